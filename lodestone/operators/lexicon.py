"""Documents against lexicons: counts, capped scores, topics.

A lexicon is a small list in code (terms, weights, patterns), so that its
patterns are constants of the plan: each is compiled once a task. Counting is
narrow; nothing is shuffled before the aggregation that a caller asks for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T


@dataclass(frozen=True)
class Lexicon:
    """Weighted literal probes, pattern categories, strong patterns, context words."""

    probes: Mapping[str, int]
    categories: Mapping[str, Sequence[str]]
    strong: Sequence[str]
    context: Sequence[str]


def once(docs: DataFrame, name: str, made: Column) -> DataFrame:
    """``docs`` with a column that the optimiser can't repeat: an array of one, exploded, is computed once for each row."""
    return docs.select("*", F.explode(F.array(made)).alias(name))


def probe_counts(docs: DataFrame, text: Column, probes: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """A row for each document and probe that it holds: ``probe, n``; counting happens once, before the rows are made."""
    docs, low = once(docs, "_low", T.folded(text)), F.col("_low")
    each = F.array(*(F.struct(F.lit(p).alias("probe"), T.occurrences(low, p).alias("n")) for p in probes))
    return docs.select(*keep, F.explode(each).alias("p")).select(*keep, "p.probe", "p.n").where("n > 0")


def _category(low: Column, start: Column, bodies: Sequence[str]) -> tuple[Column, Column]:
    """Counts in a folded text, and whether its ``start`` has a match."""
    total, early = F.lit(0), F.lit(False)
    for b in bodies:
        total = total + T.count_folded(low, b)
        early = early | T.has_folded(start, b)
    return total.cast("long"), early


def category_counts(docs: DataFrame, text: Column, categories: Mapping[str, Sequence[str]], keep: Sequence[str]) -> DataFrame:
    """A row for each document and category: the sum of its patterns' counts, whose spans may overlap, and whether it is met early."""
    docs = once(once(docs, "_low", T.folded(text)), "_start", F.substring("_low", 1, 1800))
    made = {k: _category(F.col("_low"), F.col("_start"), v) for k, v in categories.items()}
    each = F.array(*(F.struct(F.lit(k).alias("category"), n.alias("n"), early.alias("early")) for k, (n, early) in made.items()))
    return docs.select(*keep, F.explode(each).alias("c")).select(*keep, "c.category", "c.n", "c.early")


def category_columns(docs: DataFrame, text: Column, categories: Mapping[str, Sequence[str]], keep: Sequence[str]) -> DataFrame:
    """A row for each document: the counts of all categories, a column each; nothing is shuffled."""
    low = F.col("_low")
    counts = F.struct(*(_category(low, low, v)[0].alias(k) for k, v in categories.items()))
    return once(once(docs, "_low", T.folded(text)), "_c", counts).select(*keep, "_c.*")


def capped_score(docs: DataFrame, text: Column, lexicon: Lexicon, keep: Sequence[str], cap: int, bonus: int) -> DataFrame:
    """``score``: weights times counts up to ``cap``, and ``bonus`` if a strong pattern is met; ``n_strong`` of them."""
    docs, low = once(docs, "_low", T.folded(text)), F.col("_low")
    base, strong = F.lit(0), F.lit(0)
    for p, w in lexicon.probes.items():
        base = base + w * F.least(T.occurrences(low, p), F.lit(cap))
    for b in lexicon.strong:
        strong = strong + T.has_folded(low, b).cast("int")
    rows = once(docs, "_c", F.struct(base.alias("base"), strong.alias("n_strong"))).select(*keep, "_c.base", "_c.n_strong")
    score = F.col("base") + F.when(F.col("n_strong") > 0, F.lit(bonus)).otherwise(F.lit(0))
    return rows.select(*keep, score.cast("long").alias("score"), F.col("n_strong").cast("long").alias("n_strong"))
