"""Sketches as states that are kept and merged: distinct counts (HLL) and quantiles (KLL).

A state is made of rows once, for each group of the finest grain, and stored. What is asked
of coarser groups is answered from the union of states, without the rows. States of later rows are merged into the stored ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.merged import MergedTable, total

#: Base-two logarithm of the registers: relative error 1.04 / 2 ** (LOG_REGISTERS / 2) as a standard deviation.
LOG_REGISTERS = 12
#: Size of the quantile sketch: about 1.3 % of the rows between an answered rank and the true one, nearly always.
RANK_ERROR = 0.0133


def hll(c: str) -> Column:
    return F.hll_union_agg(c, F.lit(True))


def kll(c: str) -> Column:
    return F.kll_merge_agg_double(c)


#: How stored states are merged.
MERGES = {"n": total, "distinct": hll, "quantiles": kll}


def states(rows: DataFrame, by: Sequence[str], key: str, value: str) -> DataFrame:
    """``by, n, distinct, quantiles``: the partial states of each group; rows are combined before the shuffle."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(F.col(key).cast("string"), F.lit(LOG_REGISTERS)).alias("distinct"),
        F.kll_sketch_agg_double(F.col(value).cast("double")).alias("quantiles"),
    )


def united(kept: DataFrame, by: Sequence[str]) -> DataFrame:
    """States of coarser groups."""
    return kept.groupBy(*by).agg(*(m(c).alias(c) for c, m in MERGES.items()))


def answers(kept: DataFrame, qs: Sequence[float]) -> DataFrame:
    """Final figures of states: the columns of ``kept`` without the sketches, ``n_distinct``, and ``q_<percent>`` for each of ``qs``."""
    others = [c for c in kept.columns if c not in ("distinct", "quantiles")]
    return kept.select(
        *others,
        F.hll_sketch_estimate("distinct").alias("n_distinct"),
        *(F.kll_sketch_get_quantile_double("quantiles", F.lit(float(q))).alias(f"q_{round(100 * q)}") for q in qs),
    )


def kept_by_day(session, path: str, by: Sequence[str] = ("day", "kind"), *, buckets: int = 64) -> MergedTable:
    """A table of states that later rows are merged into: a late day's rows rewrite the bucket of that day alone."""
    return MergedTable(session, path, by, MERGES, buckets=buckets)
