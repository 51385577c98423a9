"""Lexicons as tables: all terms of a lexicon are found in one pass over a text, by an Aho-Corasick automaton.

A lexicon unrolled into the plan ends at some hundred terms. Here its table is
made into automata of bounded size, which are shipped as bytes and run over Arrow batches. A lexicon beyond the bound is dealt
over several automata by a hash of the term; each takes a pass over the texts, and nothing else is shuffled.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator, Sequence
from string import ascii_lowercase

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scratch import settled

#: Bytes of terms in one automaton, which takes some ten to forty times as many.
BLOCK_BYTES = 4 << 20


class Terms:
    """The automaton of some terms, and what their lexicons weigh them."""

    def __init__(self, rows: Iterable[tuple[str, str, float]]):
        """Rows are lexicon, term, weight; a term may be in several lexicons."""
        self.terms: list[str] = []
        weights: list[list[tuple[str, float]]] = []
        self.automaton = ahocorasick.Automaton()
        number: dict[str, int] = {}
        for lexicon, term, weight in rows:
            if term not in number:
                number[term] = len(self.terms)
                self.terms.append(term)
                weights.append([])
                self.automaton.add_word(term, number[term])
            weights[number[term]].append((lexicon, weight))
        # Terms of the same lexicons and weights share one tuple.
        same: dict[tuple, tuple] = {}
        self.weights: list[tuple[tuple[str, float], ...]] = [same.setdefault(w, w) for w in map(tuple, weights)]
        self.automaton.make_automaton()

    def counts(self, text: str, inside: frozenset[str]) -> dict[int, int]:
        """How often each term is there: its occurrences from left to right that don't overlap. With ``inside`` only whole words: no such character may be beside them."""
        out: dict[int, int] = {}
        free: dict[int, int] = {}
        size = len(text)
        for end, k in self.automaton.iter(text) if self.terms else ():
            start = end + 1 - len(self.terms[k])
            if inside and ((start and text[start - 1] in inside) or (end + 1 < size and text[end + 1] in inside)):
                continue
            if start >= free.get(k, 0):
                free[k] = end + 1
                out[k] = out.get(k, 0) + 1
        return out

    def scores(self, counts: dict[int, int], cap: int) -> dict[str, tuple[float, int]]:
        """For each lexicon the weights times counts up to ``cap``, and how many of its terms are there."""
        out: dict[str, tuple[float, int]] = {}
        for k, n in counts.items():
            for lexicon, weight in self.weights[k]:
                score, terms = out.get(lexicon, (0.0, 0))
                out[lexicon] = score + weight * min(n, cap), terms + 1
        return out


def packed(terms: Terms) -> bytes:
    """A Python worker keeps the bytes of every automaton that it has met, but only one automaton at a time."""
    return zlib.compress(pickle.dumps(terms), 1)


def unpacked(held: bytes) -> Terms:
    return pickle.loads(zlib.decompress(held))


def automata(lexicon: DataFrame) -> list[Broadcast]:
    """``lexicon`` (``lexicon, term, weight``) as packed automata of about :data:`BLOCK_BYTES` of terms; empty and null terms are left out, equal rows count once."""
    rows = lexicon.select("lexicon", "term", F.col("weight").cast("double").alias("weight")).where("term IS NOT NULL AND term <> ''")
    rows = settled(rows.groupBy("lexicon", "term").agg(F.max("weight").alias("weight")))
    size = rows.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    context, out = rows.sparkSession.sparkContext, []
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("term"), F.lit(n)) == k) if n > 1 else rows
        out.append(context.broadcast(packed(Terms(sorted(map(tuple, block.toLocalIterator()), key=lambda r: (r[1], str(r[0])))))))
    return out


def _pass(docs: DataFrame, text: str, sent: Broadcast, keep: Sequence[str], schema: str, columns: Sequence[str], made) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = unpacked(sent.value)
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for k in range(batch.num_rows):
                found = made(terms, batch.column(0)[k].as_py() or "")
                at += [k] * len(found)
                rows += found
            kept = batch.select(range(1, batch.num_columns)).take(pa.array(at, pa.int64())) if rows else batch.select(range(1, batch.num_columns)).slice(0, 0)
            values = zip(*rows, strict=True) if rows else ([] for _ in columns)
            arrays = [pa.array(list(v), t) for v, t in zip(values, _ARROW[tuple(columns)], strict=True)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *arrays], [*keep, *columns])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col(text).alias("_text"), *keep).mapInArrow(run, f"{kinds}, {schema}")


_ARROW = {("term", "n"): (pa.string(), pa.int64()), ("lexicon", "score", "n_terms"): (pa.string(), pa.float64(), pa.int64())}


def term_counts(docs: DataFrame, text: str, lexicon: DataFrame, keep: Sequence[str], *, inside: str = "") -> DataFrame:
    """``keep, term, n``: a row for each row of ``docs`` and term that its column ``text`` holds.

    Terms are found as they are written: fold text and terms first where case doesn't matter. ``inside`` are the characters
    of words, where only whole words count. A null text holds no term; lexicons of any size give the same rows.
    """
    word, out = frozenset(inside), None
    for sent in automata(lexicon):
        found = _pass(docs, text, sent, keep, "term string, n long", ("term", "n"), lambda terms, t: [(terms.terms[k], n) for k, n in terms.counts(t, word).items()])
        out = found if out is None else out.unionByName(found)
    return out


def lexicon_scores(docs: DataFrame, text: str, lexicon: DataFrame, keep: Sequence[str], cap: int, *, inside: str = "") -> DataFrame:
    """``keep, lexicon, score, n_terms``: a row for each row of ``docs`` and lexicon of which it holds a term.

    ``score`` sums the weights times counts up to ``cap``. Nothing is shuffled unless the lexicons take several automata.
    """
    word, sent = frozenset(inside), automata(lexicon)
    made = lambda terms, t: [(name, *s) for name, s in terms.scores(terms.counts(t, word), cap).items()]
    parts = lambda rows, b, kept: _pass(rows, text, b, kept, "lexicon string, score double, n_terms long", ("lexicon", "score", "n_terms"), made)
    if len(sent) == 1:
        return parts(docs, sent[0], list(keep))
    # Parts of one row meet by a number that is written with it.
    rows = settled(docs.select(*keep, text).withColumn("_row", F.monotonically_increasing_id()))
    out = None
    for b in sent:
        found = parts(rows, b, ["_row", *keep])
        out = found if out is None else out.unionByName(found)
    return out.groupBy("_row", *keep, "lexicon").agg(F.sum("score").alias("score"), F.sum("n_terms").alias("n_terms")).drop("_row")


LETTERS = ascii_lowercase
