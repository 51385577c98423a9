"""Benchmark decontamination by a prefix-filtered set join.

Every window of ``window`` item words is the set of its ``shingle``-word
shingles. Containment must be whole, so one prefix token per window is enough:
its rarest shingle by document frequency over the whole corpus. A document
position that holds a prefix token proposes one start; the length and positional
bounds must let the window lie inside the document, and the words are then
compared one by one.

The items are a query set: they reach the documents as a broadcast index in
blocks of at most ``block_bytes`` of item text (or one longer item), whatever
their number; the documents are never shuffled.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import folded_words, text_key

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


class WindowIndex:
    """Windows, vocabulary and prefix tokens of one block of items."""

    def __init__(self, items: list[tuple], window: int, shingle: int):
        self.vocabulary: dict[bytes, int] = {}
        self.owners: list[list[str]] = []
        self.windows: list[np.ndarray] = []
        seen: dict[tuple, int] = {}
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in folded_words(text or b"")]
            size = min(window, len(ids))
            for start in range(len(ids) - size + 1 if size else 0):
                key = tuple(ids[start : start + size])
                if key not in seen:
                    seen[key] = len(self.windows)
                    self.windows.append(np.array(key, np.int32))
                    self.owners.append([])
                owners = self.owners[seen[key]]
                if not owners or owners[-1] != item_id:
                    owners.append(item_id)
        #: by shingle length: sorted keys, and the number of the first of them
        self.tables: dict[int, tuple[np.ndarray, int]] = {}
        by_size: dict[int, list[np.ndarray]] = {}
        for w in self.windows:
            k = min(shingle, len(w))
            by_size.setdefault(k, []).append(shingle_keys(w, k)[0])
        n = 0
        for k, keys in sorted(by_size.items()):
            table = np.unique(np.concatenate(keys))
            self.tables[k] = (table, n)
            n += len(table)
        self.n_shingles = n
        self.shingle = shingle
        self.prefix: dict[int, list[tuple[int, int]]] = {}

    def set_prefixes(self, frequency: np.ndarray) -> None:
        """Order every window's shingles by rarity (ties by number) and keep its first."""
        for number, w in enumerate(self.windows):
            k = min(self.shingle, len(w))
            table, first = self.tables[k]
            own = first + np.searchsorted(table, shingle_keys(w, k)[0])
            offset = int(np.lexsort((own, frequency[own]))[0])
            self.prefix.setdefault(int(own[offset]), []).append((offset, number))
        self.is_prefix = np.zeros(self.n_shingles, bool)
        self.is_prefix[list(self.prefix)] = True

    def word_ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and shingle numbers of what the document shares with the items."""
        places, numbers = [], []
        for k, (table, first) in self.tables.items():
            keys, at = shingle_keys(ids, k)
            if len(keys):
                slot = np.minimum(np.searchsorted(table, keys), len(table) - 1)
                same = table[slot] == keys
                places.append(at[same])
                numbers.append(first + slot[same])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(places), np.concatenate(numbers)

    def find(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], list[str]]:
        """Merged [start, end) word runs that item windows cover, and the items met."""
        places, numbers = self.occurrences(ids)
        keep = self.is_prefix[numbers]
        runs, found = set(), set()
        for p, s in zip(places[keep].tolist(), numbers[keep].tolist(), strict=True):
            for offset, number in self.prefix[s]:
                w, start = self.windows[number], p - offset
                if start < 0 or start + len(w) > len(ids):
                    continue
                if np.array_equal(ids[start : start + len(w)], w):
                    runs.add((start, start + len(w)))
                    found.update(self.owners[number])
        found.discard(None)  # an item without an id covers words and isn't named
        return merged(runs), sorted(found)


def shingle_keys(ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the k-word shingles without unknown words (id 0), and their places."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    known = np.cumsum(np.concatenate(([0], ids != 0)))
    at = np.flatnonzero(known[k:] - known[:-k] == k)
    keys = np.zeros(len(at), np.uint64)
    for j in range(k):
        keys = (keys ^ ids[at + j].astype(np.uint64)) * _MIX
        keys ^= keys >> _SHIFT
    return keys, at


def merged(runs) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def item_blocks(items: DataFrame, item_id: str, block_bytes: int):
    """The distinct items on the driver, one bounded block after another."""
    own = items.select(F.col(item_id).cast("string").alias("id"), F.col("text").cast("binary").alias("text")).distinct()
    total = own.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(b""))) + 16)).first()[0] or 0
    n = max(1, math.ceil(1.25 * total / block_bytes)) if total > block_bytes else 1
    for k in range(n):
        part = own if n == 1 else own.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield sorted(((r["id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or "", r[1] or b""))


def find_overlaps(
    docs: DataFrame,
    items: DataFrame,
    *,
    item_id: str = "item_id",
    window: int = 10,
    shingle: int = 5,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """Where documents hold windows of benchmark items.

    Returns per document row ``doc_id, text_key, n_words, spans`` (array of
    ``start, end``: runs of covered words) and ``item_ids`` (strings, sorted).
    A null or wordless text has no words and no spans; a wordless item has no
    window; an item shorter than ``window`` is one window. Items repeated or
    equal under several ids are all named; an item whose id is null can cover
    words and is not named. Rows that repeat a doc_id are judged each on its own
    text. Empty documents or items give an empty or an all-clean result.
    """
    session = docs.sparkSession
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.col("text").cast("binary").alias("text"))
    parts = []
    for block in item_blocks(items, item_id, block_bytes):
        index = WindowIndex(block, window, shingle)
        sent = session.sparkContext.broadcast(index)

        def count(batches, sent=sent):
            index = sent.value
            total = np.zeros(index.n_shingles, np.int64)
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    _, numbers = index.occurrences(index.word_ids(folded_words(text or b"")))
                    total[np.unique(numbers)] += 1
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["number", "n"])

        frequency = np.zeros(index.n_shingles, np.int64)
        if index.n_shingles:
            counted = rows.select("text").mapInArrow(count, "number long, n long")
            for r in counted.groupBy("number").agg(F.sum("n").alias("n")).collect():
                frequency[r["number"]] = r["n"]
        index.set_prefixes(frequency)
        sent = session.sparkContext.broadcast(index)

        def probe(batches, sent=sent):
            index = sent.value
            for batch in batches:
                sizes, spans, items = [], [], []
                for text in batch.column(2).to_pylist():
                    words = folded_words(text or b"")
                    runs, found = index.find(index.word_ids(words))
                    sizes.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in runs])
                    items.append(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(sizes, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    ["doc_id", "text_key", "n_words", "spans", "item_ids"],
                )

        kind = docs.schema["doc_id"].dataType.simpleString()
        parts.append(rows.mapInArrow(
            probe,
            f"doc_id {kind}, text_key long, n_words long, spans array<struct<start:long,end:long>>, item_ids array<string>",
        ))
    if len(parts) == 1:
        return parts[0]
    return _joined(parts)


def _joined(parts: list[DataFrame]) -> DataFrame:
    """One row per document from several blocks of items; a document that repeats stays repeated."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    copies = F.col("copies") / F.lit(len(parts))
    flat = F.sort_array(F.flatten(F.collect_set("spans")))
    # Runs in order of their start: glue each to the last one or open a new one.
    glue = lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
        F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(
                F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")
            )),
        ),
    ).otherwise(F.concat(acc, F.array(s)))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return (
        rows.groupBy("doc_id", "text_key", "n_words")
        .agg(
            F.aggregate(flat, empty, glue).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
            F.count("*").alias("copies"),
        )
        .select("doc_id", "text_key", "n_words", "spans", "item_ids", F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("copy"))
        .drop("copy")
    )


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without those that hold a benchmark window; all their columns stay.

    The verdicts are joined back on doc_id and text key; repeated rows stay repeated.
    """
    bad = find_overlaps(docs, items, **options).where(F.size("spans") > 0)
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key")).distinct()
    same = docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (text_key(docs["text"]) == bad["_bad_key"])
    return docs.join(bad, same, "left_anti")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _held_sql(table: str, key: str) -> str:
    """Words by place, each with itself and the nine that follow it."""
    return f"""SELECT *, list(word) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS held FROM (
    SELECT r, {key}, len(w) AS n_words, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT r, {key}, {_WORDS} AS w FROM {table}))"""


ORACLE = f"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
items AS (SELECT row_number() OVER () AS r, item_id, text FROM benchmark),
item_words AS ({_held_sql('items', 'item_id')}),
windows AS (SELECT DISTINCT item_id, len(held) AS k, held FROM item_words WHERE len(held) = least(10, n_words)),
lengths AS (SELECT DISTINCT k FROM windows),
doc_words AS ({_held_sql('numbered', 'doc_id')}),
hits AS (
  SELECT DISTINCT d.r, d.pos, d.k, w.item_id FROM (SELECT r, pos, k, held[1:k] AS held FROM doc_words, lengths WHERE len(held) >= k) d JOIN windows w ON d.k = w.k AND d.held = w.held),
covered AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(pos, pos + k)) AS place FROM (SELECT DISTINCT r, pos, k FROM hits)) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(coalesce({_WORDS}, []))::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM numbered LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
