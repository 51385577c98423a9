"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with the same set of word shingles are one class. Class
representatives that agree in a whole band of MinHash values are candidates.
Their values are compared some at a time; a pair whose posterior probability of
reaching the threshold falls below a tolerance is dropped, and what is left is
verified on the shingle sets.

A bucket may hold thousands of classes. Pairs are therefore never rows: a
representative travels once to the least member (the pivot) of each of its
buckets, large groups are dealt as pairs of blocks, and a task returns a row for each
member, with its number of links and one link to its cluster. A pair that
meets at several pivots counts at the least of them.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import folded_words, join_dealt, settle, text_key

SHINGLE = 5
THRESHOLD = 0.8
#: 24 bands of 4 values: two sets of similarity 0.8 share no band with a chance of 3 in a million.
BANDS, ROWS = 24, 4
#: MinHash values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6
#: Members of a block and bytes of their shingles; a group of more is dealt as pairs of blocks.
BLOCK, BLOCK_BYTES = 512, 64 << 20
CACHED_WORDS = 500_000
_A = np.uint64(0x9E3779B97F4A7C15)
_S = np.uint64(32)
_seeds = np.random.default_rng(20240229)
_MULTIPLY = _seeds.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _seeds.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


class WordKeys(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        key = self[word] = xxhash.xxh64_intdigest(word)
        return key


def shingles(text: bytes, keys: WordKeys) -> np.ndarray:
    """Sorted distinct 64-bit keys of the text's word shingles; a shorter text is one shingle, a wordless one has none."""
    words = folded_words(text)
    ids = np.fromiter(map(keys.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(ids))
    if not k:
        return ids
    out = np.full(len(ids) - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ ids[j : len(ids) - k + 1 + j]) * _A
        out ^= out >> _S
    return np.unique(out)


def minhash(keys: np.ndarray) -> np.ndarray:
    """32-bit MinHash values."""
    least = np.full(len(_MULTIPLY), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(keys), 4096):
        part = keys[at : at + 4096]
        for i in range(len(_MULTIPLY)):
            least[i] = min(least[i], (part * _MULTIPLY[i] + _ADD[i]).min())
    return (least >> _S).astype(np.uint32)


@cache
def least_matches(threshold: float) -> tuple[int, ...]:
    """For each number of compared values, the fewest matches at which a pair stays.

    The posterior of the similarity under a uniform prior after m matches of n is Beta(m + 1, n - m + 1).
    """
    grid = (np.arange(20000) + 0.5) / 20000
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            weight = np.exp(log - log.max())
            if weight[grid >= threshold].sum() / weight.sum() >= TOLERANCE:
                break
        out.append(m)
    return tuple(out)


def prune(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (a[i], b[j]) of signatures may reach the threshold."""
    alive, matches = np.arange(len(i)), np.zeros(len(i), np.int32)
    for step, least in enumerate(least_matches(threshold)):
        cut = slice(step * STEP, (step + 1) * STEP)
        matches = matches + (a[i[alive], cut] == b[j[alive], cut]).sum(1)
        stay = matches >= least
        alive, matches = alive[stay], matches[stay]
    return alive


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, n, set_key`` (128-bit digest of the shingle set) and ``signature`` of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        keys = WordKeys()
        for batch in batches:
            sizes, digests, values = [], [], []
            for text in batch.column(2).to_pylist():
                own = shingles(text or b"", keys)
                sizes.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                values.append(minhash(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(values, pa.binary())],
                ["doc_id", "text_key", "n", "set_key", "signature"],
            )

    text = F.col("text")
    rows = docs.select("doc_id", text_key(text).alias("text_key"), text.cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, n long, set_key binary, signature binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """``class, band, bucket`` of the representatives."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, BANDS, ROWS)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array(batch.column(0)), BANDS)),
                    pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)),
                    pa.array(_signed(band_keys(values).reshape(-1))),
                ],
                ["class", "band", "bucket"],
            )

    return classes.select("class", "signature").mapInArrow(run, "class long, band int, bucket long")


def band_keys(values: np.ndarray) -> np.ndarray:
    out = np.zeros(values.shape[:2], np.uint64)
    for k in range(ROWS):
        out = (out ^ values[:, :, k]) * _A
        out ^= out >> _S
    return out


def _links(key, left: pa.Table, right: pa.Table, threshold: float) -> pa.Table:
    """Links between two blocks of one pivot's members (the same block twice: within it)."""
    pivot, same = key[0].as_py(), key[1].as_py() == key[2].as_py()
    a = _Members(left)
    b = a if same else _Members(right)
    owner = np.full((len(a.ids), len(b.ids)), np.iinfo(np.int64).max)
    for k in range(BANDS):
        meet = (a.buckets[:, k, None] == b.buckets[None, :, k]) & (a.pivots[:, k, None] >= 0)
        np.minimum(owner, a.pivots[:, k, None], out=owner, where=meet)
    i, j = np.nonzero(np.triu(owner == pivot, 1) if same else owner == pivot)
    alive = prune(a.values, b.values, i, j, threshold)
    links = {}, {}
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for x, y in zip(i[alive].tolist(), j[alive].tolist(), strict=True):
        small, large = sorted((len(a.sets[x]), len(b.sets[y])))
        if small < threshold * large:
            continue
        both = len(np.intersect1d(a.sets[x], b.sets[y], assume_unique=True))
        if both >= threshold * (small + large - both) - 1e-9:
            p, q = int(a.ids[x]), int(b.ids[y])
            links[0][p] = links[0].get(p, 0) + 1
            links[1][q] = links[1].get(q, 0) + 1
            p, q = sorted((top(p), top(q)))
            root[q] = p
    total = {c: links[0].get(c, 0) + links[1].get(c, 0) for c in links[0].keys() | links[1].keys()}
    ids = sorted(total)
    return pa.table({"class": pa.array(ids, pa.int64()), "n_links": pa.array([total[c] for c in ids], pa.int64()), "root": pa.array([top(c) for c in ids], pa.int64())})


class _Members:
    """A block's classes with their signatures, buckets, pivots and sorted shingles."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("class")
        self.ids = np.array(table["class"])
        n = len(self.ids)
        self.values = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint32).reshape(n, BANDS * ROWS)
        self.buckets = band_keys(self.values.reshape(n, BANDS, ROWS))
        self.pivots = np.full((n, BANDS), -1, np.int64)  # -1: a bucket without others
        for row, (bands, pivots) in enumerate(zip(table["bands"].to_pylist(), table["pivots"].to_pylist(), strict=True)):
            self.pivots[row, bands] = pivots
        self.sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]


def components(links: DataFrame) -> DataFrame:
    """``class, cluster`` (its least class) for the links ``class, root``; contracts until no link is left."""
    edges = settle(links.where("class <> root").select("class", "root").distinct())
    maps: list[DataFrame] = []
    while edges.limit(1).count():
        # Every node joins its least neighbour; hubs are combined before the shuffle.
        both = edges.select(F.col("class").alias("node"), F.col("root").alias("other")).unionByName(
            edges.select(F.col("root").alias("node"), F.col("class").alias("other"))
        )
        step = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label"))
        step = settle(step)
        maps.append(step)
        a, b = step.select(F.col("node").alias("_a"), F.col("label").alias("a")), step.select(F.col("node").alias("_b"), F.col("label").alias("b"))
        edges = edges.join(a, F.col("class") == F.col("_a")).join(b, F.col("root") == F.col("_b"))
        edges = edges.where("a <> b").select(F.greatest("a", "b").alias("class"), F.least("a", "b").alias("root")).distinct()
        edges = settle(edges)
    if not maps:
        return links.select("class", F.col("class").alias("cluster")).limit(0)
    out = maps[0].select(F.col("node").alias("class"), F.col("label").alias("cluster"))
    for k, step in enumerate(maps[1:]):
        step = step.select(F.col("node").alias(f"_n{k}"), F.col("label").alias(f"_l{k}"))
        out = out.join(step, F.col("cluster") == F.col(f"_n{k}"), "left").select("class", F.coalesce(f"_l{k}", "cluster").alias("cluster"))
    return out


def join_near(docs: DataFrame, **options) -> DataFrame:
    """Near-duplicate classes by the Jaccard similarity of five-word shingle sets.

    Words are folded as in ``folded_words``. Returns for each row ``doc_id,
    text_key, copy_id`` (the least doc_id with the same shingle set), ``n_links``
    (other shingle sets at the threshold or above) and ``class_id`` (the least
    doc_id that links of such sets lead to). A text of one to four words is one
    shingle; a null or wordless text has an empty set, no links, and is a class
    by its row alone. Rows that repeat are copies. A null doc_id with
    words takes part under its own class, with no number: its ids are null.

    Two sets of similarity 0.8 stay apart with a chance of about 3 in a million
    for the bands and of ``TOLERANCE`` for the pruning; less above 0.8. Options: ``threshold``, ``block``,
    ``block_bytes``.
    """
    return labelled(docs, **options).drop("cluster")


def labelled(docs: DataFrame, *, threshold: float = THRESHOLD, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """As :func:`join_near`, with the number of the class, ``cluster``, null for wordless texts."""
    rows = settle(signatures(docs))
    sets = rows.where("set_key IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("copy_id"), F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("signature").alias("signature"), F.first("n").alias("n"), F.count("*").alias("n_rows")
    )
    classes = numbered(sets)
    buckets = _buckets(classes)
    pivots = buckets.groupBy(F.col("band").alias("_band"), F.col("bucket").alias("_bucket")).agg(F.min("class").alias("pivot"), F.count("*").alias("n_met")).where("n_met > 1")
    met = join_dealt(buckets, settle(pivots), {"band": "_band", "bucket": "_bucket"}, "n_met", F.col("class"))
    met = settle(met.groupBy("class").agg(F.collect_list("band").alias("bands"), F.collect_list("pivot").alias("pivots")))
    members = _with_shingles(docs, classes, met)
    blocks = met.join(classes.select(F.col("class").alias("_class"), "n"), F.col("class") == F.col("_class")).select(F.explode(F.array_distinct("pivots")).alias("_pivot"), "n")
    # A block for each member at most: a set beyond the bytes is alone.
    n_blocks = F.least(F.count("*"), F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") * 8 / block_bytes)))
    large = settle(blocks.groupBy("_pivot").agg(n_blocks.cast("int").alias("n_blocks"), F.count("*").alias("n_members")).where("n_blocks > 1"))
    sent = members.withColumn("pivot", F.explode(F.array_distinct("pivots")))
    sent = join_dealt(sent, large, {"pivot": "_pivot"}, "n_members", F.col("class"), "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("class", "pivot"), F.col("n_blocks")).cast("int")
    sent = settle(sent.select("pivot", "n_blocks", own.alias("own"), "class", "signature", "bands", "pivots", "shingles"))
    every = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    left = sent.withColumn("other", F.explode(F.filter(every, lambda x: x >= F.col("own"))))
    right = sent.withColumn("other", F.explode(F.filter(every, lambda x: x < F.col("own"))))
    links = left.groupBy("pivot", "own", "other").cogroup(right.groupBy("pivot", "other", "own")).applyInArrow(
        lambda key, a, b: _links(key, a, b, threshold), "class long, n_links long, root long"
    )
    links = settle(links)
    counted = links.groupBy("class").agg(F.sum("n_links").alias("n_links"))
    clusters = components(links)
    return _labelled(rows, classes, counted, clusters)


def numbered(sets: DataFrame, bits: int = 62) -> DataFrame:
    """The sets with a number each, ``class``: a hash of the 128-bit digest; those that meet by chance get others until all differ."""
    number = lambda turn: F.xxhash64("set_key", F.lit(turn)).bitwiseAND(F.lit((1 << bits) - 1))
    classes, turn = settle(sets.withColumn("class", number(0))), 0
    while classes.groupBy("class").count().where("count > 1").limit(1).count():
        turn += 1
        first = classes.groupBy(F.col("class").alias("_class")).agg(F.min("set_key").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        joined = classes.join(first, F.col("class") == F.col("_class"), "left")
        other = F.when(F.col("set_key") == F.coalesce("_first", "set_key"), F.col("class")).otherwise(number(turn))
        classes = settle(joined.withColumn("class", other).drop("_class", "_first"))
    return classes


def _with_shingles(docs: DataFrame, classes: DataFrame, met: DataFrame) -> DataFrame:
    """The members with signatures and shingle sets, from the texts of their first documents."""
    need = met.join(classes.select(F.col("class").alias("_class"), "first", "signature"), F.col("class") == F.col("_class")).drop("_class")
    need = need.select("class", "signature", "bands", "pivots", F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key"))
    text = F.col("text")
    rows = docs.select("doc_id", text_key(text).alias("text_key"), text.cast("binary").alias("text"))
    joined = rows.join(need, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))

    def run(batches):
        keys = WordKeys()
        for batch in batches:
            sets = [shingles(t or b"", keys).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sets, pa.binary())], ["class", "signature", "bands", "pivots", "shingles"])

    made = joined.select("text", "class", "signature", "bands", "pivots").mapInArrow(
        run, "class long, signature binary, bands array<int>, pivots array<long>, shingles binary"
    )
    return made.dropDuplicates(["class"])


def _labelled(rows: DataFrame, classes: DataFrame, counted: DataFrame, clusters: DataFrame) -> DataFrame:
    clusters = clusters.select(F.col("class").alias("_c1"), "cluster")
    linked = counted.join(clusters, F.col("class") == F.col("_c1")).drop("_c1")
    linked = settle(linked.join(classes.select(F.col("class").alias("_c2"), F.col("copy_id").alias("_copy")), F.col("class") == F.col("_c2")).drop("_c2"))
    # Most classes have no link: only the others look for their cluster's least doc_id.
    least = settle(linked.groupBy(F.col("cluster").alias("_cluster")).agg(F.min("_copy").alias("class_id"), F.count("*").alias("_size")))
    linked = join_dealt(linked, least, {"cluster": "_cluster"}, "_size", F.col("class")).select(F.col("class").alias("_c3"), "n_links", "cluster", "class_id")
    known = classes.select("set_key", "class", "copy_id", "n_rows").join(linked, F.col("class") == F.col("_c3"), "left")
    known = known.select(
        F.col("set_key").alias("_set"), "copy_id", "n_rows", "n_links", F.coalesce("cluster", "class").alias("cluster"),
        F.when(F.col("cluster").isNull(), F.col("copy_id")).otherwise(F.col("class_id")).alias("class_id"),
    )
    # A set may be that of a third of all rows.
    out = join_dealt(rows.select("doc_id", "text_key", "set_key"), settle(known), {"set_key": "_set"}, "n_rows", F.xxhash64("doc_id", "text_key"), "left")
    return out.select(
        "doc_id",
        "text_key",
        F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        "cluster",
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents without all but one of each class: the row of the least doc_id stays, at a tie that of the least text key.

    Of equal rows one stays. Wordless documents stay, each once for its doc_id and text.
    """
    marked = labelled(docs, **options)
    first = marked.where("cluster IS NOT NULL").groupBy("cluster").agg(F.min(F.struct("doc_id", "text_key")).alias("f")).select("f.doc_id", "f.text_key")
    kept = first.unionByName(marked.where("cluster IS NULL").select("doc_id", "text_key").distinct())
    kept = kept.select(F.col("doc_id").alias("_k_id"), F.col("text_key").alias("_k_key"))
    same = docs["doc_id"].eqNullSafe(kept["_k_id"]) & (text_key(docs["text"]) == kept["_k_key"])
    chosen = docs.join(kept, same, "left_semi")
    return chosen.dropDuplicates(["doc_id", "text"])
