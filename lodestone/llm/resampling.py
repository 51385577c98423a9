"""Importance resampling towards a target distribution over hashed n-grams.

A text is lower-cased, its separators are collapsed to single spaces, and one
overlapped regular expression emits the spans of all n-grams, whose checksums are counted in buckets.
Each document's buckets are written once. Their sums over the corpus and over the target give
every bucket a gain, a document's weight is the sum of its gains, and weights with
Gumbel noise from a seeded hash, largest first, draw the documents without replacement. The drawn
ones are ranked range by range, so that they may be any share of the corpus.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import folded_words, shared_folder

BUCKETS = 10_000


def ngram_pattern(n: int) -> regex.Pattern:
    """Spans of ``n`` words between single spaces; the bounds keep an overlapped scan from starting or ending inside a word."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))


def ngrams(text: bytes, patterns: list[regex.Pattern]) -> Iterator[bytes]:
    """The n-grams of a folded text whose words stand between single spaces."""
    for pattern in patterns:
        for m in pattern.finditer(text, overlapped=True):
            yield m.group()


def _counted(texts: DataFrame, sizes: tuple[int, ...], buckets: int, keep: list[str]) -> DataFrame:
    """``keep``, the numbers of words and features, and the features' buckets in order with their counts, as little-endian 32-bit numbers."""
    kinds = {c: texts.schema[c].dataType.simpleString() for c in keep}
    patterns = [ngram_pattern(n) for n in sizes]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, found, counts = [], [], [], []
            for k in range(batch.num_rows):
                own = folded_words(batch.column(len(keep))[k].as_py() or b"")
                words.append(len(own))
                spans = np.fromiter(map(crc32, ngrams(b" ".join(own), patterns)), np.uint32)
                features.append(len(spans))
                some, n = np.unique(spans % buckets, return_counts=True)
                found.append(some.astype("<u4").tobytes())
                counts.append(n.astype("<u4").tobytes())
            arrays = [*batch.columns[: len(keep)], pa.array(words, pa.int64()), pa.array(features, pa.int64())]
            arrays += [pa.array(found, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "n_words", "n_features", "buckets", "counts"])

    columns = "".join(f"{c} {t}, " for c, t in kinds.items())
    return texts.select(*keep, F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, f"{columns}n_words long, n_features long, buckets binary, counts binary")


def _totals(counted: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket; a task sums its own rows before the shuffle."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for found, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[np.frombuffer(found, "<u4")] += np.frombuffer(counts, "<u4")
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    sums = counted.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # at most a row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of its smoothed shares in the target and in the source, in thousandths, floors down."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from 32 bits of a hash of the seed and the doc_id (a null one: nothing)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, *, sizes: tuple[int, ...] = (1,), buckets: int = BUCKETS, least_words: int = 20, percent: int = 10, seed: int = 2024
) -> DataFrame:
    """A row for each document: ``doc_id, n_words, n_features, weight, score, rank``.

    ``sizes`` are the n of the n-grams. Of the N documents with ``least_words`` or more, ``percent * N / 100``
    (rounded down) with the highest scores are drawn: ``rank`` counts them from 1, ties by the smaller doc_id (null last),
    then more features; the others' is null. Each row is a document: equal rows are drawn each by itself and have one score.
    A null text has no words. Columns besides doc_id and text don't matter. No documents give no rows; an empty target gives gains all the same.
    """
    session = docs.sparkSession
    folder = f"{shared_folder(session)}/resampled-{uuid.uuid4().hex}"
    _counted(docs, sizes, buckets, ["doc_id"]).write.option("compression", "zstd").parquet(f"{folder}/counted")
    counted = session.read.parquet(f"{folder}/counted")
    sent = session.sparkContext.broadcast(gains(_totals(counted, buckets), _totals(_counted(target, sizes, buckets, []), buckets)))  # a number for each bucket
    kind = docs.schema["doc_id"].dataType.simpleString()

    def weigh(batches):
        gain = sent.value
        for batch in batches:
            pairs = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
            weight = [int(gain[np.frombuffer(found, "<u4")] @ np.frombuffer(counts, "<u4").astype(np.int64)) for found, counts in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    scored = counted.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long").withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    # Equal rows are told apart by where they are written, so that ranges can part them.
    scored.withColumn("_serial", F.monotonically_increasing_id()).write.parquet(f"{folder}/scored")
    scored = session.read.parquet(f"{folder}/scored")
    fit = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.asc("_serial")]
    placed = scored.where(fit).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(f"{folder}/placed")
    placed = session.read.parquet(f"{folder}/placed").withColumn("_part", F.shiftright("_at", 33))
    held = placed.groupBy("_part").agg(F.count("*").alias("_held"), F.min("_at").alias("_first"))  # a row for each partition
    earlier = F.sum("_held").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select(F.col("_part").alias("_of"), (F.coalesce(earlier, F.lit(0)) - F.col("_first") + 1).alias("_shift"), (F.sum("_held").over(Window.partitionBy()) * percent / 100).alias("_drawn"))
    rank = F.col("_at") + F.col("_shift")
    ranked = placed.join(F.broadcast(held), F.col("_part") == F.col("_of")).withColumn("rank", F.when(rank <= F.floor("_drawn"), rank))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")).select(columns))


def digest(drawn: DataFrame) -> DataFrame:
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: The CRC of a word's UTF-8 bytes, eight steps for each.
_CRC = """(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}), 2),
 lambda i: (strpos('0123456789ABCDEF', substr({0}, i, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr({0}, i + 1, 1)) - 1)),
 lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))))"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH docs AS (
    SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS words FROM documents
), own AS (
    SELECT row, word, count(*) AS n FROM (SELECT row, unnest(words) AS word FROM docs) GROUP BY row, word
), wanted AS (
    SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS word FROM benchmark) GROUP BY word
), bucket AS (
    SELECT word, {_CRC.format('hex')} % 10000 AS bucket FROM (SELECT word, hex(encode(word)) AS hex FROM (SELECT word FROM own UNION SELECT word FROM wanted))
), source AS (
    SELECT bucket, sum(n) AS s FROM own JOIN bucket USING (word) GROUP BY bucket
), target AS (
    SELECT bucket, sum(n) AS t FROM wanted JOIN bucket USING (word) GROUP BY bucket
), gain AS (
    SELECT range AS bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM source) + 10000)::DOUBLE
        / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM target) + 10000)::DOUBLE)))::BIGINT AS gain
    FROM range(10000) LEFT JOIN source ON source.bucket = range LEFT JOIN target ON target.bucket = range
), weights AS (
    SELECT row, sum(n * gain)::BIGINT AS weight FROM own JOIN bucket USING (word) JOIN gain USING (bucket) GROUP BY row
), scored AS (
    SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
        + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM docs LEFT JOIN weights USING (row)
), placed AS (
    SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id NULLS LAST, n_features DESC) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM placed
"""
