"""Importance resampling against plain Python, whole tables and edge cases."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries, resampling

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def words_of(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features(text, sizes):
    w = words_of(text)
    return [" ".join(w[k : k + n]) for n in sizes for k in range(len(w) - n + 1)]


def expected(docs, target, sizes=(1,), buckets=10000, least=20, percent=10, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    counts = [Counter(map(bucket, features(t, sizes))) for _, t in docs]
    source, wanted = sum(counts, Counter()), Counter(bucket(f) for _, t in target for f in features(t, sizes))
    s, t = source.total(), wanted.total()
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in source}
    rows = []
    for (doc_id, text), c in zip(docs, counts, strict=True):
        weight = sum(gain[b] * n for b, n in c.items())
        h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, c.total(), weight, score, None, len(words_of(text))])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.select(COLUMNS).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_overlapped_scan_emits_every_run_of_words(n):
    rng = random.Random(n)
    for _ in range(300):
        words = ["".join(rng.choice("abé1") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 12))]
        text = " ".join(words).encode()
        assert list(resampling.ngrams(text, [resampling.ngram_pattern(n)])) == [" ".join(words[k : k + n]).encode() for k in range(len(words) - n + 1)]


def test_query_against_brute_force_and_sql(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(None, r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    frame = queries.op13_resample(spark, SF)
    assert frame.columns == COLUMNS
    assert [t for _, t in frame.dtypes] == ["bigint"] * 5
    assert got(frame) == expected(docs, items)
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    assert sorted(con.sql(resampling.ORACLE).select(*COLUMNS).fetchall(), key=str) == expected(docs, items)


def test_longer_runs_and_other_parameters(spark):
    rng = random.Random(9)
    docs = [(k, " ".join(rng.choice(["Red", "green", "blue,", "one", "two", "né"]) for _ in range(rng.randint(0, 60)))) for k in range(120)]
    target = [(None, "red green blue one"), (None, "two two né")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = expected(docs, target, sizes=(1, 2), buckets=64, least=5, percent=35, seed=7)
    drawn = resampling.resample(frame, spark.createDataFrame(target, "item_id string, text string"), sizes=(1, 2), buckets=64, least_words=5, percent=35, seed=7)
    assert got(drawn) == want
    assert sum(r[4] is not None for r in want) > 20


def test_draw_leans_to_the_target():
    source, target = np.array([90, 10, 0]), np.array([10, 90, 0])
    gain = resampling.gains(source, target)
    assert gain[0] < -1000 < 1000 < gain[1] and gain[2] == 0


def test_edges(spark):
    long = "word " * 30
    rows = [(1, None), (2, ""), (3, "Short one"), (None, long), (5, long), (5, long), (5, long + "tail"), (6, "É é ß " * 9000), (7, "!?" * 50), (8, "a " * 19), (9, "a " * 20)]
    rows += [(10, long)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = docs.select("*", *(F.lit("z").alias(c) for c in ("n_words", "score", "RANK", "_at", "_part", "buckets", "weight", "_serial")))
    target = spark.createDataFrame([("i", "word"), (None, None)], "item_id string, text string")
    assert got(resampling.resample(clashing, target)) == expected(rows, [(None, "word")])
    assert got(resampling.resample(docs, target.where("false"))) == expected(rows, [])
    assert resampling.resample(docs.where("false"), target).collect() == []
    few = docs.where("doc_id < 9 AND doc_id <> 5")
    assert all(r["rank"] is None for r in resampling.resample(few, target).collect())
