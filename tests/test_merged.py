"""Tables that grow by upserts, and sketches kept in one."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.operators import sketches
from lodestone.sources import merged

SF = "/root/testdata/sf0.001"
MERGES = {"created": merged.least, "updated": merged.largest, "seen": merged.union}
SCHEMA = "digest string, created long, updated long, seen array<string>"


def ledger(spark, path, **options):
    return merged.MergedTable(spark, str(path), ["digest"], MERGES, **options)


def rows_of(table):
    return sorted((tuple(r) for r in table.read(SCHEMA).collect()), key=str)


def files_of(path):
    return {str(p.relative_to(path)): os.stat(p).st_mtime_ns for p in Path(path).glob("data/**/*.parquet")}


@pytest.fixture(scope="module")
def batches(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.sha2("text", 256).alias("digest"), F.col("doc_id").alias("created"), F.col("doc_id").alias("updated"), F.array("source").alias("seen"))
    return [docs.where("created % 2 = 0"), docs.where("created % 2 = 1")]


def test_batches_in_any_order_and_twice_give_one_ledger(spark, tmp_path, batches):
    results = []
    for name, order in {"a": (0, 1), "b": (1, 0), "c": (0, 1, 0)}.items():
        table = ledger(spark, tmp_path / name, buckets=8)
        assert [table.upsert(batches[k], f"batch {k}") for k in order][:2] == [1, 2]
        results.append(rows_of(table))
    assert results[0] == results[1] == results[2]
    once = ledger(spark, tmp_path / "d", buckets=3)
    once.upsert(batches[0].unionByName(batches[1]), "all")
    assert rows_of(once) == results[0]
    # The same rows under another name change nothing, so that no file is written.
    before = files_of(tmp_path / "a")
    again = ledger(spark, tmp_path / "a")
    assert again.upsert(batches[0], "batch 0 again") == 3 and rows_of(again) == results[0] and files_of(tmp_path / "a") == before


def test_only_buckets_that_change_are_written(spark, tmp_path):
    table = ledger(spark, tmp_path / "t", buckets=16)
    rows = lambda data: spark.createDataFrame(data, SCHEMA)
    table.upsert(rows([(f"d{k}", k, k, ["x"]) for k in range(200)]), "first")
    before, live = files_of(tmp_path / "t"), table.manifest()["folders"]
    assert table.manifest()["buckets"] == 16 and len(live) == 16
    table.upsert(rows([("d7", 3, 3, ["x"]), ("d9", 500, 500, ["y"]), ("d8", 8, 8, ["x"])]), "second")
    now = table.manifest()["folders"]
    moved = {b for b in now if now[b] != live[b]}
    number = {r["d"]: str(r["b"]) for r in spark.createDataFrame([("d7",), ("d9",), ("d8",)], "d string").select("d", F.pmod(F.xxhash64("d"), F.lit(16)).alias("b")).collect()}
    assert moved == {number["d7"], number["d9"]}  # d8 is as it was
    assert {k: t for k, t in files_of(tmp_path / "t").items() if k in before} == before
    got = {r["digest"]: tuple(r)[1:] for r in table.read(SCHEMA).collect()}
    assert got["d7"] == (3, 7, ["x"]) and got["d9"] == (9, 500, ["x", "y"]) and len(got) == 200


def test_nothing_is_seen_before_it_is_published(spark, tmp_path, monkeypatch):
    table, rows = ledger(spark, tmp_path / "t", buckets=2), lambda k: spark.createDataFrame([(f"d{k}", k, k, ["x"])], SCHEMA)
    table.upsert(rows(1), "one")
    with monkeypatch.context() as m:
        m.setattr(table, "_publish", lambda manifest: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.upsert(rows(2), "two")
    assert rows_of(table) == [("d1", 1, 1, ["x"])] and table.manifest()["applied"] == ["one"]
    assert table.upsert(rows(2), "two") == 2 and len(rows_of(table)) == 2
    # A writer that started from an older version must not undo the newer one.
    with pytest.raises(merged.Conflict):
        table._publish({**table.manifest(), "version": 2})
    assert len(rows_of(table)) == 2 and not [p for p in (tmp_path / "t" / "manifest").iterdir() if ".json" not in p.name]


def test_edges(spark, tmp_path):
    table = ledger(spark, tmp_path / "t", buckets=4)
    assert rows_of(table) == []
    rows = spark.createDataFrame([(None, 5, 5, ["b"]), (None, 2, None, None), ("d", None, 1, [])], SCHEMA)
    table.upsert(rows.where("false"), "none")
    table.upsert(rows.withColumn("bucket", F.lit(1)).withColumn("_new", F.lit(1)), "some")
    assert rows_of(table) == [("d", None, 1, []), (None, 2, 5, ["b"])]
    table.upsert(spark.createDataFrame([(None, 1, 9, ["a"])], SCHEMA), "more")
    assert rows_of(table) == [("d", None, 1, []), (None, 1, 9, ["a", "b"])]


def test_sketches_are_kept_and_merged(spark, tmp_path):
    rows = spark.range(60_000).select(F.col("id"), F.date_add(F.lit("2024-01-01"), (F.col("id") % 10).cast("int")).alias("day"), F.lit("k").alias("kind"), (F.col("id") % 7001).alias("job"), (F.col("id") * 7919 % 60_013).cast("double").alias("value"))
    kept = sketches.kept_by_day(spark, str(tmp_path / "s"))
    made = lambda part: sketches.states(part, ["day", "kind"], "job", "value")
    late = "day = '2024-01-03' AND id >= 50000"
    kept.upsert(made(rows.where(f"NOT ({late})")), "first")
    schema = made(rows).schema
    told = lambda: {r["day"]: tuple(r) for r in sketches.answers(kept.read(schema), (0.5,)).collect()}
    before, days, live = files_of(tmp_path / "s"), told(), kept.manifest()["folders"]
    kept.upsert(made(rows.where(late)), "late")
    now = kept.manifest()["folders"]
    # The late day's bucket alone is written; its other days, if it has any, say what they said.
    assert sum(now[b] != live[b] for b in now) == 1 and {k: t for k, t in files_of(tmp_path / "s").items() if k in before} == before
    after = told()
    assert {str(d) for d in after if after[d] != days[d]} == {"2024-01-03"}
    exact = rows.groupBy("day").agg(F.count("*").alias("n"), F.count_distinct("job").alias("d"), F.median("value").alias("m")).collect()
    spread = 4 * 1.04 / 2 ** (sketches.LOG_REGISTERS / 2)
    for r in exact:
        _, _, n, distinct, median = after[r["day"]]
        assert n == r["n"] and abs(distinct / r["d"] - 1) <= spread and abs(median - r["m"]) <= 2 * sketches.RANK_ERROR * 60_013
    total = sketches.answers(sketches.united(kept.read(schema), ["kind"]), (0.0, 0.25, 1.0)).first()
    assert total["n"] == 60_000 and abs(total["n_distinct"] / 7001 - 1) <= spread and abs(total["q_25"] / 60_013 - 0.25) <= 2 * sketches.RANK_ERROR
    assert total["q_0"] == 0.0 and total["q_100"] == rows.agg(F.max("value")).first()[0]
