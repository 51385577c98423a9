"""Crowded views, table functions, and probes of devices."""

from __future__ import annotations

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.functions import tables
from lodestone.functions import text as X
from lodestone.operators import crowded, probes
from lodestone.operators import supervision as V

BOX = "frame long, line long, entity long, depth double, x0 double, y0 double, x1 double, y1 double"


def brute(rows):
    out = {}
    for frame, line, entity, depth, x0, y0, x1, y1 in rows:
        best = 0.0
        for f, _, e, d, a0, b0, a1, b1 in rows:
            if f == frame and None not in (f, e, entity, d, depth) and e != entity and d < depth:
                w, h = min(x1, a1) - max(x0, a0), min(y1, b1) - max(y0, b0)
                if w > 0 and h > 0:
                    best = max(best, w * h / max((x1 - x0) * (y1 - y0), 1e-6))
        out[frame, line] = best
    return out


@pytest.mark.parametrize("crowd", [0, 60, 10**6])
def test_hidden_in_views_of_any_size(spark, crowd):
    rng = random.Random(4)
    rows = []
    for line in range(170):
        x, y = rng.uniform(-20, 20), rng.uniform(0, 30)
        depth = rng.choice([None, 1.0, 2.0, 2.0, 3.5, 9.0]) if line % 10 else None
        rows.append((rng.choice([1, 1, 1, 2, None]), line, rng.choice([None, *range(40)]), depth, x, y, x + rng.choice([0.0, 0.001, 1.0, 7.0, 50.0]), y + rng.uniform(0, 5)))
    got = crowded.hidden(spark.createDataFrame(rows, BOX), ["frame"], ["line"], "entity", "depth", crowded=crowd)
    got = {(r["frame"], r["line"]): r["occlusion"] for r in got.collect()}
    expected = brute(rows)
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(v, abs=1e-8) for k, v in expected.items())


def test_a_view_of_a_hundred_thousand_boxes_ends(spark):
    n = 100_000
    at = F.pmod(F.col("id") * 7919, F.lit(n)).cast("double")
    boxes = spark.range(n).select(F.lit(1).alias("frame"), F.col("id").alias("line"), F.col("id").alias("entity"), (F.col("id") % 977).cast("double").alias("depth"), at.alias("x0"), F.lit(0.0).alias("y0"), (at + 4.5).alias("x1"), F.lit(3.0).alias("y1"))
    began = time.perf_counter()
    out = crowded.hidden(boxes, ["frame"], ["line"], "entity", "depth").agg(F.count("*"), F.sum("occlusion"), F.count_if(F.col("occlusion") > 0)).first()
    assert out[0] == n and out[2] > n // 2 and time.perf_counter() - began < 120
    x = (np.arange(n) * 7919 % n).astype(int)
    depth = np.empty(n)
    depth[x] = np.arange(n) % 977
    best = np.zeros(n)
    for k in (-4, -3, -2, -1, 1, 2, 3, 4):
        here = np.arange(max(0, -k), min(n, n - k))
        nearer = depth[here + k] < depth[here]
        best[here] = np.maximum(best[here], np.where(nearer, (4.5 - abs(k)) / 4.5, 0))
    assert out[1] == pytest.approx(best.sum(), rel=1e-6)


def test_pairs_are_counted_without_making_them(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, None]), rng.choice([None, *range(9)]), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(120)] + [(3, 1, 1.0), (3, 1, 2.0)]
    frame = spark.createDataFrame(rows, "frame long, entity long, depth double")
    got = {r["frame"]: tuple(r)[1:] for r in crowded.nearer_pairs(frame, ["frame"], "entity", "depth").collect()}
    for f in (1, 2):
        own = [(e, d) for g, e, d in rows if g == f and e is not None and d is not None]
        pairs = [(a, b) for e, a in own for g, b in own if e != g]
        assert got.pop(f) == (len(pairs), sum(b < a for a, b in pairs), sum(a == b for a, b in pairs))
    assert not got
    assert "Join" in crowded.nearer_pairs(frame, ["frame"], "entity", "depth")._jdf.queryExecution().optimizedPlan().toString()


def test_table_functions_take_nulls_and_split_documents(spark):
    tables.register(spark)
    rows = [(1, "a token, a Token and a licence token"), (2, None), (3, ""), (4, "token"), (4, "token token")]
    spark.createDataFrame(rows, "doc_id long, t string").createOrReplaceTempView("some_texts")
    got = spark.sql("SELECT * FROM snippets('token', 2, 2, 4, TABLE(some_texts) PARTITION BY doc_id)").collect()
    assert sorted((r["doc_id"], r["start"], r["snippet"]) for r in got if r["doc_id"] == 1) == [(1, 2, "a token, "), (1, 11, "a Token a")]
    assert {r["doc_id"] for r in got} == {1, 4} and sum(r["doc_id"] == 4 for r in got) == 2
    points = [(1, 5, 1.0, 0.0, 0.0), (1, 4, 2.0, 3.0, 0.0), (1, None, None, 0.0, 3.0), (2, 1, 1.0, 1.0, 1.0), (3, 1, 1.0, None, 2.0)]
    spark.createDataFrame(points, "entity long, cam long, depth double, px double, py double").createOrReplaceTempView("some_points")
    cells = spark.sql("SELECT * FROM hull_pixels(9, 9, TABLE(some_points) PARTITION BY entity)").collect()
    assert sorted(tuple(r) for r in cells) == [(1, 4, 1.0, x, y) for x, y in ((0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0))]


def test_probes_keep_their_reasons_and_failures(spark):
    own = probes.Registry()

    @own.add("even")
    def even(readings):
        if (readings["n"] == 7).any():
            raise RuntimeError("seven " + "x" * 2000)
        return pd.DataFrame({"available": readings["n"] % 2 == 0, "reason": ["because " * 300 + str(n) for n in readings["n"]]})

    own.add("short")(lambda readings: pd.DataFrame({"available": [], "reason": []}))
    own.add("silent")(lambda readings: pd.DataFrame({"available": [None] * len(readings), "reason": [None] * len(readings)}))
    with pytest.raises(ValueError):
        own.add("even")(even)
    with pytest.raises(TypeError):
        own.add("none")(3)
    assert own.names() == ["even", "short", "silent"]
    readings = spark.createDataFrame([(k,) for k in range(10)], "n long").coalesce(1)
    got = {(r["probe"], r["n"]): r for r in own.ask(readings, own.names(), ["n"]).collect()}
    assert len(got) == 30
    assert all(got["even", n]["available"] == (n % 2 == 0) and not got["even", n]["failed"] and len(got["even", n]["reason"]) == 1000 for n in range(10) if n != 7)
    assert got["even", 7]["failed"] and got["even", 7]["available"] is None and got["even", 7]["reason"].endswith("x')") and len(got["even", 7]["reason"]) == 1000
    assert all(got["short", n]["failed"] and "0 answers to 1" in got["short", n]["reason"] for n in range(10))
    assert all(not got["silent", n]["failed"] and got["silent", n]["available"] is None and got["silent", n]["reason"] is None for n in range(10))
    assert own.ask(readings.where("false"), ["even"], ["n"]).count() == 0


def test_from_device_reports_to_a_resource_that_stays_free(spark):
    """Reports as text, probed for processes; free from minute 30 on, after a busy minute 20."""
    busy, free = "| 0 0 | 41 | train.py |", "| 0 0 | 0 | |"
    reports = [(1, 60 * m, busy if m in (0, 20) else free) for m in range(0, 60, 10)]
    rows = spark.createDataFrame(reports, "job long, s long, report string").withColumn("processes", F.transform(X.device_processes(F.col("report")), lambda p: p["name"]))
    said = probes.PROBES.ask(rows, ["no_process"], ["job", "s"])
    assert {r["s"]: (r["available"], r["reason"]) for r in said.collect()} == {60 * m: ((False, "train.py") if m in (0, 20) else (True, "free")) for m in range(0, 60, 10)}
    log = said.select("job", F.timestamp_seconds("s").alias("ts"), F.col("s").alias("event_id"), "available")
    held = V.islands(log, ~F.col("available"), 20 * 60.0).select(F.unix_seconds("acquired"))
    assert [tuple(r) for r in held.collect()] == [(50 * 60,)]
    memory = spark.createDataFrame([(1, 10.0, 100.0), (2, 90.0, 100.0), (3, None, 100.0)], "job long, used double, total double")
    got = {r["job"]: (r["available"], r["failed"]) for r in probes.PROBES.ask(memory, ["memory_left"], ["job"]).collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (None, True)}


def test_pairs_are_counted_in_as_many_tasks_as_the_input_asks_for(spark, tmp_path, monkeypatch):
    """One crowded view and many small ones, zeros of both signs at one depth."""
    rng = random.Random(5)
    data = [(0, rng.randint(0, 30), float(rng.randint(0, 20))) for _ in range(400)] + [(v, rng.randint(0, 2), rng.choice([0.0, -0.0, 1.5])) for v in range(1, 60) for _ in range(4)] + [(7, None, 1.0), (7, 1, None)]
    spark.createDataFrame(data, "v long, e long, d double").write.parquet(f"{tmp_path}/boxes")
    boxes = spark.read.parquet(f"{tmp_path}/boxes")
    monkeypatch.setattr(crowded, "SHARE", 100)
    got = crowded.nearer_pairs(boxes, ["v"], "e", "d")
    assert got.rdd.getNumPartitions() > 8
    expected = {}
    known = [r for r in data if None not in r]
    for v, e, d in known:
        for w, f, c in known:
            if v == w and e != f:
                n = expected.setdefault(v, [0, 0, 0])
                n[0] += 1
                n[1] += c < d
                n[2] += c == d
    assert sorted(map(tuple, got.collect())) == sorted((v, *n) for v, n in expected.items())
