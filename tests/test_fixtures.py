"""Small inputs with answers worked out by hand: boundaries, ties, traps."""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import measures as M
from lodestone.functions import text as T
from lodestone.operators import lexicon as L
from lodestone.operators import points as P
from lodestone.operators import raster as R
from lodestone.operators import statistics as S
from lodestone.operators import supervision as V
from lodestone.operators.images import masked_ssim
from lodestone.operators.snippets import windows
from lodestone.sources import files


def one(frame):
    return frame.collect()[0]


@pytest.mark.parametrize(("cap", "bonus", "text", "score"), [(6, 30, "a " * 7, 18), (5, 30, "a " * 7, 15), (6, 30, "a " * 7 + "zz", 48)])
def test_capped_score(spark, cap, bonus, text, score):
    lexicon = L.Lexicon({"a": 3}, {}, ("zz",), ())
    docs = spark.createDataFrame([(1, text)], "doc_id long, t string")
    assert one(L.capped_score(docs, F.col("t"), lexicon, ["doc_id"], cap, bonus))["score"] == score


def test_bins(spark):
    rows = spark.createDataFrame([(95.999, 0.8), (96.0, 1.01), (320.0, 0.5), (-1.0, 0.1)], "px double, vis double")
    px = M.bin_label(F.col("px"), (0, 96, 160, 320, math.inf), ("px<96", "px96-160", "px160-320", "px>320"))
    vis = M.bin_label(F.col("vis"), (0, 0.5, 0.8, 1.01), ("low", "middle", "vis>0.8"))
    assert [tuple(r) for r in rows.select(px, vis).collect()] == [("px<96", "vis>0.8"), ("px96-160", "vis>0.8"), ("px>320", "middle"), ("px>320", "low")]


def test_quantiles_interpolate(spark):
    rows = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 8)], "v double")
    got = {r["q"]: r["value"] for r in S.quantile_profile(rows, ["v"], (0.1, 0.5)).collect()}
    assert got[0.1] == pytest.approx(1.3) and got[0.5] == 3.0


def test_moving_average(spark):
    series = lambda n: spark.createDataFrame([("s", k, float(k)) for k in range(1, n + 1)], "run string, iter int, v double")
    assert [(r["iter"], r["v"]) for r in S.moving_average(series(16), ["run"], "iter", "v", 15).orderBy("iter").collect()] == [(1, 8.0), (2, 9.0)]
    assert S.moving_average(series(10), ["run"], "iter", "v", 15).count() == 10


def test_coverage_is_not_symmetric(spark):
    box = lambda *b: [F.lit(float(x)) for x in b]
    a, b, c = box(0, 0, 10, 10), box(5, 5, 15, 15), box(0, 0, 20, 20)
    got = one(spark.range(1).select(M.coverage_ratio(a, b), M.coverage_ratio(a, c), M.coverage_ratio(c, a), M.coverage_ratio(a, box(10, 0, 20, 10))))
    assert tuple(got) == (0.25, 1.0, 0.25, 0.0)


def test_macro_is_not_micro(spark):
    rows = spark.createDataFrame([("c", "A", 10.0, 1), ("c", "A", 20.0, 1), ("c", "B", 30.0, 5)], "cell string, e string, m double, px long")
    got = one(S.macro_average(rows, ["cell"], "e", "m", "px"))
    assert (got["instances"], got["pixels"], got["metric_mean"], got["metric_std"]) == (2, 7, 22.5, 7.5)


LOG = "job long, event_id long, ts timestamp, kind string, value double"


def log(spark, rows):
    frame = spark.createDataFrame([(1, k, float(t), kind, v) for k, (t, kind, v) in enumerate(rows)], "job long, event_id long, t double, kind string, value double")
    return frame.withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))


def test_limits_strict_and_not(spark):
    steps = log(spark, [(0, "view", 0.0), (900, "view", 0.0), (1800.001, "view", 0.0)])
    assert [r["gap"] for r in V.gaps(steps, 900).collect()] == [pytest.approx(900.001)]
    assert [r["threshold"] for r in V.reminders(log(spark, [(0, "view", 0.0), (900, "view", 0.0)]), (900, 901)).collect()] == [900.0]


def test_stable_for(spark):
    rows = log(spark, [(0, "free", 0.0), (10, "free", 0.0), (20, "busy", 0.0), (30, "free", 0.0), (60, "free", 0.0)])
    got = V.islands(rows, F.col("kind") == "busy", 30)
    assert one(got.select(F.unix_seconds("acquired")))[0] == 60


@pytest.mark.parametrize(
    ("rows", "code"),
    [
        ([(0, "signup", 0.0), (1, "fatal", 0.0), (2, "out", 0.0)], 3),
        ([(0, "view", 0.0), (2, "out", 0.0)], 5),
        ([(0, "signup", 0.0), (2, "view", 0.0)], 4),
        ([(0, "signup", 0.0), (2, "out", 0.0)], 0),
    ],
)
def test_exit_precedence(spark, rows, code):
    kind = F.col("kind")
    got = one(V.verdicts(log(spark, rows), start=kind == "signup", fatal=kind == "fatal", output=kind == "out", least_outputs=1, startup=10, deadline=100))
    assert got["code"] == code and got["state"] == ("COMPLETE" if code == 0 else "FAILED")
    assert (got["gate_message"] is None) == (code != 4)


def test_terminal_state_ends_a_job(spark):
    rows = log(spark, [(0, "a", 0.0), (1, "end", 0.0), (2, "end", 0.0), (3, "a", 0.0)])
    assert V.until_terminal(rows, F.col("kind") == "end").count() == 2


def test_spaced_top(spark):
    rows = spark.createDataFrame([(1, 0, 100), (1, 3, 90), (1, 5, 80), (1, 12, 70)], "e long, frame long, height long")
    assert sorted(r["frame"] for r in S.spaced_top(rows, ["e"], "frame", "height", 3, 5).collect()) == [0, 5, 12]


def test_near_within_is_strict_and_chamfer(spark):
    pts = lambda *p: spark.createDataFrame([(k, *map(float, q)) for k, q in enumerate(p)], "id long, x double, y double, z double")
    recon, truth = pts((0, 0, 0), (1, 0, 0)), pts((0, 0, 0))
    near = lambda r: [x["distance"] for x in P.near_within(recon, truth, "id", r).orderBy("id").collect()]
    assert near(20.0) == [0.0, 1.0] and near(1.0) == [0.0, None]


def test_nearest_vectors_in_blocks(spark):
    rows = spark.createDataFrame([(k, [float(k % 7), float(k // 7)]) for k in range(49)], "id long, v array<double>")
    queries, reference = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    got = {r["id"]: r["distance"] for r in P.nearest_vectors(queries, reference, "id", "v", block_rows=5).collect()}
    assert len(got) == 25 and set(got.values()) == {1.0}


def test_psnr(spark):
    rows = spark.createDataFrame([(0.01,), (0.0,), (None,)], "mse double")
    assert [r[0] for r in rows.select(M.psnr(F.col("mse"))).collect()] == [pytest.approx(20.0), None, None]


def test_psnr_falls_with_noise(spark):
    got = [one(spark.range(1).select(M.psnr(F.lit(s * s))))[0] for s in (0.005, 0.02, 0.08)]
    assert got == sorted(got, reverse=True) and got[1] == pytest.approx(33.98, abs=0.01)


def test_unicode_text(spark):
    rows = spark.createDataFrame([("a  \x1cb", "É")], "a string, b string")
    assert tuple(one(rows.select(T.flat(F.col("a")), T.count(F.col("b"), "é")))) == ("a b", 1)


def test_defaults_and_keys(spark):
    rows = spark.createDataFrame([("", "t"), (None, "t"), ("i", "t")], "id string, title string")
    assert [r[0] for r in rows.select(T.first_filled(F.col("id"), F.col("title"))).collect()] == ["t", "t", "i"]
    key = rows.limit(1).select(T.safe_key(F.lit("a b//é.x"), 80), T.safe_key(F.lit("a b//é.x"), 80, True))
    assert tuple(one(key)) == ("a_b___.x", "a_b_.x")


def test_literal_patterns(spark):
    term = "a+b.(c)[d]$^|?*{1}\\-"
    assert re.search(T.literal(term), term)
    rows = spark.createDataFrame([(term * 2, None)], "t string, u string")
    assert tuple(one(rows.select(T.count(F.col("t"), T.literal(term)), T.count(F.col("u"), "a")))) == (2, None)


def test_spearman(spark):
    rows = spark.createDataFrame([(1.0, 3.0), (2.0, 2.0), (3.0, 1.0)], "x double, y double")
    assert one(S.spearman(rows, "x", "y"))["rho"] == pytest.approx(-1.0)


def test_sample_deviation(spark):
    rows = spark.createDataFrame([(1.2339,), (1.2367,), (1.2383,)], "v double")
    got = one(rows.select(F.round(F.avg("v"), 4), F.round(F.stddev_samp("v"), 4)))
    assert tuple(got) == (1.2363, 0.0022)


def test_ranges_exclude_their_stop(spark):
    got = one(spark.range(1).select(F.filter(F.sequence(F.lit(10), F.lit(200), F.lit(10)), lambda x: x < 200)))[0]
    assert len(got) == 19 and got[-1] == 190


def test_every_nth(spark):
    got = S.every_nth(spark.range(1000).repartition(5).select(F.col("id").alias("k")), "k", 10)
    assert sorted(r["k"] for r in got.collect()) == list(range(0, 1000, 100))


def test_snippets(spark):
    rows = spark.createDataFrame([(1, "xx hit yy hit zz"), (2, None)], "k long, t string")
    got = windows(rows, "k", "t", "hit", before=3, after=3, most=5, same=4).orderBy("start").collect()
    assert [(r["k"], r["start"], r["snippet"]) for r in got] == [(1, 3, "xx hit yy"), (1, 10, "yy hit zz")]


def test_files(spark, tmp_path):
    (tmp_path / "o").mkdir()
    (tmp_path / "o/a.json").write_text('{"a": 1, "b": "x"}')
    (tmp_path / "o/b.json").write_text('[{"a": 1}]')
    (tmp_path / "o/c.json").write_text('{"a": ')
    good, bad = files.json_objects(spark, f"{tmp_path}/o/*.json", "a long, b string")
    assert [(r["a"], r["b"]) for r in good.collect()] == [(1, "x")] and bad.count() == 2

    (tmp_path / "s").mkdir()
    for k, (stats, hits) in enumerate([({"v": 1}, [{"t": "p"}]), ({"v": 2, "w": 3}, [{"t": "q"}])]):
        (tmp_path / f"s/survey_{k}.json").write_text(json.dumps({"stats": stats, "hits": hits}))
    stats, hits = files.union_of_reports(spark, f"{tmp_path}/s/*.json", "struct<t:string>")
    assert {r["key"]: r["value"] for r in stats.collect()} == {"v": 2, "w": 3} and hits.count() == 2
    files.write_report(hits, f"{tmp_path}/out")
    files.write_report(hits, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 2
    files.append_events(hits, f"{tmp_path}/log")
    files.append_events(hits, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 4

    (tmp_path / "e.jsonl").write_text('{"timestamp": "2026-01-02T03:04:05+0900", "event": "x"}\n{"timestamp": "2026-01-02T03:04:05Z"}\n{"timestamp": "?"}\n')
    assert [r[0] for r in files.events(spark, f"{tmp_path}/e.jsonl").select(F.unix_seconds("ts")).collect()] == [1767290645, 1767323045, None]
    (tmp_path / "t.tsv").write_text("# head\n\n50\t1\t2\t3\t4\t5\n")
    assert files.trace(spark, f"{tmp_path}/t.tsv").count() == 1
    (tmp_path / "m.txt").write_text(" 1 2\n3   x\n")
    assert one(files.matrices(spark, f"{tmp_path}/m.txt"))["cells"] == [1.0, 2.0, 3.0, None]
    (tmp_path / "todo.md").write_text("| s | t |\n|---|---|\n| [x] | TASK-1 | P0 | do |\n| [ ] | TASK-2 | P1 | more |\n")
    assert [tuple(r) for r in files.markdown_tasks(spark, f"{tmp_path}/todo.md").collect()] == [(True, "TASK-1", "P0", "do"), (False, "TASK-2", "P1", "more")]
    (tmp_path / "note.md").write_text("---\nstatus: screened\nurl: a:b\n---\nbody: no\n")
    assert {r["key"]: r["value"] for r in files.front_matter(spark, f"{tmp_path}/note.md").collect()} == {"status": "screened", "url": "a:b"}
    corpus = files.text_corpus(spark, f"{tmp_path}/*.txt", "c")
    assert [tuple(r) for r in corpus.collect()] == [("m.txt", "c", " 1 2\n3   x\n")]
    assert files.unseen(corpus, corpus, "doc_id").count() == 0


def test_output_gate(spark, tmp_path):
    for k, n in enumerate((1, 2, 3)):
        (tmp_path / f"g{k}.bin").write_bytes(b"x" * n)
    stats = files.file_stats(spark, f"{tmp_path}/*.bin")
    assert tuple(one(files.output_gate(stats, "g", 2, 2))) == (2, True, None)
    assert tuple(one(files.output_gate(stats, "g", 3, 2))) == (2, False, "g: 2/3 valid files")


def test_filled_hulls_against_half_planes():
    rng = np.random.default_rng(2)
    for _ in range(30):
        pts = rng.uniform(-5, 25, (6, 2))
        got = set(zip(*(v.tolist() for v in R.filled(pts, 20, 15)), strict=True))
        c = R.hull(pts)
        inside = lambda x, y: all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for a, b in zip(c, np.roll(c, -1, axis=0), strict=True))
        assert got == {(x, y) for x in range(20) for y in range(15) if inside(x + 0.5, y + 0.5)}
    assert len(R.filled(np.array([[1.0, 1.0], [5.0, 5.0]]), 9, 9)[0]) == 0


def test_pixel_owners(spark):
    cells = [("A", 5.0, k) for k in (1, 2, 3)] + [("B", 2.0, k) for k in (3, 4)]
    frame = spark.createDataFrame([(1, e, d, k, 0) for e, d, k in cells], "view long, e string, depth double, x long, y long")
    assert {r["e"]: r["visible"] for r in R.owners(frame, ["view"], "e", "depth").collect()} == {"A": pytest.approx(2 / 3), "B": 1.0}


def test_outlines(spark):
    rows = spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]), (2, None)], "k long, o array<struct<x:double,y:double>>")
    assert R.pixels(rows, ["k"], "o", 10, 10).count() == 12


def test_ssim_of_equal_shifted_and_masked_images(spark):
    flat, steps = [0.5] * 64, [k / 64 for k in range(64)]
    rows = [(1, steps, steps, [True] * 64), (2, flat, [1.0] * 64, [True] * 64), (3, steps, flat, [False] * 64), (4, None, flat, [True] * 64), (5, steps[:9], flat, [True] * 64), (6, flat, flat, None)]
    pairs = spark.createDataFrame(rows, "k int, a array<double>, b array<double>, m array<boolean>")
    got = {r["k"]: (r["ssim"], r["n_pixels"]) for r in masked_ssim(pairs, "k", "a", "b", "m", 8).collect()}
    assert got[1] == (pytest.approx(1.0), 64)
    # Without variance only the means speak: (2ab + c1) / (a^2 + b^2 + c1).
    assert got[2] == (pytest.approx(1.0001 / 1.2501), 64)
    assert got[3] == (None, 0) and got[4] == (None, 0) and got[5] == (None, 0) and got[6] == (None, 0)
    assert masked_ssim(pairs.where("k > 9"), "k", "a", "b", "m", 8).count() == 0


def test_states_end_at_the_first_terminal_event(spark):
    kinds = {1: "asooo", 2: "sfso", 3: "fs", 4: "ooos", 5: "ss", 6: "aa", 7: "soso" + "f"}
    rows = [(job, 10 * job + n, f"2024-01-01 00:00:{n:02d}", k, 1.0) for job, text in kinds.items() for n, k in enumerate(text)]
    rows.append((8, 80, "2024-01-01 00:00:00", None, None))
    log = spark.createDataFrame(rows, "job long, event_id long, ts string, kind string, value double").withColumn("ts", F.to_timestamp("ts"))
    is_kind = lambda k: F.col("kind") == k
    got = sorted((r["job"], r["event_id"] % 10, r["state"]) for r in V.states(log, start=is_kind("s"), fatal=is_kind("f"), output=is_kind("o"), outputs=3).collect())
    assert got == [
        (1, 1, "RUNNING"), (1, 4, "COMPLETE"), (2, 0, "RUNNING"), (2, 1, "FAILED"), (3, 0, "FAILED"), (4, 3, "RUNNING"), (5, 0, "RUNNING"), (7, 0, "RUNNING"), (7, 4, "FAILED"),
    ]
    gate = {r["job"]: (r["passed"], r["message"]) for r in V.output_gate(log, [("o", 1.0, 2), ("s", 1.0, 1)]).collect()}
    assert gate[1] == (True, "") and gate[5] == (False, "o: 0/2 valid files") and gate[8] == (False, "o: 0/2 valid files; s: 0/1 valid files")
