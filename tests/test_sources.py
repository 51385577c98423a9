"""Readers of binary, partitioned and paged files, and the statistics that cut groups into ranges."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import measures as M
from lodestone.functions import text as X
from lodestone.jobs import JOBS, corpus, points
from lodestone.operators import points as P
from lodestone.operators import ordered
from lodestone.operators import statistics as S
from lodestone.sources import binary, files, paged

SF = "/root/testdata/sf0.001"


def ply(points, form="ascii"):
    head = f"ply\nformat {form} 1.0\ncomment made here\nelement vertex {len(points)}\nproperty float x\nproperty float y\nproperty uchar red\nproperty double z\nelement face 0\nproperty list uchar int vertex_indices\nend_header\n".encode()
    if form == "ascii":
        return head + "".join(f"{x} {y} 7 {z}\n" for x, y, z in points).encode()
    order = "<" if "little" in form else ">"
    return head + b"".join(struct.pack(order + "ffBd", x, y, 7, z) for x, y, z in points)


def png(pixels, filters):
    """A PNG file whose rows are filtered by the given kinds in turn."""
    height, width, channels = pixels.shape
    flat, lines = pixels.reshape(height, -1).astype(int), []
    for y in range(height):
        up = flat[y - 1] if y else np.zeros(width * channels, int)
        left = np.concatenate([np.zeros(channels, int), flat[y][:-channels]])
        corner = np.concatenate([np.zeros(channels, int), up[:-channels]])
        first = left + up - corner
        near = np.stack([abs(first - left), abs(first - up), abs(first - corner)]).argmin(0)
        guess = (np.zeros_like(up), left, up, (left + up) // 2, np.choose(near, [left, up, corner]))
        kind = filters[y % len(filters)]
        lines.append(bytes([kind]) + ((flat[y] - guess[kind]) % 256).astype(np.uint8).tobytes())
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_point_files(spark, tmp_path):
    points = [(0.5, -1.0, 2.0), (3.0, 4.0, 5.25)]
    for name, form in (("a", "ascii"), ("b", "binary_little_endian"), ("c", "binary_big_endian")):
        (tmp_path / f"{name}.ply").write_bytes(ply(points, form))
    np.savez(tmp_path / "d.npz", points=np.array(points), other=np.zeros(2))
    (tmp_path / "e.ply").write_bytes(b"not a cloud\nend_header\n")
    (tmp_path / "f.ply").write_bytes(ply([]))
    rows, bad = binary.point_files(spark, f"{tmp_path}/*")
    got = {}
    for r in rows.orderBy("path", "pid").collect():
        got.setdefault(r["path"][-5], []).append((r["x"], r["y"], r["z"]))
    assert got == {k: points for k in "abcd"}
    assert [r["path"][-5:] for r in bad.collect()] == ["e.ply"]
    near = P.near_within(rows.where("path LIKE '%a.ply'"), rows.where("path LIKE '%d.npz'"), "pid", 1.0)
    assert {r["distance"] for r in near.collect()} == {0.0}


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_pixel_files(spark, tmp_path, channels):
    pixels = np.random.default_rng(channels).integers(0, 256, (11, 7, channels))
    (tmp_path / "a.png").write_bytes(png(pixels, [0, 1, 2, 3, 4]))
    (tmp_path / "b.png").write_bytes(b"nothing")
    rows, bad = binary.pixel_files(spark, f"{tmp_path}/*.png")
    got = {(r["y"], r["x"], r["channel"]): round(r["value"] * 255) for r in rows.collect()}
    assert got == {(y, x, c): int(pixels[y, x, c]) for y in range(11) for x in range(7) for c in range(channels)}
    assert bad.count() == 1


def test_image_error_over_pixel_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (20, 20, 3))
    b = np.clip(a + rng.integers(-3, 4, a.shape), 0, 255)
    for name, image in (("pred", a), ("true", b)):
        (tmp_path / f"{name}.png").write_bytes(png(image, [4, 2]))
    rows, _ = binary.pixel_files(spark, f"{tmp_path}/*.png")
    side = lambda name: rows.where(F.col("path").contains(name)).select("y", "x", "channel", F.col("value").alias(name))
    both = side("pred").join(side("true"), ["y", "x", "channel"])
    got = both.agg(M.psnr(F.avg((F.col("pred") - F.col("true")) ** 2)).alias("psnr")).first()["psnr"]
    assert got == pytest.approx(-10 * np.log10((((a - b) / 255.0) ** 2).mean()))


def test_scenes_are_directories(spark, tmp_path):
    for scene, marked in (("s1", True), ("s2", True), ("s3", False)):
        (tmp_path / scene / "extrinsics").mkdir(parents=True)
        (tmp_path / scene / "extrinsics" / "007_2.txt").write_text("1 0 0 5\n0 1 0 6\n0 0 1 7\n0 0 0 1\n")
        if marked:
            (tmp_path / scene / "instances").mkdir()
            (tmp_path / scene / "instances" / "x.json").write_text("{}")
    (tmp_path / "s1" / "extrinsics" / "notes.txt").write_text("?")
    got = files.scene_frames(spark, str(tmp_path)).withColumn("m", X.numbers(F.col("value")))
    assert sorted((r["scene"], r["frame"], r["cam"], r["m"][3], len(r["m"])) for r in got.collect()) == [("s1", 7, 2, 5.0, 16), ("s2", 7, 2, 5.0, 16)]


def test_inventory_totals(spark, tmp_path):
    item = lambda k, n: {"key": k, "size_bytes": n, "sha256": "0" * 64, "more": {"a": 1}}
    (tmp_path / "good.json").write_text(json.dumps({"summary": {"object_count": 2, "total_bytes": 7}, "objects": [item("a", 3), item("b", 4)]}, indent=1))
    (tmp_path / "bad.json").write_text(json.dumps({"summary": {"object_count": 2, "total_bytes": 8}, "objects": [item("a", 3), item("b", 4)]}))
    objects, checks = files.inventory(spark, f"{tmp_path}/*.json")
    assert objects.count() == 4 and {r["path"].split("/")[-1]: r["matches"] for r in checks.collect()} == {"good.json": True, "bad.json": False}


def test_report_takes_the_place_of_the_old_one(spark, tmp_path):
    path = f"{tmp_path}/report"
    read = lambda: spark.read.schema("k long").json(path)
    files.replace_report(spark.range(3).withColumnRenamed("id", "k"), path)
    files.replace_report(read().selectExpr("k + 10 AS k"), path)  # made of the rows that it replaces
    assert sorted(r["k"] for r in read().collect()) == [10, 11, 12]
    assert [p.name for p in tmp_path.iterdir()] == ["report"]


def test_every_pair_with_few_or_many(spark):
    rows, few = spark.range(20), spark.range(5).withColumnRenamed("id", "c")
    for most in (10, 3):
        assert P.with_every(rows, few, most).count() == 100


def test_ledger_drift(spark, tmp_path):
    for d in ("records", "notes"):
        (tmp_path / d).mkdir()
    items = [{"id": f"E{k}", "title": f"t{k}", "status": "done"} for k in range(5)]
    (tmp_path / "index.json").write_text(json.dumps({"items": items}))
    for k, title, status in ((0, "t0", "done"), (1, "other", "done"), (2, "t2", "open"), (4, "t4", "done"), (5, "t5", "done")):
        (tmp_path / "records" / f"E{k}.json").write_text(json.dumps({"experiment_id": f"E{k}", "title": title, "status": status}))
    for k, status in ((0, "done"), (1, "done"), (2, "open"), (4, "review"), (5, "done")):
        (tmp_path / "notes" / f"E{k}.md").write_text(f"---\nid: E{k}\nstatus: {status}\n---\ntext\n")
    got = {(r["id"], r["record"]) for r in files.ledger_drift(spark, str(tmp_path)).collect()}
    assert got == {("E1", "E1"), ("E2", "E2"), ("E3", None), ("E4", "E4"), (None, "E5")}


def test_paged_pulls_stop(spark, tmp_path):
    def pages(seed, sizes, day="2025-06-01"):
        (tmp_path / seed).mkdir()
        for n, size in enumerate(sizes):
            (tmp_path / seed / f"{n}.json").write_text(json.dumps([{"id": f"{seed}{n}-{k}", "title": "t", "published": day if n < 2 else "2020-01-01"} for k in range(size)]))

    pages("short", [3, 3, 2, 3])
    pages("empty", [3, 0, 3])
    pages("long", [3] * 10)
    pages("gone", [])
    paged.register(spark)
    pull = lambda **o: {r["seed"]: r["count"] for r in spark.read.format("paged").options(pagesize=3, **o).load(str(tmp_path)).groupBy("seed").count().collect()}
    assert pull(cap=10) == {"short": 8, "empty": 3, "long": 10}
    assert pull(cap=100, since="2025-01-01") == {"short": 8, "empty": 3, "long": 9}


def test_matrix_functions(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(30, 4, 4))
    m[7] = np.ones((4, 4))
    rows = spark.createDataFrame([(k, x.reshape(-1).tolist()) for k, x in enumerate(m)], "k long, m array<double>")
    centre = M.camera_centre(F.col("m"))
    for r in rows.select("k", M.inverse4(F.col("m")).alias("inverse"), M.determinant4(F.col("m")).alias("det"), *(c.alias(f"c{k}") for k, c in enumerate(centre))).collect():
        x = m[r["k"]]
        if r["k"] == 7:
            assert r["inverse"] is None and r["c0"] is None
            continue
        assert np.allclose(np.array(r["inverse"]).reshape(4, 4) @ x, np.eye(4), atol=1e-6) and r["det"] == pytest.approx(np.linalg.det(x))
        assert np.allclose(x[:3] @ [r["c0"], r["c1"], r["c2"], 1.0], 0, atol=1e-6)


def test_text_readers(spark):
    report = "+--+\n| NPU | Process |\n| 0  1 | 4711 | python train | 10 |\n|  1 0 | 0 | idle |\n| x 0 | 5 | y |"
    row = spark.range(1).select(
        X.device_processes(F.lit(report)).alias("a"), X.csv_processes(F.lit("12, python\n\n 13,b , c\nx, y")).alias("b"),
        X.intrinsics(X.numbers(F.lit(" 100 101\n50  51 0 0\n"))).alias("k"), X.intrinsics(X.numbers(F.lit("1 2"))).alias("none"), X.numbers(F.lit("1 x")).alias("n"),
        *(X.frame_list(F.lit(t)).alias(f"f{k}") for k, t in enumerate(("range:10:200:10", "3, 5,8", "range:5:5:1", "a,1"))),
    ).first()
    assert [tuple(x) for x in row["a"]] == [(4711, "python train")] and [tuple(x) for x in row["b"]] == [(12, "python"), (13, "c"), (None, "y")]
    assert row["k"] == [100.0, 0.0, 50.0, 0.0, 101.0, 51.0, 0.0, 0.0, 1.0] and row["none"] is None and row["n"] == [1.0, None]
    assert row["f0"] == list(range(10, 200, 10)) and row["f1"] == [3, 5, 8] and row["f2"] == [] and row["f3"] is None


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(ordered, "SMALL", 0)


def test_numbering_by_ranges(spark, small_ranges):
    rng = np.random.default_rng(6)
    values = [(("a", "b", None)[k % 3], float(v), k) for k, v in enumerate(np.round(rng.exponential(size=900), 2).tolist())] + [("a", None, 900)]
    rows = spark.createDataFrame(values, "g string, v double, w long")
    got = S.numbered(rows, ["g"], "v").collect()
    for g in ("a", "b", None):
        own = sorted((r["_nth"], r["v"]) for r in got if r["g"] == g and r["v"] is not None)
        assert [v for _, v in own] == sorted(v for x, v, _ in values if x == g and v is not None)
        assert sorted(r["_nth"] for r in got if r["g"] == g) == list(range(sum(x == g for x, *_ in values)))
    exact = {(r["g"], r["q"]): r["value"] for r in S.quantiles(rows, ["g"], "v", (0.0, 0.1, 0.5, 0.99, 1.0)).collect()}
    for (g, q), v in exact.items():
        assert v == pytest.approx(np.quantile([y for x, y, _ in values if x == g and y is not None], q))
    assert len(exact) == 15
    assert S.quantiles(rows.limit(0), ["g"], "v", (0.5,)).count() == 0


def test_moving_average_over_blocks(spark, small_ranges):
    values = {"a": np.random.default_rng(7).normal(size=300).round(3), "b": np.arange(9.0), "c": np.arange(15.0)}
    rows = spark.createDataFrame([(g, k, float(v)) for g, x in values.items() for k, v in enumerate(x)], "run string, iter long, v double").repartition(5)
    got = {}
    for r in S.moving_average(rows, ["run"], "iter", "v", 15, block=40).orderBy("run", "iter").collect():
        got.setdefault(r["run"], []).append(r["v"])
    assert got["a"] == pytest.approx([values["a"][k : k + 15].mean() for k in range(286)])
    assert got["b"] == list(range(9)) and got["c"] == [7.0]
    ends = {r["run"]: (r["head"], r["tail"]) for r in S.ends(rows, ["run"], "iter", "v", 20).collect()}
    assert ends["a"] == pytest.approx((values["a"][:20].mean(), values["a"][-20:].mean())) and ends["b"] == (4.0, 4.0)


def test_nearest_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(9, 6)) * 4
    a, b = (centres[rng.integers(0, 9, n)] + rng.normal(size=(n, 6)) for n in (150, 400))
    frame = lambda v: spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(None, None)], "id long, v array<double>")
    exact = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)).min(1)
    for pivots, block in ((16, 30), (1, 1000), (64, 7)):
        got = {r["id"]: r["distance"] for r in P.nearest_vectors(frame(a), frame(b), "id", "v", pivots=pivots, block_rows=block).collect()}
        assert [got[k] for k in range(150)] == pytest.approx(exact.tolist()) and len(got) == 150
    assert {r["distance"] for r in P.nearest_vectors(frame(a), frame(b[:0]), "id", "v").collect()} == {None}


@pytest.mark.parametrize("spread", [1.0, 0.0])
def test_nearest_points_equal_brute_force(spark, spread):
    rng = np.random.default_rng(12)
    a = np.concatenate([rng.normal(size=(150, 3)) * [1, spread, 1], [[9.0, -3.0, 8.0], [0.0, 0.0, 0.0]]])
    b = np.concatenate([rng.normal(size=(300, 3)) * [1, spread, 0.01], [[0.0, 0.0, 0.0]] * 3])
    frame = lambda v: spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(v)] + [(-1, None, 1.0, 1.0)], "id long, x double, y double, z double")
    got = {r["id"]: r["distance"] for r in P.nearest_points(frame(a), frame(b), "id").collect()}
    exact = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)).min(1)
    assert got.pop(-1) is None and [got[k] for k in range(len(a))] == pytest.approx(exact.tolist(), abs=1e-9)
    assert {r["distance"] for r in P.nearest_points(frame(a), frame(b[:0]), "id").collect()} == {None}
    one = P.nearest_points(frame(a[:3]), frame(b[:1]), "id").where("distance IS NOT NULL").collect()
    assert sorted(r["distance"] for r in one) == pytest.approx(sorted(np.sqrt(((a[:3] - b[:1]) ** 2).sum(1)).tolist()))
    assert P.nearest_points(frame(a).where("false"), frame(b), "id").count() == 0


def test_nearest_points_meet_few_others(spark, monkeypatch):
    """The share of all pairs whose distances are computed, on the given vectors."""
    p = points.points(spark, "/root/testdata/sf0.1")
    a, b = p.where("label < 5"), p.where("label >= 5")
    pairs = spark.sparkContext.accumulator(0)
    plain = P.squared_distance

    def counted(x, y):
        tell = F.udf(lambda d: (pairs.add(1), d)[1], "double")
        return tell(plain(x, y))

    monkeypatch.setattr(P, "squared_distance", counted)
    P.nearest_points(a, b, "vec_id").count()
    share = pairs.value / (a.count() * b.count())
    print(f"{share:.1%} of the pairs compared")
    assert 0 < share < 0.5


def test_flat_text_is_made_once(spark):
    for name in ("a02_weighted_capped_score", "p05_rescore_threshold", "a01_probe_counts", "p10_key_hit"):
        plan = JOBS.queries[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace(") == 1, name


def test_occurrences_fold_case(spark):
    texts = ["Token toKEN tokentoken", "ſch SCH ſCH", "İsch", "", "aaaa"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in rows.select(*(X.occurrences(X.folded(F.col("t")), p) for p in ("token", "sch", "aa"))).collect()]
    assert got == [(4, 0, 0), (0, 3, 0), (0, 1, 0), (0, 0, 0), (0, 0, 2)]
    assert [tuple(r) for r in rows.select(*(X.count(F.col("t"), p) for p in ("token", "sch", "aa"))).collect()] == got


def test_patterns_in_folded_text_count_alike(spark):
    """With the literal that a pattern needs asked first."""
    assert X.required("akia[a-z0-9]+") == "akia" and X.required("[a-z.]+@[a-z]{2}") == "@" and X.required("a|b") == "" and X.required("xab?c") == "xa"
    rng = np.random.default_rng(3)
    letters = list("licensed LICENCE\u212a\u017f\u0130İtokenAKIA@.09-- the of de la") + ["token", "AKIA", "released under", "the ", " of", "555-1234", "De La"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(600)] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", X.folded(F.col("t")))
    bodies = [b for v in corpus.LEXICON.categories.values() for b in v] + list(corpus.LEXICON.strong)
    plain = rows.select(*(X.count(F.col("t"), b) for b in bodies), *(X.has(F.col("t"), b) for b in bodies)).collect()
    folded = rows.select(*(X.count_folded(F.col("low"), b) for b in bodies), *(X.has_folded(F.col("low"), b) for b in bodies)).collect()
    assert [tuple(r) for r in plain] == [tuple(r) for r in folded] and sum(map(sum, (r[: len(bodies)] for r in map(tuple, plain[:600])))) > 300
