"""Orders cut into ranges, and interval joins, against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import intervals, ordered, records
from lodestone.operators import statistics as S


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(params=[2, 13])
def cut(spark, request, monkeypatch):
    """So many ranges, not put together again where they are small."""
    monkeypatch.setattr(ordered, "SMALL", 0)
    keys = {"spark.sql.shuffle.partitions": str(request.param), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def brute_as_of(left, right, strict, within=None):
    out = []
    for i, key, at in left:
        best = None
        for key2, at2, value in right:
            if key is None or at is None or key2 is None or at2 is None or key2 != key or not (at2 < at if strict else at2 <= at):
                continue
            if best is None or (at2, value) > best:
                best = (at2, value)
        if best and within is not None and at - best[0] > within:
            best = None
        out.append((i, key, at, best[1] if best else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("strict", [False, True])
def test_as_of_with_a_hot_key_ties_and_nulls(spark, cut, strict):
    rng = random.Random(7 + strict)
    left = [(k, rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(60)])) for k in range(300)] + [(900, 3, 5), (901, 4, 5)]
    # Key 1 has its last right row far before most of its left ones: it is carried over several ranges.
    right = [(1, 3, 0), (1, 3, 1), (2, 10, 5), (2, 40, 6), (2, 40, 7), (None, 1, 8), (2, None, 9), (4, 5, 10), (4, 6, 11)]
    a = spark.createDataFrame(left, "id long, key long, at long").repartition(5)
    b = spark.createDataFrame(right, "key long, seen long, value long")
    got = ordered.as_of(a, b, ["key"], "at", "seen", ["value"], tie=["value"], strict=strict)
    assert got.columns == ["id", "key", "at", "value"] and rows_of(got) == brute_as_of(left, right, strict)
    near = ordered.as_of(a, b, ["key"], "at", "seen", ["value"], tie=["value"], strict=strict, within=F.lit(12))
    assert rows_of(near) == brute_as_of(left, right, strict, 12)
    assert rows_of(ordered.as_of(a, b.where("false"), ["key"], "at", "seen", ["value"])) == sorted(((*r, None) for r in left), key=str)
    assert ordered.as_of(a.where("false"), b, ["key"], "at", "seen", ["value"]).count() == 0


def test_numbers_and_ranks(spark, cut):
    rng = random.Random(3)
    data = [(rng.choice(["a", "a", "b", None]), rng.choice([None, *range(9)]), k) for k in range(200)]
    frame = spark.createDataFrame(data, "g string, v long, k long").repartition(4)
    got = {r["k"]: tuple(r)[3:] for r in ordered.ranks(frame, ["g"], "v", tie=["k"], tiles=7).collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in data if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        n = len(own)
        for place, (_, v, k) in enumerate(own):
            first = next(i for i, r in enumerate(own) if r[1] == v)
            small, more = divmod(n, 7)
            tile = place // (small + 1) if place < more * (small + 1) else more + (place - more * (small + 1)) // small
            assert got[k] == (place + 1, first + 1, len({r[1] for r in own[:first]}) + 1, tile + 1)
    few = ordered.ranks(frame.where("k < 3"), [], "k", tie=[], tiles=10)
    assert sorted((r["k"], r["ntile"]) for r in few.collect()) == [(0, 1), (1, 2), (2, 3)]
    weighed = ordered.numbered(frame.select("g", "k", (F.col("k") % 5).alias("w")), ["g"], "k", "w")
    for r in weighed.collect():
        assert r["_nth"] == sum(k % 5 for g, _, k in data if g == r["g"] and k < r["k"]) and r["_size"] == sum(k % 5 for g, _, k in data if g == r["g"])
    assert ordered.numbered(frame.where("false"), ["g"], "k").count() == 0


def test_frames_by_value(spark, cut):
    rng = random.Random(5)
    data = [(rng.choice(["a", "a", "b", None]), rng.choice([None, *range(-20, 40)]), rng.choice([None, 1.0, 2.5])) for _ in range(300)]
    frame = spark.createDataFrame(data, "g string, at long, value double")
    out = ordered.range_sums(frame, ["g"], "at", "value", F.lit(6))
    got = {(r["g"], r["at"]): (r["n"], round(r["total"], 6)) for r in out.collect()}
    expected = {}
    for g, at, _ in data:
        if at is not None:
            own = [v for h, t, v in data if h == g and t is not None and at - 6 <= t <= at]
            expected[g, at] = len(own), round(sum(v for v in own if v is not None), 6)
    assert got == expected
    assert "SinglePartition" not in plan_of(out)


def test_small_tables_are_numbered_alike(spark, monkeypatch):
    frame = spark.createDataFrame([(g, v, 1 + v) for g in ("a", None) for v in range(9)], "g string, v long, w long")
    small = rows_of(ordered.numbered(frame, ["g"], "v", "w")), rows_of(ordered.numbered(frame, [], "v", tie=["g"]))
    monkeypatch.setattr(ordered, "SMALL", 0)
    assert small == (rows_of(ordered.numbered(frame, ["g"], "v", "w")), rows_of(ordered.numbered(frame, [], "v", tie=["g"])))


def test_no_group_is_in_one_task(spark, cut):
    """All rows have one key; each range numbers its own."""
    frame = spark.range(5000).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 5003).alias("v"))
    held = ordered.in_order(frame, ["g"], ["v"])
    sizes = [r["count"] for r in held.groupBy("_part").count().collect()]
    assert len(sizes) == cut and max(sizes) < 2 * 5000 / cut + 50
    assert rows_of(ordered.numbered(frame, ["g"], "v").select("_nth")) == sorted(((k,) for k in range(5000)), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_against_all_pairs(spark, seed):
    rng = random.Random(seed)

    def some(n, first):
        out = []
        for k in range(n):
            a = rng.randint(-300, 300)
            out.append((first + k, rng.choice([None, a]) if k % 9 == 0 else a, a + rng.choice([0, 1, 2, 3, 4, 5, 15, 16, 17, 64, 1000]), rng.choice("xy")))
        return out

    left, right = some(70, 0), some(80, 1000)
    x = spark.createDataFrame(left, "i long, a long, b long, p string")
    y = spark.createDataFrame(right, "j long, c long, d long, q string")
    pairs = [(i, j) for i, a, b, p in left for j, c, d, q in right if a is not None and c is not None and a < d and c < b and a < b and c < d]
    assert sorted(map(tuple, intervals.overlaps(x, y, ("a", "b"), ("c", "d")).select("i", "j").collect())) == sorted(pairs)
    equal = [(i, j) for i, j in pairs if left[i][3] == right[j - 1000][3]]
    assert sorted(map(tuple, intervals.overlaps(x, y, ("a", "b"), ("c", "d"), [("p", "q")]).select("i", "j").collect())) == sorted(equal)
    points = [(i, j) for i, a, *_ in left for j, c, d, _ in right if a is not None and c is not None and c <= a < d]
    assert sorted(map(tuple, intervals.holding(x, y, "a", ("c", "d")).select("i", "j").collect())) == sorted(points)
    assert intervals.overlaps(x.where("false"), y, ("a", "b"), ("c", "d")).count() == 0


def test_long_intervals_take_no_more_rows_than_short_ones(spark):
    """A day among minutes, in microseconds: at most two rows a level."""
    minute, day = 60_000_000, 86_400_000_000
    base = 1_700_000_000_000_000
    short = spark.range(2000).select(F.col("id").alias("i"), (base + F.col("id") * minute).alias("a"), (base + (F.col("id") + 1) * minute).alias("b"))
    long = spark.createDataFrame([(0, base, base + day), (1, base - 5 * day, base + 5 * day)], "j long, c long, d long")
    assert intervals._dealt(long, "c", "d", [13, 18, 20], "_x").count() <= 2 * 2 * 3
    got = intervals.overlaps(short, long, ("a", "b"), ("c", "d")).groupBy("j").count()
    assert rows_of(got) == [(0, 1440), (1, 2000)]


def test_long_intervals_lie_in_many_buckets(spark):
    """Days in a month: a bucket is much shorter than they are, so that few of them meet a start that they don't hold."""
    hour, day, base = 3_600_000_000, 86_400_000_000, 1_700_000_000_000_000
    long = spark.range(720).select(F.col("id").alias("j"), (base + F.col("id") * hour).alias("c"), (base + F.col("id") * hour + day).alias("d"))
    level = long.select(intervals._level("c", "d")).distinct().collect()
    dealt = intervals._dealt(long, "c", "d", [level[0][0]], "_x")
    held = [r["count"] for r in dealt.groupBy(dealt.columns[-1]).count().collect()]
    assert len(held) > 100 and max(held) <= 32 and sum(held) <= 9 * 720


@pytest.mark.parametrize("seed", range(2))
def test_overlaps_of_a_lower_row_with_a_higher_one(spark, seed):
    rng = random.Random(seed)
    some = lambda n, first: [(first + k, *((s, s + rng.choice([0, 2, 9, 40, 700])) if (s := rng.choice([None, *range(-90, 90)])) is not None else (None, 5)), rng.choice([None, 1, 2, 3, 4])) for k in range(n)]
    left, right = some(150, 0), some(120, 1000)
    x, y = spark.createDataFrame(left, "i long, a long, b long, p long"), spark.createDataFrame(right, "j long, c long, d long, q long")
    pairs = [(i, j) for i, a, b, p in left for j, c, d, q in right if None not in (a, c, p, q) and a < d and c < b and a < b and c < d and p < q]
    got = intervals.overlaps(x, y, ("a", "b"), ("c", "d"), below=("p", "q"))
    assert got.columns == ["i", "a", "b", "p", "j", "c", "d", "q"] and len(pairs) > 500
    assert sorted(map(tuple, got.select("i", "j").collect())) == sorted(pairs)


def test_short_intervals_travel_some_two_times(spark):
    """Minutes in a month take wide cells, one level for several lengths."""
    minute, base = 60_000_000, 1_700_000_000_000_000
    short = spark.range(3000).select(F.col("id").alias("i"), (base + F.col("id") * 14 * minute).alias("a"), (base + (F.col("id") * 14 + 1 + F.col("id") % 9) * minute).alias("b"))
    own = [r["k"] for r in short.select(intervals._level("a", "b").alias("k")).distinct().collect()]
    levels = intervals._widened(own, 3000 * 14 * minute)
    assert len(own) > len(levels) == 1
    assert intervals._dealt(short, "a", "b", levels, "_x").count() < 2.5 * 3000


def test_pairs_are_written_in_less_than_a_byte(spark, tmp_path):
    """Days that hold thousands of starts: pairs come in blocks of the same few rows."""
    rng = random.Random(3)
    minute, day, base = 60_000_000, 86_400_000_000, 1_700_000_000_000_000
    short = [(i, s, s + 5 * minute) for i in range(4000) for s in [base + rng.randrange(3 * day)]]
    long = [(j, s, s + day) for j in range(150) for s in [base + rng.randrange(2 * day)]]
    x, y = spark.createDataFrame(short, "i long, a long, b long"), spark.createDataFrame(long, "j long, c long, d long")
    intervals.overlaps(x, y, ("a", "b"), ("c", "d")).select("i", "a", "j", "c").write.parquet(f"{tmp_path}/pairs")
    n = spark.read.parquet(f"{tmp_path}/pairs").count()
    assert n == sum(a < d and c < b for _, a, b in short for _, c, d in long) > 100_000
    assert sum(f.stat().st_size for f in tmp_path.glob("pairs/*.parquet")) < n


def test_ends_keep_a_null_series(spark):
    frame = spark.createDataFrame([(g, k, float(k)) for g in (None, 1) for k in range(6)], "g long, at long, v double")
    assert rows_of(S.ends(frame, ["g"], "at", "v", 2)) == [(1, 0.5, 4.5), (None, 0.5, 4.5)]


def test_spaced_top_plans_stay_short(spark):
    rng = random.Random(2)
    data = [(g, at, rng.randint(0, 9)) for g in (1, 2, None) for at in rng.sample(range(100), 40)] + [(3, 5, 1)]
    frame = spark.createDataFrame(data, "g long, at long, rank long")
    sizes = {}
    for k in (3, 6):
        out = S.spaced_top(frame, ["g"], "at", "rank", k, 10)
        sizes[k] = out._jdf.queryExecution().optimizedPlan().collectLeaves().size()
        expected = []
        for g in (1, 2, 3, None):
            taken = []
            for nth in range(k):
                left = [(r, -at) for h, at, r in data if h == g and all(abs(at - t) >= 10 for t in taken)]
                if left:
                    taken.append(-max(left)[1])
                    expected.append((g, nth, taken[-1]))
        assert rows_of(out) == sorted(expected, key=str)
    assert sizes == {3: 3, 6: 6}


def test_records_whose_names_meet_are_kept_apart(spark):
    frame = spark.createDataFrame([("AAAA1", 1), ("AAAA2", 2), ("BBBB1", 3)], "digest string, n long")
    assert rows_of(records.named(frame, "digest", "name", shown=4).select("n", "name")) == [(1, "REC-AAAA1"), (2, "REC-AAAA2"), (3, "REC-BBBB")]


def test_medians_of_small_groups_need_no_ranges(spark, monkeypatch):
    rng = random.Random(4)
    data = [(g, rng.choice([None, 1.0, 2.5, 7.0])) for g in (None, 1, 2) for _ in range(9)] + [(3, None), (4, 5.0)]
    frame = spark.createDataFrame(data, "g long, v double")
    sizes, asked = frame.groupBy("g").agg(F.count("*").alias("n")), {"p50": ("v", 0.5), "p10": ("v", 0.1)}
    by_range = rows_of(S.with_quantiles(sizes, frame, ["g"], asked, "n", few=5))
    monkeypatch.setattr(S, "numbered", None)
    assert rows_of(S.with_quantiles(sizes, frame, ["g"], asked, "n")) == by_range
    assert len(by_range) == 5 and (3, 1, None, None) in by_range and (4, 1, 5.0, 5.0) in by_range
