"""Streams end with what the batch forms give."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.jobs import gates, supervise
from lodestone.operators import supervision
from lodestone.sources import tail
from lodestone.streaming import delivery, limits, signs, supervisor, windows

SF = "/root/testdata/sf0.001"


def drained(frame, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return frame.sparkSession.table(name)


def split_events(spark, tmp_path, parts=3):
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts").withColumn("part", F.ntile(parts).over(Window.orderBy("ts")))
    for k in range(1, parts + 1):
        events.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    return spark.read.parquet(f"{tmp_path}/events")


def test_daily_windows_equal_batch(spark, tmp_path):
    batch = split_events(spark, tmp_path)
    got = drained(windows.daily(windows.event_stream(spark, f"{tmp_path}/events", batch.schema)), "daily")
    closed = {(r["window"]["start"], r["event_type"]): r["n"] for r in got.collect()}
    whole = batch.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day"), "event_type").count()
    expected = {(r["window"]["start"], r["event_type"]): r["count"] for r in whole.collect()}
    assert closed and all(expected[k] == n for k, n in closed.items())


def test_sessions_equal_batch(spark, tmp_path):
    batch = split_events(spark, tmp_path)
    got = drained(windows.sessions(windows.event_stream(spark, f"{tmp_path}/events", batch.schema)), "sessions")
    closed = {(r["user_id"], r["session_window"]["start"]): r["n"] for r in got.collect()}
    whole = batch.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "12 hours")).count()
    expected = {(r["user_id"], r["session_window"]["start"]): r["count"] for r in whole.collect()}
    assert closed and all(expected[k] == n for k, n in closed.items())


def test_supervisor(spark, tmp_path):
    at = lambda h: f"2026-01-01 {h:02d}:00:00"
    batches = [
        [(1, at(0), "signup", False), (1, at(1), "purchase", False), (2, at(0), "signup", False), (3, at(0), "view", False)],
        [(1, at(2), "purchase", False), (1, at(3), "purchase", False), (1, at(4), "view", True), (2, at(2), "view", True), (4, at(1), "signup", False)],
        [(5, "2026-01-03 00:00:00", "signup", False)],
        [(6, "2026-01-03 02:00:00", "view", False)],
    ]
    schema = "job long, t string, kind string, fatal boolean"
    for rows in batches:
        frame = spark.createDataFrame(rows, schema).select("job", F.to_timestamp("t").alias("ts"), "kind", "fatal")
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/jobs")
    stream = spark.readStream.schema("job long, ts timestamp, kind string, fatal boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/jobs")
    got = {}
    for r in drained(supervisor.supervise(stream), "jobs").collect():
        got.setdefault(r["job"], []).append((str(r["ts"]), r["state"]))
    states = {k: [s for _, s in sorted(v)] for k, v in got.items()}
    assert states[1] == ["RUNNING", "COMPLETE"]  # what follows has no effect
    assert states[2] == ["RUNNING", "FAILED"]
    assert states[4] == ["RUNNING", "NO_PROGRESS"]
    assert 3 not in states


JOB_ROW = "job long, ts timestamp, event_id long, kind string, value double"


def limits_of(spark, tmp_path, name):
    stream = spark.readStream.schema(JOB_ROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/jobs")
    return limits.replay(stream, f"{tmp_path}/{name}").collect()


def add_file(spark, tmp_path, rows, number):
    """Files are read in the order of their times."""
    at = tmp_path / "part"
    rows.select("job", "ts", "event_id", "kind", "value").coalesce(1).write.mode("overwrite").parquet(str(at))
    (tmp_path / "jobs").mkdir(exist_ok=True)
    target = tmp_path / "jobs" / f"{number:03d}.parquet"
    next(at.glob("part-*.parquet")).rename(target)
    os.utime(target, (1_700_000_000 + number, 1_700_000_000 + number))


def sentinel(spark, day):
    return spark.createDataFrame([(-1, day, 0, None, None)], "job long, t string, event_id long, kind string, value double").withColumn("ts", F.to_timestamp("t"))


def test_limits_on_shuffled_files_with_late_rows_and_a_restart_equal_batch(spark, tmp_path):
    log = supervise.log(spark, SF).where("job % 3 = 0")
    slices = log.withColumn("slice", (F.dayofmonth("ts") / 4).cast("int"))
    order = [1, 0, 3, 2, 5, 4, 7, 6]
    for k, part in enumerate(order[:4]):
        add_file(spark, tmp_path, slices.where(F.col("slice") == part), k)
    first = limits_of(spark, tmp_path, "run")
    assert {r["event"] for r in first} >= {"REMINDER", "REMINDER_SEEN"} and "VERDICT" not in {r["event"] for r in first}
    for k, part in enumerate(order[4:], 4):
        add_file(spark, tmp_path, slices.where(F.col("slice") == part), k)
    add_file(spark, tmp_path, sentinel(spark, "2024-06-01 00:00:00"), 20)
    # The watermark has passed these: they must not count.
    late = spark.createDataFrame([(0, "2024-01-02 00:00:00", 1, "error", 99.0)] * 3, "job long, t string, event_id long, kind string, value double").withColumn("ts", F.to_timestamp("t"))
    add_file(spark, tmp_path, late, 21)
    add_file(spark, tmp_path, sentinel(spark, "2024-06-02 00:00:00"), 22)
    got = limits_of(spark, tmp_path, "run")  # starts again from the checkpoint
    us = lambda c: F.unix_micros(c)
    seen = sorted((r["job"], r["threshold"], r["at_us"]) for r in got if r["event"] == "REMINDER_SEEN")
    expected = supervision.reminders(log, (86400, 259200, 604800)).select("job", "threshold", us("fired").alias("at_us"))
    assert seen == sorted(map(tuple, expected.collect()))
    verdicts = {r["job"]: r for r in got if r["event"] == "VERDICT"}
    assert sum(r["event"] == "VERDICT" for r in got) == len(verdicts)
    for r in supervise.exit_classification(spark, SF).where("job % 3 = 0").collect():
        assert all(verdicts[r["job"]][c] == r[c] for c in ("code", "state", "late_start", "over_deadline", "gate_message"))
    for r in gates.wait_timeout(spark, SF).where("job % 3 = 0").collect():
        assert verdicts[r["job"]]["wait"] == r["verdict"]
    # Timers tell of a limit once, whether or not a row came at that time.
    told = [(r["job"], r["event"], r["threshold"]) for r in got if r["event"] not in ("REMINDER_SEEN", "VERDICT")]
    assert len(told) == len(set(told)) and {j for j, e, _ in told if e == "REMINDER"} == set(verdicts)
    early = {r["job"] for r in got if r["event"] == "RESOURCE_WAIT_TIMEOUT"}
    assert early == {j for j, r in verdicts.items() if r["wait"] == "RESOURCE_WAIT_TIMEOUT"}


def test_limits_at_their_borders(spark, tmp_path):
    rows = [
        (1, "2024-01-01 00:00:00", 1, "view", None), (1, "2024-01-02 00:00:00", 2, "signup", None),  # starts at the marker's limit: in time
        (2, "2024-01-01 00:00:00", 3, "view", None), (2, "2024-01-02 00:00:00.000001", 4, "signup", None),  # and beyond it
        (3, "2024-01-01 00:00:00", 5, "view", None), (3, "2024-01-03 00:00:00", 6, "signup", 0.0),  # a wait is over when it reaches its limit
        (4, "2024-01-01 00:00:00", 7, None, None), (None, "2024-01-01 00:00:00", 8, "signup", None),
        (5, "2024-01-01 00:00:00", 9, "signup", None), (5, "2024-01-01 00:00:00", 9, "signup", None), (5, "2024-01-01 00:00:01", 10, "error", 90.0), (5, "2024-01-01 00:00:02", 11, "purchase", 20.0),
    ]
    add_file(spark, tmp_path, spark.createDataFrame(rows, "job long, t string, event_id long, kind string, value double").withColumn("ts", F.to_timestamp("t")), 0)
    add_file(spark, tmp_path, sentinel(spark, "2024-06-01 00:00:00"), 1)
    got = limits_of(spark, tmp_path, "run")
    verdicts = {r["job"]: (r["code"], r["wait"], r["gate_message"]) for r in got if r["event"] == "VERDICT"}
    assert verdicts == {
        1: (4, "ok", "purchase: 0/3 valid files"), 2: (4, "NO_PROGRESS: start marker", "purchase: 0/3 valid files"), 3: (4, "RESOURCE_WAIT_TIMEOUT", "purchase: 0/3 valid files"),
        4: (5, "ok", "purchase: 0/3 valid files"), 5: (4, "ok", "purchase: 1/3 valid files"),
    }
    assert {r["job"] for r in got if r["event"] == "NO_PROGRESS: start marker"} == {2, 3, 4}
    assert {r["job"] for r in got if r["event"] == "RESOURCE_WAIT_TIMEOUT"} == {3, 4}


def test_signs_of_life_over_shuffled_files_and_a_restart(spark, tmp_path):
    log = supervise.log(spark, SF)
    far = spark.createDataFrame([(-1, "2024-06-01 00:00:00", 0, "error", None), (-1, "2024-06-01 00:00:00", 0, "view", None)], "job long, t string, event_id long, kind string, value double").withColumn("ts", F.to_timestamp("t"))
    slices = log.withColumn("slice", (F.dayofmonth("ts") / 4).cast("int"))
    kinds = lambda kind: spark.readStream.schema(JOB_ROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/jobs").where(F.col("kind") == kind)

    def run():
        views = kinds("view").select("job", F.col("event_id").alias("sign_id"), F.col("ts").alias("seen"))
        return signs.replay(signs.followed(kinds("error"), views, "6 HOURS", late="7 days"), f"{tmp_path}/signs").collect()

    for k, part in enumerate([1, 0, 3, 2]):
        add_file(spark, tmp_path, slices.where(F.col("slice") == part), k)
    early = run()
    for k, part in enumerate([5, 4, 7, 6], 4):
        add_file(spark, tmp_path, slices.where(F.col("slice") == part), k)
    add_file(spark, tmp_path, far, 20)
    got = [r for r in run() if r["job"] != -1]
    assert early and len(early) < len(got)
    silent = [r["event_id"] for r in got if r["sign_id"] is None]
    rows = [tuple(r) for r in log.select("job", "event_id", "kind", F.unix_micros("ts")).collect()]
    views = {}
    for job, _, kind, us in rows:
        if kind == "view":
            views.setdefault(job, []).append(us)
    hours = 6 * 3_600_000_000
    expected = [i for job, i, kind, us in rows if kind == "error" and not any(us <= v <= us + hours for v in views.get(job, []))]
    assert sorted(silent) == sorted(expected)
    pairs = sum(us <= v <= us + hours for job, _, kind, us in rows if kind == "error" for v in views.get(job, []))
    assert len(got) == len(silent) + pairs


def test_delivery(spark, tmp_path):
    rows = [(1, "error", "a"), (2, "view", "b"), (3, "error", "c")]
    spark.createDataFrame(rows, "event_id long, kind string, detail string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, kind string, detail string").parquet(f"{tmp_path}/in")
    accept = lambda batch: batch.where("event_id = 1").select("event_id", F.lit(True).alias("ok"), F.lit("sent").alias("output"))
    query = delivery.deliver(stream, accept, wanted=["error"], log=f"{tmp_path}/log", audit=f"{tmp_path}/audit", checkpoint=f"{tmp_path}/ck")
    query.awaitTermination(60)
    assert spark.read.json(f"{tmp_path}/log").count() == 3
    assert {r["event_id"]: r["ok"] for r in spark.read.json(f"{tmp_path}/audit").collect()} == {1: True, 3: False}


def test_tail_reads_whole_lines_as_they_end(spark, tmp_path):
    tail.register(spark)
    (tmp_path / "in").mkdir()
    log = tmp_path / "in" / "a.log"
    log.write_bytes(b"first\nfatal er")
    rows = spark.readStream.format("tail").load(f"{tmp_path}/in/*.log")
    query = rows.writeStream.format("memory").queryName("tailed").option("checkpointLocation", f"{tmp_path}/state").start()
    read = lambda: sorted(r["line"] for r in spark.table("tailed").collect())
    try:
        query.processAllAvailable()
        assert read() == ["first"]
        with log.open("ab") as f:
            f.write("ror é\nthird\npart".encode())
        query.processAllAvailable()
        assert read() == ["fatal error é", "first", "third"]
        (tmp_path / "in" / "b.log").write_bytes(b"other\n")
        query.processAllAvailable()
        assert read() == ["fatal error é", "first", "other", "third"]
    finally:
        query.stop()


def test_tail_spans_part_at_lines(tmp_path, monkeypatch):
    lines = [f"line {k} " + "x" * (k % 13) for k in range(200)]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\nrest")
    reader = tail.TailReader(f"{tmp_path}/*.log")
    end = reader.latestOffset()
    for span in (1, 7, 100, 10**6):
        monkeypatch.setattr(tail, "SPAN", span)
        assert [r[2] for p in reader.partitions({}, end) for r in reader.read(p)] == lines
    path = f"{tmp_path}/a.log"
    assert reader.partitions(end, end) == [] and reader.partitions({path: [end[path][0], 10**9]}, end)[0].start == 0
    monkeypatch.setattr(tail, "STEP", 3)
    assert reader.latestOffset() == end and tail.last_break(path, 4) == 0


class Kept:
    """A state without a store, which counts the words with it."""

    def __init__(self, words, value):
        self.words, self.value = words, value

    def __getattr__(self, name):
        def said(*args):
            self.words.append(name)
            if name == "get":
                return self.value
            if name == "appendList":
                self.value = self.value + args[0]
            if name in ("clear", "deleteTimer", "registerTimer"):
                return None
            if name in ("put", "update"):
                self.value = args[0]
            return [] if name == "listTimers" else None

        return said

    def exists(self):
        self.words.append("exists")
        return self.value is not None

    def getCurrentWatermarkInMs(self):
        return self.value


def test_a_job_that_is_over_at_once_takes_few_words_with_its_state(spark):
    rules, words = limits.Rules(), []
    start, day = 1_704_067_200_000_000, 86_400_000_000
    rows = [(1, "2024-01-01 00:00:00", 0, "signup", None)] + [(1, "2024-01-02 00:00:00", k, "purchase", 20.0) for k in range(2500)] + [(1, "2024-01-02 00:00:00", 1, "error", 90.0)]
    frame = spark.createDataFrame(rows, "job long, t string, event_id long, kind string, value double").withColumn("ts", F.to_timestamp("t"))
    given = frame.select("job", F.unix_micros("ts").alias("us"), limits._flags(rules).alias("flags")).collect()
    job = limits.Watch(rules)
    job.handle, job.facts, job.pending = Kept(words, None), Kept(words, None), Kept(words, [])
    assert not list(job.handleInputRows((1,), iter(given), Kept(words, 0)))
    assert len(job.pending.value) == 3  # pieces of a thousand rows
    said = list(job.handleExpiredTimer((1,), Kept(words, (start + 60 * day) // 1000), None))
    assert [r["event"] for r in said] == ["REMINDER_SEEN", "REMINDER", "REMINDER", "REMINDER", "NO_PROGRESS: task deadline exceeded", "VERDICT"]
    assert said[-1]["code"] == 0 and said[-1]["gate_message"] is None
    assert words == ["appendList", "registerTimer", "get", "get", "clear"]
