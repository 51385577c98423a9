"""Fatal lines over growing logs, from the files to the events; replaced files are read from their start."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from lodestone.sources import tail
from lodestone.streaming import faults

FATAL, START = ("Traceback", r"loss=nan\d*", "OOM"), ("epoch 1",)


def test_fatal_patterns_go_before_everything_in_the_order_of_their_list(spark):
    rows = [
        ("a", 0, "epoch 1 begins"), ("a", 9, "OOM at once"), ("a", 20, "then loss=nan7 and OOM"), ("a", 30, "loss=nan9"),
        ("b", 0, "nothing"), ("b", 5, None), ("c", 0, "warming up"), ("c", 7, "epoch 1"), ("d", 3, "Traceback (most recent"), ("d", 1, "OOM"),
    ]
    got = sorted(map(tuple, faults.poll(spark.createDataFrame(rows, "path string, at long, line string").repartition(3), FATAL, START).collect()))
    assert got == [("a", "FATAL_LOG", "loss=nan7", 20), ("b", "PROGRESS", None, 5), ("c", "RUN_STARTED", "epoch 1", 7), ("d", "FATAL_LOG", "Traceback", 3)]
    assert faults.poll(spark.createDataFrame([], "path string, at long, line string"), FATAL, START).count() == 0


def test_growing_and_replaced_logs_end_to_end(spark, tmp_path):
    tail.register(spark)
    logs = tmp_path / "logs"
    logs.mkdir()
    a, b = logs / "a.log", logs / "b.log"
    a.write_text("starting\nepoch 1\n")
    b.write_text("OO")
    lines = lambda: spark.readStream.format("tail").load(f"{logs}/*.log")
    run = lambda: faults.watch_logs(lines(), FATAL, START, f"{tmp_path}/out", once=True).awaitTermination(120)
    events = lambda: [(os.path.basename(r["job"]), r["event"], r["detail"]) for r in faults.told(spark, f"{tmp_path}/out").orderBy("batch", "job").collect()]
    run()
    assert events() == [("a.log", "RUN_STARTED", "epoch 1")]
    with a.open("a") as f:
        f.write("epoch 1 again\n")
    with b.open("a") as f:
        f.write("M killed\nepoch 1\n")
    run()
    assert events()[1:] == [("a.log", "PROGRESS", None), ("b.log", "FATAL_LOG", "OOM")]
    # The file is replaced by one that outgrows the old one before the next poll: it is read from its start, not from the middle.
    (logs / "new").write_text("loss=nan in the first line\n" + "quiet\n" * 50)
    os.replace(logs / "new", a)
    with b.open("a") as f:
        f.write("Traceback\n")
    run()
    assert events()[3:] == [("a.log", "FATAL_LOG", "loss=nan")]  # and b has failed before


def test_offsets_know_their_files(tmp_path):
    path = tmp_path / "a.log"
    path.write_text("one\ntwo\n")
    reader = tail.TailReader(str(path))
    first = reader.latestOffset()
    assert [r[2] for p in reader.partitions({}, first) for r in reader.read(p)] == ["one", "two"]
    with path.open("a") as f:
        f.write("three\n")
    second = reader.latestOffset()
    assert [r[2] for p in reader.partitions(first, second) for r in reader.read(p)] == ["three"]
    (tmp_path / "b").write_text("other one\nother two\nother three\n")
    os.replace(tmp_path / "b", path)
    third = reader.latestOffset()
    assert [r[2] for p in reader.partitions(second, third) for r in reader.read(p)] == ["other one", "other two", "other three"]
    path.write_text("x\n")  # cut off and written anew: the same file, but shorter
    assert [r[2] for p in reader.partitions(third, reader.latestOffset()) for r in reader.read(p)] == ["x"]
    assert [r[2] for p in reader.partitions({str(path): 2}, {str(path): [1, 2]}) for r in reader.read(p)] == []  # an offset of an older checkpoint
