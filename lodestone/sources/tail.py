"""Text that files gain at their ends, as a streaming data source: offsets are bytes, rows are whole lines.

What follows the last line break waits for its end, so that a line which a writer
has written half of is neither cut nor missed. A file that shrank, or that is another one under its old name, is
read from its start: an offset is a file's number and its bytes. All machines must see the files at the same path.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that a task reads, and bytes that are looked through at a time for a line break.
SPAN, STEP = 64 << 20, 1 << 16


class Span(InputPartition):
    """Lines of a file that begin in [start, end)."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def last_break(path: str, size: int) -> int:
    """Bytes up to and with the last line break of the first ``size``."""
    with open(path, "rb") as f:
        while size:
            at = max(0, size - STEP)
            f.seek(at)
            found = f.read(size - at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            size = at
    return 0


class TailReader(DataSourceStreamReader):
    def __init__(self, pattern: str):
        self.pattern = pattern

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for path in sorted(glob.glob(self.pattern)):
            state = os.stat(path)
            out[path] = [state.st_ino, last_break(path, state.st_size)]
        return out

    def partitions(self, start: dict, end: dict) -> list[Span]:
        out = []
        for path, (file, to) in end.items():
            was = start.get(path, [file, 0])
            old, at = was if isinstance(was, list) else (file, was)  # checkpoints of old hold the bytes alone
            at = at if old == file and at <= to else 0
            out += [Span(path, a, min(a + SPAN, to)) for a in range(at, to, SPAN)]
        return out

    def read(self, partition: Span) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(max(0, partition.start - 1))
            if partition.start:
                f.readline()  # a line that begins before the span belongs to the one before
            while (at := f.tell()) < partition.end:
                line = f.readline()
                yield partition.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")


class TailSource(DataSource):
    """``spark.readStream.format("tail").load("/logs/*.log")``: ``path, at, line``."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, at long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailSource)
