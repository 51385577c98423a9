"""Growing logs of jobs, poll by poll: fatal lines before everything else, then the start marker, then signs of life."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.sources.scratch import settled

EVENTS = "job string, event string, detail string, at long"


def first_match(line: Column, patterns: Sequence[str]) -> Column:
    """A struct ``ordinal, found`` of the first pattern in the order of the list that the line has, and what it matched; null if none."""
    out = F.lit(None).cast("struct<ordinal:int,found:string>")
    for k, p in reversed(list(enumerate(patterns))):
        out = F.when(F.rlike(line, F.lit(p)), F.struct(F.lit(k).alias("ordinal"), F.regexp_extract(line, p, 0).alias("found"))).otherwise(out)
    return out


def poll(lines: DataFrame, fatal: Sequence[str], start: Sequence[str]) -> DataFrame:
    """One event for each job of a poll's lines (``path, at, line``): :data:`EVENTS`.

    ``FATAL_LOG`` with what the first fatal pattern of the list matched first, wherever other patterns or the start marker stand; else
    ``RUN_STARTED``, else ``PROGRESS``. Lines are combined before the shuffle. A null line is a sign of life.
    """
    bad, good = first_match(F.col("line"), fatal), first_match(F.col("line"), start)
    rows = lines.select(F.col("path").alias("job"), "at", bad.alias("bad"), good.alias("good"))
    worst = F.min(F.when(F.col("bad").isNotNull(), F.struct("bad.ordinal", "at", "bad.found")))
    began = F.min(F.when(F.col("good").isNotNull(), F.struct("at", "good.found")))
    told = rows.groupBy("job").agg(worst.alias("worst"), began.alias("began"), F.max("at").alias("last"))
    event = F.when(F.col("worst").isNotNull(), "FATAL_LOG").when(F.col("began").isNotNull(), "RUN_STARTED").otherwise("PROGRESS")
    detail = F.coalesce("worst.found", "began.found")
    return told.select("job", event.alias("event"), detail.alias("detail"), F.coalesce("worst.at", "began.at", "last").alias("at"))


def watch_logs(lines: DataFrame, fatal: Sequence[str], start: Sequence[str], folder: str, *, once: bool = False) -> StreamingQuery:
    """Start a query that writes each poll's events to ``folder``, where :func:`told` reads them.

    ``lines`` is the stream of ``sources.tail``. A job that has failed is told of no more; one that has started starts once. A poll that is run again overwrites its own events.
    """

    def each(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        now = settled(poll(batch, fatal, start))
        before = told(session, folder).where(F.col("batch") < number)
        gone = before.where("event = 'FATAL_LOG'").select("job").distinct()
        running = before.where("event = 'RUN_STARTED'").select("job", F.lit(True).alias("_ran")).distinct()
        left = now.join(gone, "job", "left_anti").join(running, "job", "left")
        again = (F.col("event") == "RUN_STARTED") & F.col("_ran").isNotNull()
        left = left.withColumns({"event": F.when(again, "PROGRESS").otherwise(F.col("event")), "detail": F.when(~again, F.col("detail"))}).drop("_ran")
        left.select("job", "event", "detail", "at").write.mode("overwrite").json(f"{folder}/events/batch={number}")

    query = lines.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/state")
    return (query.trigger(availableNow=True) if once else query).start()


def told(session, folder: str) -> DataFrame:
    """All events so far, with the ``batch`` of their poll."""
    path = session.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/events")
    if not path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return session.createDataFrame([], f"{EVENTS}, batch long")
    return session.read.schema(f"{EVENTS}, batch long").json(f"{folder}/events")
