"""Two streams: each event of one with the signs of life that the other gives in time, and those without any once the watermark knows it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def followed(events: DataFrame, signs: DataFrame, within: str, *, late: str = "1 day") -> DataFrame:
    """``job, event_id, ts, sign_id, seen``: a left outer join within an interval.

    ``events`` have ``job, event_id, ts``, ``signs`` ``job, sign_id, seen``; both times are zoned. A sign counts from the event's
    time until ``within`` after it, both included. An event without one comes out once, with nulls, when the watermarks of both
    streams, ``late`` behind the last times, have passed its interval; they clear the state of both sides. Rows without a job
    meet nothing; rows that come later than the watermark are dropped.
    """
    left = events.select("job", "event_id", "ts").withWatermark("ts", late)
    right = signs.select(F.col("job").alias("_job"), "sign_id", "seen").withWatermark("seen", late)
    return left.join(right, F.expr(f"job = _job AND seen >= ts AND seen <= ts + INTERVAL {within}"), "left_outer").drop("_job")


def replay(frame: DataFrame, folder: str) -> DataFrame:
    """What a stream says until its input ends, written to ``folder``; a query that stopped goes on from its state there."""
    query = frame.writeStream.format("parquet").option("path", f"{folder}/said").option("checkpointLocation", f"{folder}/state").outputMode("append")
    query.trigger(availableNow=True).start().awaitTermination()
    return frame.sparkSession.read.schema(frame.schema).parquet(f"{folder}/said")
