"""Delivery of events: everything is logged, the wanted ones are handed on, and each attempt is audited."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: A notifier gets a batch of wanted events and returns ``event_id, ok, output`` of each.
Notifier = Callable[[DataFrame], DataFrame]


def deliver(events: DataFrame, notify: Notifier, *, wanted: Sequence[str] | None, log: str, audit: str, checkpoint: str) -> StreamingQuery:
    """Start a query over ``events`` (``event_id, kind, ...``).

    ``wanted`` None delivers every kind. A batch that is run again overwrites its own folders, so
    that log and audit hold each event once; the notifier may see an event again after a failure. An
    event that the notifier returns nothing for is audited as not accepted.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.write.mode("overwrite").json(f"{log}/batch={number}")
        chosen = batch if wanted is None else batch.where(F.col("kind").isin(*wanted))
        answers = notify(chosen).select(F.col("event_id").alias("_id"), "ok", "output")
        audited = chosen.join(answers, F.col("event_id") == F.col("_id"), "left").drop("_id").withColumn("ok", F.coalesce("ok", F.lit(False)))
        audited.write.mode("overwrite").json(f"{audit}/batch={number}")
        batch.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
