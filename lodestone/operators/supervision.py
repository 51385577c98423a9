"""Event logs: what became of each job.

The log is ``job, ts, kind, value`` with a zoned time stamp. Jobs are
independent; every operator shuffles once on the job, or combines first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def by_time():
    return Window.partitionBy("job").orderBy("ts", "event_id")


def seconds(a: str, b: str) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(1e6)


def gaps(log: DataFrame, limit: float) -> DataFrame:
    """Steps to the next event that took longer than the limit (strictly): ``job, since, until, gap``."""
    steps = log.withColumn("until", F.lead("ts").over(by_time())).where("until IS NOT NULL")
    return steps.withColumn("gap", seconds("ts", "until")).where(F.col("gap") > limit).select("job", F.col("ts").alias("since"), "until", "gap")


def first_of(kind: Column) -> Column:
    return F.min(F.when(kind, F.col("ts")))


def verdicts(log: DataFrame, *, start: Column, fatal: Column, output: Column, least_outputs: int, startup: float, deadline: float) -> DataFrame:
    """One row for each job: its exit code and state, and which limits it broke.

    Precedence: a fatal line (3), no start marker (5), too few outputs (4), success (0). Startup
    and deadline are broken strictly beyond their limits.
    """
    facts = log.groupBy("job").agg(
        F.min("ts").alias("began"), F.max("ts").alias("ended"), first_of(start).alias("started"), first_of(fatal).alias("failed"), F.count_if(output).alias("n_outputs")
    )
    code = (
        F.when(F.col("failed").isNotNull(), 3).when(F.col("started").isNull(), 5).when(F.col("n_outputs") < least_outputs, 4).otherwise(0)
    )
    late = F.col("started").isNull() | (seconds("began", "started") > startup)
    return facts.select(
        "job",
        code.alias("code"),
        F.when(code == 0, "COMPLETE").otherwise("FAILED").alias("state"),
        late.alias("late_start"),
        (seconds("began", "ended") > deadline).alias("over_deadline"),
        F.when(F.col("n_outputs") < least_outputs, F.format_string("purchase: %d/%d valid files", F.col("n_outputs"), F.lit(least_outputs))).alias("gate_message"),
    )


def islands(log: DataFrame, busy: Column, hold: float) -> DataFrame:
    """The first sample at which the free condition has held long enough; a busy sample starts anew."""
    rows = log.withColumn("busy", busy).withColumn("island", F.sum(F.col("busy").cast("int")).over(by_time().rowsBetween(Window.unboundedPreceding, 0)))
    free = rows.where("NOT busy")
    since = F.min("ts").over(Window.partitionBy("job", "island"))
    held = free.withColumn("since", since).where(seconds("since", "ts") >= hold)
    return held.groupBy("job").agg(F.min("ts").alias("acquired"))


def reminders(log: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """For each job and threshold the first event at which the elapsed time reaches it."""
    began = log.groupBy("job").agg(F.min("ts").alias("began"))
    rows = log.join(began, "job").withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    return rows.where(seconds("began", "ts") >= F.col("threshold")).groupBy("job", "threshold").agg(F.min("ts").alias("fired"))


def until_terminal(log: DataFrame, terminal: Column) -> DataFrame:
    """Events up to and with the first terminal one; later ones have no effect."""
    before = F.coalesce(F.sum(terminal.cast("int")).over(by_time().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return log.withColumn("_before", before).where("_before = 0").drop("_before")


def states(log: DataFrame, *, start: Column, fatal: Column, output: Column, outputs: int) -> DataFrame:
    """The events at which a job changes its state, with the new ``state``.

    The first start makes it RUNNING, the first fatal event FAILED (also before a start), the
    ``outputs``-th output after the start COMPLETE. What follows a terminal state has no effect.
    """
    so_far = by_time().rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumns({"_start": F.coalesce(start, F.lit(False)).cast("int"), "_fatal": F.coalesce(fatal, F.lit(False))})
    rows = rows.withColumn("_starts", F.sum("_start").over(so_far))
    counts = (F.coalesce(output, F.lit(False)) & (F.col("_starts") > 0)).cast("int")
    rows = rows.withColumn("_output", counts).withColumn("_outputs", F.sum("_output").over(so_far))
    complete = (F.col("_output") == 1) & (F.col("_outputs") == outputs)
    rows = until_terminal(rows, F.col("_fatal") | complete)
    state = F.when(F.col("_fatal"), "FAILED").when(complete, "COMPLETE").when((F.col("_start") == 1) & (F.col("_starts") == 1), "RUNNING")
    return rows.withColumn("state", state).where("state IS NOT NULL").drop("_start", "_fatal", "_starts", "_output", "_outputs")


def output_gate(log: DataFrame, rules: Sequence[tuple[str, float, int]]) -> DataFrame:
    """``job, passed, message`` of ``(kind, least value, least number)`` rules; counts are combined before the shuffle."""
    large = [F.coalesce(F.count_if((F.col("kind") == k) & (F.col("value") >= v)), F.lit(0)).alias(f"_{k}") for k, v, _ in rules]
    passed = F.lit(True)
    for k, _, n in rules:
        passed = passed & (F.col(f"_{k}") >= n)
    fails = [F.when(F.col(f"_{k}") < n, F.format_string(f"{k}: %d/{n} valid files", F.col(f"_{k}"))) for k, _, n in rules]
    return log.groupBy("job").agg(*large).select("job", passed.alias("passed"), F.concat_ws("; ", *fails).alias("message"))
