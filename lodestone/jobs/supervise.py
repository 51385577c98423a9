"""Supervision of the jobs in the event log: a job is a user, its start a signup, its outputs purchases."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.jobs.registry import Registry
from lodestone.operators import supervision as V
from lodestone.sources.scratch import shared_folder
from lodestone.sources.tables import table
from lodestone.streaming import limits, signs

JOBS = Registry()
LOG = "(SELECT user_id AS job, event_id, ts, event_type AS kind, value FROM events)"
HOUR, DAY = 3600, 86400


def log(spark, sf):
    events = table(spark, sf, "events")
    return events.select(F.col("user_id").alias("job"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "value")


def clock(c: str):
    return F.unix_micros(c)


@JOBS.query("t02_gap_timeout", f"SELECT job, epoch_us(ts) AS since_us, epoch_us(until) AS until_us FROM (SELECT *, lead(ts) OVER (PARTITION BY job ORDER BY ts, event_id) AS until FROM {LOG}) WHERE epoch_us(until) - epoch_us(ts) > 43200000000")
def gap_timeout(spark, sf):
    """No progress for more than twelve hours."""
    return V.gaps(log(spark, sf), 12 * HOUR).select("job", clock("since").alias("since_us"), clock("until").alias("until_us"))


VERDICT = f"""SELECT job, (CASE WHEN failed IS NOT NULL THEN 3 WHEN started IS NULL THEN 5 WHEN n < 3 THEN 4 ELSE 0 END)::INT AS code,
  CASE WHEN failed IS NULL AND started IS NOT NULL AND n >= 3 THEN 'COMPLETE' ELSE 'FAILED' END AS state, started IS NULL OR epoch_us(started) - epoch_us(began) > 172800000000 AS late_start,
  epoch_us(ended) - epoch_us(began) > 2505600000000 AS over_deadline, CASE WHEN n < 3 THEN 'purchase: ' || n || '/3 valid files' END AS gate_message FROM (
  SELECT job, min(ts) AS began, max(ts) AS ended, min(ts) FILTER (WHERE kind = 'signup') AS started, min(ts) FILTER (WHERE kind = 'error' AND value > 90) AS failed, count(*) FILTER (WHERE kind = 'purchase' AND value >= 20) AS n FROM {LOG} GROUP BY job)"""


@JOBS.query("t12_exit_classification", VERDICT)
def exit_classification(spark, sf):
    """Codes by precedence, states, limits, the message of the output gate."""
    return V.verdicts(
        log(spark, sf), start=F.col("kind") == "signup", fatal=F.expr("kind = 'error' AND value > 90"), output=F.expr("kind = 'purchase' AND value >= 20"), least_outputs=3, startup=2 * DAY, deadline=29 * DAY
    )


@JOBS.query(
    "t05_fatal_match",
    f"SELECT job, arg_min(pattern, (ordinal, ts)) AS pattern, epoch_us(arg_min(ts, (ordinal, ts))) AS at_us FROM {LOG}, (VALUES (1, 'err'), (2, 'purch'), (3, 'sign')) p(ordinal, pattern) WHERE starts_with(kind, pattern) AND value > 50 GROUP BY job",
)
def fatal_match(spark, sf):
    """The first pattern in the order of the list, not of time."""
    patterns = F.array(*(F.struct(F.lit(k).alias("ordinal"), F.lit(p).alias("pattern")) for k, p in enumerate(("err", "purch", "sign"), 1)))
    rows = log(spark, sf).where("value > 50").select("job", "ts", "kind", F.explode(patterns).alias("p")).where(F.col("kind").startswith(F.col("p.pattern")))
    best = F.struct("p.ordinal", "ts")
    return rows.groupBy("job").agg(F.min_by("p.pattern", best).alias("pattern"), F.unix_micros(F.min_by("ts", best)).alias("at_us"))


@JOBS.query(
    "t07_stable_for",
    f"SELECT job, epoch_us(min(ts)) AS acquired_us FROM (SELECT *, min(ts) OVER (PARTITION BY job, island) AS since FROM (SELECT *, sum((kind = 'error')::INT) OVER (PARTITION BY job ORDER BY ts, event_id) AS island FROM {LOG}) WHERE kind <> 'error') WHERE epoch_us(ts) - epoch_us(since) >= 86400000000 GROUP BY job",
)
def stable_for(spark, sf):
    """A day without an error; each error starts the count anew."""
    return V.islands(log(spark, sf), F.col("kind") == "error", DAY).select("job", clock("acquired").alias("acquired_us"))


@JOBS.query(
    "t08_reminders",
    f"SELECT job, threshold::DOUBLE AS threshold, epoch_us(min(ts)) AS fired_us FROM (SELECT *, min(ts) OVER (PARTITION BY job) AS began FROM {LOG}), (VALUES (86400), (259200), (604800)) t(threshold) WHERE epoch_us(ts) - epoch_us(began) >= threshold * 1000000::BIGINT GROUP BY job, threshold",
)
def reminders(spark, sf):
    """Each threshold fires once, when it is reached (not strictly)."""
    return V.reminders(log(spark, sf), (DAY, 3 * DAY, 7 * DAY)).select("job", "threshold", clock("fired").alias("fired_us"))


#: A job of no user, whose one row lies so long after the last that all others are over.
LAST_JOB = -1


@JOBS.query(
    "t09_limits_stream",
    f"SELECT v.*, CASE WHEN waited >= 172800000000 THEN 'RESOURCE_WAIT_TIMEOUT' WHEN waited > 86400000000 THEN 'NO_PROGRESS: start marker' WHEN ran > 2505600000000 THEN 'NO_PROGRESS: task deadline exceeded' ELSE 'ok' END AS wait, "
    f"(SELECT count(*) FROM (VALUES (86400), (259200), (604800)) t(threshold) WHERE ran >= threshold * 1000000::BIGINT)::BIGINT AS n_reminders "
    f"FROM ({VERDICT}) v JOIN (SELECT job, epoch_us(coalesce(min(ts) FILTER (WHERE kind = 'signup'), max(ts))) - epoch_us(min(ts)) AS waited, epoch_us(max(ts)) - epoch_us(min(ts)) AS ran FROM {LOG} GROUP BY job) w ON v.job = w.job",
)
def limits_stream(spark, sf):
    """T03, T04, T08, T09, T12 as a stream with timers, run to its end: the verdicts of the batch queries and the reminders that were seen."""
    rules = limits.Rules()
    rows = log(spark, sf)
    folder = f"{shared_folder(spark)}/limits-{uuid.uuid4().hex}"
    last = rows.agg((F.max("ts") + F.make_dt_interval(secs=F.lit(2 * rules.closed))).alias("ts"))
    last = last.select(F.lit(LAST_JOB).cast("long").alias("job"), F.lit(0).cast("long").alias("event_id"), "ts", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("value"))
    last.coalesce(1).write.parquet(f"{folder}/last")
    # A stream's plain path must be a folder; a pattern may be a file.
    files = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/event[s].parquet")
    stream = files.select(F.col("user_id").alias("job"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "value")
    said = limits.replay(stream.unionByName(spark.readStream.schema(last.schema).parquet(f"{folder}/last")), folder, rules)
    seen = said.where("event = 'REMINDER_SEEN'").groupBy("job").agg(F.count("*").alias("n_reminders"))
    verdicts = said.where("event = 'VERDICT'").select("job", "code", "state", "late_start", "over_deadline", "gate_message", "wait")
    return verdicts.join(seen, "job", "left").fillna(0, ["n_reminders"])


@JOBS.query("t10_progress_clock", f"SELECT job, epoch_us(greatest(coalesce(max(ts) FILTER (WHERE kind = 'view'), min(ts)), coalesce(max(ts) FILTER (WHERE kind = 'click'), min(ts)), coalesce(max(ts) FILTER (WHERE kind = 'purchase'), min(ts)))) AS progress_us FROM {LOG} GROUP BY job")
def progress_clock(spark, sf):
    """The latest of several signs of life."""
    latest = [F.coalesce(F.max(F.when(F.col("kind") == k, F.col("ts"))), F.min("ts")) for k in ("view", "click", "purchase")]
    return log(spark, sf).groupBy("job").agg(F.unix_micros(F.greatest(*latest)).alias("progress_us"))


@JOBS.query("t13_event_filter", f"SELECT kind, count(*)::BIGINT AS n_logged, (count(*) FILTER (WHERE kind IN ('error', 'purchase')))::BIGINT AS n_delivered FROM {LOG} GROUP BY kind")
def event_filter(spark, sf):
    """All events are logged, some delivered."""
    return log(spark, sf).groupBy("kind").agg(F.count("*").alias("n_logged"), F.count_if(F.col("kind").isin("error", "purchase")).alias("n_delivered"))


@JOBS.query(
    "t14_terminal_idempotent",
    f"SELECT job, count(*)::BIGINT AS n_effective FROM (SELECT *, coalesce(sum((kind = 'error' AND value > 60)::INT) OVER (PARTITION BY job ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {LOG}) WHERE before = 0 GROUP BY job",
)
def terminal(spark, sf):
    return V.until_terminal(log(spark, sf), F.expr("kind = 'error' AND value > 60")).groupBy("job").agg(F.count("*").alias("n_effective"))


@JOBS.query("t15_status_enrich", f"SELECT job, arg_max(kind, (ts, event_id)) AS last_kind, epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) <= 86400000000 AS alive FROM {LOG} GROUP BY job")
def status(spark, sf):
    rows = log(spark, sf)
    now = rows.agg(F.unix_micros(F.max("ts")).alias("now"))
    last = rows.groupBy("job").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("last_kind"), F.unix_micros(F.max("ts")).alias("seen"))
    return last.join(F.broadcast(now)).select("job", "last_kind", (F.col("now") - F.col("seen") <= DAY * 1_000_000).alias("alive"))  # one row


@JOBS.query(
    "t15_silent_errors",
    f"SELECT job, event_id FROM {LOG} e WHERE kind = 'error' AND NOT EXISTS (SELECT 1 FROM {LOG} v WHERE v.job = e.job AND v.kind = 'view' AND v.ts >= e.ts AND v.ts <= e.ts + INTERVAL 6 HOUR)",
)
def silent_errors(spark, sf):
    """Errors that no view follows within six hours, by a join of two streams that is run to its end."""
    folder = f"{shared_folder(spark)}/silent-{uuid.uuid4().hex}"
    last = log(spark, sf).agg((F.max("ts") + F.make_dt_interval(days=F.lit(30))).alias("ts")).select(F.lit(LAST_JOB).cast("long").alias("job"), F.lit(0).cast("long").alias("event_id"), "ts")
    last.coalesce(1).write.parquet(f"{folder}/last")
    files = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/event[s].parquet")
    own = lambda kind: files.where(F.col("event_type") == kind).select(F.col("user_id").alias("job"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    end = spark.readStream.schema(last.schema).parquet(f"{folder}/last")
    views = own("view").unionByName(end).select("job", F.col("event_id").alias("sign_id"), F.col("ts").alias("seen"))
    said = signs.replay(signs.followed(own("error").unionByName(end), views, "6 HOURS"), folder)
    return said.where((F.col("job") != LAST_JOB) & F.col("sign_id").isNull()).select("job", "event_id")


@JOBS.query("w12_state_history", "SELECT conv_id, count(*)::BIGINT AS n_turns, (count(*) FILTER (WHERE before IS NOT NULL AND before = role))::BIGINT AS n_broken FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations) GROUP BY conv_id")
def history(spark, sf):
    """Each turn must hand over from another role than its own."""
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = table(spark, sf, "conversations").withColumn("before", before)
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.expr("before IS NOT NULL AND before = role")).alias("n_broken"))


@JOBS.query("tumbling_windows", "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS day_us, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark, sf):
    """Daily windows; the streaming form is in streaming.windows."""
    rows = log(spark, sf).groupBy(F.window("ts", "1 day").alias("w"), F.col("kind").alias("event_type")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.unix_micros("w.start").alias("day_us"), "event_type", "n", "total")


@JOBS.query(
    "session_windows",
    f"SELECT job, epoch_us(min(ts)) AS start_us, count(*)::BIGINT AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY job ORDER BY ts, event_id) AS session FROM (SELECT *, (coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY job ORDER BY ts, event_id)) >= 43200000000, true))::INT AS fresh FROM {LOG})) GROUP BY job, session",
)
def sessions(spark, sf):
    rows = log(spark, sf).groupBy("job", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("job", F.unix_micros("w.start").alias("start_us"), "n")
