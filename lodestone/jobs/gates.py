"""Gates, claims and states: what a floor, a limit, a mask or an earlier event lets through."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.jobs.corpus import LEXICON, PROBES, probes
from lodestone.jobs.points import PTS, points
from lodestone.jobs.registry import Registry
from lodestone.jobs.strata import OBS, observations
from lodestone.jobs.supervise import DAY, LOG, log
from lodestone.operators import images as I
from lodestone.operators import raster as R
from lodestone.operators import supervision as V
from lodestone.sources.tables import table

JOBS = Registry()


@JOBS.query("a09_weighted_mean", f"SELECT scene, cam, round(sum(visible * area) / nullif(sum(area), 0), 9) AS weighted, count(*)::BIGINT AS n FROM {OBS} GROUP BY scene, cam")
def weighted_mean(spark, sf):
    mean = F.sum(F.col("visible") * F.col("area")) / F.nullif(F.sum("area"), F.lit(0.0))
    return observations(spark, sf).groupBy("scene", "cam").agg(F.round(mean, 9).alias("weighted"), F.count("*").alias("n"))


@JOBS.query("a10_frac_below", f"SELECT scene, cam, round(avg((visible < 0.5)::INT::DOUBLE), 9) AS below_half, round(avg((visible < 0.25)::INT::DOUBLE), 9) AS below_quarter FROM {OBS} GROUP BY scene, cam")
def frac_below(spark, sf):
    share = lambda t: F.round(F.avg((F.col("visible") < t).cast("double")), 9)
    return observations(spark, sf).groupBy("scene", "cam").agg(share(0.5).alias("below_half"), share(0.25).alias("below_quarter"))


@JOBS.query("a14_truncated_mean", f"SELECT scene, round(avg(depth) FILTER (WHERE depth < 20), 9) AS mean_depth, (count(*) FILTER (WHERE depth < 20))::BIGINT AS n_kept, count(*)::BIGINT AS n FROM {OBS} GROUP BY scene")
def truncated_mean(spark, sf):
    """Only distances strictly below the limit count."""
    kept = F.col("depth") < 20
    return observations(spark, sf).groupBy("scene").agg(F.round(F.avg(F.when(kept, F.col("depth"))), 9).alias("mean_depth"), F.count_if(kept).alias("n_kept"), F.count("*").alias("n"))


@JOBS.query("p14_min_support", f"SELECT instance_id, count(*)::BIGINT AS n, count(DISTINCT cam)::BIGINT AS n_views FROM {OBS} GROUP BY instance_id HAVING count(*) >= 8 AND count(DISTINCT cam) >= 3")
def min_support(spark, sf):
    """Entities with eight observations and three views at least."""
    out = observations(spark, sf).groupBy("instance_id").agg(F.count("*").alias("n"), F.size(F.collect_set("cam")).cast("long").alias("n_views"))  # six cameras
    return out.where("n >= 8 AND n_views >= 3")


@JOBS.query(
    "p17_null_lookup_drop",
    "SELECT c_custkey, c_mktsegment, n FROM customer JOIN (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey WHERE n > 0",
)
def null_lookup_drop(spark, sf):
    """Rows whose lookup is missing or counts nothing are dropped."""
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"))
    return table(spark, sf, "customer").join(counts, "c_custkey").where("n > 0").select("c_custkey", "c_mktsegment", "n")


@JOBS.query(
    "j03_join_calibration",
    "SELECT s_nationkey, count(*)::BIGINT AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0 GROUP BY s_nationkey",
)
def join_calibration(spark, sf):
    """Each observation with what its camera is calibrated to; those of an uncalibrated camera are skipped.

    Sums are taken by camera before the join, so that the large side shuffles a row for each camera and task.
    """
    sums = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    known = table(spark, sf, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_nationkey")
    return sums.join(known, "s_suppkey").groupBy("s_nationkey").agg(F.sum("n").alias("n"), F.round(F.sum("quantity"), 4).alias("quantity"))


@JOBS.query("j09_join_lexicon", f"SELECT probe, (count(*) FILTER (WHERE n > 0))::BIGINT AS n_documents, sum(n)::BIGINT AS n_matches FROM ({PROBES}) GROUP BY probe")
def join_lexicon(spark, sf):
    """Documents by probes, totalled; the lexicon is a constant of the plan, and a probe without a match stays with zeros."""
    totals = probes(spark, sf).groupBy("probe").agg(F.count_if(F.col("n") > 0).alias("n_documents"), F.sum("n").cast("long").alias("n_matches"))
    names = spark.createDataFrame([(p,) for p in LEXICON.probes], "probe string")
    return names.join(totals, "probe", "left").na.fill(0)


PIXELS = f"SELECT DISTINCT label, floor(x * 20)::BIGINT AS px, floor(y * 20)::BIGINT AS py FROM {PTS}"


def mask_pixels(spark, sf):
    at = lambda c: F.floor(F.col(c) * 20).cast("long")
    return points(spark, sf).select("label", at("x").alias("px"), at("y").alias("py")).distinct()


@JOBS.query(
    "j11_mask_intersect",
    f"SELECT a.label, count(*)::BIGINT AS n_pixels, count(b.px)::BIGINT AS n_both FROM ({PIXELS}) a LEFT JOIN (SELECT DISTINCT px, py FROM ({PIXELS}) WHERE label >= 5) b ON a.px = b.px AND a.py = b.py WHERE a.label < 5 GROUP BY a.label",
)
def mask_intersect(spark, sf):
    """Pixels of each mask that the other class set covers too."""
    mine = mask_pixels(spark, sf).where("label < 5")
    other = mask_pixels(spark, sf).where("label >= 5").select("px", "py").distinct().withColumn("both", F.lit(1))
    return mine.join(other, ["px", "py"], "left").groupBy("label").agg(F.count("*").alias("n_pixels"), F.count("both").alias("n_both"))


CLAIMS = f"SELECT label, vec_id, z, floor(x * 2)::BIGINT + dx AS x, floor(y * 2)::BIGINT + dy AS y FROM {PTS}, range(-1, 2) a(dx), range(-1, 2) b(dy)"


@JOBS.query(
    "w03_exclusive_claim",
    f"SELECT label, vec_id, round((count(*) FILTER (WHERE nth = 1))::DOUBLE / count(*), 9) AS visible, count(*)::BIGINT AS n_pixels FROM (SELECT *, row_number() OVER (PARTITION BY label, x, y ORDER BY z, vec_id) AS nth FROM ({CLAIMS})) GROUP BY label, vec_id",
)
def exclusive_claim(spark, sf):
    """From near to far, each entity claims the pixels of its patch that no nearer one holds."""
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    at = lambda c: F.floor(F.col(c) * 2).cast("long") + F.col(f"s.d{c}")
    cells = points(spark, sf).withColumn("s", steps).select("label", "vec_id", "z", at("x").alias("x"), at("y").alias("y"))
    return R.owners(cells, ["label"], "vec_id", "z").select("label", "vec_id", F.round("visible", 9).alias("visible"), "n_pixels")


STATES = f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS nth FROM {LOG}),
  started AS (SELECT job, min(nth) AS place FROM o WHERE kind = 'signup' GROUP BY job),
  done AS (SELECT o.job, nth AS place FROM o JOIN started s ON o.job = s.job AND nth > s.place WHERE kind = 'purchase' QUALIFY row_number() OVER (PARTITION BY o.job ORDER BY nth) = 3),
  ended AS (SELECT job, min(place) AS place, arg_min(state, place) AS state FROM (
    SELECT job, place, 'COMPLETE' AS state FROM done UNION ALL SELECT job, min(nth), 'FAILED' FROM o WHERE kind = 'error' AND value > 90 GROUP BY job) GROUP BY job)
  SELECT o.job, event_id, state FROM o JOIN (
    SELECT s.job, s.place, 'RUNNING' AS state FROM started s LEFT JOIN ended e ON s.job = e.job WHERE e.place IS NULL OR s.place < e.place UNION ALL SELECT job, place, state FROM ended) c ON o.job = c.job AND o.nth = c.place"""


@JOBS.query("t01_state_machine", STATES)
def state_machine(spark, sf):
    """Changes of state: RUNNING at the first start, then FAILED at a fatal line or COMPLETE at the third output."""
    return V.states(
        log(spark, sf), start=F.col("kind") == "signup", fatal=(F.col("kind") == "error") & (F.col("value") > 90), output=F.col("kind") == "purchase", outputs=3
    ).select("job", "event_id", "state")


WAITED = f"SELECT job, min(ts) AS began, max(ts) AS ended, min(ts) FILTER (WHERE kind = 'signup') AS started FROM {LOG} GROUP BY job"


@JOBS.query(
    "t09_wait_timeout",
    f"SELECT job, CASE WHEN waited >= 172800000000 THEN 'RESOURCE_WAIT_TIMEOUT' WHEN waited > 86400000000 THEN 'NO_PROGRESS: start marker' WHEN ran > 2505600000000 THEN 'NO_PROGRESS: task deadline exceeded' ELSE 'ok' END AS verdict FROM (SELECT job, epoch_us(coalesce(started, ended)) - epoch_us(began) AS waited, epoch_us(ended) - epoch_us(began) AS ran FROM ({WAITED}))",
)
def wait_timeout(spark, sf):
    """A wait is over when it reaches its limit, a start or a task only beyond it."""
    facts = log(spark, sf).groupBy("job").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), V.first_of(F.col("kind") == "signup").alias("started"))
    waited = V.seconds("began", F.coalesce("started", "ended"))
    verdict = (
        F.when(waited >= 2 * DAY, "RESOURCE_WAIT_TIMEOUT")
        .when(waited > DAY, "NO_PROGRESS: start marker")
        .when(V.seconds("began", "ended") > 29 * DAY, "NO_PROGRESS: task deadline exceeded")
        .otherwise("ok")
    )
    return facts.select("job", verdict.alias("verdict"))


#: The outputs that a job must have: kind, least value, least number.
RULES = (("click", 20.0, 3), ("purchase", 50.0, 2), ("view", 5.0, 4))
_counts = ", ".join(f"(count(*) FILTER (WHERE kind = '{k}' AND value >= {v}))::BIGINT AS {k}" for k, v, _ in RULES)
_fails = ", ".join(f"CASE WHEN {k} < {n} THEN '{k}: ' || {k} || '/{n} valid files' END" for k, _, n in RULES)


@JOBS.query("t11_output_gate", f"SELECT job, {' AND '.join(f'{k} >= {n}' for k, _, n in RULES)} AS passed, concat_ws('; ', {_fails}) AS message FROM (SELECT job, {_counts} FROM {LOG} GROUP BY job)")
def output_gate(spark, sf):
    """Every rule's number of large enough outputs, and a message that lists the rules that fail."""
    return V.output_gate(log(spark, sf), RULES)


SIDE = 8
IMAGES = f"""WITH px AS (SELECT vec_id, label, (i - 1) // {SIDE} AS y, (i - 1) % {SIDE} AS x, embedding[i]::DOUBLE AS a FROM embeddings, range(1, {SIDE * SIDE + 1}) t(i)),
  duo AS (SELECT px.*, b FROM px JOIN (SELECT label, y, x, avg(a) AS b FROM px GROUP BY label, y, x) USING (label, y, x)),
  steps AS (SELECT c, o, CASE WHEN c + o < 0 THEN -1 - c - o WHEN c + o >= {SIDE} THEN {2 * SIDE - 1} - c - o ELSE c + o END AS at FROM range({SIDE}) t(c), range(-3, 4) u(o)),
  near AS (SELECT vec_id, sy.c AS y, sx.c AS x, avg(a) AS ma, avg(b) AS mb, 49 / 48.0::DOUBLE * (avg(a * a) - avg(a) * avg(a)) AS va, 49 / 48.0::DOUBLE * (avg(b * b) - avg(b) * avg(b)) AS vb,
    49 / 48.0::DOUBLE * (avg(a * b) - avg(a) * avg(b)) AS ab FROM duo JOIN steps sy ON duo.y = sy.at JOIN steps sx ON duo.x = sx.at GROUP BY ALL)
  SELECT vec_id, round(avg((2 * ma * mb + 0.0001) * (2 * ab + 0.0009) / ((ma * ma + mb * mb + 0.0001) * (va + vb + 0.0009))), 6) AS ssim, count(*)::BIGINT AS n_pixels
  FROM near JOIN duo USING (vec_id, y, x) WHERE a > 0 GROUP BY vec_id"""


@JOBS.query("f32_masked_ssim", IMAGES)
def masked_ssim(spark, sf):
    """Vectors as images of 8 by 8 against their label's mean image, over the pixels above zero."""
    images = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("image"))
    pixels = images.select("label", F.posexplode("image").alias("at", "value")).groupBy("label", "at").agg(F.avg("value").alias("value"))
    means = pixels.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda p: p["value"]).alias("mean"))  # 64 pixels a label
    pairs = images.join(means, "label").withColumn("mask", F.transform("image", lambda v: v > 0))
    return I.masked_ssim(pairs, "vec_id", "image", "mean", "mask", SIDE).where("n_pixels > 0").withColumn("ssim", F.round("ssim", 6))
