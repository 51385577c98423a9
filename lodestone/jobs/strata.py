"""Observation audits and stratified evaluation.

An observation is a line item: its scene the return flag, its entity the part,
its frame the order, its camera the supplier modulo six.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import measures as M
from lodestone.functions import text as X
from lodestone.jobs.registry import Registry
from lodestone.operators import crowded as C
from lodestone.operators import statistics as S
from lodestone.sources.scratch import settled
from lodestone.sources.tables import table

JOBS = Registry()
OBS = (
    "(SELECT l_returnflag AS scene, l_partkey AS instance_id, l_orderkey AS frame, (l_suppkey % 6)::INT AS cam, l_linenumber AS line, "
    "l_extendedprice / 1000 AS depth, l_quantity * 8 AS px_height, l_quantity * l_quantity AS area, 1 - 8 * l_discount AS visible, l_tax AS err, "
    "least(greatest((60 - l_extendedprice / 1000) / (l_quantity / 5), 0), 1) AS in_frame, l_linestatus = 'F' AS posed FROM lineitem)"
)
#: The edges and names of the strata.
PX, PX_LABELS = (0.0, 96.0, 160.0, 320.0, float("inf")), ("px<96", "px96-160", "px160-320", "px>320")
VIS, VIS_LABELS = (0.0, 0.5, 0.8, 1.01), ("vis<0.5", "vis0.5-0.8", "vis>0.8")


def label_sql(c: str, edges, labels) -> str:
    cases = " ".join(f"WHEN {c} >= {lo} AND {c} < {hi if hi != float('inf') else chr(39) + 'infinity' + chr(39) + '::DOUBLE'} THEN '{name}'" for lo, hi, name in zip(edges, edges[1:], labels, strict=False))
    return f"(CASE {cases} ELSE '{labels[-1]}' END)"


def observations(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    return line.select(
        F.col("l_returnflag").alias("scene"),
        F.col("l_partkey").alias("instance_id"),
        F.col("l_orderkey").alias("frame"),
        (F.col("l_suppkey") % 6).cast("int").alias("cam"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_extendedprice") / 1000).alias("depth"),
        (F.col("l_quantity") * 8).alias("px_height"),
        (F.col("l_quantity") * F.col("l_quantity")).alias("area"),
        (1 - 8 * F.col("l_discount")).alias("visible"),
        F.col("l_tax").alias("err"),
        # The part of the box, whose width is a fortieth of its height, before the frame's edge at 60.
        F.least(F.greatest((60 - F.col("l_extendedprice") / 1000) / (F.col("l_quantity") / 5), F.lit(0)), F.lit(1)).alias("in_frame"),
        (F.col("l_linestatus") == "F").alias("posed"),
    )


A07 = f"""SELECT scene, instance_id, count(*)::BIGINT AS n_observations, count(DISTINCT frame)::BIGINT AS n_frames, count(DISTINCT cam)::BIGINT AS n_cameras,
  min(depth) AS depth_min, median(depth) AS depth_median, max(px_height) AS px_height_max, median(px_height) AS px_height_median FROM {OBS} GROUP BY scene, instance_id"""
A08 = f"""SELECT scene, instance_id, count(*)::BIGINT AS n_visible, median(visible) AS visible_median, round(quantile_cont(visible, 0.1), 9) AS visible_p10, round(sum(visible * area) / sum(area), 9) AS visible_weighted,
  round(avg((visible < 0.5)::INT::DOUBLE), 9) AS frac_below_50, round(avg((visible < 0.25)::INT::DOUBLE), 9) AS frac_below_25, max(visible) AS best_view, round(median(in_frame), 12) AS in_frame_median FROM {OBS} WHERE cam <> 5 GROUP BY scene, instance_id"""
STRATA = f"""SELECT a.scene, a.instance_id, px_height_max, visible_weighted, {label_sql('px_height_max', PX, PX_LABELS)} AS px_stratum, {label_sql('visible_weighted', VIS, VIS_LABELS)} AS vis_stratum,
  a.n_frames / 5.0::DOUBLE AS independent FROM ({A07}) a JOIN ({A08}) b USING (scene, instance_id)"""


BOX = f"(SELECT *, depth AS x0, line * 2.0 AS y0, depth + px_height / 40 AS x1, line * 2.0 + 3 AS y1 FROM {OBS})"
OCCLUSION = f"""SELECT a.scene, a.frame, a.cam, a.line, coalesce(max(CASE WHEN b.frame IS NOT NULL AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)
      THEN round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / greatest((a.x1 - a.x0) * (a.y1 - a.y0), 1e-6), 9) ELSE 0 END), 0) AS occlusion
    FROM {BOX} a LEFT JOIN {BOX} b ON a.frame = b.frame AND a.cam = b.cam AND a.instance_id <> b.instance_id AND b.depth < a.depth GROUP BY a.scene, a.frame, a.cam, a.line"""
A07_WHOLE = f"""SELECT a.*, occlusion_median, occlusion_max FROM ({A07}) a JOIN (SELECT scene, instance_id, round(median(occlusion), 9) AS occlusion_median, max(occlusion) AS occlusion_max
  FROM ({OCCLUSION}) JOIN {OBS} USING (scene, frame, cam, line) GROUP BY scene, instance_id) o USING (scene, instance_id)"""


def entity_views(rows):
    """What is known of each entity's views without quantiles."""
    return rows.groupBy("scene", "instance_id").agg(
        F.count("*").alias("n_observations"),
        F.count_distinct("frame").alias("n_frames"),
        F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("cam")))).cast("long").alias("n_cameras"),  # six of them
        F.min("depth").alias("depth_min"),
        F.max("px_height").alias("px_height_max"),
    )


def entity_visibility(rows):
    share = lambda t: F.round(F.avg((F.col("visible") < t).cast("double")), 9)
    return rows.where("cam <> 5").groupBy("scene", "instance_id").agg(
        F.count("*").alias("n_visible"),
        F.round(F.sum(F.col("visible") * F.col("area")) / F.sum("area"), 9).alias("visible_weighted"),
        share(0.5).alias("frac_below_50"),
        share(0.25).alias("frac_below_25"),
        F.max("visible").alias("best_view"),
    )


@JOBS.query("a07_observation_summary", A07_WHOLE)
def observation_summary(spark, sf):
    """Counts, extremes and exact medians of each entity, also of how far nearer boxes hide it; an entity may have any number of views."""
    rows = observations(spark, sf)
    key = ["scene", "instance_id"]
    hidden = occluders(spark, sf).select("scene", "frame", "cam", "line", "occlusion")
    rows = settled(rows.select(*key, "frame", "cam", "line", "depth", "px_height").join(hidden, ["scene", "frame", "cam", "line"]))
    hiding = rows.groupBy(*key).agg(F.max("occlusion").alias("occlusion_max"))
    out = S.with_quantiles(entity_views(rows).join(hiding, key), rows, key, {"depth_median": ("depth", 0.5), "px_height_median": ("px_height", 0.5), "occlusion_median": ("occlusion", 0.5)}, "n_observations")
    return out.withColumn("occlusion_median", F.round("occlusion_median", 9))


@JOBS.query("a08_visibility_summary", A08)
def visibility_summary(spark, sf):
    """Quantiles, the mean weighted by area, shares below thresholds."""
    rows, key = observations(spark, sf).where("cam <> 5"), ["scene", "instance_id"]
    out = S.with_quantiles(entity_visibility(rows), rows, key, {"visible_median": ("visible", 0.5), "visible_p10": ("visible", 0.1), "in_frame_median": ("in_frame", 0.5)}, "n_visible")
    return out.withColumns({"visible_p10": F.round("visible_p10", 9), "in_frame_median": F.round("in_frame_median", 12)})


def strata(spark, sf):
    a = entity_views(observations(spark, sf)).select("scene", "instance_id", "px_height_max", "n_frames")
    b = entity_visibility(observations(spark, sf)).select("scene", "instance_id", "visible_weighted")
    return a.join(b, ["scene", "instance_id"]).select(
        "scene",
        "instance_id",
        "px_height_max",
        "visible_weighted",
        M.bin_label(F.col("px_height_max"), PX, PX_LABELS).alias("px_stratum"),
        M.bin_label(F.col("visible_weighted"), VIS, VIS_LABELS).alias("vis_stratum"),
        (F.col("n_frames") / 5.0).alias("independent"),
    )


@JOBS.query("j01_join_stats_vis", STRATA)
def join_stats_vis(spark, sf):
    """Entities with both summaries, their strata on two axes, independent frames."""
    return strata(spark, sf)


@JOBS.query("a11_cell_counts", f"SELECT px_stratum, vis_stratum, count(*)::BIGINT AS n FROM ({STRATA}) GROUP BY px_stratum, vis_stratum")
def cell_counts(spark, sf):
    return strata(spark, sf).groupBy("px_stratum", "vis_stratum").agg(F.count("*").alias("n"))


A12 = f"""SELECT px_stratum, vis_stratum, count(*)::BIGINT AS instances, sum(pixels) AS pixels, round(avg(mean), 9) AS metric_mean, round(stddev_pop(mean), 9) AS metric_std FROM (
  SELECT s.px_stratum, s.vis_stratum, o.instance_id, avg(err) AS mean, sum(area) AS pixels FROM {OBS} o JOIN ({STRATA}) s ON o.scene = s.scene AND o.instance_id = s.instance_id
  WHERE o.cam < 3 GROUP BY ALL) GROUP BY px_stratum, vis_stratum HAVING count(*) >= 3"""


@JOBS.query("a12_macro_average", A12)
def macro(spark, sf):
    """Per-entity means, then cells with three entities or more."""
    rows = observations(spark, sf).where("cam < 3").join(strata(spark, sf).select("scene", "instance_id", "px_stratum", "vis_stratum"), ["scene", "instance_id"])
    out = S.macro_average(rows, ["px_stratum", "vis_stratum"], "instance_id", "err", "area").where("instances >= 3")
    return out.withColumns({"metric_mean": F.round("metric_mean", 9), "metric_std": F.round("metric_std", 9)})


@JOBS.query(
    "j13_join_cells_pivot",
    f"SELECT px_stratum, round(avg(err) FILTER (WHERE posed), 9) AS fine, round(avg(err) FILTER (WHERE NOT posed), 9) AS coarse FROM {OBS} o JOIN ({STRATA}) s USING (scene, instance_id) GROUP BY px_stratum",
)
def cells_pivot(spark, sf):
    """Mask sources side by side; null where a cell has none."""
    rows = observations(spark, sf).join(strata(spark, sf).select("scene", "instance_id", "px_stratum"), ["scene", "instance_id"])
    rows = rows.withColumn("mask", F.when(F.col("posed"), "fine").otherwise("coarse"))
    return rows.groupBy("px_stratum").pivot("mask", ["fine", "coarse"]).agg(F.round(F.avg("err"), 9))


@JOBS.query("a13_mse_psnr", f"SELECT scene, cam, CASE WHEN mse > 1e-12 THEN round(-10 * log10(mse), 6) END AS psnr, n_masked FROM (SELECT scene, cam, avg(err * err) FILTER (WHERE visible > 0.9) AS mse, (count(*) FILTER (WHERE visible > 0.9))::BIGINT AS n_masked FROM {OBS} GROUP BY scene, cam)")
def mse_psnr(spark, sf):
    masked = F.when(F.col("visible") > 0.9, F.col("err") * F.col("err"))
    rows = observations(spark, sf).groupBy("scene", "cam").agg(F.avg(masked).alias("mse"), F.count(masked).alias("n_masked"))
    return rows.select("scene", "cam", F.round(M.psnr(F.col("mse")), 6).alias("psnr"), "n_masked")


@JOBS.query(
    "a21_threshold_table",
    f"SELECT threshold, (count(*) FILTER (WHERE px_height_max < threshold))::BIGINT AS n_below, round(avg((px_height_max < threshold)::INT::DOUBLE), 9) AS frac_below FROM ({A07}), (VALUES (48.0::DOUBLE), (96.0), (160.0), (320.0), (384.0)) t(threshold) GROUP BY threshold",
)
def threshold_table(spark, sf):
    limits = spark.createDataFrame([(x,) for x in (48.0, 96.0, 160.0, 320.0, 384.0)], "threshold double")
    rows = observations(spark, sf).groupBy("scene", "instance_id").agg(F.max("px_height").alias("px_height_max"))
    below = F.col("px_height_max") < F.col("threshold")
    rows = rows.join(F.broadcast(limits))  # five rows
    return rows.groupBy("threshold").agg(F.count_if(below).alias("n_below"), F.round(F.avg(below.cast("double")), 9).alias("frac_below"))


QS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


@JOBS.query(
    "a22_quantile_profile",
    " UNION ALL ".join(f"SELECT '{c}' AS metric, {q}::DOUBLE AS q, round(quantile_cont({c}, {q}), 9) AS value FROM {OBS}" for c in ("depth", "px_height", "visible") for q in QS),
)
def quantile_profile(spark, sf):
    return S.quantile_profile(observations(spark, sf), ["depth", "px_height", "visible"], QS).withColumn("value", F.round("value", 9))


HAS = f"SELECT scene, instance_id, max(px_height) AS h, max(visible) AS v, bool_or(posed AND cam = 0) AS has_pose, bool_or(cam = 0) AS in_table, (count(*) FILTER (WHERE posed AND cam = 0))::BIGINT AS n_valid FROM {OBS} GROUP BY scene, instance_id"


def entities(spark, sf):
    """Entities with their best view, whether they have a pose, and how many valid frames."""
    posed = F.expr("posed AND cam = 0")
    return observations(spark, sf).groupBy("scene", "instance_id").agg(
        F.max("px_height").alias("h"), F.max("visible").alias("v"), F.bool_or(posed).alias("has_pose"), F.bool_or(F.expr("cam = 0")).alias("in_table"), F.count_if(posed).alias("n_valid")
    )


@JOBS.query(
    "a23_coverage_by_stratum",
    f"SELECT scene, stratum, grouping(scene, stratum)::BIGINT AS level, count(*)::BIGINT AS n, (count(*) FILTER (WHERE has_pose))::BIGINT AS n_with, round(avg(has_pose::INT::DOUBLE), 9) AS ratio, median(n_valid) FILTER (WHERE has_pose) AS median_valid "
    f"FROM (SELECT *, {label_sql('h', PX, PX_LABELS)} AS stratum FROM ({HAS})) GROUP BY ROLLUP (scene, stratum)",
)
def coverage_by_stratum(spark, sf):
    """Strata, scenes and everything: one rollup."""
    rows = entities(spark, sf).withColumn("stratum", M.bin_label(F.col("h"), PX, PX_LABELS))
    return rows.rollup("scene", "stratum").agg(
        F.grouping_id().alias("level"),
        F.count("*").alias("n"),
        F.count_if("has_pose").alias("n_with"),
        F.round(F.avg(F.col("has_pose").cast("double")), 9).alias("ratio"),
        F.median(F.when(F.col("has_pose"), F.col("n_valid"))).alias("median_valid"),
    )


@JOBS.query(
    "a24_coverage_by_bin",
    f"SELECT bin, n, n_with, ratio, coalesce(ratio < lag(ratio) OVER (ORDER BY bin), false) AS violates FROM (SELECT least(floor(h / 64), 5)::INT AS bin, count(*)::BIGINT AS n, (count(*) FILTER (WHERE has_pose))::BIGINT AS n_with, "
    f"round(avg(has_pose::INT::DOUBLE), 9) AS ratio FROM ({HAS}) GROUP BY bin)",
)
def coverage_by_bin(spark, sf):
    """Half-open bins of 64 pixels, the last open; where the share falls from one bin to the next it violates monotonicity."""
    bins = entities(spark, sf).groupBy(F.least(F.floor(F.col("h") / 64), F.lit(5)).cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.count_if("has_pose").alias("n_with"), F.round(F.avg(F.col("has_pose").cast("double")), 9).alias("ratio")
    )
    return bins.withColumn("violates", F.coalesce(F.col("ratio") < F.lag("ratio").over(Window.orderBy("bin")), F.lit(False)))  # six rows


@JOBS.query("a25_spearman", f"SELECT round(corr(rx, ry), 6) AS rho, count(*)::BIGINT AS n FROM (SELECT rank() OVER (ORDER BY h) + (count(*) OVER (PARTITION BY h) - 1) / 2 AS rx, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS ry FROM ({HAS}))")
def spearman(spark, sf):
    return S.spearman(entities(spark, sf), "h", "v").withColumn("rho", F.round("rho", 6))


@JOBS.query("p25_unambiguous_miss", f"SELECT scene, instance_id FROM ({HAS}) WHERE h >= 160 AND v >= 0.9 AND NOT has_pose")
def unambiguous_miss(spark, sf):
    return entities(spark, sf).where("h >= 160 AND v >= 0.9 AND NOT has_pose").select("scene", "instance_id")


@JOBS.query("p26_tier_label", f"SELECT CASE WHEN h < 96 THEN 'low' WHEN h < 160 THEN 'middle' ELSE 'high' END AS tier, count(*)::BIGINT AS n, (count(*) FILTER (WHERE NOT has_pose))::BIGINT AS n_without, round(avg((NOT has_pose)::INT::DOUBLE), 9) AS share FROM ({HAS}) GROUP BY tier")
def tier_label(spark, sf):
    tier = F.when(F.col("h") < 96, "low").when(F.col("h") < 160, "middle").otherwise("high")
    return entities(spark, sf).groupBy(tier.alias("tier")).agg(
        F.count("*").alias("n"), F.count_if(~F.col("has_pose")).alias("n_without"), F.round(F.avg((~F.col("has_pose")).cast("double")), 9).alias("share")
    )


@JOBS.query("j17_anti_failure_stage", f"SELECT scene, CASE WHEN NOT in_table THEN 'absent' WHEN NOT has_pose THEN 'all_invalid' ELSE 'posed' END AS stage, count(*)::BIGINT AS n FROM ({HAS}) GROUP BY scene, stage")
def failure_stage(spark, sf):
    """Entities without a pose: absent from the table of poses, or there with invalid frames only."""
    all_of = observations(spark, sf).select("scene", "instance_id").distinct()
    poses = observations(spark, sf).where("cam = 0").groupBy("scene", "instance_id").agg(F.bool_or("posed").alias("valid"))
    stage = F.when(F.col("valid").isNull(), "absent").when(~F.col("valid"), "all_invalid").otherwise("posed")
    return all_of.join(poses, ["scene", "instance_id"], "left").groupBy("scene", stage.alias("stage")).agg(F.count("*").alias("n"))


@JOBS.query("a34_crosstab_2x2", f"SELECT has_pose, (count(*) FILTER (WHERE h >= 200))::BIGINT AS moving, (count(*) FILTER (WHERE h < 200))::BIGINT AS still FROM ({HAS}) GROUP BY has_pose")
def crosstab(spark, sf):
    rows = entities(spark, sf).withColumn("side", F.when(F.col("h") >= 200, "moving").otherwise("still"))
    return rows.groupBy("has_pose").pivot("side", ["moving", "still"]).agg(F.count(F.lit(1))).na.fill(0)


@JOBS.query("j08_semi_pose", f"SELECT DISTINCT scene, instance_id FROM {OBS} WHERE posed AND cam = 0")
def semi_pose(spark, sf):
    all_of = observations(spark, sf).select("scene", "instance_id").distinct()
    return all_of.join(observations(spark, sf).where("posed AND cam = 0"), ["scene", "instance_id"], "left_semi")


@JOBS.query(
    "w02_painter_order",
    f"SELECT scene, frame, cam, owner, n FROM (SELECT scene, frame, cam, arg_min(instance_id, (depth, instance_id)) AS owner, count(*)::BIGINT AS n FROM {OBS} GROUP BY scene, frame, cam)",
)
def painter_order(spark, sf):
    """Far to near with overwriting, and near to far with claims, both leave the nearest as the owner."""
    return observations(spark, sf).groupBy("scene", "frame", "cam").agg(F.min_by("instance_id", F.struct("depth", "instance_id")).alias("owner"), F.count("*").alias("n"))


@JOBS.query(
    "w04_visible_ratio",
    f"SELECT scene, instance_id, round(least(1.0, (count(*) FILTER (WHERE instance_id = owner))::DOUBLE / count(*)), 9) AS ratio FROM (SELECT scene, instance_id, first_value(instance_id) OVER (PARTITION BY scene, frame, cam ORDER BY depth, instance_id) AS owner FROM {OBS}) GROUP BY scene, instance_id",
)
def visible_ratio(spark, sf):
    pixels = observations(spark, sf)
    owned = pixels.join(painter_order(spark, sf).select("scene", "frame", "cam", "owner"), ["scene", "frame", "cam"])
    ratio = F.count_if(F.col("instance_id") == F.col("owner")) / F.count("*")
    return owned.groupBy("scene", "instance_id").agg(F.round(F.least(F.lit(1.0), ratio), 9).alias("ratio"))


@JOBS.query("j05_theta_occluders", OCCLUSION)
def occluders(spark, sf):
    """The largest share of a box that a strictly nearer one of another entity covers in the same frame and camera."""
    boxes = observations(spark, sf).selectExpr("scene", "frame", "cam", "line", "instance_id", "depth", "depth AS x0", "line * 2.0D AS y0", "depth + px_height / 40 AS x1", "line * 2.0D + 3 AS y1")
    return C.hidden(boxes, ["frame", "cam"], ["scene", "line"], "instance_id", "depth")


@JOBS.query(
    "p24_depth_strict_lt",
    f"SELECT a.frame, a.cam, count(*)::BIGINT AS n_pairs, (count(*) FILTER (WHERE b.depth < a.depth))::BIGINT AS n_nearer, (count(*) FILTER (WHERE b.depth = a.depth))::BIGINT AS n_level FROM {OBS} a JOIN {OBS} b ON a.frame = b.frame AND a.cam = b.cam AND a.instance_id <> b.instance_id GROUP BY a.frame, a.cam",
)
def strictly_nearer(spark, sf):
    """Of the pairs of different entities in a view, those whose second is strictly nearer; at equal depth neither hides the other."""
    return C.nearer_pairs(observations(spark, sf), ["frame", "cam"], "instance_id", "depth")


@JOBS.query(
    "f18_coverage_ratio",
    f"""SELECT a.frame, a.cam, a.line, b.line AS other, round(CASE WHEN least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)
      THEN (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / greatest((a.x1 - a.x0) * (a.y1 - a.y0), 1e-6) ELSE 0 END, 9) AS ratio
    FROM {BOX} a JOIN {BOX} b ON a.frame = b.frame AND a.cam = b.cam AND a.line <> b.line""",
)
def coverage_ratios(spark, sf):
    """How much of each box another one of its view covers; not symmetric."""
    boxes = observations(spark, sf).selectExpr("frame", "cam", "line", "depth AS x0", "line * 2.0D AS y0", "depth + px_height / 40 AS x1", "line * 2.0D + 3 AS y1")
    a, b = boxes.alias("a"), boxes.alias("b")
    pairs = a.join(b, (F.col("a.frame") == F.col("b.frame")) & (F.col("a.cam") == F.col("b.cam")) & (F.col("a.line") != F.col("b.line")))
    side = lambda t: [F.col(f"{t}.{c}") for c in ("x0", "y0", "x1", "y1")]
    return pairs.select("a.frame", "a.cam", "a.line", F.col("b.line").alias("other"), F.round(M.coverage_ratio(side("a"), side("b")), 9).alias("ratio"))


@JOBS.query("w07_argmax_per_frame", f"SELECT scene, frame, cam, px_height FROM (SELECT *, row_number() OVER (PARTITION BY scene, frame ORDER BY px_height DESC, cam, line) AS nth FROM {OBS}) WHERE nth = 1")
def argmax_per_frame(spark, sf):
    best = F.struct("px_height", (-F.col("cam")).alias("c"), (-F.col("line")).alias("l"))
    return S.argmax_rows(observations(spark, sf), ["scene", "frame"], best, ["cam", "px_height"])


@JOBS.query("p12_halfopen_range", f"SELECT scene, (count(*) FILTER (WHERE px_height >= 96 AND px_height < 160))::BIGINT AS n_inside, (count(*) FILTER (WHERE visible < 0.5))::BIGINT AS n_below FROM {OBS} GROUP BY scene HAVING count(*) >= 50")
def halfopen(spark, sf):
    """Half-open membership, strict truncation, a floor of support."""
    rows = observations(spark, sf).groupBy("scene").agg(
        F.count_if(F.expr("px_height >= 96 AND px_height < 160")).alias("n_inside"), F.count_if(F.expr("visible < 0.5")).alias("n_below"), F.count("*").alias("n")
    )
    return rows.where("n >= 50").drop("n")


@JOBS.query("p03_prefix_filter", "SELECT p_type, count(*)::BIGINT AS n FROM part WHERE starts_with(p_type, 'PROMO') GROUP BY p_type")
def prefix_filter(spark, sf):
    return table(spark, sf, "part").where(F.col("p_type").startswith("PROMO")).groupBy("p_type").agg(F.count("*").alias("n"))


@JOBS.query("p16_class_set", f"SELECT scene, count(*)::BIGINT AS n FROM {OBS} WHERE cam IN (1, 3) AND posed GROUP BY scene")
def class_set(spark, sf):
    """Members of a class set inside the mask."""
    return observations(spark, sf).where(F.col("cam").isin(1, 3) & F.col("posed")).groupBy("scene").agg(F.count("*").alias("n"))


@JOBS.query("p04_date_floor", "SELECT o_orderpriority, count(*)::BIGINT AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY o_orderpriority")
def date_floor(spark, sf):
    """A typed floor that reaches the scan; the day of a time stamp."""
    rows = table(spark, sf, "orders").where(F.col("o_orderdate") >= F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00")))
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_day"))


@JOBS.query(
    "a26_seed_noise_floor",
    "SELECT m.l_linestatus AS setting, round(m.mean, 9) AS mean, round(m.sd, 9) AS sd, round(m.spread, 9) AS spread, CASE WHEN m.l_linestatus = 'F' THEN 0 ELSE round((m.mean - b.mean) / b.mean * 100, 6) END AS delta_pct, CASE WHEN m.l_linestatus = 'F' THEN 0 ELSE round((m.mean - b.mean) / b.sd, 6) END AS delta_sds FROM "
    "(SELECT l_linestatus, avg(v) AS mean, stddev_samp(v) AS sd, max(v) - min(v) AS spread FROM (SELECT l_linestatus, l_linenumber, avg(l_discount) AS v FROM lineitem GROUP BY ALL) GROUP BY l_linestatus) m, "
    "(SELECT avg(v) AS mean, stddev_samp(v) AS sd FROM (SELECT l_linenumber, avg(l_discount) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)) b",
)
def noise_floor(spark, sf):
    """Sample deviation over repetitions, and the change against the base setting in percent and in its deviations."""
    runs = table(spark, sf, "lineitem").groupBy("l_linestatus", "l_linenumber").agg(F.avg("l_discount").alias("v"))
    all_of = runs.groupBy(F.col("l_linestatus").alias("setting")).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), (F.max("v") - F.min("v")).alias("spread"))
    base = all_of.where("setting = 'F'").select(F.col("mean").alias("m0"), F.col("sd").alias("s0"))
    change = F.col("mean") - F.col("m0")
    return all_of.join(F.broadcast(base)).select(  # one row
        "setting", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"), F.round("spread", 9).alias("spread"), F.when(F.col("setting") == "F", 0.0).otherwise(F.round(change / F.col("m0") * 100, 6)).alias("delta_pct"), F.when(F.col("setting") == "F", 0.0).otherwise(F.round(change / F.col("s0"), 6)).alias("delta_sds")
    )


@JOBS.query("a36_capacity_ratio", "SELECT p_brand, sum(p_size)::BIGINT AS entities, CASE WHEN sum(p_size) > 0 THEN round(sum(p_size) / 6890.0::DOUBLE, 9) END AS equivalent FROM part GROUP BY p_brand")
def capacity_ratio(spark, sf):
    rows = table(spark, sf, "part").groupBy("p_brand").agg(F.sum("p_size").alias("entities"))
    return rows.withColumn("equivalent", F.when(F.col("entities") > 0, F.round(F.col("entities") / 6890.0, 9)))


@JOBS.query("a31_latest_by_key", "SELECT c_mktsegment, arg_max(c_name, CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT)) AS latest FROM customer GROUP BY c_mktsegment")
def latest_by_key(spark, sf):
    number = F.regexp_extract("c_name", "([0-9]+)$", 1).cast("long")
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.max_by("c_name", number).alias("latest"))


def _spaced_sql(rounds: int) -> str:
    ctes = [f"left0 AS (SELECT instance_id, frame, px_height FROM {OBS})"]
    for k in range(rounds):
        ctes.append(f"best{k} AS (SELECT instance_id, arg_max(frame, (px_height, -frame)) AS frame FROM left{k} GROUP BY instance_id)")
        ctes.append(f"left{k + 1} AS (SELECT l.* FROM left{k} l JOIN best{k} b USING (instance_id) WHERE abs(l.frame - b.frame) >= 500)")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT instance_id, {k}::INT AS nth, frame FROM best{k}" for k in range(rounds))


@JOBS.query("w06_topk_spaced", _spaced_sql(3))
def topk_spaced(spark, sf):
    """Per part, greedily three orders of the largest height at least 500 apart."""
    return S.spaced_top(observations(spark, sf), ["instance_id"], "frame", "px_height", 3, 500)


@JOBS.query("f33_step_policy", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 25 THEN 0.85 WHEN l_quantity < 40 THEN 0.6 WHEN l_quantity < 45 THEN 0.35 ELSE 0.15 END::DOUBLE AS duty FROM lineitem")
def step_policy(spark, sf):
    q = F.col("l_quantity")
    duty = F.when(q < 25, 0.85).when(q < 40, 0.6).when(q < 45, 0.35).otherwise(0.15)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", duty.alias("duty"))


@JOBS.query(
    "j12_join_pred_gt",
    "SELECT o_orderpriority AS scene, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS ordinal, o_orderkey AS native, o_totalprice AS truth FROM orders",
)
def join_pred_gt(spark, sf):
    """A prediction's file number is the place of its frame in the scene's request; the truth has the native number."""
    orders = table(spark, sf, "orders")
    asked = S.numbered(orders.select(F.col("o_orderpriority").alias("scene"), F.col("o_orderkey").alias("native")), ["scene"], "native")
    truth = orders.select(F.col("o_orderkey").alias("frame"), F.col("o_totalprice").alias("truth"))
    return asked.join(truth, F.col("native") == F.col("frame")).select("scene", F.col("_nth").alias("ordinal"), "native", "truth")


@JOBS.query(
    "f31_frame_ranges",
    "SELECT o_orderkey, len(range(first, stop, step))::BIGINT AS n_frames, coalesce(list_max(range(first, stop, step)), -1)::BIGINT AS last FROM (SELECT o_orderkey, o_orderkey % 7 AS first, o_orderkey % 100 AS stop, 1 + o_orderkey % 5 AS step FROM orders)",
)
def frame_ranges(spark, sf):
    """a request ``range:start:stop:step`` or a comma list as frames; the stop is exclusive."""
    key = F.col("o_orderkey")
    spec = F.concat_ws(":", F.lit("range"), *((x).cast("string") for x in (key % 7, key % 100, 1 + key % 5)))
    frames = X.frame_list(spec)
    return table(spark, sf, "orders").select("o_orderkey", F.size(frames).cast("long").alias("n_frames"), F.coalesce(F.array_max(frames), F.lit(-1)).cast("long").alias("last"))
