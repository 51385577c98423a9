"""Point-set evaluation over the embeddings: runs are labels, x, y, z the first three dimensions times ten."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import measures as M
from lodestone.functions import tables
from lodestone.jobs.registry import Registry
from lodestone.operators import points as P
from lodestone.operators import raster as R
from lodestone.operators import statistics as S
from lodestone.sources.tables import table

JOBS = Registry()
PTS = "(SELECT vec_id, label, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z, embedding[4]::DOUBLE AS v, embedding[5]::DOUBLE AS w FROM embeddings)"


def points(spark, sf):
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return table(spark, sf, "embeddings").select("vec_id", "label", (e(0) * 10).alias("x"), (e(1) * 10).alias("y"), (e(2) * 10).alias("z"), e(3).alias("v"), e(4).alias("w"))


D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


@JOBS.query("a16_voxel_downsample", f"SELECT label, floor(x / 0.5)::BIGINT AS ix, floor(y / 0.5)::BIGINT AS iy, floor(z / 0.5)::BIGINT AS iz, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z, count(*)::BIGINT AS n FROM {PTS} GROUP BY label, ix, iy, iz")
def voxels(spark, sf):
    out = P.voxel_downsample(points(spark, sf), 0.5, ["label"])
    return out.withColumns({c: F.round(c, 9) for c in P.XYZ})


@JOBS.query("j06_nn_join", "SELECT vec_id, round(sqrt(min(d2)), 6) AS distance FROM (SELECT a.vec_id, list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE) FOR x IN list_zip(a.embedding, b.embedding)]) AS d2 FROM embeddings a, embeddings b WHERE a.label < 5 AND b.label >= 5) GROUP BY vec_id")
def nn_join(spark, sf):
    """Nearest vector of the other half of the labels, over all 64 dimensions."""
    e = table(spark, sf, "embeddings")
    out = P.nearest_vectors(e.where("label < 5").select("vec_id", "embedding"), e.where("label >= 5"), "vec_id", "embedding")
    return out.withColumn("distance", F.round("distance", 6))


@JOBS.query("j06_nn_points", f"SELECT a.vec_id, round(sqrt(min({D2})), 9) AS distance FROM {PTS} a, {PTS} b WHERE a.label < 5 AND b.label >= 5 GROUP BY a.vec_id")
def nn_points(spark, sf):
    """J06 over points in space, without a radius."""
    p = points(spark, sf)
    return P.nearest_points(p.where("label < 5"), p.where("label >= 5"), "vec_id").withColumn("distance", F.round("distance", 9))


@JOBS.query("j06_near_within", f"SELECT q.vec_id, round(min(sqrt({D2})) FILTER (WHERE {D2} < 0.09), 6) AS distance FROM (SELECT vec_id FROM {PTS} WHERE label < 5) q JOIN {PTS} a USING (vec_id), {PTS} b WHERE b.label >= 5 GROUP BY q.vec_id")
def near_within(spark, sf):
    """J06 with a radius (P13: strict): both sides meet in cells of the radius."""
    p = points(spark, sf)
    return P.near_within(p.where("label < 5"), p.where("label >= 5"), "vec_id", 0.3).withColumn("distance", F.round("distance", 6))


@JOBS.query(
    "a15_chamfer",
    f"""WITH a1 AS (SELECT a.vec_id, min(sqrt({D2})) AS d FROM {PTS} a, {PTS} b WHERE a.label < 5 AND a.v > 0 AND b.label >= 5 GROUP BY a.vec_id),
    a2 AS (SELECT a.vec_id, min(sqrt({D2})) AS d FROM {PTS} a, {PTS} b WHERE a.label >= 5 AND b.label < 5 GROUP BY a.vec_id)
    SELECT round(accuracy, 9) AS accuracy, round(completeness, 9) AS completeness, round((accuracy + completeness) / 2, 9) AS overall FROM (SELECT avg(d) FILTER (WHERE d < 0.6) AS accuracy FROM a1), (SELECT avg(d) FILTER (WHERE d < 0.6) AS completeness FROM a2)""",
)
def chamfer(spark, sf):
    """Truncated mean distances; accuracy of the filtered points, completeness against the unfiltered ones."""
    p = points(spark, sf)
    recon, truth = p.where("label < 5"), p.where("label >= 5")
    accuracy = P.near_within(recon.where("v > 0"), truth, "vec_id", 0.6).agg(F.avg("distance").alias("accuracy"))
    completeness = P.near_within(truth, recon, "vec_id", 0.6).agg(F.avg("distance").alias("completeness"))
    both = accuracy.join(F.broadcast(completeness))  # one row each
    return both.select(F.round("accuracy", 9).alias("accuracy"), F.round("completeness", 9).alias("completeness"), F.round((F.col("accuracy") + F.col("completeness")) / 2, 9).alias("overall"))


@JOBS.query("a17_histogram_density", f"SELECT bin, n, round(n / (sum(n) OVER () * 0.05), 9) AS density FROM (SELECT least(floor((x + 3) / 0.05), 119)::INT AS bin, count(*)::BIGINT AS n FROM {PTS} WHERE x BETWEEN -3 AND 3 GROUP BY bin)")
def histogram(spark, sf):
    return P.histogram(points(spark, sf), "x", -3.0, 3.0, 120).withColumn("density", F.round("density", 9))


@JOBS.query(
    "a18_quantile_bin_curve",
    f"""WITH e AS (SELECT list_distinct(quantile_cont(x, {[k / 12 for k in range(13)]})) AS u FROM {PTS}), s AS (SELECT list_sort(u) AS u FROM e),
    b AS (SELECT len([k FOR k IN u IF k <= x]) AS nth, u, v FROM {PTS}, s)
    SELECT (nth - 1)::INT AS bin, round((u[nth] + u[nth + 1]) / 2, 9) AS centre, count(*)::BIGINT AS n, round(median(v), 9) AS median, round(quantile_cont(v, 0.25), 9) AS q25, round(quantile_cont(v, 0.75), 9) AS q75
    FROM b WHERE nth < len(u) GROUP BY nth, u HAVING count(*) >= 10""",
)
def quantile_bins(spark, sf):
    out = P.quantile_bins(points(spark, sf), "x", "v", 12, 10)
    return out.withColumns({c: F.round(c, 9) for c in ("centre", "median", "q25", "q75")})


def grid_sql(where: str, name: str) -> str:
    return f"(SELECT least(greatest(floor((x + 3) / 0.6), 0), 9)::INT AS gx, least(greatest(floor((y + 3) / 0.6), 0), 9)::INT AS gy, median(v) AS {name}, count(*)::BIGINT AS n FROM {PTS} WHERE {where} GROUP BY gx, gy HAVING count(*) >= 3)"


def grid(spark, sf, where):
    return P.grid_median(points(spark, sf).where(where), [], "x", "y", "v", -3.0, 3.0, 10, 3)


@JOBS.query("a19_grid_median", f"SELECT gx, gy, round(m, 9) AS median, n FROM {grid_sql('true', 'm')}")
def grid_median(spark, sf):
    return grid(spark, sf, "true").withColumn("median", F.round("median", 9))


@JOBS.query("a20_grid_delta", f"SELECT round(quantile_cont(abs(b - a), 0.96), 9) AS p96, (count(*) FILTER (WHERE b > a))::DOUBLE / 100 AS share_worse, count(b - a)::BIGINT AS n_compared FROM {grid_sql('label < 5', 'a')} FULL JOIN {grid_sql('label >= 5', 'b')} USING (gx, gy)")
def grid_delta(spark, sf):
    """The share's denominator is all cells of the grid, compared or not."""
    a = grid(spark, sf, "label < 5").select("gx", "gy", F.col("median").alias("a"))
    b = grid(spark, sf, "label >= 5").select("gx", "gy", F.col("median").alias("b"))
    delta = F.col("b") - F.col("a")
    out = a.join(b, ["gx", "gy"], "full").agg(F.percentile(F.abs(delta), 0.96).alias("p96"), (F.count_if(delta > 0) / F.lit(100.0)).alias("share_worse"), F.count(delta).alias("n_compared"))
    return out.withColumn("p96", F.round("p96", 9))


@JOBS.query(
    "a33_bbox_overlap_gate",
    f"""SELECT round(ratio, 9) AS ratio, ratio >= 0.05 AS valid FROM (SELECT greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) * greatest(0, least(a.z1, b.z1) - greatest(a.z0, b.z0))
      / ((a.x1 - a.x0) * (a.y1 - a.y0) * (a.z1 - a.z0)) AS ratio FROM (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM {PTS} WHERE label < 5) a, (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM {PTS} WHERE label >= 5) b)""",
)
def bbox_gate(spark, sf):
    """Overlap of the two sets' boxes over the first's volume; below a twentieth the comparison isn't valid."""
    side = F.when(F.col("label") < 5, "a").otherwise("b")
    boxes = points(spark, sf).groupBy(side.alias("side")).agg(*(f(c).alias(f"{c}{k}") for c in P.XYZ for k, f in ((0, F.min), (1, F.max))))
    one = boxes.agg(*(F.max(F.when(F.col("side") == s, F.col(f"{c}{k}"))).alias(f"{s}{c}{k}") for s in "ab" for c in P.XYZ for k in (0, 1)))
    shared, volume = F.lit(1.0), F.lit(1.0)
    for c in P.XYZ:
        shared = shared * F.greatest(F.lit(0.0), F.least(f"a{c}1", f"b{c}1") - F.greatest(f"a{c}0", f"b{c}0"))
        volume = volume * (F.col(f"a{c}1") - F.col(f"a{c}0"))
    return one.select(F.round(shared / volume, 9).alias("ratio"), (shared / volume >= 0.05).alias("valid"))


@JOBS.query("a27_body_consistency", "SELECT label, round(avg(s), 9) AS mean_sd, round(max(s), 9) AS max_sd FROM (SELECT label, k, stddev_pop(v) AS s FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS k FROM embeddings) GROUP BY label, k HAVING count(*) >= 3) GROUP BY label")
def consistency(spark, sf):
    """Population deviation per dimension, then its mean and maximum over the dimensions."""
    rows = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("k", "v"))
    per = rows.groupBy("label", "k").agg(F.stddev_pop(F.col("v").cast("double")).alias("s"), F.count("*").alias("n")).where("n >= 3")
    return per.groupBy("label").agg(F.round(F.avg("s"), 9).alias("mean_sd"), F.round(F.max("s"), 9).alias("max_sd"))


#: A camera for each label: the mean of its points, turned about the vertical by 36 degrees each.
CAMS = f"(SELECT label AS cam, avg(x) AS cx, avg(y) AS cy, avg(z) - 2 AS cz, cos(label * 0.1) AS c, sin(label * 0.1) AS s FROM {PTS} GROUP BY label)"
SIGNS = "(VALUES " + ", ".join(f"({a}.0::DOUBLE, {b}.0::DOUBLE, {c}.0::DOUBLE)" for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)) + ") t(sa, sb, sc)"
CORNERS = f"SELECT vec_id, x + sa * (abs(v) + 0.1) AS px, y + sb * (abs(w) + 0.1) AS py, z + sc * 0.2 AS pz FROM {PTS}, {SIGNS}"
VIEWS = f"""SELECT vec_id, cam, min(depth) AS depth, min(u) AS u0, min(q) AS v0, max(u) AS u1, max(q) AS v1, bool_or(depth > 0.1 AND u >= 0 AND u < 640 AND q >= 0 AND q < 480) AS inside FROM (
  SELECT vec_id, cam, depth, 320 * camx / greatest(depth, 1e-6) + 320 AS u, 320 * camy / greatest(depth, 1e-6) + 240 AS q FROM (
    SELECT vec_id, cam, c * (px - cx) - s * (pz - cz) AS camx, py - cy AS camy, s * (px - cx) + c * (pz - cz) AS depth FROM ({CORNERS}), {CAMS})) GROUP BY vec_id, cam"""


def views(spark, sf):
    """Boxes around the points, seen by every camera: corners, projection, bounds in the image."""
    p = points(spark, sf)
    signs = F.array(*(F.struct(F.lit(float(a)).alias("sa"), F.lit(float(b)).alias("sb"), F.lit(float(c)).alias("sc")) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)))
    corners = p.withColumn("t", F.explode(signs)).select(
        "vec_id", (F.col("x") + F.col("t.sa") * (F.abs("v") + 0.1)).alias("px"), (F.col("y") + F.col("t.sb") * (F.abs("w") + 0.1)).alias("py"), (F.col("z") + F.col("t.sc") * 0.2).alias("pz")
    )
    cams = p.groupBy(F.col("label").alias("cam")).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), (F.avg("z") - 2).alias("cz"))
    cams = cams.withColumns({"c": F.cos(F.col("cam") * 0.1), "s": F.sin(F.col("cam") * 0.1)})
    seen = P.with_every(corners, cams)
    zero, one = F.lit(0.0), F.lit(1.0)
    rotation = [F.col("c"), zero, F.col("s"), zero, one, zero, -F.col("s"), zero, F.col("c")]
    camera = M.to_camera([F.col("px"), F.col("py"), F.col("pz")], rotation, [F.col("cx"), F.col("cy"), F.col("cz")])
    u, q = M.pinhole(camera, F.lit(320.0), F.lit(320.0), F.lit(320.0), F.lit(240.0))
    seen = seen.select("vec_id", "cam", camera[2].alias("depth"), u.alias("u"), q.alias("q"))
    inside = F.expr("depth > 0.1 AND u >= 0 AND u < 640 AND q >= 0 AND q < 480")
    return seen.groupBy("vec_id", "cam").agg(
        F.min("depth").alias("depth"), F.min("u").alias("u0"), F.min("q").alias("v0"), F.max("u").alias("u1"), F.max("q").alias("v1"), F.bool_or(inside).alias("inside")
    )


@JOBS.query("j04_cross_cameras", f"SELECT vec_id, cam, round(depth, 6) AS depth, round(320 * 1.7 / greatest(depth, 1e-6), 3) AS px_height FROM ({VIEWS}) WHERE inside AND depth > 0.5")
def cross_cameras(spark, sf):
    """Every box in every camera, kept where a corner lies in the image."""
    height = 320 * 1.7 / F.greatest(F.col("depth"), F.lit(1e-6))
    return views(spark, sf).where("inside AND depth > 0.5").select("vec_id", "cam", F.round("depth", 6).alias("depth"), F.round(height, 3).alias("px_height"))


@JOBS.query("f21_transform_points", f"SELECT vec_id, round(2 * x + 1, 9) AS tx, round(2 * y - 1, 9) AS ty, round(2 * z, 9) AS tz, 0.5 * x - y + 0.25 * z + 0.1 > 0 AS above FROM {PTS}")
def transform_points(spark, sf):
    """a similarity of points, and the side of a plane."""
    p = points(spark, sf)
    above = M.plane_side([F.col("x"), F.col("y"), F.col("z")], (0.5, -1.0, 0.25, 0.1))
    return p.select("vec_id", F.round(2 * F.col("x") + 1, 9).alias("tx"), F.round(2 * F.col("y") - 1, 9).alias("ty"), F.round(2 * F.col("z"), 9).alias("tz"), above.alias("above"))


@JOBS.query("f23_median_camera_distance", f"SELECT vec_id, round(median(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz))), 6) AS distance FROM {PTS}, {CAMS} GROUP BY vec_id")
def camera_distance(spark, sf):
    p = points(spark, sf)
    cams = p.groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), (F.avg("z") - 2).alias("cz")).drop("label")
    d = F.sqrt(P.squared_distance([F.col(c) for c in P.XYZ], [F.col(f"c{c}") for c in P.XYZ]))
    return P.with_every(p, cams).groupBy("vec_id").agg(F.round(F.median(d), 6).alias("distance"))


@JOBS.query("j14_join_lookup_grid", f"SELECT label, count(*)::BIGINT AS n_observed FROM {PTS} p WHERE EXISTS (SELECT 1 FROM {PTS} o WHERE o.label = 0 AND round_even(o.x, 0) = round_even(p.x, 0) AND round_even(o.y, 0) = round_even(p.y, 0) AND round_even(o.z, 0) = round_even(p.z, 0)) GROUP BY label")
def lookup_grid(spark, sf):
    """Points whose voxel (halves to even) was observed."""
    p = points(spark, sf)
    for c in P.XYZ:
        p = p.withColumn(f"i{c}", F.rint(c).cast("long"))
    keys = [f"i{c}" for c in P.XYZ]
    return p.join(p.where("label = 0").select(*keys), keys, "left_semi").groupBy("label").agg(F.count("*").alias("n_observed"))


@JOBS.query("f35_argmax_dimension", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS best FROM embeddings")
def argmax_dimension(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("best"))


TRACE = "(SELECT o_orderpriority AS run, o_orderkey AS iter, o_totalprice AS loss FROM orders)"


def trace(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_orderkey").alias("iter"), F.col("o_totalprice").alias("loss"))


@JOBS.query("w05_moving_average_15", f"SELECT run, iter, round(CASE WHEN n < 15 THEN loss ELSE m END, 4) AS loss FROM (SELECT *, count(*) OVER (PARTITION BY run) AS n, count(*) OVER w AS held, avg(loss) OVER w AS m FROM {TRACE} WINDOW w AS (PARTITION BY run ORDER BY iter ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING)) WHERE held = 15 OR n < 15")
def moving_average(spark, sf):
    return S.moving_average(trace(spark, sf), ["run"], "iter", "loss", 15).withColumn("loss", F.round("loss", 4))


@JOBS.query("w08_every_nth", "SELECT iter FROM (SELECT o_orderkey AS iter, row_number() OVER (ORDER BY o_orderkey) - 1 AS nth, greatest(1, count(*) OVER () // 100) AS step FROM orders) WHERE nth % step = 0")
def every_nth(spark, sf):
    return S.every_nth(trace(spark, sf).select("iter"), "iter", 100)


@JOBS.query("w11_head_tail_delta", f"SELECT run, round(h, 4) AS head, round(t, 4) AS tail, round((t - h) / h * 100, 6) AS change_pct FROM (SELECT run, avg(loss) FILTER (WHERE a <= 20) AS h, avg(loss) FILTER (WHERE b <= 20) AS t FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY iter) AS a, row_number() OVER (PARTITION BY run ORDER BY iter DESC) AS b FROM {TRACE}) GROUP BY run)")
def head_tail(spark, sf):
    means = S.ends(trace(spark, sf), ["run"], "iter", "loss", 20)
    change = (F.col("tail") - F.col("head")) / F.col("head") * 100
    return means.select("run", F.round("head", 4).alias("head"), F.round("tail", 4).alias("tail"), F.round(change, 6).alias("change_pct"))


@JOBS.query("w09_sample_fixed", f"SELECT vec_id, label FROM {PTS} ORDER BY md5('11:' || vec_id), vec_id LIMIT 200")
def sample_fixed(spark, sf):
    """A seeded sample of 200 without replacement: the smallest hashes."""
    seeded = F.md5(F.concat(F.lit("11:"), F.col("vec_id").cast("string")).cast("binary"))
    return points(spark, sf).select("vec_id", "label").orderBy(seeded, "vec_id").limit(200)


HULLS = f"""
WITH corners AS (SELECT vec_id // 4 AS entity, label, z, x * 8 + 32 AS cx, y * 8 + 24 AS cy, vec_id FROM {PTS}),
views AS (SELECT entity, min(label) AS cam, min(z) AS depth FROM corners GROUP BY entity),
threes AS (
  SELECT a.entity, a.cx AS ax, a.cy AS ay, b.cx AS bx, b.cy AS b_y, c.cx AS dx, c.cy AS dy, (b.cx - a.cx) * (c.cy - a.cy) - (b.cy - a.cy) * (c.cx - a.cx) AS turn
  FROM corners a JOIN corners b ON a.entity = b.entity AND a.vec_id < b.vec_id JOIN corners c ON a.entity = c.entity AND b.vec_id < c.vec_id),
grid AS (SELECT x, y FROM range(64) h(x), range(48) v(y)),
cells AS (  -- a hull is the union of the triangles of its points
  SELECT DISTINCT entity, x, y FROM (SELECT entity, x, y, x + 0.5 AS px, y + 0.5 AS py, ax, ay, bx, b_y, dx, dy, sign(turn) AS s FROM threes, grid WHERE turn <> 0)
  WHERE s * ((bx - ax) * (py - ay) - (b_y - ay) * (px - ax)) >= 0 AND s * ((dx - bx) * (py - b_y) - (dy - b_y) * (px - bx)) >= 0 AND s * ((ax - dx) * (py - dy) - (ay - dy) * (px - dx)) >= 0),
owned AS (SELECT entity, cam, first_value(entity) OVER (PARTITION BY cam, x, y ORDER BY depth, entity) AS owner FROM cells JOIN views USING (entity))
SELECT cam, entity, (count(*) FILTER (WHERE entity = owner))::DOUBLE / count(*) AS visible, count(*)::BIGINT AS n_pixels FROM owned GROUP BY cam, entity
"""


@JOBS.query("f20_hull_pixels", HULLS)
def hull_pixels(spark, sf):
    """F20, W02-W04 by pixel: outlines of four neighbouring points, one view for each label, and the share of each that stays visible."""
    p = points(spark, sf).withColumn("entity", F.floor(F.col("vec_id") / 4))
    corner = F.struct((F.col("x") * 8 + 32).alias("x"), (F.col("y") * 8 + 24).alias("y"))
    outlines = p.groupBy("entity").agg(F.min("label").alias("cam"), F.min("z").alias("depth"), F.collect_list(corner).alias("outline"))
    cells = R.pixels(outlines, ["entity", "cam", "depth"], "outline", 64, 48)
    return R.owners(cells, ["cam"], "entity", "depth")


@JOBS.query("f20_hull_sql", HULLS)
def hull_in_sql(spark, sf):
    """F20 as a table function that SQL calls, an entity at a time."""
    tables.register(spark)
    p = points(spark, sf).select(F.floor(F.col("vec_id") / 4).alias("entity"), F.col("label").cast("long").alias("cam"), F.col("z").cast("double").alias("depth"), (F.col("x") * 8 + 32).alias("px"), (F.col("y") * 8 + 24).alias("py"))
    p.createOrReplaceTempView("lodestone_corners")
    cells = spark.sql("SELECT * FROM hull_pixels(64, 48, TABLE(lodestone_corners) PARTITION BY entity)")
    return R.owners(cells, ["cam"], "entity", "depth")


def _det_sql(rows: list[int], columns: list[int], width: int) -> str:
    """A determinant by expansion along its first row."""
    if not rows:
        return "1"
    terms = [f"{'-' if k % 2 else '+'} p[{rows[0] * width + c + 1}] * ({_det_sql(rows[1:], columns[:k] + columns[k + 1 :], width)})" for k, c in enumerate(columns)]
    return " ".join(terms)


NUMBERS = "(SELECT vec_id, [x::DOUBLE * 10 FOR x IN embedding] AS p FROM embeddings)"
CENTRE = ", ".join(
    f"round(-({_det_sql([0, 1, 2], columns, 4)}) / ({_det_sql([0, 1, 2], [0, 1, 2], 4)}), 4) AS {name}" for name, columns in (("cx", [3, 1, 2]), ("cy", [0, 3, 2]), ("cz", [0, 1, 3]))
)


def leading(spark, sf, n: int):
    numbers = F.transform(F.slice("embedding", 1, n), lambda x: x.cast("double") * 10)
    return table(spark, sf, "embeddings").select("vec_id", F.explode(F.array(numbers)).alias("p"))


@JOBS.query("f34_camera_centre", f"SELECT vec_id, {CENTRE} FROM {NUMBERS} WHERE abs({_det_sql([0, 1, 2], [0, 1, 2], 4)}) > 0.01")
def camera_centres(spark, sf):
    """Camera centres of 3x4 projections, the vectors' first twelve numbers; nearly singular ones are left out."""
    p = leading(spark, sf, 12)
    e = lambda r, c: F.get("p", F.lit(4 * r + c))
    det = e(0, 0) * (e(1, 1) * e(2, 2) - e(1, 2) * e(2, 1)) - e(0, 1) * (e(1, 0) * e(2, 2) - e(1, 2) * e(2, 0)) + e(0, 2) * (e(1, 0) * e(2, 1) - e(1, 1) * e(2, 0))
    centre = M.camera_centre(F.col("p"))
    return p.where(F.abs(det) > 0.01).select("vec_id", *(F.round(c, 4).alias(n) for c, n in zip(centre, ("cx", "cy", "cz"), strict=True)))


ALL4 = [0, 1, 2, 3]
INVERSE = ", ".join(
    f"round({'-' if (i + j) % 2 else ''}({_det_sql([r for r in ALL4 if r != j], [c for c in ALL4 if c != i], 4)}) / ({_det_sql(ALL4, ALL4, 4)}), 4) AS m{i}{j}" for i, j in ((0, 0), (0, 3), (1, 2), (2, 1), (3, 0), (3, 3))
)


@JOBS.query("f16_general_inverse", f"SELECT vec_id, {INVERSE} FROM {NUMBERS} WHERE abs({_det_sql(ALL4, ALL4, 4)}) > 0.01")
def general_inverse(spark, sf):
    """Inverses of general 4x4 matrices, the vectors' first sixteen numbers; nearly singular ones are left out."""
    both = F.struct(M.inverse4(F.col("p")).alias("m"), M.determinant4(F.col("p")).alias("det"))
    held = leading(spark, sf, 16).select("vec_id", F.explode(F.array(both)).alias("x")).select("vec_id", "x.m", "x.det")
    return held.where(F.abs("det") > 0.01).select("vec_id", *(F.round(F.get("m", F.lit(4 * i + j)), 4).alias(f"m{i}{j}") for i, j in ((0, 0), (0, 3), (1, 2), (2, 1), (3, 0), (3, 3))))
