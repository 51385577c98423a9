"""Point sets: voxels, nearest neighbours, histograms, grids."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.statistics import quantiles, with_quantiles
from lodestone.sources.scratch import settled

XYZ = ("x", "y", "z")


def voxel_downsample(points: DataFrame, size: float, by: Sequence[str] = ()) -> DataFrame:
    """The centroid of each cubic voxel of space; voxels start at multiples of ``size``."""
    keys = [F.floor(F.col(c) / size).cast("long").alias(f"i{c}") for c in XYZ]
    return points.groupBy(*by, *keys).agg(*(F.avg(c).alias(c) for c in XYZ), F.count("*").alias("n"))


def with_every(rows: DataFrame, few: DataFrame, most: int = 10_000) -> DataFrame:
    """Each row with each of ``few``, such as cameras: broadcast up to ``most`` of them, beyond that a product of partitions."""
    return rows.crossJoin(F.broadcast(few) if few.limit(most + 1).count() <= most else few)


def squared_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for p, q in zip(a, b, strict=True):
        out = out + (p - q) * (p - q)
    return out


def near_within(queries: DataFrame, reference: DataFrame, key: str, radius: float, cell: float | None = None) -> DataFrame:
    """Distance from each query to the nearest reference point if it is strictly below ``radius``; else null.

    Space is cut into cells of the radius. Reference points are first thinned to what a
    cell holds of different places, then repeated for the 27 cells around; both
    sides meet in an equi-join on the cell, so that no query meets a point two cells away. Exact below the radius.
    """
    cell = cell or radius
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    ref = reference.select(*XYZ).distinct()
    shifts = F.array(*(F.struct(*(F.lit(d).alias(f"d{c}") for c, d in zip(XYZ, s, strict=True))) for s in product((-1, 0, 1), repeat=3)))
    ref = ref.select(*(F.col(c).alias(f"r{c}") for c in XYZ), *(at(c).alias(f"c{c}") for c in XYZ), F.explode(shifts).alias("s"))
    ref = ref.select(*(f"r{c}" for c in XYZ), *((F.col(f"c{c}") + F.col(f"s.d{c}")).alias(f"k{c}") for c in XYZ))
    own = queries.select(key, *XYZ, *(at(c).alias(f"q{c}") for c in XYZ))
    same = [F.col(f"q{c}") == F.col(f"k{c}") for c in XYZ]
    d2 = squared_distance([F.col(c) for c in XYZ], [F.col(f"r{c}") for c in XYZ])
    met = own.join(ref, same).groupBy(key).agg(F.sqrt(F.min(d2)).alias("distance"))
    met = met.where(F.col("distance") < radius)
    return queries.select(key).join(met, key, "left")


def nearest_points(queries: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """``key, distance``: the exact distance from each query to the nearest reference point, however far; null where there is none.

    Rings of a grid widen until the bound closes: a query looks into the 27 cells around it, of a width at which a cell holds about one
    point. What it finds within that width is the nearest; the others look again at twice the width, and so on. Each round takes only the
    queries that are left, so that a query meets the points about as near as its nearest one. Keys are unique; a query with a null coordinate has a null distance.
    """
    known = " AND ".join(f"{c} IS NOT NULL" for c in XYZ)
    ref = settled(reference.where(known).select(*XYZ).distinct())
    spans = [f(c).alias(f"{f.__name__}_{c}") for c in XYZ for f in (F.min, F.max)]
    size = ref.agg(F.count("*").alias("n"), *spans).first()
    nothing = F.lit(None).cast("double").alias("distance")
    if not size["n"]:
        return queries.select(key, nothing)
    box = queries.where(known).agg(*spans).first()
    width = lambda c: size[f"max_{c}"] - size[f"min_{c}"]
    longest = max(max(map(width, XYZ)), 1e-12)
    radius = float(np.prod([max(width(c), longest * 1e-3) for c in XYZ]) / size["n"]) ** (1 / 3)
    # No query is farther from any point than the diagonal of the box of both.
    ends = [(min(size[f"min_{c}"], box[f"min_{c}"]), max(size[f"max_{c}"], box[f"max_{c}"])) for c in XYZ] if box["min_x"] is not None else []
    most = sum((b - a) ** 2 for a, b in ends) ** 0.5
    left, out = queries.where(known).select(key, *XYZ), queries.where(f"NOT ({known})").select(key, nothing)
    shifts = F.array(*(F.struct(*(F.lit(d).alias(f"d{c}") for c, d in zip(XYZ, s, strict=True))) for s in product((-1, 0, 1), repeat=3)))
    while True:
        at = lambda c: F.floor(F.col(c) / radius).cast("long")  # noqa: B023, E731
        asked = left.select(key, *XYZ, F.explode(shifts).alias("s")).select("*", *((at(c) + F.col(f"s.d{c}")).alias(f"k{c}") for c in XYZ))
        held = ref.select(*(F.col(c).alias(f"r{c}") for c in XYZ), *(at(c).alias(f"c{c}") for c in XYZ))
        met = asked.join(held, [F.col(f"k{c}") == F.col(f"c{c}") for c in XYZ])
        d2 = squared_distance([F.col(c) for c in XYZ], [F.col(f"r{c}") for c in XYZ])
        found = met.groupBy(key).agg(F.sqrt(F.min(d2)).alias("distance")).where(F.col("distance") <= radius)
        found = settled(left.join(found, key, "left"))
        out = out.unionByName(found.where("distance IS NOT NULL").select(key, "distance"))
        left = found.where("distance IS NULL").drop("distance")
        if radius > most or not left.limit(1).count():
            return out
        radius *= 2


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest_vectors(queries: DataFrame, reference: DataFrame, key: str, vector: str, pivots: int = 64, block_rows: int = 4096) -> DataFrame:
    """Exact distance from each query vector to the nearest reference vector.

    Reference vectors lie in the cell of the nearest of some pivots (those of them with the smallest hashes). A query
    looks into its own cell first; what it finds bounds the distance, and by the triangle inequality
    only cells that reach into that ball are searched too. A cell is dealt in
    blocks of about ``block_rows`` rows of each side, so that no task holds more of either; minima are
    combined by key. All vectors are of one length; null ones are left out.
    """
    session = queries.sparkSession
    kind = queries.schema[key].dataType.simpleString()
    doubles = F.col(vector).cast("array<double>").alias("v")
    ref = reference.where(F.col(vector).isNotNull()).select(doubles)
    own = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), doubles)
    chosen = ref.orderBy(F.xxhash64("v"), "v").limit(pivots).collect()  # some pivots
    if not chosen:
        return own.select(F.col("key").alias(key), F.lit(None).cast("double").alias("distance"))
    at = session.sparkContext.broadcast(np.unique(np.array([r["v"] for r in chosen]), axis=0))

    def home(batches):
        for batch in batches:
            v = batch.column(batch.num_columns - 1)
            if len(v):
                d = _squares(_matrix(v), at.value)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(np.sqrt(d[np.arange(len(cell)), cell]))], [*batch.schema.names, "cell", "gap"])

    ref = ref.mapInArrow(home, "v array<double>, cell int, gap double")
    cells = {r["cell"]: (r["reach"], r["n"]) for r in ref.groupBy("cell").agg(F.max("gap").alias("reach"), F.count("*").alias("n")).collect()}  # a row for each pivot
    blocks = F.create_map(*(F.lit(x) for c, (_, n) in cells.items() for x in (c, -(-n // block_rows))))
    ref = ref.select("v", "cell", F.pmod(F.xxhash64("v"), blocks[F.col("cell")]).cast("int").alias("block"))

    def search(asked: DataFrame) -> DataFrame:
        """Minima of the queries ``key, v, cell`` in their cells."""
        held = {r["cell"]: -(-r["n"] // block_rows) for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each pivot
        parts = F.create_map(*(F.lit(x) for c in cells for x in (c, held.get(c, 1))))
        left = asked.select("key", "v", "cell", F.pmod(F.xxhash64("key"), parts[F.col("cell")]).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), blocks[F.col("cell")] - 1)).alias("block"))
        right = ref.select("v", "cell", F.explode(F.sequence(F.lit(0), parts[F.col("cell")] - 1)).alias("part"), "block")

        def near(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return pa.table({"key": a["key"].slice(0, 0), "d2": pa.array([], pa.float64())})
            x, y, d2 = _matrix(a["v"]), _matrix(b["v"]), []
            for k in range(0, len(x), 1024):
                some = x[k : k + 1024]
                d2.append(((some - y[_squares(some, y).argmin(1)]) ** 2).sum(1))
            return pa.table({"key": a["key"], "d2": pa.array(np.concatenate(d2))})

        return left.groupBy("cell", "part", "block").cogroup(right.groupBy("cell", "part", "block")).applyInArrow(near, f"key {kind}, d2 double")

    own = own.mapInArrow(home, f"key {kind}, v array<double>, cell int, gap double").drop("gap")
    first = search(own).groupBy("key").agg(F.min("d2").alias("d2"))
    bound = first.select(F.col("key").alias("_key"), F.sqrt("d2").alias("bound"))
    asked = own.join(bound, F.col("key") == F.col("_key"), "left").select("key", "bound", "cell", "v")
    reach = np.full(len(at.value), -np.inf)
    for c, (r, _) in cells.items():
        reach[c] = r

    def others(batches):
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(3))
                d = np.sqrt(_squares(v, at.value))
                bound = np.array(batch.column(1).to_numpy(zero_copy_only=False), float)
                bound[np.isnan(bound)] = np.inf
                inside = d - reach[None] <= bound[:, None] * (1 + 1e-9) + 1e-9
                inside[np.arange(len(v)), np.array(batch.column(2))] = False
                row, cell = np.nonzero(inside)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(3).take(pa.array(row)), pa.array(cell, pa.int32())], ["key", "v", "cell"])

    more = search(asked.mapInArrow(others, f"key {kind}, v array<double>, cell int"))
    return first.unionByName(more).groupBy(F.col("key").alias(key)).agg(F.sqrt(F.min("d2")).alias("distance"))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts and densities of equal bins; what lies outside is left out, the last edge belongs to the last bin."""
    width = (high - low) / bins
    inside = rows.where((F.col(value) >= low) & (F.col(value) <= high))
    counts = inside.groupBy(F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("bin", "n", (F.col("n") / (F.col("total") * width)).alias("density"))  # one row


def quantile_bins(rows: DataFrame, x: str, y: str, bins: int, least: int) -> DataFrame:
    """Median and quartiles of ``y`` over bins of ``x`` between its quantiles; half open, so that the largest x is left out."""
    edges = quantiles(rows, [], x, [k / bins for k in range(bins + 1)]).agg(F.array_sort(F.collect_set("value")).alias("edges"))
    held = rows.select(x, y).join(F.broadcast(edges))  # one row
    number = F.size(F.filter("edges", lambda e: e <= F.col(x)))
    held = held.withColumn("bin", number - 1).where((F.col("bin") < F.size("edges") - 1) & F.col(x).isNotNull())
    held = held.withColumn("centre", (F.element_at("edges", F.col("bin") + 1) + F.element_at("edges", F.col("bin") + 2)) / 2)
    counts = held.groupBy("bin", "centre").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    quartiles = quantiles(held.select("bin", y), ["bin"], y, (0.25, 0.5, 0.75)).groupBy(F.col("bin").alias("_bin"))
    at = lambda q: F.max(F.when(F.col("q") == q, F.col("value")))
    quartiles = quartiles.agg(at(0.5).alias("median"), at(0.25).alias("q25"), at(0.75).alias("q75"))
    return counts.join(quartiles, F.col("bin") == F.col("_bin"), "left").drop("_bin")


def grid_median(rows: DataFrame, by: Sequence[str], x: str, y: str, value: str, low: float, high: float, cells: int, least: int) -> DataFrame:
    """Medians of the cells of a square grid that hold ``least`` rows; coordinates outside go to the border cells."""
    cell = lambda c: F.least(F.greatest(F.floor((F.col(c) - low) / ((high - low) / cells)), F.lit(0)), F.lit(cells - 1)).cast("int")
    cells_of = rows.select(*by, cell(x).alias("gx"), cell(y).alias("gy"), value)
    counts = cells_of.groupBy(*by, "gx", "gy").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return with_quantiles(counts, cells_of, [*by, "gx", "gy"], {"median": (value, 0.5)}, "n")
