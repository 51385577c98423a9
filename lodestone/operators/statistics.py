"""Aggregations over entities, strata and series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.ordered import numbered
from lodestone.sources.scratch import settled


def macro_average(rows: DataFrame, cell: Sequence[str], entity: str, metric: str, pixels: str) -> DataFrame:
    """Each entity's mean first, then a cell's mean and population deviation over its entities, so that large entities don't outweigh."""
    per = rows.groupBy(*cell, entity).agg(F.avg(metric).alias("mean"), F.sum(pixels).alias("pixels"))
    return per.groupBy(*cell).agg(
        F.count("*").alias("instances"), F.sum("pixels").alias("pixels"), F.avg("mean").alias("metric_mean"), F.stddev_pop("mean").alias("metric_std")
    )


def quantiles(rows: DataFrame, by: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """``by, q, value``: exact, linearly interpolated quantiles of each group's values that aren't null.

    Equal values are counted before they are put in order, and groups may be of any size.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    placed = numbered(counts, by, "_v", "_n")
    at = lambda q: F.lit(q) * (F.col("_size") - 1)
    holds = lambda rank: (F.col("_nth") <= rank) & (rank < F.col("_nth") + F.col("_n"))
    # A value is a quantile's lower or upper neighbour, or both; few rows are left after this.
    met = F.array(*(F.struct(F.lit(float(q)).alias("q"), at(q).alias("at"), holds(F.floor(at(q))).alias("low"), holds(F.ceil(at(q))).alias("high")) for q in qs))
    near = placed.withColumn("_m", F.explode(F.filter(met, lambda m: m["low"] | m["high"])))
    ends = near.groupBy(*by, F.col("_m.q").alias("q")).agg(
        F.first("_m.at").alias("at"), F.max(F.when(F.col("_m.low"), F.col("_v"))).alias("low"), F.max(F.when(F.col("_m.high"), F.col("_v"))).alias("high")
    )
    mid = (F.ceil("at") - F.col("at")) * F.col("low") + (F.col("at") - F.floor("at")) * F.col("high")
    return ends.select(*by, "q", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(mid).alias("value"))


def quantile_columns(rows: DataFrame, by: Sequence[str], asked: Mapping[str, tuple[str, float]]) -> DataFrame:
    """``by`` and a column for each of ``asked``, name: (column, q); a group whose column is null throughout has a null, one without any value no row."""
    columns = sorted({c for c, _ in asked.values()})
    long = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns))
    found = quantiles(rows.select(*by, F.explode(long).alias("x")).select(*by, "x.metric", "x.v"), [*by, "metric"], "v", sorted({q for _, q in asked.values()}))
    at = lambda c, q: F.max(F.when((F.col("metric") == c) & (F.col("q") == q), F.col("value")))
    return found.groupBy(*by).agg(*(at(c, q).alias(name) for name, (c, q) in asked.items()))


#: Rows of a group up to which its values are put in order in one buffer.
FEW = 10_000


def with_quantiles(summary: DataFrame, rows: DataFrame, by: Sequence[str], asked: Mapping[str, tuple[str, float]], size: str, *, few: int = FEW) -> DataFrame:
    """``summary``, a row for each group of ``rows`` and ``size`` of them, with :func:`quantile_columns`; it is written once.

    Groups of up to ``few`` rows take one aggregate, only larger ones an order that is cut into ranges.
    """
    summary = settled(summary)
    many = summary.where(F.col(size) > few).select(*(F.col(c).alias(f"_{c}") for c in by))
    in_group = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    found = None
    if many.limit(1).count():
        found = quantile_columns(rows.join(many, in_group, "left_semi"), by, asked)
        rows = rows.join(many, in_group, "left_anti")
    small = rows.groupBy(*by).agg(*(F.percentile(F.col(c).cast("double"), q).alias(name) for name, (c, q) in asked.items()))
    found = small if found is None else small.unionByName(found)
    found = found.select(*(F.col(c).alias(f"_of_{c}") for c in by), *asked)
    return summary.join(found, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by], "left").drop(*(f"_of_{c}" for c in by))


def quantile_profile(rows: DataFrame, columns: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """``metric, q, value``: exact, linearly interpolated quantiles of each column."""
    long = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in columns))
    return quantiles(rows.select(F.explode(long).alias("x")).select("x.metric", "x.v"), ["metric"], "v", qs)


def average_ranks(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rows with average ranks ``rx, ry``. Values are counted first, and the distinct ones put in order range by range."""

    def ranks(c: str, name: str) -> DataFrame:
        counts = rows.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"_{name}")).agg(F.count("*").alias("n"))
        return numbered(counts, [], f"_{name}", "n").select(f"_{name}", (F.col("_nth") + (F.col("n") + 1) / 2).alias(name))

    out = rows.join(ranks(x, "rx"), F.col(x) == F.col("_rx")).join(ranks(y, "ry"), F.col(y) == F.col("_ry"))
    return out.drop("_rx", "_ry")


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    return average_ranks(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, y).agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))


def moving_average(rows: DataFrame, by: Sequence[str], order: str, value: str, k: int, block: int = 4096) -> DataFrame:
    """Means of ``k`` rows labelled with the first; a series of fewer rows is returned as it is. An order with ties gives means that depend on how they fall.

    A series may be of any length: it is cut into blocks of rows, each with the ``k - 1`` first ones of the next block.
    """
    placed = numbered(rows.select(*by, order, value), by, order)
    home = F.floor(F.col("_nth") / block)
    blocks = F.array_distinct(F.array(home, F.greatest(F.floor((F.col("_nth") - k + 1) / block), F.lit(0))))
    cut = placed.select("*", home.alias("_home"), F.explode(blocks).alias("_block"))
    ahead = Window.partitionBy(*by, "_block").orderBy("_nth").rowsBetween(0, k - 1)
    out = cut.withColumn("held", F.count("*").over(ahead)).withColumn("mean", F.avg(value).over(ahead))
    # A short series lies in its first block as a whole.
    first = Window.partitionBy(*by, "_block")
    out = out.withColumn("short", (F.col("_block") == 0) & (F.count("*").over(first) < k)).where("_home = _block")
    return out.where((F.col("held") == k) | F.col("short")).select(*by, order, F.when(F.col("short"), F.col(value)).otherwise(F.col("mean")).alias(value))


def every_nth(rows: DataFrame, order: str, most: int) -> DataFrame:
    """Every n-th row in order, n so that at most about ``most`` stay; which ones depends on an order without ties."""
    step = F.greatest(F.lit(1), F.floor(F.col("_size") / most))
    return numbered(rows, [], order).where(F.col("_nth") % step == 0).drop("_nth", "_size")


def ends(rows: DataFrame, by: Sequence[str], order: str, value: str, k: int) -> DataFrame:
    """Means of the first and the last ``k`` rows of each series, ``head, tail``; all but ``k`` rows of a series and task are left out before the shuffle."""

    def side(name: str, place) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*by).orderBy(place))
        return rows.withColumn("_nth", nth).where(F.col("_nth") <= k).groupBy(*by).agg(F.avg(value).alias(name))

    tail = side("tail", F.desc(order))
    tail = tail.select(*(F.col(c).alias(f"_{c}") for c in by), "tail")
    return side("head", F.asc(order)).join(tail, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]).drop(*(f"_{c}" for c in by))


def argmax_rows(rows: DataFrame, by: Sequence[str], best: Column, columns: Sequence[str]) -> DataFrame:
    """Of each group the row of the largest ``best`` (a struct with its tiebreaks), combined before the shuffle."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(*columns), best).alias("r")).select(*by, *(f"r.{c}" for c in columns if c not in by))


def spaced_top(rows: DataFrame, by: Sequence[str], place: str, rank: str, k: int, apart: int) -> DataFrame:
    """Greedily the ``k`` rows of the highest ``rank`` (a tie: of the least ``place``) that lie at least ``apart`` from those taken; ``nth`` from 0.

    A round for each: the best row of every group, combined before the shuffle, of those far enough from what earlier rounds took,
    which was written. So a round's plan is as long as the first one's.
    """
    out = None
    for nth in range(k):
        left = rows
        if out is not None:
            taken = out.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.collect_list(place).alias("_taken"), F.count("*").alias("_n"))
            # Groups that had nothing left in the last round are done.
            left = rows.join(taken.where(F.col("_n") == nth), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
            left = left.where(F.forall("_taken", lambda t: F.abs(F.col(place) - t) >= apart))
        best = left.groupBy(*by).agg(F.max_by(place, F.struct(F.col(rank), -F.col(place))).alias(place))
        best = settled(best.select(*by, F.lit(nth).alias("nth"), place))
        out = best if out is None else out.unionByName(best)
    return out
