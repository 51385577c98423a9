"""Whole tables in one order, range by range: numbers, ranks, frames by value, and joins with the last row before.

No group has to fit into a task: rows are dealt over ranges of group and order, and what
the ranges before hold of a group is carried over their borders. Only a row for each group and range meets in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.sources.scratch import settled


def _same(by: Sequence[str], prefix: str = "_by_") -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in by]


#: Tables that the optimiser knows to be of no more bytes are numbered by one task at once, which needs no ranges and no written table.
SMALL = 4 << 20


def known_size(rows: DataFrame) -> int:
    """What the plan's statistics say of the bytes, without running anything: of files their size, of a written table without any more than all."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def in_order(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with ``_part`` and ``_at``, which grow in the order of group and ``order`` (nulls first), written once.

    Rows that are equal in both lie in one range.
    """
    places = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    held = rows.repartitionByRange(*places).sortWithinPartitions(*places).withColumn("_at", F.monotonically_increasing_id())
    return settled(held).withColumn("_part", F.shiftright("_at", 33))


def numbered(rows: DataFrame, by: Sequence[str], order: str, weight: str | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``_nth``, the rows (or the sum of ``weight``) before a row in its group, and ``_size``, those of the group.

    Rows of equal ``order`` and ``tie`` come in any order: what depends on a row's number needs an order without ties.
    """
    n = F.sum(weight) if weight else F.count("*")
    if known_size(rows) <= SMALL:
        group = Window.partitionBy(*by)
        before = n.over(group.orderBy(*(F.col(c).asc_nulls_first() for c in (order, *tie))).rowsBetween(Window.unboundedPreceding, -1))
        return rows.withColumns({"_nth": F.coalesce(before, F.lit(0)), "_size": n.over(group)})
    held = in_order(rows, by, [order, *tie])
    runs = held.groupBy(*by, "_part").agg(n.alias("_held"), F.min("_at").alias("_first"))
    every = Window.partitionBy(*by)
    earlier = F.coalesce(F.sum("_held").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(
        *(F.col(c).alias(f"_by_{c}") for c in by), F.col("_part").alias("_of"), "_first", earlier.alias("_earlier"), F.sum("_held").over(every).alias("_size")
    )
    if weight:
        own = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        held = held.withColumn("_own", F.coalesce(F.sum(weight).over(own), F.lit(0)))
    out = held.join(runs, [*_same(by), F.col("_part") == F.col("_of")])
    before = F.col("_own") if weight else F.col("_at") - F.col("_first")
    out = out.withColumn("_nth", before + F.col("_earlier"))
    if not weight or dict(rows.dtypes)[weight] in ("int", "bigint"):
        out = out.withColumn("_nth", F.col("_nth").cast("long"))
    return out.select(*rows.columns, "_nth", "_size")


def as_of(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], *, tie: Sequence[str] = (), strict: bool = False, within: Column | None = None
) -> DataFrame:
    """``left`` with ``values`` of the row of ``right`` that has the same ``by`` and the last ``right_time`` at or before (``strict``: before) ``left_time``.

    Of several at that time the last in the order of ``tie`` counts. A left row without such a row has nulls; null keys and times meet nothing.
    ``within`` is the longest time between both, where there is one. A key may hold any number of rows: both sides lie in one order that is cut into ranges, and
    a range's last row is carried to the next ones.
    """
    names = {c: f"_left_{k}" for k, c in enumerate(left.columns)}
    known = right.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*by, right_time)))
    value = F.struct(F.col(right_time).alias("_time"), *values)
    a = left.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), *(F.col(f"`{c}`").alias(f"_key_{k}") for k, c in enumerate(by)), F.col(f"`{left_time}`").alias("_when"), F.lit(int(not strict)).alias("_side"))
    b = known.select(*(F.col(f"`{c}`").alias(f"_key_{k}") for k, c in enumerate(by)), F.col(right_time).alias("_when"), F.lit(int(strict)).alias("_side"), *(F.col(c).alias(f"_tie_{k}") for k, c in enumerate(tie)), value.alias("_right"))
    keys, ties = [f"_key_{k}" for k in range(len(by))], [f"_tie_{k}" for k in range(len(tie))]
    held = in_order(a.unionByName(b, allowMissingColumns=True), keys, ["_when", "_side", *ties])
    so_far = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    met = held.withColumn("_near", F.last("_right", ignorenulls=True).over(so_far)).where(F.col("_side") == int(not strict))
    # Keys that lie in several ranges: no more than there are borders.
    ends = held.groupBy(*keys, "_part").agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.col("_at"))).alias("_last"))
    every = Window.partitionBy(*keys)
    ends = ends.withColumn("_parts", F.count("*").over(every)).where("_parts > 1")
    carried = F.last("_last", ignorenulls=True).over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*(F.col(c).alias(f"_by_{c}") for c in keys), F.col("_part").alias("_of"), carried.alias("_carried"))
    out = met.join(F.broadcast(ends), [*_same(keys), F.col("_part") == F.col("_of")], "left")  # two rows for each border of ranges at most
    near = F.coalesce("_near", "_carried")
    if within is not None:
        near = F.when(F.col("_when") - near["_time"] <= within, near)
    return out.withColumn("_found", near).select(*(F.col(n).alias(c) for c, n in names.items()), *(F.col("_found")[c].alias(c) for c in values))


def ranks(rows: DataFrame, by: Sequence[str], order: str, *, tie: Sequence[str], tiles: int) -> DataFrame:
    """``rows`` with ``row_number`` (ties by ``tie``), ``rank``, ``dense_rank`` and ``ntile`` of ``tiles`` in the order of each group."""
    placed = numbered(rows, by, order, tie=tie)
    values = placed.groupBy(*by, order).agg(F.min("_nth").alias("_before"))
    values = numbered(values, by, order).select(*(F.col(c).alias(f"_by_{c}") for c in (*by, order)), "_before", F.col("_nth").alias("_values"))
    out = placed.join(values, _same([*by, order]))
    # The first ``_size % tiles`` tiles have one row more.
    small, more = F.floor(F.col("_size") / tiles), F.col("_size") % tiles
    late = F.col("_nth") - more * (small + 1)
    tile = F.when(late < 0, F.floor(F.col("_nth") / (small + 1))).otherwise(more + F.floor(late / F.greatest(small, F.lit(1))))
    return out.select(
        *rows.columns,
        (F.col("_nth") + 1).alias("row_number"),
        (F.col("_before") + 1).alias("rank"),
        (F.col("_values") + 1).alias("dense_rank"),
        (tile + 1).cast("long").alias("ntile"),
    )


def range_sums(rows: DataFrame, by: Sequence[str], order: str, value: str, width: Column) -> DataFrame:
    """``by, order, n, total``: for each value of ``order`` in a group, the rows from ``width`` before it up to it (both included), and the sum of their ``value``.

    A frame is what lies before its end without what lies before its start, which is found by an as-of join; null orders are left out.
    """
    each = rows.where(F.col(order).isNotNull()).groupBy(*by, order).agg(F.count("*").alias("_n"), F.sum(value).alias("_sum"))
    each = each.withColumn("_sum", F.coalesce(F.col("_sum").cast("double"), F.lit(0.0)))
    held = in_order(each, by, [order])
    runs = held.groupBy(*by, "_part").agg(F.sum("_n").alias("_held"), F.sum("_sum").alias("_held_sum"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    runs = runs.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_part").alias("_of"), none("_held", before).alias("_e"), none("_held_sum", before).alias("_es"))
    own = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    sums = held.withColumns({"_o": F.sum("_n").over(own), "_os": F.sum("_sum").over(own)}).join(runs, [*_same(by), F.col("_part") == F.col("_of")])
    # Groups are named by strings of their keys, so that a null one meets itself.
    name = F.to_json(F.struct(F.lit(1).alias("_"), *by))
    sums = settled(sums.select(*by, order, name.alias("_group"), (F.col("_o") + F.col("_e")).alias("_upto"), (F.col("_os") + F.col("_es")).alias("_total")))
    starts = sums.withColumn("_start", F.col(order) - width)
    past = sums.select("_group", order, F.col("_upto").alias("_gone"), F.col("_total").alias("_gone_total"))
    out = as_of(starts, past, ["_group"], "_start", order, ["_gone", "_gone_total"], strict=True)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(*by, order, (F.col("_upto") - zero("_gone")).cast("long").alias("n"), (F.col("_total") - zero("_gone_total")).alias("total"))
