"""Boxes that hide each other, in views of any number of boxes.

In a small view all pairs are compared. In a crowded one boxes are dealt over buckets of both axes at widths of their own size (see
``intervals``), so that only boxes that meet become pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.measures import coverage_ratio
from lodestone.operators.intervals import overlaps
from lodestone.operators.ordered import known_size

#: Boxes of a view from which on it is crowded, and parts of a unit that the ends of boxes are rounded out to.
CROWDED, GRAIN = 512, 1024


def hidden(boxes: DataFrame, view: Sequence[str], box: Sequence[str], entity: str, depth: str, *, crowded: int = CROWDED) -> DataFrame:
    """``boxes`` with ``occlusion``, the largest share of a box that a strictly nearer box of another entity covers in its view, 0 where none does.

    ``boxes`` have ``x0, y0, x1, y1``; ``view`` and ``box`` name a box. A null entity, depth or view hides nothing.
    """
    many = boxes.groupBy(*view).count().where(F.col("count") > crowded).select(*(F.col(c).alias(f"_{c}") for c in view))
    in_view = [F.col(c) == F.col(f"_{c}") for c in view]
    if not many.limit(1).count():
        return _all_pairs(boxes, view, box, entity, depth)
    return _all_pairs(boxes.join(many, in_view, "left_anti"), view, box, entity, depth).unionByName(_dealt(boxes.join(many, in_view, "left_semi"), view, box, entity, depth))


def _renamed(boxes: DataFrame, view: Sequence[str], entity: str, depth: str) -> DataFrame:
    return boxes.select(*(F.col(c).alias(f"_n_{c}") for c in (*view, entity, depth, "x0", "y0", "x1", "y1")))


def _ratio():
    return F.round(coverage_ratio([F.col(c) for c in ("x0", "y0", "x1", "y1")], [F.col(f"_n_{c}") for c in ("x0", "y0", "x1", "y1")]), 9)


def _all_pairs(boxes: DataFrame, view: Sequence[str], box: Sequence[str], entity: str, depth: str) -> DataFrame:
    same = [F.col(c) == F.col(f"_n_{c}") for c in view]
    pairs = boxes.join(_renamed(boxes, view, entity, depth), [*same, F.col(entity) != F.col(f"_n_{entity}"), F.col(f"_n_{depth}") < F.col(depth)], "left")
    ratio = F.when(F.col(f"_n_{view[0]}").isNotNull(), _ratio())
    return pairs.groupBy(*view, *box).agg(F.coalesce(F.max(ratio), F.lit(0.0)).alias("occlusion"))


def _dealt(boxes: DataFrame, view: Sequence[str], box: Sequence[str], entity: str, depth: str) -> DataFrame:
    ends = lambda p: {f"{p}{axis}{k}": (F.floor if k == 0 else F.ceil)(F.col(f"{p}{axis}{k}") * GRAIN).cast("long") for axis in "xy" for k in (0, 1)}
    own = boxes.withColumns({f"_i_{c}": e for c, e in ends("").items()})
    near = _renamed(boxes, view, entity, depth)
    near = near.withColumns({f"_j_{c[3:]}": e for c, e in ends("_n_").items()})
    # Of the two axes the one whose boxes are shorter, against their whole extent, parts them better.
    x, y = boxes.select(*(F.avg(F.col(f"{a}1") - F.col(f"{a}0")) / (F.max(f"{a}1") - F.min(f"{a}0")) for a in "xy")).first()
    axis = "x" if y is None or (x is not None and x <= y) else "y"
    pairs = overlaps(own, near, (f"_i_{axis}0", f"_i_{axis}1"), (f"_j_{axis}0", f"_j_{axis}1"), [(c, f"_n_{c}") for c in view])
    pairs = pairs.where((F.col(entity) != F.col(f"_n_{entity}")) & (F.col(f"_n_{depth}") < F.col(depth)))
    most = pairs.groupBy(*view, *box).agg(F.max(_ratio()).alias("_most"))
    most = most.select(*(F.col(c).alias(f"_of_{c}") for c in (*view, *box)), "_most")
    out = boxes.join(most, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*view, *box)], "left")
    return out.groupBy(*view, *box).agg(F.coalesce(F.max("_most"), F.lit(0.0)).alias("occlusion"))


#: What the plan's statistics say of a task's share, of some half a million rows; parts that a view's depths and entities are dealt over.
SHARE, DEALT = 1 << 20, 64


def _tasks(rows: DataFrame) -> int:
    """Tasks that grow with the files behind ``rows``; as many as any shuffle has, where nothing is known of them."""
    least, size = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), known_size(rows)
    return least if size > 1 << 50 else max(least, -(-size // SHARE))


def nearer_pairs(boxes: DataFrame, view: Sequence[str], entity: str, depth: str) -> DataFrame:
    """``view, n_pairs, n_nearer, n_level``: of the ordered pairs of different entities in a view, those whose second is strictly nearer, and those of equal depth.

    Sizes of groups give them: no pair is made. Of what isn't level, half is nearer. Rows with a null are left out. Boxes travel once by their depth and once by
    their entity, dealt so that a crowded view takes many tasks; these are as many as the input asks for, and a task holds no more groups than before when it grows.
    """
    known = boxes.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*view, entity, depth))).select(*view, entity, depth)
    tasks = _tasks(known)
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(DEALT)).cast("int")
    level = F.when(F.col(depth) == 0, F.lit(0).cast(boxes.schema[depth].dataType)).otherwise(F.col(depth))  # one zero of both signs
    both = F.array(F.struct(F.lit(True).alias("by_depth"), part(level).alias("part")), F.struct(F.lit(False).alias("by_depth"), part(F.col(entity)).alias("part")))
    dealt = known.withColumn("_s", F.explode(both)).select(*view, F.col("_s.by_depth").alias("_by_depth"), F.col("_s.part").alias("_part"), F.when(F.col("_s.by_depth"), level).alias("_depth"), F.col(entity).alias("_entity"))
    held = [*view, "_by_depth", "_part"]
    cells = dealt.repartition(tasks, *held).groupBy(*held, "_depth", "_entity").agg(F.count("*").alias("n"))
    square = lambda c: F.sum(F.col(c) * F.col(c))
    groups = cells.groupBy(*held, "_depth", F.when(~F.col("_by_depth"), F.col("_entity")).alias("_entity")).agg(F.sum("n").alias("n"), square("n").alias("own"))
    parts = groups.groupBy(*held).agg(F.sum("n").alias("n"), square("n").alias("square"), F.sum("own").alias("own"))
    by_depth = lambda c: F.sum(F.when(F.col("_by_depth"), c))
    views = parts.repartition(tasks, *view).groupBy(*view).agg(
        by_depth(F.col("n")).alias("n"), by_depth(F.col("square") - F.col("own")).alias("n_level"), F.sum(F.when(~F.col("_by_depth"), F.col("square"))).alias("own")
    )
    pairs = F.col("n") * F.col("n") - F.col("own")
    return views.select(*view, pairs.alias("n_pairs"), F.floor((pairs - F.col("n_level")) / 2).alias("n_nearer"), "n_level").where("n_pairs > 0")
