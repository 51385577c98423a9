"""Sharding on a consistent-hash ring with virtual nodes and bounded loads; DataFrame functions only.

The ring is cut into a fixed number of cells; a document's cell is a hash of
its key. Every shard stands on the ring at ``virtual`` places. A cell goes to
the next shard clockwise that still has room for it: no shard takes more than
``1 + slack`` times the mean load, so that sizes are nearly equal, and what a
full shard can't take continues to the next one. A shard's places don't depend
on the number of shards, so that one shard more moves little but what it takes.

Only the cells' sums, a table of fixed size, meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import settle, text_key

CELLS = 8192


def _preferences(session, shards: int, virtual: int) -> DataFrame:
    """For each cell, the shards in the order in which one meets them clockwise."""
    # A shard's places are hashes of its number and the replica's, so that they stay where they are when the count grows.
    nodes = session.range(shards * virtual).select(F.floor(F.col("id") / virtual).cast("int").alias("shard"), F.pmod("id", F.lit(virtual)).alias("replica"))
    nodes = nodes.select("shard", F.pmod(F.xxhash64(F.lit("node"), "shard", "replica"), F.lit(CELLS)).cast("int").alias("at"))
    ring = nodes.agg(F.array_sort(F.collect_list(F.struct("at", F.xxhash64("at", "shard").alias("tie"), "shard"))).getField("shard").alias("ring"))
    # How many places lie before each cell: the ring's later part comes first, then the part before.
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = session.range(CELLS).select(F.col("id").cast("int").alias("cell"))
    cells = cells.join(F.broadcast(nodes.groupBy("at").count()), F.col("cell") == F.col("at"), "left")
    cells = cells.select("cell", F.coalesce(F.sum("count").over(before), F.lit(0)).cast("int").alias("before")).repartition(16, "cell")
    turned = F.concat(F.slice("ring", F.col("before") + 1, F.lit(shards * virtual)), F.slice("ring", F.lit(1), F.col("before")))
    return cells.join(F.broadcast(ring)).select("cell", F.array_distinct(turned).alias("order"))  # one row, shards * virtual places


def _placed(cells: DataFrame, shards: int, slack: float) -> DataFrame:
    """``cell, shard``: a fold over the cells, the heaviest first, that keeps the shards' loads."""
    one = cells.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("load")).alias("rank"), "cell", "load", "order"))).alias("all"),
        F.ceil(F.sum("load") * F.lit(1 + slack) / F.lit(shards)).alias("limit"),
    )
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("out"))

    def place(state: Column, c: Column) -> Column:
        room = F.filter(c["order"], lambda s: F.get(state["loads"], s) + c["load"] <= F.col("limit"))
        # A cell that fits nowhere goes to the least loaded shard, which is at most the mean before.
        least = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        return F.struct(state["loads"].alias("loads"), state["out"].alias("out"), F.coalesce(F.get(room, F.lit(0)), least).alias("to"), c["load"].alias("load"))

    def put(state: Column, c: Column) -> Column:
        # A one-element transform names the choice, so that it is made once.
        chosen = F.transform(F.array(place(state, c)), lambda x: F.struct(
            F.transform(x["loads"], lambda load, i: F.when(i == x["to"], load + x["load"]).otherwise(load)).alias("loads"),
            F.concat(x["out"], F.array(x["to"])).alias("out"),
        ))
        return F.get(chosen, F.lit(0))

    folded = one.select("all", F.aggregate("all", start, put, lambda s: s["out"]).alias("out"))
    return folded.select(F.explode(F.arrays_zip("all", "out")).alias("x")).select(F.col("x.all.cell").alias("cell"), F.col("x.out").alias("shard"))


def assign(docs: DataFrame, *, shards: int = 40, virtual: int = 64, slack: float = 0.0005) -> DataFrame:
    """Each row's ``doc_id, size, text_crc32, shard, slot``.

    ``size`` is the text's UTF-8 bytes (null: none) plus 16. Loads are bytes: a shard
    takes at most ``1 + slack`` times the mean, or, where nothing fits, at most
    the mean and one cell. ``slot`` counts a shard's rows from 0 without gaps. The
    key is doc_id and text: equal texts of several doc_ids are dealt over the
    shards, as one text may be a third of all rows and no shard could take it. Equal rows share a cell and
    have slots side by side. With no rows the result is empty.
    """
    session = docs.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = settle(docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.xxhash64("doc_id", text_key(F.col("text"))).alias("draw"),
    ).withColumn("cell", F.pmod(F.xxhash64(F.lit("cell"), "draw"), F.lit(CELLS)).cast("int")))
    sums = rows.groupBy("cell").agg(F.sum("size").alias("load"), F.count("*").alias("n"))
    cells = _preferences(session, shards, virtual).join(F.broadcast(sums), "cell", "left").na.fill(0, ["load", "n"])  # at most CELLS rows
    cells = settle(cells)
    placed = _placed(cells, shards, slack).join(F.broadcast(cells.select("cell", "n")), "cell")
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    table = settle(placed.select(F.col("cell").alias("_cell"), "shard", "base"))
    order = Window.partitionBy("cell").orderBy("draw", "doc_id", "text_crc32", "size")
    return (
        rows.withColumn("nth", F.row_number().over(order) - 1)
        .join(F.broadcast(table), F.col("cell") == F.col("_cell"))  # CELLS rows
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("nth")).cast("long").alias("slot"))
    )


def digest(assigned: DataFrame) -> DataFrame:
    return assigned.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
