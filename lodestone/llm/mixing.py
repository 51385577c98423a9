"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are aggregated by the set of sources that they belong to. The flow
network leads from every pattern, once per repetition (the first at cost 0,
each further one dearer: convex), to its sources and their quotas. Documents
are then taken in the order of a seeded hash until the pattern's flow is used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.llm.common import fresh, settle, text_key

#: The seeded hash's leading bits that cut a pattern's documents into bins.
BIN_BITS = 12
#: Pairs of a pattern and a source that the flow network may hold on the driver.
MAX_ARCS = 1_000_000


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quotas(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """``total`` by weight, none above ``most`` times its size, the excess reshared by weight."""
    target, free, left = {}, set(sizes), float(total)
    while free:
        unit = left / w if (w := sum(weights[s] for s in free)) else 0.0
        full = {s for s in free if weights[s] * unit > most * sizes[s]}
        if not full:
            return target | {s: weights[s] * unit for s in free}
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= full
    return target


def min_cost_flow(supply: dict[tuple, int], demand: dict, costs: Sequence[float]) -> dict[tuple, int]:
    """Words that flow from each (pattern, source): a cheapest flow among the largest.

    ``costs`` are those of the first, second, ... use of a word. Only the way
    into a pattern costs anything, the same for all patterns. So the first uses
    are filled as far as they go, then the second ones on top of them, each
    a largest flow by shortest ways, all of one length at a time; later ways may
    take back what an earlier one gave a source.
    """
    patterns = sorted(supply, key=lambda p: [(s is None, s or "") for s in p])
    sources = {s: 1 + len(patterns) + k for k, s in enumerate(demand)}
    start, end = 0, 1 + len(patterns) + len(sources)
    arcs: list[list[int]] = [[] for _ in range(end + 1)]  # of each node; an arc's reverse is its number xor 1
    to: list[int] = []
    room: list[int] = []

    def arc(a: int, b: int, most: int) -> int:
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((most, 0))
        return len(to) - 2

    into = [arc(start, 1 + k, 0) for k in range(len(patterns))]
    used = {(p, s): arc(1 + k, sources[s], supply[p] * len(costs)) for k, p in enumerate(patterns) for s in p if s in sources}
    for s, q in demand.items():
        arc(sources[s], end, q)

    def distances() -> list[int]:
        far = [-1] * (end + 1)
        far[start], layer = 0, [start]
        while layer and far[end] < 0:
            after = []
            for a in layer:
                for k in arcs[a]:
                    if room[k] and far[to[k]] < 0:
                        far[to[k]] = far[a] + 1
                        after.append(to[k])
            layer = after
        return far

    for _ in costs:
        for k, p in enumerate(patterns):
            room[into[k]] += supply[p]
        while (far := distances())[end] >= 0:
            at, way = [0] * (end + 1), []
            while True:
                a = to[way[-1]] if way else start
                if a == end:
                    most = min(room[k] for k in way)
                    for k in way:
                        room[k] -= most
                        room[k ^ 1] += most
                    way = way[: next(i for i, k in enumerate(way) if not room[k])]
                    continue
                while at[a] < len(arcs[a]) and not (room[k := arcs[a][at[a]]] and far[to[k]] == far[a] + 1):
                    at[a] += 1
                if at[a] < len(arcs[a]):
                    way.append(arcs[a][at[a]])
                elif way:
                    at[to[way.pop() ^ 1]] += 1
                else:
                    break
    return {x: room[k ^ 1] for x, k in used.items() if room[k ^ 1]}


def mix(
    docs: DataFrame,
    members: Column,
    *,
    weigh,
    share: float = 1.5,
    max_copies: int = 2,
    repeat_costs: Sequence[float] = (0.0, 1.0),
    seed: int = 7,
) -> DataFrame:
    """How often the mix takes each document.

    ``members`` is the array of a row's sources (strings; a null entry is a
    source); ``weigh`` maps the list of sources, sorted by code point, null
    last, to their weights. Sizes are word counts; the mix is ``share`` of all
    of them (each word counted once), a source's target at most ``max_copies``
    times its size.

    Returns ``doc_id, text_key, size, pattern, copies, taken`` (``taken`` is
    ``copies * size``) and its sources' ``sizes`` and ``targets``. Rows without
    sources or words are taken 0 times. Equal rows are separate documents. Reruns
    agree: the order is a hash of seed and doc_id (of seed and text where that is
    null), ties by text. More than ``MAX_ARCS`` pairs of a pattern and a source
    raise an error; the number of documents has no bound.
    """
    if len(repeat_costs) != max_copies or list(repeat_costs) != sorted(repeat_costs):
        raise ValueError("repeat_costs needs max_copies rising costs")
    rows = settle(docs.select(
        "doc_id",
        text_key(F.col("text")).alias("text_key"),
        word_count(F.col("text")).alias("size"),
        F.array_sort(F.array_distinct(members.cast("array<string>"))).alias("pattern"),
    ).withColumn("draw", _draw(seed)))
    supply = {
        tuple(r["pattern"] or ()): int(r["size"])
        for r in rows.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_ARCS + 1).collect()
    }
    if sum(map(len, supply)) > MAX_ARCS:
        raise ValueError(f"more than {MAX_ARCS} pairs of a pattern and a source")
    sizes: dict = {}
    for pattern, words in supply.items():
        for s in pattern:
            sizes[s] = sizes.get(s, 0) + words
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = dict(zip(names, weigh(names), strict=True))
    target = quotas(sizes, weights, share * sum(supply.values()), max_copies)
    flow = min_cost_flow(supply, {s: round(t) for s, t in target.items()}, repeat_costs)
    quota: dict[tuple, int] = {}
    for (pattern, _), words in flow.items():
        quota[pattern] = quota.get(pattern, 0) + words

    session = docs.sparkSession
    plan = [(list(p) or None, int(q // supply[p]), int(q % supply[p])) for p, q in quota.items() if supply[p]]
    kind = T.StructType([T.StructField("_pattern", T.ArrayType(T.StringType())), T.StructField("whole", T.LongType()), T.StructField("rest", T.LongType())])
    plan = F.broadcast(session.createDataFrame(plan, kind))  # MAX_ARCS bounds it
    drawn = (
        rows.join(plan, F.col("pattern").eqNullSafe(F.col("_pattern")), "left")
        .drop("_pattern")
        .withColumn("bin", F.shiftright("draw", 60 - BIN_BITS))
    )
    # A pattern may hold a third of all rows: its bins are summed first, and only the bin where the quota ends is put in order.
    bins = drawn.where("rest > 0").groupBy("pattern", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    before = Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    last = bins.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    last = F.broadcast(last.select(F.col("pattern").alias("_pattern"), F.col("bin").alias("last_bin"), "before"))  # a row for each pattern at most
    drawn = drawn.join(last, F.col("pattern").eqNullSafe(F.col("_pattern")), "left").drop("_pattern")
    at_end = F.col("bin").eqNullSafe(F.col("last_bin")) & (F.col("rest") > 0) & (F.col("size") > 0)
    order = Window.partitionBy("pattern", "bin").orderBy("draw", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = drawn.where(at_end).withColumn("more", ((F.col("before") + F.sum("size").over(order)) <= F.col("rest")).cast("long"))
    others = drawn.where(~at_end).withColumn(
        "more", (F.coalesce("rest", F.lit(0).cast("long")) > 0).cast("long") * F.coalesce((F.col("bin") < F.col("last_bin")).cast("long"), F.lit(1).cast("long"))
    )
    copies = F.when(F.col("size") > 0, F.coalesce("whole", F.lit(0).cast("long")) + F.col("more")).otherwise(F.lit(0).cast("long"))
    return (
        ordered.unionByName(others)
        .select("doc_id", "text_key", "size", "pattern", copies.alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .withColumns({"sizes": _lookup(sizes, "pattern"), "targets": _lookup(target, "pattern")})
    )


def _draw(seed: int) -> Column:
    """60 bits of an MD5 of seed and doc_id; rows without a doc_id are drawn by their texts."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("text_key").cast("string")))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, 15), 16, 10).cast("long")


def _lookup(values: dict, pattern: str) -> Column:
    """The values of a pattern's sources, in its order."""
    named = [k for k in values if k is not None]
    table = F.create_map(*(F.lit(x) for k in named for x in (k, float(values[k])))) if named else F.create_map().cast("map<string,double>")
    none = F.lit(float(values[None])) if None in values else F.lit(None).cast("double")
    return F.transform(pattern, lambda s: F.when(s.isNull(), none).otherwise(F.element_at(table, s)))


def contract_weights(names: list) -> list[int]:
    return [(3, 1, 2)[k % 3] for k in range(len(names))]


def by_source(docs: DataFrame, source: str = "source", **options) -> DataFrame:
    return mix(docs, F.array(F.col(source)), weigh=contract_weights, **options)


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select(
        "doc_id",
        "size",
        F.element_at("sizes", 1).cast("long").alias("source_size"),
        F.element_at("targets", 1).alias("target"),
        "taken",
        "copies",
    )


def repeated(docs: DataFrame, *, source: str = "source", **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns.

    Rows that are equal in doc_id, text and source share what they are taken
    together: each as often as all of them, the first few once more. They are
    numbered by the partitions that hold them, so that no task gets them all.
    """
    names = {k: fresh(k, docs.columns) for k in ("id", "key", "source", "copies", "rows", "part", "at", "nth", "before", "held", "of_id", "of_key", "of_source", "of_part")}
    c = {k: F.col(f"`{v}`") for k, v in names.items()}
    taken = by_source(docs, source, **options).select(
        F.col("doc_id").alias(names["id"]), F.col("text_key").alias(names["key"]), F.element_at("pattern", 1).alias(names["source"]), F.col("copies").alias(names["copies"])
    )
    same_row = [names[k] for k in ("id", "key", "source")]
    taken = taken.groupBy(*same_row).agg(F.sum(c["copies"]).alias(names["copies"]), F.count("*").alias(names["rows"])).where(c["copies"] > 0)
    taken = settle(taken)
    same = docs["doc_id"].eqNullSafe(taken[names["id"]]) & (text_key(docs["text"]) == taken[names["key"]]) & docs[source].cast("string").eqNullSafe(taken[names["source"]])
    joined = docs.join(taken, same)
    plain = [F.col(f"`{x}`") for x in docs.columns]
    one = joined.where(c["rows"] == 1).select(*(docs[x] for x in docs.columns), c["copies"].cast("int").alias(names["copies"]))
    emitted = lambda rows: rows.select(*plain, F.explode(F.sequence(F.lit(1), c["copies"])).alias(names["nth"])).drop(names["nth"])
    if not taken.where(c["rows"] > 1).limit(1).count():  # no rows are equal
        return emitted(one)
    many = joined.where(c["rows"] > 1).withColumns({names["part"]: F.spark_partition_id(), names["at"]: F.monotonically_increasing_id()})
    many = settle(many)
    held = many.groupBy(*same_row, names["part"]).agg(F.count("*").alias(names["held"]))
    before = F.coalesce(F.sum(c["held"]).over(Window.partitionBy(*same_row).orderBy(names["part"]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(*(c[k].alias(names[f"of_{k}"]) for k in ("id", "key", "source", "part")), before.alias(names["before"]))
    here = c["id"].eqNullSafe(c["of_id"]) & (c["key"] == c["of_key"]) & c["source"].eqNullSafe(c["of_source"]) & (c["part"] == c["of_part"])
    own = F.row_number().over(Window.partitionBy(*same_row, names["part"]).orderBy(names["at"])) - 1
    many = many.withColumn(names["nth"], own).join(held, here)
    extra = (c["before"] + c["nth"] < F.pmod(c["copies"], c["rows"])).cast("long")
    many = many.select(*plain, (F.floor(c["copies"] / c["rows"]) + extra).cast("int").alias(names["copies"])).where(c["copies"] > 0)
    return emitted(one.unionByName(many))


ORACLE = """
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5('7:' || doc_id), 1, 15))::BIGINT AS draw FROM documents),
sources AS (
  SELECT source, sum(size) AS n, (ARRAY[3, 1, 2])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM docs GROUP BY source),
filled AS (  -- sources fill up in the order of capacity to weight
  SELECT *, sum(2 * n) OVER w - 2 * n AS full_before, sum(weight) OVER () - (sum(weight) OVER w - weight) AS weight_left,
         1.5 * sum(n) OVER () AS total, row_number() OVER w AS place
  FROM sources WINDOW w AS (ORDER BY 2 * n / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (
  SELECT arg_min((total - full_before) / weight_left, place) FILTER (WHERE (total - full_before) / weight_left * weight <= 2 * n) AS unit FROM filled),
targets AS (
  SELECT source, n, least(2 * n, coalesce(weight * unit, 2 * n))::DOUBLE AS target FROM filled, level),
quota AS (
  SELECT *, least(round_even(target, 0)::BIGINT, 2 * n::BIGINT) AS q FROM targets),
ranked AS (
  SELECT d.doc_id, d.size, t.n, t.target, CASE WHEN t.n > 0 THEN q // t.n::BIGINT ELSE 0 END AS whole,
         CASE WHEN t.n > 0 THEN q % t.n::BIGINT ELSE 0 END AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM docs d JOIN quota t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, n::BIGINT AS source_size, target,
       (size * copies)::BIGINT AS taken, copies::BIGINT AS copies
FROM (SELECT *, CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END END AS copies FROM ranked)
"""
