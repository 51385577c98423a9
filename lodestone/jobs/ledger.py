"""Ledgers and validation: consistency between indexes, records and references."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.jobs.registry import Registry
from lodestone.operators import records as R
from lodestone.sources import merged
from lodestone.sources.scratch import shared_folder
from lodestone.sources.tables import table

JOBS = Registry()


@JOBS.query("j15_trace_edges", "SELECT 'customer without orders' AS issue, count(*)::BIGINT AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'order without customer', count(*)::BIGINT FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'order without lines', count(*)::BIGINT FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def trace_edges(spark, sf):
    """Dangling and one-way references."""
    customers, orders, lines = (table(spark, sf, t) for t in ("customer", "orders", "lineitem"))
    counted = lambda rows, name: rows.agg(F.lit(name).alias("issue"), F.count("*").alias("n"))
    a = customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    b = orders.join(customers, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    c = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return counted(a, "customer without orders").unionByName(counted(b, "order without customer")).unionByName(counted(c, "order without lines"))


RECORDED = "(SELECT l_orderkey, CASE WHEN bool_and(l_linestatus = 'F') THEN 'F' WHEN bool_and(l_linestatus = 'O') THEN 'O' ELSE 'P' END AS recorded, count(*)::BIGINT AS n_lines FROM lineitem GROUP BY l_orderkey)"


@JOBS.query("j16_index_record", f"SELECT coalesce(o_orderkey, l_orderkey) AS record_id, o_orderstatus AS indexed, recorded, coalesce(n_lines, 0)::BIGINT AS n_lines FROM orders FULL JOIN {RECORDED} ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL OR l_orderkey IS NULL OR o_orderstatus IS DISTINCT FROM recorded")
def index_record(spark, sf):
    """The index states a status for each order; its record's lines are all finished, all open, or in progress. Where these differ, or one lacks, is drift."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("record")).agg(
        F.when(F.bool_and(F.col("l_linestatus") == "F"), "F").when(F.bool_and(F.col("l_linestatus") == "O"), "O").otherwise("P").alias("recorded"), F.count("*").alias("n_lines")
    )
    index = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("indexed"))
    drifted = R.drift(index, lines, "o_orderkey", "record", {"indexed": "recorded"})
    return drifted.select(F.coalesce("o_orderkey", "record").alias("record_id"), "indexed", "recorded", F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"))


@JOBS.query(
    "u06_upsert_by_identity",
    "SELECT 'REC-' || upper(substr(sha256(text), 1, 12)) AS record_id, min(doc_id) AS created, max(doc_id) AS updated, array_to_string(list_sort(list_distinct(list(source))), ',') AS retrievals FROM documents GROUP BY text",
)
def upsert(spark, sf):
    """Records named by a digest of their identity; a repeat adds its retrieval and moves the update, not the creation.

    Records are told apart by the whole digest. The name shows its first twelve characters, or all where two records share these.
    """
    rows = table(spark, sf, "documents").select(F.upper(F.sha2("text", 256)).alias("digest"), "doc_id", "source")
    records = rows.groupBy("digest").agg(F.min("doc_id").alias("created"), F.max("doc_id").alias("updated"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("retrievals"))
    return R.named(records, "digest", "record_id").select("record_id", "created", "updated", "retrievals")


@JOBS.query(
    "u06_ledger_merge",
    "SELECT upper(sha256(text)) AS digest, min(doc_id) AS created, max(doc_id) AS updated, array_to_string(list_sort(list_distinct(list(source))), ',') AS retrievals FROM documents GROUP BY text",
)
def ledger_merge(spark, sf):
    """Three retrievals of the documents, one of them twice, merged into a ledger that is there."""
    docs = table(spark, sf, "documents").select(F.upper(F.sha2("text", 256)).alias("digest"), F.col("doc_id").alias("created"), F.col("doc_id").alias("updated"), F.array_compact(F.array("source")).alias("retrievals"))
    merges = {"created": merged.least, "updated": merged.largest, "retrievals": merged.union}
    ledger = merged.MergedTable(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}", ["digest"], merges, buckets=16)
    for k in (2, 0, 1, 0):
        ledger.upsert(docs.where(F.pmod("created", F.lit(3)) == k), f"retrieval {k}")
    return ledger.read(docs.schema).withColumn("retrievals", F.array_join("retrievals", ","))


@JOBS.query("a32_status_rollup", "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority)::BIGINT AS level, count(*)::BIGINT AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def status_rollup(spark, sf):
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


@JOBS.query(
    "s25_inventory",
    "SELECT source, count(*)::BIGINT AS n_objects, sum(octet_length(encode(text)))::BIGINT AS n_bytes, count(DISTINCT sha256(text))::BIGINT AS n_digests, sum(n_chars)::BIGINT AS stated, sum(length(text))::BIGINT AS counted, "
    "coalesce(sum(n_chars) = sum(length(text)), false) AS total_matches FROM documents GROUP BY source",
)
def inventory(spark, sf):
    """Objects of a source: how many, their bytes and different digests; whether the total that the rows state is the one counted."""
    docs = table(spark, sf, "documents").select("source", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"), "n_chars", F.length("text").cast("long").alias("counted"))
    return docs.groupBy("source").agg(
        F.count("*").alias("n_objects"), F.sum("size").alias("n_bytes"), F.count_distinct("sha256").alias("n_digests"), F.sum("n_chars").alias("stated"), F.sum("counted").alias("counted"),
        F.coalesce(F.sum("n_chars") == F.sum("counted"), F.lit(False)).alias("total_matches"),
    )


#: The words that make a key sensitive.
SENSITIVE = "token|secret|password|credential|api[_-]?key|access[_-]?key"


@JOBS.query(
    "p20_sensitive_key_scan",
    "SELECT doc_id, key, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z_-]+) = \"', 1)) AS key FROM documents) WHERE regexp_matches(key, '(?i)" + SENSITIVE + "') GROUP BY doc_id, key",
)
def sensitive_keys(spark, sf):
    keys = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit('([A-Za-z_-]+) = "'), 1)).alias("key"))
    return keys.where(F.col("key").rlike(f"(?i){SENSITIVE}")).groupBy("doc_id", "key").agg(F.count("*").alias("n"))


@JOBS.query(
    "p21_policy_validate",
    "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END, CASE WHEN o_totalprice <= 50000 THEN 'price' END, CASE WHEN coalesce(trim(o_orderpriority), '') = '' THEN 'priority' END, "
    "CASE WHEN o_orderdate < TIMESTAMP '1993-01-01' THEN 'date' END], lambda x: x IS NOT NULL), ',') AS violations FROM orders",
)
def policy_validate(spark, sf):
    """Violations of each row as a list, never an exception."""
    rules = F.array(
        F.when(~F.col("o_orderstatus").isin("F", "O"), F.lit("status")),
        F.when(F.col("o_totalprice") <= 50000, F.lit("price")),
        F.when(F.coalesce(F.trim("o_orderpriority"), F.lit("")) == "", F.lit("priority")),
        F.when(F.col("o_orderdate") < F.to_timestamp_ntz(F.lit("1993-01-01 00:00:00")), F.lit("date")),
    )
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(F.filter(rules, lambda x: x.isNotNull()), ",").alias("violations"))


@JOBS.query(
    "s17_device_table",
    "SELECT l_orderkey, count(*) FILTER (WHERE l_quantity >= 5)::BIGINT AS n_busy, count(*) FILTER (WHERE l_quantity >= 5) = 0 AS available, coalesce(max(l_partkey + 1) FILTER (WHERE l_quantity >= 5), 0)::BIGINT AS last_pid, "
    "count(*)::BIGINT AS n_listed FROM lineitem GROUP BY l_orderkey",
)
def device_table(spark, sf):
    """Process rows of device reports, a report for each order's lines: a pipe table, in which a pid of 0 is an idle device, and a CSV listing."""
    pid = F.when(F.col("l_quantity") < 5, 0).otherwise(F.col("l_partkey") + 1)
    piped = F.concat(F.lit("| "), F.col("l_linenumber").cast("string"), F.lit("  0   | "), pid.cast("string"), F.lit("   | proc "), F.col("l_linestatus"), F.lit("  | "))
    listed = F.concat(F.col("l_partkey").cast("string"), F.lit(", proc"))
    reports = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.concat(F.lit("+---+\n| devices |\n"), F.array_join(F.collect_list(piped), "\n"), F.lit("\n+---+")).alias("report"), F.array_join(F.collect_list(listed), "\n").alias("listing")
    )
    found = reports.select("l_orderkey", F.explode(F.array(X.device_processes(F.col("report")))).alias("found"), "listing")
    return found.select(
        "l_orderkey", F.size("found").cast("long").alias("n_busy"), (F.size("found") == 0).alias("available"), F.coalesce(F.array_max(F.transform("found", lambda x: x["pid"])), F.lit(0).cast("long")).alias("last_pid"),
        F.size(F.filter(X.csv_processes(F.col("listing")), lambda x: x["pid"].isNotNull())).cast("long").alias("n_listed"),
    )


CELLS = "(SELECT vec_id, [floor(x::DOUBLE * 1000000) FOR x IN embedding[1:16]] AS m FROM embeddings)"


@JOBS.query(
    "s11_matrix_text",
    f"SELECT vec_id, m[1] AS fx, m[2] AS fy, m[3] AS cx, m[4] AS cy, [m[4], m[8], m[12]]::VARCHAR AS shift, m[1] + m[6] + m[11] + m[16] AS trace FROM {CELLS}",
)
def matrix_text(spark, sf):
    """Texts of four lines of numbers as a 4x4 matrix, and of their first four as intrinsics; the texts are the vectors' leading numbers."""
    micro = F.transform(F.slice("embedding", 1, 16), lambda x: F.floor(x.cast("double") * 1000000).cast("string"))
    lines = F.concat_ws("\n", *(F.concat_ws("  ", F.slice("m", 4 * r + 1, 4)) for r in range(4)))
    texts = table(spark, sf, "embeddings").select("vec_id", micro.alias("m")).select("vec_id", lines.alias("text"))
    cells = texts.select("vec_id", F.explode(F.array(X.numbers(F.col("text")))).alias("m")).where(F.size("m") == 16)
    k = X.intrinsics(F.col("m"))
    at = lambda i: F.get("m", F.lit(i))
    shift = F.concat(F.lit("["), F.array_join(F.transform(F.array(at(3), at(7), at(11)), lambda x: x.cast("string")), ", "), F.lit("]"))
    return cells.select("vec_id", F.get(k, F.lit(0)).alias("fx"), F.get(k, F.lit(4)).alias("fy"), F.get(k, F.lit(2)).alias("cx"), F.get(k, F.lit(5)).alias("cy"), shift.alias("shift"), (at(0) + at(5) + at(10) + at(15)).alias("trace"))


@JOBS.query("f11_local_time", "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS local, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS utc FROM events")
def local_time(spark, sf):
    return table(spark, sf, "events").select("event_id", X.local_time(F.col("ts"), 8).alias("local"), X.local_time(F.col("ts"), 0).alias("utc"))


@JOBS.query("p18_column_slim", "SELECT l_returnflag AS scene, l_partkey AS instance_id, count(*)::BIGINT AS n_observations, max(l_quantity) AS tallest FROM lineitem GROUP BY ALL")
def column_slim(spark, sf):
    """Entities with their figures; the heavy nested observations are left out, and never gathered, as nothing asks for them."""
    line = table(spark, sf, "lineitem")
    whole = line.groupBy(F.col("l_returnflag").alias("scene"), F.col("l_partkey").alias("instance_id")).agg(
        F.count("*").alias("n_observations"), F.max("l_quantity").alias("tallest"), F.collect_list(F.struct(*line.columns)).alias("observations")
    )
    return whole.drop("observations")
