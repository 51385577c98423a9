"""Readers and writers of the record formats: JSON objects, event lines, text corpora, listings.

All have explicit schemas; what doesn't fit one is kept apart rather than guessed or raised.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as X
from lodestone.operators import records as R


def json_objects(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """One object a file: the good rows, and paths of files whose root is no object or doesn't parse."""
    kind = T.StructType.fromDDL(schema).add("_corrupt", T.StringType())
    # A root array would be read as rows: its files are told by their first character.
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.trim(F.translate("value", "\r\n\t﻿", "    ")).alias("value"))
    parsed = whole.withColumn("row", F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    good = F.col("value").startswith("{") & F.col("row._corrupt").isNull()
    names = [f.name for f in kind.fields if f.name != "_corrupt"]
    return parsed.where(good).select("path", *(f"row.{n}" for n in names)), parsed.where(~F.coalesce(good, F.lit(False))).select("path")


def write_report(rows: DataFrame, path: str) -> None:
    """Nested rows as JSON lines; the commit protocol makes a failed run leave no part."""
    rows.write.mode("overwrite").json(path)


def replace_report(rows: DataFrame, path: str) -> None:
    """As :func:`write_report`, into a new folder that takes the place of the old one by renaming: readers see one or the other, and rows may come from the old one."""
    session = rows.sparkSession
    turn = uuid.uuid4().hex
    rows.write.json(f"{path}.new-{turn}")
    jvm = session.sparkContext._jvm
    at = lambda suffix="": jvm.org.apache.hadoop.fs.Path(f"{path}{suffix}")
    system = at().getFileSystem(session.sparkContext._jsc.hadoopConfiguration())
    old = system.exists(at())
    if old and not system.rename(at(), at(f".old-{turn}")) or not system.rename(at(f".new-{turn}"), at()):
        raise OSError(f"{path} can't be replaced; the new rows are in {path}.new-{turn}")
    if old:
        system.delete(at(f".old-{turn}"), True)


def append_events(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def events(spark: SparkSession, path: str) -> DataFrame:
    """Event lines with the local offset in their time stamps."""
    rows = spark.read.schema("schema_version string, timestamp string, event string, detail string, name string, state string, job_dir string").json(path)
    return rows.withColumn("ts", F.coalesce(*(F.try_to_timestamp("timestamp", F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssZ", "yyyy-MM-dd'T'HH:mm:ssXXX"))))


def text_corpus(spark: SparkSession, glob: str, corpus: str) -> DataFrame:
    """One document a file, named by its file."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return spark.read.text(glob, wholetext=True).select(name.alias("doc_id"), F.lit(corpus).alias("corpus"), F.col("value").alias("raw_text"))


def union_of_reports(spark: SparkSession, glob: str, hit: str) -> tuple[DataFrame, DataFrame]:
    """Reports ``stats`` (map, the last file wins by name) and ``hits``; outputs belong in another folder than the inputs."""
    rows = spark.read.schema(f"stats map<string,bigint>, hits array<{hit}>").json(glob, multiLine=True).withColumn("path", F.col("_metadata.file_path"))
    stats = rows.select("path", F.explode("stats").alias("key", "value")).groupBy("key").agg(F.max_by("value", "path").alias("value"))
    return stats, rows.select(F.inline("hits"))


def trace(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated trace; comments and blank lines are left out."""
    schema = "iter int, loss_ref double, depth_loss double, loss_n double, total double, w_depth double"
    return spark.read.csv(path, sep="\t", comment="#", schema=schema).where("iter IS NOT NULL")


def matrices(spark: SparkSession, glob: str) -> DataFrame:
    """White-space separated numbers of each file as an array of doubles."""
    return spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), X.numbers(F.col("value")).alias("cells"))


def scene_frames(spark: SparkSession, root: str, folder: str = "extrinsics", marker: str = "instances") -> DataFrame:
    """``scene, frame, cam, value`` of the texts ``root/<scene>/<folder>/<frame>_<cam>.txt``; a directory is a scene if it has a file in ``marker``."""
    rows = spark.read.text(f"{root}/*/{folder}/*.txt", wholetext=True).withColumn("_path", F.col("_metadata.file_path"))
    part = lambda k: F.regexp_extract("_path", r"/([^/]+)/[^/]+/(\d+)_(\d+)\.txt$", k)
    named = rows.select(part(1).alias("scene"), part(2).try_cast("int").alias("frame"), part(3).try_cast("int").alias("cam"), "value").where("scene <> ''")
    marked = spark.read.format("binaryFile").load(f"{root}/*/{marker}/*").select(F.regexp_extract("path", r"/([^/]+)/[^/]+/[^/]+$", 1).alias("scene")).distinct()
    return named.join(marked, "scene", "left_semi")


def inventory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Objects ``key, size_bytes, sha256`` of inventory files, and per file whether their number and sum are the stated ones."""
    kind = "summary struct<object_count:bigint,total_bytes:bigint>, objects array<struct<key:string,size_bytes:bigint,sha256:string>>"
    rows = spark.read.schema(kind).json(path, multiLine=True).withColumn("path", F.col("_metadata.file_path"))
    total = F.aggregate("objects", F.lit(0).cast("long"), lambda a, x: a + x["size_bytes"])
    checks = rows.select("path", F.size("objects").cast("long").alias("n_objects"), total.alias("n_bytes"), (F.size("objects").eqNullSafe(F.col("summary.object_count").cast("int")) & total.eqNullSafe(F.col("summary.total_bytes"))).alias("matches"))
    return rows.select("path", F.inline("objects")), checks


def ledger_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of ``index.json`` against ``records/*.json`` and the front matter of ``notes/*.md``: what lacks or states another title or status."""
    index = spark.read.schema("items array<struct<id:string,title:string,status:string>>").json(f"{folder}/index.json", multiLine=True).select(F.inline("items"))
    records = spark.read.schema("experiment_id string, title string, status string").json(f"{folder}/records/*.json", multiLine=True)
    records = records.select(F.col("experiment_id").alias("record_id"), F.col("title").alias("record_title"), F.col("status").alias("record_status"))
    notes = front_matter(spark, f"{folder}/notes/*.md").groupBy("path").agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(f"note_{k}") for k in ("id", "status")))
    records = records.join(notes.drop("path"), F.col("record_id") == F.col("note_id"), "full")
    records = records.select(F.coalesce("record_id", "note_id").alias("record"), "record_title", "record_status", "note_status")
    return R.drift(index, records, "id", "record", {"title": "record_title", "status": "record_status"}).unionByName(
        index.join(records, F.col("id") == F.col("record")).where(F.col("title").eqNullSafe(F.col("record_title")) & F.col("status").eqNullSafe(F.col("record_status")) & ~F.col("status").eqNullSafe(F.col("note_status")))
    )


def markdown_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``| [x] | TASK-.. | priority | action |`` of a table."""
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\| \["))
    cell = lambda k: F.trim(F.get(F.split("value", r"\|"), F.lit(k)))
    return rows.select((cell(1) == "[x]").alias("done"), cell(2).alias("task_id"), cell(3).alias("priority"), cell(4).alias("action"))


def front_matter(spark: SparkSession, glob: str) -> DataFrame:
    """``key: value`` lines between the first two ``---`` of each note."""
    rows = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("value", r"(?s)^---\n(.*?)\n---", 1).alias("head"))
    rows = rows.select("path", F.explode(F.split("head", "\n")).alias("line")).where(F.contains("line", F.lit(":")))
    return rows.select("path", F.trim(F.split_part("line", F.lit(":"), F.lit(1))).alias("key"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))


def file_stats(spark: SparkSession, glob: str) -> DataFrame:
    """Paths, sizes and times; contents aren't read."""
    return spark.read.format("binaryFile").load(glob).select("path", "modificationTime", "length")


def output_gate(files: DataFrame, pattern: str, least: int, size: int) -> DataFrame:
    """Whether enough files of enough bytes are there, and a message if not."""
    n = F.count_if(F.col("path").rlike(pattern) & (F.col("length") >= size))
    return files.agg(n.alias("n_valid")).select(
        "n_valid", (F.col("n_valid") >= least).alias("passed"), F.when(F.col("n_valid") < least, F.format_string(f"{pattern}: %d/{least} valid files", F.col("n_valid"))).alias("message")
    )


def unseen(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What the ledger of processed items doesn't have."""
    return items.join(done.select(key).distinct(), key, "left_anti")
