"""Line dedup over overlapping windows of three lines; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import settle, text_key


def _windows(lines: Column, size: int) -> Column:
    """An array of ``key, at`` for each run of ``size`` lines that isn't blank throughout.

    The array is zipped with itself, shifted: no function looks into the whole array for each line.
    """
    shifted = [F.slice(lines, k + 1, F.greatest(F.size(lines) - k, F.lit(0))).alias(f"l{k}") for k in range(size)]
    joined = lambda w: F.concat_ws("\n", *(w[f"l{k}"] for k in range(size)))
    made = F.transform(F.arrays_zip(*shifted), lambda w, i: F.when(
        w[f"l{size - 1}"].isNotNull() & (F.regexp_replace(joined(w), r"[ \t\n\x0B\f\r]", "") != ""),
        F.struct(F.md5(joined(w).cast("binary")).alias("key"), i.alias("at")),
    ))
    return F.filter(made, lambda w: w.isNotNull())


def find_repeats(docs: DataFrame, *, size: int = 3) -> DataFrame:
    """Lines covered by windows that also stand earlier.

    Earlier is a smaller doc_id (null first), then a smaller text key, then a
    smaller line. Returns ``doc_id, text_key, covered`` (sorted line numbers from
    0) for the documents that have any. Rows equal in doc_id and text count as
    one document. Lines are what ``\\n`` splits, compared as they are; texts of
    fewer lines than ``size`` and null texts have no window, and a window of blank lines is none.
    """
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.explode(_windows(F.split("text", "\n"), size)).alias("w"))
    # Both sides of the join below read the windows, which are dear to hash.
    rows = settle(rows.select("doc_id", "text_key", F.unhex("w.key").alias("key"), "w.at"))
    place = F.struct("doc_id", "text_key", "at")
    firsts = (
        rows.groupBy("key")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(~F.col("first").eqNullSafe(F.col("last")))
        .select(F.col("key").alias("_key"), "first")
    )
    # A window may stand in a third of all documents: its rows are dealt over salts, the one row of its first place repeated.
    salts = 32
    firsts = firsts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    later = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(salts)).cast("int"))
        .join(firsts, (F.col("key") == F.col("_key")) & (F.col("salt") == F.col("_salt")))
        .where(~place.eqNullSafe(F.col("first")))
    )
    covered = F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + size - 1)))
    return later.groupBy("doc_id", "text_key").agg(F.array_sort(F.array_distinct(covered)).alias("covered"))


def dedup_lines(docs: DataFrame, *, size: int = 3) -> DataFrame:
    """Each row's ``doc_id, n_lines, n_removed, n_spans`` (maximal runs of removed lines) and ``kept_text``.

    A null text stays null, with no lines. See :func:`find_repeats` for what goes.
    """
    found = find_repeats(docs, size=size).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "covered")
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    lines = F.split("text", "\n")
    covered = F.coalesce("covered", F.array().cast("array<int>"))
    before = F.concat(F.array(F.lit(-2)), covered)
    spans = F.size(F.filter(F.zip_with(covered, before, lambda x, y: x - y), lambda gap: gap > 1))
    # Each covered line's mark sorts just before the line: a line whose neighbour is its own mark goes.
    mark = F.transform(covered, lambda i: F.struct(i.alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("line")))
    both = F.array_sort(F.concat(mark, F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.lit(1).alias("kind"), x.alias("line")))))
    left = F.filter(
        F.zip_with(
            both,
            F.concat(F.array(F.lit(None).cast("struct<at:int,kind:int,line:string>")), both),
            lambda x, y: F.when((x["kind"] == 1) & ~F.coalesce((y["kind"] == 0) & (y["at"] == x["at"]), F.lit(False)), x["line"]),
        ),
        lambda x: x.isNotNull(),
    )
    kept = F.when(F.size(covered) == 0, F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.size(covered).cast("long").alias("n_removed"),
        spans.cast("long").alias("n_spans"),
        F.when(F.col("text").isNotNull(), kept).alias("kept_text"),
    )


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
numbered AS (
  SELECT doc_id, text, ls, unnest(range(len(ls))) AS pos FROM lines),
windows AS (
  SELECT doc_id, text, pos, array_to_string(list_slice(ls, pos + 1, pos + 3), chr(10)) AS w FROM numbered WHERE pos + 3 <= len(ls)),
placed AS (
  SELECT doc_id, text, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS FIRST, pos) AS nth
  FROM windows WHERE regexp_replace(w, '[ \\t\\n\\v\\f\\r]', '', 'g') <> ''),
covered AS (
  SELECT DISTINCT doc_id, text, pos + k AS line FROM placed, (VALUES (0), (1), (2)) r(k) WHERE nth > 1),
kept AS (
  SELECT n.doc_id, n.text, count(c.line) AS n_removed,
         count(c.line) FILTER (WHERE p.line IS NULL) AS n_spans,
         coalesce(string_agg(n.ls[n.pos + 1], chr(10) ORDER BY n.pos) FILTER (WHERE c.line IS NULL), '') AS kept_text
  FROM numbered n LEFT JOIN covered c ON c.doc_id IS NOT DISTINCT FROM n.doc_id AND c.text = n.text AND c.line = n.pos
  LEFT JOIN covered p ON p.doc_id IS NOT DISTINCT FROM n.doc_id AND p.text = n.text AND p.line = n.pos - 1 AND c.line IS NOT NULL
  GROUP BY n.doc_id, n.text)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
       coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(k.n_spans, 0)::BIGINT AS n_spans,
       sha256(coalesce(k.kept_text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id IS NOT DISTINCT FROM d.doc_id AND k.text = d.text
"""
