"""Quality rules: text statistics and cross-document line frequency.

Normalised lines are hashed and their distinct documents counted per host.
Lines of more than ``min_documents`` documents and more than ``max_share`` of
their host's documents are removed; a document is rejected when the base rules
fail, when fewer than ``min_words`` words are left, or when more than
``max_removed`` of its words went.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import fresh, settle, text_key

_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_SALTS = 32
_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def line_key(line: bytes) -> int:
    """Signed 64-bit hash of a line: A-Z in lower case, words joined by one space."""
    h = xxhash.xxh64_intdigest(b" ".join(line.lower().split()))
    return h - (1 << 64) if h >> 63 else h


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text holds twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    for w in words:
        numbers.setdefault(w, len(numbers))
    ids = np.fromiter(map(numbers.get, words), np.uint64, len(words))
    base = np.uint64(len(numbers))
    if len(numbers) < 2_000_000:  # below, three numbers fit into 64 bits
        keys = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    else:
        pair = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1].astype(np.uint64)
        keys = pair[:-1] * base + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + n] |= twice
    return int(hit.sum())


def measure(text: bytes) -> tuple[list[int], dict[int, int]]:
    """The five base figures, and words by line key."""
    words = text.split()
    n_bytes = len(text.translate(None, _SPACES))
    joined = np.frombuffer(text, np.uint8)
    chars = n_bytes - int(((joined & 0xC0) == 0x80).sum())
    seen, dup, lines = set(), 0, {}
    for line in text.split(b"\n"):
        n = len(line.split())
        if n:
            dup += line in seen
            seen.add(line)
            key = line_key(line)
            lines[key] = lines.get(key, 0) + n
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    return [len(words), chars, symbols, dup, repeated_words(words)], lines


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def judge(
    docs: DataFrame,
    *,
    host: str = "source",
    min_documents: int = 10,
    max_share: float = 0.05,
    min_words: int = 50,
    max_removed: float = 0.5,
) -> DataFrame:
    """Verdicts per document row.

    Returns ``doc_id, text_key, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_removed_words, frequent_lines`` (hashes) and
    ``kept``. A null or wordless text has no words and fails the base rules. A
    null host is a host of its own. Documents count once per distinct text and
    host, so exact copies don't make their own lines frequent. Rows that repeat
    are judged alike, each returned.
    """

    def stats(batches):
        for batch in batches:
            figures, keys, counts = [], [], []
            for text in batch.column(3).to_pylist():
                row, lines = measure(text or b"")
                figures.append(row)
                keys.append(list(lines))
                counts.append(list(lines.values()))
            columns = [pa.array([f[i] for f in figures], pa.int64()) for i in range(len(_STATS))]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(3)),
                    *columns,
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(counts, pa.list_(pa.int32())),
                ],
                ["doc_id", "host", "text_key", *_STATS, "line_keys", "line_words"],
            )

    text = F.col("text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), text_key(text).alias("text_key"), text.cast("binary"))
    figures = ", ".join(f"{c} long" for c in _STATS)
    base = settle(rows.mapInArrow(
        stats, f"doc_id {kind}, host string, text_key long, {figures}, line_keys array<long>, line_words array<int>"
    ))

    lines = base.select("host", "text_key", F.explode("line_keys").alias("line_key")).distinct()
    frequency = lines.groupBy("host", "line_key").agg(F.count("*").alias("n_documents")).where(F.col("n_documents") > min_documents)
    hosts = base.select("host", "text_key").distinct().groupBy("host").agg(F.count("*").alias("host_documents"))
    # A host's lines are as many as they are and it has one row: the small table is dealt out with a salt.
    salted = hosts.select(F.col("host").alias("_host"), "host_documents", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_salt"))
    frequent = (
        frequency.withColumn("salt", F.pmod("line_key", F.lit(_SALTS)).cast("int"))
        .join(salted, F.col("host").eqNullSafe(F.col("_host")) & (F.col("salt") == F.col("_salt")))
        .where(F.col("n_documents") > F.col("host_documents") * F.lit(max_share))
        .select(F.col("host").alias("_host"), F.col("line_key").alias("_line"))
    )
    # One line may stand in a third of all documents: its rows are dealt over salts, the frequent line repeated for each.
    marked = frequent.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    seen = (
        base.select("doc_id", "host", "text_key", F.explode(F.arrays_zip("line_keys", "line_words")).alias("l"))
        .select("doc_id", "host", "text_key", F.col("l.line_keys").alias("line_key"), F.col("l.line_words").alias("words"))
        .distinct()
        .withColumn("salt", F.pmod("text_key", F.lit(_SALTS)).cast("int"))
    )
    removed = (
        seen.join(marked, F.col("host").eqNullSafe(F.col("_host")) & (F.col("line_key") == F.col("_line")) & (F.col("salt") == F.col("_salt")))
        .groupBy(F.col("doc_id").alias("_id"), F.col("host").alias("_h"), F.col("text_key").alias("_key"))
        .agg(F.sum("words").alias("n_removed_words"), F.sort_array(F.collect_list("line_key")).alias("frequent_lines"))
    )
    gone = F.coalesce("n_removed_words", F.lit(0).cast("long"))
    left = F.col("n_words") - F.col("n_removed_words")
    return (
        base.drop("line_keys", "line_words")
        .join(removed, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("host").eqNullSafe(F.col("_h")) & (F.col("text_key") == F.col("_key")), "left")
        .withColumn("n_removed_words", gone)
        .withColumn("base_failed", base_failed())
        .withColumn("frequent_lines", F.coalesce("frequent_lines", F.array().cast("array<bigint>")))
        .withColumn("kept", ~F.col("base_failed") & (left >= min_words) & (F.col("n_removed_words") <= F.col("n_words") * F.lit(max_removed)))
        .select("doc_id", "host", "text_key", *_STATS, "base_failed", "n_removed_words", "frequent_lines", "kept")
    )


def without_lines(text: bytes, frequent: set[int]) -> bytes:
    return b"\n".join(x for x in text.split(b"\n") if not x.split() or line_key(x) not in frequent)


def filtered(docs: DataFrame, *, host: str = "source", **options) -> DataFrame:
    """The kept documents with their frequent lines removed; other columns stay, ``n_chars`` (if there) is counted anew."""
    verdicts = judge(docs, host=host, **options).where("kept")
    lines_name = fresh("lines", docs.columns)
    verdicts = verdicts.select(
        F.col("doc_id").alias("_v_id"), F.col("host").alias("_v_host"), F.col("text_key").alias("_v_key"), F.col("frequent_lines").alias(lines_name)
    ).distinct()
    same = (
        docs["doc_id"].eqNullSafe(verdicts["_v_id"])
        & docs[host].cast("string").eqNullSafe(verdicts["_v_host"])
        & (text_key(docs["text"]) == verdicts["_v_key"])
    )
    joined = docs.join(verdicts, same).select(*(docs[c] for c in docs.columns if c != "text"), docs["text"].cast("binary").alias("text"), verdicts[lines_name])
    at, lines_at = joined.columns.index("text"), joined.columns.index(lines_name)

    def strip(batches):
        for batch in batches:
            texts = [
                without_lines(t, set(drop)).decode("utf-8") if drop else t.decode("utf-8")
                for t, drop in zip(batch.column(at).to_pylist(), batch.column(lines_at).to_pylist(), strict=True)
            ]
            arrays = [batch.column(i) for i in range(batch.num_columns) if i != lines_at]
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, [x for i, x in enumerate(batch.schema.names) if i != lines_at])

    schema = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in joined.schema.fields if f.name != lines_name)
    out = joined.mapInArrow(strip, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def digest(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("doc_id", *_STATS, "base_failed", "kept", "n_removed_words")


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t, dense_rank() OVER (ORDER BY text) AS same FROM documents),
words AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT r, {_WORDS.format('t')} AS w FROM docs)),
threes AS (
  SELECT r, pos, count(*) OVER (PARTITION BY r, word, second, third) AS times FROM (
    SELECT *, lead(word) OVER o AS second, lead(word, 2) OVER o AS third FROM words WINDOW o AS (PARTITION BY r ORDER BY pos)) WHERE third IS NOT NULL),
repeats AS (SELECT r, count(DISTINCT pos + k) AS n_repeat_words FROM threes, range(3) s(k) WHERE times > 1 GROUP BY r),
sizes AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY r),
lines AS (
  SELECT *, len({_WORDS.format('line')}) AS n, translate(array_to_string({_WORDS.format('line')}, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS normal
  FROM (SELECT r, host, same, unnest(string_split(t, chr(10))) AS line FROM docs)),
dups AS (SELECT r, sum(n - 1) AS n_dup_lines FROM (SELECT r, line, count(*) AS n FROM lines WHERE n > 0 GROUP BY r, line) GROUP BY r),
hosts AS (SELECT host, count(DISTINCT same) AS n_documents FROM docs GROUP BY host),
frequent AS (
  SELECT f.host, normal FROM (SELECT host, normal, count(DISTINCT same) AS n FROM lines WHERE n > 0 GROUP BY host, normal) f
  JOIN hosts h ON f.host IS NOT DISTINCT FROM h.host WHERE f.n > 10 AND f.n > 0.05::DOUBLE * h.n_documents),
gone AS (
  SELECT r, sum(n) AS n_removed_words FROM lines l JOIN frequent f ON l.normal = f.normal AND l.host IS NOT DISTINCT FROM f.host WHERE n > 0 GROUP BY r),
figures AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_removed_words, 0)::BIGINT AS n_removed_words
  FROM docs LEFT JOIN sizes USING (r) LEFT JOIN repeats USING (r) LEFT JOIN dups USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words AND n_words - n_removed_words >= 50 AND 2 * n_removed_words <= n_words AS kept
FROM figures
"""
