"""URL filters: host and path rules, then a Bloom filter cascade; DataFrame functions only.

Level 1 encodes the listed keys; level 2 those of all other keys of the corpus
that pass level 1; level 3 the listed keys that pass level 2; and so on until
no key passes wrongly. The first level that a key misses then decides, exactly
for every key of the corpus, without a join.

Long lists are dealt into blocks by a hash of the key, each with a cascade of
bounded size; the pages are then written once, by block, and every block reads its own.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import settle, shared_folder

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Bytes that a filter may take; it is a constant of the plan.
LEVEL_BYTES = 4 << 20


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """A struct ``rule, verdict`` of the longest rule that fits; null if none does."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


class Level:
    """One Bloom filter as 64-bit words."""

    def __init__(self, number: int, words: Sequence[int], hashes: int):
        self.number, self.words, self.hashes = number, words, hashes

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(i)), F.lit(64 * len(self.words))) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        # One constant array; splitting happens once, when the plan is optimised.
        table = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        bits = [F.getbit(F.get(table, F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in self.places(key)]
        out = bits[0]
        for b in bits[1:]:
            out = out & b
        return out


def level_words(n: float, rate: float) -> int:
    """64-bit words of a Bloom filter of ``n`` keys with about this rate of false positives."""
    return max(1, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64))


def first_rate(listed: float, others: float) -> float:
    """False positives of the first level: about 0.7 times as many as there are listed keys."""
    return min(0.5, 0.7 * listed / max(others, 1))


def n_blocks(listed: int, others: int, level_bytes: int) -> int:
    """Blocks of keys such that no level takes more than ``level_bytes``.

    The first level is the largest: a later one has at most as many keys, at a rate of a half. A
    block's share of the listed keys lies below a mean of some hundreds at least
    plus eight times its root; a tenth is left for that.
    """
    need = 8 * level_words(listed, min(first_rate(listed, others), 0.5)) if listed else 0
    return 1 if need <= level_bytes else math.ceil(1.1 * need / level_bytes)


def build_level(keys: DataFrame, number: int, n: int, rate: float) -> Level:
    level = Level(number, [0] * level_words(n, rate), max(1, round(-math.log2(rate))))
    spots = keys.select(F.explode(F.array(*level.places(F.col("key")))).alias("p"))
    bits = spots.groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pmod(p, 64) AS int))")).alias("bits")
    )
    for r in bits.collect():  # about LEVEL_BYTES: blocks are cut so
        level.words[r["w"]] = r["bits"]
    return level


def build_cascade(keys: DataFrame) -> list[Level]:
    """Levels for distinct ``key``s with ``listed``; the keys must be the complete universe."""
    inside, outside = keys.where("listed"), keys.where(~F.col("listed"))
    levels: list[Level] = []
    n, others = inside.count(), outside.count()
    while n:
        level = build_level(inside, len(levels), n, 0.5 if levels else first_rate(n, others))
        levels.append(level)
        wrong = settle(outside.where(level.holds(F.col("key"))))
        n, others = wrong.count(), n
        inside, outside = wrong, inside
    return levels


def in_cascade(key: Column, levels: Sequence[Level]) -> Column:
    """Whether the key is listed: the number of levels it passes before the first miss is odd."""
    out = F.lit(bool(len(levels) % 2))
    for level in reversed(levels):
        out = F.when(level.holds(key), out).otherwise(F.lit(bool(level.number % 2)))
    return out


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    *,
    key: Column | None = None,
    rules: Sequence[tuple[str, str, str]] = RULES,
    level_bytes: int = LEVEL_BYTES,
) -> DataFrame:
    """Per row of ``pages``: ``page_id, host, path, rule, verdict``.

    The longest fitting rule's verdict holds (longest by host and path
    together, then by host); otherwise ``block`` if the row's ``key``, a
    column over ``host`` and ``path`` (by default the host), is a ``key`` of ``listed``,
    else ``allow``. A null url and one without ``://`` has an empty host and
    path. Null and repeated keys of ``listed`` and those that no page has are
    of no effect; repeated pages stay repeated.

    A level takes about ``level_bytes`` at most: more listed keys are dealt into blocks.
    """
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("key", F.col("host") if key is None else key)
    listing = listed.select("key", F.lit(True).alias("listed")).where("key IS NOT NULL")
    seen = rows.select("key", F.lit(False).alias("listed"))
    both = listing.unionByName(seen).groupBy("key").agg(F.bool_or("listed").alias("listed"), F.bool_and("listed").alias("unseen"))
    keys = settle(both.where(~F.col("unseen")).select("key", "listed"))
    counts = keys.agg(F.count_if("listed").alias("n"), F.count("*").alias("all")).first()
    blocks = n_blocks(counts["n"], counts["all"] - counts["n"], level_bytes)
    chosen = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("chosen", chosen).select("page_id", "host", "path", "key", F.col("chosen.rule").alias("rule"), F.col("chosen.verdict").alias("verdict"))

    def judged(own: DataFrame, levels: Sequence[Level]) -> DataFrame:
        by_list = F.when(in_cascade(F.col("key"), levels), "block").otherwise("allow")
        return own.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_list).alias("verdict"))

    if blocks == 1:
        return judged(rows, build_cascade(keys))
    folder = f"{shared_folder(pages.sparkSession)}/url-blocks-{uuid.uuid4().hex}"
    block = lambda c: F.pmod(F.xxhash64(F.lit("block"), c), F.lit(blocks)).cast("int").alias("block")
    written = {"keys": keys.select("*", block(F.col("key"))), "rows": rows.select("*", block(F.col("key")))}
    for name, frame in written.items():
        frame.write.partitionBy("block").parquet(f"{folder}/{name}")
    own = {name: pages.sparkSession.read.schema(frame.schema).parquet(f"{folder}/{name}") for name, frame in written.items()}
    out = None
    for k in range(blocks):
        part = judged(own["rows"].where(F.col("block") == k), build_cascade(own["keys"].where(F.col("block") == k).drop("block")))
        part = settle(part)  # so that a plan holds one cascade
        out = part if out is None else out.unionByName(part)
    return out


def page_key() -> Column:
    """A page's key: host and path of its url."""
    return F.concat("host", "path")


def listed_pages(pages: DataFrame) -> DataFrame:
    """The block list of the query: the keys of pages all of whose copies are cut off.

    A page is cut off if its html is null or lacks the closing tag. Urls without a host aren't listed. The list grows with the pages.
    """
    cut = F.coalesce(~F.contains("html", F.lit("</html>")), F.lit(True))
    rows = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), cut.alias("cut")).where(F.col("host") != "")
    return rows.groupBy(page_key().alias("key")).agg(F.bool_and("cut").alias("cut")).where("cut").select("key")


ORACLE = f"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, coalesce(NOT contains(html, '</html>'), true)::INT AS cut FROM pages),
rules(verdict, h, p) AS (VALUES {", ".join(str(r) for r in RULES)}),
fitting AS (
  SELECT page_id, arg_max(h || p, len(h || p)) AS rule, arg_max(verdict, len(h || p)) AS verdict
  FROM parsed JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
listed AS (SELECT host || path AS key FROM parsed WHERE host <> '' GROUP BY host || path HAVING min(cut) = 1)
SELECT a.page_id, host, path, rule,
       coalesce(verdict, CASE WHEN host || path IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed a LEFT JOIN fitting f ON f.page_id = a.page_id
"""
