"""Web pages as a link graph: listings, edges, co-citation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.jobs.registry import Registry
from lodestone.sources.tables import table

JOBS = Registry()
HREF = r'(?s)<a href="([^"]*)">(.*?)</a>'
LINKS = """(SELECT page_id, host, nth, regexp_extract(m, '(?s)<a href="([^"]*)">', 1) AS href, trim(regexp_replace(m, '<[^>]+>', '', 'g')) AS title FROM (
  SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, unnest(regexp_extract_all(html, '(?s)<a href="[^"]*">.*?</a>')) AS m, generate_subscripts(regexp_extract_all(html, '(?s)<a href="[^"]*">.*?</a>'), 1) - 1 AS nth FROM pages))"""
SEEDS = ("/the", "/The", "/of", "/de", "/la", "/and")


def links(spark, sf):
    """A row for each link: its place in the page, target and title without tags."""
    pages = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.posexplode(F.regexp_extract_all("html", F.lit(HREF), 0)).alias("nth", "m"))
    return pages.select(
        "page_id", "host", F.col("nth").cast("long").alias("nth"), F.regexp_extract("m", HREF, 1).alias("href"), F.trim(F.regexp_replace("m", "<[^>]+>", "")).alias("title")
    )


@JOBS.query("s06_html_listing", f"SELECT page_id, title, 'https://' || host || href AS url FROM (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY nth) AS r FROM {LINKS}) WHERE r = 1")
def listing(spark, sf):
    """Links of each page, the first for each target, with absolute urls."""
    firsts = links(spark, sf).groupBy("page_id", "host", "href").agg(F.min_by("title", "nth").alias("title"))
    return firsts.select("page_id", "title", F.concat(F.lit("https://"), "host", "href").alias("url"))


@JOBS.query("s07_xml_feed", "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang FROM pages WHERE regexp_extract(html, '(?s)<title>(.*?)</title>', 1) <> ''")
def feed(spark, sf):
    """Entries without a title are dropped."""
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return table(spark, sf, "pages").select("page_id", title.alias("title"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang")).where("title <> ''")


@JOBS.query("p22_entry_regex_select", f"SELECT page_id, href FROM {LINKS} WHERE regexp_matches(href, '^/[a-m].*[aeiou]$')")
def entry_select(spark, sf):
    return links(spark, sf).where(F.col("href").rlike("^/[a-m].*[aeiou]$")).select("page_id", "href")


IN_SEEDS = ", ".join(f"'{s}'" for s in SEEDS)


@JOBS.query("a05_seed_counts", f"SELECT href AS seed, count(*)::BIGINT AS n, count(DISTINCT page_id)::BIGINT AS n_pages FROM {LINKS} WHERE href IN ({IN_SEEDS}) GROUP BY href")
def seed_counts(spark, sf):
    rows = links(spark, sf).where(F.col("href").isin(*SEEDS))
    return rows.groupBy(F.col("href").alias("seed")).agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("n_pages"))


GROUPED = f"SELECT page_id, array_to_string(list(href ORDER BY href), ' ') AS seeds, count(*)::BIGINT AS n_seeds, count(DISTINCT href)::BIGINT AS n_distinct FROM {LINKS} WHERE href IN ({IN_SEEDS}) GROUP BY page_id"


def grouped(spark, sf):
    rows = links(spark, sf).where(F.col("href").isin(*SEEDS))
    return rows.groupBy("page_id").agg(F.array_join(F.sort_array(F.collect_list("href")), " ").alias("seeds"), F.count("*").alias("n_seeds"), F.count_distinct("href").alias("n_distinct"))


@JOBS.query("a06_group_to_list", f"SELECT page_id, seeds, n_seeds, n_distinct, n_seeds <> n_distinct AS repeats FROM ({GROUPED})")
def group_to_list(spark, sf):
    """Seeds of each page as a list, not a set; a flag where one repeats."""
    return grouped(spark, sf).withColumn("repeats", F.expr("n_seeds <> n_distinct"))


@JOBS.query("o06_sort_by_set_size", f"SELECT page_id, n_distinct FROM ({GROUPED}) WHERE n_distinct >= 2 ORDER BY n_distinct DESC, page_id LIMIT 15")
def by_set_size(spark, sf):
    return grouped(spark, sf).where("n_distinct >= 2").select("page_id", "n_distinct").orderBy(F.desc("n_distinct"), "page_id").limit(15)


@JOBS.query("f26_json_props", "SELECT event_type, count(*)::BIGINT AS n, sum(coalesce(json_extract(props, '$.k')::BIGINT, 0))::BIGINT AS total FROM events GROUP BY event_type")
def json_props(spark, sf):
    """a null-safe value of nested JSON, summed."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0).cast("long"))
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))
