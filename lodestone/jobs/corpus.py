"""Corpus probing: documents against lexicons, thresholds, corpora against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import tables
from lodestone.functions import text as T
from lodestone.jobs.registry import Registry
from lodestone.operators import automata as A
from lodestone.operators import lexicon as L
from lodestone.operators.snippets import windows
from lodestone.sources.tables import table

JOBS = Registry()
LEXICON = L.Lexicon(
    probes={"licensed": 3, "license": 2, "reserved": 2, "token": 4, "password": 4, "version": 1, "tion": 1, "ment": 1, "sch": 1, "erein": 2},
    categories={
        "licence": ("licen[cs]e", "all rights reserved", "released under"),
        "secret": ("token", "password", "akia[a-z0-9]+"),
        "contact": ("[a-z0-9.]+@[a-z0-9.]+", "[0-9]{3}-[0-9]{4}"),
        "prose": ("the .{0,40} of", "de la"),
    },
    strong=("apache license", "general public license", "mit license"),
    context=("the", "des", "und", "los"),
)
SPACES = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
FLAT = f"(SELECT doc_id, source, lang, text AS raw, regexp_replace(text, '{SPACES}', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL)"


def n(pattern: str) -> str:
    return f"len(regexp_extract_all(t, '(?i){pattern}'))"


def hit(pattern: str, of: str = "t") -> str:
    return f"regexp_matches({of}, '(?i){pattern}')"


GATE = "(" + " OR ".join(f"contains(lower(t), '{w}')" for w in LEXICON.context) + ")"
STRONG = " + ".join(f"({hit(p)})::INT" for p in LEXICON.strong)
CATEGORIES = " UNION ALL ".join(
    f"SELECT doc_id, source, lang, '{name}' AS category, ({' + '.join(n(p) for p in bodies)})::BIGINT AS n, "
    f"({' OR '.join(hit(p, 'substr(t, 1, 1800)') for p in bodies)}) AS early FROM {FLAT}"
    for name, bodies in LEXICON.categories.items()
)
PROBES = " UNION ALL ".join(f"SELECT doc_id, source, lang, '{p}' AS probe, {n(p)}::BIGINT AS n FROM {FLAT}" for p in LEXICON.probes)


def score_sql(cap: int, bonus: int) -> str:
    base = " + ".join(f"{w} * least({n(p)}, {cap})" for p, w in LEXICON.probes.items())
    return f"SELECT doc_id, source, ({base} + CASE WHEN {STRONG} > 0 THEN {bonus} ELSE 0 END)::BIGINT AS score, ({STRONG})::BIGINT AS n_strong FROM {FLAT} WHERE {GATE}"


def flat_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the flattened text, ``t``, and its lower case, ``low``, each made once."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "source", "lang", F.col("text").alias("raw"))
    return L.once(L.once(docs, "t", T.flat(F.col("raw"))), "low", F.lower("t"))


def scored(spark: SparkSession, sf: str, cap: int, bonus: int) -> DataFrame:
    docs = flat_docs(spark, sf).where(T.any_word(F.col("low"), LEXICON.context, lowered=True))
    return L.capped_score(docs, F.col("t"), LEXICON, ["doc_id", "source"], cap, bonus)


def categories(spark: SparkSession, sf: str) -> DataFrame:
    return L.category_counts(flat_docs(spark, sf), F.col("t"), LEXICON.categories, ["doc_id", "source", "lang"])


def probes(spark: SparkSession, sf: str) -> DataFrame:
    return L.probe_counts(flat_docs(spark, sf), F.col("t"), list(LEXICON.probes), ["doc_id", "source", "lang"])


@JOBS.query("a02_weighted_capped_score", f"SELECT doc_id, source, score, n_strong FROM ({score_sql(6, 30)}) WHERE score >= 20")
def survey_score(spark, sf):
    """Context gate, capped weights, bonus, threshold."""
    return scored(spark, sf, 6, 30).where("score >= 20")


@JOBS.query("p05_rescore_threshold", f"SELECT doc_id, source, score, n_strong FROM ({score_sql(5, 40)}) WHERE score >= 25")
def rescore(spark, sf):
    """A02 with the other cap, bonus and threshold."""
    return scored(spark, sf, 5, 40).where("score >= 25")


@JOBS.query("o03_topk_global", f"SELECT doc_id, score FROM ({score_sql(6, 30)}) ORDER BY score DESC, doc_id LIMIT 25")
def top_scores(spark, sf):
    """The best 25, ties by doc_id."""
    return scored(spark, sf, 6, 30).select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(25)


@JOBS.query(
    "o05_work_cap",
    f"WITH s AS ({score_sql(6, 30)}), r AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS nth, count(*) OVER () AS n FROM s WHERE score >= 20) "
    "SELECT doc_id, score, greatest(0, n - 100)::BIGINT AS not_examined FROM r WHERE nth <= 100",
)
def work_cap(spark, sf):
    """The first hundred candidates, and how many were not examined."""
    candidates = scored(spark, sf, 6, 30).where("score >= 20").select("doc_id", "score")
    total = candidates.agg(F.greatest(F.lit(0).cast("long"), F.count("*") - 100).alias("not_examined"))
    return candidates.orderBy(F.desc("score"), "doc_id").limit(100).join(F.broadcast(total))  # one row


TOKENS = "SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents"
LEXICONS = f"SELECT lang AS lexicon, term, length(term) AS weight FROM ({TOKENS}) WHERE length(term) >= 7 GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 3"


def lexicons(spark: SparkSession, sf: str) -> DataFrame:
    """A lexicon for each language: its words of seven letters and more in three documents and more, weighed by their length."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 7))
    rows = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("lexicon"), F.explode(words).alias("term"))
    return rows.groupBy("lexicon", "term").agg(F.count("*").alias("n")).where("n >= 3").select("lexicon", "term", F.length("term").alias("weight"))


@JOBS.query(
    "x03_lexicon_scores",
    f"SELECT doc_id, t.lang, lexicon, sum(weight * least(n, 5))::DOUBLE AS score, count(*)::BIGINT AS n_terms FROM (SELECT doc_id, lang, term, count(*) AS n FROM ({TOKENS}) GROUP BY ALL) t JOIN ({LEXICONS}) l ON t.term = l.term GROUP BY doc_id, t.lang, lexicon",
)
def lexicon_scores(spark, sf):
    """Every document against lexicons that are tables, derived from the corpus; whole words."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.lower("text").alias("low"))
    return A.lexicon_scores(docs, "low", lexicons(spark, sf), ["doc_id", "lang"], 5, inside=A.LETTERS)


@JOBS.query(
    "x03_term_counts",
    f"SELECT term, count(*)::BIGINT AS n_documents, sum(n)::BIGINT AS n_found FROM (SELECT doc_id, term, count(*) AS n FROM ({TOKENS}) WHERE term IN (SELECT term FROM ({LEXICONS})) GROUP BY ALL) GROUP BY term",
)
def lexicon_terms(spark, sf):
    """How many documents hold each term of the lexicons, and how often."""
    docs = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("low"))
    found = A.term_counts(docs, "low", lexicons(spark, sf), ["doc_id"], inside=A.LETTERS)
    return found.groupBy("term").agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_found"))


@JOBS.query("p01_any_keyword", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'licensed') OR contains(lower(text), 'worthless') OR contains(lower(text), 'reserved')")
def any_keyword(spark, sf):
    return table(spark, sf, "documents").where(T.any_word(F.col("text"), ("licensed", "worthless", "reserved"))).select("doc_id", "source")


@JOBS.query("p02_context_gate", f"SELECT source, count(*) FILTER (WHERE {GATE})::BIGINT AS n_in_context, count(*)::BIGINT AS n_documents FROM {FLAT} GROUP BY source")
def context_gate(spark, sf):
    gate = T.any_word(F.col("low"), LEXICON.context, lowered=True)
    return flat_docs(spark, sf).groupBy("source").agg(F.count_if(gate).alias("n_in_context"), F.count("*").alias("n_documents"))


@JOBS.query("p08_topic_level", f"SELECT doc_id, category, n FROM ({CATEGORIES}) WHERE early AND n >= 6")
def topic_level(spark, sf):
    """A document is on a topic if a pattern is met early and the topic's patterns are met six times."""
    return categories(spark, sf).where("early AND n >= 6").select("doc_id", "category", "n")


@JOBS.query("p09_strong_signal", " UNION ALL ".join(f"SELECT doc_id, '{p}' AS pattern FROM {FLAT} WHERE {hit(p)}" for p in LEXICON.strong))
def strong_signal(spark, sf):
    met = F.filter(F.array(*(F.when(T.has(F.col("t"), p), F.lit(p)) for p in LEXICON.strong)), lambda x: x.isNotNull())
    return flat_docs(spark, sf).select("doc_id", F.explode(met).alias("pattern"))


WIDE = "SELECT doc_id, source, " + ", ".join(f"({' + '.join(n(p) for p in bodies)})::BIGINT AS {name}" for name, bodies in LEXICON.categories.items()) + f" FROM {FLAT}"


def wide(spark, sf):
    return L.category_columns(flat_docs(spark, sf), F.col("t"), LEXICON.categories, ["doc_id", "source"])


@JOBS.query("p07_cross_filter", f"SELECT doc_id, licence, secret, contact, prose FROM ({WIDE}) WHERE licence + prose >= 2 AND secret + contact >= 2")
def cross_filter(spark, sf):
    """Two pairs of categories must each be met twice."""
    return wide(spark, sf).where("licence + prose >= 2 AND secret + contact >= 2").select("doc_id", *LEXICON.categories)


@JOBS.query("p06_composite_pick", f"SELECT doc_id, coalesce(nullif(source, ''), 'src' || doc_id) AS source FROM ({WIDE}) WHERE nullif(source, '') IS NOT NULL AND (licence >= 1 OR secret >= 1 OR prose >= 2)")
def composite_pick(spark, sf):
    """An id must be there and not empty; then any of three floors."""
    picked = wide(spark, sf).where("nullif(source, '') IS NOT NULL AND (licence >= 1 OR secret >= 1 OR prose >= 2)")
    return picked.select("doc_id", T.first_filled(F.col("source"), F.concat(F.lit("src"), "doc_id")).alias("source"))


@JOBS.query("p10_key_hit", f"SELECT doc_id, (licence >= 2 OR secret >= 2 OR contact >= 2) AS key_hit FROM ({WIDE})")
def key_hit(spark, sf):
    return wide(spark, sf).select("doc_id", F.expr("licence >= 2 OR secret >= 2 OR contact >= 2").alias("key_hit"))


@JOBS.query("p11_nonzero_rows", f"SELECT source, count(*)::BIGINT AS n_documents, (count(*) FILTER (WHERE licence + secret + contact + prose = 0))::BIGINT AS n_all_zero FROM ({WIDE}) GROUP BY source")
def nonzero_rows(spark, sf):
    return wide(spark, sf).groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if(F.expr("licence + secret + contact + prose = 0")).alias("n_all_zero"))


@JOBS.query("o02_sort_composite", f"SELECT doc_id, (licence * 3 + secret * 2 + contact * 2 + prose)::BIGINT AS rank_key FROM ({WIDE}) ORDER BY rank_key DESC, doc_id LIMIT 30")
def sort_composite(spark, sf):
    key = F.expr("licence * 3 + secret * 2 + contact * 2 + prose").alias("rank_key")
    return wide(spark, sf).select("doc_id", key).orderBy(F.desc("rank_key"), "doc_id").limit(30)


@JOBS.query("a01_probe_counts", f"SELECT doc_id, category, n FROM ({CATEGORIES}) WHERE n > 0")
def category_rows(spark, sf):
    """Counts of a category sum over its patterns; one span may count twice."""
    return categories(spark, sf).where("n > 0").select("doc_id", "category", "n")


@JOBS.query("a03_found_map", f"SELECT doc_id, probe, n FROM ({PROBES}) WHERE n > 0")
def found(spark, sf):
    """The long form of the map from probe to uncapped count."""
    return probes(spark, sf).select("doc_id", "probe", "n")


@JOBS.query("o04_topk_in_map", f"SELECT doc_id, probe, n, nth FROM (SELECT doc_id, probe, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, probe) AS nth FROM ({PROBES}) WHERE n > 0) WHERE nth <= 4")
def top_probes(spark, sf):
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "probe")).cast("long")
    return probes(spark, sf).select("doc_id", "probe", "n", nth.alias("nth")).where("nth <= 4")


@JOBS.query("a04_venue_stats", "SELECT source, count(*)::BIGINT AS total, (count(*) FILTER (WHERE contains(lower(text), 'licensed')))::BIGINT AS coarse_pass FROM documents GROUP BY source")
def venue_stats(spark, sf):
    passes = T.any_word(F.col("text"), ("licensed",))
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("total"), F.count_if(passes).alias("coarse_pass"))


@JOBS.query(
    "a28_topic_vs_mention",
    f"SELECT category, (count(*) FILTER (WHERE early AND n >= 6))::BIGINT AS n_topic, (count(*) FILTER (WHERE n > 0 AND NOT (early AND n >= 6)))::BIGINT AS n_mention, "
    f"CASE WHEN count(*) FILTER (WHERE early AND n >= 6) < 5 THEN 'unknown' ELSE 'covered' END AS verdict, "
    f"array_to_string((list(doc_id ORDER BY doc_id) FILTER (WHERE early AND n >= 6))[1:3], ',') AS examples FROM ({CATEGORIES}) GROUP BY category",
)
def topic_vs_mention(spark, sf):
    """On the topic or in passing; fewer than five on it means unknown, never a gap.

    The three examples come from blocks of 65,536 doc_ids: a block's three first, then the three first of those.
    """
    rows = categories(spark, sf).withColumn("topic", F.expr("early AND n >= 6"))
    first = lambda ids: F.slice(F.array_sort(ids), 1, 3)
    blocks = rows.groupBy("category", F.shiftright("doc_id", 16).alias("block")).agg(
        F.count_if("topic").alias("n_topic"), F.count_if(F.expr("n > 0 AND NOT topic")).alias("n_mention"), first(F.collect_list(F.when(F.col("topic"), F.col("doc_id")))).alias("ids")
    )
    out = blocks.groupBy("category").agg(F.sum("n_topic").alias("n_topic"), F.sum("n_mention").alias("n_mention"), first(F.flatten(F.collect_list("ids"))).alias("ids"))
    return out.select(
        "category",
        "n_topic",
        "n_mention",
        F.when(F.col("n_topic") < 5, "unknown").otherwise("covered").alias("verdict"),
        F.nullif(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), F.lit("")).alias("examples"),
    )


@JOBS.query("a29_phrase_census", f"SELECT phrase, count(*)::BIGINT AS n FROM (SELECT lower(unnest(regexp_extract_all(t, '(?i)(licensed under the [a-z]+|all rights reserved|released under)'))) AS phrase FROM {FLAT}) GROUP BY phrase")
def phrase_census(spark, sf):
    found = F.regexp_extract_all("t", F.lit("(?iu)(licensed under the [a-z]+|all rights reserved|released under)"), 1)
    return flat_docs(spark, sf).select(F.explode(F.transform(found, lambda x: F.lower(x))).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))


@JOBS.query(
    "a30_admit_vs_dedicated",
    f"SELECT source, (count(*) FILTER (WHERE n > 0))::BIGINT AS admitting, (count(*) FILTER (WHERE early AND n >= 2))::BIGINT AS dedicated, "
    f"CASE WHEN count(*) FILTER (WHERE early AND n >= 2) > 0 THEN (count(*) FILTER (WHERE n > 0))::DOUBLE / count(*) FILTER (WHERE early AND n >= 2) END AS gap_ratio "
    f"FROM ({CATEGORIES}) WHERE category = 'licence' GROUP BY source",
)
def admit_vs_dedicated(spark, sf):
    """Null where no document is dedicated."""
    counts = categories(spark, sf).where("category = 'licence'").groupBy("source")
    counts = counts.agg(F.count_if(F.col("n") > 0).alias("admitting"), F.count_if(F.expr("early AND n >= 2")).alias("dedicated"))
    return counts.withColumn("gap_ratio", F.when(F.col("dedicated") > 0, F.col("admitting").cast("double") / F.col("dedicated")))


@JOBS.query("a35_topic_union", f"SELECT source, count(DISTINCT doc_id)::BIGINT AS n_documents FROM ({CATEGORIES}) WHERE category IN ('licence', 'secret') AND n >= 1 GROUP BY source")
def topic_union(spark, sf):
    rows = categories(spark, sf).where("category IN ('licence', 'secret') AND n >= 1")
    return rows.groupBy("source").agg(F.count_distinct("doc_id").alias("n_documents"))


def titles_sql(of: str) -> str:
    return f"(SELECT lang, trim(split_part(text, chr(10), 1)) AS title FROM documents WHERE {of})"


def titles(spark, sf, of):
    return table(spark, sf, "documents").where(of).select("lang", F.trim(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"))


#: Two sides that overlap and together hold every document, by the last character of the source.
FIRST, SECOND = "right(coalesce(source, ''), 1) <= '6'", "right(coalesce(source, 'z'), 1) >= '4'"


@JOBS.query("u02_union_distinct", f"SELECT lang, title FROM {titles_sql(FIRST)} UNION SELECT lang, title FROM {titles_sql(SECOND)}")
def union_distinct(spark, sf):
    return titles(spark, sf, FIRST).union(titles(spark, sf, SECOND)).distinct()


@JOBS.query("u01_union_all", f"SELECT lang, title, 'a' AS side FROM {titles_sql(FIRST)} UNION ALL SELECT lang, title, 'b' AS side FROM {titles_sql(SECOND)}")
def union_all(spark, sf):
    return titles(spark, sf, FIRST).withColumn("side", F.lit("a")).unionByName(titles(spark, sf, SECOND).withColumn("side", F.lit("b")))


@JOBS.query("j07_anti_titles", f"SELECT lang, title FROM {titles_sql(SECOND)} b WHERE NOT EXISTS (SELECT 1 FROM {titles_sql(FIRST)} a WHERE a.lang = b.lang AND a.title = b.title)")
def anti_titles(spark, sf):
    """What only the second corpus has; its own repeats stay."""
    return titles(spark, sf, SECOND).join(titles(spark, sf, FIRST), ["lang", "title"], "left_anti")


@JOBS.query("u04_membership", f"SELECT lang, title FROM {titles_sql(SECOND)} b WHERE EXISTS (SELECT 1 FROM {titles_sql(FIRST)} a WHERE a.lang = b.lang AND a.title = b.title)")
def membership(spark, sf):
    return titles(spark, sf, SECOND).join(titles(spark, sf, FIRST), ["lang", "title"], "left_semi")


@JOBS.query("u05_union_sorted_keys", "SELECT key FROM (SELECT source AS key FROM documents UNION SELECT lang FROM documents) ORDER BY key")
def sorted_keys(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(F.col("source").alias("key")).union(docs.select("lang")).distinct().orderBy("key")


@JOBS.query("w01_first_seen", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth FROM documents) WHERE nth = 1")
def first_seen(spark, sf):
    """The first of equal texts in the order of doc_id: an aggregate, so that many copies are combined before the shuffle."""
    firsts = table(spark, sf, "documents").groupBy(F.sha2(F.col("text"), 256).alias("digest")).agg(F.min(F.struct("doc_id", "source")).alias("first"))
    return firsts.select("first.doc_id", "first.source")


TITLE = "[x FOR x IN [trim(y) FOR y IN string_split(text, chr(10))[1:{n}]] IF length(x) > 18 AND length(x) < {most}{stop}][1]"


@JOBS.query(
    "p23_title_guess",
    "SELECT doc_id, coalesce(" + TITLE.format(n=40, most=160, stop=" AND NOT starts_with(lower(x), 'the') AND NOT starts_with(lower(x), 'is')") + ", source || doc_id)[1:90] AS title, "
    "coalesce(" + TITLE.format(n=30, most=140, stop="") + ", '')[1:70] AS short_title FROM documents",
)
def title_guess(spark, sf):
    """P23 and its shorter form P23b."""
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        T.title_guess(text, 40, 160, 90, ("the", "is"), F.concat("source", "doc_id")).alias("title"),
        T.title_guess(text, 30, 140, 70).alias("short_title"),
    )


REPORT = """(SELECT l_orderkey, string_agg('  ' || CASE WHEN l_linenumber % 2 = 1 THEN 'Model ' ELSE '' END || l_returnflag || CASE WHEN l_linenumber % 3 = 0 THEN 'x' ELSE '' END || ' | ' || l_quantity::INT
    || CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE ' | ' || l_discount END || ' ', chr(10) ORDER BY l_linenumber) AS report FROM lineitem GROUP BY l_orderkey)"""


@JOBS.query(
    "p19_table_row_grep",
    f"SELECT l_orderkey, row FROM (SELECT l_orderkey, trim(unnest(string_split(report, chr(10)))) AS row FROM {REPORT}) WHERE regexp_matches(row, '^(Model )?[A-N]\\b') AND regexp_matches(row, '\\d\\.\\d') AND length(row) < 160",
)
def table_rows(spark, sf):
    """Rows of a text table that name a model and hold a figure with decimals; the texts are reports of the orders' lines."""
    odd, third, fourth = (F.col("l_linenumber") % k for k in (2, 3, 4))
    line = F.concat(
        F.lit("  "), F.when(odd == 1, "Model ").otherwise(""), "l_returnflag", F.when(third == 0, "x").otherwise(""), F.lit(" | "), F.col("l_quantity").cast("int").cast("string"),
        F.when(fourth == 0, "").otherwise(F.concat(F.lit(" | "), F.col("l_discount").cast("string"))), F.lit(" "),
    )
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line"))))
    reports = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("report"))
    rows = reports.select("l_orderkey", F.explode(F.transform(F.split("report", "\n"), lambda x: F.trim(x))).alias("row"))
    return rows.where(F.col("row").rlike(r"^(Model )?[A-N]\b") & F.col("row").rlike(r"\d\.\d") & (F.length("row") < 160))


@JOBS.query(
    "f_string_functions",
    f"SELECT doc_id, regexp_replace(source || '/' || substr(raw, 1, 100), '[^A-Za-z0-9._-]', '_', 'g')[1:80] AS key_each, regexp_replace(source || '/' || substr(raw, 1, 100), '[^A-Za-z0-9._-]+', '_', 'g')[1:120] AS key_runs, "
    "substr(sha256(source), 1, 12) AS path_digest, length(t)::BIGINT AS n_flat, CASE WHEN instr(lower(t), 'licen') > 0 THEN substr(t, greatest(1, instr(lower(t), 'licen') - 500), 1400) END AS first_context, "
    f"coalesce(nullif(lang, ''), source) AS label, {hit('general public')} AS named, coalesce(regexp_extract(t, '(?i)license, version ([0-9.]+)', 1), '') AS version FROM {FLAT}",
)
def string_functions(spark, sf):
    """F01-F03, F06, F09, F28, F29 over documents."""
    t, raw = F.col("t"), F.concat("source", F.lit("/"), F.substring("raw", 1, 100))
    at = F.instr(F.lower(t), "licen")
    start = F.greatest(F.lit(1), at - 500)
    return flat_docs(spark, sf).select(
        "doc_id",
        T.safe_key(raw, 80).alias("key_each"),
        T.safe_key(raw, 120, collapse=True).alias("key_runs"),
        F.substring(F.sha2("source", 256), 1, 12).alias("path_digest"),
        F.length(t).cast("long").alias("n_flat"),
        F.when(at > 0, F.substring(t, start, F.lit(1400))).alias("first_context"),
        T.first_filled(F.col("lang"), F.col("source")).alias("label"),
        T.has(t, "general public").alias("named"),
        F.regexp_extract(t, "(?iu)license, version ([0-9.]+)", 1).alias("version"),
    )


@JOBS.query(
    "f08_abstract",
    f"SELECT doc_id, nullif(regexp_extract(t, '(?i)^(.{{40,800}}?)(licensed|released under|all rights reserved)', 1), '') AS head FROM {FLAT}",
)
def abstract(spark, sf):
    """The shortest head of 40 to 800 characters before a marker."""
    head = F.regexp_extract("t", "(?iu)^(.{40,800}?)(licensed|released under|all rights reserved)", 1)
    return flat_docs(spark, sf).select("doc_id", F.nullif(head, F.lit("")).alias("head"))


@JOBS.query(
    "f07_snippets",
    f"""WITH cut AS (SELECT doc_id, t, regexp_split_to_array(t, '(?i)licen[cs]ed|token') AS parts, regexp_extract_all(t, '(?i)licen[cs]ed|token') AS hits FROM {FLAT}),
    nth AS (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM cut),
    placed AS (SELECT doc_id, t, k, list_sum([length(x) FOR x IN parts[1:k]]) + coalesce(list_sum([length(x) FOR x IN hits[1:k - 1]]), 0) AS s, length(hits[k]) AS n FROM nth),
    shown AS (SELECT doc_id, k, s::BIGINT AS "start", (s + n)::BIGINT AS "end", t[greatest(1, s - 89):s + n + 90] AS snippet FROM placed),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, snippet[1:60] ORDER BY k) AS again FROM shown)
    SELECT doc_id, "start", "end", snippet FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS place FROM firsts WHERE again = 1) WHERE place <= 3""",
)
def snippets(spark, sf):
    """Up to three windows around matches, repeats by their first 60 characters dropped."""
    return windows(flat_docs(spark, sf), "doc_id", "t", r"licen[cs]ed|token", before=90, after=90, most=3, same=60)


@JOBS.query("f07_snippets_sql", JOBS.sql["f07_snippets"])
def snippets_in_sql(spark, sf):
    """F07, W10 as a table function that SQL calls, a document at a time."""
    tables.register(spark)
    flat_docs(spark, sf).select("doc_id", "t").createOrReplaceTempView("lodestone_flat_documents")
    return spark.sql("SELECT doc_id, start, `end`, snippet FROM snippets('licen[cs]ed|token', 90, 3, 60, TABLE(lodestone_flat_documents) PARTITION BY doc_id)")


@JOBS.query(
    "j10_focus_contains",
    "SELECT DISTINCT doc_id FROM documents, (VALUES ('apache license'), ('mit license'), ('rights reserved')) f(phrase) WHERE contains(lower(text), phrase)",
)
def focus_contains(spark, sf):
    phrases = spark.createDataFrame([("apache license",), ("mit license",), ("rights reserved",)], "phrase string")
    docs = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("low"))
    return docs.join(F.broadcast(phrases), F.contains("low", "phrase"), "left_semi").select("doc_id")  # three phrases


@JOBS.query("f_acceptance", f"SELECT category, coalesce(bool_or(n > 0), false) AS acceptance, max(n)::BIGINT AS most FROM ({CATEGORIES}) GROUP BY category")
def acceptance(spark, sf):
    """Negatives count only where the tool finds a known positive."""
    return categories(spark, sf).groupBy("category").agg(F.coalesce(F.bool_or(F.col("n") > 0), F.lit(False)).alias("acceptance"), F.max("n").alias("most"))


@JOBS.query("s21_incremental", "SELECT source, count(*)::BIGINT AS n_new FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source")
def incremental(spark, sf):
    """What the ledger of processed documents doesn't have yet."""
    new = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")
    return new.groupBy("source").agg(F.count("*").alias("n_new"))
