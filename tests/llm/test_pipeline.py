"""The pipeline, stage by stage, against plain Python; queries with SQL against it."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import mixing, queries
from lodestone.llm.common import settle
from tests.llm.test_brute_force import expected_near, expected_overlaps, expected_quality

SF = "/root/testdata/sf0.001"


def normal(line: str) -> bytes:
    return b" ".join(line.encode().lower().split())


def kept_by_quality(docs):
    failed = {(r[0]): r[6] for r in expected_quality(docs)}
    per_line, per_host = defaultdict(set), defaultdict(set)
    for _, text, host in docs:
        per_host[host].add(text)
        for line in text.split("\n"):
            if normal(line):
                per_line[host, normal(line)].add(text)
    frequent = {k for k, v in per_line.items() if len(v) > 10 and len(v) > 0.05 * len(per_host[k[0]])}
    out = []
    for i, text, host in docs:
        n = len(text.encode().split())
        gone = sum(len(normal(x).split()) for x in text.split("\n") if (host, normal(x)) in frequent)
        if not failed[i] and n - gone >= 50 and gone <= 0.5 * n:
            out.append((i, "\n".join(x for x in text.split("\n") if (host, normal(x)) not in frequent), host))
    return out


def copies_by_mix(docs):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in docs}
    total = Counter()
    for i, _, s in docs:
        total[s] += size[i]
    names = sorted(total)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(total.values()), set(names)
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * unit > 2 * total[s]}
        if not full:
            target |= {s: weight[s] * unit for s in free}
            break
        for s in full:
            target[s] = 2 * total[s]
            left -= target[s]
        free -= full
    copies = {}
    for s in names:
        quota = min(round(target[s]), 2 * total[s])
        whole, rest = divmod(quota, total[s])
        draw = lambda i: int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:15], 16)
        used = 0
        for i in sorted((i for i, _, x in docs if x == s), key=draw):
            used += size[i]
            copies[i] = whole + (1 if rest and used <= rest else 0)
    return copies


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = settle(stage(spark, docs, SF))
    return [*out, docs]


def rows(frame):
    return [(r["doc_id"], r["text"], r["source"]) for r in frame.collect()]


def test_stages_against_brute_force(spark, stages):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixture", "token_files"]
    assert all(s.columns == stages[0].columns for s in stages[:5])
    assert sorted(rows(stages[1])) == sorted(kept_by_quality(rows(stages[0])))
    first = {i for i, _, _, cluster in expected_near(rows(stages[1])) if i == cluster}
    assert sorted(rows(stages[2])) == sorted(r for r in rows(stages[1]) if r[0] in first)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in expected_overlaps(rows(stages[2]), items) if r[5]}
    assert bad and sorted(rows(stages[3])) == sorted(r for r in rows(stages[2]) if r[0] not in bad)
    copies = copies_by_mix(rows(stages[3]))
    assert Counter(r[0] for r in rows(stages[4])) == Counter({i: n for i, n in copies.items() if n})
    from tokenizers import Tokenizer

    whole, start, expected = Tokenizer.from_file(queries.tokenizer_file()), 0, []
    for i, text, _ in sorted(rows(stages[4])):
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 2], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, stages[5].collect())) == expected


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[5].collect()))


EDGE_DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def folder_of(spark, tmp_path, rows, items):
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], EDGE_DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline_of_edge_cases(spark, tmp_path):
    body = lambda k, n=80: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(None, None, None), (1, "", "a"), (2, "few words", "a"), (3, body(3), "a"), (3, body(3), "a"), (4, body(4), None), (None, body(5), "b"), (None, body(5), "b"), (6, body(6, 20000), "a")]
    rows += [(7, body(7) + " alpha beta gamma delta", "b"), (8, body(4), "b"), (9, body(9) + " unseen tail", "a"), (9, "w9x0 " * 200, "a")]
    sf = folder_of(spark, tmp_path, rows, [(None, "alpha beta gamma delta"), (2, None), (3, "")])
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf))
        kept.append(docs.collect())
    named = [Counter((r["doc_id"], len((r["text"] or "").split())) for r in k) for k in kept[:3]]
    quality = Counter({(3, 80): 2, (4, 80): 1, (None, 80): 2, (6, 20000): 1, (7, 84): 1, (8, 80): 1, (9, 82): 1})
    assert named[0] == quality
    single = Counter({(3, 80): 1, (4, 80): 1, (None, 80): 1, (6, 20000): 1, (7, 84): 1, (9, 82): 1})  # 8 is a copy of 4
    assert named[1] == single
    assert named[2] == single - Counter({(7, 84): 1})
    mixed = Counter(r["doc_id"] for r in kept[3])
    assert mixed and set(mixed) <= {3, 4, None, 6, 9} and max(mixed.values()) <= 2
    assert Counter(r["doc_id"] for r in kept[4]) == mixed
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, kept[4]))


#: Names that the stages give to columns of their own.
CLASHING = "_0 _1 _2 _3 _before _held _nth _copies _rows _part _at _id _key _of_id n size taken copies pattern text_key _v_lines words chunk bucket cluster score rank".split()


def test_extra_columns_of_any_name(spark, tmp_path):
    body = lambda k, n=80: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(1, body(1), "en", "a", 1)] * 3 + [(k, body(k), "en", "ab"[k % 2], 1) for k in range(2, 12)]
    docs = spark.createDataFrame(rows, EDGE_DOCS)
    extra = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHING)))
    extra.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    mixed = mixing.repeated(extra)
    assert mixed.columns == extra.columns
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(r["doc_id"] for r in mixing.repeated(docs).collect())
    assert all(r[c] == k for r in mixed.collect() for k, c in enumerate(CLASHING))
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        at = settle(stage(spark, at, str(tmp_path)))
        assert at.count() > 0 and (name == "token_files" or at.columns == extra.columns)


@pytest.mark.parametrize("rows", [[], [(1, None, None)]])
def test_pipeline_of_nothing(spark, tmp_path, rows):
    assert corpus_pipeline.run(spark, folder_of(spark, tmp_path, rows, [])).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, expected = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    # As Python values: a frame would turn whole numbers beside nulls into floats on one side only.
    assert sorted(str(tuple(r)) for r in got.select(columns).collect()) == sorted(map(str, expected.select(*columns).fetchall()))
