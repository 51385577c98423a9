"""The Merkle manifest against a plain tree, for sizes around every border of blocks and trees."""

from __future__ import annotations

import os
import random
import zlib
from collections import defaultdict
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import merkle, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def hashed(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return hashed(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([hashed(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def siblings(levels, k):
    out = []
    for level in levels[:-1]:
        run = k // 3 * 3
        out.append([level[run:k], level[k + 1 : run + 3]])
        k //= 3
    return out


def expected(rows):
    """Rows are doc_id, text, lang, source, n_chars."""
    by_source = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        even = doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        shown = text.replace("\n", "") if even else text
        by_source[source].append((doc_id is not None, doc_id, leaf((doc_id, source, lang, n, text)), leaf((doc_id, source, lang, n, shown))))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda r: (r[0], r[1] or 0, r[2]))
        trees[s] = levels_of([r[2] for r in by_source[s]])
    top = levels_of([trees[s][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for k, (_, doc_id, own, shown) in enumerate(by_source[s]):
            sides = siblings(trees[s], k) + siblings(top, place)
            for left, right in sides:
                shown = hashed(*left, shown, *right)
            proof = hashed(*(h for left, right in sides for h in left + right))
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], proof, shown, shown == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def got(frame):
    return sorted((tuple(r) for r in frame.select(COLUMNS).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 50, 243, 244])
def test_missing_nodes_suffice_and_none_is_spare(n):
    rng = random.Random(n)
    levels = levels_of([hashed(str(k)) for k in range(n)])
    for _ in range(10):
        known = set(rng.sample(range(n), rng.randint(1, n)))
        needs = merkle.missing(known, n)
        assert len(set(needs)) == len(needs)
        have, size = {k: levels[0][k] for k in known}, n
        for level in range(len(levels) - 1):
            have |= {k: levels[level][k] for at, k in needs if at == level}
            runs = {k // 3 for k in have}
            # Every run is whole, with what was fetched, and holds something derived.
            assert all(c in have for r in runs for c in range(3 * r, min(3 * r + 3, size)))
            assert all(any((at, c) not in needs for c in range(3 * r, min(3 * r + 3, size))) for r in runs for at in [level])
            have, size = {r: hashed(*(have[c] for c in range(3 * r, min(3 * r + 3, size)))) for r in runs}, -(-size // 3)
        assert have == {0: levels[-1][0]}


def test_query_against_a_plain_tree_and_sql(spark):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    frame = queries.op12_merkle_proofs(spark, SF)
    assert frame.columns == COLUMNS
    assert got(frame) == expected(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    assert sorted(con.sql(merkle.ORACLE).select(*COLUMNS).fetchall(), key=str) == expected(rows)
    assert {r[-1] for r in expected(rows)} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [3], [1, 1], [2, 1, 28, 9, 10, 27, 1], [82] + [1] * 11, [244, 1]])
def test_blocks_of_any_borders(spark, monkeypatch, sizes):
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    rows = [(k * 7 + s, f"text {k}\nof {s}", "en", None if s == 1 else f"é{s}", k) for s, n in enumerate(sizes) for k in range(n)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert got(merkle.prove(docs, digest=True)) == expected(rows)
    proof = merkle.prove(docs).select("doc_id", "source", F.sha2(F.concat_ws("", "proof").cast("binary"), 256).alias("proof_sha256"))
    assert sorted(r["proof_sha256"] for r in proof.collect()) == sorted(r[4] for r in expected(rows))


def test_edges(spark):
    rows = [(1, None, None, None, None), (None, "a\nb", "en", "x", 3), (2, "", "", "", 0), (2, "", "", "", 0), (2, "é\n" * 40000, "en", "x", 1)]
    rows += [(4, "\n", "en", "x", 1)] * 9 + [(4, "other", "en", "x", 1), (5, "no newline", "en", "y", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    clashing = docs.select("*", *(F.lit(1).alias(c) for c in ("tree", "pos", "block", "_at", "_part", "leaf", "hash", "serial", "N")))
    assert got(merkle.prove(clashing, digest=True)) == expected(rows)
    assert merkle.prove(docs.where("false"), digest=True).collect() == []


def test_rows_without_a_change_are_verified_and_others_fail(spark):
    docs = spark.createDataFrame([(k, "a\nb" if k % 3 else "ab", "en", "s", 1) for k in range(60)], DOCS)
    for r in merkle.prove(docs, digest=True).collect():
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["doc_id"] % 3
        assert r["verified"] == (not changed) and (r["folded_root"] == r["root"]) == (not changed)


def test_no_task_folder_is_left_on_the_machine(spark):
    before = set(os.listdir("."))
    merkle.prove(spark.createDataFrame([(1, "a", "en", "s", 1)], DOCS), digest=True).count()
    assert set(os.listdir(".")) == before
