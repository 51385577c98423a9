"""Lexicons as tables against brute force, in one automaton and in several."""

from __future__ import annotations

import pickle
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.operators import automata

SF = "/root/testdata/sf0.01"


def non_overlapping(text, sizes, terms):
    out, free = Counter(), {}
    for end in range(1, len(text) + 1):
        for n in sizes:
            if end >= n and (t := text[end - n : end]) in terms and end - n >= free.get(t, 0):
                free[t] = end
                out[t] += 1
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.lower("text").alias("low"))
    return docs, {r["doc_id"]: r["low"] for r in docs.collect()}


@pytest.mark.parametrize("block_bytes", [4 << 20, 300_000])
def test_a_hundred_thousand_terms_against_brute_force_and_sql(spark, corpus, monkeypatch, block_bytes):
    monkeypatch.setattr(automata, "BLOCK_BYTES", block_bytes)
    docs, texts = corpus
    rng, terms = random.Random(3), set()
    whole = [t for t in texts.values() if t and len(t) > 100]
    while len(terms) < 100_000:
        t = rng.choice(whole)
        at = rng.randrange(len(t) - 8)
        terms.add(t[at : at + rng.randint(5, 8)])
    lexicon = spark.createDataFrame([("l", t, 1.0) for t in sorted(terms)], "lexicon string, term string, weight double")
    got = {(r["doc_id"], r["term"]): r["n"] for r in automata.term_counts(docs, "low", lexicon, ["doc_id"]).collect()}
    expected = {(i, t): n for i, text in texts.items() for t, n in non_overlapping(text or "", range(5, 9), terms).items()}
    assert len(terms) == 100_000 and got == expected
    con = duckdb.connect()
    some = rng.sample(sorted(terms), 40)
    con.execute("CREATE TABLE t AS SELECT unnest($1) AS term", [some])
    sql = f"SELECT doc_id, term, (length(l) - length(replace(l, term, ''))) // length(term) AS n FROM (SELECT doc_id, lower(text) AS l FROM '{SF}/documents.parquet'), t WHERE contains(l, term)"
    assert {(i, t): n for i, t, n in con.sql(sql).fetchall()} == {k: n for k, n in expected.items() if k[1] in set(some)}


@pytest.mark.parametrize("block_bytes", [4 << 20, 8])
def test_scores_of_several_lexicons(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(automata, "BLOCK_BYTES", block_bytes)
    docs = [(1, "red redder red"), (2, None), (3, ""), (4, "blue, red; Blue"), (4, "blue, red; Blue"), (5, "xred red-blue bluered aaaa")]
    rows = [("warm", "red", 2.0), ("cold", "blue", 3.0), ("all", "red", 1.0), ("all", "blue", 1.0), ("all", "blue", 1.0), ("none", "aa", 5.0), ("none", "", 9.0), ("none", None, 9.0), (None, "redder", 1.0)]
    frame, lexicon = spark.createDataFrame(docs, "doc_id long, low string"), spark.createDataFrame(rows, "lexicon string, term string, weight double")

    def expected(whole, cap=2):
        out = []
        for i, text in docs:
            by = {}
            for name, term, weight in set(rows):
                if term:
                    n = len(re.findall(rf"(?<![a-z]){term}(?![a-z])" if whole else term, text or ""))
                    if n:
                        s, k = by.get(name, (0.0, 0))
                        by[name] = (s + weight * min(n, cap), k + 1)
            out += [(i, name, s, k) for name, (s, k) in by.items()]
        return sorted(out, key=str)

    for whole in (False, True):
        got = automata.lexicon_scores(frame, "low", lexicon, ["doc_id"], 2, inside=automata.LETTERS if whole else "")
        assert sorted(map(tuple, got.collect()), key=str) == expected(whole)
    assert automata.lexicon_scores(frame, "low", lexicon.where("false"), ["doc_id"], 2).count() == 0
    assert automata.term_counts(frame.where("false"), "low", lexicon, ["doc_id"]).count() == 0


def test_what_a_worker_keeps_of_an_automaton_is_small():
    rng = random.Random(6)
    terms = sorted({"".join(rng.choice("bdglmnrst") + rng.choice("aeiou") for _ in range(rng.randint(3, 5))) for _ in range(20_000)})
    made = automata.Terms([("l", t, float(len(t))) for t in terms])
    held = automata.packed(made)
    assert len(held) < 60 * len(terms) and len(held) < len(pickle.dumps(made)) / 2
    assert len({id(w) for w in made.weights}) == len({len(t) for t in terms})
    again = automata.unpacked(held)
    assert again.terms == terms and again.counts(" ".join(terms[:50]), frozenset(automata.LETTERS)) == {k: 1 for k in range(50)}
