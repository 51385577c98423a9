"""Every registered query of the library proper against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from lodestone.jobs import JOBS, flagship

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows_of(frame, columns):
    plain = frame[columns].astype(object)
    return sorted(map(str, plain.where(plain.notna(), None).values.tolist()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(JOBS.sql))
def test_query_equals_its_sql(spark, duck, name):
    got, expected = JOBS.queries[name](spark, SF).toPandas(), duck.sql(JOBS.sql[name]).df()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    assert rows_of(got, columns) == rows_of(expected, columns)


def test_every_query_has_its_sql():
    assert set(JOBS.queries) == set(JOBS.sql)


def test_flagship(spark):
    assert flagship(spark, SF).columns == ["doc_id", "source", "score", "n_strong"]
