"""Every query that has SQL gives the same rows as DuckDB."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from gridseek.queries import ORACLE_SQL, QUERIES  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert QUERIES.keys() - ORACLE_SQL.keys() == {"spectral_stats", "microscope_effects", "encoded_pictures", "ransac_fit"}


@pytest.mark.parametrize("name", ["spectral_stats", "microscope_effects", "encoded_pictures", "ransac_fit"])
def test_rows(name, spark, sf):
    rows = QUERIES[name](spark, sf).collect()
    assert rows and sorted(map(repr, rows)) == sorted(map(repr, QUERIES[name](spark, sf).collect()))
    assert name != "ransac_fit" or all(r["success"] and 2 * r["inliers"] > r["matches"] for r in rows if r["matches"] >= 15)


def test_entry(spark):
    import __spark_entry__

    row = __spark_entry__.entry(spark).first()
    assert (row["out_r"], row["out_c"], round(row["score"], 6)) == (7, 4, 1.0)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(name, spark, sf, duck):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    mine = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    assert mine == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
