"""Registered queries against SQL, and the pipeline against its stages in plain Python."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402
from gridseek.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf), con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_pipeline(spark, sf, tmp_path):
    from test_operators import plain_components, plain_contamination, plain_fingerprint

    from gridseek.llm import lines, quality

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns, now = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        out = stage(spark, now, sf)
        out.write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        ids = sorted(before)
        if k == 4:
            assert {r["doc_id"] for r in now.collect()} == set(ids)
            break
        assert now.columns == columns
        after = {r["doc_id"]: r["text"] for r in now.collect()}
        if name == "quality classifier":
            scored = quality.score_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()
            assert set(after) == {r["doc_id"] for r in scored}
        elif name == "line dedup":
            assert set(after) == set(ids)
        elif name == "simhash near-dedup":
            assert set(after) == set(plain_components([plain_fingerprint(before[i]) for i in ids], ids))
        else:
            judged = plain_contamination([before[i] for i in ids], bench)
            assert set(after) == {i for i, w in zip(ids, judged) if not w[4]}
    assert corpus_pipeline.run(spark, sf).count() == now.count()
    assert lines.MIN_DOCS == 5
