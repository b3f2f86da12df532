"""Core queries against their SQL on the smallest data."""

import os

import pytest

from tarnlake.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def plain(rows):
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(repr(tuple(tidy(v) for v in r)) for r in rows)


@pytest.mark.parametrize("name", ["tokenize_counts", "bm25_topk", "dense_topk", "hybrid_rrf_index", "filter_ne", "filter_range", "chunk_full_lines", "keywords_brief", "snapshot_diff", "upsert_report", "rank_apply_tail"])
def test_query_is_its_sql(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(f"select {', '.join(columns)} from ({Q.ORACLES[name]})").fetchall()
    assert plain(got.select(*columns).collect()) == plain(want) and want


def test_code_chunks_hold_whole_texts(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(800))
    spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [r["label"] for r in Q.code_chunks(spark, str(tmp_path)).collect()]
    assert any("[#2]" in x for x in labels) and all(any(f"word{i}" in x.split() for x in labels) for i in range(790))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
