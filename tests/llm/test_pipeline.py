"""The pipeline stages on whole documents, and the SQL checks."""

import duckdb
from compare import TABLES, rows_of

import corpus_pipeline
from tracewell.llm import queries


def test_stages_keep_clean_documents_and_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.landed(stage(spark, docs, sf), "test")
        after = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
        assert after <= before and len(after) > 0.8 * len(before), name
        if name == "mixing":
            assert after == before
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs, before = out, after
    assert docs.agg({"length": "sum"}).first()[0] > 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_sql_checks(spark, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, sf)
        found = con.execute(sql)
        columns = [c[0] for c in found.description]
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, found.fetchall()), name
