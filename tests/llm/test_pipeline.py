"""The stages on a small table, and the registered SQL on sf0.001."""

import duckdb

import __spark_entry__ as E
import corpus_pipeline


def test_stages_keep_columns_and_the_registry_is_whole(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), f"test_{name}")
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == n
    names = set(E.queries())
    assert "pipeline" in names and all(any(q.startswith(f"op{i}_") for q in names) for i in range(1, 11))


def test_exact_dedup_matches_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    df = E.queries()["op3_exact_dedup"](spark, sf)
    rel = con.sql(f"SELECT {', '.join(df.columns)} FROM ({E.oracle_sql()['op3_exact_dedup']})")
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())
