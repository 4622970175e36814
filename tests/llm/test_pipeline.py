"""The stages one after another, and the queries in the driver's registry."""

import duckdb

import __spark_entry__
import corpus_pipeline
from quantgrid.llm import lines
from quantgrid.llm.queries import QUERIES


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, seen = {r.doc_id for r in docs.select("doc_id").collect()}, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf))
        assert docs.columns == corpus_pipeline.COLUMNS, name
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(set(ids)) == len(ids) and set(ids) <= before
        before = set(ids)
        seen.append(len(ids))
    assert seen[0] >= seen[1] > seen[2] >= seen[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == before
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = corpus_pipeline.keep_good(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    assert sum((i in kept) == (q == 1) for i, q in labels.items()) >= 0.97 * len(labels)


def test_odd_tables(spark, odd, empty, sf):
    for table, n in ((odd, 1), (empty, 0)):
        docs = table
        for _, stage in corpus_pipeline.STAGES[1:]:
            docs = corpus_pipeline.materialise(stage(spark, docs, sf))
        assert (docs.count() > 0) == bool(n)


def test_line_dedup_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = QUERIES["op3_levelled_line_dedup"](spark, sf)
    cur = con.execute(lines.OP3_SQL)
    assert [d[0] for d in cur.description] == got.columns
    assert sorted(cur.fetchall()) == sorted(tuple(r) for r in got.collect())


def test_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in names} and "pipeline" in names
