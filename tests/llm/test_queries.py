"""The opN_ queries against their SQL, and the pipeline's stages."""

import os

import duckdb
import pytest

import corpus_pipeline
from decklake.llm.queries import ORACLES, QUERIES


def ordered(names, rows):
    k = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(None if r[i] != r[i] else r[i] for i in k) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    db = duckdb.connect()
    for f in os.listdir(sf):
        db.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    df = QUERIES[name](spark, sf)
    cur = db.execute(ORACLES[name])
    assert ordered(df.columns, [tuple(r) for r in df.collect()]) == ordered([d[0] for d in cur.description], cur.fetchall())


def test_pipeline(spark, sf):
    docs = before = corpus_pipeline.documents(spark, sf)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
        if name in ("quality rules", "n-gram Jaccard join"):
            assert docs.select("doc_id").distinct().count() == docs.count() < before.count()
    assert docs.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(docs.columns)


def test_stages_take_empty_documents(spark, sf):
    docs = corpus_pipeline.documents(spark, sf).where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf))
        assert docs.count() == 0
