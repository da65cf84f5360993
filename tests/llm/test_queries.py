"""Registered queries against their SQL, and the pipeline's stages."""

import duckdb
import pytest

import corpus_pipeline
from jetforge.llm.common import stored
from jetforge.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for t in "documents pages benchmark labels conversations".split():
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


def canon(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(canon(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(canon(r[c]) for c in cols) for r in df.collect()) == want


def test_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 1 + len(QUERIES)))


def test_pipeline_stages_follow_from_each_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), "stage")
        sizes.append(docs.count())
        assert docs.columns[:5] == columns
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] and sizes[4] == sizes[5]
    assert corpus_pipeline.run(spark, sf).count() == sizes[-1]


def test_pipeline_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), "stage")
        assert docs.count() == 0
