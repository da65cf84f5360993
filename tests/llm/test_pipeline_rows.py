"""The pipeline's stages on odd rows and clashing column names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from jetforge.llm import decontaminate
from jetforge.llm.common import stored

CLASHES = ["_key", "_digest", "_n", "shard", "slot", "doc", "position", "passes", "_id0", "_row", "_text", "digest", "hit", "size"]


@pytest.fixture(scope="module")
def odd_docs(spark, sf):
    """Real documents, nulls, repeated rows, a very long text, with columns of the stages' own names."""
    base = spark.read.parquet(f"{sf}/documents.parquet").limit(120).collect()
    rng = random.Random(2)
    words = [w for r in base if r.lang == "en" for w in r.text.split()]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in base]
    long_text = " ".join(rng.choices(words, k=60_000))
    rows += [rows[3], rows[3], (None, rows[5][1], "en", None, None), (9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, long_text, "en", "s", len(long_text))]
    frame = spark.createDataFrame([(*r, *[f"keep {i} {c}" for c in CLASHES]) for i, r in enumerate(rows)],
                                  "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))
    return stored(frame, "odd-docs")


def test_stages_keep_columns_of_any_name(spark, sf, odd_docs):
    docs, given = odd_docs, {tuple(r) for r in odd_docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, sf), "stage")
        assert docs.columns[:len(odd_docs.columns)] == odd_docs.columns, name
        rows = {tuple(r)[:len(odd_docs.columns)] for r in docs.collect()}
        assert rows <= given and rows, name
        if name == "quality rules":
            assert {r[0] for r in rows} >= {9003} and not {r[0] for r in rows} & {9001, 9002}
        if name == "near duplicates":
            kept = docs.groupBy(F.md5("text").alias("t")).count()
            assert kept.where("count > 1").count() == 0 and rows <= {tuple(r) for r in before.collect()}
    assert docs.columns[-2:] == ["shard_", "slot_"]
    assert {r["shard_"] for r in docs.collect()} <= set(range(16))


def test_decontamination_in_blocks_of_a_shuffled_plan(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7).select("doc_id", "text")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.contamination(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 2000)
    assert sorted(map(tuple, decontaminate.contamination(docs, items).collect())) == want
