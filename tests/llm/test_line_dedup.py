"""Line deduplication against a count by hand."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from jetforge.llm import line_dedup

LONG = "this line is long enough to count, it has over forty"
OTHER = "another line that is long enough to be counted here"
SCHEMA = "doc_id long, text string, _pos string, keep int"


def by_hand(rows, min_chars=40, min_docs=5):
    held = defaultdict(set)
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(held[key(x)]) < min_docs
                or doc == max((d for d in held[key(x)] if d is not None), default=None)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


ROWS = ([(i, f"head {i}\n {LONG.upper()}\t\nmiddle\n{LONG}\n") for i in range(1, 9)]
        + [(i, f"{OTHER}\n{i}") for i in range(20, 24)]  # four documents only
        + [(30, f"{LONG}\r"), (30, f"{LONG}\r"), (None, f"{LONG}\n{OTHER}"), (None, None), (31, ""), (32, "\n\n"), (33, "é" * 40), (34, "É" * 40)]
        + [(40, "\n".join([LONG, "x"] * 3000)), (41, f" {LONG}\u0085"), (42, f"{'a' * 39}"), (43, None)])


@pytest.mark.parametrize("limit, small", [(500_000, 1 << 14), (3, 1 << 14), (3, 0)])
def test_lines(spark, limit, small, monkeypatch):
    monkeypatch.setattr(line_dedup, "MAX_SMALL_GROUPS", small)
    docs = spark.createDataFrame([(*r, "clash", 7) for r in ROWS], SCHEMA)
    got = line_dedup.drop_lines(docs, rows_per_task=limit).collect()
    assert sorted((tuple(r) for r in got), key=repr) == by_hand(ROWS)


def test_a_null_document_is_the_fifth(spark):
    rows = [(None, LONG), (1, LONG), (2, LONG), (3, LONG), (4, LONG)]
    got = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_dropped, r.text) for r in got) == [(0, 1, ""), (1, 1, ""), (2, 1, ""), (3, 1, ""), (4, 0, LONG)]


def test_bitmaps_hold_the_text(spark):
    docs = spark.createDataFrame([(*r, "clash", 7) for r in ROWS], SCHEMA)
    maps = line_dedup.keep_bitmaps(docs)
    assert maps.columns == ["doc_id", "n_lines", "n_dropped", "keep"] and maps.count() == len(ROWS)
    one = maps.where("doc_id = 1").first()
    assert [tuple(r) for r in one["keep"]] == [(0, 1), (2, 3), (4, 5)] and one.n_lines == 5 and one.n_dropped == 2
    text = spark.createDataFrame([("a\nb\nc",)], "t string").select(
        line_dedup.kept_text(F.col("t"), F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("stop")), F.struct(F.lit(2).alias("start"), F.lit(3).alias("stop"))))).first()[0]
    assert text == "a\nc"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.drop_lines(docs).count() == 0 and line_dedup.keep_bitmaps(docs).count() == 0


def test_plan_is_native(spark, sf):
    plan = line_dedup.drop_lines(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "rangepartitioning" in plan
