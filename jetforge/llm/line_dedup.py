"""Line deduplication over the whole corpus, by range-partitioned line hashes.

Every long line becomes a row of two hashes, its document and its position. The rows are
range-partitioned by hash and sorted inside a range by document and position, so that the lines of
a key follow one another with the greatest document in front. One stream over them keeps that
document's lines and marks the others. What comes back is a run-length compressed bitmap of the
kept lines for each document; the texts themselves do not move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import MAX_SMALL_GROUPS, hot_groups
from .common import ascii_lower, quoted, stored

MIN_CHARS = 40  # code points from which a key counts
MIN_DOCS = 5  # documents from which a key is boilerplate
HOT_LINES = 10_000  # lines of a key from which it is counted by document before its rows hear of it
SPACES = " \t\n\x0b\x0c\r"
KEY = ["_h1", "_h2"]


def _lines(text: Column) -> Column:
    """A null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keyed(docs: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """``_doc`` and ``_tx`` (a hash of the text) tell rows apart; ``_text`` is the text."""
    return docs.select(quoted(key_col).alias("_doc"), F.coalesce(F.xxhash64(quoted(text_col)), F.lit(0)).alias("_tx"), quoted(text_col).alias("_text"))


def line_rows(keyed: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(``_h1``, ``_h2``, ``_doc``, ``_tx``, ``_pos``) of every line whose key has ``min_chars``
    code points. The two hashes of a key differ in their seeds: 128 bits together."""
    lines = keyed.select("_doc", "_tx", F.posexplode(_lines(F.col("_text"))).alias("_pos", "_line"))
    keys = lines.select("_doc", "_tx", "_pos", F.btrim("_line", F.lit(SPACES)).alias("_key")).where(F.char_length("_key") >= min_chars)
    keys = keys.withColumn("_key", ascii_lower(F.col("_key")))
    return keys.select(F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("second"), "_key").alias("_h2"), "_doc", "_tx", "_pos")


def _streamed(rows: DataFrame, min_docs: int) -> DataFrame:
    """Lines to drop among keys that fit into a task: one exchange by range of hash, one sort."""
    order = [*KEY, F.desc_nulls_last("_doc"), F.asc("_pos")]
    laid = rows.repartitionByRange(*KEY).sortWithinPartitions(*order)
    of_key = Window.partitionBy(*KEY)
    seen = laid.withColumn("_nth", F.dense_rank().over(of_key.orderBy(F.desc_nulls_last("_doc"))))
    seen = seen.withColumn("_docs", F.max("_nth").over(of_key))
    return seen.where(F.col("_docs") >= min_docs).where("_nth > 1").select("_doc", "_tx", "_pos")


def _counted(rows: DataFrame, small, min_docs: int) -> DataFrame:
    """Lines to drop among the keys that are too frequent for one task: counted by document first,
    then the verdict, a written table, goes to the rows."""
    documents = rows.select(*KEY, "_doc").distinct()
    verdict = documents.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_docs"), F.max("_doc").alias("_last"))
    verdict = stored(verdict.where(F.col("_docs") >= min_docs).select(*KEY, "_last"), "hot-verdicts")
    return rows.join(small(verdict), KEY).where(~F.col("_doc").eqNullSafe(F.col("_last"))).select("_doc", "_tx", "_pos")


def dropped_lines(keyed: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, rows_per_task: int = HOT_LINES) -> DataFrame:
    """(``_doc``, ``_tx``, ``_pos``) of the lines that go."""
    rows = stored(line_rows(keyed, min_chars), "line-hashes")
    hot = hot_groups(rows, KEY, rows_per_task)
    if not hot.count:
        return _streamed(rows, min_docs)
    # Sent to the rows up to MAX_SMALL_GROUPS keys; beyond that a join that splits hot keys.
    small = F.broadcast if hot.count <= MAX_SMALL_GROUPS else lambda table: table
    keys = stored(hot.frame, "hot-lines")
    often = _counted(rows.join(small(keys), KEY, "left_semi"), small, min_docs)
    return _streamed(rows.join(small(keys), KEY, "left_anti"), min_docs).unionByName(often)


def _marked(docs: DataFrame, key_col: str, text_col: str, min_chars: int, min_docs: int, rows_per_task: int, carry: list[Column]) -> DataFrame:
    """Every row of the documents with ``_lines``, ``_keep`` (see keep_bitmaps) and ``carry``."""
    keyed = _keyed(docs, key_col, text_col)
    lines = dropped_lines(keyed, min_chars, min_docs, rows_per_task)
    # Repeated rows of a document bring the same positions: a set takes them once.
    gone = lines.groupBy("_doc", "_tx").agg(F.sort_array(F.collect_set("_pos")).alias("_gone"))
    # Runs: a place starts one unless the place before is gone too, and ends one likewise.
    first = F.filter("_gone", lambda p, i: (i == 0) | (F.get("_gone", i - 1) < p - 1))
    last = F.filter("_gone", lambda p, i: (i == F.size("_gone") - 1) | (F.get("_gone", i + 1) > p + 1))
    gone = gone.select(F.col("_doc").alias("_d"), F.col("_tx").alias("_t"), first.alias("_first"), last.alias("_last"))
    thin = docs.select(quoted(key_col).alias("_doc"), F.coalesce(F.xxhash64(quoted(text_col)), F.lit(0)).alias("_tx"),
                       F.size(_lines(quoted(text_col))).alias("_lines"), *carry)
    met = thin.join(gone, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_tx") == F.col("_t")), "left")
    starts = F.concat(F.array(F.lit(0)), F.transform(F.coalesce("_last", F.array().cast("array<int>")), lambda p: p + 1))
    stops = F.concat(F.coalesce("_first", F.array().cast("array<int>")), F.array(F.col("_lines")))
    runs = F.filter(F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("stop"))), lambda r: r["start"] < r["stop"])
    return met.withColumn("_keep", runs).drop("_d", "_t", "_first", "_last")


def _n_dropped() -> Column:
    kept = F.aggregate("_keep", F.lit(0), lambda n, r: n + r["stop"] - r["start"])
    return (F.col("_lines") - kept).cast("long")


def keep_bitmaps(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                 rows_per_task: int = HOT_LINES) -> DataFrame:
    """One row per document: its key, n_lines, n_dropped and ``keep``, the bitmap of the kept lines
    as runs (start, stop exclusive; from 0). Texts are read, but not moved.

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of
    ``min_chars`` code points or more that stand in ``min_docs`` documents or more lose all their
    lines but those of the document with the greatest key holding them. Documents are told apart by
    their key: rows of one key are one document when counted, and null is a document below all
    others. A null or empty text has one empty line. Repeated rows are rows of their own with equal
    bitmaps; an empty table gives none. Other columns are ignored.
    """
    rows = _marked(docs, key_col, text_col, min_chars, min_docs, rows_per_task, [])
    return rows.select(F.col("_doc").alias(key_col), F.col("_lines").cast("long").alias("n_lines"), _n_dropped().alias("n_dropped"), F.col("_keep").alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The kept lines of a text, joined by line feeds. The text is split once: inside the lambda of
    the runs, the lines are a variable."""
    cut = lambda lines: F.flatten(F.transform(keep, lambda r: F.slice(lines, r["start"] + 1, r["stop"] - r["start"])))
    return F.array_join(F.get(F.transform(F.array(_lines(text)), cut), F.lit(0)), "\n")


def drop_lines(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
               rows_per_task: int = HOT_LINES) -> DataFrame:
    """One row per document: its key, n_lines, n_dropped and ``text``, the lines that stay (empty if
    none). Here the texts move once to meet their bitmaps; cases as in ``keep_bitmaps``."""
    rows = _marked(docs, key_col, text_col, min_chars, min_docs, rows_per_task, [quoted(text_col).alias("_text")])
    text = F.when(_n_dropped() == 0, F.coalesce("_text", F.lit(""))).otherwise(kept_text(F.col("_text"), F.col("_keep")))
    return rows.select(F.col("_doc").alias(key_col), F.col("_lines").cast("long").alias("n_lines"), _n_dropped().alias("n_dropped"), text.alias("text"))
