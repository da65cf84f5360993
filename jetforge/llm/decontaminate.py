"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window is a run of words of a benchmark item; its set is its word shingles. Shingles are ordered
by rarity in the corpus. A document that contains a window contains each of its shingles, so the
necessary prefix is the rarest one: windows meet documents on that shingle alone. The length bound
drops windows with a shingle that the corpus lacks, the positional bound places the window in the
document, and what is left is verified shingle by shingle over the window's whole length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, ids_of, quoted, renamed, stored, words_of

WINDOW = 10  # words of an item in a window
SHINGLE = 3  # words in a shingle; shorter windows are one shingle
BROADCAST_ROWS = 500_000  # benchmark shingles sent to every executor in one pass over the texts
# Fixed value: the characters between words, as a character class.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return words_of(ascii_lower(text), SEPARATORS)


def item_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (``w``, ``len``, ``shingles``), and the items of each (``w``, ``item``).

    Items without words have no window. A null item id counts for hits but is not listed.
    """
    items = benchmark.select(quoted(item_col).alias("item"), _words(quoted(text_col)).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    spread = items.withColumn("len", length).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)))
    cut = stored(spread.select("item", "len", F.slice("words", F.col("at"), F.col("len")).alias("words")), "item-windows")
    size = F.least(F.col("len"), F.lit(SHINGLE))
    shingles = F.transform(F.sequence(F.lit(1), F.col("len") - size + 1), lambda i: F.array_join(F.slice("words", i, size), " "))
    windows = stored(cut.select("words", "len").distinct().withColumn("w", F.monotonically_increasing_id()).withColumn("shingles", shingles), "windows")
    return windows.drop("words"), cut.join(windows.select("words", "w"), "words").select("w", "item").distinct()


def _hits(docs: DataFrame, keys: DataFrame, sizes: list[int], id_cols: tuple[str, ...], text_col: str) -> DataFrame:
    """Every place where one of the shingles occurs, and one row (without a shingle) at the start
    of each document: ``_row``, id columns, ``n_words``, ``pos``, ``sid``. Only rows that meet a
    shingle leave the pass over the texts."""
    rows = docs.select(*ids_of(docs, id_cols), F.monotonically_increasing_id().alias("_row"), _words(quoted(text_col)).alias("_words"))
    rows = rows.select("*", F.size("_words").alias("n_words"), F.posexplode_outer("_words").alias("pos", "_w"))
    word = [F.col("_w"), *(F.get("_words", F.col("pos") + k) for k in range(1, SHINGLE))]
    hashes = [F.when(F.col("pos") + n <= F.col("n_words"), F.xxhash64(F.lit(n), *word[:n])) for n in sizes]
    rows = rows.withColumn("_h", hashes[0] if len(hashes) == 1 else F.explode_outer(F.array_compact(F.array(*hashes))))
    # Rows meet by hash; the words then have to be the same.
    same = F.lit(True)
    for k in range(SHINGLE):
        same = same & ((F.col("_n") <= k) | (word[k] == F.col(f"_b{k}")))
    met = rows.join(F.broadcast(keys), "_h", "left").withColumn("sid", F.when(same, F.col("_sid")))
    ids = [c for c in rows.columns if c.startswith("_id")]
    return met.where("sid is not null or pos is null or pos = 0").select(*ids, "_row", "n_words", "pos", "sid")


def _corpus_hits(docs: DataFrame, shingles: DataFrame, id_cols: tuple[str, ...], text_col: str) -> DataFrame:
    """One pass over the texts for each BROADCAST_ROWS shingles; for several, ids and texts are
    written first."""
    sizes = sorted(r[0] for r in shingles.select("size").distinct().collect())
    blocks = max(1, -(-shingles.count() // BROADCAST_ROWS))
    parts = F.split("shingle", " ")
    words = [F.get(parts, F.lit(k)).alias(f"_b{k}") for k in range(SHINGLE)]
    # xxhash64 passes over nulls: the hash of a short shingle is that of its words.
    keys = shingles.select(F.col("sid").alias("_sid"), F.col("size").alias("_n"), *words).withColumn(
        "_h", F.xxhash64("_n", *[f"_b{k}" for k in range(SHINGLE)]))
    found = None
    if blocks > 1:  # a row keeps its number over the passes only if the rows are a table
        docs = stored(docs.select(*[quoted(c) for c in dict.fromkeys((*id_cols, text_col))]), "numbered")
    for block in range(blocks):
        some = keys if blocks == 1 else keys.where(F.pmod("_h", F.lit(blocks)) == block)
        hits = _hits(docs, some, sizes or [SHINGLE], id_cols, text_col)
        found = hits if found is None else found.unionByName(hits.where("sid is not null"))
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text",
                  item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """One row per document: id columns, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of digits, a-z (after A-Z are lower-cased) and characters beyond ASCII. A
    document word inside any occurrence of a window is hit; ``items_sha256`` is over the item ids
    whose windows occur, sorted as strings and comma-joined. A null text has no words. Repeated
    documents are rows of their own; repeated items are one. Without items nothing is hit; without
    documents there are no rows. Extra columns of either table are ignored.
    """
    windows, owners = item_windows(benchmark, item_col=item_col, window=window)
    flat = windows.select("w", "len", F.posexplode("shingles").alias("offset", "shingle"))
    shingles = flat.select("shingle", F.size(F.split("shingle", " ")).alias("size")).distinct()
    shingles = stored(shingles.withColumn("sid", F.monotonically_increasing_id()), "shingles")
    found = stored(_corpus_hits(docs, shingles, id_cols, text_col), "shingle-hits")
    hits = found.where("sid is not null").select("_row", "n_words", "pos", "sid")

    rarity = hits.groupBy("sid").agg(F.count(F.lit(1)).alias("seen"))
    # Length bound: every shingle of the window has to occur somewhere.
    ordered = flat.join(shingles, "shingle").join(rarity, "sid").groupBy("w", "len").agg(
        F.count(F.lit(1)).alias("present"), F.min(F.struct("seen", "sid", "offset")).alias("rarest"),
        F.collect_list(F.struct("offset", "sid")).alias("parts"))
    whole = ordered.where(F.col("present") == F.greatest(F.col("len") - SHINGLE + 1, F.lit(1)))
    prefix = stored(whole.select("w", "len", F.col("rarest.sid").alias("sid"), F.col("rarest.offset").alias("offset"), "parts"), "prefixes")
    places = hits.join(prefix, "sid").withColumn("start", F.col("pos") - F.col("offset"))
    places = places.where("start >= 0 and start + len <= n_words")
    wanted = places.select("_row", "w", "start", "len", F.inline("parts").alias("part", "sid")).withColumn("pos", F.col("start") + F.col("part"))
    proved = (
        wanted.join(hits.drop("n_words"), ["_row", "pos", "sid"]).groupBy("_row", "w", "start", "len").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == F.greatest(F.col("len") - SHINGLE + 1, F.lit(1)))
    )
    proved = stored(proved.select("_row", "w", "start", (F.col("start") + F.col("len")).alias("end")), "proved")

    # Words covered by overlapping windows count once; a document's windows are bounded by its text.
    runs = proved.groupBy("_row", "start").agg(F.max("end").alias("end"))
    order = Window.partitionBy("_row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(order), F.col("start"))), F.lit(0))
    covered = runs.withColumn("fresh", fresh).groupBy("_row").agg(F.sum("fresh").cast("long").alias("hit"))
    listed = proved.select("_row", "w").distinct().join(owners.where("item is not null"), "w").select("_row", F.col("item").cast("string").alias("item")).distinct()
    listed = listed.groupBy("_row").agg(F.array_sort(F.collect_list("item")).alias("items"))

    n_hit, items = F.coalesce("hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    base = found.where("sid is null or pos = 0").dropDuplicates(["_row"]).drop("pos", "sid")
    return base.join(covered, "_row", "left").join(listed, "_row", "left").select(
        *renamed(id_cols), F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without a benchmark window, with all their columns. Being hit follows from the
    text alone, so documents meet the list of hit texts by digest; a null text is never hit."""
    digest = F.md5(quoted(text_col))
    keyed = docs.select(digest.alias("digest"), quoted(text_col).alias("text"))
    hit = stored(contamination(keyed, benchmark, ("digest",)).where("contaminated").select("digest").distinct(), "hit-texts")
    return docs.join(hit, digest == hit["digest"], "left_anti")
