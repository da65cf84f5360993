"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are laid into tiles by their population counts; tiles whose counts differ by
more than the radius cannot hold a pair within it and are never brought together. The others are
compared whole, with exclusive-or and bit counts over numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_of, quoted, renamed, stored
from .components import components, forest
from .overlap import band_keys, shingle_set, text_links

RADIUS = 2
SHINGLE = 3
SEED = 42
LANES = 4  # the count is taken of each 16-bit lane: the lanes' differences add up to a lower bound
SIGNED_AT_ONCE = 200  # texts whose signatures a task holds
TILE = 1024  # fingerprints in a tile at most
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits: a bit is set if it is set in over half the shingles' XXH64."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(len(words) - shingle + 1, 1)
    last = (ends[min(shingle, len(words)) - 1:] - 1).tolist()
    digest, seed = xxhash.xxh64_digest, SEED
    hashes = np.frombuffer(b"".join([digest(joined[i:j], seed) for i, j in zip(starts[:n].tolist(), last)]), np.uint8).reshape(n, 8)
    votes = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        prints = np.array([fingerprint(t.as_py() or b"") for t in texts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints)], names=[*batch.schema.names[:-1], "_fp"])


def fingerprints(docs: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Private id columns and ``_fp`` (the fingerprint as a signed long); a null text has zero."""
    thin = docs.select(*ids_of(docs, id_cols), quoted(text_col).cast("binary").alias("_text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in thin.schema.fields[:-1])
    return thin.mapInArrow(_fingerprints, f"{fields}, _fp long")


def _lane_counts() -> list:
    lane = [F.shiftrightunsigned("_fp", 16 * k).bitwiseAND(0xFFFF) for k in range(LANES)]
    return [F.bit_count(x).cast("int") for x in lane]


def _near_cells(radius: int) -> list[tuple[int, ...]]:
    """Differences between lane counts that a pair within the radius can have, one of each two
    directions."""
    grid = np.stack(np.meshgrid(*[np.arange(-radius, radius + 1)] * LANES, indexing="ij"), -1).reshape(-1, LANES)
    return [tuple(int(x) for x in d) for d in grid if np.abs(d).sum() <= radius and tuple(d) >= (0,) * LANES]


def _forest(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Edges of a spanning forest of the pairs within the radius: no more than fingerprints, however
    many pairs there are."""
    found = []
    for i in range(0, len(left), 256):
        x, y = np.nonzero(np.bitwise_count(left[i:i + 256, None] ^ right[None, :]) <= radius)
        pairs = np.stack([left[i + x], right[y]])
        found.append(pairs[:, pairs[0] != pairs[1]])
    pairs = np.concatenate(found, 1)
    return forest(pairs[0], pairs[1]).view(np.int64)


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty((0, 2), np.int64)]
            for left, right in zip(batch.column(0), batch.column(1)):
                found.append(_forest(left.values.to_numpy().view(np.uint64), right.values.to_numpy().view(np.uint64), radius))
            edges = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])
    return run


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (``a``, ``b``) that connect exactly the distinct ``_fp`` within ``radius`` bits of one
    another, directly or through others.

    A cell is one combination of lane counts, 17 to the power of LANES at most. A cell's rows are
    cut into tiles of TILE rows; tiles meet the tiles of the same and of near cells through a join
    on the cell, once for each two.
    """
    cells = prints.select("_fp", F.array(*_lane_counts()).alias("cell"))
    counts = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    # Bounded by the number of cells (83,521), whatever the input.
    cut = cells.join(F.broadcast(counts), "cell").withColumn("part", F.pmod(F.xxhash64("_fp"), F.ceil(F.col("n") / TILE)))
    tiles = stored(cut.groupBy("cell", "part").agg(F.collect_list("_fp").alias("fps")), "tiles")
    near = [F.array(*[F.element_at("cell", k + 1) + d for k, d in enumerate(step)]) for step in _near_cells(radius)]
    left = tiles.select(F.col("part").alias("left_part"), F.col("fps").alias("left"), F.col("cell").alias("home"), F.explode(F.array(*near)).alias("cell"))
    met = left.join(tiles, "cell").where("home <> cell or left_part <= part").select("left", F.col("fps").alias("right"))
    return met.mapInArrow(_compare(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: id columns, ``fingerprint`` (16 hex digits) and ``component_id``, the
    least first id column of the documents reachable over links of at most ``radius`` bits.

    Exact copies fall together before any comparison. A null text and one without words have
    fingerprint zero, linked like any other. Null ids do not count for the least; a component of
    null ids only has null. Repeated rows are rows of their own. An empty table gives none.
    """
    prints = stored(fingerprints(docs, id_cols, text_col), "fingerprints")
    rooted = _rooted(prints, radius)
    least = stored(rooted.groupBy("_root").agg(F.min("_least").alias("component_id")), "component-least")
    named = stored(rooted.join(least, "_root").select("_fp", "component_id"), "named")
    return prints.join(named, "_fp").select(*renamed(id_cols), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(prints: DataFrame, radius: int, more: DataFrame | None = None) -> DataFrame:
    """Distinct fingerprints with their component's root and the least id that has them; ``more``
    are further edges between fingerprints."""
    distinct = stored(prints.groupBy("_fp").agg(F.min("_id0").alias("_least")), "distinct-fingerprints")
    found = links(distinct, radius)
    roots = components(found if more is None else found.unionByName(more))
    met = distinct.join(roots, distinct["_fp"] == roots["node"], "left")
    return stored(met.select("_fp", "_least", F.coalesce("root", "_fp").alias("_root")), "rooted")


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task side: fingerprint, number of distinct shingles and band keys of a text, the last column."""
    for batch in batches:
        for i in range(0, batch.num_rows, SIGNED_AT_ONCE):
            part = batch.slice(i, SIGNED_AT_ONCE)
            prints, sizes, bands = [], [], []
            for t in part.column(part.num_columns - 1):
                text = t.as_py() or b""
                shingles = shingle_set(text)
                prints.append(fingerprint(text))
                sizes.append(len(shingles))
                bands.append(band_keys(shingles))
            prints = np.array(prints, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(prints), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                                             names=[*part.schema.names[:-1], "_fp", "_n", "_bands"])


def keep_one(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One document of each group of near-duplicates with all its columns: that with the least key
    (null first), of equal keys the one with the least digest, of repeated rows one.

    Documents are linked if their fingerprints are within ``radius`` bits, as in
    ``near_duplicates``, or if their sets of five-word shingles have a Jaccard similarity of 0.8 or
    more (``overlap.text_links``); a group is what links connect. Texts without words are one
    group. Only keys, digests, fingerprints and band keys are written for all documents; the
    documents move once to meet their verdict and once to be compared with candidates.
    """
    digest = F.coalesce(F.md5(quoted(text_col)), F.lit(""))
    # A key without nulls, so that join and window share their exchange.
    plain = lambda key: F.coalesce(F.concat(F.lit("0"), key.cast("string")), F.lit("1"))
    keyed = docs.select(F.struct(quoted(key_col).alias("key"), digest.alias("digest")).alias("_id0"),
                        F.xxhash64(quoted(text_col)).alias("_tx"), quoted(text_col).cast("binary").alias("_text"))
    key_type = keyed.schema["_id0"].dataType.simpleString()
    prints = stored(keyed.mapInArrow(_signed, f"_id0 {key_type}, _tx long, _fp long, _n long, _bands array<long>"), "fingerprints")
    texts = prints.groupBy("_tx").agg(F.min("_id0").alias("_id0"), F.first("_fp").alias("_fp"), F.first("_n").alias("_n"), F.first("_bands").alias("_bands"))
    texts = stored(texts, "texts")
    # The document goes along as one column: its own columns may have any names.
    marked = docs.select(plain(quoted(key_col)).alias("_key"), digest.alias("_digest"), F.struct(*[quoted(c) for c in docs.columns]).alias("_doc"))
    plain_texts = docs.select(plain(quoted(key_col)).alias("_key"), digest.alias("_digest"), quoted(text_col).alias("text"))

    def fetch(some: DataFrame) -> DataFrame:
        some = some.withColumn("_key", plain(F.col("_id0.key"))).withColumn("_digest", F.col("_id0.digest"))
        return some.join(plain_texts, ["_key", "_digest"]).dropDuplicates(["_key", "_digest"])

    pairs = text_links(texts.select("_tx", "_id0", "_n", "_bands"), fetch)
    number = texts.select("_tx", "_fp")
    pairs = pairs.join(number.select(F.col("_tx").alias("a"), F.col("_fp").alias("_a")), "a").join(number.select(F.col("_tx").alias("b"), F.col("_fp").alias("_b")), "b")
    kept = _rooted(prints, radius, pairs.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).groupBy("_root").agg(F.min("_least").alias("least"))
    kept = stored(kept.select(plain(F.col("least.key")).alias("_key"), F.col("least.digest").alias("_digest")).distinct(), "kept")
    first = F.row_number().over(Window.partitionBy("_key", "_digest").orderBy("_digest"))
    return marked.join(kept, ["_key", "_digest"], "left_semi").withColumn("_n", first).where("_n = 1").select("_doc.*")
