"""Links between texts that share most of their word shingles.

SimHash tiles are fit for a radius of a few bits; texts at a similarity of 0.8 over five-word
shingles differ in up to 18 of 64. Here MinHash bands bring together the texts that can be so
similar, and their whole shingle sets are then compared, tile by tile. Tiles whose set sizes
exclude the similarity never meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components, forest

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 8  # a pair at 0.8 shares a band with a chance of 0.9994, one at 0.5 with 0.14
TILE = 512  # texts in a tile at most,
TILE_SHINGLES = 500_000  # and about so many shingles
COLUMNS = 4096  # shingles counted at once in a tile

_RNG = np.random.default_rng(20)
_FUNCTIONS = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_MIX = _RNG.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_MIX = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: bytes) -> np.ndarray:
    """Distinct shingles of a text as 64-bit hashes; a shorter text is one shingle, one without
    words has none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    seen: dict[bytes, int] = {}
    for w in words:
        if w not in seen:
            seen[w] = xxhash.xxh64_intdigest(w)
    hashes = np.fromiter((seen[w] for w in words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total = _mixed(total + hashes[k:k + len(total)] * _WORD_MIX[k])
    return np.unique(total)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band of the MinHash signature; none for an empty set."""
    if not len(shingles):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[i:i + 1024, None] * _FUNCTIONS[None, :]).min(0))
    return _mixed((least.reshape(BANDS, ROWS) * _BAND_MIX).sum(1)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task side: the text, last column, becomes its shingle set. Four bytes of a hash tell the
    shingles of two texts apart."""
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            found = [np.unique((shingle_set(t.as_py() or b"") >> np.uint64(32)).astype(np.uint32)).view(np.int32) for t in part.column(part.num_columns - 1)]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            values = np.concatenate(found) if found else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(offsets, values)], names=[*part.schema.names[:-1], "shingles"])


def similar(left: list[np.ndarray], right: list[np.ndarray], similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Places (in left, in right) of all pairs of sets at least so similar. Only shingles that both
    sides have are counted, COLUMNS at a time."""
    a, b = (np.concatenate(x) for x in (left, right))
    common = np.intersect1d(a, b)
    rows = [np.repeat(np.arange(len(x), dtype=np.int32), [len(s) for s in x]) for x in (left, right)]
    both = np.zeros((len(left), len(right)), np.float32)
    found = []
    for values, row in zip((a, b), rows):
        at = np.minimum(np.searchsorted(common, values), max(len(common) - 1, 0))
        keep = common[at] == values if len(common) else np.zeros(len(values), bool)
        order = np.argsort(at[keep], kind="stable")
        found.append((at[keep][order], row[keep][order]))
    for start in range(0, len(common), COLUMNS):
        wide = min(COLUMNS, len(common) - start)
        held = []
        for (at, row), n in zip(found, both.shape):
            i, j = np.searchsorted(at, (start, start + wide))
            grid = np.zeros((n, wide), np.float32)
            grid[row[i:j], at[i:j] - start] = 1
            held.append(grid)
        both += held[0] @ held[1].T
    sizes = [np.array([len(s) for s in x]) for x in (left, right)]
    union = sizes[0][:, None] + sizes[1][None, :] - both
    return np.nonzero((union > 0) & (both >= similarity * union - 1e-6 * union))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def side(column, i):
        rows = column[i].values
        lists = rows.field("shingles")
        values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        return rows.field("tx").to_numpy(), [values[x:y] for x, y in zip(ends, ends[1:])]

    for batch in batches:
        for i in range(batch.num_rows):
            (ids, sets), (other, others) = side(batch.column(0), i), side(batch.column(1), i)
            x, y = similar(sets, others)
            edges = forest(ids[x], other[y])
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])


def text_links(texts: DataFrame, fetch) -> DataFrame:
    """Edges (``a``, ``b``) that connect the texts with a similarity of SIMILARITY or more over
    their shingle sets, directly or through others.

    ``texts`` has one row per distinct text: ``_tx`` (its number), ``_n`` (distinct shingles),
    ``_bands`` and what ``fetch`` needs; ``fetch`` takes the rows of some texts and returns their
    columns with ``text``. Texts that share a band are candidates, as are those connected through
    others; a star on the least text of each band keeps that linear. A group of candidates is cut
    into cells by set size, a step being one factor of the similarity, and cells into tiles; a tile
    meets the tiles of its own and the next cell of the group, and yields a spanning forest.
    """
    bands = texts.select("_tx", F.explode("_bands").alias("band"))
    least = bands.groupBy("band").agg(F.min("_tx").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    least = stored(least.select("band", "m"), "bands")
    groups = components(bands.join(least, "band").select(F.col("_tx").alias("a"), F.col("m").alias("b")))
    step = F.floor(F.log("_n") / -math.log(SIMILARITY)).cast("int")
    members = stored(groups.withColumnsRenamed({"node": "_tx", "root": "group"}).join(texts.drop("_bands"), "_tx").withColumn("step", step), "candidates")
    cells = members.groupBy("group", "step").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("_n") / TILE_SHINGLES)).alias("parts"))
    cells = stored(cells, "cells")
    cut = members.join(cells, ["group", "step"]).withColumn("part", F.pmod(F.hash("_tx"), F.col("parts")))
    rows = fetch(stored(cut, "cut")).select("group", "step", "part", F.col("_tx").alias("tx"), F.col("text").cast("binary").alias("text"))
    sets = rows.mapInArrow(_sets, "group long, step int, part long, tx long, shingles array<int>")
    tiles = stored(sets.groupBy("group", "step", "part").agg(F.collect_list(F.struct("tx", "shingles")).alias("rows")), "set-tiles")
    left = tiles.select("group", F.col("step").alias("home"), F.col("part").alias("left_part"), F.col("rows").alias("left"),
                        F.explode(F.array(F.col("step"), F.col("step") + 1)).alias("step"))
    met = left.join(tiles, ["group", "step"]).where("home <> step or left_part <= part").select("left", F.col("rows").alias("right"))
    return met.mapInArrow(_linked, "a long, b long").distinct()
