"""Shards of near-equal bytes by histogram sort.

Rows are ordered by a key. Candidate boundaries (probes) are counted exactly: every partition adds
up the bytes and rows below each probe, the sums narrow the interval of every splitter, and new
probes go only into intervals that are still too wide. When all splitters are settled, the rows
are exchanged once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_of, quoted, renamed, stored

SHARDS = 16
TOLERANCE = 0.002  # of a shard's share of the bytes, for shard boundaries
PIECE_BYTES = 32 << 20  # rows are exchanged in pieces of about this size,
MAX_PIECES = 256  # of which a shard has so many at most: what the driver holds is bounded
LOOSE = 0.25  # of a piece, for boundaries inside a shard
PROBES = 24  # per open boundary and round
MAX_ROUNDS = 64
KEY = 24  # bytes: 8 of the text's digest, 8 of the id's, 8 of the row's number

HISTOGRAM = "bucket int, bytes long, rows long, low binary, high binary"


def _histogram(probes: list[bytes]):
    """Task side: bytes, rows, least and greatest key between neighbouring probes."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(probes, dtype=f"S{KEY}")
        size, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        low, high = [None] * len(size), [None] * len(size)
        for batch in batches:
            keys = np.array(batch.column(0).to_pylist(), dtype=f"S{KEY}")
            bucket = np.searchsorted(edges, keys, side="right")
            order = np.argsort(bucket, kind="stable")
            size += np.bincount(bucket, weights=batch.column(1).to_numpy(zero_copy_only=False), minlength=len(size)).astype(np.int64)
            rows += np.bincount(bucket, minlength=len(size))
            found, first = np.unique(bucket[order], return_index=True)
            for b, part in zip(found.tolist(), np.split(keys[order], first[1:])):
                part = np.sort(part)
                least, most = part[0].ljust(KEY, b"\0"), part[-1].ljust(KEY, b"\0")
                low[b] = least if low[b] is None else min(low[b], least)
                high[b] = most if high[b] is None else max(high[b], most)
        used = [int(b) for b in np.flatnonzero(rows)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(size[used]), pa.array(rows[used]),
             pa.array([low[b] for b in used], pa.binary()), pa.array([high[b] for b in used], pa.binary())],
            names=["bucket", "bytes", "rows", "low", "high"])
    return count


def _spread(low: bytes, high: bytes, n: int) -> set[bytes]:
    """About ``n`` keys evenly spaced over [low, high], both ends and the key after them included:
    what is counted between them lies inside the interval."""
    a, b = int.from_bytes(low, "big"), int.from_bytes(high, "big")
    last = (1 << 8 * KEY) - 1
    return {min(x, last).to_bytes(KEY, "big") for x in (*(a + (b - a) * i // n for i in range(n + 1)), b + 1)}


class Boundaries:
    """Exact counts below every probe so far, and the splitters found from them."""

    def __init__(self, total_bytes: int, shards: int, pieces: int, tolerance: float):
        unit = total_bytes / (shards * pieces)
        self.goals = [(j * unit, (tolerance * unit * pieces if j % pieces == 0 else LOOSE * unit)) for j in range(1, shards * pieces)]
        self.below: dict[bytes, tuple[int, int]] = {}
        self.open = {j: (b"\0" * KEY, b"\xff" * KEY) for j in range(len(self.goals))}
        self.found: dict[int, bytes] = {}

    def probes(self, n: int) -> list[bytes]:
        return sorted(set().union(*(_spread(low, high, n) for low, high in self.open.values())))

    def narrow(self, probes: list[bytes], counted: dict[int, tuple[int, int, bytes, bytes]]) -> None:
        size, rows, at = 0, 0, []
        for b in range(len(probes) + 1):
            got = counted.get(b, (0, 0, None, None))
            at.append((size, *got))
            size, rows = size + got[0], rows + got[1]
            if b < len(probes):
                self.below[probes[b]] = (size, rows)
        starts = np.array([x[0] for x in at], dtype=np.float64)
        for j in list(self.open):
            goal, allowed = self.goals[j]
            b = min(int(np.searchsorted(starts, goal, side="right")) - 1, len(at) - 1)
            start, held, _, low, high = at[b]
            near = [probes[i] for i in (b - 1, b) if 0 <= i < len(probes)]
            best = min(near, key=lambda p: abs(self.below[p][0] - goal), default=None)
            if best is not None and (abs(self.below[best][0] - goal) <= allowed or not held or low == high):
                self.found[j] = best
                del self.open[j]
            else:
                self.open[j] = (low, high)


def split_points(keyed: DataFrame, shards: int, piece_bytes: int, tolerance: float) -> tuple[list[bytes], list[int], list[int]]:
    """Piece boundaries of (``_key``, ``_size``) rows: keys, rows below each, shard of each piece.

    What reaches the driver is one row per probe: shards x MAX_PIECES x PROBES at most.
    """
    total = keyed.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    pieces = min(MAX_PIECES, max(1, -(-total // (shards * piece_bytes))))
    state = Boundaries(total, shards, pieces, tolerance)
    for _ in range(MAX_ROUNDS):
        probes = state.probes(PROBES)
        if not state.open or not probes:
            break
        got = (
            keyed.select("_key", "_size").mapInArrow(_histogram(probes), HISTOGRAM).groupBy("bucket")
            .agg(F.sum("bytes"), F.sum("rows"), F.min("low"), F.max("high")).collect()
        )
        state.narrow(probes, {r[0]: (r[1], r[2], bytes(r[3]), bytes(r[4])) for r in got})
    else:
        raise RuntimeError(f"splitters did not settle in {MAX_ROUNDS} rounds")
    edges = sorted(state.found.get(j, b"\xff" * KEY) for j in range(len(state.goals)))
    rows = [state.below.get(e, (0, 0))[1] for e in edges]
    return edges, rows, [j // pieces for j in range(len(edges) + 1)]


def _piece_of(edges: list[bytes]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.array(edges, dtype=f"S{KEY}")
        for batch in batches:
            keys = np.array(batch.column(batch.schema.get_field_index("_key")).to_pylist(), dtype=f"S{KEY}")
            piece = np.searchsorted(ends, keys, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(piece)], names=[*batch.schema.names, "_piece"])
    return find


def shard(docs: DataFrame, keep_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", key_col: str = "doc_id", shards: int = SHARDS,
          piece_bytes: int = PIECE_BYTES, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: the kept columns, size (UTF-8 bytes + 1), text_crc32, shard and slot.

    The order is that of the text's digest, then the key column's, then the row's number, so equal
    texts lie side by side: they share a shard unless a boundary has to cut through them to keep
    the bytes equal. A boundary misses its goal by ``tolerance`` of a shard at most, or by half a
    document where one document is larger than that. ``slot`` counts rows of a shard from 0 in key
    order. Rows travel once, by piece (a bounded part of a shard); the slot is the count of rows in
    earlier pieces, known from the histogram, plus the rank inside the piece.

    A null text has no bytes (size 1, checksum 0) and stays null; repeated rows and null keys are
    rows of their own. An empty table gives none; with fewer rows than shards some shards are
    empty. Columns that are not kept are ignored.
    """
    text = F.encode(F.coalesce(quoted(text_col), F.lit("")), "UTF-8")
    key = F.concat(
        F.substring(F.unhex(F.md5(text)), 1, 8),
        F.substring(F.unhex(F.md5(F.coalesce(quoted(key_col).cast("string"), F.lit("")))), 1, 8),
        F.unhex(F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")),
    )
    keyed = stored(
        docs.select(*ids_of(docs, keep_cols), (F.length(text) + 1).cast("long").alias("_size"), F.crc32(text).alias("_crc"), key.alias("_key")),
        "shard-keys",
    )
    edges, below, owner = split_points(keyed, shards, piece_bytes, tolerance)
    first = [below[i] for i, j in enumerate(owner[1:]) if j != owner[i]]  # rows below shard 1, 2, ...
    base = [([0, *below][i] - [0, *first][j]) if j <= len(first) else 0 for i, j in enumerate(owner)]
    spark = docs.sparkSession
    pieces = spark.createDataFrame(list(zip(range(len(owner)), owner, base)), "_p int, shard int, _base long")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema.fields)
    rank = F.row_number().over(Window.partitionBy("_piece").orderBy("_key")) - 1
    placed = keyed.mapInArrow(_piece_of(edges), f"{fields}, _piece int").withColumn("_rank", rank)
    # The pieces are shards x MAX_PIECES rows of 16 bytes at most.
    return placed.join(F.broadcast(pieces), F.col("_piece") == F.col("_p")).select(
        *renamed(keep_cols), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard", (F.col("_base") + F.col("_rank")).alias("slot"))
