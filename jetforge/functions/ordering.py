"""Ranks, running sums, lags and exact quantiles that survive a hot group.

A window needs its whole partition in one task. That is fine for most groups, but a group holding
a large share of all rows would become one straggler. Every helper here therefore looks at group
sizes first. Groups within ``rows_per_task`` use the plain built-in window or aggregate. Larger
groups are cut into ordered buckets, windows run inside a bucket, and the totals of the buckets
before it (a table of at most a few thousand rows per group) are added back. The result is the
same whatever the bucket edges are.

Bucket edges are approximate quantiles that are actual data values. A value equal to an edge gets
a bucket of its own, so the open buckets between edges stay small even when many rows tie; tied
rows are spread by edges on the unique tie-break key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .hashing import HASH_BITS, hash60

ROWS_PER_TASK = 500_000
MAX_EDGES = 1024
# Largest number of hot groups whose edges are broadcast (edges: MAX_EDGES doubles each at most).
MAX_BROADCAST_GROUPS = 1_000
# Bits of a row's hash that may name its bucket: beyond them only equal hashes are left.
MAX_BUCKET_BITS = 40
# Offset rows (a few numbers each) that are broadcast at most.
MAX_HASH_ROWS = 1 << 18
# Hash buckets of the first look for hot groups; a second look takes more where the table is huge.
SCREEN_BUCKETS = 1 << 16
# Groups up to this many meet their rows by broadcast.
MAX_SMALL_GROUPS = 1 << 14

_B = "_bucket"


@dataclass(frozen=True)
class HotGroups:
    """Groups above the row limit: how many, the largest, and the groups themselves."""
    count: int
    largest: int
    frame: DataFrame | None


def hot_groups(df: DataFrame, groups: Sequence[str], rows_per_task: int = ROWS_PER_TASK,
               sizes: DataFrame | None = None) -> HotGroups:
    """Find groups too large for one task: more than ``rows_per_task`` rows, whatever the size of the
    table. Only a few numbers reach the driver.

    ``sizes`` may give (groups..., n) from a cheaper source; any upper bound on the true sizes will
    do. Otherwise rows are first counted by a hash of the group: the partial counts are small even
    for billions of groups, and where no hash bucket is over the limit no group can be. Where the
    buckets are over it merely because the table is huge, a second look takes as many as the rows
    ask for. Exact counts are taken only inside the buckets that are still over the limit. At most
    one group for each ``rows_per_task`` rows can be hot.
    """
    if not groups:
        n = (sizes.agg(F.sum("n").alias("n")) if sizes is not None else df.agg(F.count("*").alias("n"))).first()["n"] or 0
        return HotGroups(int(n > rows_per_task), int(n), None)
    table = sizes
    if sizes is None:
        n_buckets = SCREEN_BUCKETS
        while True:
            keyed = df.select(*groups, F.pmod(F.xxhash64(*groups), F.lit(n_buckets)).alias("_s"))
            buckets = keyed.groupBy("_s").agg(F.count("*").alias("n"))
            row = buckets.agg(F.max("n").alias("m"), F.sum("n").alias("t")).first()
            if (row["m"] or 0) <= rows_per_task:
                return HotGroups(0, row["m"] or 0, None)
            enough = 4 * row["t"] // rows_per_task  # a bucket of other groups then holds a quarter of the limit
            if enough <= n_buckets:
                break
            n_buckets = enough
        full = stored(buckets.where(F.col("n") > rows_per_task).select("_s"), "full-buckets")
        full = F.broadcast(full) if full.count() <= MAX_HASH_ROWS else full
        table = keyed.join(full, "_s", "left_semi").groupBy(*groups).agg(F.count("*").alias("n"))
    hot = table.where(F.col("n") > rows_per_task)
    row = hot.agg(F.count("*").alias("c"), F.max("n").alias("m")).first()
    if not row["c"]:
        return HotGroups(0, row["m"] or 0, None)
    return HotGroups(row["c"], row["m"] or 0, hot.select(*groups))


def attach(rows: DataFrame, per_group: DataFrame, keys: Sequence[str], *, rows_per_task: int = ROWS_PER_TASK,
           probe: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Left join of a one-row-per-group table back to the rows of the groups.

    A co-partitioned join would put a hot group into one task, and the adaptive skew join does not
    apply when a side is an aggregate. Rows of hot groups therefore meet their group row by
    broadcast, in place, up to MAX_SMALL_GROUPS groups, and beyond that by joins of written tables,
    which are split where a key is hot; all others join on the key. ``probe`` is a cheaper table to look for hot groups in; it may carry only those key
    columns that identify a group by themselves.
    """
    by = list(keys) if probe is None else [k for k in keys if k in probe.columns]
    hot = hot_groups(rows if probe is None else probe, by, rows_per_task, sizes)
    if not hot.count:
        return rows.join(per_group, list(keys), "left")
    rows = stored(rows, "attached")  # both branches read it
    hot_keys = stored(hot.frame, "hot-keys")
    hot_keys = F.broadcast(hot_keys) if hot.count <= MAX_SMALL_GROUPS else hot_keys
    hot_side = stored(per_group.join(hot_keys, by, "left_semi"), "hot-groups")
    # A probe that knows part of the key only can bring many groups: those are left to the join.
    if hot_side.count() <= MAX_HASH_ROWS:
        hot_side = F.broadcast(hot_side)
    inside = rows.join(hot_keys, by, "left_semi").join(hot_side, list(keys), "left")
    return inside.unionByName(rows.join(hot_keys, by, "left_anti").join(per_group, list(keys), "left"))


def join_small(rows: DataFrame, per_group: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a table of a few groups back to their rows. The groups are written and counted first:
    up to MAX_SMALL_GROUPS they are sent to the rows, which stay where they are."""
    side = stored(per_group, "groups")
    return rows.join(F.broadcast(side) if side.count() <= MAX_SMALL_GROUPS else side, list(keys), how)


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on keys where NULL meets NULL, keeping the left key columns: rows of a NULL group
    must not get lost."""
    side = right.select(*[F.col(k).alias(f"_m_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_m_{k}"))
    return left.join(side, cond, how).drop(*[f"_m_{k}" for k in keys])


def _small(frame: DataFrame, hot: HotGroups) -> DataFrame:
    """A table of the hot groups, to be joined to rows: sent to them up to MAX_BROADCAST_GROUPS,
    written beyond that, so that the join can split a hot key."""
    return F.broadcast(frame) if hot.count <= MAX_BROADCAST_GROUPS else stored(frame, "hot-side")


def _edge_array(value: str, n_edges: int) -> Column:
    probs = F.array(*[F.lit(i / n_edges) for i in range(n_edges + 1)])
    return F.array_sort(F.array_distinct(F.percentile_approx(F.col(value), probs, F.lit(n_edges * 20))))


def _below(edges: str, value: str, n_edges: int) -> Column:
    """How many of the ascending edges (``n_edges`` + 1 at most) lie below a value, by binary search."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range((n_edges + 1).bit_length()))])
    fits = lambda at: (at <= F.size(edges)) & (F.get(F.col(edges), at - 1) < F.col(value))
    return F.aggregate(steps, F.lit(0), lambda found, step: F.when(fits(found + step), found + step).otherwise(found))


def _add_buckets(df: DataFrame, groups: Sequence[str], value: str, key: str | None, hot: HotGroups,
                 rows_per_task: int) -> DataFrame:
    n_edges = max(2, min(MAX_EDGES, -(-hot.largest // rows_per_task)))
    by = list(groups)
    if not by:
        by = ["_all"]
        df = df.withColumn("_all", F.lit(0))
    hot_rows = df if hot.frame is None else match(df, _small(hot.frame, hot), by, "left_semi")
    aggs = [_edge_array(value, n_edges).alias("_ve")]
    if key is not None:
        aggs.append(_edge_array(key, n_edges).alias("_ke"))
    edges = hot_rows.groupBy(*by).agg(*aggs)
    out = match(df, _small(edges, hot), by, "left")
    out = out.withColumn("_vb", _below("_ve", value, n_edges))
    missing = F.col(value).isNull()
    single = missing | F.coalesce(F.get("_ve", F.col("_vb")) == F.col(value), F.lit(False))
    # NULL sorts first and is a tie like any other.
    bucket = F.when(missing, -1).otherwise(F.col("_vb") * 2 + single.cast("int"))
    if key is not None:
        spread = _below("_ke", key, n_edges)
        bucket = bucket * (MAX_EDGES + 2) + F.when(single, spread).otherwise(0)
    bucket = F.when(F.col("_ve").isNull(), 0).otherwise(bucket)
    out = out.withColumn(_B, bucket.cast("bigint")).drop("_ve", "_ke", "_vb")
    return out if groups else out.drop("_all")


def _cut(df: DataFrame, groups: Sequence[str], value: str, key: str | None, hot: HotGroups, rows_per_task: int) -> DataFrame:
    """Rows with their bucket, written once: edges, totals and windows all read them."""
    if hot.frame is not None:
        hot = HotGroups(hot.count, hot.largest, stored(hot.frame, "hot-keys"))
    return stored(_add_buckets(stored(df, "ordered"), groups, value, key, hot, rows_per_task), "buckets")


def _offsets(df: DataFrame, groups: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Totals of all earlier buckets of the group, per bucket."""
    totals = df.groupBy(*groups, _B).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*groups).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*groups, _B, *[
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])


def running(df: DataFrame, groups: Sequence[str], value: str, sums: dict[str, Column], *,
            key: str | None = None, rows_per_task: int = ROWS_PER_TASK,
            sizes: DataFrame | None = None) -> DataFrame:
    """Add inclusive running sums over each group in ``value`` (then ``key``) order. The order must
    be unique within a group."""
    order = [value] if key is None else [value, key]
    hot = hot_groups(df, groups, rows_per_task, sizes)
    if not hot.count:
        w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(w).alias(n) for n, c in sums.items()])
    cut = _cut(df, groups, value, key, hot, rows_per_task)
    w = Window.partitionBy(*groups, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.select("*", *[F.sum(c).over(w).alias(f"_i_{n}") for n, c in sums.items()])
    joined = match(inside, _offsets(cut, groups, sums), [*groups, _B])
    return joined.select(*df.columns, *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def ranked(df: DataFrame, groups: Sequence[str], value: str, key: str, *, descending: bool = False,
           name: str = "rank", rows_per_task: int = ROWS_PER_TASK, sizes: DataFrame | None = None) -> DataFrame:
    """Add the 1-based rank inside each group by ``value`` (``key`` breaks ties, ascending)."""
    if descending:
        tmp = df.withColumn("_neg", -F.col(value))
        return running(tmp, groups, "_neg", {name: F.lit(1)}, key=key, rows_per_task=rows_per_task,
                       sizes=sizes).select(*df.columns, F.col(name).cast("bigint").alias(name))
    return running(df, groups, value, {name: F.lit(1)}, key=key, rows_per_task=rows_per_task,
                   sizes=sizes).select(*df.columns, F.col(name).cast("bigint").alias(name))


def lagged(df: DataFrame, groups: Sequence[str], value: str, key: str, *, name: str = "previous",
           rows_per_task: int = ROWS_PER_TASK, sizes: DataFrame | None = None) -> DataFrame:
    """Add the previous ``value`` of the group in (value, key) order. ``value`` must be numeric."""
    hot = hot_groups(df, groups, rows_per_task, sizes)
    if not hot.count:
        return df.select("*", F.lag(value).over(Window.partitionBy(*groups).orderBy(value, key)).alias(name))
    cut = _cut(df, groups, value, key, hot, rows_per_task)
    last = cut.groupBy(*groups, _B).agg(F.max(value).alias("_last"))
    carry = last.select(*groups, _B, F.lag("_last").over(Window.partitionBy(*groups).orderBy(_B)).alias("_carry"))
    inside = cut.withColumn("_in", F.lag(value).over(Window.partitionBy(*groups, _B).orderBy(value, key)))
    return match(inside, carry, [*groups, _B]).select(
        *df.columns, F.coalesce("_in", "_carry").alias(name))


def bucket_bits(hashed: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Leading bits of ``_h`` whose ranges hold ``rows_per_task`` rows at most, by count: about two
    ranges for each share of the rows, and one bit more as long as a range is over the limit."""
    n = hashed.count()
    bits = max(0, math.ceil(math.log2(max(n / rows_per_task, 1))) + (n > rows_per_task))
    while n > rows_per_task and bits < MAX_BUCKET_BITS:
        ranges = hashed.groupBy(F.shiftright(F.col("_h"), HASH_BITS - bits).alias("_r")).agg(F.count("*").alias("n"))
        if ranges.agg(F.max("n")).first()[0] <= rows_per_task:
            break
        bits += 1
    return bits


def hash_ranked(df: DataFrame, groups: Sequence[str], keys: Sequence[str], *, seed: int | str = 42,
                name: str = "rank", size: str = "group_n", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Add a reproducible random 1-based rank inside each group, and the group size.

    Rows are ordered by a hash of their unique key and cut into ranges of its leading bits, as many
    as their count asks for (``bucket_bits``): balanced whatever the data, and a hot group is spread
    evenly. The offset table has a row per group and range; groups must be few (classes, splits).
    """
    hashed = stored(df.withColumn("_h", hash60(*keys, seed=seed)), "hashed")
    hashed = hashed.withColumn(_B, F.shiftright(F.col("_h"), HASH_BITS - bucket_bits(hashed, rows_per_task)))
    totals = hashed.groupBy(*groups, _B).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    side = stored(totals.select(*groups, _B, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o_n"),
                                F.sum("_n").over(Window.partitionBy(*groups)).alias(size)), "hash-buckets")
    if side.count() <= MAX_HASH_ROWS:
        side = F.broadcast(side)
    inside = hashed.withColumn("_i", F.row_number().over(Window.partitionBy(*groups, _B).orderBy("_h", *keys)))
    return match(inside, side, [*groups, _B]).select(
        *df.columns, (F.col("_i") + F.col("_o_n")).cast("bigint").alias(name), F.col(size).cast("bigint").alias(size))


def grouped_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float], *,
                      rows_per_task: int = ROWS_PER_TASK, sizes: DataFrame | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one row per group with a non-null value."""
    df = df.select(*groups, value).where(F.col(value).isNotNull())
    hot = hot_groups(df, groups, rows_per_task, sizes)
    plain = [F.percentile(value, F.lit(p)).alias(n) for n, p in probs.items()]
    if not hot.count:
        return df.groupBy(*groups).agg(*plain)
    df = stored(df, "quantile-rows")
    if hot.frame is None:
        hot_rows, cold = df, None
    else:
        hot = HotGroups(hot.count, hot.largest, stored(hot.frame, "hot-keys"))
        side = _small(hot.frame, hot)
        hot_rows, cold = match(df, side, groups, "left_semi"), match(df, side, groups, "left_anti")
    # Duplicates collapse before the shuffle; the rest is a running count over distinct values.
    distinct = hot_rows.groupBy(*groups, value).agg(F.count("*").alias("_n"))
    # There are no more distinct values than rows: the distinct ones are not counted before they are written.
    n_tot = stored(hot_rows.groupBy(*groups).agg(F.count("*").alias("n")), "quantile-sizes")
    cum = running(distinct, groups, value, {"_c": F.col("_n")}, rows_per_task=rows_per_task, sizes=n_tot)
    if groups:
        cum = match(cum, _small(n_tot.withColumnRenamed("n", "_tot"), hot), groups)
    else:
        cum = cum.withColumn("_tot", F.lit(n_tot.first()["n"]))
    picks, out = [], []
    for i, (name, p) in enumerate(probs.items()):
        pos = F.lit(float(p)) * (F.col("_tot") - 1)
        # The smallest value whose running count passes a position is the value at that position.
        picks.append(F.min(F.when(F.col("_c") > F.floor(pos), F.col(value))).alias(f"_lo{i}"))
        picks.append(F.min(F.when(F.col("_c") > F.ceil(pos), F.col(value))).alias(f"_hi{i}"))
        frac = pos - F.floor(pos)
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * frac).alias(name))
    picked = cum.groupBy(*groups).agg(F.first("_tot").alias("_tot"), *picks).select(*groups, *out)
    return picked if cold is None else picked.unionByName(cold.groupBy(*groups).agg(*plain))


def top_k(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, name: str = "rn") -> DataFrame:
    """First k rows per group. The rank filter becomes a per-task group limit ahead of the shuffle,
    so a hot group sends at most k rows per task."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(name) <= k)
