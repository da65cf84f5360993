"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a weight schedule over training progress. The schedule's integral,
scaled to the source's target, is its cumulative token demand; a document's place in the token
stream of its source, sent through the inverse of that demand, is its training position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_of, quoted, renamed, stored, words_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5  # words of the mix per word of input
MOST = 2.0  # passes over a source at most
# Relative demand at equally spaced points of training progress, linear between them; by weight.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
ROWS_PER_BUCKET = 200_000
MAX_SWEEPS = 200  # rounds of handing on the excess; each settles a source or ends


def source_key(source: Column) -> Column:
    """A key without nulls that sorts as the source by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def _ranked(sources: DataFrame) -> DataFrame:
    """Number of each source key in order, from 0. Sources may be many: they are cut into ranges
    and only the ranges' counts are summed over."""
    parts = stored(
        sources.repartitionByRange("_source").sortWithinPartitions("_source").withColumn("_n", F.monotonically_increasing_id()),
        "mix-sources",
    ).withColumn("_part", F.shiftright("_n", 33)).withColumn("_at", F.col("_n").bitwiseAND((1 << 33) - 1))
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.orderBy("_part")) - F.col("_c"))
    return parts.join(F.broadcast(before), "_part").withColumn("_rank", F.col("_before") + F.col("_at"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Target words per source from (``_source``, ``_size``) rows.

    The level L for which min(most * size, L * weight) sums to share * all sizes: sources above
    their limit are held there and the rest is shared out again until no source is above. One
    aggregate per round; only totals reach the driver.
    """
    per = sizes.groupBy("_source").agg(F.sum("_size").alias("_total"))
    ranked = _ranked(per)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.select("_source", "_total", (F.col("_rank") % len(weights)).cast("int").alias("_class"), weight.alias("_weight")), "mix-weights")
    limit = F.lit(most) * F.col("_total")
    all_words, all_weights = ranked.agg(F.sum("_total"), F.sum("_weight")).first()
    demand = share * (all_words or 0)
    level = demand / all_weights if all_weights else 0.0
    held = -1
    for _ in range(MAX_SWEEPS):
        full = limit <= F.lit(level) * F.col("_weight")
        n, words, weighing = ranked.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("_total"))), F.sum(F.when(~full, F.col("_weight")))).first()
        if n == held or not weighing:
            break
        held, level = n, (demand - most * (words or 0)) / weighing
    else:
        raise RuntimeError(f"targets did not settle in {MAX_SWEEPS} rounds")
    return ranked.withColumn("_target", F.least(limit, F.lit(level) * F.col("_weight")))


def progress(share: Column, kind: Column, schedules: tuple[tuple[float, ...], ...] = SCHEDULES) -> Column:
    """Training progress in [0, 1] at which a source has asked for ``share`` of its target.

    Within a segment the rate is r + g u, so the integral is r u + g u^2 / 2, solved for u without
    cancellation.
    """
    out = F.lit(None).cast("double")
    for k, points in enumerate(schedules):
        steps = len(points) - 1
        areas = [(a + b) / 2 / steps for a, b in zip(points, points[1:])]
        total, upper, seg = sum(areas), sum(areas), F.lit(1.0)
        for i in reversed(range(steps)):
            lower = upper - areas[i]
            rate, grow = points[i], (points[i + 1] - points[i]) * steps
            rest = F.greatest(share * total - lower, F.lit(0.0))
            u = F.try_divide(2 * rest, rate + F.sqrt(F.greatest(F.lit(rate * rate) + 2 * grow * rest, F.lit(0.0))))
            at = F.least(F.lit(i / steps) + F.coalesce(u, F.lit(0.0)), F.lit((i + 1) / steps))
            seg = at if i == steps - 1 else F.when(share * total < upper, at).otherwise(seg)
            upper = lower
        out = F.when(kind == k, seg).otherwise(out)
    return out


def mix(docs: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", source_col: str = "source",
        key_col: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
        reread: bool = False) -> DataFrame:
    """One row per document: id columns, source, size, source_size, target, taken and ``passes``.

    A source's documents stand in the order of a digest of ``key_col``. Its token stream runs
    through them as often as the target asks; every whole pass takes all words of a document, the
    last one ends inside a document, of which the first words are taken. ``passes`` is an array of
    (position, words): for each pass over the document, at most ``most`` rounded up, the training
    progress at which it begins and the words it takes.

    Running sums never gather a source: documents fall into buckets by the digest's leading bits,
    as many as the row count asks for, sums run inside buckets, and the buckets' sums are added.
    With ``reread`` the input is read again for the rows instead of being written with its sizes:
    for id columns that hold whole documents.

    A null text or one without words has size 0 and is taken 0 times. A null source is a source of
    its own, last. Rows with equal keys and sizes are alike and exchange freely; a null key has the
    digest of an empty one. An empty table gives none. Other columns are ignored.
    """
    digest = F.md5(F.coalesce(quoted(key_col).cast("string"), F.lit("")))
    rows = (
        docs.select(*ids_of(docs, id_cols), source_key(quoted(source_col)).alias("_source"), F.size(words_of(quoted(text_col))).cast("long").alias("_size"), digest.alias("_digest"))
        .withColumn("_tie", F.xxhash64(*[f"_id{i}" for i in range(len(id_cols))]))
    )
    thin = stored(rows.select("_source", "_size", "_digest") if reread else rows, "mix-sizes")
    return _placed(rows if reread else thin, thin, weights, share, most).select(
        *renamed(id_cols), F.when(F.col("_source") != "1", F.substring("_source", 2, 1 << 30)).alias("source"), F.col("_size").alias("size"), F.col("_total").alias("source_size"),
        F.col("_target").alias("target"), F.col("_taken").alias("taken"), F.col("_passes").alias("passes"))


def _placed(rows: DataFrame, thin: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    targets = source_targets(thin, weights, share, most)
    digits = max(2, math.ceil(math.log(max(thin.count() / ROWS_PER_BUCKET, 1), 16)))
    rows, thin = (x.withColumn("_bucket", F.substring("_digest", 1, digits)) for x in (rows, thin))
    buckets = thin.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    # Sources meet their target on bucket rows, of which a source has a bounded number.
    buckets = stored(buckets.join(targets.drop("_weight"), "_source"), "mix-buckets")
    inside = Window.partitionBy("_source", "_bucket").orderBy("_digest", "_size", "_tie")
    start = F.coalesce(F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = rows.withColumn("_inside", start)
    placed = summed.join(buckets, ["_source", "_bucket"])
    placed = placed.withColumn("_start", F.col("_before") + F.col("_inside"))
    passes = []
    for k in range(math.ceil(most)):
        begin = F.col("_start") + k * F.col("_total")
        words = F.greatest(F.least(F.round(F.col("_target")).cast("long") - begin, F.col("_size")), F.lit(0))
        at = F.round(progress(F.try_divide(begin, F.col("_target")), F.col("_class")), 9)
        passes.append(F.when(words > 0, F.struct(at.alias("position"), words.alias("words"))))
    placed = placed.withColumn("_passes", F.array_compact(F.array(*passes)))
    return placed.withColumn("_taken", F.aggregate("_passes", F.lit(0).cast("long"), lambda total, x: total + x["words"]))


def curriculum(mixed: DataFrame) -> DataFrame:
    """One row per pass (``position``, ``words`` beside the columns of ``mixed``), range-sorted by
    position: the training order runs through the partitions."""
    keep = [c for c in mixed.columns if c != "passes"]
    flat = mixed.select(*[quoted(c) for c in keep], F.inline("passes"))
    return flat.repartitionByRange("position").sortWithinPartitions("position")
