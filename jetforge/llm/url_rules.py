"""URL filter: host-suffix and path-prefix expressions against rules by hash prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, ids_of, quoted, renamed

PREFIX_HEX = 8  # four bytes of the digest are joined on, all 32 are confirmed
BROADCAST_BYTES = 16 << 20  # rules up to this many bytes are sent to every executor


def url_host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _keyed(rules: DataFrame) -> DataFrame:
    """Rules with the digest of their expression. A rule without host, path or a known action is
    no rule; of the same rule twice, block counts."""
    expression = F.concat(F.col("_host"), F.col("_path"))
    return (
        rules.select(ascii_lower(F.col("host")).alias("_host"), F.col("path").alias("_path"), F.col("action").alias("_action"))
        .where("_host <> '' and _path is not null and _action in ('allow', 'block')")
        .groupBy("_host", "_path").agg(F.max("_action").alias("_action"))
        .select("_host", "_path", "_action", expression.alias("_rule"), F.sha2(expression, 256).alias("_full"))
        .withColumn("_short", F.substring("_full", 1, PREFIX_HEX))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, id_cols: tuple[str, ...] = ("page_id",), url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """One row per input row: id columns, host, path, rule and verdict.

    ``rules`` has host, path and action (allow or block). A rule fits its host and all subdomains
    when the path starts with the rule's; the longest host plus path wins, then the longer host,
    and ``default`` holds where none fits. Each URL is expanded only into the shapes (labels in
    the host, characters in the path) that rules have, so the number of expressions follows the
    shapes and not the URL. They meet the rules on a four-byte prefix of their SHA-256; the full
    digest then confirms.

    Null URLs and those without ``://`` have an empty host and path and no rule. Repeated rows
    give repeated rows; an empty table gives none; without rules every URL gets ``default``. Other
    columns are ignored, whatever their names.
    """
    keyed = _keyed(rules)
    size = keyed.agg(F.coalesce(F.sum(F.length("_rule") + 128), F.lit(0))).first()[0]
    # Shapes, not rules: at most labels in a host times characters in a path.
    shapes = [tuple(r) for r in keyed.select(F.size(F.split("_host", r"\.")), F.length("_path")).distinct().collect()]
    if size <= BROADCAST_BYTES:
        keyed = F.broadcast(keyed)

    host, path = url_host_path(quoted(url_col))
    rows = pages.select(*ids_of(pages, id_cols), host.alias("_h"), path.alias("_p"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumn("_labels", F.split("_h", r"\."))
    expressions = [
        F.when((F.size("_labels") >= labels) & (F.length("_p") >= chars),
               F.concat(F.array_join(F.slice("_labels", -labels, labels), "."), F.substring("_p", 1, chars)))
        for labels, chars in sorted(shapes)
    ]
    none = F.array().cast("array<string>")
    rows = rows.withColumn("_e", F.explode_outer(F.array_compact(F.array(*expressions)) if expressions else none))
    rows = rows.withColumn("_digest", F.sha2("_e", 256)).withColumn("_prefix", F.substring("_digest", 1, PREFIX_HEX))
    met = rows.join(keyed, (F.col("_prefix") == F.col("_short")) & (F.col("_digest") == F.col("_full")), "left")
    best = F.max(F.when(F.col("_full").isNotNull(), F.struct(
        F.length("_rule").alias("n"), F.length("_host").alias("h"), F.col("_rule").alias("rule"), F.col("_action").alias("action"))))
    ids = [F.first(f"_id{i}").alias(f"_id{i}") for i in range(len(id_cols))]
    return (
        met.groupBy("_row").agg(*ids, F.first("_h").alias("host"), F.first("_p").alias("path"), best.alias("_best"))
        .select(*renamed(id_cols), "host", "path", F.col("_best.rule").alias("rule"),
                F.coalesce(F.col("_best.action"), F.lit(default)).alias("verdict"))
    )
