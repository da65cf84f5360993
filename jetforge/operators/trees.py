"""Tree node tables: rules of the leaves and lookup of rows in them.

A node table has one row per node: id, left, right (-1 on leaves), feature, threshold, prediction.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path, stored

CASE_LEAVES = 64  # of a tree that becomes one expression
MAX_EDGES = 512  # of the lookup grid along a feature
COVER = 16  # grid cells that a box is listed in on average at most
MAX_LISTED = 1 << 20  # rows of the list that are broadcast at most


def model_nodes(model, features: Sequence[str]) -> DataFrame:
    """Node table of a fitted MLlib decision tree, from its own saved form."""
    spark = SparkSession.active()
    path = shared_path(spark, "tree")
    model.write().save(path)
    raw = spark.read.parquet(f"{path}/data")
    names = F.array(*[F.lit(f) for f in features])
    leaf = F.col("leftChild") < 0
    return raw.select(
        "id", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.when(~leaf, F.try_element_at(names, F.col("split.featureIndex") + 1)).alias("feature"),
        F.when(~leaf, F.try_element_at(F.col("split.leftCategoriesOrThreshold"), F.lit(1))).alias("threshold"),
        F.col("prediction").cast("int").alias("prediction"), "impurity", "gain")


def root_cut(model, features: Sequence[str]) -> tuple[str, float] | None:
    """Feature and threshold of the root of a fitted tree; None for a single leaf."""
    if model.depth == 0:
        return None
    split = model._call_java("rootNode").split()
    return features[split.featureIndex()], float(split.threshold())


def tree_rules(nodes: DataFrame) -> DataFrame:
    """(leaf, feature, lo, hi]: the box of every leaf, one row per constrained feature; open ends
    are NULL. Node tables are bounded by the tree size, so a recursive walk is enough."""
    return nodes.sparkSession.sql("""
        WITH RECURSIVE edges AS (
            SELECT left AS child, id AS parent, feature, CAST(NULL AS DOUBLE) AS lo, threshold AS hi FROM {nodes} WHERE left >= 0
            UNION ALL
            SELECT right, id, feature, threshold, CAST(NULL AS DOUBLE) FROM {nodes} WHERE right >= 0
        ), walk AS (
            SELECT n.id AS leaf, e.parent AS cur, e.feature, e.lo, e.hi
            FROM {nodes} n JOIN edges e ON n.id = e.child WHERE n.left < 0
            UNION ALL
            SELECT w.leaf, e.parent, e.feature, e.lo, e.hi FROM walk w JOIN edges e ON w.cur = e.child
        )
        SELECT w.leaf, n.prediction, w.feature, max(w.lo) AS lo, min(w.hi) AS hi
        FROM walk w JOIN {nodes} n ON n.id = w.leaf GROUP BY w.leaf, n.prediction, w.feature
    """, nodes=nodes)


def clip_rules(rules: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Close open ends at a plot range and keep boxes inside it."""
    lo = F.create_map(*[F.lit(v) for k, r in ranges.items() for v in (k, float(r[0]))])
    hi = F.create_map(*[F.lit(v) for k, r in ranges.items() for v in (k, float(r[1]))])
    least, most = F.try_element_at(lo, F.col("feature")), F.try_element_at(hi, F.col("feature"))
    return rules.select("leaf", "prediction", "feature",
                        F.greatest("lo", least).alias("lo"), F.least("hi", most).alias("hi"))


def box_lookup(df: DataFrame, rules: DataFrame, name: str = "leaf") -> DataFrame:
    """Leaf of every row; NULL where no box holds it. The boxes of one tree do not overlap.

    Up to CASE_LEAVES leaves become one CASE expression inside the scan stage, without a join; more
    are looked up through a grid (``box_index_lookup``)."""
    leaves = rules.select("leaf").distinct().limit(CASE_LEAVES + 1).count()
    if leaves > CASE_LEAVES:
        return box_index_lookup(df, rules, name)
    boxes: dict[int, list] = {}
    # One row per leaf and column.
    for r in rules.groupBy("leaf", "feature").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi")).collect():
        boxes.setdefault(r["leaf"], []).append(r)
    expr = None
    for leaf, sides in sorted(boxes.items()):
        cond = F.lit(True)
        for s in sides:
            if s["lo"] is not None:
                cond = cond & (F.col(s["feature"]) > F.lit(s["lo"]))
            if s["hi"] is not None:
                cond = cond & (F.col(s["feature"]) <= F.lit(s["hi"]))
        expr = F.when(cond, F.lit(leaf)) if expr is None else expr.when(cond, F.lit(leaf))
    return df.withColumn(name, expr if expr is not None else F.lit(None).cast("int"))


def _edges(rules: DataFrame, features: Sequence[str], n: int) -> dict[str, list[float]]:
    """``n`` thresholds of each feature at most, evenly spread over its rules."""
    cuts = rules.where(F.col("feature").isin(*features)).select("feature", F.explode(F.array("lo", "hi")).alias("cut")).where(F.col("cut").isNotNull())
    probs = F.array(*[F.lit((i + 0.5) / n) for i in range(n)])
    rows = cuts.groupBy("feature").agg(F.array_sort(F.array_distinct(F.percentile_approx("cut", probs, F.lit(50 * n)))).alias("edges")).collect()
    return {r["feature"]: r["edges"] for r in rows}


def _cells(feature: str, edges: Sequence[float]) -> tuple[Column, Column]:
    """First and last grid cell of a box (lo, hi] along a feature. Cell k holds the values with k
    edges below them; NULL values have cell -1, which only boxes open on both sides cover."""
    lo, hi, at = F.col(f"_lo_{feature}"), F.col(f"_hi_{feature}"), F.array(*[F.lit(float(e)) for e in edges])
    first = F.when(lo.isNull(), F.when(hi.isNull(), -1).otherwise(0)).otherwise(F.size(F.filter(at, lambda e: e <= lo)))
    return first, F.when(hi.isNull(), len(edges)).otherwise(F.size(F.filter(at, lambda e: e < hi)))


def box_index_lookup(df: DataFrame, rules: DataFrame, name: str = "leaf") -> DataFrame:
    """Leaf of every row for any number of leaves, by a grid over the two features with the most
    thresholds.

    A box is listed in every grid cell it touches; a row meets the boxes of its own cell by an equi
    join and is tested against all their sides. The grid is as fine as the boxes allow: its edges
    are thresholds, and it is halved until the boxes are listed COVER times each at most on average.
    The list is broadcast up to MAX_LISTED rows (counted), beyond that it is joined by cell. A NULL
    value fails every side set on its feature, as in a comparison.
    """
    sides = stored(rules.groupBy("leaf", "feature").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi")), "box-sides")
    # One row per feature of the tree.
    found = {r["feature"]: r["n"] for r in sides.groupBy("feature").agg((F.count_distinct("lo") + F.count_distinct("hi")).alias("n")).collect()}
    features, grid = sorted(found), sorted(found, key=lambda f: (-found[f], f))[:2]
    pick = lambda f, c: F.max(F.when(F.col("feature") == f, F.col(c)))
    boxes = stored(sides.groupBy("leaf").agg(*[pick(f, c).alias(f"_{c}_{f}") for f in features for c in ("lo", "hi")]), "boxes")
    n_boxes = boxes.count()
    n = max(1, min(MAX_EDGES, math.ceil(math.sqrt(n_boxes))))
    while True:
        edges = _edges(sides, grid, n)
        spans = [_cells(f, edges.get(f, [])) for f in grid]
        listed = F.lit(1)
        for first, last in spans:
            listed = listed * (last - first + 1)
        total = boxes.agg(F.sum(listed.cast("double"))).first()[0] or 0
        if total <= COVER * n_boxes + MAX_LISTED / 16 or n == 1:
            break
        n = max(1, n // 2)
    for k, (first, last) in enumerate(spans):
        boxes = boxes.withColumn(f"_c{k}", F.explode(F.sequence(first, last)))
    boxes = boxes.withColumnRenamed("leaf", "_leaf")
    if total <= MAX_LISTED:
        boxes = F.broadcast(boxes)
    cond = F.lit(True)

    def cell_of(f: str) -> Column:
        x, at = F.col(f).cast("double"), F.array(*[F.lit(float(e)) for e in edges.get(f, [])])
        return F.when(x.isNull(), -1).otherwise(F.size(F.filter(at, lambda e: e < x)))

    for k, f in enumerate(grid):
        df = df.withColumn(f"_g{k}", cell_of(f))
        cond = cond & (F.col(f"_g{k}") == F.col(f"_c{k}"))
    for f in features:
        cond = cond & (F.col(f"_lo_{f}").isNull() | (F.col(f) > F.col(f"_lo_{f}"))) & (F.col(f"_hi_{f}").isNull() | (F.col(f) <= F.col(f"_hi_{f}")))
    met = df.join(boxes, cond, "left").withColumn(name, F.col("_leaf"))
    return met.drop("_leaf", *[f"_{c}{k}" for c in "cg" for k in range(len(grid))], *[f"_{c}_{f}" for f in features for c in ("lo", "hi")])


def dot_lines(nodes: DataFrame) -> DataFrame:
    """Graph text (one ``value`` column) of a node table: a line per node, a line per edge."""
    parts = F.concat_ws("\\n", F.when(F.col("left") >= 0, F.concat_ws(" <= ", "feature", F.col("threshold").cast("string"))),
                        F.concat(F.lit("class = "), F.col("prediction").cast("string")))
    own = F.concat(F.col("id").cast("string"), F.lit(' [label="'), parts, F.lit('"] ;'))
    edges = [F.concat_ws(" -> ", F.col("id").cast("string"), F.concat(F.col(c).cast("string"), F.lit(" ;"))) for c in ("left", "right")]
    lines = nodes.select(F.explode(F.when(F.col("left") >= 0, F.array(own, *edges)).otherwise(F.array(own))).alias("value"))
    return nodes.sparkSession.createDataFrame([("digraph Tree {",), ("}",)], "value string").unionByName(lines)


def read_dot(spark: SparkSession, path: str, classes: dict[str, int] | None = None) -> DataFrame:
    """Node tables of the trees written as graph text below a path, one tree per file: tree (the
    file), id, left, right, feature, threshold, prediction, gini, samples, value, class_name.

    Node lines carry a label of ``name <= threshold`` (inner nodes), gini, samples, value and class,
    as far as they are given, separated by a written line feed; edge lines name parent and child,
    of which the lesser is the left one (nodes are numbered in depth-first order). The prediction is
    what ``classes`` says of the class name, a class name that is a number, or else the place of the
    greatest value. Other lines are passed over.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("tree"), F.trim("value").alias("line"))
    number = r"[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?"
    get = lambda pattern, k=1: F.nullif(F.regexp_extract("label", pattern, k), F.lit(""))
    node = lines.where(F.col("line").rlike(r"^[0-9]+ \[label=")).select(
        "tree", F.regexp_extract("line", r"^([0-9]+) ", 1).cast("int").alias("id"), F.regexp_extract("line", r'label=[<"](.*?)[">](?:,|\])', 1).alias("label"))
    split = rf"^(.+?) <= ({number})"
    values = F.transform(F.filter(F.split(get(r"value = \[([^\]]*)\]"), r"[,\s]+"), lambda x: x != ""), lambda x: x.cast("double"))
    node = node.select("tree", "id", get(split).alias("feature"), get(split, 2).cast("double").alias("threshold"), get(rf"gini = ({number})").cast("double").alias("gini"),
                       get(r"samples = ([0-9]+)").cast("long").alias("samples"), values.alias("value"), get(r"class = (.*?)(?:\\n|$)").alias("class_name"))
    edge = lines.where(F.col("line").rlike(r"^[0-9]+ -> [0-9]+")).select(
        "tree", F.regexp_extract("line", r"^([0-9]+) ->", 1).cast("int").alias("id"), F.regexp_extract("line", r"-> ([0-9]+)", 1).cast("int").alias("child"))
    ends = edge.groupBy("tree", "id").agg(F.min("child").alias("left"), F.max("child").alias("right"))
    named = F.col("class_name").try_cast("int")
    if classes:
        named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in classes.items() for v in pair]), F.col("class_name")), named)
    most = F.array_position("value", F.array_max("value")).cast("int") - 1
    return node.join(ends, ["tree", "id"], "left").select(
        "tree", "id", F.coalesce("left", F.lit(-1)).alias("left"), F.coalesce("right", F.lit(-1)).alias("right"), "feature", "threshold",
        F.coalesce(named, most).alias("prediction"), "gini", "samples", "value", "class_name")
