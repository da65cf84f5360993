"""Matching, pairing, union, lineage and lookup queries (J), and sampling (C)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.binning import pt_label
from ..operators import background as bg
from ..operators import jets as J
from ..operators import joins
from ..operators import sampling
from ..operators import stats as S
from ..operators import trees
from ..schema import KEYS
from ..session import shared_path, stored
from ..sources import views as V
from .check_ctes import density_bin, dr, h60, with_ctes
from .features import stored_rows
from .registry import query

C = V.constituents
CK = ["jet_id", "k1", "k2", "k3"]


@query("J1_truth_match", with_ctes(f"""
    , tp AS (SELECT * FROM live WHERE user_index > 0),
    tl AS (SELECT event_id, jet_id, sum(pt) AS truth_pt, max(CASE WHEN rn = 1 THEN eta END) AS truth_eta, max(CASE WHEN rn = 1 THEN phi END) AS truth_phi
           FROM (SELECT *, row_number() OVER (PARTITION BY event_id, jet_id ORDER BY pt DESC, k1, k2, k3) AS rn FROM tp) GROUP BY 1, 2),
    best AS (SELECT * FROM (SELECT h.event_id, h.user_index, h.jet_id AS truth_jet, t.truth_pt, t.truth_eta, t.truth_phi,
             row_number() OVER (PARTITION BY h.event_id, h.user_index ORDER BY t.truth_pt DESC, h.jet_id) AS rn
             FROM (SELECT DISTINCT event_id, jet_id, user_index FROM tp) h JOIN tl t ON h.event_id = t.event_id AND h.jet_id = t.jet_id) WHERE rn = 1)
    SELECT j.event_id, j.jet_id, f.first_signal, b.truth_jet,
           coalesce({dr('l.eta', 'l.phi', 'b.truth_eta', 'b.truth_phi')}, 1e6) AS dist_match, coalesce(j.tru_sum / b.truth_pt, 0) AS x_match
    FROM jets j JOIN first_sig f ON j.event_id = f.event_id AND j.jet_id = f.jet_id
    LEFT JOIN lead l ON j.event_id = l.event_id AND j.jet_id = l.jet_id
    LEFT JOIN best b ON j.event_id = b.event_id AND f.first_signal = b.user_index""", "live", "jets", "lead", "first_sig"), ["dist_match", "x_match"])
def j1(spark, sf):
    return joins.truth_match(C(spark, sf), event_sizes=V.event_sizes(spark, sf))


@query("J2_event_median_join", with_ctes("""SELECT j.event_id, j.jet_id, j.p_t, m.rho FROM jets j JOIN
       (SELECT event_id, quantile_cont(p_t / area, 0.5) AS rho FROM jets GROUP BY 1) m ON j.event_id = m.event_id""", "jets"), ["p_t", "rho"])
def j2(spark, sf):
    jets = V.basic_jets(C(spark, sf))
    return bg.attach_rho(jets, bg.rho_median(jets, sizes=V.event_sizes(spark, sf)), sizes=V.event_sizes(spark, sf)).select(*KEYS, "p_t", "rho")


@query("J3_event_gate", with_ctes("""SELECT event_id, count(*) AS n, sum(pt) AS pt, event_id IN (SELECT event_id FROM jets WHERE tru_sum > 150) AS gated
       FROM constits WHERE user_index = 0 GROUP BY event_id""", "constits", "jets"), ["pt"])
def j3(spark, sf):
    c = C(spark, sf)
    selected = V.basic_jets(c).where(F.col("tru_sum") > 150)
    per_event = c.where(F.col("user_index") == 0).groupBy("event_id").agg(F.count("*").alias("n"), F.sum("pt").alias("pt"))
    return bg.event_gate(per_event, selected).withColumn("gated", F.lit(True)).unionByName(
        bg.event_gate(per_event, selected, keep=False).withColumn("gated", F.lit(False)))


@query("J4_event_zip", with_ctes("""SELECT s.ordinal, s.event_id AS signal_event, b.event_id AS background_event FROM
       (SELECT event_id, row_number() OVER (ORDER BY event_id) AS ordinal FROM (SELECT DISTINCT event_id FROM jets WHERE tru_sum > 150)) s JOIN
       (SELECT event_id, row_number() OVER (ORDER BY event_id) AS ordinal FROM (SELECT DISTINCT event_id FROM jets WHERE tru_sum = 0)) b ON s.ordinal = b.ordinal""", "jets"))
def j4(spark, sf):
    jets = V.basic_jets(C(spark, sf))
    return bg.event_zip(jets.where(F.col("tru_sum") > 150), jets.where(F.col("tru_sum") == 0))


@query("J5_union_sources", with_ctes("""SELECT source, r_idx, count(*) AS n, sum(pt) AS pt, CAST(sum(user_index) AS BIGINT) AS index_sum FROM (
       SELECT 'signal' AS source, r_idx, pt, user_index FROM constits WHERE user_index <> 0 UNION ALL
       SELECT 'background', r_idx, pt, 0 FROM constits WHERE user_index = 0) GROUP BY 1, 2""", "constits"), ["pt"], 3)
def j5(spark, sf):
    c = C(spark, sf)
    both = joins.union_sources(c.where(F.col("user_index") != 0), c.where(F.col("user_index") == 0).drop("user_index"))
    return both.groupBy("source", "r_idx").agg(F.count("*").alias("n"), F.sum("pt").alias("pt"), F.sum("user_index").alias("index_sum"))


@query("J6_concat_classes", with_ctes("SELECT label, count(*) AS n, avg(p_t) AS p_t FROM feat GROUP BY 1", "feat"), ["p_t"])
def j6(spark, sf):
    jets = V.basic_jets(C(spark, sf)).withColumn("label", pt_label(F.col("tru_sum"), F.col("pt_hard_min")))
    return joins.concat_classes([jets.where(F.col("label") == c) for c in (3, 1, 2)]).groupBy("label").agg(
        F.count("*").alias("n"), F.avg("p_t").alias("p_t"))


@query("J7_lineage_root", """WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE p_partkey // 3 END AS parent FROM part),
       walk AS (SELECT id, parent AS ptr, 1 AS hops, parent BETWEEN 1 AND 8 AS prompt FROM n
                UNION ALL SELECT w.id, n.parent, hops + 1, prompt FROM walk w JOIN n ON w.ptr = n.id WHERE w.ptr > 8)
       SELECT id, CASE WHEN ptr BETWEEN 1 AND 8 THEN ptr END AS root, hops, CASE WHEN ptr < 1 THEN 'error' WHEN prompt THEN 'prompt' ELSE 'resolved' END AS status
       FROM walk WHERE ptr <= 8
       UNION ALL SELECT 1000000001 + p_partkey, 5, p_partkey + 1, CASE WHEN p_partkey = 0 THEN 'prompt' ELSE 'resolved' END FROM part""")
def j7(spark, sf):
    """A shallow forest in which some parents are missing, and one chain through all parts."""
    part = V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    shallow = part.withColumn("parent", F.expr("CASE WHEN id % 17 <> 0 THEN id div 3 END"))
    chain = part.select((F.col("id") + 1_000_000_001).alias("id"), F.expr("CASE WHEN id = 0 THEN 5 ELSE id + 1000000000 END").alias("parent"))
    return joins.lineage_root(shallow.unionByName(chain))


@query("J8_cone_assign", with_ctes(f"""SELECT event_id, jet_id, k1, k2, k3, CASE WHEN rn = 1 AND d < 0.4::DOUBLE THEN seed END AS seed,
       CASE WHEN d < 0.4::DOUBLE THEN d END AS distance FROM (SELECT c.event_id, c.jet_id, c.k1, c.k2, c.k3, s.jet_id AS seed,
       {dr('c.eta', 'c.phi', 's.eta', 's.phi')} AS d, row_number() OVER (PARTITION BY c.event_id, c.jet_id, c.k1, c.k2, c.k3
       ORDER BY {dr('c.eta', 'c.phi', 's.eta', 's.phi')}, s.jet_id) AS rn
       FROM live c JOIN lead s ON c.event_id = s.event_id) WHERE rn = 1""", "live", "lead"), ["distance"])
def j8(spark, sf):
    live = C(spark, sf).where(J.not_ghost())
    seeds = J.jet_axis(live).select(*KEYS, "eta", "phi")
    return joins.cone_assign(live, seeds, 0.4, particle_keys=CK)


@query("J9_hist_ratio", with_ctes(f"""
    , b AS (SELECT user_index > 0 AS sig, {density_bin('eta', '(-0.9)::DOUBLE', '0.9::DOUBLE', 20)} AS bin_x, {density_bin('pt', '0', '120', 20)} AS "bin_y" FROM live)
    SELECT coalesce(a.bin_x, c.bin_x) AS bin_x, coalesce(a.bin_y, c.bin_y) AS bin_y, coalesce(a.n, 0) AS num, coalesce(c.n, 0) AS den,
           coalesce(a.n / nullif(c.n, 0), 0) AS ratio FROM (SELECT bin_x, bin_y, count(*) AS n FROM b WHERE sig GROUP BY 1, 2) a
    FULL JOIN (SELECT bin_x, bin_y, count(*) AS n FROM b WHERE NOT sig GROUP BY 1, 2) c ON a.bin_x = c.bin_x AND a.bin_y = c.bin_y""", "live"), ["ratio"])
def j9(spark, sf):
    from ..functions.binning import density_bin as dbin

    live = C(spark, sf).where(J.not_ghost())
    b = live.select((F.col("user_index") > 0).alias("sig"), dbin(F.col("eta"), F.lit(-0.9), F.lit(0.9), 20).alias("bin_x"),
                    dbin(F.col("pt"), F.lit(0.0), F.lit(120.0), 20).alias("bin_y"))
    counts = b.groupBy("bin_x", "bin_y").agg(F.count_if("sig").alias("s"), F.count_if(~F.col("sig")).alias("b"))
    return joins.hist_ratio(counts.where("s > 0").select("bin_x", "bin_y", F.col("s").alias("n")),
                            counts.where("b > 0").select("bin_x", "bin_y", F.col("b").alias("n")), ["bin_x", "bin_y"])


NODES_SQL = """
    , t0 AS (SELECT round(avg(area) + 3.1415926535e-9, 6) AS t FROM train),
    t1 AS (SELECT round(avg(p_t_1) + 3.1415926535e-9, 6) AS t FROM train, t0 WHERE area <= t0.t),
    t2 AS (SELECT round(avg(angularity) + 3.1415926535e-9, 6) AS t FROM train, t0 WHERE area > t0.t),
    placed AS (SELECT train.*, CASE WHEN area <= t0.t THEN CASE WHEN p_t_1 <= t1.t THEN 3 ELSE 4 END
               ELSE CASE WHEN angularity <= t2.t THEN 5 ELSE 6 END END AS leaf FROM train, t0, t1, t2),
    tops AS (SELECT leaf, CAST(label AS INT) AS prediction FROM (SELECT leaf, label, row_number() OVER (PARTITION BY leaf ORDER BY count(*) DESC, label) AS rn
             FROM placed GROUP BY leaf, label) WHERE rn = 1),
    boxes AS (SELECT 3 AS leaf, 'area' AS feature, NULL::DOUBLE AS lo, t0.t AS hi FROM t0 UNION ALL SELECT 4, 'area', NULL, t0.t FROM t0
              UNION ALL SELECT 5, 'area', t0.t, NULL FROM t0 UNION ALL SELECT 6, 'area', t0.t, NULL FROM t0
              UNION ALL SELECT 3, 'p_t_1', NULL, t1.t FROM t1 UNION ALL SELECT 4, 'p_t_1', t1.t, NULL FROM t1
              UNION ALL SELECT 5, 'angularity', NULL, t2.t FROM t2 UNION ALL SELECT 6, 'angularity', t2.t, NULL FROM t2)"""


def mean_split_nodes(rows):
    """A small tree over the rows: every node splits at the mean of its feature."""
    cut = lambda c, cond: F.round(F.avg(F.when(cond, F.col(c))) + 3.1415926535e-9, 6)
    t0 = rows.agg(F.round(F.avg("area") + 3.1415926535e-9, 6).alias("t")).first()["t"]
    low = F.col("area") <= t0
    t = rows.agg(cut("p_t_1", low).alias("t1"), cut("angularity", ~low).alias("t2")).first()
    leaf = F.when(low, F.when(F.col("p_t_1") <= t["t1"], 3).otherwise(4)).otherwise(F.when(F.col("angularity") <= t["t2"], 5).otherwise(6))
    counts = rows.groupBy(leaf.alias("id"), "label").agg(F.count("*").alias("n"))
    tops = {r["id"]: r["label"] for r in counts.groupBy("id").agg(
        F.max(F.struct("n", (-F.col("label")).alias("neg"))).alias("m")).select("id", (-F.col("m.neg")).alias("label")).collect()}
    inner = [(0, 1, 2, "area", t0, None), (1, 3, 4, "p_t_1", t["t1"], None), (2, 5, 6, "angularity", t["t2"], None)]
    leaves = [(i, -1, -1, None, None, int(tops[i])) for i in (3, 4, 5, 6) if i in tops]
    return rows.sparkSession.createDataFrame(inner + leaves, "id int, left int, right int, feature string, threshold double, prediction int")


@query("F15_tree_rules", with_ctes(NODES_SQL + " SELECT b.leaf, t.prediction, b.feature, b.lo, b.hi FROM boxes b JOIN tops t ON b.leaf = t.leaf", "train"), ["lo", "hi"])
def f15(spark, sf):
    return trees.tree_rules(mean_split_nodes(stored_rows(spark, sf)))


@query("J10_box_lookup", with_ctes(NODES_SQL + """ SELECT p.event_id, p.jet_id, CAST(p.leaf AS INT) AS leaf FROM placed p""", "train"))
def j10(spark, sf):
    rows = stored_rows(spark, sf)
    return trees.box_lookup(rows, trees.tree_rules(mean_split_nodes(rows))).select(*KEYS, "leaf")


GRID_CUTS = 47  # cuts of each feature: 103,823 boxes


@query("J10_box_index", with_ctes(f"""
    , e AS (SELECT min(area) AS a0, (max(area) - min(area)) / {GRID_CUTS} AS da, min(p_t_1) AS p0, (max(p_t_1) - min(p_t_1)) / {GRID_CUTS} AS dp,
            min(angularity) AS g0, (max(angularity) - min(angularity)) / {GRID_CUTS} AS dg FROM train),
    c AS (SELECT CAST(i AS INT) AS i, a0 + i * da AS al, a0 + (i + 1) * da AS ah, p0 + i * dp AS pl, p0 + (i + 1) * dp AS ph, g0 + i * dg AS gl, g0 + (i + 1) * dg AS gh
          FROM e, (SELECT unnest(range({GRID_CUTS})) AS i))
    SELECT t.event_id, t.jet_id, CAST(a.i * {GRID_CUTS * GRID_CUTS} + p.i * {GRID_CUTS} + g.i AS BIGINT) AS leaf FROM train t
    LEFT JOIN c a ON (t.area > a.al OR a.i = 0) AND (t.area <= a.ah OR a.i = {GRID_CUTS - 1})
    LEFT JOIN c p ON (t.p_t_1 > p.pl OR p.i = 0) AND (t.p_t_1 <= p.ph OR p.i = {GRID_CUTS - 1})
    LEFT JOIN c g ON (t.angularity > g.gl OR g.i = 0) AND (t.angularity <= g.gh OR g.i = {GRID_CUTS - 1})""", "train"))
def j10i(spark, sf):
    """Rows looked up among the boxes of a tree of 103,823 leaves: an even grid over three features."""
    rows = stored_rows(spark, sf)
    cols = ["area", "p_t_1", "angularity"]
    ends = rows.agg(*[f(c).alias(f"{n}_{c}") for c in cols for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    leaf = spark.range(GRID_CUTS ** 3).select(F.col("id").alias("leaf"))
    sides = []
    for k, c in enumerate(cols):
        i = F.floor(F.col("leaf") / GRID_CUTS ** (2 - k)) % GRID_CUTS
        step = (ends[f"hi_{c}"] - ends[f"lo_{c}"]) / GRID_CUTS
        edge = lambda j, c=c, step=step: F.lit(ends[f"lo_{c}"]) + j * F.lit(step)
        sides.append(F.struct(F.lit(c).alias("feature"), F.when(i > 0, edge(i)).alias("lo"), F.when(i < GRID_CUTS - 1, edge(i + 1)).alias("hi")))
    rules = leaf.select("leaf", F.inline(F.array(*sides)))
    return trees.box_lookup(rows, rules).select(*KEYS, "leaf")


@query("F15_dot_rules", with_ctes(NODES_SQL + " SELECT b.leaf, t.prediction, b.feature, b.lo, b.hi FROM boxes b JOIN tops t ON b.leaf = t.leaf", "train"), ["lo", "hi"])
def f15d(spark, sf):
    """A tree over the rows written as graph text, read back, and its rules."""
    path = shared_path(spark, "dot")
    trees.dot_lines(mean_split_nodes(stored_rows(spark, sf))).coalesce(1).write.text(path)
    return trees.tree_rules(trees.read_dot(spark, path).drop("tree"))


def labelled(spark, sf):
    jets = V.basic_jets(C(spark, sf))
    return jets.select(*KEYS, "p_t", "r_idx", "pt_hard_min", pt_label(F.col("tru_sum"), F.col("pt_hard_min")).alias("label"))


@query("C1_balance_classes", with_ctes(f"""
    , o AS (SELECT event_id, jet_id, p_t, label, row_number() OVER (PARTITION BY label ORDER BY {h60('event_id', 'jet_id')}, event_id, jet_id) AS ord,
            count(*) OVER (PARTITION BY label) AS nc FROM feat),
    na AS (SELECT count(*) AS n FROM feat WHERE label = 3),
    d AS (SELECT c.label, c.nc, u.id FROM (SELECT DISTINCT label, nc FROM o WHERE label IN (1, 2)) c,
          (SELECT unnest(range(1, (SELECT n FROM na) + 1)) AS id) u),
    dd AS (SELECT label, {h60('label', 'id')} % nc + 1 AS ord FROM d)
    SELECT o.event_id, o.jet_id, o.p_t, o.label, row_number() OVER (PARTITION BY o.event_id, o.jet_id) AS copy
    FROM o JOIN dd ON o.label = dd.label AND o.ord = dd.ord
    UNION ALL SELECT event_id, jet_id, p_t, label, 0 FROM feat WHERE label = 3""", "feat"), ["p_t"])
def c1(spark, sf):
    return sampling.balance_classes(stored(labelled(spark, sf).select(*KEYS, "p_t", "label"), "labelled"), KEYS)


@query("C2_train_test_split", with_ctes(f"""SELECT event_id, jet_id, CASE WHEN rn <= ceil(n / 5) THEN 'test' ELSE 'train' END AS split FROM (
       SELECT event_id, jet_id, row_number() OVER (ORDER BY {h60('event_id', 'jet_id')}, event_id, jet_id) AS rn, count(*) OVER () AS n FROM feat)""", "feat"))
def c2(spark, sf):
    return sampling.train_test_split(labelled(spark, sf).select(*KEYS), KEYS)


@query("C2_hash_split", with_ctes(f"""SELECT event_id, jet_id, CASE WHEN {h60('event_id', 'jet_id')} % 10000 < 2000 THEN 'test' ELSE 'train' END AS split FROM jets""", "jets"))
def c2h(spark, sf):
    return sampling.hash_split(labelled(spark, sf).select(*KEYS), KEYS)


@query("C3_k_fold", with_ctes(f"""SELECT event_id, jet_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {h60('event_id', 'jet_id')}, event_id, jet_id) - 1) % 5 AS INT) AS fold
       FROM feat""", "feat"))
def c3(spark, sf):
    return sampling.k_fold(labelled(spark, sf).select(*KEYS, "label"), KEYS)


@query("C1_approx_balance", with_ctes("SELECT label, true AS near_anchor FROM feat WHERE label IN (1, 2, 3) GROUP BY label", "feat"))
def c1a(spark, sf):
    """Sampled sizes scatter like Poisson counts around the anchor's: within five deviations."""
    counts = S.class_counts(sampling.approx_balance(stored(labelled(spark, sf), "labelled")))
    anchor = F.max(F.when(F.col("label") == 3, F.col("n"))).over(Window.partitionBy())  # one row per class
    return counts.select("label", (F.abs(F.col("n") - anchor) <= 5 * F.sqrt(anchor)).alias("near_anchor"))
