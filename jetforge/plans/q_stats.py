"""Exploration and evaluation queries (D, W2, W3), votes, stump and silhouettes (F)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.binning import density_bin as dbin
from ..operators import prep as P
from ..operators import sampling
from ..operators import silhouette as sil
from ..operators import stats as S
from ..operators import votes
from ..operators.jets import not_ghost
from ..schema import FEATURES, KEYS, LABEL_NAMES
from ..session import stored
from ..sources import views as V
from .check_ctes import density_bin, dphi, dr, fixed_bin, h60, with_ctes
from .features import stored_rows, training_rows
from .registry import query

C = V.constituents
NAMES = dict(zip((1, 2, 3), LABEL_NAMES))


def scored(spark, sf):
    """Training rows with a rule-based prediction, a split and a batch number."""
    pc = F.col("p_t_corr")
    rows = training_rows(spark, sf).withColumn("pred", F.when(pc > 20, 3).when(pc > -20, 2).otherwise(1))
    return sampling.batches(sampling.hash_split(rows, KEYS), KEYS, 5)


@query("D1_class_counts", with_ctes("SELECT label, count(*) AS n FROM train GROUP BY 1", "train"))
def d1(spark, sf):
    return S.class_counts(training_rows(spark, sf))


@query("D2_describe", with_ctes("""SELECT feature, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
       quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM long GROUP BY 1""", "long"),
       ["mean", "std", "min", "max", "q25", "q50", "q75"])
def d2(spark, sf):
    return S.describe(stored_rows(spark, sf), FEATURES)


@query("D3_corr_matrix", with_ctes(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM train" for a in FEATURES for b in FEATURES), "train"), ["corr"])
def d3(spark, sf):
    return S.corr_matrix(training_rows(spark, sf), FEATURES)


_HIST = """, grp AS (SELECT feature, 0 AS grp, value FROM long UNION ALL SELECT feature, label, value FROM long),
    rng AS (SELECT feature, grp, min(value) AS lo, max(value) AS hi FROM grp GROUP BY 1, 2),
    cnt AS (SELECT g.feature, g.grp, {bin} AS bin, count(*) AS n FROM grp g JOIN rng r ON g.feature = r.feature AND g.grp = r.grp GROUP BY 1, 2, 3),
    full_grid AS (SELECT feature, grp, lo, hi, CAST(u.bin AS INT) AS bin FROM rng, (SELECT unnest(range(0, {n})) AS bin) u)
    SELECT f.feature, CAST(f.grp AS INT) AS grp, f.bin, f.lo + (f.hi - f.lo) / {n} * f.bin AS left_edge, coalesce(c.n, 0) AS n,
           coalesce(c.n, 0) / (sum(coalesce(c.n, 0)) OVER (PARTITION BY f.feature, f.grp) * ((f.hi - f.lo) / {n})) AS density
    FROM full_grid f LEFT JOIN cnt c ON f.feature = c.feature AND f.grp = c.grp AND f.bin = c.bin"""


def _hist_sql(n):
    return with_ctes(_HIST.format(n=n, bin=density_bin("g.value", "r.lo", "r.hi", n)), "long")


for _n in (10, 25, 30):
    query(f"D4_hist_density_{_n}", _hist_sql(_n), ["left_edge", "density"])(
        lambda spark, sf, n=_n: S.density_histogram(stored_rows(spark, sf), FEATURES, n))

# Name, column, and (low, high, bins) of the particle and jet histograms.
FIXED_HISTOGRAMS = [
    ("particle_pt", "pt", 0, 100, 100), ("particle_pt_low", "pt", 0, 10, 200), ("particle_eta", "eta", -0.9, 0.9, 100),
    ("particle_phi", "phi", 0, 6.283185307179586, 100),
]


@query("D5_hist_fixed", with_ctes(" UNION ALL ".join(
    f"""SELECT '{n}' AS name, source, {fixed_bin(c, lo, hi, b)} AS bin, count(*) AS n, sum(1.0::DOUBLE) AS sumw FROM (
        SELECT 'total' AS source, * FROM live UNION ALL SELECT CASE WHEN user_index > 0 THEN 'signal' ELSE 'background' END, * FROM live) GROUP BY 2, 3"""
    for n, c, lo, hi, b in FIXED_HISTOGRAMS), "live"), ["sumw"])
def d5(spark, sf):
    from ..functions.binning import fixed_bin as fb

    live = C(spark, sf).where(not_ghost())
    cells = F.array(*[F.struct(F.lit(n).alias("name"), fb(F.col(c), lo, hi, b).alias("bin")) for n, c, lo, hi, b in FIXED_HISTOGRAMS])
    src = F.when(F.col("user_index") > 0, "signal").otherwise("background")
    # Counted once by source; the total is the sum of the two.
    per = live.select(src.alias("source"), F.explode(cells).alias("h")).groupBy("source", "h.name", "h.bin").agg(F.count("*").alias("n"))
    both = per.withColumn("source", F.explode(F.array("source", F.lit("total"))))
    return both.groupBy("name", "source", "bin").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double")).alias("sumw"))


@query("D6_hist_normalize", with_ctes(f""", h AS (SELECT label, {fixed_bin('angularity', 0, 1, 50)} AS bin, count(*) AS n FROM train GROUP BY 1, 2)
       SELECT label, bin, n, n / sum(n) OVER (PARTITION BY label) / 0.02::DOUBLE AS density FROM h""", "train"), ["density"])
def d6(spark, sf):
    h = S.fixed_histogram(training_rows(spark, sf), F.col("angularity"), 0, 1, 50, ["label"]).select("label", "bin", "n")
    return S.normalize_histogram(h, 0.02, ["label"])


@query("D5_jet_histograms", with_ctes(f"""SELECT name, bin, count(*) AS n FROM (
    SELECT 'z' AS name, {fixed_bin('round(l.pt / j.p_t, 9)', 0, 1, 100)} AS bin FROM live l JOIN jets j ON l.event_id = j.event_id AND l.jet_id = j.jet_id
    UNION ALL SELECT 'lesub', {fixed_bin('(p_t_1 - p_t_2)', 0, 100, 200)} FROM feat WHERE p_t_2 IS NOT NULL
    UNION ALL SELECT 'lesub_low', {fixed_bin('(p_t_1 - p_t_2)', 0, 10, 100)} FROM feat WHERE p_t_2 IS NOT NULL
    UNION ALL SELECT 'x_tru', {fixed_bin('round(tru_sum / p_t, 9)', 0, 1, 100)} FROM feat WHERE p_t > 0
    UNION ALL SELECT 'x_fake', {fixed_bin('round(y_bkgd, 9)', 0, 1, 100)} FROM feat WHERE p_t > 0
    UNION ALL SELECT 'origin', {fixed_bin('(CASE WHEN y_beam > 0 AND y_quark + y_gluon > 0 THEN 2 WHEN y_beam > 0 THEN 1 ELSE 3 END)', 0.5, 3.5, 3)} FROM feat WHERE y_beam + y_quark + y_gluon > 0
    UNION ALL SELECT 'rho_low', {fixed_bin('rho', 0, 80, 200)} FROM rho2 UNION ALL SELECT 'rho', {fixed_bin('rho', 0, 600, 600)} FROM rho2) GROUP BY 1, 2""",
    "live", "jets", "feat", "rho2"))
def d5j(spark, sf):
    """The fixed histograms filled per constituent, per jet and per event. Shares are rounded first:
    a share of exactly one must not depend on the order of its sums."""
    from ..functions.binning import fixed_bin as fb
    from ..operators import background as bg
    from ..operators import jets as J

    c = C(spark, sf)
    cell = lambda name, x, lo, hi, n: F.struct(F.lit(name).alias("name"), fb(x, lo, hi, n).alias("bin"))
    feats = stored_rows(spark, sf, ["p_t_2", "p_t", "tru_sum", "y_bkgd", "y_beam", "y_quark", "y_gluon"])
    gap, parton = F.col("p_t_1") - F.col("p_t_2"), F.col("y_quark") + F.col("y_gluon")
    origin = F.when((F.col("y_beam") > 0) & (parton > 0), 2.0).when(F.col("y_beam") > 0, 1.0).when(parton > 0, 3.0)
    per_jet = feats.select(F.explode(F.array(
        cell("lesub", gap, 0, 100, 200), cell("lesub_low", gap, 0, 10, 100), cell("x_tru", F.round(F.try_divide("tru_sum", "p_t"), 9), 0, 1, 100),
        cell("x_fake", F.round("y_bkgd", 9), 0, 1, 100), cell("origin", origin, 0.5, 3.5, 3))).alias("h"))
    per_row = J.fragmentation(c, probe=V.jet_sizes(spark, sf)).select(cell("z", F.round("z", 9), 0, 1, 100).alias("h"))
    rho = bg.rho_median_drop2(V.basic_jets(c), sizes=V.event_sizes(spark, sf))
    per_event = rho.select(F.explode(F.array(cell("rho_low", F.col("rho"), 0, 80, 200), cell("rho", F.col("rho"), 0, 600, 600))).alias("h"))
    return per_jet.unionByName(per_row).unionByName(per_event).select("h.*").where(F.col("bin").isNotNull()).groupBy("name", "bin").agg(
        F.count("*").alias("n"))


@query("D7_purity_vs_pt", with_ctes(f"""SELECT {fixed_bin('round(tru_sum / p_t, 9)', 0, 1, 100)} AS bin_x, {fixed_bin('p_t', 0, 100, 100)} AS bin_y, count(*) AS n
    FROM jets WHERE p_t > 0 GROUP BY 1, 2""", "jets"))
def d7x(spark, sf):
    jets = V.basic_jets(C(spark, sf))
    return S.histogram_2d(jets, F.round(F.try_divide("tru_sum", "p_t"), 9), (0, 1, 100), F.col("p_t"), (0, 100, 100)).select("bin_x", "bin_y", "n")


@query("D8_cone_z_weighted", with_ctes(f"""SELECT {fixed_bin('dphi', -1, 1, 200)} AS bin_x, {fixed_bin('deta', -1, 1, 200)} AS bin_y, count(*) AS n, sum(z) AS sumw, sum(z * z) AS sumw2
    FROM (SELECT {dphi('n.phi', 'n.axis_phi')} AS dphi, n.axis_eta - n.eta AS deta, n.pt / j.p_t AS z FROM near n JOIN jets j ON n.event_id = j.event_id AND n.jet_id = j.jet_id)
    GROUP BY 1, 2""", "near", "jets"), ["sumw", "sumw2"])
def d8z(spark, sf):
    from ..functions.kinematics import delta_phi
    from ..functions.ordering import attach
    from ..operators import jets as J

    live = C(spark, sf).where(not_ghost())
    core = J.jet_core(live).select(*KEYS, "p_t", F.col("eta").alias("axis_eta"), F.col("phi").alias("axis_phi"))
    near = attach(live, core, KEYS, probe=V.jet_sizes(spark, sf))
    return S.histogram_2d(near, delta_phi(F.col("phi"), F.col("axis_phi")), (-1, 1, 200), F.col("axis_eta") - F.col("eta"), (-1, 1, 200),
                          weight=F.try_divide("pt", "p_t"))


# Variables compared between sources, with (low, high) of their 50 bins.
COMPARE_VARS = [("area", 0, 1), ("angularity", 0, 1), ("angularity_nw", 0, 1), ("mean_p_t", 0, 2), ("p_t_1", 0, 20), ("p_t_2", 0, 20)]
_SRC_FEATS = """
    , sc AS (SELECT 'total' AS source, * FROM live UNION ALL SELECT CASE WHEN user_index > 0 THEN 'signal' ELSE 'background' END, * FROM live),
    rk AS (SELECT *, row_number() OVER (PARTITION BY source, event_id, jet_id ORDER BY pt DESC, k1, k2, k3) AS rn FROM sc),
    ax AS (SELECT source, event_id, jet_id, max(CASE WHEN rn = 1 THEN eta END) AS ae, max(CASE WHEN rn = 1 THEN phi END) AS ap,
           max(CASE WHEN rn = 1 THEN pt END) AS p_t_1, max(CASE WHEN rn = 2 THEN pt END) AS p_t_2 FROM rk GROUP BY 1, 2, 3),
    sf AS (SELECT s.source, s.event_id, s.jet_id, sum(s.pt * {dr}) / sum(s.pt) AS angularity, avg({dr}) AS angularity_nw, avg(s.pt) AS mean_p_t,
           max(a.p_t_1) AS p_t_1, max(a.p_t_2) AS p_t_2, max(CAST(10 + s.jet_id % 50 AS DOUBLE) / 100) AS area FROM sc s JOIN ax a ON s.source = a.source AND s.event_id = a.event_id AND s.jet_id = a.jet_id GROUP BY 1, 2, 3)
"""


@query("D6_variable_compare", with_ctes(_SRC_FEATS.format(dr=dr("s.eta", "s.phi", "a.ae", "a.ap")) + " SELECT name, source, bin, n, n / sum(n) OVER (PARTITION BY name, source) / width AS density FROM ("
       + " UNION ALL ".join(f"SELECT '{v}' AS name, source, {fixed_bin(v, lo, hi, 50)} AS bin, {(hi - lo) / 50}::DOUBLE AS width, count(*) AS n FROM sf WHERE {v} IS NOT NULL GROUP BY 2, 3"
                            for v, lo, hi in COMPARE_VARS) + ")", "live"), ["density"])
def d6v(spark, sf):
    """Normalised spectra of jet variables for signal, background and total jets, with the source as
    an extra jet key: one feature job covers the three tables."""
    from ..functions.binning import fixed_bin as fb
    from ..operators import jets as J

    live = C(spark, sf).where(not_ghost())
    src = F.explode(F.array(F.lit("total"), F.when(F.col("user_index") > 0, "signal").otherwise("background")))
    feats = J.jet_features(live.withColumn("source", src), carry=(), keys=["source", *KEYS])
    feats = feats.withColumn("area", (10 + F.col("jet_id") % 50).cast("double") / 100)
    cells = F.array(*[F.struct(F.lit(v).alias("name"), fb(F.col(v), lo, hi, 50).alias("bin"), F.lit((hi - lo) / 50).alias("width")) for v, lo, hi in COMPARE_VARS])
    h = feats.select("source", F.explode(cells).alias("h")).select("source", "h.*").where(F.col("bin").isNotNull()).groupBy("name", "source", "bin", "width").agg(
        F.count("*").alias("n"))
    entries = F.sum("n").over(Window.partitionBy("name", "source"))
    return h.select("name", "source", "bin", "n", (F.col("n") / entries / F.col("width")).alias("density"))


# Ranges of the compared jet variables.
COMPARE_PAIRS = [("angularity", (0, 0.5, 50), "angularity_nw", (0, 0.5, 50)), ("area", (0, 1, 50), "mean_p_t", (0, 2, 50)),
                 ("area", (0, 1, 50), "p_t", (0, 30, 50)), ("p_t_1", (0, 10, 50), "p_t_2", (0, 10, 50))]


@query("D7_hist_2d", with_ctes(" UNION ALL ".join(
    f"SELECT '{a}:{b}' AS pair, {fixed_bin(a, *ra)} AS bin_x, {fixed_bin(b, *rb)} AS bin_y, count(*) AS n FROM train WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 2, 3"
    for a, ra, b, rb in COMPARE_PAIRS), "train"))
def d7(spark, sf):
    from ..functions.binning import fixed_bin as fb

    cells = F.array(*[F.struct(F.lit(f"{a}:{b}").alias("pair"), fb(F.col(a), *ra).alias("bin_x"), fb(F.col(b), *rb).alias("bin_y"))
                      for a, ra, b, rb in COMPARE_PAIRS])
    long = training_rows(spark, sf).select(F.explode(cells).alias("c")).select("c.*")
    return long.where(F.col("bin_x").isNotNull() & F.col("bin_y").isNotNull()).groupBy("pair", "bin_x", "bin_y").agg(F.count("*").alias("n"))


@query("D9_hexbin_log", with_ctes("""
    , b AS (SELECT min(p_t_corr) AS xl, max(p_t_corr) AS xh, min(area) AS yl, max(area) AS yh FROM train WHERE label <> 2),
    uv AS (SELECT (p_t_corr - xl) / ((xh - xl) / 20.0::DOUBLE) AS u, (area - yl) / ((yh - yl) / 11.0::DOUBLE) AS v FROM train, b WHERE label <> 2),
    d AS (SELECT u, v, (u - floor(u + 0.5)) * (u - floor(u + 0.5)) + 3 * (v - floor(v + 0.5)) * (v - floor(v + 0.5)) <=
          (u - floor(u) - 0.5) * (u - floor(u) - 0.5) + 3 * (v - floor(v) - 0.5) * (v - floor(v) - 0.5) AS first FROM uv)
    SELECT CAST(CASE WHEN first THEN 0 ELSE 1 END AS INT) AS lattice, CAST(CASE WHEN first THEN floor(u + 0.5) ELSE floor(u) END AS BIGINT) AS ix,
           CAST(CASE WHEN first THEN floor(v + 0.5) ELSE floor(v) END AS BIGINT) AS iy, count(*) AS n, log10(count(*) + 1) AS color FROM d GROUP BY 1, 2, 3""", "train"), ["color"])
def d9(spark, sf):
    return S.hexbin(P.class_filter(stored_rows(spark, sf), drop=[2]), "p_t_corr", "area", 20)


def _pairs_sql(pairs, n):
    cols = sorted({c for p in pairs for c in p})
    binned = ", ".join(density_bin(c, f"(min({c}) OVER ())", f"(max({c}) OVER ())", n) + f" AS {c}" for c in cols)
    parts = " UNION ALL ".join(f"SELECT label, '{a}' AS a, '{b}' AS b, {a} AS bin_x, {b} AS bin_y FROM binned" for a, b in pairs)
    return with_ctes(f", binned AS (SELECT label, {binned} FROM train) SELECT label, a, b, bin_x, bin_y, count(*) AS n FROM ({parts}) GROUP BY ALL", "train")


@query("D10_scatter_matrix", _pairs_sql([(p, q) for i, p in enumerate(FEATURES) for q in FEATURES[i:]], 30))
def d10(spark, sf):
    pairs = [(p, q) for i, p in enumerate(FEATURES) for q in FEATURES[i:]]
    return S.pair_histograms(stored_rows(spark, sf), FEATURES, 30, pairs=pairs)


_VS = ["area", "angularity", "mean_p_t", "p_t_1"]


@query("D11_feature_vs_pt", _pairs_sql([("p_t", c) for c in _VS], 30))
def d11(spark, sf):
    return S.pair_histograms(stored_rows(spark, sf, ["p_t"]), ["p_t", *_VS], 30, pairs=[("p_t", c) for c in _VS])


@query("D12_profile_by_bin", with_ctes(f"""SELECT {density_bin('p_t', 'lo', 'hi', 20)} AS bin, count(*) AS n, avg(angularity) AS mean,
       quantile_cont(angularity, 0.5) AS median FROM train, (SELECT min(p_t) AS lo, max(p_t) AS hi FROM train) GROUP BY 1""", "train"), ["mean", "median"])
def d12(spark, sf):
    return S.profile(stored_rows(spark, sf, ["p_t"]), "p_t", "angularity", 20)


@query("D12_profile_strict", with_ctes("""SELECT CAST(floor((p_t - lo) / ((hi - lo) / 19)) AS INT) AS bin, count(*) AS n, avg(angularity) AS mean,
       quantile_cont(angularity, 0.5) AS median FROM train, (SELECT min(p_t) AS lo, max(p_t) AS hi FROM train)
       WHERE p_t > lo + (hi - lo) / 19 * floor((p_t - lo) / ((hi - lo) / 19)) AND p_t < lo + (hi - lo) / 19 * floor((p_t - lo) / ((hi - lo) / 19)) + (hi - lo) / 20
       GROUP BY 1""", "train"), ["mean", "median"])
def d12s(spark, sf):
    return S.profile(stored_rows(spark, sf, ["p_t"]), "p_t", "angularity", 20, strict_edges=True)


@query("D15_accuracy", with_ctes("SELECT split, avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM scored GROUP BY 1", "scored"), ["accuracy"])
def d15(spark, sf):
    return S.accuracy(scored(spark, sf), groups=["split"])


@query("D16_class_rates", with_ctes("""SELECT split, label, count(*) AS n, avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0 END) AS rate
       FROM scored GROUP BY 1, 2""", "scored"), ["rate"])
def d16(spark, sf):
    return S.class_rates(scored(spark, sf))


@query("D17_fall_rates", with_ctes("""SELECT split, avg(CASE WHEN label = 1 THEN CASE WHEN pred = 3 THEN 1.0::DOUBLE ELSE 0 END END) AS fall_out,
       avg(CASE WHEN label = 3 THEN CASE WHEN pred = 1 THEN 1.0::DOUBLE ELSE 0 END END) AS fall_in FROM scored GROUP BY 1""", "scored"), ["fall_out", "fall_in"])
def d17(spark, sf):
    return S.fall_rates(scored(spark, sf), groups=["split"])


@query("D17_confusion", with_ctes("SELECT split, label, CAST(pred AS INT) AS pred, count(*) AS n FROM scored GROUP BY 1, 2, 3", "scored"))
def d17c(spark, sf):
    return S.confusion(scored(spark, sf), groups=["split"])


METRIC_SQL = """, m AS (SELECT batch_id, r_idx, pt_hard_min, avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0 END) AS accuracy,
       avg(CASE WHEN label = 1 THEN CASE WHEN pred = 3 THEN 1.0::DOUBLE ELSE 0 END END) AS fall_out,
       avg(CASE WHEN label = 3 THEN CASE WHEN pred = 1 THEN 1.0::DOUBLE ELSE 0 END END) AS fall_in FROM scored GROUP BY 1, 2, 3),
       metrics AS (SELECT batch_id, r_idx, pt_hard_min, 'accuracy' AS metric, accuracy AS value FROM m UNION ALL
       SELECT batch_id, r_idx, pt_hard_min, 'fall_out', fall_out FROM m UNION ALL SELECT batch_id, r_idx, pt_hard_min, 'fall_in', fall_in FROM m)"""


def metrics_long(spark, sf, by=("batch_id", "r_idx", "pt_hard_min")):
    rows = scored(spark, sf)
    rate = lambda true, called: F.avg(F.when(F.col("label") == true, (F.col("pred") == called).cast("double")))
    wide = rows.groupBy(*by).agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"),
                                 rate(1, 3).alias("fall_out"), rate(3, 1).alias("fall_in"))
    return wide.unpivot(list(by), ["accuracy", "fall_out", "fall_in"], "metric", "value")


@query("D18_metric_mean", with_ctes(METRIC_SQL + " SELECT r_idx, pt_hard_min, metric, avg(value) AS mean, count(value) AS n_models FROM metrics GROUP BY 1, 2, 3", "scored"), ["mean"])
def d18(spark, sf):
    return S.metric_mean(metrics_long(spark, sf), ["r_idx", "pt_hard_min", "metric"])


@query("D18_metric_mean_compat", with_ctes(METRIC_SQL + " SELECT r_idx, pt_hard_min, metric, sum(value) / (count(value) + 1) AS mean, count(value) AS n_models FROM metrics GROUP BY 1, 2, 3", "scored"), ["mean"])
def d18c(spark, sf):
    return S.metric_mean(metrics_long(spark, sf), ["r_idx", "pt_hard_min", "metric"], compat=True)


def events(spark, sf):
    return V.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")


_GAPS = ", g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM ev)"


@query("W2_interval_stats", with_ctes(_GAPS + " SELECT user_id, count(gap) AS n, sum(gap) AS total, avg(gap) AS mean FROM g WHERE gap IS NOT NULL GROUP BY 1", "ev"), ["total", "mean"], 3)
def w2(spark, sf):
    return S.interval_stats(S.interval_gaps(events(spark, sf), "ts", "event_id", ["user_id"]), ["user_id"])


@query("W2_interval_hist", with_ctes(""", g AS (SELECT (epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id)) / 1e6 AS gap FROM ev),
       m AS (SELECT avg(gap) AS mean FROM g)
       SELECT CAST(CASE WHEN gap < mean - 1 THEN 0 WHEN gap >= mean + 1 THEN 9 ELSE 1 + floor(8 * (gap - (mean - 1)) / ((mean + 1) - (mean - 1))) END AS INT) AS bin, count(*) AS n
       FROM g, m WHERE gap IS NOT NULL GROUP BY 1""", "ev"))
def w2h(spark, sf):
    return S.interval_histogram(S.interval_gaps(events(spark, sf), "ts", "event_id")).select("bin", "n")


IMP_SQL = ", imp AS (" + " UNION ALL ".join(
    f"SELECT r_idx, pt_hard_min, '{c}' AS feature, coalesce(abs(corr({c}, label)), 0) AS importance FROM train GROUP BY 1, 2" for c in FEATURES) + ")"


def grid_importance(spark, sf, by=("r_idx", "pt_hard_min"), rows=None):
    """Association of every feature with the label, per group, in long form."""
    rows = training_rows(spark, sf) if rows is None else rows
    wide = rows.groupBy(*by).agg(*[F.coalesce(F.abs(F.corr(c, "label")), F.lit(0.0)).alias(c) for c in FEATURES])
    return wide.unpivot(list(by), FEATURES, "feature", "importance")


@query("W3_importance_rank", with_ctes(IMP_SQL + """ SELECT r_idx, pt_hard_min, feature, importance, CAST(row_number() OVER (PARTITION BY r_idx, pt_hard_min
       ORDER BY importance DESC, feature) AS INT) AS rank FROM imp""", "train"), ["importance"])
def w3(spark, sf):
    return votes.importance_rank(grid_importance(spark, sf), ["r_idx", "pt_hard_min"])


@query("F5_importance_stats", with_ctes(", imp AS (" + " UNION ALL ".join(
    f"SELECT batch_id, '{c}' AS feature, coalesce(abs(corr({c}, label)), 0) AS importance FROM scored GROUP BY 1" for c in FEATURES) + """)
    SELECT feature, avg(importance) AS importance, stddev_pop(importance) AS std, quantile_cont(importance, 0.75) AS q75 FROM imp GROUP BY 1""", "scored"), ["importance", "std", "q75"])
def f5(spark, sf):
    per_batch = grid_importance(spark, sf, ["batch_id"], scored(spark, sf))
    return votes.importance_stats(per_batch.withColumnRenamed("batch_id", "tree"))


@query("F3_majority_vote", with_ctes(f""", v AS (SELECT event_id, jet_id, 1 + {h60('m', 'event_id', 'jet_id', seed='vote')} % 3 AS pred FROM train,
       (SELECT unnest(range(0, 5)) AS m) u)
       SELECT event_id, jet_id, vote, n_votes FROM (SELECT event_id, jet_id, pred AS vote, count(*) AS n_votes,
       row_number() OVER (PARTITION BY event_id, jet_id ORDER BY count(*) DESC, pred) AS rn FROM v GROUP BY 1, 2, 3) WHERE rn = 1""", "train"))
def f3(spark, sf):
    from ..functions.hashing import hash60

    rows = training_rows(spark, sf).select(*KEYS).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(4))))
    v = rows.withColumn("pred", 1 + F.pmod(hash60("m", *KEYS, seed="vote"), F.lit(3)))
    return votes.majority_vote(v, KEYS)


def _stump_sql(n, groups, tail):
    g = ", ".join(groups) + (", " if groups else "")
    on = " AND ".join(["c.feature = r.feature", *[f"c.{x} = r.{x}" for x in groups]])
    by = "PARTITION BY " + ", ".join([*groups, "feature"])
    best = ("PARTITION BY " + ", ".join(groups) + " ") if groups else ""
    gini = lambda p, t: f"(1 - ({p.format(1)} / {t}) * ({p.format(1)} / {t}) - ({p.format(2)} / {t}) * ({p.format(2)} / {t}) - ({p.format(3)} / {t}) * ({p.format(3)} / {t}))"
    lt, tt = "(l1 + l2 + l3)", "(t1 + t2 + t3)"
    rt = f"({tt} - {lt})"
    gain = f"{gini('t{}', tt)} - {lt} / {tt} * {gini('l{}', lt)} - {rt} / {tt} * {gini('(t{0} - l{0})', rt)}"
    return with_ctes(f"""
    , rng AS (SELECT {g}feature, min(value) AS lo, max(value) AS hi FROM long GROUP BY ALL),
    binned AS (SELECT {''.join(f'c.{x}, ' for x in groups)}c.feature, c.label, r.lo, r.hi, CAST(least(CASE WHEN c.value <= r.lo THEN 0 ELSE
        greatest(ceil((c.value - r.lo) * {n} / (r.hi - r.lo)) - 1, 0) END, {n - 1}) AS INT) AS bin FROM long c JOIN rng r ON {on}),
    pb AS (SELECT {g}feature, bin, lo, hi, {', '.join(f'CAST(count(CASE WHEN label = {k} THEN 1 END) AS DOUBLE) AS n{k}' for k in (1, 2, 3))} FROM binned GROUP BY ALL),
    lf AS (SELECT {g}feature, bin, lo, hi, {', '.join(f'sum(n{k}) OVER ({by} ORDER BY bin) AS l{k}, sum(n{k}) OVER ({by}) AS t{k}' for k in (1, 2, 3))} FROM pb),
    sc AS (SELECT *, round({gain}, 9) AS gain, lo + (hi - lo) / {n} * (bin + 1) AS threshold FROM lf WHERE {lt} > 0 AND {rt} > 0),
    bs AS (SELECT * FROM (SELECT *, row_number() OVER ({best}ORDER BY gain DESC, feature, bin) AS rk FROM sc) WHERE rk = 1)
    {tail}""", "long")


def _cut_tail(groups):
    g = "".join(f"{x}, " for x in groups)
    return " UNION ALL ".join(
        f"SELECT {g}feature, threshold, gain, CAST({k} AS INT) AS label, '{n}' AS label_name, 100 * l{k} / nullif(t{k}, 0) AS pct_below, "
        f"100 * (t{k} - l{k}) / nullif(t{k}, 0) AS pct_above, printf('%s <= %.3f keeps %.1f%% of our {n} jets', feature, threshold, 100 * l{k} / nullif(t{k}, 0)) AS below_text, "
        f"printf('%s > %.3f keeps %.1f%% of our {n} jets', feature, threshold, 100 * (t{k} - l{k}) / nullif(t{k}, 0)) AS above_text FROM bs" for k, n in NAMES.items())


@query("F9_top_cut", _stump_sql(32, [], _cut_tail([])), ["threshold", "gain", "pct_below", "pct_above"])
def f9(spark, sf):
    best = votes.best_stump(votes.stump_counts(stored_rows(spark, sf), FEATURES, 32), 32)
    return votes.cut_report(best, NAMES)


_SOME = [c for c in FEATURES if c != "p_t_1"] + ["p_t_2", "p_t_3"]


@query("F9_top_cut_missing", _stump_sql(32, [], _cut_tail([])).replace("FROM long", "FROM picked").replace(
    ", rng AS", ", picked AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, label, CAST({c} AS DOUBLE) AS value FROM train WHERE {c} IS NOT NULL" for c in _SOME) + "), rng AS", 1),
    ["threshold", "gain", "pct_below", "pct_above"])
def f9m(spark, sf):
    """The best cut where some features are missing on small jets."""
    best = votes.best_stump(votes.stump_counts(stored_rows(spark, sf, _SOME), _SOME, 32), 32)
    return votes.cut_report(best, NAMES)


_GINI = lambda p, t: f"(1 - {' - '.join(f'({p.format(k)} / {t}) * ({p.format(k)} / {t})' for k in (1, 2, 3))})"


def _exact_sql(groups, tail):
    """A stump over all values by hand: every distinct value is a candidate."""
    g = "".join(f"{x}, " for x in groups)
    lt, tt = "(l1 + l2 + l3)", "(t1 + t2 + t3)"
    rt = f"({tt} - {lt})"
    gain = f"{_GINI('t{}', tt)} - {lt} / {tt} * {_GINI('l{}', lt)} - {rt} / {tt} * {_GINI('(t{0} - l{0})', rt)}"
    best = f"PARTITION BY {', '.join(groups)} " if groups else ""
    return with_ctes(f"""
    , pv AS (SELECT {g}feature, value, {', '.join(f'CAST(count(CASE WHEN label = {k} THEN 1 END) AS DOUBLE) AS n{k}' for k in (1, 2, 3))} FROM long GROUP BY ALL),
    lf AS (SELECT {g}feature, value, lead(value) OVER o AS next, {', '.join(f'sum(n{k}) OVER o AS l{k}, sum(n{k}) OVER a AS t{k}' for k in (1, 2, 3))} FROM pv
           WINDOW o AS (PARTITION BY {g}feature ORDER BY value), a AS (PARTITION BY {g}feature)),
    sc AS (SELECT *, round({gain}, 9) AS gain, (value + next) / 2 AS threshold FROM lf WHERE {rt} > 0),
    bs AS (SELECT * FROM (SELECT *, row_number() OVER ({best}ORDER BY gain DESC, feature, value) AS rk FROM sc) WHERE rk = 1)
    {tail}""", "long")


@query("F9_exact_cut", _exact_sql([], _cut_tail([])), ["threshold", "gain", "pct_below", "pct_above"])
def f9x(spark, sf):
    return votes.cut_report(votes.exact_stump(stored_rows(spark, sf), FEATURES), NAMES)


GRID = ["r_idx", "pt_hard_min"]


@query("F9_exact_cut_grid", _exact_sql(GRID, "SELECT r_idx, pt_hard_min, feature, threshold, gain, " + ", ".join(
    f"CAST({p}{k} AS BIGINT) AS {p}{k}" for p in "lt" for k in (1, 2, 3)) + " FROM bs"), ["threshold", "gain"])
def f9g(spark, sf):
    """The exact best cut of every grid point in one job."""
    cuts = votes.exact_stump(stored_rows(spark, sf), FEATURES, groups=GRID)
    return cuts.select(*GRID, "feature", "threshold", "gain", *[F.col(f"{p}{k}").cast("bigint").alias(f"{p}{k}") for p in "lt" for k in (1, 2, 3)])


@query("G1_sweep_cuts", _stump_sql(16, GRID, "SELECT r_idx, pt_hard_min, feature, threshold, gain, " + ", ".join(
    f"CAST(l{k} AS BIGINT) AS l{k}, CAST(t{k} AS BIGINT) AS t{k}" for k in (1, 2, 3)) + " FROM bs"), ["threshold", "gain"])
def g1(spark, sf):
    """The single best cut at every grid point, as one job over all of them."""
    rows = stored_rows(spark, sf)
    return votes.best_stump(votes.stump_counts(rows, FEATURES, 16, groups=GRID), 16, groups=GRID)


@query("F10_covariance", with_ctes(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, covar_samp({a}, {b}) AS cov FROM train" for i, a in enumerate(FEATURES) for b in FEATURES[i:]), "train"), ["cov"], 4)
def f10c(spark, sf):
    return S.covariance_matrix(training_rows(spark, sf), FEATURES)


_SIL1 = """
    , v AS (SELECT feature, value, """ + ", ".join(f"count(CASE WHEN label = {k} THEN 1 END)::DOUBLE AS n{k}" for k in (1, 2, 3)) + """ FROM long GROUP BY 1, 2),
    w AS (SELECT feature, value AS x, n1, n2, n3, """ + ", ".join(
    f"sum(n{k}) OVER o AS c{k}, sum(n{k} * value) OVER o AS p{k}, sum(n{k}) OVER a AS nn{k}, sum(n{k} * value) OVER a AS t{k}" for k in (1, 2, 3)) + """ FROM v
    WINDOW o AS (PARTITION BY feature ORDER BY value), a AS (PARTITION BY feature)),
    dd AS (SELECT *, """ + ", ".join(f"x * c{k} - p{k} + t{k} - p{k} - x * (nn{k} - c{k}) AS d{k}" for k in (1, 2, 3)) + """ FROM w),
    s AS (""" + " UNION ALL ".join(
    f"SELECT feature, {k} AS label, n{k} AS n, CASE WHEN nn{k} <= 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END AS s FROM "
    f"(SELECT *, d{k} / (nn{k} - 1) AS a, least({', '.join(f'd{o} / nullif(nn{o}, 0)' for o in (1, 2, 3) if o != k)}) AS b FROM dd WHERE n{k} > 0)" for k in (1, 2, 3)) + ")"


@query("F12_silhouette_1d", with_ctes(_SIL1 + " SELECT feature, sum(n * s) / sum(n) AS silhouette, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY 1", "long"), ["silhouette"])
def f12(spark, sf):
    return sil.silhouette_1d_mean(stored_rows(spark, sf), FEATURES)


@query("F12_silhouette_1d_hist", with_ctes(_SIL1 + f""" SELECT s.feature, {density_bin('s.s', 'r.lo', 'r.hi', 10)} AS bin, CAST(sum(n) AS BIGINT) AS n FROM s
       JOIN (SELECT feature, min(s) AS lo, max(s) AS hi FROM s GROUP BY 1) r ON s.feature = r.feature GROUP BY 1, 2""", "long"))
def f12h(spark, sf):
    s = sil.silhouette_1d(stored_rows(spark, sf), FEATURES)
    r = s.groupBy("feature").agg(F.min("silhouette").alias("lo"), F.max("silhouette").alias("hi"))
    return s.join(F.broadcast(r), "feature").groupBy("feature", dbin(F.col("silhouette"), F.col("lo"), F.col("hi"), 10).alias("bin")).agg(
        F.sum("n").alias("n"))


_PAIR_SCORE = """, own AS (SELECT {g}label, count(*) AS n FROM pts GROUP BY ALL),
    ds AS (SELECT {pg}p.id, p.label, q.label AS other, sum({dist}) AS d FROM pts p JOIN pts q ON {on} GROUP BY ALL),
    ab AS (SELECT {dg}ds.id, ds.label, max(CASE WHEN ds.label = ds.other THEN o.n END) AS own,
           max(CASE WHEN ds.label = ds.other THEN d / nullif(o.n - 1, 0) END) AS a, min(CASE WHEN ds.label <> ds.other THEN d / o.n END) AS b
           FROM ds JOIN own o ON {oj} GROUP BY ALL),
    sc AS (SELECT {sg}id, label, CASE WHEN own <= 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END AS silhouette FROM ab)"""


@query("F11_silhouette", ("WITH pts AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
       + _PAIR_SCORE.format(g="", sg="", pg="", dg="", dist="list_distance(p.v, q.v)", on="true", oj="ds.other = o.label")
       + " SELECT label, count(*) AS n, avg(silhouette) AS silhouette FROM sc GROUP BY 1"), ["silhouette"])
def f11(spark, sf):
    s = sil.silhouette_rows(V.embeddings(spark, sf), "vec_id", "vec")
    return s.groupBy("label").agg(F.count("*").alias("n"), F.avg("silhouette").alias("silhouette"))


_SQ = " + ".join(f"{c} * {c}" for c in FEATURES)


@query("F11_silhouette_squared", with_ctes(f""", m AS (SELECT label, count(*)::DOUBLE AS n, sum({_SQ}) AS q, {', '.join(f'sum({c}) AS s_{c}' for c in FEATURES)} FROM train GROUP BY 1),
    d AS (SELECT t.event_id, t.jet_id, t.label, m.label AS other, m.n, m.n * ({_SQ}) + m.q - 2 * ({' + '.join(f't.{c} * m.s_{c}' for c in FEATURES)}) AS d FROM train t, m),
    ab AS (SELECT event_id, jet_id, label, max(CASE WHEN label = other THEN d / (n - 1) END) AS a, min(CASE WHEN label <> other THEN d / n END) AS b FROM d GROUP BY 1, 2, 3)
    SELECT label, avg((b - a) / greatest(a, b)) AS silhouette FROM ab GROUP BY 1""", "train"), ["silhouette"])
def f11q(spark, sf):
    s = sil.silhouette_squared(stored_rows(spark, sf), FEATURES)
    return s.groupBy("label").agg(F.avg("silhouette").alias("silhouette"))


def _f13_rows(spark, sf):
    """Fakes and reals, and the same with min-max scaled features inside each grid point."""
    rows = P.class_filter(stored_rows(spark, sf), drop=[2]).select(*KEYS, *GRID, "label", *FEATURES)
    unit = P.minmax_scale(rows, FEATURES, GRID).select(*KEYS, *GRID, "label", F.array(*FEATURES).alias("vec"))
    return rows, stored(unit, "unit-rows")


_F13 = (""", raw AS (SELECT event_id, jet_id AS id, r_idx, pt_hard_min, label, """ + ", ".join(FEATURES) + """ FROM train WHERE label <> 2),
    pts AS (SELECT event_id, id, r_idx, pt_hard_min, label, """ + ", ".join(
    f"coalesce(({c} - min({c}) OVER w) / nullif(max({c}) OVER w - min({c}) OVER w, 0), 0) AS {c}" for c in FEATURES) + " FROM raw WINDOW w AS (PARTITION BY r_idx, pt_hard_min))"
    + _PAIR_SCORE.format(g="r_idx, pt_hard_min, ", sg="r_idx, pt_hard_min, event_id, ", pg="p.r_idx, p.pt_hard_min, p.event_id, ", dg="ds.r_idx, ds.pt_hard_min, ds.event_id, ",
                         dist="sqrt(" + " + ".join(f"(p.{c} - q.{c}) * (p.{c} - q.{c})" for c in FEATURES) + ")",
                         on="p.r_idx = q.r_idx AND p.pt_hard_min = q.pt_hard_min",
                         oj="ds.other = o.label AND ds.r_idx = o.r_idx AND ds.pt_hard_min = o.pt_hard_min"))


_F13_ROWS = with_ctes(_F13 + " SELECT r_idx, pt_hard_min, event_id, id AS jet_id, label, silhouette FROM sc", "train")


def _f13_scores(unit):
    return sil.silhouette_rows(unit, KEYS, "vec", groups=GRID)


@query("F13_silhouette_samples", _F13_ROWS, ["silhouette"])
def f13(spark, sf):
    return _f13_scores(_f13_rows(spark, sf)[1])


@query("F13_silhouette_cells", _F13_ROWS, ["silhouette"])
def f13c(spark, sf):
    """Bounded scores beside the exact ones: a score is shown as the exact one if it lies within its
    stated error of it, and as it is (and the check fails) otherwise."""
    unit = _f13_rows(spark, sf)[1]
    near = sil.silhouette_cells(unit, KEYS, "vec", groups=GRID, rows_per_cell=64).withColumnRenamed("silhouette", "near")
    both = near.join(_f13_scores(unit), [*GRID, *KEYS, "label"], "full")
    right = F.abs(F.col("near") - F.col("silhouette")) <= F.col("error") + 1e-9
    return both.select(*GRID, *KEYS, "label", F.when(right, F.col("silhouette")).otherwise(F.col("near")).alias("silhouette"))


@query("F13_silhouette_hist", with_ctes(_F13 + f""", j AS (SELECT sc.r_idx, sc.pt_hard_min, sc.label, raw.p_t_1, sc.silhouette FROM sc JOIN raw ON sc.id = raw.id AND sc.event_id = raw.event_id),
    r AS (SELECT r_idx, pt_hard_min, label, min(p_t_1) AS xl, max(p_t_1) AS xh, min(silhouette) AS yl, max(silhouette) AS yh FROM j GROUP BY 1, 2, 3)
    SELECT j.r_idx, j.pt_hard_min, j.label, {density_bin('j.p_t_1', 'r.xl', 'r.xh', 20)} AS bin_x, {density_bin('j.silhouette', 'r.yl', 'r.yh', 20)} AS bin_y, count(*) AS n
    FROM j JOIN r ON j.r_idx = r.r_idx AND j.pt_hard_min = r.pt_hard_min AND j.label = r.label GROUP BY ALL""", "train"))
def f13h(spark, sf):
    rows, unit = _f13_rows(spark, sf)
    # The histogram reads its rows twice: the scores are written once.
    j = stored(_f13_scores(unit).join(rows.select(*KEYS, "p_t_1"), KEYS), "scored-rows")
    return S.auto_histogram_2d(j, "p_t_1", "silhouette", 20, [*GRID, "label"])


