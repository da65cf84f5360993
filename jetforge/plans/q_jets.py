"""Jet- and event-level queries (E, W1, W5, D13, D14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordering import top_k
from ..operators import background as bg
from ..operators import jets as J
from ..operators import stats as S
from ..schema import KEYS
from ..sources import views as V
from .check_ctes import dphi, fixed_bin, with_ctes
from .features import features
from .registry import query

C = V.constituents


def basic(spark, sf):
    return V.basic_jets(C(spark, sf))


@query("E1_jet_axis", with_ctes("""SELECT j.event_id, j.jet_id, j.p_t, l.eta, l.phi FROM jets j
       LEFT JOIN lead l ON j.event_id = l.event_id AND j.jet_id = l.jet_id""", "jets", "lead"), ["p_t", "eta", "phi"])
def e1(spark, sf):
    return J.jet_axis(C(spark, sf))


@query("E2_n_trk", with_ctes("SELECT event_id, jet_id, n_trk FROM jets", "jets"))
def e2(spark, sf):
    return J.track_counts(C(spark, sf))


@query("E3_mean_var_pt", with_ctes("""SELECT event_id, jet_id, avg(CASE WHEN pt > 1e-50 THEN pt END) AS mean_p_t,
       var_pop(CASE WHEN pt > 1e-50 THEN pt END) AS var_p_t FROM constits GROUP BY 1, 2""", "constits"), ["mean_p_t", "var_p_t"])
def e3(spark, sf):
    return J.pt_moments(C(spark, sf))


@query("E4_leading_k", with_ctes("SELECT * FROM lead", "lead"), ["eta", "phi", *[f"p_t_{i}" for i in range(1, 6)]])
def e4(spark, sf):
    return J.leading(C(spark, sf))


@query("E5_lesub", with_ctes("SELECT event_id, jet_id, p_t_1 - p_t_2 AS lesub FROM lead WHERE p_t_2 IS NOT NULL", "lead"), ["lesub"])
def e5(spark, sf):
    return J.leading_minus_subleading(C(spark, sf))


@query("E6_frag_z", with_ctes("""SELECT l.event_id, l.jet_id, l.k1, l.k2, l.k3, l.pt / j.p_t AS z FROM live l
       JOIN jets j ON l.event_id = j.event_id AND l.jet_id = j.jet_id""", "live", "jets"), ["z"])
def e6(spark, sf):
    return J.fragmentation(C(spark, sf), probe=V.jet_sizes(spark, sf)).select(*KEYS, "k1", "k2", "k3", "z")


@query("E7_angularity", with_ctes("SELECT event_id, jet_id, angularity, angularity_nw FROM near_agg", "near_agg"), ["angularity", "angularity_nw"])
def e7(spark, sf):
    return J.angularity(C(spark, sf), probe=V.jet_sizes(spark, sf))


@query("E8_signal_sums", with_ctes("""SELECT event_id, jet_id, tru_sum, fake_sum, tru_sum / n AS x_tru, fake_sum / n AS x_fake,
       tru_sum / p_t AS x_tru_share FROM (SELECT event_id, jet_id, count(*) AS n, sum(pt) AS p_t,
       sum(CASE WHEN user_index <> 0 THEN pt ELSE 0 END) AS tru_sum, sum(CASE WHEN user_index = 0 THEN pt ELSE 0 END) AS fake_sum
       FROM live GROUP BY 1, 2)""", "live"), ["tru_sum", "fake_sum", "x_tru", "x_fake", "x_tru_share"])
def e8(spark, sf):
    return J.signal_sums(C(spark, sf))


@query("E9_first_signal", with_ctes("SELECT * FROM first_sig", "first_sig"))
def e9(spark, sf):
    return J.first_signal(C(spark, sf))


@query("E10_origin_fractions", with_ctes("""SELECT j.event_id, j.jet_id, j.p_t, a.quark / j.p_t AS y_quark, a.gluon / j.p_t AS y_gluon,
       a.beam / j.p_t AS y_beam, a.bkgd / j.p_t AS y_bkgd FROM jets j LEFT JOIN near_agg a
       ON j.event_id = a.event_id AND j.jet_id = a.jet_id""", "jets", "near_agg"), ["p_t", "y_quark", "y_gluon", "y_beam", "y_bkgd"])
def e10(spark, sf):
    return J.origin_fractions(C(spark, sf))


@query("E11_origin_class", with_ctes("""SELECT event_id, jet_id, CAST(CASE WHEN b AND p THEN 2 WHEN b THEN 1 WHEN p THEN 3 END AS INT) AS origin_class
       FROM (SELECT event_id, jet_id, bool_or(pt > 1e-50 AND user_index <> 0 AND origin_kf = 2212) AS b,
       bool_or(pt > 1e-50 AND user_index <> 0 AND origin_kf <> 2212) AS p FROM constits GROUP BY 1, 2)""", "constits"))
def e11(spark, sf):
    return J.origin_class(C(spark, sf))


@query("E12_pure_spectrum", with_ctes(f"""SELECT kind, {fixed_bin('p_t', 0, 500, 500)} AS bin, count(*) AS n FROM (
       SELECT 'quark' AS kind, p_t FROM feat WHERE y_quark > 0.99 UNION ALL SELECT 'gluon', p_t FROM feat WHERE y_gluon > 0.99)
       GROUP BY 1, 2""", "feat"))
def e12(spark, sf):
    y = J.origin_fractions(C(spark, sf))
    kinds = F.array(F.when(F.col("y_quark") > 0.99, "quark"), F.when(F.col("y_gluon") > 0.99, "gluon"))
    pure = y.select("p_t", F.explode(F.array_compact(kinds)).alias("kind"))
    return S.fixed_histogram(pure, F.col("p_t"), 0, 500, 500, ["kind"]).select("kind", "bin", "n")


@query("E13_epsilon", with_ctes("SELECT event_id, jet_id, p_t / area AS epsilon FROM jets", "jets"), ["epsilon"])
def e13(spark, sf):
    return bg.epsilon(basic(spark, sf)).select(*KEYS, "epsilon")


@query("E14_rho_median", with_ctes("SELECT event_id, quantile_cont(p_t / area, 0.5) AS rho FROM jets GROUP BY 1", "jets"), ["rho"])
def e14(spark, sf):
    return bg.rho_median(basic(spark, sf), sizes=V.event_sizes(spark, sf))


@query("E15_rho_median_drop2", with_ctes("SELECT * FROM rho2", "rho2"), ["rho"])
def e15(spark, sf):
    return bg.rho_median_drop2(basic(spark, sf), sizes=V.event_sizes(spark, sf))


@query("E16_ghost_stats", with_ctes("""SELECT r.event_id, count(*) AS n_jets, count(CASE WHEN n_trk = 0 THEN 1 END) AS n_ghost,
       avg(CASE WHEN n_trk = 0 THEN 1.0::DOUBLE ELSE 0 END) AS ghost_share,
       coalesce(quantile_cont(CASE WHEN p_t > 1e-50 THEN epsilon END, 0.5), 0) AS rho_all,
       coalesce(quantile_cont(epsilon, 0.5), 0) AS rho_all_ghosts,
       coalesce(quantile_cont(CASE WHEN p_t > 1e-50 AND rn > least(2, n_jets - 1) THEN epsilon END, 0.5), 0) AS rho_drop2,
       coalesce(quantile_cont(CASE WHEN rn > least(2, n_jets - 1) THEN epsilon END, 0.5), 0) AS rho_drop2_ghosts
       FROM ranked r GROUP BY 1""", "ranked"), ["ghost_share", "rho_all", "rho_all_ghosts", "rho_drop2", "rho_drop2_ghosts"])
def e16(spark, sf):
    return bg.ghost_stats(basic(spark, sf), sizes=V.event_sizes(spark, sf))


@query("E17_pt_corr", with_ctes("""SELECT j.event_id, j.jet_id, j.p_t, j.p_t - r.rho * j.area AS p_t_corr FROM jets j
       JOIN rho2 r ON j.event_id = r.event_id""", "jets", "rho2"), ["p_t", "p_t_corr"])
def e17(spark, sf):
    jets = bg.with_rho_drop2(basic(spark, sf), sizes=V.event_sizes(spark, sf))
    return bg.pt_corr(jets).select(*KEYS, "p_t", "p_t_corr")


@query("E18_subjet_share", with_ctes("""SELECT event_id, jet_id, coalesce(max(cell) / nullif(sum(cell), 0), -1) AS z_subjet FROM (
       SELECT event_id, jet_id, sum(CASE WHEN pt > 1e-50 AND user_index <> 0 THEN pt ELSE 0 END) AS cell FROM constits
       GROUP BY event_id, jet_id, floor(eta / 0.1::DOUBLE), floor(phi / 0.1::DOUBLE)) GROUP BY 1, 2""", "constits"), ["z_subjet"])
def e18(spark, sf):
    return J.subjet_share(C(spark, sf))


@query("E19_jet_rank", with_ctes("SELECT event_id, jet_id, rn AS jet_rank FROM ranked", "ranked"))
def e19(spark, sf):
    return bg.jet_rank(basic(spark, sf), sizes=V.event_sizes(spark, sf)).select(*KEYS, "jet_rank")


@query("W1_leading_jets", with_ctes("SELECT event_id, jet_id, CAST(rn AS INT) AS rn, p_t FROM ranked WHERE rn <= 3", "ranked"), ["p_t"])
def w1(spark, sf):
    jets = basic(spark, sf).select(*KEYS, "p_t")
    return top_k(jets, ["event_id"], [F.col("p_t").desc(), F.col("jet_id")], 3).select(*KEYS, "rn", "p_t")


@query("W5_top_k", with_ctes("""SELECT event_id, jet_id, k1, k2, k3, CAST(rn AS INT) AS rn, pt FROM (SELECT *,
       row_number() OVER (PARTITION BY event_id, jet_id ORDER BY pt DESC, k1, k2, k3) AS rn FROM live) WHERE rn <= 2""", "live"), ["pt"])
def w5(spark, sf):
    rows = C(spark, sf).where(J.not_ghost()).select(*KEYS, "k1", "k2", "k3", "pt")
    return top_k(rows, KEYS, [F.col("pt").desc(), F.col("k1"), F.col("k2"), F.col("k3")], 2)


@query("D13_event_plane", with_ctes("SELECT event_id, " + ", ".join(
    f"(pi() + atan2(-sum(pt * sin(phi * {n})), -sum(pt * cos(phi * {n})))) / {n} AS psi_{n}" for n in range(1, 6))
    + " FROM live GROUP BY 1", "live"), [f"psi_{n}" for n in range(1, 6)])
def d13(spark, sf):
    return bg.event_plane(C(spark, sf).where(J.not_ghost()))


@query("D13_event_plane_hist", with_ctes(f"""SELECT CAST(n AS INT) AS harmonic, CAST(CASE WHEN psi < -pi() / 2 THEN 0 WHEN psi >= 5 * pi() / 2 THEN 201
       ELSE 1 + floor(200 * (psi + pi() / 2) / (5 * pi() / 2 + pi() / 2)) END AS INT) AS bin, count(*) AS n FROM (
       """ + " UNION ALL ".join(f"SELECT {n} AS n, (pi() + atan2(-sum(pt * sin(phi * {n})), -sum(pt * cos(phi * {n})))) / {n} AS psi FROM live GROUP BY event_id"
                               for n in range(1, 6)) + ") GROUP BY 1, 2", "live"))
def d13h(spark, sf):
    import math

    psi = bg.event_plane(C(spark, sf).where(J.not_ghost()))
    long = psi.select(F.posexplode(F.array(*[F.col(f"psi_{n}") for n in range(1, 6)])).alias("p", "psi")).select(
        (F.col("p") + 1).alias("harmonic"), "psi")
    return S.fixed_histogram(long, F.col("psi"), -math.pi / 2, 5 * math.pi / 2, 200, ["harmonic"]).select("harmonic", "bin", "n")


@query("D14_counters", with_ctes("""SELECT kind, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM (
       SELECT CASE WHEN n_trk = 0 THEN 'ghost' WHEN tru_sum = 0 THEN 'background' WHEN tru_sum = p_t THEN 'signal' ELSE 'mixed' END AS kind
       FROM jets) GROUP BY 1""", "jets"), ["share"])
def d14(spark, sf):
    jets = basic(spark, sf)
    kind = (F.when(F.col("n_trk") == 0, "ghost").when(F.col("tru_sum") == 0, "background")
            .when(F.col("tru_sum") == F.col("p_t"), "signal").otherwise("mixed"))
    return S.counters(jets.withColumn("kind", kind), "kind")


_FEAT_DOUBLES = ["p_t", "eta", "phi", "angularity", "angularity_nw", "mean_p_t", "var_p_t", "p_t_1", "p_t_2", "p_t_3", "p_t_4", "p_t_5",
                 "x_tru", "y_quark", "y_gluon", "y_beam", "y_bkgd", "tru_sum", "area", "epsilon", "p_t_corr"]


@query("P1_feature_table", with_ctes("SELECT * FROM feat", "feat"), _FEAT_DOUBLES)
def p1(spark, sf):
    return features(spark, sf)


ENTRY_SQL = with_ctes("SELECT label, count(*) AS n, avg(p_t_corr) AS mean_p_t_corr FROM feat GROUP BY 1", "feat")


@query("P0_class_summary", ENTRY_SQL, ["mean_p_t_corr"])
def p0(spark, sf):
    """Constituents to jets, background subtraction, labels, class summary."""
    return features(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.avg("p_t_corr").alias("mean_p_t_corr"))


@query("D8_hist_2d_weighted", with_ctes(f"""SELECT {fixed_bin('dphi', -1, 1, 200)} AS bin_x, {fixed_bin('deta', -1, 1, 200)} AS bin_y, count(*) AS n,
       sum(pt) AS sumw, sum(pt * pt) AS sumw2 FROM (SELECT {dphi('phi', 'axis_phi')} AS dphi, axis_eta - eta AS deta, pt FROM near)
       GROUP BY 1, 2""", "near"), ["sumw", "sumw2"], 3)
def d8(spark, sf):
    from ..functions.kinematics import delta_phi

    live = C(spark, sf).where(J.not_ghost())
    near = J.with_axis(live, J.jet_axis(live), probe=V.jet_sizes(spark, sf))
    return S.histogram_2d(near, delta_phi(F.col("phi"), F.col("axis_phi")), (-1, 1, 200),
                          F.col("axis_eta") - F.col("eta"), (-1, 1, 200), weight=F.col("pt"))
