"""Typing, derivation, label and filter queries (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kinematics as K
from ..functions.binning import label_names, pt_label, purity_class
from ..operators import joins
from ..operators import prep as P
from ..operators import stats as S
from ..schema import ABLATIONS, DEFAULT_EDGES, FEATURES, KEYS, TWO_CLASS_EDGES
from ..sources import views as V
from .check_ctes import dphi, fixed_bin, with_ctes
from .features import features, stored_rows, training_rows
from .registry import query

C = V.constituents
CK = [*KEYS, "k1", "k2", "k3"]


@query("B1_type_cast", """SELECT o_orderkey AS key, CAST(CAST(CAST(o_totalprice AS VARCHAR) AS FLOAT) AS DOUBLE) AS p_t,
       CAST(o_orderkey % 7 AS BIGINT) AS n_trk FROM orders""", ["p_t"], 2)
def b1(spark, sf):
    text = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_totalprice").cast("string").alias("p_t"),
        (F.col("o_orderkey") % 7).cast("string").alias("n_trk"))
    return P.type_jets(text, float32=True)


@query("B2_derive_product", with_ctes("SELECT event_id, jet_id, x_tru * n_trk AS pythia_mom FROM feat", "feat"), ["pythia_mom"])
def b2(spark, sf):
    return P.signal_momentum(features(spark, sf)).select(*KEYS, "pythia_mom")


@query("B3_label_bins", with_ctes("""SELECT event_id, jet_id, label,
       CAST(CASE WHEN tru_sum > -1 AND tru_sum <= 1e-9 THEN 1 WHEN tru_sum > 1e-9 AND tru_sum <= 1e7 THEN 2 END AS INT) AS label2,
       CAST(CASE WHEN tru_sum > -1 AND tru_sum <= 1e-8 THEN 1 WHEN tru_sum > 1e-8 AND tru_sum <= 10 THEN 2 WHEN tru_sum > 10 AND tru_sum <= 1e7 THEN 3 END AS INT) AS label3,
       CAST(CASE WHEN tru_sum > -1 AND tru_sum <= 1e-9 THEN 0 WHEN tru_sum > 1e-9 AND tru_sum <= pt_hard_min THEN 1 WHEN tru_sum > pt_hard_min AND tru_sum <= 1e7 THEN 2 END AS INT) AS label_old
       FROM feat""", "feat"))
def b3(spark, sf):
    from ..functions.binning import cut_right_closed as cut

    x = F.col("tru_sum")
    jets = V.basic_jets(C(spark, sf))
    ptm = F.col("pt_hard_min").cast("double")
    return jets.select(*KEYS, pt_label(x, F.col("pt_hard_min"), strict=True).alias("label"), cut(x, TWO_CLASS_EDGES, [1, 2]).alias("label2"),
                       cut(x, DEFAULT_EDGES, [1, 2, 3]).alias("label3"), cut(x, [-1.0, 1e-9, ptm, 1e7], [0, 1, 2]).alias("label_old"))


@query("B4_label_names", with_ctes("""SELECT event_id, jet_id, label, CASE label WHEN 1 THEN 'Fake' WHEN 2 THEN 'Squish' WHEN 3 THEN 'Real' END AS label_name
       FROM feat""", "feat"))
def b4(spark, sf):
    jets = V.basic_jets(C(spark, sf))
    lab = jets.withColumn("label", pt_label(F.col("tru_sum"), F.col("pt_hard_min")))
    return lab.select(*KEYS, "label", label_names(F.col("label")).alias("label_name"))


_KEPT = ["event_id", "jet_id", "pt_hard_min", "r_idx", "angularity", "mean_p_t", "var_p_t", "p_t_1", "x_tru", "tru_sum", "area", "label"]


@query("B5_drop_features", with_ctes(f"SELECT {', '.join(_KEPT)} FROM feat", "feat"),
       ["angularity", "mean_p_t", "var_p_t", "p_t_1", "x_tru", "tru_sum", "area"])
def b5(spark, sf):
    return P.drop_features(features(spark, sf), "lean")


_AB_FEATS = [*FEATURES, "p_t_2"]


@query("B6_ablation_sets", with_ctes(" UNION ALL ".join(
    f"SELECT '{name}' AS subset, CAST({len([c for c in _AB_FEATS if c not in d])} AS INT) AS n_features, "
    f"{' + '.join('coalesce(avg(' + c + '), 0)' for c in _AB_FEATS if c not in d)} AS mean_sum FROM train"
    for name, d in ABLATIONS.items()), "train"), ["mean_sum"])
def b6(spark, sf):
    means = training_rows(spark, sf).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in _AB_FEATS])
    rows = []
    for name, dropped in ABLATIONS.items():
        use = [c for c in _AB_FEATS if c not in dropped]
        rows.append(F.struct(F.lit(name).alias("subset"), F.lit(len(use)).alias("n_features"),
                             sum((F.col(c) for c in use[1:]), F.col(use[0])).alias("mean_sum")))
    return means.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


_SPLIT_COLS = ["event_id", "jet_id", "pt_hard_min", "r_idx", *[c for c in _KEPT[4:] if c not in ("x_tru", "tru_sum", "label")], "label"]


@query("B7_feature_label_split", with_ctes(f"SELECT {', '.join(_SPLIT_COLS)} FROM feat", "feat"),
       ["angularity", "mean_p_t", "var_p_t", "p_t_1", "area"])
def b7(spark, sf):
    return P.feature_label_split(P.drop_features(P.signal_momentum(features(spark, sf)).withColumn("label_name", label_names(F.col("label"))), "lean"))


@query("B8_low_pt_filter", with_ctes("""SELECT event_id, jet_id, p_t, p_t < 100 AS fixed_cut FROM jets
       WHERE p_t < 100 + (pt_hard_min / 10.0::DOUBLE - 1) * 20""", "jets"), ["p_t"])
def b8(spark, sf):
    return P.low_pt(V.basic_jets(C(spark, sf)), adaptive=True).select(*KEYS, "p_t", (F.col("p_t") < 100).alias("fixed_cut"))


@query("B9_class_filter", with_ctes("SELECT label, r_idx, count(*) AS n FROM feat WHERE label <> 2 GROUP BY 1, 2", "feat"))
def b9(spark, sf):
    jets = V.basic_jets(C(spark, sf)).withColumn("label", pt_label(F.col("tru_sum"), F.col("pt_hard_min")))
    return P.class_filter(jets, drop=[2]).groupBy("label", "r_idx").agg(F.count("*").alias("n"))


@query("B10_minmax_scale", with_ctes("SELECT event_id, jet_id, " + ", ".join(
    f"coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0) AS {c}" for c in FEATURES) + " FROM train", "train"), FEATURES)
def b10(spark, sf):
    return P.minmax_scale(stored_rows(spark, sf).select(*KEYS, *FEATURES), FEATURES)


@query("B11_purity_class", with_ctes("""SELECT event_id, jet_id, CAST(CASE WHEN x < 0.1::DOUBLE THEN 0 WHEN x < 0.5 THEN 1 WHEN x < 0.9::DOUBLE THEN 2
       WHEN x IS NOT NULL THEN 3 END AS INT) AS purity FROM (SELECT *, CASE WHEN p_t > 0 THEN tru_sum / p_t END AS x FROM jets)""", "jets"))
def b11(spark, sf):
    return V.basic_jets(C(spark, sf)).select(*KEYS, purity_class(F.try_divide("tru_sum", "p_t")).alias("purity"))


@query("B12_class_encode", """SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'O' THEN 3 WHEN 'P' THEN 2 WHEN 'F' THEN 1 END AS INT) AS code FROM orders""")
def b12(spark, sf):
    o = V.table(spark, sf, "orders")
    name = F.when(F.col("o_orderstatus") == "O", "real").when(F.col("o_orderstatus") == "P", "squish").when(F.col("o_orderstatus") == "F", "fake").otherwise("none")
    return o.select("o_orderkey", P.class_encode(name).alias("code"))


_KIN = ["pt", "p", "eta", "phi", "energy", "dca"]


@query("B13_kinematics", with_ctes("""SELECT event_id, jet_id, k1, k2, k3, sqrt(px * px + py * py) AS pt, sqrt(px * px + py * py + pz * pz) AS p,
       0.5::DOUBLE * ln((sqrt(px * px + py * py + pz * pz) + pz) / nullif(sqrt(px * px + py * py + pz * pz) - pz, 0)) AS eta,
       pi() + atan2(-py, -px) AS phi, sqrt(px * px + py * py + pz * pz + 0.13957::DOUBLE * 0.13957::DOUBLE) AS energy,
       sqrt(vx * vx + vy * vy + vz * vz) * 1000 AS dca FROM parts WHERE px * px + py * py > 0.0225""", "parts"), _KIN, 5)
def b13(spark, sf):
    p = V.particles(spark, sf).where(F.col("px") * F.col("px") + F.col("py") * F.col("py") > 0.0225)
    k = K.kinematics(F.col("px"), F.col("py"), F.col("pz"), F.lit(0.13957))
    return p.select(*CK, *[c.alias(n) for n, c in k.items()], K.vertex_distance_um(F.col("vx"), F.col("vy"), F.col("vz")).alias("dca"))


@query("B14_species_mass", with_ctes("""SELECT kf, mass, count(*) AS n FROM (SELECT kf, CASE abs(kf) WHEN 211 THEN 0.13957 WHEN 321 THEN 0.493677
       WHEN 2212 THEN 0.938272 WHEN 111 THEN 0.134977 END AS mass FROM (SELECT CAST(CASE k2 % 6 WHEN 0 THEN 211 WHEN 1 THEN -211 WHEN 2 THEN 321 WHEN 3 THEN -2212
       WHEN 4 THEN 111 ELSE 22 END AS INT) AS kf FROM constits)) GROUP BY 1, 2""", "constits"), ["mass"])
def b14(spark, sf):
    k = F.col("k2") % 6
    kf = F.when(k == 0, 211).when(k == 1, -211).when(k == 2, 321).when(k == 3, -2212).when(k == 4, 111).otherwise(22)
    return joins.species_mass(C(spark, sf).select(kf.alias("kf"))).groupBy("kf", "mass").agg(F.count("*").alias("n"))


@query("B15_acceptance_cut", with_ctes("""SELECT event_id, jet_id, count(*) AS n, sum(pt) AS pt FROM constits
       WHERE pt > 0.15 AND abs(eta) < 0.9::DOUBLE AND k1 % 5 <> 0 GROUP BY 1, 2""", "constits"), ["pt"])
def b15(spark, sf):
    status = F.when(F.col("k1") % 5 != 0, 1).otherwise(0)
    return P.particle_cut(C(spark, sf), status=status).groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum("pt").alias("pt"))


@query("B15_jet_acceptance", with_ctes("""SELECT event_id, jet_id, p_t, eta FROM feat
       WHERE p_t >= pt_hard_min AND p_t <= 10000 AND abs(eta) < 0.9::DOUBLE - (0.2::DOUBLE + 0.1::DOUBLE * r_idx)""", "feat"), ["p_t", "eta"])
def b15j(spark, sf):
    return P.jet_cut(features(spark, sf), F.col("pt_hard_min")).select(*KEYS, "p_t", "eta")


@query("B16_plane_class", with_ctes("""SELECT plane, count(*) AS n, sum(pt) AS pt FROM (SELECT pt, CASE
       WHEN (phi >= 0 AND phi < 0.524::DOUBLE) OR (phi >= 5.76::DOUBLE AND phi < 6.283::DOUBLE) OR (phi >= 2.618::DOUBLE AND phi < 3.665::DOUBLE) THEN 'in_plane'
       WHEN (phi >= 0.524::DOUBLE AND phi < 1.047::DOUBLE) OR (phi >= 5.236::DOUBLE AND phi < 5.76::DOUBLE) OR (phi >= 2.094::DOUBLE AND phi < 2.618::DOUBLE) OR (phi >= 3.665::DOUBLE AND phi < 4.189::DOUBLE) THEN 'mid_plane'
       WHEN (phi >= 1.047::DOUBLE AND phi < 2.094::DOUBLE) OR (phi >= 4.189::DOUBLE AND phi < 5.236::DOUBLE) THEN 'out_of_plane' END AS plane FROM constits) GROUP BY 1""", "constits"), ["pt"], 3)
def b16(spark, sf):
    return C(spark, sf).groupBy(K.plane_class(F.col("phi")).alias("plane")).agg(F.count("*").alias("n"), F.sum("pt").alias("pt"))


@query("B17_delta_angle", with_ctes(f"""SELECT event_id, jet_id, k1, k2, k3, {dphi('phi', 'axis_phi')} AS dphi, eta - axis_eta AS deta, dr FROM near""", "near"),
       ["dphi", "deta", "dr"])
def b17(spark, sf):
    from ..operators import jets as J

    live = C(spark, sf).where(J.not_ghost())
    near = J.with_axis(live, J.jet_axis(live), probe=V.jet_sizes(spark, sf))
    return near.select(*CK, K.delta_phi(F.col("phi"), F.col("axis_phi")).alias("dphi"), K.delta_eta(F.col("eta"), F.col("axis_eta")).alias("deta"), "dr")


@query("A12_filtered_draw", with_ctes(f"""SELECT {fixed_bin('p_t_corr', -100, 300, 100)} AS bin, count(*) AS n FROM feat WHERE mean_p_t > 30
       GROUP BY 1""", "feat"))
def a12(spark, sf):
    from ..sources.jet_csv import filtered_draw

    drawn = filtered_draw(features(spark, sf), "mean_p_t > 30", "p_t_corr")
    return S.fixed_histogram(drawn, F.col("x"), -100, 300, 100).select("bin", "n")


