"""Building blocks of the check SQL: the views of the query catalogue as plain SQL."""

from __future__ import annotations

from ..schema import FEATURES, GHOST_PT

TWO_PI = "(2 * pi())"


def dphi(a: str, b: str) -> str:
    x = f"({a} - {b} + pi())"
    return f"({x} - {TWO_PI} * floor({x} / {TWO_PI}) - pi())"


def dr(eta_a: str, phi_a: str, eta_b: str, phi_b: str) -> str:
    d = dphi(phi_a, phi_b)
    return f"sqrt({d} * {d} + ({eta_a} - {eta_b}) * ({eta_a} - {eta_b}))"


def h60(*parts: str, seed: object = 42) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def fixed_bin(x: str, lo: float, hi: float, n: int) -> str:
    return (f"CAST(CASE WHEN {x} < {lo}::DOUBLE THEN 0 WHEN {x} >= {hi}::DOUBLE THEN {n + 1} "
            f"ELSE 1 + floor({n} * ({x} - {lo}::DOUBLE) / ({hi}::DOUBLE - {lo}::DOUBLE)) END AS INT)")


def density_bin(x: str, lo: str, hi: str, n: int) -> str:
    return (f"CAST(CASE WHEN {hi} - {lo} = 0 THEN 0 ELSE least(floor(({x} - {lo}) * {n}::DOUBLE / ({hi} - {lo})), {n - 1}) END AS INT)")


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "constits": ((), """
        SELECT o.o_custkey AS event_id, l.l_orderkey AS jet_id,
               l.l_linenumber AS k1, l.l_partkey AS k2, l.l_suppkey AS k3,
               CASE WHEN l.l_discount = 0 THEN CAST(0 AS DOUBLE) ELSE l.l_extendedprice / 1000 END AS pt,
               CAST(l.l_partkey % 1801 AS DOUBLE) / 1000 - CAST(0.9 AS DOUBLE) AS eta,
               CAST((l.l_suppkey * 97 + l.l_linenumber * 613) % 6283 AS DOUBLE) / 1000 AS phi,
               CAST(CASE WHEN l.l_returnflag = 'R' THEN 1 + l.l_suppkey % 8 ELSE 0 END AS INT) AS user_index,
               CAST(CASE WHEN l.l_returnflag <> 'R' THEN 0 WHEN l.l_suppkey % 4 = 1 THEN 2212
                    WHEN l.l_suppkey % 4 = 2 THEN 21 ELSE 1 END AS INT) AS origin_kf,
               CAST(o.o_orderkey % 5 AS INT) AS r_idx,
               CAST(10 * (1 + o.o_custkey % 4) AS INT) AS pt_hard_min
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""),
    "live": (("constits",), f"SELECT * FROM constits WHERE pt > {GHOST_PT}"),
    "jets": (("constits",), """
        SELECT event_id, jet_id, max(pt_hard_min) AS pt_hard_min, max(r_idx) AS r_idx, sum(pt) AS p_t,
               CAST(10 + jet_id % 50 AS DOUBLE) / 100 AS area,
               CAST(sum(CASE WHEN pt > 1e-50 THEN 1 ELSE 0 END) AS BIGINT) AS n_trk,
               sum(CASE WHEN user_index <> 0 THEN pt ELSE 0 END) AS tru_sum
        FROM constits GROUP BY event_id, jet_id"""),
    "lead": (("live",), """
        SELECT event_id, jet_id, max(CASE WHEN rn = 1 THEN eta END) AS eta, max(CASE WHEN rn = 1 THEN phi END) AS phi,
               max(CASE WHEN rn = 1 THEN pt END) AS p_t_1, max(CASE WHEN rn = 2 THEN pt END) AS p_t_2,
               max(CASE WHEN rn = 3 THEN pt END) AS p_t_3, max(CASE WHEN rn = 4 THEN pt END) AS p_t_4,
               max(CASE WHEN rn = 5 THEN pt END) AS p_t_5
        FROM (SELECT *, row_number() OVER (PARTITION BY event_id, jet_id ORDER BY pt DESC, k1, k2, k3) AS rn FROM live)
        GROUP BY event_id, jet_id"""),
    "near": (("live", "lead"), f"""
        SELECT c.*, l.eta AS axis_eta, l.phi AS axis_phi, {dr('c.eta', 'c.phi', 'l.eta', 'l.phi')} AS dr
        FROM live c JOIN lead l ON c.event_id = l.event_id AND c.jet_id = l.jet_id"""),
    "ranked": (("jets",), """
        SELECT *, p_t / area AS epsilon, row_number() OVER (PARTITION BY event_id ORDER BY p_t DESC, jet_id) AS rn,
               count(*) OVER (PARTITION BY event_id) AS n_jets FROM jets"""),
    "rho2": (("ranked",), """
        SELECT event_id, coalesce(quantile_cont(CASE WHEN rn > least(2, n_jets - 1) THEN epsilon END, 0.5), 0) AS rho
        FROM ranked GROUP BY event_id"""),
    "near_agg": (("near",), """
        SELECT event_id, jet_id, sum(pt * dr) / sum(pt) AS angularity, avg(dr) AS angularity_nw,
               avg(pt) AS mean_p_t, var_pop(pt) AS var_p_t,
               sum(CASE WHEN user_index <> 0 AND origin_kf NOT IN (2212, 21, 9) THEN pt ELSE 0 END) AS quark,
               sum(CASE WHEN user_index <> 0 AND origin_kf IN (21, 9) THEN pt ELSE 0 END) AS gluon,
               sum(CASE WHEN user_index <> 0 AND origin_kf = 2212 THEN pt ELSE 0 END) AS beam,
               sum(CASE WHEN user_index = 0 THEN pt ELSE 0 END) AS bkgd
        FROM near GROUP BY event_id, jet_id"""),
    "feat": (("jets", "lead", "near_agg", "rho2"), """
        SELECT j.event_id, j.jet_id, j.pt_hard_min, j.r_idx, j.p_t, l.eta, l.phi, j.n_trk,
               a.angularity, a.angularity_nw, a.mean_p_t, a.var_p_t, l.p_t_1, l.p_t_2, l.p_t_3, l.p_t_4, l.p_t_5,
               CASE WHEN j.n_trk > 0 THEN j.tru_sum / j.n_trk END AS x_tru,
               a.quark / j.p_t AS y_quark, a.gluon / j.p_t AS y_gluon, a.beam / j.p_t AS y_beam, a.bkgd / j.p_t AS y_bkgd,
               j.tru_sum, j.area, j.p_t / j.area AS epsilon, j.p_t - r.rho * j.area AS p_t_corr,
               CAST(CASE WHEN j.tru_sum > -1 AND j.tru_sum <= CAST(0.05 AS DOUBLE) * pow(CAST(j.pt_hard_min AS DOUBLE), 1.5) THEN 1
                    WHEN j.tru_sum > CAST(0.05 AS DOUBLE) * pow(CAST(j.pt_hard_min AS DOUBLE), 1.5) AND j.tru_sum <= CAST(0.8 AS DOUBLE) * j.pt_hard_min THEN 2
                    WHEN j.tru_sum > CAST(0.8 AS DOUBLE) * j.pt_hard_min AND j.tru_sum <= 1e7 THEN 3 END AS INT) AS label
        FROM jets j LEFT JOIN lead l ON j.event_id = l.event_id AND j.jet_id = l.jet_id
        LEFT JOIN near_agg a ON j.event_id = a.event_id AND j.jet_id = a.jet_id
        JOIN rho2 r ON j.event_id = r.event_id"""),
    "matched": (("live", "jets", "lead", "first_sig"), f"""
        WITH tp AS (SELECT * FROM live WHERE user_index > 0),
             tl AS (SELECT event_id, jet_id, sum(pt) AS truth_pt, max(CASE WHEN rn = 1 THEN eta END) AS truth_eta, max(CASE WHEN rn = 1 THEN phi END) AS truth_phi
                    FROM (SELECT *, row_number() OVER (PARTITION BY event_id, jet_id ORDER BY pt DESC, k1, k2, k3) AS rn FROM tp) GROUP BY 1, 2),
             best AS (SELECT * FROM (SELECT h.event_id, h.user_index, h.jet_id AS truth_jet, t.truth_pt, t.truth_eta, t.truth_phi,
                      row_number() OVER (PARTITION BY h.event_id, h.user_index ORDER BY t.truth_pt DESC, h.jet_id) AS rn
                      FROM (SELECT DISTINCT event_id, jet_id, user_index FROM tp) h JOIN tl t ON h.event_id = t.event_id AND h.jet_id = t.jet_id) WHERE rn = 1)
        SELECT j.event_id, j.jet_id, coalesce({dr('l.eta', 'l.phi', 'b.truth_eta', 'b.truth_phi')}, 1e6) AS dist_match, coalesce(j.tru_sum / b.truth_pt, 0) AS x_match
        FROM jets j JOIN first_sig f ON j.event_id = f.event_id AND j.jet_id = f.jet_id
        LEFT JOIN lead l ON j.event_id = l.event_id AND j.jet_id = l.jet_id LEFT JOIN best b ON j.event_id = b.event_id AND f.first_signal = b.user_index"""),
    "full24": (("feat", "matched", "constits"), """
        SELECT f.*, round(0.2::DOUBLE + 0.1::DOUBLE * f.r_idx, 1) AS radius, m.dist_match, m.x_match, s.z_subjet FROM feat f
        JOIN matched m ON f.event_id = m.event_id AND f.jet_id = m.jet_id
        JOIN (SELECT event_id, jet_id, coalesce(max(cell) / nullif(sum(cell), 0), -1) AS z_subjet FROM (
                SELECT event_id, jet_id, sum(CASE WHEN pt > 1e-50 AND user_index <> 0 THEN pt ELSE 0 END) AS cell FROM constits
                GROUP BY event_id, jet_id, floor(eta / 0.1::DOUBLE), floor(phi / 0.1::DOUBLE)) GROUP BY 1, 2) s ON f.event_id = s.event_id AND f.jet_id = s.jet_id"""),
    "train": (("feat",), "SELECT * FROM feat WHERE n_trk > 0"),
    "long": (("train",), " UNION ALL ".join(
        f"SELECT '{c}' AS feature, label, event_id, jet_id, r_idx, pt_hard_min, CAST({c} AS DOUBLE) AS value FROM train" for c in FEATURES)),
    "scored": (("train",), f"""
        SELECT *, CASE WHEN p_t_corr > 20 THEN 3 WHEN p_t_corr > -20 THEN 2 ELSE 1 END AS pred,
               CASE WHEN {h60('event_id', 'jet_id')} % 10000 < 2000 THEN 'test' ELSE 'train' END AS split,
               CAST({h60('event_id', 'jet_id', seed='batch')} % 5 AS INT) AS batch_id FROM train"""),
    "balanced": (("train",), f"""
        WITH o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {h60('event_id', 'jet_id')}, event_id, jet_id) AS ord,
                          count(*) OVER (PARTITION BY label) AS nc FROM train),
             d AS (SELECT c.label, c.nc, u.id FROM (SELECT DISTINCT label, nc FROM o WHERE label IN (1, 2)) c,
                          (SELECT unnest(range(1, (SELECT count(*) FROM train WHERE label = 3) + 1)) AS id) u),
             drawn AS (SELECT label, {h60('label', 'id')} % nc + 1 AS ord FROM d)
        SELECT b.*, CASE WHEN {h60('event_id', 'jet_id')} % 10000 < 2000 THEN 'test' ELSE 'train' END AS split
        FROM (SELECT o.* FROM o JOIN drawn ON o.label = drawn.label AND o.ord = drawn.ord UNION ALL SELECT * FROM o WHERE label = 3) b"""),
    "ev": ((), "SELECT event_id, ts, user_id, event_type, value FROM events"),
    "parts": (("constits",), """
        SELECT event_id, jet_id, k1, k2, k3, user_index, origin_kf, pt * cos(phi) AS px, pt * sin(phi) AS py,
               pt * (exp(eta) - exp(-eta)) / 2 AS pz, CAST(k2 % 7 AS DOUBLE) AS vx, CAST(k3 % 5 AS DOUBLE) AS vy,
               CAST(k1 AS DOUBLE) AS vz FROM constits"""),
    "first_sig": (("constits",), """
        SELECT event_id, jet_id, CAST(coalesce(max(CASE WHEN rn = 1 AND hit THEN user_index END), 0) AS INT) AS first_signal
        FROM (SELECT *, pt > 1e-50 AND user_index > 0 AS hit,
                     row_number() OVER (PARTITION BY event_id, jet_id ORDER BY (pt > 1e-50 AND user_index > 0) DESC, k1, k2, k3) AS rn FROM constits)
        GROUP BY event_id, jet_id"""),
}


def with_ctes(body: str, *names: str, recursive: bool = False) -> str:
    """Prefix a statement with the named views and everything they need. A body that starts with a
    comma continues the list of views."""
    done: list[str] = []

    def need(name: str) -> None:
        if name not in done:
            for dep in CTES[name][0]:
                need(dep)
            done.append(name)

    for n in names:
        need(n)
    parts = ", ".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in done)
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts} {body}" if parts else body
