"""Column contracts of the jet feature table."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names of the jet CSV, in file order.
CSV_COLUMNS = [
    "p_T", "Eta", "Phi", "Area", "Eps", "p_T-corr", "N-Trk", "Angularity", "Angularity-NW",
    "Mean-p_T", "Var-p_T", "p_T_1", "p_T_2", "p_T_3", "p_T_4", "p_T_5", "distmatch", "XMatch",
    "X_tru", "Y_quark", "Y_gluon", "Y_beam", "Y_bkgd", "z_subjet",
]

# Columns of the older 18-column layout, in file order.
OLD_CSV_COLUMNS = [
    "p_T", "Eta", "Phi", "Area", "Rho", "p_T-corr", "N-Trk", "Angularity", "Angularity-NW",
    "Mean-p_T", "p_T_1", "p_T_2", "p_T_3", "p_T_4", "p_T_5", "distmatch", "XMatch", "X_tru",
]

# Internal snake_case names; CSV names carry '-' and clash with SQL identifiers.
SNAKE = {
    "p_T": "p_t", "Eta": "eta", "Phi": "phi", "Area": "area", "Eps": "epsilon", "Rho": "epsilon",
    "p_T-corr": "p_t_corr", "N-Trk": "n_trk", "Angularity": "angularity",
    "Angularity-NW": "angularity_nw", "Mean-p_T": "mean_p_t", "Var-p_T": "var_p_t",
    "p_T_1": "p_t_1", "p_T_2": "p_t_2", "p_T_3": "p_t_3", "p_T_4": "p_t_4", "p_T_5": "p_t_5",
    "distmatch": "dist_match", "XMatch": "x_match", "X_tru": "x_tru", "Y_quark": "y_quark",
    "Y_gluon": "y_gluon", "Y_beam": "y_beam", "Y_bkgd": "y_bkgd", "z_subjet": "z_subjet",
}

JET_COLUMNS = set(SNAKE.values())
COUNT_COLUMNS = {"n_trk"}

# Feature lists dropped before training. "lean" keeps no jet pT, "with_pt" keeps
# the raw and corrected pT, "all" drops nothing.
DROP_LISTS = {
    "lean": ["eta", "phi", "p_t", "p_t_corr", "epsilon", "angularity_nw", "n_trk", "p_t_2", "p_t_3",
             "p_t_4", "p_t_5", "dist_match", "x_match", "y_quark", "y_gluon", "y_beam", "y_bkgd"],
    "with_pt": ["eta", "phi", "epsilon", "angularity_nw", "n_trk", "p_t_2", "p_t_3", "p_t_4", "p_t_5",
                "dist_match", "x_match", "y_quark", "y_gluon", "y_beam", "y_bkgd"],
    "all": [],
}

# Columns the label is cut from: never features.
LEAKY = ["x_tru", "tru_sum", "pythia_mom", "label", "label_name"]

# Features used by the training, exploration and report jobs.
FEATURES = ["area", "epsilon", "p_t_corr", "angularity", "mean_p_t", "p_t_1"]

# The four feature-subset experiments.
ABLATIONS = {
    "all_feat": [],
    "drop_p_t_1": ["p_t_1"],
    "drop_p_t_2": ["p_t_2"],
    "drop_p_t_corr": ["p_t_corr"],
}

# Label edges (right-closed) and class codes.
TWO_CLASS_EDGES = [-1.0, 1e-9, 1e7]
DEFAULT_EDGES = [-1.0, 1e-8, 10.0, 1e7]
LABEL_NAMES = ["Fake", "Squish", "Real"]
CLASS_CODES = {"fake": 1, "squish": 2, "real": 3}

# The parameter grid of the study.
RADII = [0.2, 0.3, 0.4, 0.5, 0.6]
PT_HARD_MIN = [10, 20, 30, 40, 60, 80]

KEYS = ["event_id", "jet_id"]
CONSTIT_ORDER = ["k1", "k2", "k3"]
GHOST_PT = 1e-50


def csv_schema(columns: list[str] | None = None) -> T.StructType:
    """All-string schema: shards repeat their header line, so typing happens after it is dropped."""
    return T.StructType([T.StructField(c, T.StringType()) for c in (columns or CSV_COLUMNS)])
