"""Report tables (G, F7) and streaming forms (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from ..schema import FEATURES, KEYS
from ..session import shared_path, stored
from ..sources import views as V
from ..streaming import jobs
from .check_ctes import fixed_bin, h60, with_ctes
from .features import stored_rows, training_rows
from .q_stats import GRID, IMP_SQL, METRIC_SQL, NAMES, _cut_tail, _stump_sql, grid_importance, metrics_long, scored
from .registry import query

POINTS = [10, 20, 30, 40]


@query("G2_metric_series", with_ctes(METRIC_SQL.replace("batch_id, ", "").replace("GROUP BY 1, 2, 3", "GROUP BY 1, 2")
       + " SELECT r_idx, metric, " + ", ".join(f"max(CASE WHEN pt_hard_min = {p} THEN value END) AS pt_{p}" for p in POINTS)
       + " FROM metrics GROUP BY 1, 2", "scored"), [f"pt_{p}" for p in POINTS])
def g2(spark, sf):
    return R.metric_series(metrics_long(spark, sf, GRID), POINTS)


@query("G3_importance_series", with_ctes(IMP_SQL + " SELECT r_idx, feature, " + ", ".join(
    f"max(CASE WHEN pt_hard_min = {p} THEN importance END) AS pt_{p}" for p in POINTS) + " FROM imp GROUP BY 1, 2", "train"), [f"pt_{p}" for p in POINTS])
def g3(spark, sf):
    return R.metric_series(grid_importance(spark, sf), POINTS, by=("r_idx", "feature"), value="importance")


_PARAMS_SQL = """, g AS (SELECT r_idx, pt_hard_min, count(*) AS n, count(CASE WHEN label = 1 THEN 1 END) AS n1, count(CASE WHEN label = 3 THEN 1 END) AS n3 FROM train GROUP BY 1, 2),
    params AS (SELECT r_idx, pt_hard_min, 'n_estimators' AS name, CASE WHEN n > 700 THEN '200' ELSE '100' END AS value FROM g
    UNION ALL SELECT r_idx, pt_hard_min, 'criterion', CASE WHEN n1 > n3 THEN 'entropy' ELSE 'gini' END FROM g
    UNION ALL SELECT r_idx, pt_hard_min, 'max_features', '1' FROM g
    UNION ALL SELECT r_idx, pt_hard_min, 'class_weight', CASE WHEN n3 > 400 THEN '{1:1,2:1,3:10}' ELSE '{1:1,2:1,3:100}' END FROM g)"""


def grid_params(spark, sf):
    """A long parameter table per grid point, chosen from the class counts of the point."""
    g = training_rows(spark, sf).groupBy(*GRID).agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 3).alias("n3"))
    rows = [("n_estimators", F.when(F.col("n") > 700, "200").otherwise("100")),
            ("criterion", F.when(F.col("n1") > F.col("n3"), "entropy").otherwise("gini")),
            ("max_features", F.lit("1")),
            ("class_weight", F.when(F.col("n3") > 400, "{1:1,2:1,3:10}").otherwise("{1:1,2:1,3:100}"))]
    cells = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in rows])
    return g.select(*GRID, F.explode(cells).alias("p")).select(*GRID, "p.name", "p.value")


@query("F7_best_params_store", with_ctes(_PARAMS_SQL + """ SELECT false AS low_pt, r_idx, pt_hard_min, name, CASE name WHEN 'max_features' THEN 'auto' ELSE value END AS value FROM sv WHERE name <> 'class_weight'
    UNION ALL SELECT true, r_idx, pt_hard_min, name, CASE name WHEN 'max_features' THEN 'auto' WHEN 'class_weight' THEN '{1:1,2:1,3:4}' ELSE value END FROM sv""".replace(
    " SELECT false", """, sv AS (SELECT * FROM params UNION ALL SELECT r_idx, pt_hard_min, e.name, e.value FROM g,
    (VALUES ('oob_score', 'True'), ('random_state', '42'), ('n_jobs', '-1')) e(name, value)) SELECT false""", 1), "train"))
def f7(spark, sf):
    path = shared_path(spark, "params")
    R.saved_params(grid_params(spark, sf)).write.parquet(path)
    stored = spark.read.parquet(path)
    return R.loaded_params(stored).withColumn("low_pt", F.lit(False)).unionByName(
        R.loaded_params(stored, low_pt=True).withColumn("low_pt", F.lit(True)))


@query("G4_params_report", with_ctes(_PARAMS_SQL + """ SELECT r_idx, pt_hard_min, CAST(row_number() OVER (PARTITION BY r_idx, pt_hard_min ORDER BY name DESC) AS INT) AS line,
    CASE name WHEN 'n_estimators' THEN 'Number of Estimators' WHEN 'criterion' THEN 'Criterion' WHEN 'max_features' THEN 'Max Features' ELSE 'Class Weight' END AS parameter,
    value FROM params""", "train"))
def g4(spark, sf):
    return R.params_report(grid_params(spark, sf))


@query("G5_share_report", with_ctes(IMP_SQL + """ SELECT r_idx, pt_hard_min, feature, importance, 100 * importance / sum(importance) OVER (PARTITION BY r_idx, pt_hard_min) AS pct
    FROM imp""", "train"), ["importance", "pct"])
def g5(spark, sf):
    return R.share_report(grid_importance(spark, sf), GRID, "importance")


@query("G5_retention_report", _stump_sql(16, GRID, _cut_tail(GRID)), ["threshold", "gain", "pct_below", "pct_above"])
def g5r(spark, sf):
    from ..operators import votes

    rows = stored_rows(spark, sf)
    best = votes.best_stump(votes.stump_counts(rows, FEATURES, 16, groups=GRID), 16, groups=GRID)
    return votes.cut_report(best, NAMES, GRID)


@query("G6_run_log", with_ctes(f""", g AS (SELECT r_idx, pt_hard_min, count(CASE WHEN label = 1 THEN 1 END) AS a, count(CASE WHEN label = 2 THEN 1 END) AS b,
    count(CASE WHEN label = 3 THEN 1 END) AS c FROM train GROUP BY 1, 2)
    SELECT r_idx, pt_hard_min, 'Number of Fake Jets' AS metric, a AS value FROM g UNION ALL SELECT r_idx, pt_hard_min, 'Number of Squishy Jets', b FROM g
    UNION ALL SELECT r_idx, pt_hard_min, 'Number of Real Jets', c FROM g
    UNION ALL SELECT r_idx, pt_hard_min, 'Number of Features', {len(FEATURES)} FROM g
    UNION ALL SELECT r_idx, pt_hard_min, 'Number of Batches', count(DISTINCT batch_id) FROM scored GROUP BY 1, 2
    UNION ALL SELECT r_idx, pt_hard_min, 'Accuracy', CAST(printf('%.4f', avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0 END)) AS DOUBLE) FROM scored GROUP BY 1, 2""",
    "train", "scored"), ["value"])
def g6(spark, sf):
    """Class counts, features, batches and the accuracy of the rule-based prediction, through the text log."""
    seen = scored(spark, sf).groupBy(*GRID).agg(*[F.count_if(F.col("label") == k).alias(f"n{k}") for k in (1, 2, 3)],
                                                F.countDistinct("batch_id").cast("double").alias("batches"),
                                                F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"))
    return R.parse_log(R.log_lines(seen, features=FEATURES, scores={"batches": "Number of Batches", "accuracy": "Accuracy"}))


@query("S1_micro_batch_stats", f"""SELECT CAST({h60('event_id', seed='batch')} % 4 AS INT) AS chunk, count(*) AS n, sum(value) AS total, min(event_id) AS first_id, max(event_id) AS last_id
    FROM events GROUP BY 1""", ["total"], 3)
def s1(spark, sf):
    """Events written as chunk files and read back one file per micro batch, one stats row each."""
    from ..operators.sampling import batches

    path = shared_path(spark, "chunks")
    ev = V.table(spark, sf, "events").select("event_id", "value")
    chunked = batches(ev, ["event_id"], 4).withColumnRenamed("batch_id", "chunk")
    chunked.write.parquet(path)
    stream = jobs.file_stream(spark, path, chunked.schema)
    stats = lambda batch, epoch: batch.groupBy("chunk").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
    per_batch = jobs.micro_batches(stream, stats, "chunk-stats")
    return per_batch.groupBy("chunk").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))


CHUNK_ROWS = 5_000
FILES_AT_ONCE = 64


@query("S1_model_per_chunk", with_ctes(f"""SELECT CAST({h60('event_id', 'jet_id', seed='batch')} % (SELECT CAST(ceil(count(*) / {CHUNK_ROWS}.0) AS BIGINT) FROM train) AS INT) AS chunk,
       count(*) AS n, true AS known, true AS beats_majority FROM train GROUP BY 1""", "train"))
def s1m(spark, sf):
    """One tree per chunk, fitted and scored when all rows of the chunk have arrived; a chunk comes
    in as many files as its rows need, and there are as many chunks as the rows ask for."""
    from ..operators import forests as M
    from ..operators.sampling import chunks

    path = shared_path(spark, "model-chunks")
    rows = stored(chunks(stored_rows(spark, sf), KEYS, CHUNK_ROWS).withColumnRenamed("batch_id", "chunk"), "chunk-rows")
    jobs.write_chunks(rows, path, CHUNK_ROWS // 2)
    manifest = rows.groupBy("chunk").agg(F.count("*").alias("rows"))
    stream = jobs.file_stream(spark, path, rows.schema, files_per_trigger=FILES_AT_ONCE)

    def fit(chunk):
        chunk = chunk.coalesce(1)  # about CHUNK_ROWS rows: one task to a step, and no shuffle for the counts
        scored = M.predict(M.fit_tree(chunk, FEATURES, 5), chunk, FEATURES)
        per = scored.groupBy("chunk", "label").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("label")).alias("hit"),
                                                   F.min(F.col("pred").isin(1, 2, 3)).alias("known"))
        return per.groupBy("chunk").agg(F.sum("n").alias("n"), F.min("known").alias("known"), (F.sum("hit") >= F.max("n")).alias("beats_majority"))

    return jobs.per_complete_chunk(stream, manifest, fit, "chunk int, n long, known boolean, beats_majority boolean", "chunk-models")


@query("S2_stream_hist", f"SELECT event_type, {fixed_bin('value', 0, 100, 50)} AS bin, count(*) AS n FROM events GROUP BY 1, 2")
def s2(spark, sf):
    schema = V.table(spark, sf, "events").schema
    stream = jobs.file_stream(spark, f"{sf}/events.parquet*", schema)
    return jobs.run_complete(jobs.stream_histogram(stream, F.col("value"), 0, 100, 50, ["event_type"]), "stream-hist")


