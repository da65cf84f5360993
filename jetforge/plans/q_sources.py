"""Scans, shards, catalogues and sinks (A, W4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.binning import pt_label
from ..functions.ordering import hot_groups
from ..operators import background as bg
from ..operators import jets as J
from ..operators import forests, joins
from ..operators import sampling
from ..schema import CSV_COLUMNS, FEATURES, KEYS, SNAKE
from ..session import rows_stay, shared_path, stored
from ..sources import committed, folder
from ..sources import jet_csv as io
from ..sources import views as V
from .check_ctes import h60, with_ctes
from .features import features, stored_rows
from .registry import query

C = V.constituents
_ALL = [SNAKE[c] for c in CSV_COLUMNS]
_DBL = [c for c in _ALL if c != "n_trk"]


def csv_rows(spark, sf, *extra):
    """The full 24-column jet table."""
    c, sizes = C(spark, sf, by_jet=True), V.event_sizes(spark, sf)
    match = joins.truth_match(c, event_sizes=sizes).select(*KEYS, "dist_match", "x_match")
    share = J.subjet_share(c)
    if not hot_groups(share, ["event_id"], sizes=sizes).count:
        share = share.repartition("event_id")  # as features and matches lie: no second shuffle of the jets
    # Hashed, the narrow sides spare a sort of all 24 columns for each join; hot events are screened.
    full = features(spark, sf).join(match.hint("shuffle_hash"), KEYS).join(share.hint("shuffle_hash"), KEYS)
    full = full.withColumn("radius", F.round(F.lit(0.2) + F.lit(0.1) * F.col("r_idx"), 1))
    return full.select(*extra, *_ALL)


def stored_csv_rows(spark, sf):
    """For sinks that read it more than once."""
    rows = csv_rows(spark, sf)
    with rows_stay(spark):
        return stored(rows, "jets-24")


def means(df, *groups):
    """Rows, and the mean of every column: a sum would only scale the rounding."""
    by = df.groupBy(*groups) if groups else df
    return by.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in _ALL])


_MEANS = "count(*) AS n, " + ", ".join(f"avg({c}) AS {c}" for c in _ALL)


@query("A1_csv_scan", with_ctes("SELECT " + ", ".join(_ALL) + " FROM full24", "full24"), _DBL, 5)
def a1(spark, sf):
    path = shared_path(spark, "jets-csv")
    rows = csv_rows(spark, sf)
    with rows_stay(spark):
        io.append_jets(rows, path)
    return io.read_jets(spark, path).select(*_ALL)


@query("A2_drop_repeated_headers", with_ctes(f"SELECT {_MEANS} FROM full24", "full24"), _ALL, 4)
def a2(spark, sf):
    """Data lines and header lines mixed in one text file, blank after the comma."""
    path = shared_path(spark, "jets-text")
    rows = csv_rows(spark, sf)
    # An empty field keeps its place.
    fields = F.array(*[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in _ALL])
    data = rows.select(F.array_join(fields, ", ").alias("value"), (F.pmod(F.xxhash64("p_t", "area"), F.lit(50)) == 0).alias("h"))
    header = F.lit(", ".join(CSV_COLUMNS))
    lines = data.select(F.explode(F.when(F.col("h"), F.array(header, "value")).otherwise(F.array("value"))).alias("value"))
    with rows_stay(spark):
        lines.write.text(path)
    return means(io.read_jets(spark, path))


@query("A3_rename_cols", "SELECT o_orderkey AS p_t, o_custkey AS epsilon, o_totalprice AS p_t_corr FROM orders", ["p_t_corr"])
def a3(spark, sf):
    o = V.table(spark, sf, "orders")
    return io.rename_columns(o.select(F.col("o_orderkey").alias("p_T"), F.col("o_custkey").alias("Eps"), F.col("o_totalprice").alias("p_T-corr")))


@query("A4_chunked_scan", with_ctes(f"""SELECT CAST({h60('event_id', 'jet_id', seed='batch')} % (SELECT CAST(ceil(count(*) / 2000.0) AS BIGINT) FROM jets) AS INT) AS batch_id,
       count(*) AS n, avg(p_t) AS p_t FROM jets GROUP BY 1""", "jets"), ["p_t"])
def a4(spark, sf):
    """Chunks of about 2,000 rows, as many as the table asks for."""
    return sampling.chunks(stored(V.basic_jets(C(spark, sf)).select(*KEYS, "p_t"), "chunked"), KEYS, 2_000).groupBy("batch_id").agg(F.count("*").alias("n"), F.avg("p_t").alias("p_t"))


@query("A5_grid_scan", with_ctes(f"""SELECT radius, pt_hard_min, {_MEANS} FROM full24
       WHERE NOT (r_idx = 4 OR pt_hard_min IN (10, 30)) GROUP BY 1, 2""", "full24"), ["radius", *_ALL])
def a5(spark, sf):
    path = shared_path(spark, "grid")
    rows = csv_rows(spark, sf, "radius", "pt_hard_min").withColumnRenamed("radius", "R")
    with rows_stay(spark):
        io.write_grid(rows, path)
    skip = [(r, p) for r in (0.2, 0.3, 0.4, 0.5, 0.6) for p in (10, 20, 30, 40) if r == 0.6 or p in (10, 30)]
    return means(io.read_grid(spark, path, skip=skip), F.col("R").alias("radius"), "pt_hard_min")


@query("A6_merge_shards", with_ctes(f"SELECT radius, pt_hard_min, {_MEANS} FROM full24 GROUP BY 1, 2", "full24"), ["radius", *_ALL], 4)
def a6(spark, sf):
    path = shared_path(spark, "shards")
    rows = csv_rows(spark, sf, "radius", "pt_hard_min").withColumnRenamed("radius", "R")
    with rows_stay(spark):
        io.append_jets(rows, path, ["R", "pt_hard_min"])
    return means(io.merge_shards(spark, f"{path}/*/*/*.csv"), F.col("R").alias("radius"), "pt_hard_min")


@query("A7_split_shards", with_ctes(f"SELECT 0::BIGINT AS oversize, 0::BIGINT AS headerless, {_MEANS} FROM full24", "full24"), _ALL, 4)
def a7(spark, sf):
    path = shared_path(spark, "split")
    rows = csv_rows(spark, sf)
    with rows_stay(spark):
        io.split_shards(rows, path, 1_000)
    raw = io.read_raw(spark, path).withColumn("f", F.input_file_name())
    header = F.col("p_T") == "p_T"
    per_file = raw.groupBy("f").agg(F.count_if(~header).alias("n"), F.count_if(header).alias("h"))
    layout = per_file.agg(F.count_if(F.col("n") > 1_000).alias("oversize"), F.count_if(F.col("h") != 1).alias("headerless")).first()
    rows = means(io.read_jets(spark, path))
    return rows.select("*", *[F.lit(layout[c]).cast("bigint").alias(c) for c in ("oversize", "headerless")])


@query("A8_csv_append_sink", with_ctes(f"SELECT 2 * n AS n, {', '.join(_ALL)} FROM (SELECT {_MEANS} FROM full24)", "full24"), _ALL, 4)
def a8(spark, sf):
    path = shared_path(spark, "append")
    rows = stored_csv_rows(spark, sf)
    for _ in range(2):
        io.append_jets(rows, path)
    return means(io.read_jets(spark, path))


@query("A8_committed_append", with_ctes(f"SELECT 2 * n AS n, {', '.join(_ALL)} FROM (SELECT {_MEANS} FROM full24)", "full24"), _ALL, 4)
def a8c(spark, sf):
    """Two named appends, one of them after an attempt that wrote files and failed, and both once
    more: every row is there once for each name."""
    path = shared_path(spark, "committed")
    rows = stored_csv_rows(spark, sf)
    rows.limit(100).write.csv(f"{path}/run=second")  # no marker: the attempt failed
    for run in ("first", "second", "first", "second"):
        committed.append_once(rows, path, run, fmt="csv")
    return means(committed.read_committed(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields), fmt="csv"))


_SRC = """SELECT source, count(*) AS n, sum(p_t) AS p_t, sum(p_t_corr) AS p_t_corr FROM (
    SELECT 'signal' AS source, p_t, p_t AS p_t_corr FROM s UNION ALL SELECT 'bkgd_kt', p_t, 0 FROM b
    UNION ALL SELECT 'bkgd_antikt', b.p_t, b.p_t - r.rho * b.area FROM b JOIN rb r ON b.event_id = r.event_id
    UNION ALL SELECT 'total', t.p_t, t.p_t - r.rho * t.area FROM jets t JOIN rho2 r ON t.event_id = r.event_id
    UNION ALL SELECT 'total_matched', t.p_t, t.p_t - r.rho * t.area FROM jets t JOIN rho2 r ON t.event_id = r.event_id
    JOIN first_sig f ON f.event_id = t.event_id AND f.jet_id = t.jet_id WHERE f.first_signal > 0) GROUP BY 1"""


@query("A9_jet_table_sinks", with_ctes(""", s AS (SELECT event_id, jet_id, sum(pt) AS p_t FROM constits WHERE user_index <> 0 GROUP BY 1, 2),
    b AS (SELECT event_id, jet_id, sum(pt) AS p_t, CAST(10 + jet_id % 50 AS DOUBLE) / 100 AS area FROM constits WHERE user_index = 0 GROUP BY 1, 2),
    rb AS (SELECT event_id, quantile_cont(p_t / area, 0.5) AS rho FROM b GROUP BY 1) """ + _SRC, "jets", "rho2", "first_sig"), ["p_t", "p_t_corr"], 3)
def a9(spark, sf):
    c, sizes = C(spark, sf), V.event_sizes(spark, sf)
    pick = lambda df, name, corr: df.select(F.lit(name).alias("source"), *KEYS, "p_t", "n_trk", "area", corr.alias("p_t_corr"))
    sig = V.basic_jets(c.where(F.col("user_index") != 0))
    bkgd = V.basic_jets(c.where(F.col("user_index") == 0))
    total = V.basic_jets(c)
    rb = bg.pt_corr(bg.attach_rho(bkgd, bg.rho_median(bkgd, sizes=sizes), sizes=sizes))
    rt = bg.pt_corr(bg.with_rho_drop2(total, sizes=sizes))
    matched = rt.join(J.first_signal(c).where(F.col("first_signal") > 0), KEYS, "left_semi")
    tables = [pick(sig, "signal", F.col("p_t")), pick(bkgd, "bkgd_kt", F.lit(0.0)), pick(rb, "bkgd_antikt", F.col("p_t_corr")),
              pick(rt, "total", F.col("p_t_corr")), pick(matched, "total_matched", F.col("p_t_corr"))]
    path = shared_path(spark, "tables")
    io.write_tables(joins.concat_classes(tables), path)
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"), F.sum("p_t").alias("p_t"), F.sum("p_t_corr").alias("p_t_corr"))


def catalog(spark, sf):
    s = V.table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("file"), (F.col("s_nationkey") % 8).alias("centrality"), (F.col("s_nationkey") % 5).alias("harmonics"),
                    F.floor(F.abs("s_acctbal")).alias("events"))


@query("A10_catalog_scan", """SELECT s_suppkey AS file, CAST(floor(abs(s_acctbal)) AS BIGINT) AS events, count(*) AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey
       WHERE s_nationkey % 8 = 3 AND s_nationkey % 5 IN (1, 3) GROUP BY 1, 2""")
def a10(spark, sf):
    wanted = [io.catalog_scan(catalog(spark, sf), centrality=3, harmonics=h) for h in (1, 3)]
    files = joins.concat_classes(wanted)
    rows = io.scan_files(V.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file")), files)
    # Pre-aggregated per file, so the attach join carries one row per file.
    return rows.groupBy("file").agg(F.count("*").alias("n")).join(files.select("file", "events"), "file")


@query("A10_catalog_total", "SELECT count(*) AS n_files, CAST(sum(floor(abs(s_acctbal))) AS BIGINT) AS total_events FROM supplier WHERE s_nationkey % 8 = 3 AND CAST(s_suppkey AS VARCHAR) LIKE '%3'")
def a10t(spark, sf):
    return io.catalog_scan(catalog(spark, sf), suffix="3", centrality=3).agg(F.count("*").alias("n_files"), F.sum("events").alias("total_events"))


@query("A10_folder_scan", """SELECT s_suppkey AS file, CAST(floor(abs(s_acctbal)) AS BIGINT) AS events, count(*) AS n, sum(l_quantity) AS quantity
       FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE s_nationkey % 8 = 3 AND s_nationkey % 5 IN (1, 3) GROUP BY 1, 2""", ["quantity"])
def a10f(spark, sf):
    """A file per supplier with its settings in the first line, among files of another kind; the
    wanted ones are found by their settings and read."""
    path = shared_path(spark, "folder")
    head = catalog(spark, sf).select("file", F.lit(0).alias("place"), F.format_string(
        "# centrality=%d harmonics=%d events=%d version=1", F.col("centrality"), F.col("harmonics"), F.col("events")).alias("value"))
    body = V.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file"), F.lit(1).alias("place"),
                                                 F.concat_ws(",", F.col("l_orderkey").cast("string"), F.col("l_quantity").cast("string")).alias("value"))
    lines = head.unionByName(body).repartition("file").sortWithinPartitions("file", "place")
    lines.select("file", "value").write.partitionBy("file").text(path)
    catalog(spark, sf).write.mode("append").json(f"{path}/other")
    found = folder.file_headers(spark, path, ["centrality", "harmonics", "events", "version"], ".txt")
    wanted = stored(io.catalog_scan(found, name="path", centrality=3, version=1).where(F.col("harmonics").isin(1, 3)), "wanted-files")
    rows = folder.read_files(spark, wanted, "orderkey bigint, quantity double")
    number = lambda c: F.regexp_extract(c, r"file=(\d+)", 1).cast("bigint").alias("file")
    per_file = rows.groupBy(number("path")).agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))
    return per_file.join(wanted.select(number("path"), "events"), "file")


@query("A11_shuffled_read", f"""SELECT o_orderkey AS event, o_custkey AS file, row_number() OVER (ORDER BY {h60('o_custkey', seed='42:file')}, o_custkey,
       {h60('o_orderkey', seed='42:event')}, o_orderkey) AS position FROM orders""")
def a11(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("event"), F.col("o_custkey").alias("file"))
    return io.shuffled_read(o, "file", "event")


@query("A13_result_sinks", with_ctes("SELECT 'count' AS metric, label, 2 * count(*) AS value FROM feat GROUP BY 2", "feat"), ["value"])
def a13(spark, sf):
    from ..operators.reports import append_results

    path = shared_path(spark, "results")
    jets = V.basic_jets(C(spark, sf)).withColumn("label", pt_label(F.col("tru_sum"), F.col("pt_hard_min")))
    rows = jets.groupBy("label").agg(F.count("*").cast("double").alias("value")).select(F.lit("count").alias("metric"), "label", "value")
    for _ in range(2):
        append_results(rows, path)
    return spark.read.parquet(path).groupBy("metric", "label").agg(F.sum("value").alias("value"))


@query("A13_model_store", with_ctes("SELECT r_idx, pt_hard_min, count(*) AS n, count(*) AS same, 3 AS max_depth FROM train GROUP BY 1, 2", "train"))
def a13m(spark, sf):
    """A tree per R, stored with its parameters and scores, loaded again: rows whose prediction is
    the one of the tree in memory."""
    path = shared_path(spark, "model-store")
    rows = stored_rows(spark, sf)
    parts = []
    # One model per R: five.
    for (r,) in sorted(rows.select("r_idx").distinct().collect()):
        part = rows.where(F.col("r_idx") == r)
        tree = forests.fit_tree(part, FEATURES, 3)
        seen = forests.predict(tree, part, FEATURES)
        hits = seen.agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]
        committed.save_model(spark, path, f"R{r}", tree, {"max_depth": 3, "r_idx": r}, {"accuracy": hits})
        parts.append(seen)
    again = [forests.predict(committed.load_model(spark, path, f"R{r}"), joins.concat_classes(parts).where(F.col("r_idx") == r), FEATURES, "loaded")
             for r in sorted(int(m.point[1:]) for m in committed.stored_models(spark, path).collect())]
    depth = F.get_json_object("params", "$.max_depth").cast("int").alias("max_depth")
    models = committed.stored_models(spark, path).select(F.get_json_object("params", "$.r_idx").cast("int").alias("r_idx"), depth)
    met = joins.concat_classes(again).join(F.broadcast(models), "r_idx")
    return met.groupBy("r_idx", "pt_hard_min").agg(F.count("*").alias("n"), F.count_if(F.col("loaded") == F.col("pred")).alias("same"), F.max("max_depth").alias("max_depth"))


@query("W4_row_cap", with_ctes("SELECT event_id, jet_id, p_t FROM (SELECT *, row_number() OVER (ORDER BY jet_id) AS rn FROM jets) WHERE rn <= 1000", "jets"), ["p_t"])
def w4(spark, sf):
    return io.row_cap(V.basic_jets(C(spark, sf)).select(*KEYS, "p_t"), "jet_id", 1_000)


