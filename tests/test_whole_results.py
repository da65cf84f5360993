"""Rows that are easily lost: missing values, deep chains, large rule tables, flat columns, hot groups."""

import random

import pytest
from pyspark.sql import functions as F

from jetforge.functions.ordering import attach, grouped_quantiles, join_small, ranked
from jetforge.operators import background, joins, silhouette, stats, trees, votes
from jetforge.schema import OLD_CSV_COLUMNS
from jetforge.sources import jet_csv


def random_tree(rng, depth, cuts):
    """Node rows of a tree over x, y, z."""
    nodes = []

    def grow(level):
        me = len(nodes)
        nodes.append(None)
        if level == depth or rng.random() < 0.1 and level > 2:
            nodes[me] = (me, -1, -1, None, None, me % 3)
            return me
        feature, cut = rng.choice("xyz"), rng.choice(cuts)
        left, right = grow(level + 1), grow(level + 1)
        nodes[me] = (me, left, right, feature, cut, None)
        return me

    grow(0)
    return nodes


def walk(nodes, row):
    at = nodes[0]
    while at[1] >= 0:
        value = row["xyz".index(at[3])]
        if value is None:
            return None
        at = nodes[at[1]] if value <= at[4] else nodes[at[2]]
    return at[0]


@pytest.mark.parametrize("case, listed", [(10_000, 1 << 20), (1, 1 << 20), (1, 0)])
def test_box_lookup_of_many_leaves(spark, monkeypatch, case, listed):
    """As an expression, through the grid with a broadcast list, and with a joined list."""
    monkeypatch.setattr(trees, "CASE_LEAVES", case)
    monkeypatch.setattr(trees, "MAX_LISTED", listed)
    rng = random.Random(3)
    nodes = random_tree(rng, 8, [i / 8 for i in range(-8, 9)])
    rules = trees.tree_rules(spark.createDataFrame(nodes, "id int, left int, right int, feature string, threshold double, prediction int"))
    value = lambda: rng.choice([rng.uniform(-1.5, 1.5), rng.randint(-8, 8) / 8])
    rows = [(i, value(), value(), value()) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, x double, y double, z double")
    got = {r.id: r.leaf for r in trees.box_lookup(df, rules).collect()}
    # A threshold below one further up leaves an empty box; every row has exactly one other.
    assert got == {i: walk(nodes, v) for i, *v in rows}
    assert trees.box_lookup(df, rules).columns == ["id", "x", "y", "z", "leaf"]


@pytest.mark.parametrize("case", [64, 0])
def test_box_lookup_of_missing_values(spark, monkeypatch, case):
    monkeypatch.setattr(trees, "CASE_LEAVES", case)
    rules = spark.createDataFrame([(1, "x", None, 0.0), (2, "x", 0.0, None), (2, "y", None, 1.0), (3, "x", 0.0, None), (3, "y", 1.0, None)], "leaf int, feature string, lo double, hi double")
    df = spark.createDataFrame([(1, -1.0, None), (2, None, 0.0), (3, 1.0, float("nan")), (4, 0.0, 5.0), (5, 1.0, 1.0)], "id int, x double, y double")
    assert {r.id: r.leaf for r in trees.box_lookup(df, rules).collect()} == {1: 1, 2: None, 3: 3, 4: 1, 5: 2}
    assert {r.leaf for r in trees.box_lookup(df, rules.limit(0)).collect()} == {None}


DOT = r"""digraph Tree {
node [shape=box, style="filled, rounded", color="black", fontname=helvetica] ;
edge [fontname=helvetica] ;
0 [label="p_T <= 0.31\ngini = 0.49\nsamples = 8795\nvalue = [391, 8404]\nclass = Real", fillcolor="#d7ebfa"] ;
1 [label="gini = 0.02\nsamples = 385\nvalue = [381, 4]\nclass = Fake", fillcolor="#e5823b"] ;
0 -> 1 [labeldistance=2.5, labelangle=45, headlabel="True"] ;
2 [label="Area <= -1.5e-3\ngini = 0.0\nsamples = 8410\nvalue = [10.0, 8400.0]\nclass = Real"] ;
0 -> 2 ;
3 [label="gini = 0.0\nsamples = 10\nvalue = [6, 4]"] ;
2 -> 3 ;
4 [label="gini = 0.0\nsamples = 8400\nvalue = [4, 8396]\nclass = Real"] ;
2 -> 4 ;
}
"""


def test_graph_text_as_a_node_table(spark, tmp_path):
    (tmp_path / "one.dot").write_text(DOT)
    (tmp_path / "two.dot").write_text(DOT.replace("0.31", "0.5"))
    rows = trees.read_dot(spark, str(tmp_path), {"Fake": 1, "Real": 3}).where(F.col("tree").endswith("one.dot")).orderBy("id").collect()
    assert [tuple(r)[1:] for r in rows] == [
        (0, 1, 2, "p_T", 0.31, 3, 0.49, 8795, [391.0, 8404.0], "Real"), (1, -1, -1, None, None, 1, 0.02, 385, [381.0, 4.0], "Fake"),
        (2, 3, 4, "Area", -0.0015, 3, 0.0, 8410, [10.0, 8400.0], "Real"), (3, -1, -1, None, None, 0, 0.0, 10, [6.0, 4.0], None),
        (4, -1, -1, None, None, 3, 0.0, 8400, [4.0, 8396.0], "Real")]
    rules = trees.tree_rules(spark.createDataFrame(rows))
    assert sorted((r.leaf, r.prediction, r.feature, r.lo, r.hi) for r in rules.where("feature = 'Area'").collect()) == [(3, 0, "Area", None, -0.0015), (4, 3, "Area", -0.0015, None)]


def test_graph_text_round_trip(spark, tmp_path):
    schema = "id int, left int, right int, feature string, threshold double, prediction int"
    nodes = random_tree(random.Random(8), 5, [0.1, 1 / 3, -2e-7, 1e20])
    given = spark.createDataFrame(nodes, schema)
    trees.dot_lines(given).coalesce(1).write.text(str(tmp_path / "dot"))
    back = trees.read_dot(spark, str(tmp_path / "dot")).select(*given.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, given.collect()))


def test_lineage_of_a_chain_missing_parents_and_a_cycle(spark):
    chain = [(i, i - 1) for i in range(9, 6009)]
    other = [(7000, None), (7001, 7000), (8000, 8001), (8001, 8002), (8002, 8000), (9000, 4)]
    got = {r.id: (r.root, r.hops, r.status) for r in joins.lineage_root(spark.createDataFrame(chain + other, "id long, parent long")).collect()}
    assert len(got) == len(chain) + len(other)
    assert all(got[i] == (8, i - 8, "prompt" if i == 9 else "resolved") for i, _ in chain)
    assert {got[i][2] for i in (7000, 7001, 8000, 8001, 8002)} == {"error"} and got[9000] == (4, 1, "prompt")


def test_density_histogram_counts_other_labels_among_all_rows(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (9, 2.0), (None, 3.0), (3, None)], "label int, a double")
    rows = stats.density_histogram(df, ["a"], 3).groupBy("grp").agg(F.sum("n").alias("n")).collect()
    assert {r.grp: r.n for r in rows} == {0: 4, 1: 1, 2: 1}
    with pytest.raises(ValueError):
        stats.density_histogram(df, ["a"], 3, classes=(0, 1))


def test_stump_ignores_missing_values_and_empty_classes(spark):
    rows = [(1, 0.0, 1.0), (1, 1.0, None), (3, 2.0, float("nan")), (3, 3.0, 2.0)]
    counts = votes.stump_counts(spark.createDataFrame(rows, "label int, a double, b double"), ["a", "b"], 4)
    assert {(r.feature, r.n) for r in counts.groupBy("feature").agg(F.sum("n").alias("n")).collect()} == {("a", 4), ("b", 2)}
    report = {r.label: r for r in votes.cut_report(votes.best_stump(counts, 4), {1: "Fake", 2: "Squish", 3: "Real"}).collect()}
    assert report[2].below_text is None and report[2].above_text is None and report[1].below_text.endswith("keeps 100.0% of our Fake jets")


def test_old_layout_of_merged_shards(spark, tmp_path):
    folder = tmp_path / "R=0.4" / "pt_hard_min=20"
    folder.mkdir(parents=True)
    line = ",".join(str(i) for i in range(len(OLD_CSV_COLUMNS)))
    for name in "ab":
        (folder / f"{name}.csv").write_text(", ".join(OLD_CSV_COLUMNS) + f"\n{line}\n")
    rows = jet_csv.merge_shards(spark, str(folder / "*.csv"), OLD_CSV_COLUMNS).collect()
    assert [(r.R, r.pt_hard_min, r.epsilon) for r in rows] == [(0.4, 20, 4.0)] * 2


def test_flat_columns(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "a double, b double")
    assert sum(r.n for r in stats.hexbin(df, "a", "b", 4).collect()) == 5
    assert stats.profile(df, "a", "b", strict_edges=True).count() == 0
    assert [r.n for r in stats.profile(df, "a", "b").collect()] == [5]


def test_silhouette_of_one_class_and_missing_labels(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (2, 1, 4.0), (3, None, 9.0)], "id long, label int, a double")
    assert {r.silhouette for r in silhouette.silhouette_squared(df, ["a"]).collect()} == {0.0, None}
    got = {r.id: r.silhouette for r in silhouette.silhouette_rows(df.withColumn("v", F.array("a")), "id", "v").collect()}
    assert got == {1: 0.0, 2: 0.0}


def test_row_cap_keeps_the_first(spark):
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("k"))
    want = sorted(i * 37 % 101 for i in range(100))[:7]
    assert sorted(r.k for r in jet_csv.row_cap(df, "k", 7).collect()) == want
    assert sorted(r.k for r in jet_csv.row_cap(df, "k", 7, rows_per_task=3).collect()) == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def jets(spark):
    rows = spark.range(400).selectExpr("if(id < 300, 1, id) event_id", "id jet_id", "cast(id * 7 % 83 as double) p_t", "0.5D area", "cast(id % 4 as int) n_trk")
    return rows.groupBy("event_id", "jet_id").agg(*[F.max(c).alias(c) for c in ("p_t", "area", "n_trk")])


@pytest.mark.parametrize("job", [
    lambda j, n: background.with_rho_drop2(j, rows_per_task=n), lambda j, n: background.density_medians(j, rows_per_task=n),
    lambda j, n: background.jet_rank(j, rows_per_task=n), lambda j, n: grouped_quantiles(j, ["event_id"], "p_t", {"m": 0.5}, rows_per_task=n),
    lambda j, n: attach(j, j.groupBy("event_id").agg(F.sum("p_t").alias("s")), ["event_id"], rows_per_task=n),
])
def test_hot_event_path_reads_its_input_no_more_than_the_ordinary_one(spark, jets, job):
    """A forced hot group gives the same rows, and its last plan goes back to the source at most
    twice as often."""
    plain, hot = job(jets, 10_000), job(jets, 50)
    key = lambda r: tuple(str(x) for x in r)
    rounded = lambda df: sorted(key([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
    assert rounded(plain) == rounded(hot)
    # Every visit to the source is one range node.
    assert plan_of(hot).count("Range (") <= 2 * max(1, plan_of(plain).count("Range ("))


def test_join_small_broadcasts_few_groups_only(spark, monkeypatch):
    from jetforge.functions import ordering

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, side = spark.range(100).selectExpr("id % 5 g", "id"), spark.range(5).selectExpr("id g", "id * 2 v")
        assert "BroadcastHashJoin" in plan_of(join_small(rows, side, ["g"]))
        monkeypatch.setattr(ordering, "MAX_SMALL_GROUPS", 3)
        small = join_small(rows, side, ["g"])
        assert "BroadcastHashJoin" not in plan_of(small) and small.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ranked_by_ties_in_a_hot_group(spark):
    df = spark.range(500).selectExpr("1 g", "id % 3 v", "id k")
    got = {r.k: r["rank"] for r in ranked(df, ["g"], "v", "k", rows_per_task=20).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(range(500), key=lambda k: (k % 3, k)))}


def test_release_removes_scratch_tables(spark):
    import os

    from jetforge import session

    kept, session._GIVEN[:] = list(session._GIVEN), []
    try:
        table = session.stored(spark.range(5), "released")
        (path,) = session._GIVEN
        assert table.count() == 5 and os.path.isdir(path)
        session.release(spark)
        assert not os.path.exists(path) and session._GIVEN == []
    finally:
        session._GIVEN[:] = kept
