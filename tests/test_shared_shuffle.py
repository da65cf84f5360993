"""The jet table shuffles the constituents once, and joins of tables by event leave rows where they lie."""

import re

import pyarrow as pa
import pyarrow.parquet as pq

from jetforge.operators import joins
from jetforge.plans import features, q_sources
from jetforge.schema import KEYS
from jetforge.session import rows_stay


def tables(tmp_path):
    n = 60
    orders = {"o_orderkey": list(range(n)), "o_custkey": [i % 7 for i in range(n)]}
    lines = [(i, k, (37 * i + k) % 200, (11 * i + 3 * k) % 50, (i + k) % 3 / 10, 900.0 + 13 * i + k, "RAN"[(i + k) % 3]) for i in range(n) for k in range(5)]
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_extendedprice", "l_returnflag"]
    pq.write_table(pa.table(orders), f"{tmp_path}/orders.parquet")
    pq.write_table(pa.table({c: [r[i] for r in lines] for i, c in enumerate(names)}), f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def final_plan(df):
    with rows_stay(df.sparkSession):
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def test_constituents_are_shuffled_once(spark, tmp_path):
    plan = final_plan(q_sources.csv_rows(spark, tables(tmp_path)))
    # A shuffle that is read again shows as ReusedExchange.
    shuffles = re.findall(r"(?<!Reused)Exchange hashpartitioning\((.*?), \d+\)", plan)
    reused = len(re.findall(r"ReusedExchange", plan))
    assert sum("l_orderkey" in s for s in shuffles) - reused // 2 <= 1 and reused >= 6
    assert not any("event_id" in s and "jet_id" in s for s in shuffles)
    plan = final_plan(features.features(spark, str(tmp_path)))
    assert not any("jet_id" in s for s in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan))


def test_the_setting_is_put_back(spark):
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    with rows_stay(spark):
        assert spark.conf.get(name) == "false"
    assert spark.conf.get(name) == before


def test_matches_of_rows_without_keys_and_of_events_of_any_size(spark):
    rows = [(e, j, k, j % 5, k % 3, float(1 + (7 * (j or 3) + k) % 11), 0.1 * k, 0.2 * k, (j or 1) * k % 4)
            for e in (1, 2, None) for j in (1, 2, 3, 4) for k in range(4)]
    rows += [(3, None, k, 1, 1, 5.0, 0.1, 0.1, 2) for k in range(2)] + [(3, 9, 0, 1, 1, 2.0, 0.3, 0.3, 2), (3, 8, 0, 1, 1, 0.0, 0.3, 0.3, 2)]
    c = spark.createDataFrame(rows, "event_id int, jet_id int, k1 int, k2 int, k3 int, pt double, eta double, phi double, user_index int")
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    found = key(joins.truth_match(c))
    assert found == key(joins.truth_match(c, rows_per_task=2))
    by = {r[:2]: r for r in found}
    assert len(found) == len({r[:2] for r in rows}) and all(by[None, j][3] is None for j in (1, 2, 3, 4))
    assert by[3, None][3] == 9 and by[3, 8][2:] == (0, None, 1e6, 0.0)  # a jet without a key holds nothing for others
