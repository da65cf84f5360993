"""The jet table sorts constituents jet first, as their merge join leaves them, and its 24 columns for no join."""

import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from jetforge.plans import q_sources
from jetforge.session import rows_stay

# An order key twice with two customers, one without a customer, one without a key, one without lines.
ORDERS = [(i, i % 4) for i in range(12)] + [(3, 9), (5, None), (None, 2), (99, 1)]
LINES = [(i, k, (37 * i + k) % 200, (11 * i + 3 * k) % 50, (i + k) % 3 / 10, 900.0 + 13 * i + k, "RAN"[(i + k) % 3])
         for i in range(12) for k in range(1 + i % 7)] + [(None, 1, 5, 5, 0.1, 700.0, "R")]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    root = tmp_path_factory.mktemp("jet-table")
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_extendedprice", "l_returnflag"]
    pq.write_table(pa.table({c: [r[i] for r in ORDERS] for i, c in enumerate(["o_orderkey", "o_custkey"])}), f"{root}/orders.parquet")
    pq.write_table(pa.table({c: [r[i] for r in LINES] for i, c in enumerate(names)}), f"{root}/lineitem.parquet")
    return str(root)


def test_sorts_of_the_jet_table(spark, tables):
    df = q_sources.csv_rows(spark, tables)
    with rows_stay(spark):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    sorts = re.findall(r"Sort \[([^\]]*)\]", plan)
    assert any(s.startswith("jet_id#") and "event_id#" in s for s in sorts)
    # Neither constituents nor jets are sorted by event, then jet: only by event and pT, or by event and index.
    assert not [s for s in sorts if re.match(r"event_id#\S+ ASC NULLS FIRST, jet_id#", s)]
    assert plan.count("ShuffledHashJoin [event_id#") == 2


def test_every_jet_once_with_its_sums(spark, tables):
    want = {}
    for o, e in ORDERS:
        for line in LINES:
            # A jet without an event meets no match row, as no null key does in a join.
            if o is not None and e is not None and line[0] == o:
                want.setdefault((e, o), []).append(0.0 if line[4] == 0 else line[5] / 1000)
    rows = q_sources.csv_rows(spark, tables, "event_id", "jet_id").collect()
    got = {(r.event_id, r.jet_id): r for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys() and {(3, 3), (9, 3)} <= got.keys()
    for key, pts in want.items():
        lead = sorted((p for p in pts if p > 0), reverse=True)[:5]
        assert got[key].p_t == pytest.approx(sum(pts)) and got[key].n_trk == sum(p > 0 for p in pts)
        assert [got[key][f"p_t_{i}"] for i in range(1, 6)] == pytest.approx(lead + [None] * (5 - len(lead)))
