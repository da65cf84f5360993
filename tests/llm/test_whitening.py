"""Whitening against dense eigenvectors and exact integers."""

import math

import numpy as np
import pytest

from jetforge.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n int"


def by_hand(rows):
    """{row index: (deviation, whitened up to sign)}, n, explained of the rows with finite vectors."""
    x = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array(sums) / n
    c = np.array(fit, float) - mean
    cov = c.T @ c / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:4], q[:, ::-1][:, :4]
    return ({i: (sum((n * a - s) ** 2 for a, s in zip(v, sums)), (np.array(v) - mean) @ q / np.sqrt(e)) for i, v in x.items()}, n, e / np.trace(cov))


def check(spark, rows, extra=()):
    want, n, explained = by_hand(rows)
    docs = spark.createDataFrame([(i, v, "x", 5) for i, v in [*rows, *extra]], SCHEMA)
    got = whitening.whiten(docs).collect()
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n}
    signs = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        deviation, whitened = want[r.vec_id]
        sign = signs.setdefault(r.component, np.sign(r.whitened * whitened[r.component - 1]))
        assert r.deviation == deviation and r.whitened * sign == pytest.approx(whitened[r.component - 1], rel=1e-8, abs=1e-10)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-12) and r.identity_error < 1e-9
    return got


def test_against_dense(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(spark, rows)


def test_odd_rows_and_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(0, [5, 3, 2, 1, 0.5, 300])]) for i in range(200)]
    rows += [(1000 + i, rows[0][1]) for i in range(100)]  # copies count once
    odd = [(1, None), (2, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (3, [float("nan")] * 6), (4, [float("inf")] * 6), (5, []), (6, [1.0, 2.0])]
    check(spark, rows, [(5000 + i, v) for i, v in odd])


def test_no_variance_and_few_dimensions(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame([(1, None)])).count() == 0
    line = whitening.whiten(frame([(None, [1.0, 1.0]), (2, [2.0, 2.0]), (2, [3.0, 3.0])])).collect()
    assert [r.component for r in line] == [1, 1, 1] and sorted(abs(r.whitened) for r in line)[2] == pytest.approx(math.sqrt(1.5))
    assert all(r.explained == pytest.approx(1) for r in line)


def test_wide_values_stay_exact(spark):
    rows = [(i, [float(2**20 * i), float((-1) ** i * 2**40), 1.0]) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    x = [[int(256 * c) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    exact = {i: sum((6 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in enumerate(x)}
    assert {r.vec_id: r.deviation for r in got} == {i: d if d < 2**63 else None for i, d in exact.items()}


@pytest.mark.parametrize("matrix", [
    np.diag(np.arange(64.0)), np.eye(7), np.diag([3.0, 3, 3, 3, 3, 1, 0, 0]), np.zeros((5, 5)), np.array([[4.0]]),
    np.diag(1 + 1e-9 * np.arange(100)), np.diag(np.r_[np.zeros(90), 1e-30, 1, 2, 3]),
])
def test_pairs_reach_double_precision(matrix):
    values, vectors = whitening.leading_pairs(lambda w: matrix @ w, len(matrix), 4)
    k = min(4, len(matrix))
    top = np.linalg.eigvalsh(matrix)[::-1][:k]
    assert np.allclose(values, top, rtol=1e-13, atol=1e-13 * max(top[0], 1e-300))
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-12 * max(top[0], 1e-300)
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-13)


def test_the_covariance_is_known_by_products_alone():
    seen = []
    m = np.diag(np.arange(1.0, 301))
    whitening.leading_pairs(lambda w: seen.append(w.shape[1]) or m @ w, 300, 4)
    assert max(seen) < 60 and len(seen) < 300
