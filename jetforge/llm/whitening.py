"""Whitening of embeddings onto their leading principal components, by a Jacobi-Davidson solver.

The covariance is never formed: Spark gives its centred product with a few vectors in one pass over
the distinct vectors. The driver holds the search subspace only (dimensions x a few dozen numbers).
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids_of, quoted, renamed, stored

SCALE = 256
COMPONENTS = 4
GUARD = 8  # approximations beyond the components asked for that are corrected along with them
BLOCK = 4096  # vectors in a row of the fit list
INNER_STEPS = 6  # MINRES steps for one correction at most
MAX_BASIS = 40
MAX_ROUNDS = 200
EXACT = 64 * np.finfo(float).eps  # residual, as a share of the largest eigenvalue, at which a pair is locked
NEAR = 1e-11  # a residual below this that falls no further is at the noise of the sums
STALLED = 4  # rounds without progress that show it
WIDTHS = (1, 2, 4, 8)
LONG_MAX = 2**63 - 1


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def scaled(rows: DataFrame, vector_col: str, scale: int = SCALE) -> Column:
    """floor(scale * c) as longs; null where the vector is null or holds a null or non-finite entry."""
    vector = quoted(vector_col).cast("array<double>")
    return F.when(F.forall(vector, _finite), F.transform(vector, lambda c: F.floor(c * F.lit(float(scale)))))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def _packed(dim: int):
    """Task side: each vector in the least width that holds it, so that equal vectors are equal bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            out = np.empty(len(x), object)
            low, high = x.min(1, initial=0), x.max(1, initial=0)
            left = np.ones(len(x), bool)
            for w in WIDTHS:
                span = np.iinfo(f"i{w}")
                rows = np.flatnonzero(left & (low >= span.min) & (high <= span.max))
                left[rows] = False
                data = x[rows].astype(f"<i{w}").tobytes()
                for k, row in enumerate(rows):
                    out[row] = data[k * dim * w:(k + 1) * dim * w]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["x"])
    return run


def _blocked(dim: int):
    """Task side: packed vectors of one width side by side, BLOCK to a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}

        def block(width: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([b"".join(held.pop(width))], pa.binary())], names=["width", "data"])

        for batch in batches:
            for x in batch.column(0).to_pylist():
                width = len(x) // dim
                held.setdefault(width, []).append(x)
                if len(held[width]) == BLOCK:
                    yield block(width)
        for width in list(held):
            yield block(width)
    return run


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for width, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield np.frombuffer(data.as_buffer(), f"<i{width}").reshape(-1, dim)


@dataclass
class FitList:
    """The distinct vectors in blocks, how many there are, and their exact sums."""
    blocks: DataFrame
    dim: int
    n: int
    sums: list[int]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def reduce(self, step: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """Sum over the blocks of ``step(block)``: a small table, added up inside each task and then
        by Spark, row by row."""
        dim, names = self.dim, [f"v{j}" for j in range(shape[1])]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for x in _blocks(batches, dim):
                total += step(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0])), *[pa.array(total[:, j]) for j in range(shape[1])]], names=["i", *names])

        parts = self.blocks.mapInArrow(run, "i long, " + ", ".join(f"{n} double" for n in names))
        out = np.zeros(shape)
        for row in parts.groupBy("i").agg(*[F.sum(n).alias(n) for n in names]).collect():
            out[row["i"]] = [row[n] for n in names]
        return out

    def product(self, vectors: np.ndarray) -> np.ndarray:
        """Covariance times some vectors, centred before multiplying."""
        mean = self.mean

        def step(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return c.T @ (c @ vectors)

        return self.reduce(step, vectors.shape) / self.n

    def trace(self) -> float:
        mean = self.mean
        return float(self.reduce(lambda x: np.sum((x - mean) ** 2, keepdims=True), (1, 1))[0, 0]) / self.n


def fit_list(x: DataFrame, dim: int) -> FitList:
    """Of a table with one column ``x`` (arrays of ``dim`` longs)."""
    distinct = x.mapInArrow(_packed(dim), "x binary").distinct()
    blocks = stored(distinct.mapInArrow(_blocked(dim), "width int, data binary"), "fit-list")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dim, object)
        for b in _blocks(batches, dim):
            n += len(b)
            # Up to 32 bits a block's sums are within 64 bits; wider values are added as integers.
            sums = sums + (b.sum(0, dtype=np.int64).astype(object) if b.dtype.itemsize <= 4 else b.astype(object).sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int64()), pa.array([str(v) for v in (n, *sums)])], names=["i", "v"])

    rows = blocks.mapInArrow(totals, "i long, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    got = {r["i"]: int(r["v"]) for r in rows}
    return FitList(blocks, dim, got.get(-1, 0), [got.get(i, 0) for i in range(dim)])


def _minres(b: np.ndarray, shift: float, project: Callable[[np.ndarray], np.ndarray], steps: int, rtol: float) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """MINRES for project (A - shift) project x = b. Yields each vector whose product with A it
    needs, so that several systems can share a pass over the data."""
    beta = first = float(np.linalg.norm(b))
    x = np.zeros_like(b)
    if first == 0:
        return x
    r1 = r2 = y = b
    oldb = dbar = eps = 0.0
    phibar, cs, sn = first, -1.0, 0.0
    w = w2 = np.zeros_like(b)
    for k in range(steps):
        v = y / beta
        y = project((yield v) - shift * v)
        if k:
            y = y - (beta / oldb) * r1
        alfa = float(v @ y)
        y = project(y - (alfa / beta) * r2)
        r1, r2, oldb, beta = r2, y, beta, float(np.linalg.norm(y))
        oldeps, delta, gbar = eps, cs * dbar + sn * alfa, sn * dbar - cs * alfa
        eps, dbar = sn * beta, -cs * beta
        gamma = max(float(np.hypot(gbar, beta)), np.finfo(float).tiny)
        cs, sn = gbar / gamma, beta / gamma
        phi, phibar = cs * phibar, sn * phibar
        w, w2, w1 = None, w, w2
        w = (v - oldeps * w1 - delta * w2) / gamma
        x = x + phi * w
        if phibar <= rtol * first or beta <= np.finfo(float).eps * first:
            break
    return x


def _together(systems: list[Generator], product: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """Run the systems in step: one product for all that still need one."""
    out: list[np.ndarray | None] = [None] * len(systems)
    asked = {}

    def advance(i: int, value: np.ndarray | None) -> None:
        try:
            asked[i] = systems[i].send(value)
        except StopIteration as end:
            out[i] = end.value
            asked.pop(i, None)

    for i in range(len(systems)):
        advance(i, None)
    while asked:
        order = list(asked)
        got = product(np.stack([asked[i] for i in order], 1))
        for j, i in enumerate(order):
            advance(i, got[:, j])
    return out


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Columns of ``new`` that the bases do not hold, orthonormal to them and each other."""
    kept: list[np.ndarray] = []
    for v in new.T:
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v = v / size
        for _ in range(3):
            for basis in (*bases, *([np.stack(kept, 1)] if kept else [])):
                v = v - basis @ (basis.T @ v)
        size = np.linalg.norm(v)
        if size > 1e-10:
            v = v / size
            for basis in (*bases, *([np.stack(kept, 1)] if kept else [])):
                v = v - basis @ (basis.T @ v)
            kept.append(v / np.linalg.norm(v))
    return np.stack(kept, 1) if kept else np.empty((len(new), 0))


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], dim: int, count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues (falling) and unit eigenvectors (columns) of a symmetric
    non-negative matrix known by its products alone, by Jacobi-Davidson.

    Rayleigh-Ritz over the subspace gives approximate pairs; for each wanted one that is not exact
    yet, MINRES solves the correction equation in the space orthogonal to what is locked and to the
    present approximations, and the corrections widen the subspace. Leading pairs are locked in
    order once their residual is at double precision (EXACT), or at the noise of the sums: below
    NEAR and no longer falling. A subspace that has become the whole space is exact as it is.
    """
    count = min(count, dim)
    locked, values = np.empty((dim, 0)), []
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((dim, min(dim, count + GUARD))))
    image = product(basis)
    best, still = np.full(count, np.inf), 0
    for outer in range(MAX_ROUNDS):
        h = basis.T @ image
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        basis, image = basis @ s, image @ s
        scale = max(float(theta[0]), values[0] if values else 0.0, np.finfo(float).tiny)
        want = min(count - len(values), basis.shape[1])
        aim = min(want + GUARD, basis.shape[1])
        rest = image[:, :aim] - basis[:, :aim] * theta[:aim]
        rest -= locked @ (locked.T @ rest)
        size = np.linalg.norm(rest, axis=0) / scale
        now = np.zeros(count)
        now[len(values):len(values) + want] = size[:want]
        still = 0 if (now < 0.5 * best).any() else still + 1
        best = np.minimum(best, now)
        whole = basis.shape[1] + locked.shape[1] >= dim
        done = 0
        while done < want and (size[done] <= EXACT or whole or still >= STALLED and size[done] <= NEAR):
            done += 1
        if done:
            values += [float(t) for t in theta[:done]]
            locked = np.concatenate([locked, basis[:, :done]], 1)
            basis, image, rest, theta = basis[:, done:], image[:, done:], rest[:, done:], theta[done:]
            want, aim = want - done, aim - done
            still = 0
        if len(values) == count:
            order = np.argsort(values)[::-1]
            return np.array(values)[order], locked[:, order]
        if basis.shape[1] > MAX_BASIS:
            keep = max(count + GUARD, MAX_BASIS // 3)
            basis, image = basis[:, :keep], image[:, :keep]
        if want and basis.shape[1]:
            shown = np.concatenate([locked, basis[:, :aim]], 1)
            project = lambda v: v - shown @ (shown.T @ v)
            rtol = max(2.0 ** -(outer + 2), 1e-3)
            systems = [_minres(-project(rest[:, i]), float(theta[i]), project, INNER_STEPS, rtol) for i in range(aim)]
            new = _orthonormal(np.stack(_together(systems, product), 1), locked, basis)
        else:
            new = np.empty((dim, 0))
        if not new.shape[1]:  # nothing to correct or a closed subspace: look outside it
            new = _orthonormal(np.random.default_rng(seed + outer + 1).standard_normal((dim, 1)), locked, basis)
        basis, image = np.concatenate([basis, new], 1), np.concatenate([image, product(new)], 1)
    raise RuntimeError(f"eigenpairs did not settle in {MAX_ROUNDS} rounds: residuals {best}")


@dataclass
class Whitening:
    """What the rows need: sizes, exact sums, components (columns) and their eigenvalues."""
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit(x: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening:
    """Components of the distinct vectors with an eigenvalue above zero (at double precision)."""
    found = fit_list(x, dim)
    nothing = Whitening(found.n, found.sums, np.empty(0), np.empty((dim, 0)), np.empty(0), 0.0)
    if not found.n or not dim:
        return nothing
    trace = found.trace()
    if not trace > 0:
        return nothing
    values, vectors = leading_pairs(found.product, dim, components)
    real = values > dim * np.finfo(float).eps * trace
    values, vectors = values[real], vectors[:, real]
    mean, k, onto = found.mean, len(values), vectors / np.sqrt(values)
    centre = found.reduce(lambda b: ((b - mean) @ onto).sum(0, keepdims=True), (1, k)) / found.n

    def square(b: np.ndarray) -> np.ndarray:
        z = (b - mean) @ onto - centre
        return z.T @ z

    error = float(np.abs(found.reduce(square, (k, k)) / found.n - np.eye(k)).max())
    return Whitening(found.n, found.sums, values, vectors, values / trace, error)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """n*x - S as doubles, and the exact sum of their squares for each row; null beyond a long."""
    most = n * float(np.abs(x.astype(float)).max(initial=0)) + max(map(abs, sums), default=0)
    if most * most * max(len(sums), 1) < 2.0**62:
        away = n * x - np.array(sums, np.int64)
        return away.astype(float), (away * away).sum(1).tolist()
    away = x.astype(object) * n - np.array(sums, object)
    squares = (away * away).sum(1)
    return away.astype(float), [s if s <= LONG_MAX else None for s in squares]


def whiten(embeddings: DataFrame, id_cols: tuple[str, ...] = ("vec_id",), vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """For each vector and component: id columns, component (from 1, by falling eigenvalue), n (size
    of the fit list), deviation, whitened, explained and identity_error.

    A vector c becomes x = floor(scale * c). The components are eigenvectors of the covariance of
    the distinct x (divisor n). ``deviation`` is the exact sum of (n*x - S)^2, null beyond a long;
    ``whitened`` is (x - S/n) on the component over the root of its eigenvalue; ``explained`` is the
    eigenvalue's share of the trace; ``identity_error`` is the largest difference between the
    covariance of the whitened fit list and the identity.

    Rows whose vector is null or holds null or non-finite entries are left out, and so are vectors
    of another length than most have (of equally frequent lengths the greater counts). Components
    without variance do not come out: fewer than asked for if the distinct vectors span fewer
    dimensions, none for a single one. Equal eigenvalues have any orthonormal vectors of their
    space. Repeated rows count once in the fit and are rows of their own in the result; null ids
    stay. An empty table gives no rows. Other columns are ignored.
    """
    rows = embeddings.select(*ids_of(embeddings, id_cols), scaled(embeddings, vector_col, scale).alias("_x")).where(F.col("_x").isNotNull())
    ids = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema = f"{ids}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usual = rows.groupBy(F.size("_x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim = usual["dim"] if usual else 0
    rows = rows.where(F.size("_x") == dim)
    w = fit(rows.select(F.col("_x").alias("x")), dim, components)
    k, root = len(w.values), np.sqrt(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not k or not batch.num_rows:
                continue
            x = _matrix(batch.column(batch.num_columns - 1), dim)
            away, squares = _deviations(x, w.n, w.sums)
            values = (away @ w.vectors) / w.n / root
            each = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [c.take(each) for c in batch.columns[:-1]]
            own = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, w.n)), pa.array(squares, pa.int64()).take(each),
                   pa.array(values.ravel()), pa.array(np.tile(w.explained, len(x))), pa.array(np.full(len(x) * k, w.identity_error))]
            yield pa.RecordBatch.from_arrays([*columns, *own], names=[*batch.schema.names[:-1], "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = rows.mapInArrow(run, schema)
    return out.select(*renamed(id_cols), *out.columns[len(id_cols):])
