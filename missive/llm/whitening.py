"""Whitening of embeddings along the leading components of their covariance, found by Jacobi-Davidson.

Entries are taken to whole numbers, so sums over all vectors are exact and equal vectors are equal. The covariance is that of the
distinct vectors. It is never formed: `Fit.product` multiplies it with a few columns at a time in one pass over the distinct
vectors, each centred first, and adds up one small array for each task. On the driver lie a basis of a few columns of the
vectors' length and its products. `eigenpairs` takes the Ritz pairs of the basis, solves for each wanted pair that is not exact
yet the projected correction equation by a few steps of MINRES, all pairs in one pass a step, adds the corrections to the basis,
and locks leading pairs once their residuals reach double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.llm.common import shared_folder

COMPONENTS = 16
SCALE = 64
SHIFT = 1_000_000
# vectors in a stored block of the fit list, as entries
BLOCK_ENTRIES = 1 << 18
# steps of the inner solver, columns beyond the wanted ones, basis columns for each wanted one before a restart
INNER_STEPS = 5
SPARE = 4
MOST_BASIS = 5
ROUNDS = 200

WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and x = floor(64 c) + 1,000,000 for each entry c; a vector that is missing, or has a missing or not finite entry or
    one whose x is no 64-bit number, goes."""

    def fits(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < 2.0**62 / SCALE)

    whole = F.transform(vec_col, lambda c: F.floor(SCALE * c.cast("double")) + SHIFT)
    usable = F.col(vec_col).isNotNull() & F.coalesce(F.forall(vec_col, fits), F.lit(False))
    return rows.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("x"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


class Fit:
    """The distinct vectors in stored blocks, with their number and exact sums."""

    def __init__(self, vectors: DataFrame, size: int) -> None:
        self.spark, self.size = vectors.sparkSession, size
        per_block = max(1, BLOCK_ENTRIES // size)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting, count = [], 0
            for batch in batches:
                waiting.append(_matrix(batch.column(0), size))
                count += len(waiting[-1])
                while count >= per_block:
                    rows = np.concatenate(waiting)
                    yield pa.RecordBatch.from_arrays([pa.array([rows[:per_block].tobytes()])], ["block"])
                    waiting, count = [rows[per_block:]], count - per_block
            if count:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(waiting).tobytes()])], ["block"])

        self.path = shared_folder(self.spark, "whitening")
        vectors.select("x").distinct().mapInArrow(pack, "block binary").write.parquet(self.path)
        sums = self._added(lambda x: np.concatenate([[len(x)], x.sum(axis=0)]), size + 1, "long")
        self.n, self.sums = int(sums[0]), np.array(sums[1:], dtype=np.int64)

    def _added(self, of: Callable[[np.ndarray], np.ndarray], length: int, kind: str = "double") -> np.ndarray:
        """Sum of a small array over all blocks: one array a task, added by position."""
        size, dtype = self.size, np.int64 if kind == "long" else np.float64

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(length, dtype=dtype)
            for batch in batches:
                for block in batch.column(0):
                    total += of(np.frombuffer(block.as_buffer(), dtype=np.int64).reshape(-1, size)).ravel()
            values = pa.ListArray.from_arrays([0, length], pa.array(total))
            yield pa.RecordBatch.from_arrays([values], ["part"])

        parts = self.spark.read.schema("block binary").parquet(self.path).mapInArrow(run, f"part array<{kind}>")
        found = parts.select(F.posexplode("part").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).collect()
        total = np.zeros(length, dtype=dtype)
        for row in found:
            total[row.at] = row.value
        return total

    def _centred(self) -> Callable[[np.ndarray], np.ndarray]:
        n, sums = self.n, self.sums
        # exact before the division
        return lambda x: (n * x - sums) / n

    def product(self, columns: np.ndarray) -> np.ndarray:
        """Covariance times columns."""
        centred = self._centred()

        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return c.T @ (c @ columns)

        return self._added(part, columns.size).reshape(columns.shape) / self.n

    def trace(self) -> float:
        centred = self._centred()
        return float(self._added(lambda x: np.array([(centred(x) ** 2).sum()]), 1)[0] / self.n)

    def covariance_of(self, columns: np.ndarray) -> np.ndarray:
        """Covariance of the projections on columns, from the projections themselves."""
        centred, k = self._centred(), columns.shape[1]

        def part(x: np.ndarray) -> np.ndarray:
            p = centred(x) @ columns
            return p.T @ p

        return self._added(part, k * k).reshape(k, k) / self.n


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what `new` adds to the bases."""
    kept: list[np.ndarray] = []
    for column in new.T:
        length = np.linalg.norm(column)
        for _ in range(3):
            for basis in (*bases, *[k[:, None] for k in kept]):
                column = column - basis @ (basis.T @ column)
        if length > 0 and np.linalg.norm(column) > 1e-10 * length:
            kept.append(column / np.linalg.norm(column))
    return np.stack(kept, axis=1) if kept else new[:, :0]


def _minres(operator: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """A few steps of MINRES for several symmetric systems, one a column, each with its own coefficients."""
    x = np.zeros_like(right)
    beta = np.linalg.norm(right, axis=0)
    alive = beta > 0
    v, before = np.where(alive, right / np.where(alive, beta, 1), 0), np.zeros_like(right)
    d, d_before = np.zeros_like(right), np.zeros_like(right)
    eta, last = beta.copy(), np.zeros_like(beta)
    c, s, c_before, s_before = np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        w = operator(v)
        alpha = (v * w).sum(axis=0)
        w = w - alpha * v - last * before
        following = np.linalg.norm(w, axis=0)
        # the tridiagonal column, rotated by the two rotations before and by a new one
        top = s_before * last
        middle = c * c_before * last + s * alpha
        low = c * alpha - s * c_before * last
        length = np.hypot(low, following)
        alive = alive & (length > 0)
        safe = np.where(alive, length, 1)
        c_before, s_before, c, s = c, s, np.where(alive, low / safe, 1), np.where(alive, following / safe, 0)
        d, d_before = np.where(alive, (v - middle * d - top * d_before) / safe, 0), d
        x = x + np.where(alive, c * eta, 0) * d
        eta = -s * eta
        more = following > 1e-14 * np.maximum(beta, 1e-300)
        alive = alive & more
        before, v = v, np.where(more, w / np.where(more, following, 1), 0)
        last = following
    return x


def eigenpairs(
    product: Callable[[np.ndarray], np.ndarray], size: int, count: int, seed: int = 7
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues of a symmetric operator, falling, their unit vectors as columns, their residuals."""
    start = np.random.default_rng(seed).standard_normal((size, min(size, count + SPARE)))
    basis = _orthonormal(start)
    products = product(basis)
    locked, values, left = np.zeros((size, 0)), np.zeros(0), np.zeros(0)
    for _ in range(ROUNDS):
        h = basis.T @ products
        theta, turn = np.linalg.eigh((h + h.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, products = basis @ turn, products @ turn
        wanted = count - len(values)
        residuals = products - basis * theta
        residuals -= locked @ (locked.T @ residuals)
        norms = np.linalg.norm(residuals, axis=0)
        top = max(abs(theta[0]), values.max(initial=0))
        full = basis.shape[1] + locked.shape[1] == size
        exact = (norms <= 16 * np.finfo(float).eps * np.sqrt(size) * top) | full
        done = wanted if exact[:wanted].all() else int(np.argmin(exact[:wanted]))
        locked = np.concatenate([locked, basis[:, :done]], axis=1)
        values, left = np.concatenate([values, theta[:done]]), np.concatenate([left, norms[:done]])
        basis, products, residuals, theta, exact = (a[..., done:] for a in (basis, products, residuals, theta, exact))
        wanted -= done
        if wanted == 0:
            break
        if basis.shape[1] > MOST_BASIS * count:
            basis, products, residuals, theta = (a[..., : wanted + SPARE] for a in (basis, products, residuals, theta))
        todo = np.flatnonzero(~exact[:wanted])
        known = np.concatenate([locked, basis[:, :wanted]], axis=1)
        shifts = theta[todo]

        def outside(columns: np.ndarray) -> np.ndarray:
            return columns - known @ (known.T @ columns)

        def corrected(columns: np.ndarray) -> np.ndarray:
            columns = outside(columns)
            return outside(product(columns) - shifts * columns)

        steps = _minres(corrected, outside(-residuals[:, todo]), INNER_STEPS)
        new = _orthonormal(np.concatenate([steps, residuals[:, todo]], axis=1), locked, basis)[:, : len(todo)]
        if new.shape[1] == 0:
            # nothing to add: a direction the basis has not seen yet
            new = _orthonormal(np.random.default_rng(seed + 1).standard_normal((size, 1)), locked, basis)
        basis, products = np.concatenate([basis, new], axis=1), np.concatenate([products, product(new)], axis=1)
    else:
        raise ArithmeticError(f"residuals {norms[:wanted]} after {ROUNDS} rounds")
    order = np.argsort(-values, kind="stable")
    return values[order], locked[:, order], left[order]


def whitened(
    rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """For each usable row and component, from 1 by falling variance: n (distinct vectors), deviation (exact sum of squares of
    n x - S), the whitened value, the component's share of the variance, and the largest error of the whitened covariance.

    Unusable vectors (see `whole_vectors`) go. Vectors of another length than most (the greater of equally common lengths) go
    too. Components without variance, as in a table of few distinct vectors, are left out, so one distinct vector gives no rows;
    nor does an empty table. Repeated rows give their values again; the largest entry of a component is positive. Sums of x, and
    n x, have to stay within 64 bits; a deviation beyond them is null. Other columns are left out.
    """
    vectors = whole_vectors(rows, id_col, vec_col)
    spark = rows.sparkSession
    sizes = vectors.groupBy(F.size("x").alias("size")).count().where("size > 0")
    common = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        return spark.createDataFrame([], WHITENED)
    size = common["size"]
    vectors = vectors.where(F.size("x") == size)
    fit = Fit(vectors, size)
    values, axes, _ = eigenpairs(fit.product, size, min(components, size))
    trace = fit.trace()
    some = values > size * np.finfo(float).eps * max(trace, 0)
    if not some.any():
        return spark.createDataFrame([], WHITENED)
    values, axes = values[some], axes[:, some]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(values))])
    scaled = axes / np.sqrt(values)
    error = float(np.abs(fit.covariance_of(scaled) - np.eye(len(values))).max())
    n, sums, k = fit.n, fit.sums, len(values)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), size)
            centred = n * x - sums
            if size * float(np.abs(centred).max(initial=0)) ** 2 < 2.0**62:
                deviation = pa.array((centred * centred).sum(axis=1))
            else:
                exact = [sum(int(c) ** 2 for c in row) for row in centred]
                deviation = pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())
            each = np.repeat(np.arange(len(x)), k)
            columns = [
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), n)),
                deviation.take(pa.array(each)),
                pa.array(((centred / n) @ scaled).ravel()),
                pa.array(np.tile(values / trace, len(x))),
                pa.array(np.full(len(each), error)),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
            )

    return vectors.mapInArrow(score, WHITENED)
