"""Whitening against dense matrices, exact sums in whole numbers, odd rows."""

import math
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from missive.llm import whitening
from missive.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def dense(vectors):
    """n, sums, eigenvalues, eigenvectors, trace of the distinct whole vectors."""
    x = np.array(sorted({tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in vectors}), dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = ((n * x - sums) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, values[::-1], axes[:, ::-1], float((centred**2).sum() / n)


def compare(got, rows, components=16):
    n, sums, values, axes, trace = dense([v for _, v in rows])
    k = min(components, len(values), int((values > len(values) * 2.3e-16 * trace).sum()))
    assert len(got) == len(rows) * k
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for i, v in rows:
        x = [math.floor(64 * float(c)) + 1_000_000 for c in v]
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums))
        centred = np.array([float(Fraction(n * a - int(s), n)) for a, s in zip(x, sums)])
        for c in range(k):
            r = by[i, c + 1][0]
            plain = centred @ axes[:, c] / np.sqrt(values[c])
            sign = signs.setdefault(c, 1 if abs(plain) < 1e-6 or plain * r.whitened > 0 else -1) if abs(plain) > 1e-6 else 1
            assert (r.n, r.deviation) == (n, deviation)
            assert abs(plain) < 1e-6 or abs(sign * plain - r.whitened) < 1e-8 * max(1, abs(plain))
            assert abs(r.explained - values[c] / trace) < 1e-12 and r.identity_error < 1e-9


@pytest.mark.parametrize("size, count", [(1, 1), (3, 3), (40, 16), (300, 5), (300, 16)])
def test_eigenpairs_equal_dense_ones(size, count):
    rng = np.random.default_rng(size + count)
    root = rng.standard_normal((size, size)) * np.geomspace(1, 1e-3, size)
    matrix = root @ root.T
    passes = []

    def product(columns):
        passes.append(columns.shape[1])
        return matrix @ columns

    values, axes, residuals = whitening.eigenpairs(product, size, count)
    expected = np.linalg.eigvalsh(matrix)[::-1][:count]
    assert np.abs(values - expected).max() <= 1e-13 * expected[0]
    assert np.abs(axes.T @ axes - np.eye(count)).max() < 1e-13
    assert np.abs(matrix @ axes - axes * values).max() <= 1e-13 * expected[0] and residuals.max() <= 1e-13 * expected[0]
    assert max(passes) <= count + whitening.SPARE


def test_equal_eigenvalues_and_no_variance():
    for values in ([5.0] * 6 + [1.0] * 20, [0.0] * 9, [3.0, 0, 0, 0, 0]):
        matrix = np.diag(values)
        found, axes, _ = whitening.eigenpairs(lambda c: matrix @ c, len(values), 4)
        assert np.allclose(found, sorted(values, reverse=True)[:4], atol=1e-13)
        assert np.abs(axes.T @ axes - np.eye(4)).max() < 1e-12


def test_query_equals_dense_version(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    compare(QUERIES["op12_whitening"](spark, SF).collect(), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [(k, (rng.standard_normal(5) * [9, 4, 2, 1, 0.5]).round(3).tolist()) for k in range(60)]
    good += [(100 + k, good[0][1]) for k in range(40)] + [(100, good[1][1])]
    odd = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [math.nan] * 5), (204, [math.inf] * 5)]
    odd += [(205, [1.0] * 4), (206, [1e30, 0.0, 0.0, 0.0, 0.0])]
    schema = "vec_id long, embedding array<double>, n string, x string"
    df = spark.createDataFrame([(*r, "n", "x") for r in good + odd], schema).repartition(7)
    got = whitening.whitened(df).collect()
    compare([r for r in got if r.vec_id != 100], [r for r in good if r[0] != 100])
    assert len([r for r in got if r.vec_id == 100]) == 2 * 5
    few = spark.createDataFrame([(1, [1.0, 2.0], "", ""), (None, [1.0, 4.0], "", ""), (3, [1.0, 2.0], "", "")], schema)
    found = whitening.whitened(few).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, round(abs(r.whitened), 9), round(r.explained, 9)) for r in found) == [
        (0, 1, 2, 1.0, 1.0),
        (1, 1, 2, 1.0, 1.0),
        (3, 1, 2, 1.0, 1.0),
    ]
    assert whitening.whitened(few.limit(0)).collect() == []
    assert whitening.whitened(few.where("vec_id = 1")).collect() == []


def test_great_deviations(spark):
    rows = [(k, [k * 1e9, -k * 2e9]) for k in range(40)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    for r in got:
        exact = sum((40 * a - s) ** 2 for a, s in zip(x[r.vec_id], sums))
        assert r.deviation == (exact if exact < 1 << 63 else None)
    assert any(r.deviation is None for r in got)
