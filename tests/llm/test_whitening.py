"""Whitening against whole-number sums and a plain eigendecomposition."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from kerbstone.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n string, x int, size int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", "n", 1, 2) for i, v in rows], SCHEMA)


def simple(rows):
    """(kept rows, n, sums, covariance) with exact fractions."""
    kept = [
        (i, [math.floor(64 * min(max(c, -(2.0**46)), 2.0**46)) + 1_000_000 for c in v])
        for i, v in rows
        if v and all(c is not None and math.isfinite(c) for c in v)
    ]
    lengths = [len(v) for _, v in kept]
    width = max(set(lengths), key=lambda w: (lengths.count(w), w), default=0)
    kept = [(i, v) for i, v in kept if len(v) == width]
    fit = [list(v) for v in {tuple(v) for _, v in kept}]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    v = [
        [sum(Fraction(n * a[i] - sums[i]) * (n * a[j] - sums[j]) for a in fit) / n**3 for j in range(width)]
        for i in range(width)
    ]
    return kept, n, sums, np.array([[float(c) for c in row] for row in v])


def check(spark, rows, count=16, tolerance=1e-8):
    found = whitening.whiten(frame(spark, rows), count=count).collect()
    kept, n, sums, v = simple(rows)
    values, axes = np.linalg.eigh(v) if n else (np.zeros(0), np.zeros((0, 0)))
    values, axes = values[::-1], axes[:, ::-1]
    rank = int((values > 1e-11 * max(values.max(initial=0), 0)).sum())
    k = min(count, rank)
    assert len(found) == len(kept) * k
    wanted = {}
    for i, x in kept:
        square = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        y = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)])
        wanted.setdefault(i, []).append((square, y @ axes[:, :k] / np.sqrt(values[:k])))
    sign = {}
    for r in sorted(found, key=lambda r: -abs(r.whitened)):
        assert r.n == n and r.identity_error < 1e-4
        c = r.component - 1
        assert abs(r.explained - values[c] / np.trace(v)) <= 1e-9 * r.explained
        options = wanted[r.vec_id]
        if len(options) == 1:
            square, w = options[0]
            assert r.deviation == (square if square < 2**63 else None)
            sign.setdefault(c, 1 if r.whitened * w[c] >= 0 else -1)
            assert abs(r.whitened - sign[c] * w[c]) <= tolerance * max(1, abs(w[c]))
    return found


def vectors(seed, n, width):
    rng = np.random.default_rng(seed)
    spread = np.diag(1.5 ** -np.arange(width)) @ rng.normal(size=(width, width))
    return (rng.normal(size=(n, width)) @ spread + rng.normal(size=width)).astype(np.float32)


@pytest.mark.parametrize(("seed", "n", "width"), [(1, 300, 20), (2, 40, 5), (3, 12, 20)])
def test_equals_exact_sums(spark, seed, n, width):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(seed, n, width))]
    rows += [(1000 + i, rows[3][1]) for i in range(n // 2)]  # a third are one vector
    found = check(spark, rows)
    assert max(r.component for r in found) == min(16, width, n - 1)


def test_awkward_rows(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(5, 30, 3))]
    rows += [(1, rows[1][1]), (None, [0.0, 1.0, 2.0]), (50, None), (51, []), (52, [1.0, 2.0])]
    rows += [(53, [None, 1.0, 1.0]), (54, [float("nan")] * 3), (55, [0.0, float("-inf"), 1.0])]
    check(spark, rows)
    assert check(spark, []) == check(spark, rows[-6:-4]) == []
    assert check(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []


def test_equally_frequent_lengths(spark):
    found = check(spark, [(1, [1.0, 2.0]), (2, [3.0, 5.0]), (3, [1.0]), (4, [2.0])])
    assert {r.vec_id for r in found} == {1, 2}


def test_large_components_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, np.float32([rng.uniform(-1, 1) * 1e9, rng.uniform(-1, 1) * 1e7]).tolist()) for i in range(40)]
    found = check(spark, rows, tolerance=1e-6)
    assert any(r.deviation is None for r in found)
    check(spark, rows + [(99, [3e38, 1.0])], tolerance=1e-4)


@pytest.mark.parametrize("chunk", [64, 100, 1 << 16])
def test_planes_count_products(chunk):
    rng = np.random.default_rng(4)
    y = np.column_stack([rng.integers(0, 1 << b, 777) for b in (1, 7, 20, 50, 3)])
    y = np.column_stack([y, np.zeros(777, np.int64)])
    planes = whitening.Planes([1, 7, 20, 50, 3, 0])
    for at in range(0, len(y), chunk):
        planes.add(y[at : at + chunk])
    exact = y.astype(object)
    assert (planes.products() == exact.T @ exact).all()


def test_driver_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check(spark, [(r.vec_id, r.embedding) for r in table.collect()])
