"""Centroid clustering against plain whole-number rounds."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbstone.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance string, x int, row int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", "d", 1, 2) for i, v in rows], SCHEMA)


def simple(rows, width, count=8, rounds=10):
    """Rows of (vec_id, cluster, distance), inertia and centroids, in plain steps."""
    kept = [
        (i, tuple(math.floor(1024 * c) for c in v))
        for i, v in rows
        if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)
    ]
    digest = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    chosen = [list(v) for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:count]]

    def assign():
        found = []
        for _, v in kept:
            distance = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in chosen]
            found.append((distance.index(min(distance)), min(distance)))
        return found

    for _ in range(rounds):
        found = assign()
        for c in range(len(chosen)):
            own = [v for (_, v), (k, _) in zip(kept, found, strict=True) if k == c]
            if own:
                chosen[c] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    return [(i, *f) for (i, _), f in zip(kept, assign(), strict=True)], chosen


def check(spark, rows, width, **options):
    found = centroids.cluster(frame(spark, rows), width=width, **options).collect()
    wanted, chosen = simple(rows, width, options.get("count", 8))
    order = lambda r: (r[0] is None, r)
    fits = lambda n: n if n < 2**63 else None
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in found), key=str) == sorted(
        ((i, c, fits(d)) for i, c, d in wanted), key=str
    )
    total = sum(d for *_, d in wanted)
    for r in found:
        assert r.inertia == fits(total)
        assert r.cluster_inertia == fits(sum(d for _, c, d in wanted if c == r.cluster))
        text = ",".join(map(str, chosen[r.cluster]))
        assert r.centroid_sha256 == hashlib.sha256(text.encode()).hexdigest()
    return found, order


def vectors(seed, n, width, groups=5, noise=0.1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, width))
    return (centers[rng.integers(0, groups, n)] + noise * rng.normal(size=(n, width))).astype(np.float32)


@pytest.mark.parametrize(("seed", "width", "block"), [(1, 64, 16), (2, 3, 4), (3, 64, 256)])
def test_equals_plain_rounds(spark, seed, width, block):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(seed, 300, width))]
    rows += [(500 + i, rows[7][1]) for i in range(150)]  # a third are one vector
    check(spark, rows, width, block=block)


def test_ties_and_few_values(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 1 / 1024, -1 / 1024]) for _ in range(4)]) for i in range(200)]
    check(spark, rows, 4, block=8)


def test_awkward_rows(spark):
    good = [0.5, -0.25, 0.125]
    rows = [(1, good), (1, good), (None, [0.0, 0.0, 1.0]), (2, None), (3, []), (4, [1.0, 2.0])]
    rows += [(5, [None, 1.0, 1.0]), (6, [float("nan"), 0.0, 0.0]), (7, [float("inf"), 0.0, 0.0])]
    check(spark, rows, 3)
    check(spark, rows + [(10 + i, [i / 7, 1.0, float(-i)]) for i in range(30)], 3)
    for nothing in ([], rows[3:]):
        assert centroids.cluster(frame(spark, nothing), width=3).count() == 0


def test_large_components_are_exact(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 4, 6, 30]) for _ in range(3)]) for i in range(60)]
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    found, _ = check(spark, rows, 3, block=8)
    assert any(r.distance is None for r in found)


@pytest.mark.parametrize(("width", "bits"), [(2, 3), (3, 2), (2, 1)])
def test_curve_steps_by_one(width, bits):
    grid = np.indices([1 << bits] * width).reshape(width, -1).T
    keys = centroids.hilbert_keys(grid, bits)
    order = sorted(range(len(grid)), key=lambda i: keys[i].tobytes())
    steps = np.abs(np.diff(grid[order], axis=0)).sum(1)
    assert (steps == 1).all()


def test_candidates_hold_every_nearest():
    rng = np.random.default_rng(6)
    for _ in range(200):
        x = np.floor(rng.normal(size=(20, 5)) * rng.choice([3, 50]) + rng.integers(-60, 60, 5))
        given = np.floor(rng.normal(size=(6, 5)) * 50)
        near = ((x[:, None] - given[None]) ** 2).sum(2).argmin(1)
        assert set(near) <= set(centroids.candidates(x.min(0), x.max(0), given))


def test_boxes_prune_on_grouped_vectors(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(9, 4000, 64, groups=8, noise=0.02))]
    whole = centroids.whole_vectors(frame(spark, rows), 64, 1024, "embedding")
    _, low, high, spread = centroids.spreads(whole, 64)
    blocks = centroids.zone_blocks(whole, 64, low, high, spread, 64).collect()
    given = np.array(simple(rows[:400], 64, rounds=3)[1], float)
    boxes = [(np.frombuffer(b.low), np.frombuffer(b.high)) for b in blocks]
    left = sum(len(centroids.candidates(lo, hi, given)) for lo, hi in boxes)
    assert sum(len(b.ids) for b in blocks) == 4000
    assert left < 0.5 * 8 * len(blocks)


def test_ids_and_centroids_of_the_driver_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    found = centroids.cluster(table)
    assert found.agg(F.countDistinct("inertia")).first()[0] == 1
    wanted, _ = simple(rows, 64)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in found.collect()) == sorted(wanted)
