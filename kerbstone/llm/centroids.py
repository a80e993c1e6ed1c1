"""Clustering of vectors around centroids, with zone maps along a Hilbert curve.

Vectors become integers (floor of ``scale`` times each component), so all sums and distances are exact. They are sorted by
their place on a Hilbert curve over all dimensions, those of the widest spread first, and cut into blocks; a block keeps the least and
the largest value of every dimension, its box, and the sum of its vectors. Blocks are written once; each round reads them.

For two centroids, the difference of the squared distances is linear in the vector, so its least value over a box is the
sum of the least values per dimension. Where it is positive, the first centroid is nearest to no vector of the block. What no other
centroid rules out are the block's candidates: a single one takes the whole block by its stored sum, several are
compared with every vector, as one matrix product. The product runs in double precision where all its terms are
exact there (components up to 2 ** 22), and in whole numbers of any size else.

Equal vectors have equal places on the curve; the row's hash comes after it in the sort, so a vector that makes up a third of all
rows spreads over tasks. A round sends one row per centroid and dimension from each task, the driver gets the totals.

Defined results: vectors of another length, null ones, and ones with null or non-finite components take no part. Null ids are
hashed as an empty text and kept; repeated rows count each. Starting centroids with equal hashes come in the order of their components. With fewer
vectors than centroids there are so many centroids. Ties go to the smaller number, an empty centroid stays. Distances and
sums that exceed 64 bits are null, without effect on the clusters. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbstone.llm.common import settled, usable
from kerbstone.llm.exact import limb_rows, matrix, read_limbs

WIDTH = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
BLOCK = 256
BITS = 6
# Up to here squares, their sums and products of components are exact in double precision.
EXACT = 2.0**22


# --- vectors --------------------------------------------------------------------------------


def whole(component: Column, scale: int) -> Column:
    """floor(scale * component), as a double, which holds it exactly."""
    scaled = component * F.lit(float(scale))
    return F.when(F.abs(scaled) < 2.0**52, F.floor(scaled).cast("double")).otherwise(scaled)


def whole_vectors(embeddings: DataFrame, width: int, scale: int, vector: str) -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    doubles = F.col(vector).cast("array<double>")
    return embeddings.filter(usable(doubles, width)).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(doubles, lambda c: whole(c, scale)).alias("x"),
    )


def _spread(width: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(width, np.inf), np.full(width, -np.inf)
        total, square, n = np.zeros(width), np.zeros(width), 0
        for batch in batches:
            x = matrix(batch.column("x"), width)
            if len(x):
                low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
                total, square, n = total + x.sum(0), square + (x**2).sum(0), n + len(x)
        if n:
            columns = [np.arange(width, dtype=np.int32), np.full(width, n), low, high, total, square]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], ["dim", "n", "low", "high", "total", "square"]
            )

    return measure


def spreads(vectors: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The number of vectors; per dimension the least and largest value and the variance."""
    parts = vectors.select("x").mapInArrow(
        _spread(width), "dim int, n long, low double, high double, total double, square double"
    )
    found = (
        parts.groupBy("dim")
        .agg(F.sum("n"), F.min("low"), F.max("high"), F.sum("total"), F.sum("square"))
        .orderBy("dim")
        .collect()
    )
    if not found:
        return 0, np.zeros(width), np.zeros(width), np.zeros(width)
    n, low, high, total, square = np.array([tuple(r)[1:] for r in found], float).T
    return int(n[0]), low, high, square / n - (total / n) ** 2


# --- the curve ------------------------------------------------------------------------------


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Hilbert curve, one row of bytes each that sorts in curve order.

    ``cells`` has one row per point, of unsigned coordinates below 2 ** bits. Coordinates are
    turned and swapped from the highest bit down, then Gray-coded, all points at a time.
    """
    axes = [cells[:, d].astype(np.uint32) for d in range(cells.shape[1])]
    for bit in range(bits - 1, 0, -1):
        below = np.uint32((1 << bit) - 1)
        for d in range(len(axes)):
            on = (axes[d] >> np.uint32(bit) & np.uint32(1)).astype(bool)
            if d == 0:
                axes[0] = np.where(on, axes[0] ^ below, axes[0])
                continue
            swap = np.where(on, np.uint32(0), (axes[0] ^ axes[d]) & below)
            axes[0] = axes[0] ^ np.where(on, below, swap)
            axes[d] = axes[d] ^ swap
    for d in range(1, len(axes)):
        axes[d] = axes[d] ^ axes[d - 1]
    turn = np.zeros(len(cells), np.uint32)
    for bit in range(bits - 1, 0, -1):
        on = (axes[-1] >> np.uint32(bit) & np.uint32(1)).astype(bool)
        turn = np.where(on, turn ^ np.uint32((1 << bit) - 1), turn)
    codes = np.column_stack([a ^ turn for a in axes])
    planes = [(codes >> np.uint32(bit)) & np.uint32(1) for bit in range(bits - 1, -1, -1)]
    return np.packbits(np.column_stack(planes).astype(np.uint8), axis=1)


def _keyed(width: int, bits: int, low: np.ndarray, high: np.ndarray, order: np.ndarray):
    unit = np.where(high > low, high - low, 1.0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), width)
            cells = np.minimum((x - low) / unit * (1 << bits), (1 << bits) - 1).astype(np.uint32)
            keys = [k.tobytes() for k in hilbert_keys(cells[:, order], bits)] if len(x) else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), pa.array(keys, pa.binary())],
                ["vec_id", "x", "place"],
            )

    return place


# --- blocks ---------------------------------------------------------------------------------

_BLOCKS = "ids array<long>, vectors binary, low binary, high binary, sums binary"


def _row_type(x: np.ndarray) -> str:
    return "<f4" if np.abs(x).max() <= 2**24 else "<f8"


def _blocked(width: int, size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], np.empty((0, width))

        def block(ids: list, x: np.ndarray) -> tuple:
            return ids, x.astype(_row_type(x)).tobytes(), *(v.tobytes() for v in (x.min(0), x.max(0), x.sum(0)))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            lists, *rest = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(lists, pa.list_(pa.int64())), *(pa.array(c, pa.binary()) for c in rest)],
                ["ids", "vectors", "low", "high", "sums"],
            )

        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            held = np.concatenate([held, matrix(batch.column("x"), width)])
            whole = len(ids) // size * size
            if whole:
                yield batch_of([block(ids[k : k + size], held[k : k + size]) for k in range(0, whole, size)])
                ids, held = ids[whole:], held[whole:]
        if ids:
            yield batch_of([block(ids, held)])

    return cut


def zone_blocks(
    vectors: DataFrame, width: int, low: np.ndarray, high: np.ndarray, spread: np.ndarray,
    size: int = BLOCK, bits: int = BITS,
) -> DataFrame:
    """Blocks of vectors in curve order, with their boxes and sums, written to the shared folder."""
    order = np.argsort(-spread, kind="stable")
    keyed = vectors.mapInArrow(
        _keyed(width, bits, low, high, order), "vec_id long, x array<double>, place binary"
    ).withColumn("row", F.xxhash64("vec_id"))
    laid = keyed.repartitionByRange("place", "row").sortWithinPartitions("place", "row")
    return settled(laid.select("vec_id", "x").mapInArrow(_blocked(width, size), _BLOCKS), "zone-blocks")


# --- assignment -----------------------------------------------------------------------------


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a vector of the box; numbers are exact."""
    norms = (centroids**2).sum(1)
    # rows: a, columns: b; the least of |x - a| ** 2 - |x - b| ** 2 over the box
    slope = 2 * (centroids[None] - centroids[:, None])
    least = np.where(slope > 0, slope * low, slope * high).sum(2) + norms[:, None] - norms[None]
    number = np.arange(len(centroids))
    beaten = (least > 0) | ((least == 0) & (number[:, None] > number[None]))
    return np.flatnonzero(~beaten.any(1))


def nearest(
    x: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: list[list[int]]
) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance) of the nearest centroid of each vector, and the number of candidates."""
    largest = max(abs(c) for row in centroids for c in row)
    if max(np.abs(low).max(), np.abs(high).max(), largest) <= EXACT:
        given = np.array(centroids, float)
        open_ = candidates(low, high, given)
        few = given[open_]
        square = (x**2).sum(1)[:, None] - 2 * (x @ few.T) + (few**2).sum(1)
    else:
        open_ = np.arange(len(centroids))
        points = np.array([[int(v) for v in row] for row in x.tolist()], object)
        square = np.array([((points - np.array(c, object)) ** 2).sum(1) for c in centroids], object).T
    best = square.argmin(1)
    return open_[best], square[np.arange(len(x)), best], len(open_)


def _opened(batch: pa.RecordBatch, width: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    names = ("ids", "vectors", "low", "high", "sums")
    for ids, vectors, low, high, sums in zip(*(batch.column(n) for n in names), strict=True):
        ids, raw = ids.as_py(), vectors.as_py()
        kind = "<f4" if len(raw) == 4 * width * len(ids) else "<f8"
        x = np.frombuffer(raw, kind).reshape(-1, width).astype(float)
        yield ids, x, *(np.frombuffer(v.as_py()) for v in (low, high, sums))


def _totals(width: int, centroids: list[list[int]]):
    k = len(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = [0] * k, np.zeros((k, width), object)
        for batch in batches:
            for ids, x, low, high, sums in _opened(batch, width):
                number, _, open_ = nearest(x, low, high, centroids)
                exact = max(np.abs(low).max(), np.abs(high).max()) <= EXACT
                for c in np.unique(number).tolist():
                    chosen = number == c
                    counts[c] += int(chosen.sum())
                    if not exact:
                        part = [sum(int(v) for v in column) for column in x[chosen].T.tolist()]
                    elif open_ == 1:
                        part = sums.astype(np.int64).tolist()
                    else:
                        part = x[chosen].sum(0).astype(np.int64).tolist()
                    totals[c] += np.array(part, object)
        # Dimension -1 stands for the number of vectors.
        taken = [c for c in range(k) if counts[c]]
        numbers = [(c, d, totals[c, d]) for c in taken for d in range(width)]
        yield limb_rows([(c, -1, counts[c]) for c in taken] + numbers, "cluster", "dim")

    return add


def moved(blocks: DataFrame, width: int, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: at most a few numbers per centroid and dimension reach the driver."""
    parts = blocks.mapInArrow(_totals(width, centroids), "cluster int, dim int, limb int, digit long")
    totals = read_limbs(parts, "cluster", "dim")
    return [
        [totals.get((c, d), 0) // totals[c, -1] for d in range(width)] if (c, -1) in totals else old
        for c, old in enumerate(centroids)
    ]


def _assigned(width: int, centroids: list[list[int]]):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, low, high, _ in _opened(batch, width):
                number, square, _ = nearest(x, low, high, centroids)
                distance = [int(s) if s < 1 << 63 else None for s in square.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(number, pa.int32()), pa.array(distance, pa.int64())],
                    ["vec_id", "cluster", "distance"],
                )

    return assign


def first_centroids(vectors: DataFrame, count: int) -> list[list[int]]:
    """The vectors with the least hashes of their id."""
    name = F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    least = vectors.select(F.sha2(name, 256).alias("hash"), "x").orderBy("hash", "x").limit(count)
    return [[int(v) for v in r["x"]] for r in least.collect()]


def _summed(distance: Column) -> Column:
    """The sum as a long; null if a distance or the sum is more than 64 bits hold."""
    total = F.sum(distance.cast("decimal(38,0)"))
    known = (F.count(distance) == F.count(F.lit(1))) & (total <= F.lit((1 << 63) - 1))
    return F.when(known, total.cast("string").try_cast("long"))


def cluster(
    embeddings: DataFrame, *, count: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH,
    scale: int = SCALE, vector: str = "embedding", block: int = BLOCK,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row per vector."""
    vectors = whole_vectors(embeddings, width, scale, vector)
    _, low, high, spread = spreads(vectors, width)
    blocks = zone_blocks(vectors, width, low, high, spread, block)
    centroids = first_centroids(vectors, count)
    for _ in range(rounds if centroids else 0):
        after = moved(blocks, width, centroids)
        if after == centroids:  # so would be all further rounds
            break
        centroids = after
    rows = blocks.mapInArrow(_assigned(width, centroids or [[0] * width]), "vec_id long, cluster int, distance long")
    assigned = settled(rows, "assigned")
    digests = assigned.sparkSession.createDataFrame(
        [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)],
        "cluster int, centroid_sha256 string",
    )
    per_cluster = assigned.groupBy("cluster").agg(_summed(F.col("distance")).alias("cluster_inertia"))
    overall = assigned.agg(_summed(F.col("distance")).alias("inertia")).first()["inertia"]
    # One row per centroid on this side.
    told = per_cluster.join(F.broadcast(digests), "cluster").withColumn("inertia", F.lit(overall).cast("long"))
    columns = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return assigned.join(F.broadcast(told), "cluster").select(*columns)
