"""Whitening of vectors by an exact, bit-sliced scatter matrix.

Components become whole numbers, x = floor(scale * c) + shift. The fit list is each distinct vector once. Counted from the least value of its
dimension, each number is a few bits; a task packs each bit of a dimension, for 64 rows at a time, into one word. The
cross-product of two dimensions is then the sum over pairs of their bit planes of the count of common ones, weighted by the
powers of two of both: AND and popcount of whole words, no product of values, nothing rounded. A task adds up the
counts of all its rows and sends one number per pair of dimensions.

The driver holds as many numbers as the matrix has. It centres them as integers, n * sum(x y) - sum(x) * sum(y), divides once, and
takes eigenvalues and eigenvectors. The vectors never leave the tasks: each is centred exactly there and projected.

Defined results: null vectors, empty ones, and ones with null or non-finite components take no part; nor do those whose length is not the
most frequent one (the larger of equally frequent ones). Scaled components beyond 2 ** 52 in size count as that. Components of the
result whose eigenvalue is not above 1e-11 of the largest have no direction and are left out, so a single distinct vector
gives no rows. Deviations that exceed 64 bits are null. Null ids are kept, repeated rows count once in the fit and give rows each; other columns
are ignored. Signs: the largest entry of each eigenvector is positive. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbstone.llm.common import settled, usable
from kerbstone.llm.exact import limb_rows, matrix, read_limbs

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
LARGEST = 2.0**52
# Rows packed at once: so many bits of a plane.
CHUNK = 1 << 16
LEAST_SHARE = 1e-11


# --- whole numbers --------------------------------------------------------------------------


def common_width(lengths: DataFrame) -> int:
    """The most frequent of ``size``, the larger of equally frequent ones; 0 without rows."""
    best = lengths.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    return best["size"] if best else 0


def whole_vectors(embeddings: DataFrame, scale: int, shift: int, vector: str) -> tuple[DataFrame, int]:
    """(vec_id, x) of the vectors that take part, and their dimension."""
    doubles = F.col(vector).cast("array<double>")
    kept = embeddings.filter(usable(doubles))
    width = common_width(kept.select(F.size(vector).alias("size")))

    def number(c):
        held = F.greatest(F.least(c * float(scale), F.lit(LARGEST)), F.lit(-LARGEST))
        return F.floor(held).cast("long") + F.lit(shift).cast("long")

    x = F.transform(doubles, number).alias("x")
    return kept.filter(F.size(vector) == width).select(F.col("vec_id").cast("long").alias("vec_id"), x), width


# --- sums -----------------------------------------------------------------------------------


@dataclass
class Fit:
    """``n`` distinct vectors; per dimension the least and largest value and the sum."""

    n: int
    low: list[int]
    high: list[int]
    total: list[int]

    @property
    def rest(self) -> list[int]:
        """Sums of what is above the least value."""
        return [s - self.n * m for s, m in zip(self.total, self.low, strict=True)]


def _summed(width: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, upper, lower = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        low, high = np.full(width, np.iinfo(np.int64).max), np.full(width, np.iinfo(np.int64).min)
        for batch in batches:
            x = matrix(batch.column("x"), width)
            if len(x):
                n += len(x)
                upper, lower = upper + (x >> 32).sum(0), lower + (x & 0xFFFFFFFF).sum(0)
                low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        if n:
            total = [Decimal((u << 32) + v) for u, v in zip(upper.tolist(), lower.tolist(), strict=True)]
            columns = [
                pa.array(np.arange(width, dtype=np.int32)),
                pa.array(np.full(width, n)),
                pa.array(low),
                pa.array(high),
                pa.array(total, pa.decimal128(38, 0)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "n", "low", "high", "total"])

    return add


def fitted(distinct: DataFrame, width: int) -> Fit:
    """Counts and sums of the fit list, one row per dimension at the driver."""
    parts = distinct.mapInArrow(_summed(width), "dim int, n long, low long, high long, total decimal(38,0)")
    found = (
        parts.groupBy("dim")
        .agg(F.sum("n").alias("n"), F.min("low"), F.max("high"), F.sum("total"))
        .orderBy("dim")
        .collect()
    )
    low, high, total = ([int(r[k]) for r in found] for k in (2, 3, 4))
    return Fit(found[0]["n"] if found else 0, low, high, total)


# --- bit planes -----------------------------------------------------------------------------


class Planes:
    """Counts of common ones of every two bit planes, added up over chunks of rows."""

    def __init__(self, bits: list[int]) -> None:
        self.bits = bits
        self.width = len(bits)
        # Planes are ordered by bit, then dimension.
        self.dims = [np.flatnonzero(np.array(bits) > b) for b in range(max(bits, default=0))]
        self.starts = np.cumsum([0, *(len(d) for d in self.dims)])
        self.common = np.zeros((self.starts[-1], self.starts[-1]), np.int64)

    def words(self, y: np.ndarray) -> np.ndarray:
        """One row of 64-bit words per plane."""
        rows = -(-len(y) // 64) * 64
        packed = np.zeros((self.starts[-1], rows // 8), np.uint8)
        for bit, dims in enumerate(self.dims):
            ones = ((y[:, dims] >> bit) & 1).astype(np.uint8)
            packed[self.starts[bit] : self.starts[bit + 1], : -(-len(y) // 8)] = np.packbits(ones, axis=0).T
        return packed.view(np.uint64)

    def add(self, y: np.ndarray) -> None:
        words = self.words(y)
        for p in range(len(words)):
            self.common[p, p:] += np.bitwise_count(words[p] & words[p:]).sum(1, dtype=np.int64)

    def products(self) -> np.ndarray:
        """Sums of products of every two dimensions, as whole numbers of any size."""
        common = self.common + np.triu(self.common, 1).T
        by_weight = np.zeros((max(2 * len(self.dims) - 1, 0), self.width, self.width), np.int64)
        for a, left in enumerate(self.dims):
            for b, right in enumerate(self.dims):
                block = common[self.starts[a] : self.starts[a + 1], self.starts[b] : self.starts[b + 1]]
                by_weight[a + b][np.ix_(left, right)] += block
        result = np.zeros((self.width, self.width), object)
        for weight, counts in enumerate(by_weight):
            result += counts.astype(object) * (1 << weight)
        return result


def _crossed(low: list[int], bits: list[int]):
    least = np.array(low, np.int64)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, held, n = Planes(bits), [], 0
        for batch in batches:
            y = matrix(batch.column("x"), len(bits)) - least
            for at in range(0, len(y), CHUNK):
                held.append(y[at : at + CHUNK])
                n += len(held[-1])
                if n >= CHUNK:
                    planes.add(np.concatenate(held))
                    held, n = [], 0
        if held:
            planes.add(np.concatenate(held))
        products = planes.products()
        upper = [(i, j, products[i, j]) for i in range(len(bits)) for j in range(i, len(bits))]
        yield limb_rows(upper, "i", "j")

    return cross


def covariance(distinct: DataFrame, fit: Fit) -> np.ndarray:
    """The covariance matrix of the fit list: exact whole numbers, rounded once at the end."""
    width, n, rest = len(fit.low), fit.n, fit.rest
    bits = [(h - m).bit_length() for h, m in zip(fit.high, fit.low, strict=True)]
    products = read_limbs(distinct.mapInArrow(_crossed(fit.low, bits), "i int, j int, limb int, digit long"), "i", "j")
    result = np.zeros((width, width))
    for i in range(width):
        for j in range(i, width):
            # Python divides whole numbers of any size with one rounding.
            result[i, j] = result[j, i] = (n * products.get((i, j), 0) - rest[i] * rest[j]) / (n * n)
    return result


# --- components -----------------------------------------------------------------------------


@dataclass
class Whitening:
    """The transformation: columns of ``axes`` are unit eigenvectors by falling eigenvalue."""

    fit: Fit
    values: np.ndarray
    axes: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """(x - mean as doubles, the sum of squares of n * x - sum)."""
        fit = self.fit
        y, rest = x - np.array(fit.low, np.int64), np.array(fit.rest, object)
        reach = fit.n * max(h - m for h, m in zip(fit.high, fit.low, strict=True))
        if reach * reach * len(fit.low) < 1 << 62:
            scaled = fit.n * y - rest.astype(np.int64)
            return scaled / fit.n, (scaled**2).sum(1).tolist()
        scaled = fit.n * y.astype(object) - rest
        square = (scaled**2).sum(1).tolist()
        return (scaled / fit.n).astype(float), [s if s < 1 << 63 else None for s in square]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.axes / np.sqrt(self.values)


def components(fit: Fit, matrix: np.ndarray, count: int) -> Whitening:
    values, axes = np.linalg.eigh(matrix)
    values, axes = values[::-1], axes[:, ::-1]
    kept = np.flatnonzero(values > LEAST_SHARE * max(values.max(initial=0), 0))[:count]
    values, axes = values[kept], axes[:, kept]
    largest = np.abs(axes).argmax(0)
    axes = axes * np.where(axes[largest, np.arange(len(kept))] < 0, -1.0, 1.0)
    return Whitening(fit, values, axes, float(np.trace(matrix)))


def _moments(white: Whitening, width: int):
    k = len(white.values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = white.whitened(white.centred(matrix(batch.column("x"), width))[0])
            one = np.column_stack([w, np.ones(len(w))])
            total += one.T @ one
        i, j = (v.ravel().astype(np.int32) for v in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "value"])

    return add


def identity_error(distinct: DataFrame, white: Whitening, width: int) -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity, measured on the
    whitened vectors themselves."""
    k = len(white.values)
    parts = distinct.mapInArrow(_moments(white, width), "i int, j int, value double")
    total = np.zeros((k + 1, k + 1))
    for i, j, value in parts.groupBy("i", "j").agg(F.sum("value")).collect():
        total[i, j] = value
    mean = total[k, :k] / total[k, k]
    return float(np.abs(total[:k, :k] / total[k, k] - np.outer(mean, mean) - np.eye(k)).max())


_RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def _projected(white: Whitening, error: float, width: int):
    k = len(white.values)
    explained = white.values / white.trace if k else white.values

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows or not k:
                continue
            centred, square = white.centred(matrix(batch.column("x"), width))
            which = np.repeat(np.arange(rows), k)
            columns = [
                batch.column("vec_id").take(pa.array(which)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, white.fit.n)),
                pa.array(square, pa.int64()).take(pa.array(which)),
                pa.array(white.whitened(centred).ravel()),
                pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * k, error)),
            ]
            names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return project


def fit_whitening(vectors: DataFrame, width: int, count: int) -> tuple[Whitening, float]:
    """The whitening of the distinct vectors among ``vectors``, and its identity error."""
    distinct = settled(vectors.select("x").distinct(), "distinct-vectors")
    fit = fitted(distinct, width)
    if not fit.n:
        return Whitening(fit, np.zeros(0), np.zeros((width, 0)), 0.0), 0.0
    white = components(fit, covariance(distinct, fit), count)
    error = identity_error(distinct, white, width) if len(white.values) else 0.0
    return white, error


def whiten(
    embeddings: DataFrame, *, count: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT,
    vector: str = "embedding",
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector and
    component."""
    vectors, width = whole_vectors(embeddings, scale, shift, vector)
    white, error = fit_whitening(vectors, width, count)
    return vectors.mapInArrow(_projected(white, error, width), _RESULT)
