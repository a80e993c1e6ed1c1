"""Whole numbers of any size as rows that Spark adds up."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BITS = 60


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of ``width`` numbers each as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) in base 2 ** 60, the highest digit signed."""
    at = 0
    while value not in (0, -1):
        yield at, value & ((1 << _BITS) - 1)
        value >>= _BITS
        at += 1
    if value:
        yield at, -1


def limb_rows(numbers: Iterable[tuple[int, int, int]], *keys: str) -> pa.RecordBatch:
    """Rows (first key, second key, limb, digit) of keyed numbers; zeros have none."""
    rows = [(a, b, *limb) for a, b, value in numbers for limb in limbs(value)]
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [*keys, "limb", "digit"])


def read_limbs(rows: DataFrame, *keys: str) -> dict[tuple[int, int], int]:
    """The sums per pair of keys. Callers see to it that there are few."""
    digits = F.sum(F.col("digit").cast("decimal(38,0)")).alias("sum")
    result: dict[tuple[int, int], int] = {}
    for a, b, limb, digit in rows.groupBy(*keys, "limb").agg(digits).collect():
        result[a, b] = result.get((a, b), 0) + (int(digit) << _BITS * limb)
    return result
