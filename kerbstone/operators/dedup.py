"""Removing repeated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Values that an aggregation buffer changes in place.
_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def keep_last(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``; null keys form one group.

    An aggregate, not a window: each task reduces its rows to one per key
    before the shuffle, so a key with a third of all rows is no hot spot. A row of numbers
    and dates goes through one ``max_by`` per column, which stays in hash aggregation; any
    other goes whole through a single one, whose buffer holds the order once. ``order`` must
    be unique per key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    values = [c for c in df.columns if c not in keys]
    types = {f.name: f.dataType for f in df.schema}
    if len(order) == 1 and all(isinstance(types[c], _FIXED) for c in (*values, *order)):
        place = F.col(f"`{order[0]}`")
        last = df.groupBy(*keys).agg(*[F.max_by(F.col(f"`{c}`"), place).alias(c) for c in values])
    else:
        row = F.struct(*[F.col(f"`{c}`") for c in values])
        last = df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("last"))
        last = last.select(*keys, "last.*")
    return last.select(*[F.col(f"`{c}`") for c in df.columns])
