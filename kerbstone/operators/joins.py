"""Joins on a property key.

``attach`` and ``flag_in`` expect one row per key on the left, as feature tables have:
no key can be hot then, and right sides arrive aggregated. ``events_with`` has the many rows on
the left, where AQE splits a hot key by itself; ``attach_events`` has them on the right of a left join, where
it can't, so hot keys are split here. Null keys never match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# So many rows of one key one task takes without help.
PART_ROWS = 1_000_000


def hot_keys(df: DataFrame, key: str, part_rows: int = PART_ROWS) -> DataFrame:
    """(key, parts): keys with more than ``part_rows`` rows, and into how many parts of about
    that size to split each. One pass over the key column; there are at most rows / ``part_rows``."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.filter(F.col("n") > part_rows).select(
        key, F.ceil(F.col("n") / part_rows).cast("int").alias("parts")
    )


def _parted(df: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """Add ``parts``, 1 for keys that aren't hot."""
    return df.join(hot, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))


def _part(df: DataFrame, parts: Column) -> Column:
    """Which part of its key a row belongs to: settled by the row's own values, so that
    a task run again decides the same way."""
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), parts).cast("int")


def attach(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join to a table with one row per key."""
    return left.join(right, key, "left")


def attach_events(
    left: DataFrame, right: DataFrame, key: str, part_rows: int = PART_ROWS
) -> DataFrame:
    """Left join that repeats each left row for all its rows on the right.

    Rows of a hot key of the right are split into parts of about ``part_rows``; its left rows go
    to every part, and copies whose part holds nothing are dropped: a hot key fills at least
    one part. All in one lazy plan: the planner sees to the small list of hot keys.
    """
    right = right.filter(F.col(key).isNotNull())
    hot = hot_keys(right, key, part_rows)
    split = _parted(right, hot, key).withColumn("_part", _part(right, F.col("parts")))
    copies = _parted(left, hot, key).withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    joined = copies.join(
        split.drop("parts").withColumn("_matched", F.lit(True)), [key, "_part"], "left"
    )
    return joined.filter(F.col("_matched") | (F.col("parts") == 1)).drop(
        "_part", "parts", "_matched"
    )


def events_with(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join events, any number per key, to a table with one row per key.

    ``how`` is left, inner, left_semi or left_anti: in all of them AQE's skew join may split
    the left side.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join: {how}")
    return left.join(right, key, how)


def not_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is absent from ``keys``."""
    return events_with(df, keys.select(key).distinct(), key, "left_anti")


def flag_in(df: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """Add 1/0: does the row's key occur in ``keys``? One row per key in ``df``."""
    marks = keys.filter(F.col(key).isNotNull()).select(key).distinct().withColumn(name, F.lit(1))
    return attach(df, marks, key).withColumn(name, F.coalesce(name, F.lit(0)))


def reopened(foreclosures: DataFrame, permits: DataFrame, key: str, foreclosed: str, permit: str):
    """Keys with any permit later than any foreclosure, ``foreclosed`` and ``permit`` being years.

    "Any pair" holds exactly when the latest permit is later than the earliest
    foreclosure, so one row per key and side decides it and no pairs are formed.
    """
    first = foreclosures.groupBy(key).agg(F.min(foreclosed).alias("first_foreclosed"))
    last = permits.groupBy(key).agg(F.max(permit).alias("last_permit"))
    return (
        first.join(last, key).filter(F.col("last_permit") > F.col("first_foreclosed")).select(key)
    )
