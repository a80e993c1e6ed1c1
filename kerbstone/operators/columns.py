"""Choosing, naming and filling columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop columns; an unknown name is an error instead of being skipped."""
    names = list(names)
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    return df.drop(*names)


def keep_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.select(*[df[f"`{n}`"] for n in names])


def keep_present(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Keep the named columns that exist, in the order given."""
    return keep_columns(df, [n for n in names if n in df.columns])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def with_flag(df: DataFrame, name: str, value: int = 1) -> DataFrame:
    """Add a constant marker, so that rows are known again after a left join."""
    return df.withColumn(name, F.lit(value))


def fill_missing(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace nulls column by column; the columns not named keep theirs."""
    return df.withColumns(
        {n: F.coalesce(F.col(f"`{n}`"), F.lit(v)) for n, v in values.items()}
    )
