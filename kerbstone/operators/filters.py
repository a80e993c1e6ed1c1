"""Row conditions, above all on years."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Span:
    """Years from ``first`` to ``last``, both included; None leaves that end open."""

    first: int | None = None
    last: int | None = None

    @classmethod
    def up_to(cls, as_of: int) -> Span:
        return cls(None, as_of)

    @classmethod
    def label(cls, as_of: int, horizon: int = 4, offset: int = 0) -> Span:
        """The years whose incidents label a row known in ``as_of``."""
        return cls(as_of + offset, as_of + horizon)


def in_span(df: DataFrame, name: str, span: Span) -> Column:
    """Is the year or time in column ``name`` within ``span``? Null never is.

    A time is compared with the first instants of two years, not through
    ``year()``: only plain comparisons reach the file scan.
    """
    kind = df.schema[name].dataType
    column = F.col(f"`{name}`")
    inside = column.isNotNull()
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        if span.first is not None:
            inside &= column >= F.lit(f"{span.first:04d}-01-01").cast(kind)
        if span.last is not None:
            inside &= column < F.lit(f"{span.last + 1:04d}-01-01").cast(kind)
    elif isinstance(kind, T.NumericType):
        if span.first is not None:
            inside &= column >= span.first
        if span.last is not None:
            inside &= column <= span.last
    else:
        raise TypeError(f"{name} is {kind.simpleString()}; parse it to a time or a year first")
    return inside


def year_column(df: DataFrame, name: str) -> Column:
    """The year of column ``name``, whether it holds times or years."""
    column = F.col(f"`{name}`")
    return column if isinstance(df.schema[name].dataType, T.NumericType) else F.year(column)


def differs(column: Column, value: object) -> Column:
    """Not equal, where a null counts as different."""
    return ~column.eqNullSafe(F.lit(value))


def not_listed(column: Column, values: Iterable[object]) -> Column:
    """Not one of ``values``, where a null counts as not listed."""
    return ~F.coalesce(column.isin(list(values)), F.lit(False))


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without any null."""
    return df.na.drop("any")


# Key texts that stand for "no address".
NO_KEY = ["0", ""]


def has_key(df: DataFrame, key: str) -> Column:
    """Can the row be matched by ``key``? Nulls never are, nor are the no-address texts."""
    column = F.col(f"`{key}`")
    usable = column.isNotNull()
    if isinstance(df.schema[key].dataType, T.StringType):
        usable &= not_listed(column, NO_KEY)
    return usable
