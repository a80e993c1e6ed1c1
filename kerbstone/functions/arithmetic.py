"""Year arithmetic and row totals."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def age(built_year: Column, ref_year: Column | int) -> Column:
    """Years from ``built_year`` to the reference year."""
    return _column(ref_year) - built_year


def recency(last_year: Column, ref_year: Column | int) -> Column:
    """Years since the latest event; also the running time of a permit."""
    return _column(ref_year) - last_year


def row_total(*columns: Column) -> Column:
    """Sum across the columns of one row, missing values counting as nothing."""
    return reduce(add, [F.coalesce(c, F.lit(0)) for c in columns])
