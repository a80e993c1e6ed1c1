"""Stacking tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_by_name(*tables: DataFrame) -> DataFrame:
    """Rows of all tables, columns matched by name, absent ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
