"""One row per key."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T


def count_per_key(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """How many non-null values of ``column`` each key has."""
    return df.groupBy(key).agg(F.count(f"`{column}`").alias(name))


def count_and_last(df: DataFrame, key: str, year: str, count: str, last: str) -> DataFrame:
    """Number of events and latest year of each key, in one aggregate."""
    return df.groupBy(key).agg(F.count(year).alias(count), F.max(year).alias(last))


def sum_per_key(df: DataFrame, key: str) -> DataFrame:
    """Sum of every numeric column of each key; other columns are left out."""
    numbers = [
        f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != key
    ]
    return df.groupBy(key).agg(*[F.sum(f"`{n}`").alias(n) for n in numbers])


def category_counts(kind: Column, categories: Mapping[str, str]) -> list[Column]:
    """One conditional count per listed category: {value in the data: column name}.

    The list is given, so the columns are the same whatever the data holds; a
    category nobody has counts 0.
    """
    return [F.count_if(kind == value).alias(name) for value, name in categories.items()]


def category_matrix(
    df: DataFrame,
    key: str,
    kind: str,
    categories: Mapping[str, str],
    total: str | None = None,
    any_flag: str | None = None,
) -> DataFrame:
    """Counts of the listed categories per key, the count over all categories, listed
    or not, and a marker for having any row at all."""
    column = F.col(f"`{kind}`")
    measures = category_counts(column, categories)
    if total:
        measures.append(F.count(column).alias(total))
    counted = df.groupBy(key).agg(*measures)
    return counted.withColumn(any_flag, F.lit(1)) if any_flag else counted


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """One row: rows without and with the label, and their ratio."""
    n0, n1 = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.agg(n0.alias("n0"), n1.alias("n1")).withColumn(
        "ratio", F.try_divide(F.col("n0"), F.col("n1"))
    )


def last_incident(
    incidents: DataFrame, key: str, year: str, ref_year: int, history: Column, window: Column
) -> DataFrame:
    """Keys with an incident in ``window``, their count there, and the years since the
    latest one in ``history``; keys without history are left out."""
    seen = incidents.groupBy(key).agg(
        F.count(F.when(window, F.col(year))).alias("incident_count"),
        (F.lit(ref_year) - F.max(F.when(history, F.col(year)))).alias("Last_Incident"),
    )
    return seen.filter((F.col("incident_count") > 0) & F.col("Last_Incident").isNotNull())


class RowTrace:
    """Row and column counts after named steps, taken while the steps run.

    ``mark`` adds an observation to the plan and no job. After an action has
    read the whole table, ``rows`` has the numbers.
    """

    def __init__(self) -> None:
        self._steps: list[tuple[str, int, Observation]] = []

    def mark(self, df: DataFrame, step: str) -> DataFrame:
        seen = Observation(step)
        width = sum(not c.startswith("_") for c in df.columns)  # helpers don't count
        self._steps.append((step, width, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def rows(self) -> list[tuple[str, int, int]]:
        return [(step, seen.get["rows"], width) for step, width, seen in self._steps]

