"""From feature table to feature vector."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.ml.base import Estimator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbstone.operators.ranking import in_ranges
from kerbstone.session import scratch_path, settle

FEATURES = "features"
_HOT = "__hot"


@dataclass(frozen=True)
class Inputs:
    """Which columns feed the model."""

    numbers: tuple[str, ...]
    texts: tuple[str, ...] = ()
    # The vector is in the table already, see :func:`vectors`.
    ready: bool = False

    @classmethod
    def of(cls, df: DataFrame, without: Sequence[str]) -> Inputs:
        """All numeric and text columns but the named ones (label, key, coordinates, …)."""
        fields = [f for f in df.schema if f.name not in without]
        return cls(
            tuple(f.name for f in fields if isinstance(f.dataType, T.NumericType)),
            tuple(f.name for f in fields if isinstance(f.dataType, T.StringType)),
        )


def one_hot_columns(df: DataFrame, values: Mapping[str, Sequence[str]]) -> DataFrame:
    """Replace text columns by 0/1 columns ``<column>_<value>``; a null is 0 in all of them."""
    hot = [
        F.coalesce((F.col(f"`{c}`") == v).cast("int"), F.lit(0)).alias(f"{c}_{v}")
        for c, listed in values.items()
        for v in listed
    ]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in values]
    return df.select(*rest, *hot)


def fill_for_trees(df: DataFrame, inputs: Inputs, fill: float = 0.0) -> tuple[DataFrame, Inputs]:
    """Numbers without nulls: a constant instead, and ``<column>_missing`` to tell.

    Only columns that hold nulls in ``df`` get a marker; one aggregate finds out, since
    files call every column nullable.
    """
    counts = df.agg(
        *[F.count_if(F.col(f"`{n}`").isNull()).alias(n) for n in inputs.numbers], F.lit(0).alias("")
    ).first()
    gaps = [n for n in inputs.numbers if counts[n]]
    marked = df.withColumns({f"{n}_missing": F.col(f"`{n}`").isNull().cast("int") for n in gaps})
    filled = marked.withColumns(
        {n: F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(fill)) for n in inputs.numbers}
    )
    return filled, Inputs((*inputs.numbers, *(f"{n}_missing" for n in gaps)), inputs.texts)


def stages(inputs: Inputs) -> list[Estimator | Transformer]:
    """Index and one-hot the texts, and assemble the vector.

    A value not seen in training, or a null, sets no column: the indexer gives it
    the last index, which the encoder drops. The values of a text column are the model's
    columns, so they all go to the driver: for columns of many values use :func:`vectors` instead. A table whose
    vector is ready needs nothing here.
    """
    if inputs.ready:
        return []
    texts = list(inputs.texts)
    encoded: list[Estimator | Transformer] = []
    if texts:
        encoded.append(
            StringIndexer(
                inputCols=texts,
                outputCols=[f"{t}__index" for t in texts],
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            )
        )
        encoded.append(
            OneHotEncoder(
                inputCols=[f"{t}__index" for t in texts],
                outputCols=[f"{t}{_HOT}" for t in texts],
                dropLast=True,
                handleInvalid="error",
            )
        )
    vector = VectorAssembler(
        inputCols=[*inputs.numbers, *[f"{t}{_HOT}" for t in texts]], outputCol=FEATURES
    )
    return [*encoded, vector]


# --- columns of many values -----------------------------------------------------------------


@dataclass(frozen=True)
class Dictionary:
    """The values of a text column in ascending order, numbered from 0: a table, and how many."""

    column: str
    values: DataFrame
    size: int


def dictionary(df: DataFrame, column: str) -> Dictionary:
    """Number the values of a column without collecting them: they are counted in ranges of their order."""
    distinct = df.select(F.col(f"`{column}`").alias("value")).filter("value is not null").distinct()
    numbered = in_ranges(distinct, [F.col("value").asc()])
    table = settle(numbered.select("value", (F.col("_number") - 1).cast("int").alias("index")))
    return Dictionary(column, table, table.count())


def vectors(df: DataFrame, numbers: Sequence[str], dictionaries: Sequence[Dictionary]) -> DataFrame:
    """Add the feature vector: the numbers, then a place for each value of each dictionary.

    The places are those of :func:`stages`: a null or a value outside the dictionary sets none. Values meet
    their numbers in a join, where Spark broadcasts a small dictionary and splits a frequent value of a large one. Indices and
    numbers are laid out as the fields of a sparse vector, and read back as one: no label reaches the driver, and
    no Python runs. ``df`` is written to the shared folder.
    """
    size, joined, hot = len(numbers), df, []
    for i, d in enumerate(dictionaries):
        named = d.values.select(F.col("value").alias(f"_value_{i}"), F.col("index").alias(f"_index_{i}"))
        joined = joined.join(named, F.col(f"`{d.column}`") == F.col(f"_value_{i}"), "left")
        hot.append(F.col(f"_index_{i}") + F.lit(size))
        size += d.size
    places = F.array(*[F.lit(i) for i in range(len(numbers))], *hot)
    known = F.filter(places, lambda p: p.isNotNull())
    given = F.array(*[F.col(f"`{n}`").cast("double") for n in numbers])
    ones = F.array_repeat(F.lit(1.0), F.size(known) - F.lit(len(numbers)))
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).alias("size"),
        known.cast("array<int>").alias("indices"),
        (F.concat(given, ones) if numbers else ones).cast("array<double>").alias("values"),
    )
    path = scratch_path(df.sparkSession, "vectors")
    names = [F.col(f"`{c}`") for c in df.columns]
    joined.select(*names, vector.alias(FEATURES)).write.parquet(path)
    schema = T.StructType([*df.schema.fields, T.StructField(FEATURES, VectorUDT())])
    return df.sparkSession.read.schema(schema).parquet(path)


def place_names(spark: SparkSession, numbers: Sequence[str], dictionaries: Sequence[Dictionary]) -> DataFrame:
    """(position, name) of the places of :func:`vectors`, as a table."""
    named = spark.createDataFrame(list(enumerate(numbers)), "position int, name string")
    first = len(numbers)
    for d in dictionaries:
        places = (F.col("index") + F.lit(first)).cast("int").alias("position")
        named = named.unionByName(d.values.select(places, F.concat(F.lit(f"{d.column}_"), "value").alias("name")))
        first += d.size
    return named


def feature_names(df: DataFrame) -> list[str]:
    """Names of the vector's places, one-hot ones as ``<column>_<value>``."""
    attributes = df.schema[FEATURES].metadata["ml_attr"]["attrs"]
    places = sorted((a["idx"], a["name"]) for kind in attributes.values() for a in kind)
    return [name.replace(f"{_HOT}_", "_", 1) for _, name in places]
