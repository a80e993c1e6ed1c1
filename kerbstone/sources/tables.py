"""Table files in and out."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Quotes inside quoted fields are doubled, as spreadsheets and most exports write them.
_QUOTING = {"quote": '"', "escape": '"'}


# As a share of a task, every file counts as this many bytes: so each is a task of its own.
_FILE_COST = 1 << 40


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first line of a file that isn't blank. What follows is not asked for, so not read."""
    for batch in batches:
        lines = pc.utf8_trim_whitespace(batch.column("value"))
        filled = pc.index_in(pa.scalar(True), pc.greater(pc.utf8_length(lines), 0)).as_py()
        if filled is not None:
            yield batch.slice(filled, 1)
            return


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files under ``path`` by their column names.

    One job with a small task per file, which takes the first lines of it; files come back grouped by header
    line. Settings for this job are those of a session of its own.
    """
    session = spark.newSession()
    for name, value in (
        ("spark.sql.files.openCostInBytes", _FILE_COST),
        ("spark.sql.files.maxPartitionBytes", _FILE_COST),
        ("spark.sql.execution.arrow.maxRecordsPerBatch", 64),
    ):
        session.conf.set(name, str(value))
    lines = session.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    first = lines.mapInArrow(_first_lines, "value string, file string")
    grouped = first.groupBy("value").agg(F.sort_array(F.collect_list("file")).alias("files"))
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in grouped.orderBy(F.col("files")[0]).collect():
        names = tuple(next(csv.reader([row["value"].lstrip("\ufeff").strip()])))
        groups.setdefault(names, []).extend(row["files"])
    return groups


# Words that stand for a missing value in a file.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
_WHOLE = r"^[+-]?[0-9]+$"
_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_TRUTHS = ("True", "TRUE", "true", "False", "FALSE", "false")
# What a value can be, as bits that add up over a column.
_BOOLEAN, _LONG, _DOUBLE, _TEXT = 1, 2, 4, 8


def _given(column: Column) -> Column:
    """The text without blanks around it, null if it stands for a missing value."""
    bare = F.btrim(column)
    return F.when(~bare.isin(*MISSING), bare)


def _kind(column: Column) -> Column:
    text = _given(column)
    return (
        F.when(text.isNull(), 0)
        .when(text.isin(*_TRUTHS), _BOOLEAN)
        .when(text.rlike(_WHOLE) & text.try_cast("long").isNotNull(), _LONG)
        .when(text.rlike(_DECIMAL), _DOUBLE)
        .otherwise(_TEXT)
    )


def narrowest_types(df: DataFrame, names: Sequence[str]) -> dict[str, T.DataType]:
    """For each text column the narrowest type that all its values parse as.

    One pass with one small number per column and task: the union of the kinds seen. Whole numbers are long, those
    too long for it and decimals double, ``true`` and ``false`` boolean; what is mixed otherwise
    stays text, and a column without any value is double.
    """
    if not names:
        return {}
    seen = df.agg(*[F.bit_or(_kind(F.col(f"`{n}`"))).alias(f"k{i}") for i, n in enumerate(names)]).first()

    def narrowest(kinds: int | None) -> T.DataType:
        if kinds == _BOOLEAN:
            return T.BooleanType()
        if kinds == _LONG:
            return T.LongType()
        return T.DoubleType() if not (kinds or 0) & (_BOOLEAN | _TEXT) else T.StringType()

    return {n: narrowest(kinds) for n, kinds in zip(names, seen, strict=True)}


def typed(column: Column, kind: T.DataType) -> Column:
    """A text column as ``kind``; texts stay as they are, but for words that mean a missing value."""
    if isinstance(kind, T.StringType):
        return F.when(~F.btrim(column).isin(*MISSING), column)
    return _given(column).try_cast(kind)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    others: bool = False,
    multi_line: bool = False,
    order: str | None = None,
    infer: bool = False,
) -> DataFrame:
    """CSV with header lines, one line each.

    Columns are matched to ``schema`` by the header of each file, whatever their order;
    ``others`` keeps the columns outside the schema, null in files without them: as text, or with
    ``infer`` as the narrowest type of all their values in all files, for which these columns are read once more.
    Without a schema all columns are kept and typed so. Unreadable fields become null. ``multi_line`` allows line
    breaks inside quotes; a file is then read by one task, so it is off unless asked for. ``order`` adds a
    column as :func:`with_file_order` does.
    """
    if schema is None:
        schema, others, infer = T.StructType(), True, True
    types = {f.name: f for f in schema}
    parts = []
    headers = _headers(spark, path)
    for header, files in headers.items():
        absent = [n for n in types if n not in header]
        if absent:
            raise ValueError(f"{files[0]} lacks {absent}")
        full = T.StructType([types.get(n, T.StructField(n, T.StringType())) for n in header])
        reader = spark.read.schema(full).options(
            header=True, mode="PERMISSIVE", multiLine=multi_line, **_QUOTING
        )
        # Most often all files are alike: then the folder stands for them.
        part = reader.csv(files if len(headers) > 1 else path)
        kept = list(header) if others else list(types)
        if order:
            part, kept = with_file_order(part, order), [*kept, order]
        parts.append(part.select(*[F.col(f"`{n}`") for n in kept]))
    if not parts:
        raise ValueError(f"{path} holds no header line")
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if not infer:
        return table
    kinds = narrowest_types(table, [n for n in table.columns if n not in types and n != order])
    return table.select(
        *[typed(F.col(f"`{n}`"), kinds[n]).alias(n) if n in kinds else F.col(f"`{n}`") for n in table.columns]
    )


def read_parquet(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    others: bool = True,
    order: str | None = None,
) -> DataFrame:
    """Parquet as it is, or with the columns of ``schema`` checked and cast to its types.

    ``others`` keeps the columns outside the schema; ``order`` as in :func:`read_csv`.
    """
    table = spark.read.parquet(path)
    types = {f.name: f.dataType for f in schema or ()}
    absent = [n for n in types if n not in table.columns]
    if absent:
        raise ValueError(f"{path} lacks {absent}")
    kept = table.columns if others else list(types)
    columns = [
        F.col(f"`{n}`").cast(types[n]).alias(n) if n in types else F.col(f"`{n}`") for n in kept
    ]
    if order:
        table, columns = with_file_order(table, order), [*columns, F.col(order)]
    return table.select(*columns)


def with_file_order(df: DataFrame, name: str = "_ord") -> DataFrame:
    """Add the place of each row in its files; call it right on what a reader returned.

    File, then start of the file block, then row inside the task: the order
    stays that of the files however Spark packs the blocks into tasks.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.withColumn(name, place)


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()
) -> None:
    """Write a table, replacing what was there. No row numbers are added.

    ``partition_by`` names columns of few values that later reads filter on.
    """
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if fmt == "csv":
        writer.options(
            header=True,
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
            **_QUOTING,
        ).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format: {fmt}")
