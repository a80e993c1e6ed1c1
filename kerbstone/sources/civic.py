"""The civic input tables: schemas, key columns and where they are found."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbstone.functions import lenient_timestamp, normalise_key, strict_timestamp
from kerbstone.operators.columns import rename
from kerbstone.sources.tables import read_csv, read_parquet

KEY = "ADDRESS"

# Columns of each table, in DDL form.
SCHEMAS = {
    "properties": "ADDRESS string, YEARBUILT string, LAT double, LON double",
    "code_cases": "Address string, Year int, `Code Case Type` string",
    "offenses": "Parcel_Address string, Offense string, Date string",
    "utility_disconnects": "Address string, Year int",
    "rentals": "Address string, `Permit Issue Date` string",
    "incidents": "Location string, Time string, Code int, Category string, Type string",
    "inspections": "Address string, `Scheduled Start Date` string, `Status Name` string",
    "parcels": (
        "ADDRESS string, ACTIVITY int, SQFT double, ACREAGE double, FRONTFOOT double, "
        "Shape_Length double, Shape_Area double, BuildVal double, LandVal double"
    ),
    "foreclosures": "ADDRESS string, YEAR int",
}

# The address column of each table, and its time column held as text.
KEY_COLUMNS = {
    "properties": "ADDRESS",
    "code_cases": "Address",
    "offenses": "Parcel_Address",
    "utility_disconnects": "Address",
    "rentals": "Address",
    "incidents": "Location",
    "inspections": "Address",
    "parcels": "ADDRESS",
    "foreclosures": "ADDRESS",
}
STRICT_TIMES = {"offenses": "Date", "incidents": "Time", "inspections": "Scheduled Start Date"}
LENIENT_TIMES = {"rentals": "Permit Issue Date"}

# Ways the time columns may be written, tried in order.
TIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "M/d/yyyy h:mm:ss a",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
)


def clean(table: str, df: DataFrame, formats: tuple[str, ...] = TIME_FORMATS) -> DataFrame:
    """Shared key name, normalised addresses, and times instead of text."""
    df = rename(df, {KEY_COLUMNS[table]: KEY})
    df = df.withColumn(KEY, normalise_key(F.col(KEY)))
    if table in STRICT_TIMES:
        name = STRICT_TIMES[table]
        df = df.withColumn(name, strict_timestamp(F.col(f"`{name}`"), *formats))
    if table in LENIENT_TIMES:
        name = LENIENT_TIMES[table]
        df = df.withColumn(name, lenient_timestamp(F.col(f"`{name}`"), *formats))
    return df


def read_civic(
    spark: SparkSession,
    folder: str,
    fmt: str = "csv",
    formats: tuple[str, ...] = TIME_FORMATS,
    only: Sequence[str] = tuple(SCHEMAS),
) -> dict[str, DataFrame]:
    """All nine tables, or ``only`` some, from ``folder/<table>.<fmt>``, cleaned.

    Properties and parcels also get ``_ord``, their place in the file, because
    the last row of an address counts there.
    """
    tables = {}
    for table in only:
        ddl = SCHEMAS[table]
        path = posixpath.join(folder, f"{table}.{fmt}")
        schema = T.StructType.fromDDL(ddl)
        # Further columns of the properties become features, with the types of their values; the
        # last row of an address counts among properties and parcels.
        others = table == "properties"
        order = "_ord" if table in ("properties", "parcels") else None
        if fmt == "csv":
            df = read_csv(spark, path, schema, others=others, order=order, infer=others)
        else:
            df = read_parquet(spark, path, schema, others=others, order=order)
        tables[table] = clean(table, df, formats)
    return tables
