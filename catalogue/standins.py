"""The driver tables in the roles of the civic ones.

Customers are the properties. Orders give code cases, utility disconnects,
rentals, foreclosures and incidents; click events the offenses; order lines
the inspections; parts the parcels. No table has coordinates or building years, so
both are worked out from the key, here and in :mod:`catalogue.oracles` alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbstone.operators.filters import Span
from kerbstone.plans.features import KEY, Events
from kerbstone.plans.snapshot import Sources

FEATURES = Span(1995, 1998)
LABELS = Span(1999, 2000)
REF_YEAR = 2001
YEARS = range(1995, 2002)
HORIZON = 2
# Orders end in August 2001.
OBSERVED_UNTIL = 2000
URGENT = "1-URGENT"
# The last one occurs nowhere, and one priority of the data is not listed.
PRIORITIES = {
    URGENT: "n_urgent",
    "2-HIGH": "n_high",
    "3-MEDIUM": "n_medium",
    "5-LOW": "n_low",
    "9-NEVER": "n_never",
}
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lat_of(key: Column) -> Column:
    return (key * 37) % 17900 / 100 - 89.5


def lon_of(key: Column) -> Column:
    return (key * 91) % 35900 / 100 - 179.5


def score_of(key: Column) -> Column:
    """A made-up score from -0.1 to 1.1 in steps of 0.01."""
    return ((key * 13) % 121 - 10) / 100


def built_text(key: Column) -> Column:
    return F.when(key % 10 == 7, "n/a").otherwise((key % 17 + 1985).cast("string"))


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias(KEY),
        built_text(key).alias("YEARBUILT"),
        F.col("c_mktsegment").alias("SEGMENT"),
        lat_of(key).alias("LAT"),
        lon_of(key).alias("LON"),
        key.alias("_ord"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def order_events(rows: DataFrame) -> Events:
    return Events(rows, "o_custkey", "o_orderdate", "o_orderpriority")


def disconnects(rows: DataFrame) -> Events:
    return order_events(rows.filter("o_orderstatus = 'F'"))


def permits(rows: DataFrame) -> Events:
    return order_events(rows.filter("o_orderstatus = 'O'"))


def filings(rows: DataFrame) -> Events:
    return order_events(rows.filter("o_totalprice > 400000"))


def offense_events(spark: SparkSession, sf_dir: str) -> Events:
    seen = table(spark, sf_dir, "events").withColumn(
        "offense_year", (F.col("event_id") % 7 + 1995).cast("int")
    )
    return Events(seen, "user_id", "offense_year", "event_type")


def visits(spark: SparkSession, sf_dir: str) -> Events:
    lines = table(spark, sf_dir, "lineitem")
    return Events(lines, "l_orderkey", "l_shipdate", "l_returnflag")


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts share a parcel key; the later one counts."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.floor(F.col("p_partkey") / 2).alias(KEY),
        F.col("p_size").alias("ACTIVITY"),
        F.col("p_retailprice").alias("BuildVal"),
        F.col("p_partkey").alias("_ord"),
    )


def sources(spark: SparkSession, sf_dir: str) -> Sources:
    rows = orders(spark, sf_dir)
    return Sources(
        properties=properties(spark, sf_dir),
        code_cases=order_events(rows),
        offenses=offense_events(spark, sf_dir),
        utility_disconnects=disconnects(rows),
        rentals=permits(rows),
        incidents=order_events(rows),
        inspections=visits(spark, sf_dir),
        parcels=lots(spark, sf_dir),
        foreclosures=filings(rows),
        parcel_measures=("BuildVal",),
        case_types=PRIORITIES,
        fire_code=URGENT,
        ready_status="R",
        cases_from=1996,
        offenses_from=1997,
        inspections_from=1996,
    )


def snake(df: DataFrame) -> DataFrame:
    """Lower-case column names without blanks."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
