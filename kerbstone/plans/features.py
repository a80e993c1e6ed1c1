"""One builder per source: events or attributes in, one row per property key out.

Builders take the window of years they may see, so the same function serves a
fixed feature window (``Span(2011, 2019)``) and an as-of year (``Span.up_to(y)``).
Each reduces its source in one aggregate on the key; results are joined to the
property table by :mod:`kerbstone.plans.snapshot`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbstone.functions import age, land_use_category, lenient_number, recency
from kerbstone.operators.aggregates import category_matrix
from kerbstone.operators.columns import drop_columns
from kerbstone.operators.dedup import keep_last
from kerbstone.operators.filters import Span, has_key, in_span, year_column

KEY = "ADDRESS"
REF_YEAR = 2023
FEATURE_SPAN = Span(2011, 2019)
LABEL_SPAN = Span(2020, 2021)

# Case types with a column of their own (one ends in a blank).
CASE_TYPES = (
    "Building Service",
    "Drainage",
    "Erosion and Sediment Control",
    "Fire",
    "Health Nuisance Complaints",
    "IMPORT / Tree Survey & Stump Removal",
    "Illicit Discharge",
    "Landfill",
    "Manufactured Housing",
    "Parks and Rec - Dead or Diseased Tree",
    "Parks and Rec - Tree Complaint",
    "Property Maintenance",
    "Rental Registration",
    "Right of Way ",
    "Sidewalks and Ramps",
    "Snow",
    "Special Assessment",
    "Vegetation",
    "Waste Water",
    "Water Purfication",
    "Zoning",
)

# Address columns without use as features.
UNUSED_ADDRESS_COLUMNS = (
    "STATE",
    "MUNICIPALITY",
    "X",
    "Y",
    "OBJECTID",
    "TAG",
    "ADDRESSNUM_SUF",
    "ALIAS",
    "ALIASPLUS",
    "PATH",
    "HYPERLINK",
    "DISPLAY",
    "HOUSENUM",
    "PR1",
    "STNM1",
    "TYP1",
    "PD1",
    "STREETVIEW",
    "EFFECTIVEDATE",
    "UNITTYPE",
    "POINTTYPE",
    "COUNTRY",
    "GlobalID",
    "PHOTOARCHIVELINK",
    "PHOTOACQUISITIONYEAR",
    "RETIREDATE",
    "ADDRCLASS",
)

# Foreclosure columns without use, the fire code, the ready status.
UNUSED_FORECLOSURE_COLUMNS = ("NAME", "AUCTIONDATE", "ASSESSEDVALUE")
FIRE_CODE = 111
READY_STATUS = "Ready Anytime"

PARCEL_MEASURES = (
    "SQFT",
    "ACREAGE",
    "FRONTFOOT",
    "Shape_Length",
    "Shape_Area",
    "BuildVal",
    "LandVal",
)


@dataclass(frozen=True)
class Events:
    """An event table and its columns: key, time or year, and kind (type, code, status)."""

    frame: DataFrame
    key: str = KEY
    when: str = "Year"
    kind: str | None = None

    def seen(self, span: Span) -> DataFrame:
        """The events of ``span`` with a usable key, as (ADDRESS, year, kind)."""
        return self._inside(span).select(*self._named())

    def distinct_seen(self, span: Span) -> DataFrame:
        """Like :meth:`seen`, equal (key, kind, time) rows counting once."""
        parts = [f"`{c}`" for c in (self.key, self.kind, self.when) if c]
        return self._inside(span).select(*parts).distinct().select(*self._named())

    def _inside(self, span: Span) -> DataFrame:
        return self.frame.filter(
            has_key(self.frame, self.key) & in_span(self.frame, self.when, span)
        )

    def _named(self) -> list[Column]:
        columns = [
            F.col(f"`{self.key}`").alias(KEY),
            year_column(self.frame, self.when).alias("year"),
        ]
        if self.kind:
            columns.append(F.col(f"`{self.kind}`").alias("kind"))
        return columns


def case_columns(types: Sequence[str] | Mapping[str, str]) -> dict[str, str]:
    """{value in the data: column name}; a plain list names the columns like the values."""
    return dict(types) if isinstance(types, Mapping) else {t: t for t in types}


def property_base(
    properties: DataFrame,
    order: Sequence[str],
    key: str = KEY,
    built: str = "YEARBUILT",
    ref_year: int = REF_YEAR,
    built_by: int | None = None,
) -> DataFrame:
    """One row per property with its ``Age`` in ``ref_year``; later rows replace earlier ones.

    With ``built_by`` properties of unknown or later year are left out first.
    The columns of ``order`` are not passed on.
    """
    df = built_properties(properties, built, built_by)
    last = keep_last(df, key, order)
    passed_on = [c for c in last.columns if c not in (key, built, *order)]
    return last.select(
        F.col(f"`{key}`").alias(KEY),
        age(F.col(built), ref_year).alias("Age"),
        *[F.col(f"`{c}`") for c in passed_on],
    )


def built_properties(properties: DataFrame, built: str, built_by: int | None) -> DataFrame:
    """Properties without the unused columns, their building year as a number."""
    unused = [c for c in UNUSED_ADDRESS_COLUMNS if c in properties.columns]
    df = drop_columns(properties, unused).withColumn(built, lenient_number(F.col(built)))
    return df if built_by is None else df.filter(F.col(built) <= built_by)


def code_cases(
    cases: Events, span: Span = FEATURE_SPAN, types: Sequence[str] | Mapping[str, str] = CASE_TYPES
) -> DataFrame:
    """A count per listed case type, the count of all cases, and a marker."""
    return category_matrix(
        cases.seen(span),
        KEY,
        "kind",
        case_columns(types),
        total="TOTAL_VIOLATIONS",
        any_flag="ANY_VIOLATIONS",
    )


def crimes(offenses: Events, span: Span = FEATURE_SPAN, name: str = "CRIME_INCIDENTS") -> DataFrame:
    """Different (offense, date) pairs, and a marker."""
    once = offenses.distinct_seen(span)
    return once.groupBy(KEY).agg(F.count("kind").alias(name)).withColumn("ANY_CRIME", F.lit(1))


def utility_disconnects(
    disconnects: Events, span: Span = FEATURE_SPAN, ref_year: int = REF_YEAR
) -> DataFrame:
    """Number of disconnects, years since the last one, and a marker."""
    return disconnects.seen(span).groupBy(KEY).agg(
        F.count("year").alias("Utility_discon_count"),
        recency(F.max("year"), ref_year).alias("Since_Last_disconnect"),
        F.lit(1).alias("Any_disconnects"),
    )


def last_permits(rentals: Events, span: Span = FEATURE_SPAN) -> DataFrame:
    """Latest permit year per key; registration and foreclosure both start from it."""
    return rentals.seen(span).groupBy(KEY).agg(F.max("year").alias("last_permit"))


def rental_registration(
    rentals: Events, span: Span = FEATURE_SPAN, ref_year: int | None = None
) -> DataFrame:
    """Registered, and for a given ``ref_year`` the years since the latest permit."""
    permits = last_permits(rentals, span)
    columns = [F.lit(1).alias("Rent_Reg")]
    if ref_year is not None:
        columns.append(recency(F.col("last_permit"), ref_year).alias("Permit Duration"))
    return permits.select(KEY, *columns)


def fire_label(incidents: Events, span: Span = LABEL_SPAN, code: object = FIRE_CODE) -> DataFrame:
    """Keys with an incident of the given code. Its year is not passed on: it would
    tell the label."""
    fires = incidents.seen(span).filter(F.col("kind") == code)
    return fires.select(KEY).distinct().withColumn("Incident", F.lit(1))


def inspections(
    visits: Events, span: Span = FEATURE_SPAN, ready: str = READY_STATUS
) -> DataFrame:
    """Ready at any time, and inspections counted.

    Keys seen both ways count as not ready, with the number of those visits.
    """
    is_ready = F.col("kind").eqNullSafe(F.lit(ready))
    both = visits.seen(span).groupBy(KEY).agg(
        F.count_if(is_ready).alias("n_ready"), F.count_if(~is_ready).alias("n_not_ready")
    )
    only_ready = F.col("n_not_ready") == 0
    return both.select(
        KEY,
        only_ready.cast("int").alias("ready_anytime"),
        F.when(only_ready, F.col("n_ready"))
        .otherwise(F.col("n_not_ready"))
        .alias("Inspections_Count"),
    )


def parcels(
    attributes: DataFrame,
    order: Sequence[str],
    key: str = KEY,
    activity: str = "ACTIVITY",
    measures: Sequence[str] = PARCEL_MEASURES,
) -> DataFrame:
    """Size, value and land-use category of each parcel; later rows replace earlier ones.

    The category is looked up after the reduction, while the code is a number.
    """
    known = attributes.filter(has_key(attributes, key))
    last = keep_last(known.select(key, activity, *measures, *order), key, order)
    return last.select(
        F.col(f"`{key}`").alias(KEY),
        land_use_category(F.col(activity)).alias("ACTIVITY"),
        *measures,
    )


def first_foreclosures(filings: Events, span: Span = FEATURE_SPAN) -> DataFrame:
    """Earliest foreclosure year per key."""
    return filings.seen(span).groupBy(KEY).agg(F.min("year").alias("first_foreclosed"))


def foreclosed(filings: Events, rentals: Events, span: Span = FEATURE_SPAN) -> DataFrame:
    """Keys with a foreclosure and no rental permit later than it.

    Any permit after any foreclosure clears the key; the earliest foreclosure
    and the latest permit decide that, so both sides join one row per key.
    """
    return (
        first_foreclosures(filings, span)
        .join(last_permits(rentals, span), KEY, "left")
        .filter(~still_cleared(F.col("first_foreclosed"), F.col("last_permit")))
        .select(KEY, F.lit(1).alias("foreclosed"))
    )


def still_cleared(first_foreclosed: Column, last_permit: Column) -> Column:
    """Was the property let again after a foreclosure?"""
    return F.coalesce(last_permit > first_foreclosed, F.lit(False))
