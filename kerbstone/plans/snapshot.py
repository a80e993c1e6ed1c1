"""The full feature table at one cutoff: one row per property."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbstone.functions import land_use_category
from kerbstone.operators.aggregates import RowTrace
from kerbstone.operators.columns import fill_missing
from kerbstone.operators.filters import Span, has_key
from kerbstone.operators.joins import attach, attach_events, events_with
from kerbstone.operators.sets import union_by_name
from kerbstone.plans import features as fb


@dataclass(frozen=True)
class Sources:
    """The nine input tables. ``*_order`` name the columns that tell later rows from
    earlier ones; ``*_from`` the first year a source has data for."""

    properties: DataFrame
    code_cases: fb.Events
    offenses: fb.Events
    utility_disconnects: fb.Events
    rentals: fb.Events
    incidents: fb.Events
    inspections: fb.Events
    parcels: DataFrame
    foreclosures: fb.Events
    property_order: Sequence[str] = ("_ord",)
    parcel_order: Sequence[str] = ("_ord",)
    parcel_measures: Sequence[str] = fb.PARCEL_MEASURES
    case_types: Sequence[str] | Mapping[str, str] = field(default=fb.CASE_TYPES)
    fire_code: object = fb.FIRE_CODE
    ready_status: str = fb.READY_STATUS
    cases_from: int = 2015
    offenses_from: int = 2017
    inspections_from: int = 2015

    @classmethod
    def civic(cls, tables: Mapping[str, DataFrame]) -> Sources:
        """From the tables of :func:`kerbstone.sources.civic.read_civic`."""
        return cls(
            properties=tables["properties"],
            code_cases=fb.Events(tables["code_cases"], kind="Code Case Type"),
            offenses=fb.Events(tables["offenses"], when="Date", kind="Offense"),
            utility_disconnects=fb.Events(tables["utility_disconnects"]),
            rentals=fb.Events(tables["rentals"], when="Permit Issue Date"),
            incidents=fb.Events(tables["incidents"], when="Time", kind="Code"),
            inspections=fb.Events(
                tables["inspections"], when="Scheduled Start Date", kind="Status Name"
            ),
            parcels=tables["parcels"],
            foreclosures=fb.Events(tables["foreclosures"], when="YEAR"),
        )


def fills(types: Sequence[str] | Mapping[str, str], measures: Sequence[str]) -> dict[str, object]:
    """What a property without rows in a source gets. ``Permit Duration`` stays missing."""
    zero = [
        *fb.case_columns(types).values(),
        "TOTAL_VIOLATIONS",
        "ANY_VIOLATIONS",
        "CRIME_INCIDENTS",
        "ANY_CRIME",
        "Utility_discon_count",
        "Since_Last_disconnect",
        "Any_disconnects",
        "Rent_Reg",
        "Incident",
        "ready_anytime",
        "Inspections_Count",
        "foreclosed",
    ]
    return {**dict.fromkeys(zero, 0), **dict.fromkeys(measures, 0.0), "ACTIVITY": "0"}


def feature_table(
    sources: Sources,
    span: Span = fb.FEATURE_SPAN,
    label_span: Span = fb.LABEL_SPAN,
    ref_year: int = fb.REF_YEAR,
    built_by: int | None = None,
    trace: RowTrace | None = None,
) -> DataFrame:
    """Properties with the features of ``span`` and the label of ``label_span``.

    Every right side is one aggregate on the key, so it leaves its shuffle
    placed by key; the joins then run side by side in one stage, or broadcast a
    side Spark finds small.
    """
    s = sources

    def step(df: DataFrame, name: str) -> DataFrame:
        return trace.mark(df, name) if trace else df

    df = step(
        fb.property_base(
            s.properties, s.property_order, ref_year=ref_year, built_by=built_by
        ),
        "properties",
    )
    parts = {
        "code_cases": fb.code_cases(s.code_cases, span, s.case_types),
        "offenses": fb.crimes(s.offenses, span),
        "utility_disconnects": fb.utility_disconnects(s.utility_disconnects, span, ref_year),
        "rentals": fb.last_permits(s.rentals, span).select(
            fb.KEY, F.lit(1).alias("Rent_Reg"), F.col("last_permit").alias("_last_permit")
        ),
        "incidents": fb.fire_label(s.incidents, label_span, s.fire_code),
        "inspections": fb.inspections(s.inspections, span, s.ready_status),
        "parcels": fb.parcels(s.parcels, s.parcel_order, measures=s.parcel_measures),
        "foreclosures": fb.first_foreclosures(s.foreclosures, span),
    }
    for name, part in parts.items():
        df = attach(df, part, fb.KEY)
        if name == "foreclosures":
            # The permits above also tell which foreclosures have been cleared since.
            first, permit = F.col("first_foreclosed"), F.col("_last_permit")
            closed = first.isNotNull() & ~fb.still_cleared(first, permit)
            df = df.withColumn("foreclosed", closed.cast("int"))
            df = df.drop("first_foreclosed", "_last_permit")
        df = step(df, name)
    return fill_missing(df, fills(s.case_types, s.parcel_measures))


def as_of_table(
    sources: Sources,
    as_of: int,
    horizon: int = 4,
    label_start_offset: int = 0,
    one_to_many: bool = False,
    built: str = "YEARBUILT",
) -> DataFrame:
    """The rows of one as-of year: what was known by then, labelled by what followed.

    For many years use :func:`kerbstone.plans.panel.as_of_panel`, which reads each
    source once. ``one_to_many`` keeps one row per combination of property row,
    permit, fire, inspection state and parcel row of an address, instead of one
    row per property; it is meant for comparisons, as it repeats properties.
    """
    s, known = sources, Span.up_to(as_of)
    label_span = Span.label(as_of, horizon, label_start_offset)
    nowhere = None
    if one_to_many:
        rows = (
            fb.built_properties(s.properties, built, as_of)
            .withColumn("Age", F.lit(as_of) - F.col(built))
            .drop(built, *s.property_order)
            .distinct()
        )
        # Rows without address match nothing, so they need not travel with the others.
        df, nowhere = rows.filter(F.col(fb.KEY).isNotNull()), rows.filter(F.col(fb.KEY).isNull())
    else:
        df = fb.property_base(
            s.properties, s.property_order, built=built, ref_year=as_of, built_by=as_of
        )
    parts = [fb.utility_disconnects(s.utility_disconnects, known, as_of)]
    if as_of >= s.cases_from:
        parts.append(fb.code_cases(s.code_cases, known, s.case_types))
    if as_of >= s.offenses_from:
        parts.append(fb.crimes(s.offenses, known, "CRIME_INCIDENT"))
    parts.append(fb.foreclosed(s.foreclosures, s.rentals, known))
    # With repeated properties an address may fill many rows of the left side.
    for part in parts:
        df = events_with(df, part, fb.KEY) if one_to_many else attach(df, part, fb.KEY)

    many = _rows_as_of if one_to_many else _single_as_of
    for part in many(s, as_of, known, label_span):
        df = (attach_events if one_to_many else attach)(df, part, fb.KEY)
    if nowhere is not None:
        df = union_by_name(df, nowhere)
    values = {
        ("CRIME_INCIDENT" if n == "CRIME_INCIDENTS" else n): v
        for n, v in fills(s.case_types, s.parcel_measures).items()
        if n != "Inspections_Count"
    }
    absent = {n: F.lit(v) for n, v in values.items() if n not in df.columns}
    return fill_missing(df.withColumns(absent) if absent else df, values)


def _single_as_of(s: Sources, as_of: int, known: Span, label_span: Span) -> list[DataFrame]:
    """Sources that may hold several rows per key, reduced to one."""
    parts = [
        fb.rental_registration(s.rentals, known, as_of),
        fb.fire_label(s.incidents, label_span, s.fire_code),
        fb.parcels(s.parcels, s.parcel_order, measures=s.parcel_measures),
    ]
    if as_of >= s.inspections_from:
        visits = fb.inspections(s.inspections, known, s.ready_status)
        parts.append(visits.drop("Inspections_Count"))
    return parts


def _rows_as_of(s: Sources, as_of: int, known: Span, label_span: Span) -> list[DataFrame]:
    """The same sources with all their rows."""
    permits = s.rentals.distinct_seen(known)
    fires = s.incidents.seen(label_span).filter(F.col("kind") == s.fire_code)
    lots = s.parcels.filter(has_key(s.parcels, fb.KEY)).drop(*s.parcel_order)
    parts = [
        permits.select(
            fb.KEY, F.lit(1).alias("Rent_Reg"), (as_of - F.col("year")).alias("Permit Duration")
        ),
        fires.select(fb.KEY, F.lit(1).alias("Incident")),
        lots.select(
            fb.KEY, land_use_category(F.col("ACTIVITY")).alias("ACTIVITY"), *s.parcel_measures
        ).distinct(),
    ]
    if as_of >= s.inspections_from:
        ready = F.col("kind").eqNullSafe(F.lit(s.ready_status)).cast("int")
        states = s.inspections.seen(known).select(fb.KEY, ready.alias("ready_anytime"))
        parts.append(states.distinct())
    return parts


def addressed(table: DataFrame) -> DataFrame:
    """Only properties that have an address."""
    return table.filter(F.col(fb.KEY).isNotNull())
