"""The as-of panel: every property once per as-of year, with what was known by then.

Each source is read once. An aggregate on the key computes the measure of all
as-of years side by side (``count_if(year <= 2011)``, ``count_if(year <= 2012)``, …)
and packs them into one array, so a property stays a single row through all
joins. Only the finished rows are unfolded to one per year, which needs no
shuffle: the panel, the largest table here, never travels.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbstone.functions import lenient_number
from kerbstone.operators.filters import Span
from kerbstone.operators.joins import attach
from kerbstone.plans import features as fb
from kerbstone.plans.snapshot import Sources, addressed

YEARS = range(2011, 2022)

# Columns for cases of a type outside the list, and for cases without type.
OTHER, UNTYPED = "other_cases", "untyped_cases"

COUNT = "count_if(year <= {y})"
LATEST = "max(if(year <= {y}, year, null))"


def _per_year(measures: Mapping[str, str], years: Sequence[int]) -> list[Column]:
    """The SQL measures for every year ``{y}``: columns ``<name>_<year>``."""
    return [F.expr(sql.format(y=y)).alias(f"{n}_{y}") for n, sql in measures.items() for y in years]


def _packed(name: str, years: Sequence[int]) -> Column:
    """The columns of one measure as an array, in year order."""
    columns = ", ".join(f"`{name}_{y}`" for y in years)
    return F.expr(f"array({columns})").alias(name)


def _panel_of(df: DataFrame, years: Sequence[int], measures: Mapping[str, str]) -> DataFrame:
    wide = df.groupBy(fb.KEY).agg(*_per_year(measures, years))
    return wide.select(fb.KEY, *[_packed(name, years) for name in measures])


# Properties with a key, and the last row of each as of every year, in a struct.
LAST = "last"


def panel_base(sources: Sources, years: Sequence[int], built: str = "YEARBUILT") -> DataFrame:
    """(ADDRESS, last[]): for each year the last row of those built by then, as a struct.

    Properties without address are not among them, here as in the feature table.
    """
    df = addressed(sources.properties).withColumn(built, lenient_number(F.col(built)))
    unused = {fb.KEY, *sources.property_order, *fb.UNUSED_ADDRESS_COLUMNS}
    row = "struct(" + ", ".join(f"`{c}`" for c in df.columns if c not in unused) + ")"
    place = "struct(" + ", ".join(f"`{c}`" for c in sources.property_order) + ")"
    last = {LAST: f"max_by({row}, if(`{built}` <= {{y}}, {place}, null))"}
    return _panel_of(df.filter(F.col(built) <= max(years)), years, last)


def panel_code_cases(sources: Sources, years: Sequence[int]) -> DataFrame:
    """(ADDRESS, <type>[], …, other_cases[], untyped_cases[]), null where a key has none.

    Counted per key and type first, types outside the list as one: that bounds
    what is gathered per key by the length of the list.
    """
    kind = F.col("kind")
    names = [*fb.case_columns(sources.case_types).values(), OTHER, UNTYPED]
    slot = F
    for number, value in enumerate(fb.case_columns(sources.case_types)):
        slot = slot.when(kind == value, number)
    slot = slot.when(kind.isNotNull(), names.index(OTHER)).otherwise(names.index(UNTYPED))

    seen = sources.code_cases.seen(Span.up_to(max(years)))
    counts = (
        seen.select(fb.KEY, "year", slot.alias("slot"))
        .groupBy(fb.KEY, "slot")
        .agg(*_per_year({"n": COUNT}, years))
    )
    entries = counts.select(fb.KEY, F.struct("slot", _packed("n", years)).alias("entry"))
    cases = entries.groupBy(fb.KEY).agg(F.map_from_entries(F.collect_list("entry")).alias("cases"))
    return cases.select(
        fb.KEY,
        *[F.expr(f"try_element_at(cases, {i})").alias(name) for i, name in enumerate(names)],
    )


def panel_crimes(sources: Sources, years: Sequence[int]) -> DataFrame:
    once = sources.offenses.distinct_seen(Span.up_to(max(years)))
    named = "count_if(year <= {y} and kind is not null)"
    return _panel_of(once, years, {"CRIME_INCIDENT": named, "ANY_CRIME": COUNT})


def panel_utility(sources: Sources, years: Sequence[int]) -> DataFrame:
    seen = sources.utility_disconnects.seen(Span.up_to(max(years)))
    return _panel_of(seen, years, {"Utility_discon_count": COUNT, "last_disconnect": LATEST})


def panel_permits(sources: Sources, years: Sequence[int]) -> DataFrame:
    return _panel_of(sources.rentals.seen(Span.up_to(max(years))), years, {"last_permit": LATEST})


def panel_labels(
    sources: Sources, years: Sequence[int], horizon: int = 4, offset: int = 0
) -> DataFrame:
    window = Span(min(years) + offset, max(years) + horizon)
    fires = sources.incidents.seen(window).filter(F.col("kind") == sources.fire_code)
    hit = f"max(int(year between {{y}} + {offset} and {{y}} + {horizon}))"
    return _panel_of(fires, years, {"Incident": hit})


def panel_inspections(sources: Sources, years: Sequence[int]) -> DataFrame:
    """Ready only if every visit so far found it so, hence the smallest of the 0/1 marks."""
    ready = F.col("kind").eqNullSafe(F.lit(sources.ready_status)).cast("int").alias("ready")
    seen = sources.inspections.seen(Span.up_to(max(years))).select(fb.KEY, "year", ready)
    return _panel_of(seen, years, {"ready_anytime": "min(if(year <= {y}, ready, null))"})


def panel_foreclosures(sources: Sources, years: Sequence[int]) -> DataFrame:
    seen = sources.foreclosures.seen(Span.up_to(max(years)))
    return seen.groupBy(fb.KEY).agg(F.min("year").alias("first_foreclosed"))


def as_of_panel(
    sources: Sources,
    years: Sequence[int] = YEARS,
    horizon: int = 4,
    label_start_offset: int = 0,
    built: str = "YEARBUILT",
    observed_until: int | None = None,
) -> DataFrame:
    """One row per (property with an address, as-of year) with features known by that year.

    ``Incident`` looks at ``[year + label_start_offset, year + horizon]``. ``observed_until`` is
    the last year the incidents cover whole (:func:`last_whole_year` finds it);
    ``label_complete`` tells whether a label's years end by then, null without it.
    """
    years = sorted(years)
    s = sources
    base = panel_base(s, years, built)
    carried = [c for c in base.schema[LAST].dataType.elementType.names if c != built]
    wide = base
    for part in (
        panel_code_cases(s, years),
        panel_crimes(s, years),
        panel_utility(s, years),
        panel_permits(s, years),
        panel_labels(s, years, horizon, label_start_offset),
        panel_inspections(s, years),
        fb.parcels(s.parcels, s.parcel_order, measures=s.parcel_measures),
        panel_foreclosures(s, years),
    ):
        wide = attach(wide, part, fb.KEY)

    listed_years = ", ".join(map(str, years))
    unfolded = wide.select("*", F.expr(f"posexplode(array({listed_years})) as (_place, as_of)"))
    known = unfolded.filter(F.expr(f"get({LAST}, _place) is not null"))

    def count(array: str, since: int | None = None) -> str:
        """The year's entry of an array; 0 without one, and before the source has data."""
        entry = f"coalesce(get(`{array}`, _place), 0)"
        return entry if since is None else f"if(as_of >= {since}, {entry}, 0)"

    types = list(fb.case_columns(s.case_types).values())
    violations = " + ".join(count(name, s.cases_from) for name in [*types, OTHER])
    permit = "get(last_permit, _place)"
    reopened = f"coalesce({permit} > first_foreclosed, false)"
    columns = {
        "Age": f"as_of - get({LAST}, _place).`{built}`",
        **{c: f"get({LAST}, _place).`{c}`" for c in carried},
        **{name: count(name, s.cases_from) for name in types},
        "TOTAL_VIOLATIONS": violations,
        "ANY_VIOLATIONS": f"int({violations} + {count(UNTYPED, s.cases_from)} > 0)",
        "CRIME_INCIDENT": count("CRIME_INCIDENT", s.offenses_from),
        "ANY_CRIME": f"int({count('ANY_CRIME', s.offenses_from)} > 0)",
        "Utility_discon_count": count("Utility_discon_count"),
        "Since_Last_disconnect": "coalesce(as_of - get(last_disconnect, _place), 0)",
        "Any_disconnects": f"int({count('Utility_discon_count')} > 0)",
        "Permit Duration": f"as_of - {permit}",
        "Rent_Reg": f"int({permit} is not null)",
        "Incident": count("Incident"),
        "ready_anytime": count("ready_anytime", s.inspections_from),
        "ACTIVITY": "coalesce(ACTIVITY, '0')",
        **{m: f"coalesce(`{m}`, 0.0D)" for m in s.parcel_measures},
        "foreclosed": f"int(coalesce(first_foreclosed <= as_of and not {reopened}, false))",
    }
    complete = F.col("as_of") + horizon <= F.lit(observed_until).cast("int")
    return known.select(
        fb.KEY,
        "as_of",
        *[F.expr(sql).alias(name) for name, sql in columns.items()],
        complete.cast("int").alias("label_complete"),
    )


def last_whole_year(events: fb.Events) -> int | None:
    """The last year the events may cover whole: that of the last event if it is on the last day of
    its year, else the one before. For events with only a year it is the year before the last.

    One number, from one pass over the time column.
    """
    when = F.col(f"`{events.when}`")
    if isinstance(events.frame.schema[events.when].dataType, T.NumericType):
        return events.frame.agg((F.max(when) - 1).alias("y")).first()["y"]
    return events.frame.agg((F.year(F.date_add(F.max(when), 1)) - 1).alias("y")).first()["y"]
