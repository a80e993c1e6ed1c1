import civic
import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from catalogue import standins
from kerbstone.operators.aggregates import RowTrace
from kerbstone.operators.filters import Span
from kerbstone.plans import features as fb
from kerbstone.plans.panel import as_of_panel, last_whole_year
from kerbstone.plans.snapshot import Sources, addressed, as_of_table, feature_table
from kerbstone.sources.civic import read_civic


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    folder = civic.write(tmp_path_factory.mktemp("civic"))
    return Sources.civic(read_civic(spark, folder))


@pytest.fixture(scope="module")
def table(sources):
    found = feature_table(sources).collect()
    assert len(found) == len({r["ADDRESS"] for r in found})
    return {r["ADDRESS"]: r.asDict() for r in found}


def test_one_row_per_address_the_last_one(table):
    assert set(table) == {"1MAINST", "2OAKAVE", "3ELM", "4PINE", None}
    assert table["1MAINST"]["Age"] == 73 and table["1MAINST"]["LAT"] == 43.6
    assert table["2OAKAVE"]["Age"] is None
    assert "STATE" not in table["3ELM"] and "_ord" not in table["3ELM"]


def test_rows_without_address_match_nothing(table, sources):
    unknown = {k: v for k, v in table[None].items() if k not in ("ADDRESS", "Age", "LAT", "LON")}
    assert set(unknown.values()) == {0, 0.0, "0"}
    assert addressed(feature_table(sources)).count() == 4


def test_code_cases(table):
    main = table["1MAINST"]
    assert (main["Zoning"], main["Snow"], main["Drainage"]) == (1, 1, 0)
    # The unlisted type counts as a violation; the row without type only as a case.
    assert (main["TOTAL_VIOLATIONS"], main["ANY_VIOLATIONS"]) == (3, 1)
    assert table["2OAKAVE"]["ANY_VIOLATIONS"] == 0
    assert table["4PINE"]["Right of Way "] == 1
    assert all(t in main for t in fb.CASE_TYPES) and len(fb.CASE_TYPES) == 21


def test_crimes_within_the_window_count_once(table):
    assert table["1MAINST"]["CRIME_INCIDENTS"] == 2
    assert table["2OAKAVE"]["CRIME_INCIDENTS"] == 1
    assert (table["3ELM"]["CRIME_INCIDENTS"], table["3ELM"]["ANY_CRIME"]) == (0, 0)


def test_utility(table):
    names = ("Utility_discon_count", "Since_Last_disconnect", "Any_disconnects")
    assert [table["1MAINST"][n] for n in names] == [2, 8, 1]
    assert [table["2OAKAVE"][n] for n in names] == [0, 0, 0]
    assert [table["3ELM"][n] for n in names] == [1, 4, 1]


def test_rental_label_and_inspections(table):
    assert {a: r["Rent_Reg"] for a, r in table.items()} == {
        "1MAINST": 1, "2OAKAVE": 0, "3ELM": 0, "4PINE": 1, None: 0,
    }
    assert {a for a, r in table.items() if r["Incident"]} == {"1MAINST"}
    states = {a: (r["ready_anytime"], r["Inspections_Count"]) for a, r in table.items()}
    assert states["1MAINST"] == (0, 2)
    assert states["2OAKAVE"] == (1, 2)
    assert states["3ELM"] == (0, 0)
    assert "Year" not in table["1MAINST"]


def test_parcels(table):
    assert (table["1MAINST"]["ACTIVITY"], table["1MAINST"]["SQFT"]) == ("AIRPORT", 100.5)
    assert (table["2OAKAVE"]["ACTIVITY"], table["2OAKAVE"]["ACREAGE"]) == ("39", 0.0)
    assert (table["3ELM"]["ACTIVITY"], table["3ELM"]["LandVal"]) == ("0", 0.0)


def test_foreclosed_unless_let_later(table):
    assert {a: r["foreclosed"] for a, r in table.items()} == {
        "1MAINST": 0,  # let in 2016, after the first foreclosure
        "2OAKAVE": 1,  # the permit date is unreadable
        "3ELM": 0,  # foreclosed after the window
        "4PINE": 1,  # let in the same year only
        None: 0,
    }


def test_trace_sees_every_step(sources):
    trace = RowTrace()
    feature_table(sources, trace=trace).write.format("noop").mode("overwrite").save()
    assert [(s, n) for s, n, _ in trace.rows()] == [
        (s, 5)
        for s in (
            "properties",
            "code_cases",
            "offenses",
            "utility_disconnects",
            "rentals",
            "incidents",
            "inspections",
            "parcels",
            "foreclosures",
        )
    ]


def test_panel_follows_the_years(sources):
    found = as_of_panel(sources, observed_until=last_whole_year(sources.incidents))
    panel = {(r["ADDRESS"], r["as_of"]): r.asDict() for r in found.collect()}
    addresses = {a for a, _ in panel}
    assert addresses == {"1MAINST", "3ELM", "4PINE"}
    assert {y for a, y in panel if a == "3ELM"} == set(range(2015, 2022))
    main = {y: panel["1MAINST", y] for y in range(2011, 2022)}
    assert main[2011]["Age"] == 61
    assert [main[y]["Zoning"] for y in (2014, 2015)] == [0, 2]
    assert [main[y]["CRIME_INCIDENT"] for y in (2017, 2018, 2020)] == [0, 2, 3]
    assert [main[y]["Permit Duration"] for y in (2012, 2013, 2016, 2017)] == [None, 0, 0, 1]
    assert [main[y]["Incident"] for y in (2015, 2016, 2021)] == [0, 1, 1]
    assert [main[y]["ready_anytime"] for y in (2014, 2015, 2016)] == [0, 1, 0]
    # Foreclosed in 2012, let again in 2013.
    assert [main[y]["foreclosed"] for y in (2011, 2012, 2013, 2018)] == [0, 1, 0, 0]
    assert [panel["4PINE", y]["Incident"] for y in (2011, 2015, 2016)] == [1, 1, 0]
    assert {y for y in range(2011, 2022) if main[y]["label_complete"]} == set(range(2011, 2018))


def test_panel_label_may_start_later(sources):
    panel = as_of_panel(sources, [2015], label_start_offset=1)
    assert panel.filter("ADDRESS = '4PINE'").first()["Incident"] == 0


def same(left, right):
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    quoted = [F.col(f"`{c}`") for c in columns]
    assert rows(left.select(*quoted)) == rows(right.select(*quoted))


@pytest.mark.parametrize("year", [2012, 2015, 2018, 2021])
def test_panel_equals_the_single_year_table(sources, year):
    panel = as_of_panel(sources).filter(F.col("as_of") == year).drop("as_of", "label_complete")
    same(panel, addressed(as_of_table(sources, year)))


@pytest.mark.parametrize("year", [1995, 1996, 1999])
def test_panel_equals_the_single_year_table_on_more_rows(spark, year):
    sources = standins.sources(spark, SMALL)
    panel = as_of_panel(sources, standins.YEARS, horizon=2).filter(F.col("as_of") == year)
    same(panel.drop("as_of", "label_complete"), as_of_table(sources, year, horizon=2))


def test_snapshot_and_as_of_table_agree_on_a_covered_year(spark):
    sources = standins.sources(spark, SMALL)
    single = feature_table(sources, Span.up_to(1998), Span.label(1998, 2), 1998, built_by=1998)
    single = single.withColumnRenamed("CRIME_INCIDENTS", "CRIME_INCIDENT")
    as_of = as_of_table(sources, 1998, horizon=2).drop("Permit Duration")
    same(single.drop("Inspections_Count"), as_of)


def test_one_to_many_repeats_properties(sources):
    many = as_of_table(sources, 2018, one_to_many=True)
    main = many.filter("ADDRESS = '1MAINST'")
    # 2 property rows x 2 permits x 2 fires x 2 inspection states x 2 parcel rows
    assert main.count() == 32
    assert sorted({r["Permit Duration"] for r in main.collect()}) == [2, 5]
    pine = many.filter("ADDRESS = '4PINE'").collect()
    assert len(pine) == 1 and pine[0]["Rent_Reg"] == 1


def test_joins_run_in_one_stage_without_moving_the_table_again(spark, no_broadcast):
    sources = standins.sources(spark, SMALL)
    plan = feature_table(sources)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    # One shuffle per source and one more: the offenses are made distinct first.
    assert plan.count("Exchange hashpartitioning") == 10
    assert plan.count("FileScan") == 9
    panel = as_of_panel(sources, standins.YEARS)._jdf.queryExecution().executedPlan().toString()
    assert panel.count("FileScan") == 9
    assert panel.count("max_by(struct(") == 2 * len(standins.YEARS)
    above = panel[: panel.index("Exchange hashpartitioning")]
    assert "explode" in above.lower()
