"""The runs end to end: civic CSV files to features, and stand-in tables to models."""

import civic
import pytest
from conftest import SMALL, rows

from catalogue import standins
from kerbstone import jobs
from kerbstone.plans.panel import as_of_panel
from kerbstone.plans.snapshot import feature_table

QUICK = ["--rounds", "2", "--depth", "2"]


def run(job, source, out, *more):
    jobs.main([job, "--input", str(source), "--output", str(out), *more])


@pytest.fixture(scope="module")
def features(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("features") / "t")
    sources = standins.sources(spark, SMALL)
    feature_table(
        sources, standins.FEATURES, standins.LABELS, standins.REF_YEAR
    ).write.parquet(path)
    return path


def test_civic_files_to_features_and_panel(spark, tmp_path):
    (tmp_path / "in").mkdir()
    folder = civic.write(tmp_path / "in")
    run("features", folder, tmp_path)
    run("panel", folder, tmp_path)
    assert spark.read.parquet(str(tmp_path / "features")).count() == 4
    profiled = spark.read.parquet(str(tmp_path / "features_profile"))
    assert "Right of Way " in {r["column_name"] for r in profiled.collect()}
    steps = spark.read.parquet(str(tmp_path / "features_steps"))
    assert {r["step"] for r in steps.collect()} >= {"properties", "parcels", "foreclosures"}
    assert spark.read.parquet(str(tmp_path / "features_top_values")).count() > 0
    panel = spark.read.parquet(str(tmp_path / "panel"))
    assert panel.filter("as_of = 2021").count() == 3


def test_holdout_then_maps(spark, features, tmp_path):
    run("holdout", features, tmp_path, *QUICK)
    scored = spark.read.parquet(str(tmp_path / "scored_locations"))
    cells = spark.read.parquet(str(tmp_path / "confusion")).first()
    assert sum(cells) == scored.count() > 0
    assert spark.read.parquet(str(tmp_path / "fold_metrics")).count() == 6
    run("maps", tmp_path / "scored_locations", tmp_path)
    hits = rows(spark.read.parquet(str(tmp_path / "running_hits")))
    assert [r for r, _ in hits] == list(range(1, 21))
    assert all(a <= b for (_, a), (_, b) in zip(hits, hits[1:], strict=False))
    areas = spark.read.parquet(str(tmp_path / "areas"))
    assert {"geohash", "cluster"} <= set(areas.columns)


def test_crossval_scores_every_row(spark, features, tmp_path):
    run("crossval", features, tmp_path, *QUICK)
    scored = spark.read.parquet(str(tmp_path / "scored_locations"))
    assert scored.count() == spark.read.parquet(features).count()
    importances = spark.read.parquet(str(tmp_path / "importances"))
    assert importances.agg({"feature_importance": "sum"}).first()[0] == pytest.approx(1.0)


def test_rounds_on_the_panel(spark, tmp_path):
    panel = as_of_panel(standins.sources(spark, SMALL), [1997, 1998], horizon=2)
    for name in jobs.PANEL_LEFT_OUT:
        if name not in panel.columns:
            panel = panel.selectExpr("*", f"0.0D as `{name}`")
    panel.write.parquet(str(tmp_path / "panel"))
    run("rounds", tmp_path / "panel", tmp_path, *QUICK)
    errors = rows(spark.read.parquet(str(tmp_path / "round_errors")))
    assert errors and all(0 <= e <= 1 for _, e, _ in errors)
    accuracy = spark.read.parquet(str(tmp_path / "panel_accuracy")).first()
    last = [e for r, e, part in errors if part == "test"][-1]
    assert accuracy["error"] == pytest.approx(last)
