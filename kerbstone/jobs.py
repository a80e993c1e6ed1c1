"""The whole runs, from input tables to result tables.

    python -m kerbstone.jobs features  --input civic --output out
    python -m kerbstone.jobs panel     --input civic --output out
    python -m kerbstone.jobs holdout   --input out/features --output out
    python -m kerbstone.jobs crossval  --input out/features --output out
    python -m kerbstone.jobs rounds    --input out/panel --output out
    python -m kerbstone.jobs maps      --input out/scored_locations --output out

or with ``spark-submit``. Each result is a Parquet table (or a saved model) under
the output folder.
"""

from __future__ import annotations

import argparse
import posixpath
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbstone.ml import encode, evaluate, model, split
from kerbstone.operators import ranking
from kerbstone.operators.aggregates import RowTrace
from kerbstone.operators.profile import profile, top_values
from kerbstone.plans import features as fb
from kerbstone.plans import reports
from kerbstone.plans.panel import as_of_panel, last_whole_year
from kerbstone.plans.snapshot import Sources, addressed, feature_table
from kerbstone.session import remove_scratch, settle
from kerbstone.sources.civic import read_civic
from kerbstone.sources.tables import write_table

LABEL = "Incident"
COORDINATES = ("LAT", "LON")
# Panel columns the model does not see.
PANEL_LEFT_OUT = ("Shape_Length", "Shape_Area", "BuildVal", "Permit Duration")


@dataclass(frozen=True)
class Run:
    """Where a run reads and writes, and how it trains."""

    spark: SparkSession
    input: str
    output: str
    fmt: str = "csv"
    boosting: model.Boosting = model.Boosting()

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.input)

    def path(self, name: str) -> str:
        return posixpath.join(self.output, name)

    def write(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
        write_table(df, self.path(name), partition_by=partition_by)


def features(run: Run) -> None:
    """The feature table of the fixed window, the row counts of its steps, its column
    profile, and the most frequent values."""
    sources = Sources.civic(read_civic(run.spark, run.input, run.fmt))
    trace = RowTrace()
    run.write(addressed(feature_table(sources, trace=trace)), "features")
    steps = run.spark.createDataFrame(trace.rows(), "step string, rows long, columns int")
    run.write(steps, "features_steps")
    written = run.spark.read.parquet(run.path("features"))
    run.write(profile(written), "features_profile")
    run.write(top_values(written, written.columns), "features_top_values")


def panel(run: Run) -> None:
    """All as-of years, one folder per year."""
    sources = Sources.civic(read_civic(run.spark, run.input, run.fmt))
    until = last_whole_year(sources.incidents)
    run.write(as_of_panel(sources, observed_until=until), "panel", partition_by=["as_of"])


def _model_table(table: DataFrame, without: Sequence[str]) -> tuple[DataFrame, encode.Inputs]:
    """Rows with an id of their own and without nulls, and the columns the model sees."""
    inputs = encode.Inputs.of(table, without)
    return encode.fill_for_trees(table, inputs)


def _with_id(table: DataFrame, *parts: str) -> DataFrame:
    texts = [F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]
    return table.withColumn("_id", F.concat_ws("|", *texts))


def holdout(run: Run) -> None:
    """Cross-validate on two thirds, then train there and judge on the rest.

    Positive rows weigh as much as there are negative ones to each.
    """
    boosting = run.boosting.with_weight(None)
    table = _with_id(run.read(), fb.KEY)
    table, inputs = _model_table(table, ["_id", fb.KEY, LABEL, *COORDINATES])
    marked = settle(split.mark_test(table, "_id", LABEL))
    train, test = marked.filter("is_test = 0"), marked.filter("is_test = 1")

    folded = settle(split.mark_folds(train, "_id", LABEL), ["fold"])
    scored = settle(model.out_of_fold(folded, inputs, LABEL, boosting=boosting))
    run.write(evaluate.fold_metrics(scored, label=LABEL), "fold_metrics")

    fitted = model.fit(train, inputs, LABEL, boosting)
    _write_model(run, fitted, train, model.score(fitted, test))


def crossval(run: Run, positive_weight: float = 1000.0) -> None:
    """Score every row by a model that has not seen it; then train on all rows."""
    boosting = run.boosting.with_weight(positive_weight)
    table = _with_id(run.read(), fb.KEY)
    table, inputs = _model_table(table, ["_id", fb.KEY, LABEL, *COORDINATES])
    folded = settle(split.mark_folds(table, "_id", LABEL), ["fold"])
    scored = settle(model.out_of_fold(folded, inputs, LABEL, boosting=boosting))
    run.write(evaluate.fold_metrics(scored, label=LABEL), "fold_metrics")
    _write_model(run, model.fit(folded, inputs, LABEL, boosting), folded, scored)


def _write_model(run: Run, fitted, rows: DataFrame, scored: DataFrame) -> None:
    model.save(fitted, run.path("model"))
    run.write(model.importances(fitted, rows), "importances")
    run.write(evaluate.confusion(scored, LABEL), "confusion")
    run.write(reports.scored_locations(scored, LABEL, keep=["_id"]), "scored_locations")


def rounds(run: Run) -> None:
    """On the panel: find the number of rounds by cross-validation, train, and judge.

    The round errors on both parts of the data show where more rounds stop to help.
    """
    table = _with_id(run.read(), fb.KEY, "as_of")
    without = ["_id", fb.KEY, LABEL, "as_of", "label_complete", *PANEL_LEFT_OUT]
    table, inputs = _model_table(table, without)
    marked = settle(split.mark_test(table, "_id", LABEL))
    train, test = marked.filter("is_test = 0"), marked.filter("is_test = 1")

    folded = settle(split.mark_folds(train, "_id", LABEL), ["fold"])
    best = model.cross_validated_rounds(folded, inputs, LABEL, boosting=run.boosting)
    # The rounds are found: the final training uses all rows and doesn't stop before.
    final = replace(run.boosting.with_rounds(best), validation_share=0.0)
    fitted = model.fit(train, inputs, LABEL, final)
    model.save(fitted, run.path("panel_model"))
    errors = [
        model.error_per_round(fitted, part, LABEL).withColumn("part", F.lit(name))
        for name, part in (("train", train), ("test", test))
    ]
    run.write(errors[0].unionByName(errors[1]), "round_errors")
    scored = model.score(fitted, test)
    run.write(evaluate.accuracy(scored, LABEL), "panel_accuracy")
    run.write(evaluate.confusion(scored, LABEL), "panel_confusion")


def maps(run: Run) -> None:
    """From scored locations: map markers, geohashes with clusters, and the running hits."""
    locations = run.read()
    run.write(reports.marker_feed(locations), "markers")
    clean = reports.clean_locations(locations)
    run.write(reports.with_clusters(reports.with_geohash(clean)), "areas")
    hits = ranking.running_hits(locations, "scores", "_id", F.col("y") == 1)
    run.write(hits.select("rank", "cumulative_hits"), "running_hits")


JOBS: dict[str, Callable[[Run], None]] = {
    job.__name__: job for job in (features, panel, holdout, crossval, rounds, maps)
}


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("job", choices=JOBS)
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--format", default="csv", choices=["csv", "parquet"])
    parser.add_argument("--rounds", type=int, default=model.Boosting.rounds)
    parser.add_argument("--validation-share", type=float, default=0.0)
    parser.add_argument("--depth", type=int, default=model.Boosting.depth)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName(f"kerbstone-{given.job}").getOrCreate()
    boosting = model.Boosting(
        rounds=given.rounds, depth=given.depth, validation_share=given.validation_share
    )
    try:
        JOBS[given.job](Run(spark, given.input, given.output, given.format, boosting))
    finally:
        remove_scratch()


if __name__ == "__main__":
    main()
