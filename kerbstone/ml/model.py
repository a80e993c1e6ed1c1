"""The boosted-tree incident classifier."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbstone.ml.encode import FEATURES, Inputs, feature_names, stages
from kerbstone.operators.aggregates import class_balance
from kerbstone.operators.sets import union_by_name
from kerbstone.session import checkpoint_folder, scratch_path

WEIGHT, HELD = "_weight", "_held"
PASSED_ON = ("rawPrediction", "probability", "prediction")


@dataclass(frozen=True)
class Boosting:
    """Training settings; rounds, depth and step start from usual boosting defaults."""

    rounds: int = 100
    depth: int = 6
    step: float = 0.3
    seed: int = 42
    # Share of a positive row's weight to a negative one's; None takes n0 / n1 of the training rows.
    positive_weight: float | None = 1.0
    # Rows held out of training to stop it when they gain no more: those a boolean column
    # marks, or else a share of the rows, settled by their values. Without either all rounds run.
    validation: str | None = None
    validation_share: float = 0.0
    tolerance: float = 0.01
    max_bins: int = 32

    def with_weight(self, positive_weight: float | None) -> Boosting:
        return replace(self, positive_weight=positive_weight)

    def with_rounds(self, rounds: int) -> Boosting:
        return replace(self, rounds=rounds)


def weighted(df: DataFrame, label: str, positive_weight: float | None) -> DataFrame:
    """Add the weight column; the class ratio is two counts, read once."""
    if positive_weight is None:
        positive_weight = class_balance(df, label).first()["ratio"] or 1.0
    return df.withColumn(
        WEIGHT, F.when(F.col(label) == 1, F.lit(float(positive_weight))).otherwise(F.lit(1.0))
    )


def fit(df: DataFrame, inputs: Inputs, label: str, boosting: Boosting = Boosting()) -> PipelineModel:
    """Train encoders and trees on ``df``.

    Rounds are many passes over the same rows: the tree builder keeps its own
    binned copy and cuts the lineage of its round state through checkpoints.
    """
    checkpoint_folder(df.sparkSession)
    rows, held = weighted(df, label, boosting.positive_weight), boosting.validation
    if held is None and boosting.validation_share:
        values = F.xxhash64(F.lit(boosting.seed), *[F.col(f"`{c}`") for c in df.columns])
        rows = rows.withColumn(HELD, F.pmod(values, F.lit(1000)) < 1000 * boosting.validation_share)
        held = None if rows.filter(HELD).isEmpty() else HELD
    trees = GBTClassifier(
        featuresCol=FEATURES,
        labelCol=label,
        weightCol=WEIGHT,
        maxIter=boosting.rounds,
        maxDepth=boosting.depth,
        stepSize=boosting.step,
        seed=boosting.seed,
        checkpointInterval=10,
        validationTol=boosting.tolerance,
        maxBins=boosting.max_bins,
    )
    if held:
        trees = trees.setValidationIndicatorCol(held)
    return Pipeline(stages=[*stages(inputs), trees]).fit(rows)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``scores``, the probability of the label, and ``y_pred``, the likelier class
    (0 where both are equal)."""
    scored = model.transform(df)
    return scored.select(
        *[F.col(f"`{c}`") for c in df.columns],
        vector_to_array("probability")[1].alias("scores"),
        F.col("prediction").cast("int").alias("y_pred"),
    )


def out_of_fold(
    df: DataFrame,
    inputs: Inputs,
    label: str,
    fold: str = "fold",
    folds: int = 5,
    boosting: Boosting = Boosting(),
    parallel: int = 5,
) -> DataFrame:
    """Score every row by the model trained on the other folds.

    The folds train side by side; each is a Spark job of its own. ``df`` is read
    many times, so pass a settled table.
    """

    def held_out(i: int) -> DataFrame:
        model = fit(df.filter(F.col(fold) != i), inputs, label, boosting)
        return score(model, df.filter(F.col(fold) == i))

    with ThreadPoolExecutor(parallel) as pool:
        inherited = inheritable_thread_target(df.sparkSession)(held_out)
        return union_by_name(*pool.map(inherited, range(folds)))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _trees(model: PipelineModel):
    return model.stages[-1]


def round_count(model: PipelineModel) -> int:
    return _trees(model).getNumTrees


def importances(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(feature_name, feature_importance, position), summing to 1. ``df`` is any table the
    model can score; only its schema is used. One row per feature, so a local table."""
    encoded = PipelineModel(model.stages[:-1]).transform(df.limit(0))
    names = feature_names(encoded)
    values = _trees(model).featureImportances.toArray()
    total = values.sum() or 1.0
    rows = [(n, float(v / total), i) for i, (n, v) in enumerate(zip(names, values, strict=True))]
    schema = "feature_name string, feature_importance double, position int"
    return df.sparkSession.createDataFrame(rows, schema)


def top_features(table: DataFrame, k: int = 20) -> DataFrame:
    """The k most important features, earlier ones first among equals."""
    return table.orderBy(F.col("feature_importance").desc(), "position").limit(k)


def _leaf_values(model: PipelineModel) -> list[np.ndarray]:
    """For each tree the output of its leaves, left to right, times the tree's weight.

    Read from the model's own node table, as large as the model whatever the data.
    """
    spark = SparkSession.active()
    path = scratch_path(spark, "trees")
    _trees(model).write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    leaves = nodes.filter("leftChild < 0").select("treeID", "id", "prediction")
    found: list[list[float]] = [[] for _ in _trees(model).treeWeights]
    for row in leaves.orderBy("treeID", "id").collect():
        found[row["treeID"]].append(row["prediction"])
    return [w * np.array(v) for w, v in zip(_trees(model).treeWeights, found, strict=True)]


def _counting_errors(outputs: list[np.ndarray]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrong, rows = np.zeros(len(outputs), np.int64), 0
        for batch in batches:
            leaves = np.array(batch.column("leaves").flatten()).reshape(batch.num_rows, -1)
            label = batch.column("label").to_numpy()
            margin = np.zeros(batch.num_rows)
            for i, output in enumerate(outputs):
                margin += output[leaves[:, i].astype(int)]
                wrong[i] += ((margin > 0) != (label > 0)).sum()
            rows += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(1, len(outputs) + 1, dtype=np.int32)),
                pa.array(wrong),
                pa.array(np.full(len(outputs), rows)),
            ],
            ["round", "wrong", "rows"],
        )

    return count


def error_per_round(model: PipelineModel, df: DataFrame, label: str) -> DataFrame:
    """(round, error): share of ``df`` misclassified by the first 1, 2, … trees.

    The model names the leaf each row reaches in every tree. Each task adds up the leaves'
    outputs round by round, in batches, and hands on one row of counts per round.
    """
    trees = _trees(model)
    encoded = PipelineModel(model.stages[:-1]).transform(df)
    encoded = encoded.select(FEATURES, F.col(label).cast("double").alias("label"))
    reached = trees.transform(encoded, {trees.leafCol: "_leaves"})
    leaves = reached.select(vector_to_array("_leaves").alias("leaves"), "label")
    counts = leaves.mapInArrow(
        _counting_errors(_leaf_values(model)), "round int, wrong long, rows long"
    )
    return counts.groupBy("round").agg((F.sum("wrong") / F.sum("rows")).alias("error"))


def best_rounds(errors: Sequence[float], patience: int = 10) -> int:
    """How many rounds to train: the best round before ``patience`` rounds brought no gain."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def _next_count(errors: Sequence[float], best: int, most: int, patience: int) -> int:
    """How many rounds to train after as many as there are ``errors``, which leave the end open.

    Twice as many. If the last round was the best, as many as the fall would take to reach nought at the pace of
    the last ``patience`` rounds, and ``patience`` more. Where the run after that couldn't double again, all.
    """
    n = len(errors)
    count = 2 * n
    if best == n > 1:
        seen = min(patience, n - 1)
        # The last error is the least, so the fall isn't nought.
        left = errors[-1] * seen / (errors[-1 - seen] - errors[-1])
        count = max(count, n + patience + round(min(left, most)))
    return most if 2 * count > most else count


def rounds_in_blocks(
    errors_of: Callable[[int], list[float]], most: int, patience: int = 10, block: int = 12
) -> tuple[int, list[float]]:
    """(best round, errors): train as many rounds as it takes to see ``patience`` rounds without gain.

    ``errors_of(n)`` trains n rounds and gives the held-out error after each. The first n trees
    of a longer run are those of a shorter one, and every run starts anew. So the number is doubled until the errors tell,
    and errors that fall steadily, which no small number will end, lead to a long run at once. All runs before the
    last have fewer rounds together than the last one.
    """
    n = min(block, most)
    while True:
        errors = errors_of(n)
        best = best_rounds(errors, patience)
        if best + patience <= len(errors) or n >= most:
            return best, errors
        n = _next_count(errors, best, most, patience)


def _errors(model: PipelineModel, df: DataFrame, label: str) -> list[float]:
    return [r["error"] for r in error_per_round(model, df, label).orderBy("round").collect()]


def _unstopped(boosting: Boosting, rounds: int) -> Boosting:
    return replace(boosting, rounds=rounds, validation=None, validation_share=0.0)


def fit_with_patience(
    train: DataFrame,
    held: DataFrame,
    inputs: Inputs,
    label: str,
    boosting: Boosting = Boosting(),
    patience: int = 10,
) -> tuple[PipelineModel, list[float]]:
    """The model of the best round, when ``patience`` further rounds didn't lower the error on ``held``;
    and the errors of all rounds trained."""
    models: dict[int, PipelineModel] = {}

    def errors_of(rounds: int) -> list[float]:
        models[rounds] = fit(train, inputs, label, _unstopped(boosting, rounds))
        return _errors(models[rounds], held, label)

    best, errors = rounds_in_blocks(errors_of, boosting.rounds, patience)
    if best not in models:
        models[best] = fit(train, inputs, label, _unstopped(boosting, best))
    return models[best], errors


def cross_validated_rounds(
    df: DataFrame,
    inputs: Inputs,
    label: str,
    fold: str = "fold",
    folds: int = 5,
    boosting: Boosting = Boosting(),
    patience: int = 10,
    parallel: int = 5,
) -> int:
    """The round with the lowest mean error on the held-out folds, before ``patience`` rounds without gain."""

    def mean_errors(rounds: int) -> list[float]:
        def held_out_errors(i: int) -> list[float]:
            model = fit(df.filter(F.col(fold) != i), inputs, label, _unstopped(boosting, rounds))
            return _errors(model, df.filter(F.col(fold) == i), label)

        with ThreadPoolExecutor(parallel) as pool:
            inherited = inheritable_thread_target(df.sparkSession)(held_out_errors)
            return [sum(e) / folds for e in zip(*pool.map(inherited, range(folds)), strict=True)]

    return rounds_in_blocks(mean_errors, boosting.rounds, patience)[0]


def chosen_round(errors: DataFrame, patience: int = 10) -> DataFrame:
    """(round, error, chosen) of a table of errors, a row per round: marks the round that training with
    ``patience`` ends with."""
    upto = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = errors.withColumn("_best", F.min(F.struct("error", "round")).over(upto)["round"])
    rounds = F.struct("round", "_best")
    stopped = F.min(F.when(F.col("round") - F.col("_best") >= patience, rounds))["_best"]
    end = best.agg(F.coalesce(stopped, F.max(rounds)["_best"]).alias("_chosen"))
    marked = best.crossJoin(F.broadcast(end))  # one row
    return marked.select("round", "error", (F.col("round") == F.col("_chosen")).alias("chosen"))
