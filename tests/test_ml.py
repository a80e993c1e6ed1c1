import math
import random
from dataclasses import replace

import pytest
from conftest import rows
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from kerbstone.ml import encode, evaluate, model, split
from kerbstone.plans import reports

BOOSTING = model.Boosting(rounds=4, depth=3)


@pytest.fixture(scope="module")
def labelled(spark):
    """400 rows, an eighth positive; ``size`` and ``kind`` tell the label, with exceptions."""
    i = F.col("id")
    kind = F.when(i % 4 == 0, "big").when(i % 4 == 1, "small").when(i % 4 == 2, None)
    df = spark.range(400).select(
        i,
        F.when(i % 8 == 0, 1).otherwise(0).alias("y"),
        (F.when(i % 8 == 0, 50.0).otherwise(10.0) + i % 7).alias("size"),
        F.when(i % 10 != 3, i % 5).alias("gap"),
        kind.otherwise("other").alias("kind"),
        (i % 90).cast("double").alias("LAT"),
        (i % 180).cast("double").alias("LON"),
    )
    inputs = encode.Inputs.of(df, without=["id", "y", "LAT", "LON"])
    filled, inputs = encode.fill_for_trees(df, inputs)
    return filled.cache(), inputs


@pytest.fixture(scope="module")
def fitted(labelled):
    df, inputs = labelled
    marked = split.mark_test(df, "id", "y").cache()
    train, test = marked.filter("is_test = 0"), marked.filter("is_test = 1")
    return model.fit(train, inputs, "y", BOOSTING), train, test


def test_test_rows_are_exact_per_class(spark):
    df = spark.range(1000).select("id", (F.col("id") < 130).cast("int").alias("y"))
    marked = split.mark_test(df, "id", "y")
    counts = dict(rows(marked.groupBy("y").agg(F.sum("is_test"))))
    assert counts == {0: math.ceil(870 * 0.33), 1: math.ceil(130 * 0.33)}
    assert marked.count() == 1000 and marked.select("id").distinct().count() == 1000
    assert rows(marked) == rows(split.mark_test(df.repartition(7), "id", "y"))
    other = split.mark_test(df, "id", "y", seed=7).filter("is_test = 1")
    assert rows(other.select("id")) != rows(marked.filter("is_test = 1").select("id"))


def test_split_does_not_move_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), F.rand(1)).write.parquet(path)
    marked = split.mark_test(spark.read.parquet(path), "id", "y")
    plan = marked._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("FileScan")]
    assert "BroadcastHashJoin" in top and "Exchange hashpartitioning" not in top


def test_test_share_of_tiny_classes(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, None)], "id int, y int")
    marked = split.mark_test(df, "id", "y")
    assert rows(marked.groupBy("y").agg(F.sum("is_test"))) == [(None, 1), (0, 1), (1, 1)]


def test_folds_are_even_and_complete(labelled):
    folded = split.mark_folds(labelled[0], "id", "y")
    counts = rows(folded.groupBy("y", "fold").count())
    assert [c for y, _, c in counts if y == 1] == [10] * 5
    assert [c for y, _, c in counts if y == 0] == [70] * 5


def test_shuffle_keeps_the_rows_and_repeats(labelled):
    df = labelled[0].select("id")
    first = [r[0] for r in split.shuffle_rows(df, "id").collect()]
    assert first == [r[0] for r in split.shuffle_rows(df.repartition(5), "id").collect()]
    assert sorted(first) == list(range(400)) and first != sorted(first)


def test_one_hot_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "i int, c string")
    hot = encode.one_hot_columns(df, {"c": ["a", "b"]})
    assert hot.columns == ["i", "c_a", "c_b"]
    assert rows(hot) == [(1, 1, 0), (2, 0, 0), (3, 0, 0)]


def test_missing_numbers_get_a_marker(labelled):
    df, inputs = labelled
    assert "gap_missing" in inputs.numbers and "LAT" not in inputs.numbers
    assert df.filter("gap is null").count() == 0
    assert df.agg(F.sum("gap_missing")).first()[0] == 40


def test_unseen_texts_set_no_column(labelled, fitted):
    df, _ = labelled
    trained, _, _ = fitted
    encoder = trained.stages[:-1]
    odd = df.limit(2).withColumn("kind", F.when(F.col("id") == 0, "unseen"))
    for stage in encoder:
        odd = stage.transform(odd)
    names = encode.feature_names(odd)
    assert [n for n in names if n.startswith("kind")] == ["kind_big", "kind_other", "kind_small"]
    places = [i for i, n in enumerate(names) if n.startswith("kind")]
    for row in odd.select(encode.FEATURES).collect():
        assert [row[0][p] for p in places] == [0.0] * 3


def test_only_observed_gaps_get_a_marker(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 2.0, None), (2, 3.0, 4)], "id int, a double, b int")
    df.write.parquet(path)
    for table in (df, spark.read.parquet(path)):
        _, inputs = encode.fill_for_trees(table, encode.Inputs(("a", "b")))
        assert inputs.numbers == ("a", "b", "b_missing")


def test_training_stops_when_held_out_rows_gain_no_more(labelled):
    df, inputs = labelled[0], encode.Inputs(("gap",))  # tells little about the label
    stopping = model.Boosting(rounds=40, depth=3, validation_share=0.2)
    assert model.round_count(model.fit(df, inputs, "y", stopping)) < 40
    marked = df.withColumn("held", F.col("id") % 3 == 0)
    watched = model.Boosting(rounds=40, depth=3, validation="held")
    assert model.round_count(model.fit(marked, inputs, "y", watched)) < 40
    none = model.Boosting(rounds=2, depth=2, validation_share=1e-9)
    assert model.round_count(model.fit(df, inputs, "y", none)) == 2


def test_importances_sum_to_one(fitted):
    trained, train, _ = fitted
    table = model.importances(trained, train)
    assert table.agg(F.sum("feature_importance")).first()[0] == pytest.approx(1.0)
    assert model.top_features(table, 1).first()["feature_name"] == "size"


def test_saved_model_scores_the_same(fitted, tmp_path):
    trained, _, test = fitted
    path = str(tmp_path / "model")
    model.save(trained, path)
    model.save(trained, path)
    before, after = (model.score(m, test).select("id", "scores", "y_pred") for m in (trained, model.load(path)))
    assert rows(before) == rows(after)


def test_errors_per_round_end_at_the_final_error(fitted):
    trained, _, test = fitted
    errors = [r["error"] for r in model.error_per_round(trained, test, "y").orderBy("round").collect()]
    assert len(errors) == 4
    final = evaluate.accuracy(model.score(trained, test), "y").first()
    assert errors[-1] == pytest.approx(final["error"])


def test_best_rounds_stops_without_gain():
    assert model.best_rounds([0.5, 0.4, 0.4, 0.3]) == 4
    assert model.best_rounds([0.5, 0.4, 0.4, 0.4, 0.1], patience=2) == 2


def test_out_of_fold_scores_cover_every_row(labelled):
    df, inputs = labelled
    folded = split.mark_folds(df, "id", "y").cache()
    scored = model.out_of_fold(folded, inputs, "y", boosting=BOOSTING).cache()
    assert rows(scored.select("id")) == rows(df.select("id"))
    metrics = {r["fold"]: r for r in evaluate.fold_metrics(scored, label="y").collect()}
    assert set(metrics) == {-1, 0, 1, 2, 3, 4}
    assert metrics[-1]["roc_auc"] == pytest.approx(
        sum(metrics[i]["roc_auc"] for i in range(5)) / 5
    )
    assert metrics[-1]["roc_auc"] > 0.9
    assert 1 <= model.cross_validated_rounds(folded, inputs, "y", boosting=BOOSTING) <= 4


def test_positive_weight_raises_scores(labelled):
    df, inputs = labelled
    vague = encode.Inputs(("gap",))
    light, heavy = (
        model.score(model.fit(df, vague, "y", model.Boosting(2, 2, positive_weight=w)), df)
        .agg(F.avg("scores"))
        .first()[0]
        for w in (1.0, None)
    )
    assert heavy > light


def test_metrics_name_the_cells_right(spark):
    df = spark.createDataFrame(
        [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 0)] * 3 + [(1, 1)] * 4, "y int, y_pred int"
    )
    assert evaluate.confusion(df).first().asDict() == {"tn": 5, "fp": 2, "fn": 3, "tp": 4}
    assert rows(evaluate.recall_precision(df)) == [(4 / 7, 4 / 6)]
    assert evaluate.accuracy(df).first()["accuracy"] == pytest.approx(9 / 14)
    nothing = df.filter("y_pred = 0 and y = 0")
    assert rows(evaluate.recall_precision(nothing)) == [(0.0, 0.0)]


@pytest.mark.parametrize("ranges", [1, 7, 4096])
def test_roc_auc_of_all_groups_at_once(spark, monkeypatch, ranges):
    monkeypatch.setattr(evaluate, "RANGES", ranges)
    rng = random.Random(3)
    points = [(g, rng.randrange(2), rng.choice([rng.random(), 0.5, -3.0])) for g in range(3) for _ in range(120)]
    points += [(None, 0, 0.1), (None, 1, 0.9), (None, 1, None), (7, 1, 0.2), (8, 0, 0.4), (8, None, 0.4)]
    df = spark.createDataFrame(points, "fold int, y int, scores double")
    wanted = {}
    for g in {p[0] for p in points}:
        ones = [s for f, y, s in points if f == g and y == 1 and s is not None]
        noughts = [s for f, y, s in points if f == g and y == 0]
        pairs = [(p > n) + 0.5 * (p == n) for p in ones for n in noughts]
        wanted[g] = pytest.approx(sum(pairs) / len(pairs)) if pairs else None
    assert dict(rows(evaluate.roc_auc(df, ["fold"]))) == wanted


def test_jobs_of_fold_metrics_do_not_grow_with_folds(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("y"), (F.col("id") % 97 / 97).alias("scores"), "id")
    df = df.withColumn("y_pred", (F.col("scores") > 0.5).cast("int"))
    jobs = []
    for folds in (2, 40):
        spark.sparkContext.setJobGroup(f"folds-{folds}", "")
        found = evaluate.fold_metrics(df.withColumn("fold", (F.col("id") % folds).cast("int"))).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"folds-{folds}")))
        assert sorted(r["fold"] for r in found) == list(range(-1, folds))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[1] <= jobs[0] + 2


def dense(vector):
    return vector.toArray().tolist()


def test_dictionary_vectors_equal_indexed_ones(spark):
    rng = random.Random(5)
    values = ["b", "a", "ä", "Z", "a b", None]
    data = [(i, float(i % 5), rng.choice(values), rng.choice(["x", "y", None])) for i in range(300)]
    df = spark.createDataFrame(data, "id int, n double, t string, u string").repartition(4)
    train = df.filter("id % 4 > 0 and (t <> 'Z' or t is null)")
    inputs = encode.Inputs(("n",), ("t", "u"))
    wanted = Pipeline(stages=encode.stages(inputs)).fit(train).transform(df)
    known = [encode.dictionary(train, c) for c in ("t", "u")]
    found = encode.vectors(df, ["n"], known)
    assert {r["id"]: dense(r["features"]) for r in found.collect()} == {
        r["id"]: dense(r["features"]) for r in wanted.collect()
    }
    names = dict(rows(encode.place_names(spark, ["n"], known)))
    assert [names[i] for i in range(len(names))] == encode.feature_names(wanted)


def test_trees_on_a_column_of_many_values(spark, no_broadcast):
    df = spark.range(30_000).select(
        "id", (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 3).cast("double").alias("n"),
        F.concat(F.lit("k"), F.when(F.col("id") % 3 == 1, 0).otherwise(F.col("id")).cast("string")).alias("key"),
    )
    known = encode.dictionary(df, "key")
    assert known.size == df.select("key").distinct().count()
    ready = encode.vectors(df, ["n"], [known])
    first = ready.filter("id < 3").orderBy("id").collect()
    assert all(len(r["features"]) == 1 + known.size and len(r["features"].indices) == 2 for r in first)
    # The vector feeds a model as it is.
    few = encode.vectors(df, ["n"], [])
    trained = model.fit(few, encode.Inputs((), ready=True), "y", model.Boosting(rounds=1, depth=1))
    assert evaluate.accuracy(model.score(trained, few), "y").first()["accuracy"] > 0.6


def test_patience_and_tolerance_differ(spark):
    """Tolerance goes on while the loss falls, though no row changes its side; patience sees that none does."""
    i = F.col("id")
    df = spark.range(600).select(
        i, (i % 2).cast("double").alias("a"), (i % 3).cast("double").alias("b"), (i % 5).cast("double").alias("c"),
        ((i % 2 + i % 3 + i % 5) >= 4).cast("int").alias("y"),
    )
    inputs = encode.Inputs(("a", "b", "c"))
    boosting = model.Boosting(rounds=40, depth=1, step=0.1, tolerance=0.01)
    train, held = df.filter("id < 400"), df.filter("id >= 400")
    tolerant = model.fit(df.withColumn("held", i >= 400), inputs, "y", replace(boosting, validation="held"))
    patient, errors = model.fit_with_patience(train, held, inputs, "y", boosting)
    rounds = model.round_count(patient)
    assert rounds == model.best_rounds(errors, 10) != model.round_count(tolerant)
    assert errors[rounds - 1] == min(errors[: rounds + 10])
    assert evaluate.accuracy(model.score(patient, held), "y").first()["error"] == pytest.approx(errors[rounds - 1])


def test_blocks_grow_until_the_errors_tell():
    asked = []

    def errors_of(n):
        asked.append(n)
        return [1 / (1 + min(r, 25)) for r in range(n)]

    assert model.rounds_in_blocks(errors_of, 100)[0] == 26
    assert asked == [12, 24, 48]
    assert model.rounds_in_blocks(lambda n: [1 / (1 + r) for r in range(n)], 40)[0] == 40


def test_steady_errors_are_not_trained_five_times():
    """Every run starts anew: where errors fall to the last round, all runs together cost little more than it."""

    def search(errors, **settings):
        asked = []
        best, _ = model.rounds_in_blocks(lambda n: asked.append(n) or errors[:n], len(errors), **settings)
        return best, asked

    assert search([0.44 - 0.0015 * r for r in range(100)]) == (100, [12, 100])
    assert search([0.44 - 0.0015 * min(r, 11) for r in range(100)]) == (12, [12, 100])
    # Without a fall there is nothing to wait for, and a pause in it is waited for by doubling.
    assert search([0.44] * 100) == (1, [12])
    assert search([0.44 - 0.001 * min(r, 20) + 0.002 * (r == 11) for r in range(100)]) == (21, [12, 24, 48])
    rng = random.Random(7)
    for _ in range(300):
        falls, most, patience = rng.random() * 0.02, rng.choice([1, 12, 40, 100, 300]), rng.choice([1, 2, 10, 20])
        errors = [0.5]
        while len(errors) < most:
            errors.append(round(max(0.0, errors[-1] - falls * rng.random() + 0.005 * rng.random()), 4))
        best, asked = search(errors, patience=patience, block=rng.choice([1, 2, 12]))
        assert best == model.best_rounds(errors, patience)
        assert sum(asked) < 2 * asked[-1]


@pytest.mark.parametrize("errors", [[0.5, 0.4, 0.4, 0.3], [0.5, 0.4, 0.4, 0.4, 0.1], [0.2], [0.3, 0.3, 0.3]])
@pytest.mark.parametrize("patience", [1, 2, 10])
def test_chosen_round_equals_the_plain_rule(spark, errors, patience):
    df = spark.createDataFrame([(i + 1, e) for i, e in enumerate(errors)], "round int, error double")
    chosen = [r["round"] for r in model.chosen_round(df, patience).collect() if r["chosen"]]
    assert chosen == [model.best_rounds(errors, patience)]


def test_clusters_do_not_depend_on_the_layout(spark):
    rng = random.Random(2)
    points = [(round(rng.gauss(10 * (i % 4), 1), 6), round(rng.gauss(-80, 2), 6)) for i in range(500)]
    points += [points[0]] * 200 + [(None, 1.0), (1.0, None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, lat double, long double")
    found = [reports.with_clusters(d, 4).select("id", "cluster") for d in (df.repartition(1), df.repartition(9, "lat"))]
    assert rows(found[0]) == rows(found[1])
    centres = reports.cluster_centres(df, 4)
    for r in reports.with_clusters(df, 4).collect():
        if r["lat"] is None or r["long"] is None:
            assert r["cluster"] is None
            continue
        place = (round(r["lat"] * 10**6), round(r["long"] * 10**6))
        squares = [(place[0] - a) ** 2 + (place[1] - b) ** 2 for a, b in centres]
        assert r["cluster"] == squares.index(min(squares))
    assert reports.with_clusters(df.limit(0)).count() == 0


def test_roc_auc_by_counting_pairs(spark):
    points = [(i % 2, (i * 37 % 11) / 10) for i in range(40)]
    df = spark.createDataFrame(points, "y int, scores double")
    pairs = [
        (p > n) + 0.5 * (p == n) for y, p in points if y for z, n in points if not z
    ]
    assert evaluate.roc_auc(df).first()[0] == pytest.approx(sum(pairs) / len(pairs))


def test_reports(fitted):
    trained, _, test = fitted
    places = reports.scored_locations(model.score(trained, test), "y")
    assert places.columns == ["lat", "long", "scores", "y", "y_pred"]
    clustered = reports.with_clusters(reports.clean_locations(places), k=3)
    assert clustered.count() == test.count()
    assert clustered.select("cluster").distinct().count() == 3


def test_locations_are_cleaned(spark):
    df = spark.createDataFrame(
        [(-90.0, 1.0, 0.8), (-91.0, 1.0, 0.8), (None, 1.0, 0.8), (1.0, 180.0, 0.5)],
        "lat double, long double, scores double",
    )
    assert rows(reports.clean_locations(df).select("lat")) == [(-90.0,), (1.0,)]
    assert rows(reports.marker_feed(df.filter("lat > 0"), None)) == [
        (1.0, 180.0, 0.5, "mid", "yellow", "Score: 0.5")
    ]
    assert reports.marker_feed(df).count() == 2
