import bisect
import math
import random
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kerbstone.operators import aggregates, columns, filters, joins, profile, ranking, sets
from kerbstone.operators.dedup import distinct_rows, keep_last
from kerbstone.operators.filters import Span


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dropping_an_unknown_column_fails(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert columns.drop_columns(df, ["a"]).columns == ["b"]
    with pytest.raises(ValueError, match="nope"):
        columns.drop_columns(df, ["nope"])
    assert columns.keep_present(df, ["b", "nope", "a"]).columns == ["b", "a"]


def test_fill_missing_leaves_other_columns_alone(spark):
    df = spark.createDataFrame([(None, None)], "a int, `b c` string")
    assert rows(columns.fill_missing(df, {"a": 0})) == [(0, None)]
    assert rows(columns.fill_missing(df, {"b c": "0"})) == [(None, "0")]


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date", "int"])
def test_span_ends_are_included(spark, kind):
    years = [2010, 2011, 2019, 2020, None]
    df = spark.createDataFrame([(y,) for y in years], "y int")
    if kind != "int":
        df = df.select(F.make_date("y", F.lit(12), F.lit(31)).cast(kind).alias("y"))
    year = filters.year_column(df, "y")
    for span, expected in [
        (Span(2011, 2019), [2011, 2019]),
        (Span.up_to(2011), [2010, 2011]),
        (Span.label(2019), [2019, 2020]),
        (Span(), [2010, 2011, 2019, 2020]),
    ]:
        found = df.filter(filters.in_span(df, "y", span)).select(year.alias("y"))
        assert [r[0] for r in rows(found)] == expected


def test_span_on_text_is_refused(spark):
    with pytest.raises(TypeError):
        filters.in_span(spark.createDataFrame([("2011",)], "y string"), "y", Span(2011, 2012))


def test_span_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(datetime(2011, 1, 1),)], "t timestamp_ntz").write.parquet(path)
    df = spark.read.parquet(path)
    pushed = plan(df.filter(filters.in_span(df, "t", Span(2011, 2019)))).split("PushedFilters")[1]
    assert "GreaterThanOrEqual(t,2011-01-01" in pushed and "LessThan(t,2020-01-01" in pushed


def test_null_aware_conditions(spark):
    df = spark.createDataFrame([("Ready",), ("Not",), (None,), ("0",), ("",)], "s string")
    kept = df.filter(filters.differs(F.col("s"), "Ready"))
    assert [r[0] for r in rows(kept)] == [None, "", "0", "Not"]
    kept = df.filter(filters.not_listed(F.col("s"), filters.NO_KEY))
    assert [r[0] for r in rows(kept)] == [None, "Not", "Ready"]
    kept = df.filter(filters.has_key(df, "s"))
    assert [r[0] for r in rows(kept)] == ["Not", "Ready"]


def test_keep_last(spark):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 3, None), ("a", 2, "z"), (None, 5, "n"), (None, 4, "m")],
        "k string, o int, v string",
    )
    assert rows(keep_last(df, "k", ["o"])) == [(None, 5, "n"), ("a", 3, None)]
    two = df.withColumn("p", -F.col("o"))
    assert rows(keep_last(two, "k", ["p", "o"]).select("k", "o", "v")) == [
        (None, 4, "m"),
        ("a", 1, "x"),
    ]


def test_keep_last_of_numbers_is_hash_aggregation(spark):
    df = spark.range(10).select((F.col("id") % 3).alias("k"), "id", F.rand(1).alias("v"))
    assert "SortAggregate" not in plan(keep_last(df, "k", ["id"]))


def test_distinct_and_union(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "i int, s string")
    b = spark.createDataFrame([(2,)], "i int")
    assert rows(distinct_rows(a)) == [(1, "x")]
    assert rows(sets.union_by_name(a, b)) == [(1, "x"), (1, "x"), (2, None)]


@pytest.fixture
def hot(spark):
    """Left: keys 0..4 and two nulls. Right: 300 rows of key 0, one each of 1 to 3, one null."""
    left = spark.createDataFrame(
        [(k, f"p{i}") for i, k in enumerate([0, 1, 2, 3, 4, None, None])], "k int, p string"
    )
    right = spark.createDataFrame(
        [(0, i) for i in range(300)] + [(1, -1), (2, -2), (3, -3), (None, -4)], "k int, e int"
    )
    return left, right


def test_hot_keys_are_found_and_counted_into_parts(spark, hot):
    assert rows(joins.hot_keys(hot[1], "k", part_rows=50)) == [(0, 6)]
    assert rows(joins.hot_keys(hot[1], "k")) == []


@pytest.mark.parametrize("part_rows", [20, 50, 1000])
def test_attach_events_equals_a_left_join(spark, hot, no_broadcast, part_rows):
    left, right = hot
    joined = joins.attach_events(left, right, "k", part_rows)
    assert rows(joined.select("k", "p", "e")) == rows(
        left.join(right, "k", "left").select("k", "p", "e")
    )


def test_attach_events_spreads_the_hot_key(spark, hot, no_broadcast):
    left, right = hot
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.attach_events(left, right, "k", part_rows=20)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(r["count"] for r in sizes) < 250


def test_plans_are_made_without_running_a_job(spark, hot, no_broadcast):
    left, right = hot
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "no job expected")
    try:
        joins.attach_events(left, right, "k", part_rows=20)
        joins.events_with(right, left.dropna(), "k")
        assert not tracker.getJobIdsForGroup("planning")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_events_with_keeps_null_keys_apart(spark, how):
    events = spark.range(200).selectExpr("if(id < 150, null, id % 5) as k", "id as e")
    attributes = spark.range(4).selectExpr("id as k", "id * 10 as v")
    found = joins.events_with(events, attributes, "k", how)
    missing = found.filter("k is null").count()
    assert missing == (150 if how in ("left", "left_anti") else 0)
    with pytest.raises(ValueError):
        joins.events_with(events, attributes, "k", "full")


def test_not_in_and_flag_in(spark, hot):
    left, right = hot
    assert [r[0] for r in rows(joins.not_in(left, right, "k").select("k"))] == [None, None, 4]
    flags = dict(rows(joins.flag_in(left.dropna(), right, "k", "seen").select("k", "seen")))
    assert flags == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0}


def test_reopened_means_any_later_permit(spark):
    foreclosures = spark.createDataFrame(
        [("a", 2012), ("a", 2018), ("b", 2012), ("c", 2012), ("d", 2012), (None, 2012)],
        "k string, f int",
    )
    permits = spark.createDataFrame(
        [("a", 2015), ("b", 2012), ("c", 2011), (None, 2019)], "k string, p int"
    )
    assert rows(joins.reopened(foreclosures, permits, "k", "f", "p")) == [("a",)]


def test_counts_sums_and_matrix(spark):
    df = spark.createDataFrame(
        [("a", "x", 1.5), ("a", "x", None), ("a", "other", 1.0), ("b", None, 2.0)],
        "k string, t string, v double",
    )
    assert rows(aggregates.count_per_key(df, "k", "v", "n")) == [("a", 2), ("b", 1)]
    assert rows(aggregates.sum_per_key(df, "k")) == [("a", 2.5), ("b", 2.0)]
    matrix = aggregates.category_matrix(df, "k", "t", {"x": "x", "never": "never"}, "total", "any")
    assert matrix.columns == ["k", "x", "never", "total", "any"]
    assert rows(matrix) == [("a", 2, 0, 3, 1), ("b", 0, 0, 0, 1)]


def test_balance_of_one_class(spark):
    df = spark.createDataFrame([(0,), (0,)], "y int")
    assert rows(aggregates.class_balance(df, "y")) == [(2, 0, None)]


def test_row_trace_counts_without_own_jobs(spark):
    trace = aggregates.RowTrace()
    df = trace.mark(spark.range(10), "all")
    df = trace.mark(df.filter("id < 4").withColumn("x", F.lit(1)), "few")
    df.write.format("noop").mode("overwrite").save()
    assert trace.rows() == [("all", 10, 1), ("few", 4, 2)]


def test_ranking_with_ties(spark):
    df = spark.createDataFrame(
        [(1, 0.5, 1), (2, 0.9, 0), (3, 0.5, 1), (4, None, 1), (5, 0.1, None)],
        "id int, s double, y int",
    )
    assert [r["id"] for r in ranking.top_k(df, "s", "id", 3).collect()] == [2, 1, 3]
    hits = ranking.running_hits(df, "s", "id", F.col("y") == 1, 4)
    assert rows(hits.select("rank", "cumulative_hits")) == [(1, 0), (2, 1), (3, 2), (4, 2)]
    assert rows(ranking.hits_in_top_k(df, "s", "id", F.col("y") == 1, 2)) == [(1,)]


def test_hash_rank_is_a_plain_rank(spark):
    df = spark.range(500).select("id", (F.col("id") % 7 == 0).cast("int").alias("c"))
    ranked = ranking.hash_rank(df, "id", 42, ["c"])
    md5 = F.md5(F.concat(F.lit("42:"), F.col("id").cast("string")))
    from pyspark.sql import Window

    plain = df.withColumn("rank", F.row_number().over(Window.partitionBy("c").orderBy(md5)))
    assert rows(ranked) == rows(plain.withColumn("rank", F.col("rank").cast("bigint")))


def test_profile(spark):
    df = spark.createDataFrame(
        [(1, "a"), (2, None), (2, "b"), (None, "b")], "n int, t string"
    )
    for exact in (False, True):
        found = {r["column_name"]: r for r in profile.profile(df, exact=exact).collect()}
        assert found["n"]["rows"] == 4 and found["n"]["nulls"] == 1
        assert found["n"]["distinct_values"] == 2 and found["t"]["distinct_values"] == 2
        assert found["n"]["mean"] == pytest.approx(5 / 3)
        assert found["n"]["quantiles"][2] == 2.0
        assert (found["t"]["min_text"], found["t"]["max_text"]) == ("a", "b")
    best = profile.top_values(df, ["n", "t"], 1)
    assert rows(best) == [("n", "2", 2, 1), ("t", "b", 2, 1)]
    assert "WindowGroupLimit" in plan(best)


def test_running_hits_of_any_number(spark):
    df = spark.createDataFrame([(i, (i * 37 % 50) / 10 if i % 9 else None, i % 3) for i in range(400)], "id int, s double, y int")
    ordered = sorted(df.collect(), key=lambda r: (r["s"] is None, -(r["s"] or 0), r["id"]))
    hits, wanted = 0, []
    for rank, r in enumerate(ordered, 1):
        hits += r["y"] == 1
        wanted.append((rank, hits, r["s"], r["id"]))
    for k in (None, 350, 7):
        few, ranking.FEW = ranking.FEW, 10
        try:
            found = ranking.running_hits(df.repartition(6), "s", "id", F.col("y") == 1, k)
        finally:
            ranking.FEW = few
        assert sorted(tuple(r) for r in found.collect()) == wanted[:k]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan.replace("_part", "")[: plan.index("cumulative_hits")] or k
    assert ranking.running_hits(df.limit(0), "s", "id", F.col("y") == 1, None).count() == 0


def quantile(values, share):
    values = sorted(values)
    at = (len(values) - 1) * share
    low = math.floor(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


@pytest.mark.parametrize("direct", [100_000, 50, 1])
def test_exact_quantiles(spark, direct):
    rng = random.Random(4)
    columns = {
        "even": [rng.random() for _ in range(5000)],
        "tail": [math.exp(rng.gauss(0, 60)) * rng.choice([1, -1]) for _ in range(5000)],
        "hot": [rng.choice([0.0, 0.0, 0.0, 1.0, rng.random()]) for _ in range(5000)],
        "two": [rng.choice([1.0, 2.0]) for _ in range(5000)],
        "gaps": [None if rng.random() < 0.5 else rng.choice([float("nan"), rng.gauss(0, 1)]) for _ in range(5000)],
        "none": [None] * 5000,
    }
    kinds = ", ".join(f"{n} double" for n in columns)
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), kinds).repartition(5)
    shares = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]
    found = profile.exact_quantiles(df, list(columns), shares, direct)
    for name, values in columns.items():
        known = [v for v in values if v is not None and v == v]
        assert found[name] == pytest.approx([quantile(known, s) for s in shares] if known else [], rel=1e-12)


def test_exact_quantiles_of_tiny_columns(spark):
    df = spark.createDataFrame([(1, 2.0), (None, 4.0)], "a int, b double")
    assert profile.exact_quantiles(df, ["a", "b"], [0.25, 0.5]) == {"a": [1.0, 1.0], "b": [2.5, 3.0]}
    assert profile.exact_quantiles(df.limit(0), ["a", "b"]) == {"a": [], "b": []}
    assert profile.exact_quantiles(df, []) == {}


def test_sketches_keep_their_bounds(spark):
    rng = random.Random(9)
    values = [rng.gauss(0, 1) for _ in range(40_000)]
    df = spark.createDataFrame([(v, i % 7000, None if i % 2 else "x") for i, v in enumerate(values)], "v double, k int, t string")
    df = df.withColumn("none", F.lit(None).cast("double")).repartition(8)
    found = {r["column_name"]: r for r in profile.profile(df).collect()}
    ordered = sorted(values)
    for share, value in zip(profile.QUANTILES, found["v"]["quantiles"], strict=True):
        rank = bisect.bisect_left(ordered, value) / len(ordered)
        assert abs(rank - share) < 0.01
    assert found["v"]["min_number"] == ordered[0] and found["v"]["max_number"] == ordered[-1]
    assert abs(found["v"]["distinct_values"] - 40_000) < 5 * 0.016 * 40_000
    assert abs(found["k"]["distinct_values"] - 7000) < 5 * 0.016 * 7000
    assert (found["t"]["nulls"], found["t"]["distinct_values"], found["t"]["max_text"]) == (20_000, 1, "x")
    assert found["none"]["quantiles"] is None and found["none"]["distinct_values"] == 0
