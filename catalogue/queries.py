"""The queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogue import standins as si
from kerbstone import functions as kf
from kerbstone.ml import encode, evaluate, model, split
from kerbstone.operators import aggregates, columns, filters, joins, ranking
from kerbstone.operators import profile as profiles
from kerbstone.operators.dedup import distinct_rows, keep_last
from kerbstone.operators.filters import Span
from kerbstone.operators.sets import union_by_name
from kerbstone.plans import features as fb
from kerbstone.plans import reports
from kerbstone.plans.panel import as_of_panel
from kerbstone.plans.snapshot import addressed, as_of_table, feature_table
from kerbstone.session import scratch_path, settle
from kerbstone.sources import tables
from kerbstone.sources.civic import read_civic

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


# Scalar functions ------------------------------------------------------------


@query
def key_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = si.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), kf.normalise_key(F.col("p_name")).alias("key")
    )
    customers = si.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), kf.normalise_key(F.col("c_name")).alias("key")
    )
    return union_by_name(parts, customers)


@query
def lenient_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    text = (
        F.when(F.col("p_partkey") % 4 == 0, size)
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit(" "), size, F.lit(" ")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(size, F.lit(".5")))
        .otherwise(F.col("p_brand"))
    )
    return si.table(spark, sf_dir, "part").select(
        "p_partkey", kf.lenient_number(text).alias("number")
    )


def _date_text():
    day = F.col("o_orderdate")
    return (
        F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "M/d/yyyy"))
        .otherwise(F.col("o_orderstatus"))
    )


@query
def lenient_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = kf.lenient_timestamp(_date_text(), "yyyy-MM-dd", "M/d/yyyy")
    return si.table(spark, sf_dir, "orders").select("o_orderkey", stamp.alias("stamp"))


@query
def strict_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = kf.strict_timestamp(
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), "yyyy-MM-dd HH:mm:ss"
    )
    return si.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", kf.year_of(stamp).alias("ship_year")
    )


@query
def age_recency_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = kf.lenient_number(si.built_text(F.col("o_custkey")))
    last = F.max(F.year("o_orderdate"))
    return (
        si.table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(last.alias("last_year"), F.min(F.year("o_orderdate")).alias("first_year"))
        .select(
            "o_custkey",
            kf.age(built, si.REF_YEAR).alias("age"),
            kf.recency(F.col("last_year"), si.REF_YEAR).alias("since_last"),
            kf.recency(F.col("first_year"), F.col("last_year")).alias("duration"),
        )
    )


@query
def land_use_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = (F.col("p_partkey") % 103 - 1).cast("int")
    return si.table(spark, sf_dir, "part").select(
        "p_partkey",
        kf.land_use_category(F.col("p_size")).alias("by_size"),
        kf.land_use_category(code).alias("by_code"),
    )


def _locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored customers; some lack a latitude and some have an impossible one."""
    key = F.col("c_custkey")
    lat = F.when(key % 50 == 3, None).when(key % 50 == 4, F.lit(-91.0)).otherwise(si.lat_of(key))
    return si.table(spark, sf_dir, "customer").select(
        key,
        lat.alias("lat"),
        si.lon_of(key).alias("long"),
        si.score_of(key).alias("scores"),
    )


@query
def score_band_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.marker_feed(_locations(spark, sf_dir), lowest_score=None)


@query
def high_score_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.marker_feed(_locations(spark, sf_dir))


@query
def haversine_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return si.table(spark, sf_dir, "customer").select(
        key, kf.miles_from_origin(si.lat_of(key), si.lon_of(key)).alias("miles")
    )


@query
def geohash5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.with_geohash(reports.clean_locations(_locations(spark, sf_dir)))


@query
def location_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.clean_locations(_locations(spark, sf_dir))


# Columns ---------------------------------------------------------------------


@query
def select_rename_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = columns.drop_columns(si.table(spark, sf_dir, "supplier"), ["s_acctbal"])
    named = columns.rename(suppliers, {"s_suppkey": "id", "s_name": "name"})
    customers = columns.rename(
        columns.keep_columns(si.table(spark, sf_dir, "customer"), ["c_custkey", "c_name"]),
        {"c_custkey": "id", "c_name": "name"},
    )
    wanted = ["id", "name", "not_there"]
    return union_by_name(*[columns.keep_present(t, wanted) for t in (named, customers)])


@query
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = si.table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("seg")
    )
    return encode.one_hot_columns(customers, {"seg": si.SEGMENTS})


# Filters ---------------------------------------------------------------------


@query
def window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = si.table(spark, sf_dir, "orders")
    inside = filters.in_span(orders, "o_orderdate", si.FEATURES)
    return orders.filter(inside).select("o_orderkey", F.year("o_orderdate").alias("year"))


@query
def as_of_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = si.table(spark, sf_dir, "lineitem")
    inside = filters.in_span(lines, "l_shipdate", Span.up_to(1996))
    return lines.filter(inside).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query
def label_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = si.table(spark, sf_dir, "orders")
    inside = filters.in_span(orders, "o_orderdate", Span.label(1996))
    urgent = F.col("o_orderpriority") == si.URGENT
    return orders.filter(inside & urgent).select("o_orderkey", "o_custkey")


@query
def null_keeping_inequality(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status")
    orders = si.table(spark, sf_dir, "orders").select("o_orderkey", status)
    return orders.filter(filters.differs(F.col("status"), "F"))


@query
def not_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("c_custkey") % 5 == 0, "0").when(F.col("c_custkey") % 5 == 1, "")
    key = key.when(F.col("c_custkey") % 5 == 2, None).otherwise(F.col("c_name"))
    rows = si.table(spark, sf_dir, "customer").select("c_custkey", key.alias("key"))
    return rows.filter(filters.not_listed(F.col("key"), filters.NO_KEY))


@query
def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.complete_rows(_locations(spark, sf_dir))


# Duplicates ------------------------------------------------------------------


@query
def distinct_rows_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = si.table(spark, sf_dir, "orders")
    return distinct_rows(orders.select("o_custkey", "o_orderpriority", "o_orderstatus"))


@query
def last_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = si.table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_totalprice"
    )
    return keep_last(orders, "o_custkey", ["o_orderdate", "o_orderkey"])


@query
def last_part_per_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = si.table(spark, sf_dir, "part").select("p_size", "p_partkey", "p_retailprice")
    return keep_last(part, "p_size", ["p_partkey"])


# Joins -----------------------------------------------------------------------


def _order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = si.table(spark, sf_dir, "orders")
    return columns.with_flag(
        aggregates.count_per_key(orders, "o_custkey", "o_orderkey", "n_orders"), "any_order"
    ).withColumnRenamed("o_custkey", "c_custkey")


@query
def feature_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = si.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    joined = joins.attach(customers, _order_counts(spark, sf_dir), "c_custkey")
    return columns.fill_missing(joined, {"n_orders": 0, "any_order": 0})


@query
def feature_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = si.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = si.table(spark, sf_dir, "orders")
    orders = orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return joins.attach_events(customers, orders, "c_custkey")


@query
def fanout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fan-out by order status, whose few keys hold far more rows than one part may."""
    orders = si.table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey")
    statuses = orders.select("o_orderstatus").distinct().withColumn("known", F.lit(1))
    return joins.attach_events(statuses, orders, "o_orderstatus", part_rows=500)


@query
def events_with_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = si.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    suppliers = si.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"
    )
    return joins.events_with(lines, suppliers, "l_suppkey", "left")


@query
def anti_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = si.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    urgent = si.table(spark, sf_dir, "orders").filter(
        (F.col("o_orderpriority") == si.URGENT) & (F.col("o_totalprice") > 300000)
    )
    return joins.not_in(orders, urgent, "o_custkey")


@query
def member_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = si.table(spark, sf_dir, "customer").select("c_custkey")
    buyers = si.table(spark, sf_dir, "orders").filter(F.col("o_totalprice") > 450000)
    buyers = buyers.select(F.col("o_custkey").alias("c_custkey"))
    return joins.flag_in(customers, buyers, "c_custkey", "big_buyer")


@query
def reopened_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = si.orders(spark, sf_dir)
    filed = si.filings(orders).seen(si.FEATURES).withColumnRenamed("year", "filed")
    let = si.permits(orders).seen(si.FEATURES).withColumnRenamed("year", "let")
    return si.snake(joins.reopened(filed, let, fb.KEY, "filed", "let"))


@query
def foreclosed_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = si.orders(spark, sf_dir)
    still = fb.foreclosed(si.filings(orders), si.permits(orders), si.FEATURES)
    customers = si.properties(spark, sf_dir).select(fb.KEY)
    return si.snake(joins.flag_in(customers, still, fb.KEY, "foreclosed"))


# Aggregates ------------------------------------------------------------------


@query
def count_max_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = si.order_events(si.orders(spark, sf_dir)).seen(si.FEATURES)
    return si.snake(aggregates.count_and_last(seen, fb.KEY, "year", "n", "last_year"))


@query
def sum_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = si.table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"
    )
    return aggregates.sum_per_key(lines, "l_suppkey")


@query
def category_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = si.table(spark, sf_dir, "orders")
    matrix = aggregates.category_matrix(
        orders, "o_custkey", "o_orderpriority", si.PRIORITIES, "total", "any_order"
    )
    listed = kf.row_total(*[F.col(c) for c in si.PRIORITIES.values()])
    return matrix.withColumn("listed", listed)


@query
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.class_balance(si.table(spark, sf_dir, "labels"), "toxic")


@query
def last_incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = si.orders(spark, sf_dir).filter(F.col("o_orderpriority") == si.URGENT)
    seen = si.order_events(urgent).seen(Span())
    year = F.col("year")
    return si.snake(
        aggregates.last_incident(
            seen, fb.KEY, "year", 1997, history=year <= 1997, window=year.between(1997, 2001)
        )
    )


@query
def row_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = aggregates.RowTrace()
    traced = feature_table(
        si.sources(spark, sf_dir), si.FEATURES, si.LABELS, si.REF_YEAR, trace=trace
    )
    traced.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(trace.rows(), "step string, rows bigint, columns int")


# Rankings and stacking -------------------------------------------------------


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a rule for a score: the shorter, the likelier toxic."""
    documents = si.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    labels = si.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"))
    score = F.lit(100.0) / (F.col("n_chars") + 100)
    scored = documents.join(labels, "doc_id").withColumn("scores", score)
    return scored.withColumn("y_pred", (F.col("scores") >= 0.1).cast("int"))


@query
def topk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_k(_scored(spark, sf_dir), "scores", "doc_id", 20)


@query
def running_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.running_hits(_scored(spark, sf_dir), "scores", "doc_id", F.col("y") == 1, 20)


@query
def running_hits_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders ranked by price, with the number of urgent ones so far."""
    orders = si.table(spark, sf_dir, "orders")
    urgent = F.col("o_orderpriority") == si.URGENT
    return ranking.running_hits(orders, "o_totalprice", "o_orderkey", urgent, None)


@query
def hits_in_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = (F.col("y") == 1) & (F.col("y_pred") == 1)
    return ranking.hits_in_top_k(_scored(spark, sf_dir), "scores", "doc_id", hit, 100)


@query
def union_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = si.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), "c_mktsegment"
    )
    suppliers = si.table(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"), "s_nationkey"
    )
    return union_by_name(customers, suppliers)


# Feature builders ------------------------------------------------------------


@query
def fb_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = fb.property_base(si.properties(spark, sf_dir), ["_ord"], ref_year=si.REF_YEAR)
    return si.snake(base)


@query
def fb_property_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = fb.property_base(
        si.properties(spark, sf_dir), ["_ord"], ref_year=1996, built_by=1996
    )
    return si.snake(base)


@query
def fb_code_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return si.snake(fb.code_cases(si.order_events(si.orders(spark, sf_dir)), si.FEATURES, si.PRIORITIES))


@query
def fb_crimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return si.snake(fb.crimes(si.offense_events(spark, sf_dir), si.FEATURES))


@query
def fb_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    disconnects = si.disconnects(si.orders(spark, sf_dir))
    return si.snake(fb.utility_disconnects(disconnects, si.FEATURES, si.REF_YEAR))


@query
def fb_rental(spark: SparkSession, sf_dir: str) -> DataFrame:
    permits = si.permits(si.orders(spark, sf_dir))
    return si.snake(fb.rental_registration(permits, Span.up_to(1998), 1998))


@query
def fb_fire_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    incidents = si.order_events(si.orders(spark, sf_dir))
    return si.snake(fb.fire_label(incidents, si.LABELS, si.URGENT))


@query
def fb_inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return si.snake(fb.inspections(si.visits(spark, sf_dir), si.FEATURES, "R"))


@query
def fb_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return si.snake(fb.parcels(si.lots(spark, sf_dir), ["_ord"], measures=["BuildVal"]))


@query
def fb_foreclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = si.orders(spark, sf_dir)
    return si.snake(fb.foreclosed(si.filings(orders), si.permits(orders), si.FEATURES))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = si.sources(spark, sf_dir)
    return addressed(feature_table(sources, si.FEATURES, si.LABELS, si.REF_YEAR))


@query
def full_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return si.snake(_features(spark, sf_dir))


@query
def full_as_of_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = si.sources(spark, sf_dir)
    panel = as_of_panel(sources, si.YEARS, si.HORIZON, observed_until=si.OBSERVED_UNTIL)
    return si.snake(panel)


@query
def as_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One as-of year with a row per combination of permit, fire, inspection state and parcel."""
    rows = as_of_table(si.sources(spark, sf_dir), 1997, si.HORIZON, one_to_many=True)
    return si.snake(rows)


# Splits ----------------------------------------------------------------------


@query
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.mark_test(si.table(spark, sf_dir, "labels"), "doc_id", "toxic")


@query
def shuffled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = si.table(spark, sf_dir, "customer").select("c_custkey")
    return ranking.hash_rank(customers, "c_custkey", split.SEED, name="position")


@query
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.mark_folds(si.table(spark, sf_dir, "labels"), "doc_id", "toxic")


# Metrics and profile ---------------------------------------------------------


@query
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_scored(spark, sf_dir))


@query
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy(_scored(spark, sf_dir))


@query
def recall_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recall_precision(_scored(spark, sf_dir), ["lang"])


@query
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiled = profiles.profile(si.table(spark, sf_dir, "orders"), exact=True)
    shares = {f"q{round(100 * q):02}": F.round(F.get("quantiles", F.lit(i)), 4) for i, q in enumerate(profiles.QUANTILES)}
    return profiled.withColumns(
        {name: F.round(name, 4) for name in ("mean", "stddev")} | shares
    ).drop("quantiles")


@query
def column_profile_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.profile(si.table(spark, sf_dir, "lineitem"))


@query
def column_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = si.table(spark, sf_dir, "orders")
    return profiles.top_values(orders, ["o_custkey", "o_orderstatus", "o_orderpriority"])


# Files -----------------------------------------------------------------------


@query
def sink_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = si.table(spark, sf_dir, "customer")
    read = []
    for fmt in ("parquet", "csv"):
        path = scratch_path(spark, f"customers-{fmt}")
        tables.write_table(customers, path, fmt)
        if fmt == "csv":
            back = tables.read_csv(spark, path, T.StructType(customers.schema.fields))
        else:
            back = tables.read_parquet(spark, path)
        read.append(columns.with_flag(back, "fmt", fmt))
    return union_by_name(*read)


@query
def csv_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks, commas and quotes, through a CSV file and back."""
    documents = si.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit('"a", ""b""\n'), "text").alias("text"), "lang"
    )
    path = scratch_path(spark, "documents-csv")
    tables.write_table(documents, path, "csv")
    return tables.read_csv(spark, path, documents.schema, multi_line=True)


@query
def csv_mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder of files whose columns come in different orders."""
    customers = si.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = scratch_path(spark, "customers-mixed")
    even = F.col("c_custkey") % 2 == 0
    customers.filter(even).write.option("header", True).csv(path)
    turned = customers.filter(~even).select("c_acctbal", "c_custkey", "c_name")
    turned.write.mode("append").option("header", True).csv(path)
    return tables.read_csv(spark, path, customers.schema)


@query
def csv_inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts from CSV without a schema: a column without values, a mixed one, and one that is a number
    in all rows but one."""
    part = si.table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    written = part.withColumns(
        {
            "nothing": F.lit(None).cast("string"),
            "even": key % 2 == 0,
            "mixed": F.when(key % 2 == 0, key.cast("string")).otherwise("true"),
            "late": F.when(key == 77, F.lit("n77")).otherwise(key.cast("string")),
            "halves": (key / 2).cast("double"),
            "gaps": F.when(key % 3 == 0, F.lit("NA")).otherwise(key.cast("string")),
        }
    )
    path = scratch_path(spark, "parts-csv")
    tables.write_table(written, path, "csv")
    return tables.read_csv(spark, path)


@query
def civic_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a file of properties with further columns, read as the civic tables are."""
    read = []
    for fmt in ("csv", "parquet"):
        folder = scratch_path(spark, f"civic-{fmt}")
        key = F.col("c_custkey")
        rows = si.table(spark, sf_dir, "customer").select(
            F.concat(key.cast("string"), F.lit(" main st")).alias("ADDRESS"),
            si.built_text(key).alias("YEARBUILT"),
            si.lat_of(key).alias("LAT"),
            si.lon_of(key).alias("LON"),
            F.col("c_nationkey").cast("long").alias("ZONE"),
            F.col("c_acctbal").alias("TAX"),
            F.col("c_mktsegment").alias("SEGMENT"),
        )
        tables.write_table(rows, f"{folder}/properties.{fmt}", fmt)
        back = read_civic(spark, folder, fmt, only=["properties"])["properties"]
        read.append(columns.with_flag(back.drop("_ord"), "fmt", fmt))
    return read[0].unionByName(read[1])


# Models ----------------------------------------------------------------------

# The package's own depth and most rounds; training stops when held-out rows gain no more.
STOPPING = model.Boosting(validation_share=0.1)


def _model_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, encode.Inputs]:
    """The feature table, computed once for all passes, and the columns the model sees."""
    table = settle(_features(spark, sf_dir))
    inputs = encode.Inputs.of(table, without=[fb.KEY, "Incident", "LAT", "LON"])
    return encode.fill_for_trees(table, inputs)


def _folded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, encode.Inputs]:
    table, inputs = _model_table(spark, sf_dir)
    return settle(split.mark_folds(table, fb.KEY, "Incident"), ["fold"]), inputs


def _held_out(spark: SparkSession, sf_dir: str):
    table, inputs = _model_table(spark, sf_dir)
    marked = settle(split.mark_test(table, fb.KEY, "Incident"))
    train, test = marked.filter("is_test = 0"), marked.filter("is_test = 1")
    return model.fit(train, inputs, "Incident", STOPPING), train, test, inputs


# Trees are Spark ML's and have no twin in SQL; what must hold of any scores has: which rows are
# scored, in which fold, that scores are probabilities and the class follows from them.


def _checked(scored: DataFrame) -> list:
    in_range = F.col("scores").between(0.0, 1.0)
    agrees = F.col("y_pred") == (F.col("scores") > 0.5).cast("int")
    return [in_range.alias("in_range"), agrees.alias("agrees")]


@query
def oof_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded, inputs = _folded(spark, sf_dir)
    scored = model.out_of_fold(folded, inputs, "Incident", boosting=STOPPING)
    return scored.select(F.col(fb.KEY).alias("address"), "fold", "Incident", *_checked(scored))


@query
def cv_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics per fold of the documents' rule score."""
    folded = split.mark_folds(_scored(spark, sf_dir), "doc_id", "y")
    metrics = evaluate.fold_metrics(settle(folded))
    return metrics.select(
        "fold", *[F.round(n, 6).alias(n) for n in ("recall", "precision", "roc_auc")]
    )


@query
def holdout_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted, _, test, _ = _held_out(spark, sf_dir)
    path = scratch_path(spark, "classifier")
    model.save(fitted, path)
    before = model.score(fitted, test).select(fb.KEY, F.col("scores").alias("before"))
    scored = model.score(model.load(path), test).join(before, fb.KEY)
    same = (F.col("scores") == F.col("before")).alias("same")
    return scored.select(F.col(fb.KEY).alias("address"), "Incident", same, *_checked(scored))


@query
def iteration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Are the rounds complete, and is the last error that of the whole model?"""
    fitted, train, test, _ = _held_out(spark, sf_dir)
    rounds = model.round_count(fitted)
    return union_by_name(
        *[
            model.error_per_round(fitted, rows, "Incident")
            .crossJoin(
                evaluate.accuracy(model.score(fitted, rows), "Incident").select(
                    F.col("error").alias("final")
                )
            )
            .agg(
                F.lit(part).alias("part"),
                (F.count_distinct("round") == rounds).alias("complete"),
                F.max(
                    (F.col("round") == rounds) & (F.abs(F.col("error") - F.col("final")) < 1e-12)
                ).alias("ends_right"),
            )
            for part, rows in (("train", train), ("test", test))
        ]
    )


@query
def best_round_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds found by cross-validation: at least one, and fewer than allowed."""
    folded, inputs = _folded(spark, sf_dir)
    rounds = model.cross_validated_rounds(folded, inputs, "Incident")
    found = spark.createDataFrame([(rounds,)], "rounds int")
    most = model.Boosting.rounds
    return found.select(
        (F.col("rounds") >= 1).alias("trains"), (F.col("rounds") < most).alias("stops")
    )


# A model small enough to be trained in SQL as well: its twins work out the trees, scores, errors and
# metrics from the table alone.
STUMPS = model.Boosting(rounds=6, depth=1)
STUMP_INPUTS = encode.Inputs(("prio", "month", "fifth"))


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    prio, month = F.substring("o_orderpriority", 1, 1).cast("int"), F.month("o_orderdate")
    fifth, noise = F.col("o_custkey") % 5, F.col("o_orderkey") % 7
    return si.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        prio.cast("double").alias("prio"),
        month.cast("double").alias("month"),
        fifth.cast("double").alias("fifth"),
        (2 * prio + month + 3 * fifth + noise > 22).cast("int").alias("y"),
        (F.col("o_orderkey") % 5).cast("int").alias("fold"),
    )


@query
def boosted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settle(_graded(spark, sf_dir))
    fitted = model.fit(rows, STUMP_INPUTS, "y", STUMPS)
    return model.score(fitted, rows).select("o_orderkey", F.round("scores", 6).alias("scores"), "y_pred")


@query
def boosted_round_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of each round on rows held out, and the round that two rounds without gain lead back to."""
    rows = settle(_graded(spark, sf_dir))
    fitted = model.fit(rows.filter("fold <> 0"), STUMP_INPUTS, "y", STUMPS.with_rounds(10))
    errors = model.error_per_round(fitted, rows.filter("fold = 0"), "y")
    return model.chosen_round(errors, patience=2).withColumn("error", F.round("error", 9))


@query
def boosted_fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, precision and area under the curve of models trained on the other folds."""
    rows = settle(_graded(spark, sf_dir), ["fold"])
    scored = settle(model.out_of_fold(rows, STUMP_INPUTS, "y", boosting=STUMPS))
    metrics = evaluate.fold_metrics(scored)
    return metrics.select(
        "fold", *[F.round(n, 6).alias(n) for n in ("recall", "precision", "roc_auc")]
    )


@query
def dictionary_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the feature vector of a number, a column of few and one of very many values."""
    customers = si.table(spark, sf_dir, "customer")
    known = [encode.dictionary(customers, c) for c in ("c_mktsegment", "c_name")]
    return encode.place_names(spark, ["c_acctbal"], known)


@query
def dictionary_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the vector of their size, brand and type; brands are known from a part of the table."""
    part = si.table(spark, sf_dir, "part")
    known = [encode.dictionary(part.filter("p_partkey % 20 < 3"), c) for c in ("p_brand", "p_type")]
    encoded = encode.vectors(part, ["p_size"], known)
    values = vector_to_array(F.col(encode.FEATURES))
    set_ = F.filter(F.sequence(F.lit(1), F.size(values) - 1), lambda i: F.get(values, i) == 1.0)
    return encoded.select(
        "p_partkey",
        F.get(values, F.lit(0)).alias("first"),
        F.size(values).alias("width"),
        F.array_join(set_.cast("array<string>"), ",").alias("places"),
    )


@query
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted, train, _, inputs = _held_out(spark, sf_dir)
    found = model.importances(fitted, train)
    whole = F.abs(F.sum("feature_importance") - 1) < 1e-9
    return found.agg(
        (F.count_distinct("feature_name") == F.count(F.lit(1))).alias("one_row_each"),
        (F.min("feature_importance") >= 0).alias("none_negative"),
        whole.alias("sum_to_one"),
    )


@query
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking of importances, on parts in the role of features."""
    part = si.table(spark, sf_dir, "part")
    named = part.select(
        F.col("p_name").alias("feature_name"),
        F.col("p_size").cast("double").alias("feature_importance"),
        F.col("p_partkey").alias("position"),
    )
    return model.top_features(named)


@query
def scored_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _locations(spark, sf_dir).select(
        F.col("lat").alias("LAT"),
        F.col("long").alias("LON"),
        "scores",
        (F.col("c_custkey") % 2).alias("Incident"),
        (F.col("scores") > 0.5).cast("int").alias("y_pred"),
        "c_custkey",
    )
    return reports.scored_locations(scored, keep=["c_custkey"])


@query
def geo_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.with_clusters(reports.clean_locations(_locations(spark, sf_dir)), rounds=12)
