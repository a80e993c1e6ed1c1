import math
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kerbstone import functions as kf


def values(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_key_loses_spaces_but_not_tabs(spark):
    found = values(spark, [" 12 Main st", "12\tMain", "", None], "string", kf.normalise_key)
    assert found == ["12MAINST", "12\tMAIN", "", None]


def test_key_normalising_twice_changes_nothing(spark):
    once = lambda c: kf.normalise_key(c)
    twice = lambda c: kf.normalise_key(kf.normalise_key(c))
    texts = ["a b", "ß x", " Ä\t1 "]
    assert values(spark, texts, "string", once) == values(spark, texts, "string", twice)


def test_lenient_number(spark):
    texts = ["1999", "n/a", " 12 ", "", "1999.5", "nan", "12d", "3.f", "-7", None]
    found = values(spark, texts, "string", kf.lenient_number)
    assert found == [1999.0, None, 12.0, None, 1999.5, None, None, None, -7.0, None]


def test_lenient_timestamp_tries_formats_in_order(spark):
    texts = ["2019-02-01", "1/2/2019", "13/13/2019", "soon", None]
    found = values(
        spark, texts, "string", lambda c: kf.lenient_timestamp(c, "yyyy-MM-dd", "M/d/yyyy")
    )
    assert found == [datetime(2019, 2, 1), datetime(2019, 1, 2), None, None, None]


def test_strict_timestamp_stops_at_bad_text(spark):
    assert values(spark, ["2019-02-01", None], "string", kf.strict_timestamp) == [
        datetime(2019, 2, 1),
        None,
    ]
    with pytest.raises(Exception, match="not a timestamp: soon"):
        values(spark, ["soon"], "string", kf.strict_timestamp)


def test_land_use_boundaries(spark):
    codes = [8, 9, 10, 11, 13, 14, 25, 26, 38, 39, 40, 49, 50, 53, 54, 61, 62, 63, 69, 70, 97, 98]
    found = dict(zip(codes, values(spark, codes, "int", kf.land_use_category), strict=True))
    unmapped = {c for c, v in found.items() if v == str(c)}
    assert unmapped == {9, 10, 14, 26, 39, 50, 54, 98}
    assert found[8] == found[70] == found[97] == "OPEN SPACES/NA"
    assert found[61] == found[63] == found[69] == "INDUSTRIAL"
    assert found[62] == "AIRPORT"
    assert found[11] == found[13] == "SINGLE OR TWO RESIDENTIAL"
    assert found[25] == "MULTIFAMILY"
    assert found[38] == "OFFICE AND PUBLIC SERVICE"
    assert found[40] == found[49] == "INSTITUTIONAL"
    assert found[53] == "COMMERCIAL"


def test_land_use_of_fractions_and_null(spark):
    found = values(spark, [11.0, 11.5, 9.0, None], "double", kf.land_use_category)
    assert found == ["SINGLE OR TWO RESIDENTIAL", "11.5", "9", None]


def test_score_bands(spark):
    scores = [-0.1, 0.0, 0.39, 0.4, 0.5, 0.6, 0.7, None]
    assert values(spark, scores, "double", kf.band_label) == [
        None, "low", "low", "mid", "mid", "high", "high", None,
    ]
    assert values(spark, [0.0, 0.4, 0.6], "double", kf.band_color) == ["green", "yellow", "red"]


def test_plain_number_text(spark):
    found = values(
        spark, [0.0005, 1.0, 0.25, 0.30000000000000004, 1e-05], "double", kf.plain_number_text
    )
    assert found == ["0.0005", "1.0", "0.25", "0.30000000000000004", "0.00001"]


def test_miles_from_origin(spark):
    df = spark.createDataFrame([(45.0, 90.0), (0.0, 0.0), (None, 1.0)], "lat double, lon double")
    found = [r[0] for r in df.select(kf.miles_from_origin(F.col("lat"), F.col("lon"))).collect()]
    assert found == [6214.0702688, 0.0, None]
    radians = df.limit(1).select(
        kf.miles_from_origin(F.lit(math.pi / 4), F.lit(math.pi / 2), degrees=False)
    )
    assert radians.first()[0] == pytest.approx(6214.0702688)


def bisected(lat, lon, precision=5):
    """Geohash by halving intervals."""
    digits = "0123456789bcdefghjkmnpqrstuvwxyz"
    bounds = {0: [-180.0, 180.0], 1: [-90.0, 90.0]}
    text, value = "", 0
    for place in range(5 * precision):
        low, high = bounds[place % 2]
        middle, at = (low + high) / 2, (lon, lat)[place % 2]
        value = value * 2 + (at >= middle)
        bounds[place % 2] = [middle, high] if at >= middle else [low, middle]
        if place % 5 == 4:
            text, value = text + digits[value], 0
    return text


def test_geohash_against_bisection(spark):
    points = [(42.6, -5.6), (57.64911, 10.40744), (90.0, 180.0), (-90.0, -180.0), (0.0, 0.0)]
    points += [((i * 37 % 1800) / 10 - 90, (i * 91 % 3600) / 10 - 180) for i in range(300)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, a double, o double")
    for precision in (5, 6):
        hashed = df.orderBy("i").select(kf.geohash(F.col("a"), F.col("o"), precision))
        assert [r[0] for r in hashed.collect()] == [bisected(*p, precision) for p in points]
    assert bisected(42.6, -5.6) == "ezs42"


def test_geohash_of_impossible_points(spark):
    df = spark.createDataFrame([(91.0, 0.0), (None, 0.0), (0.0, 181.0)], "a double, o double")
    found = [r[0] for r in df.select(kf.geohash(F.col("a"), F.col("o"))).collect()]
    assert found == [None, None, bisected(0.0, -179.0)]


def test_row_total_skips_missing(spark):
    df = spark.createDataFrame([(1, None, 3)], "a int, b int, c int")
    assert rows(df.select(kf.row_total(F.col("a"), F.col("b"), F.col("c")))) == [(4,)]
