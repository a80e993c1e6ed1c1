"""Tables for maps and rankings, made from scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbstone.functions import band_color, band_label, geohash, plain_number_text
from kerbstone.session import settle

LOCATION = ("lat", "long")


def scored_locations(
    scored: DataFrame,
    label: str = "Incident",
    lat: str = "LAT",
    lon: str = "LON",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(lat, long, scores, y, y_pred), plus the columns to ``keep``."""
    return scored.select(
        *keep,
        F.col(lat).alias("lat"),
        F.col(lon).alias("long"),
        "scores",
        F.col(label).cast("int").alias("y"),
        "y_pred",
    )


def clean_locations(locations: DataFrame, lowest_lat: float = -90.0) -> DataFrame:
    """Complete rows with a possible latitude."""
    return locations.na.drop("any").filter(F.col("lat") >= lowest_lat)


def marker_feed(locations: DataFrame, lowest_score: float | None = 0.7) -> DataFrame:
    """(lat, long, score, band, color, popup) of the complete rows scored high enough."""
    rows = locations.na.drop("any")
    score = F.col("scores")
    if lowest_score is not None:
        rows = rows.filter(score >= lowest_score)
    return rows.select(
        "lat",
        "long",
        score.alias("score"),
        band_label(score).alias("band"),
        band_color(score).alias("color"),
        F.concat(F.lit("Score: "), plain_number_text(score)).alias("popup"),
    )


def with_geohash(locations: DataFrame, precision: int = 5) -> DataFrame:
    return locations.withColumn("geohash", geohash(F.col("lat"), F.col("long"), precision))


# Coordinates are clustered as whole numbers of this fraction of a degree.
PER_DEGREE = 1_000_000


def _nearest(lat: Column, lon: Column, centres: Sequence[tuple[int, int]]) -> Column:
    """Number of the nearest centre by squared distance in degrees, the smaller one of equals."""
    squares = [
        F.struct(((lat - a) * (lat - a) + (lon - b) * (lon - b)).alias("d"), F.lit(i).alias("i"))
        for i, (a, b) in enumerate(centres)
    ]
    return F.array_min(F.array(*squares))["i"]


def cluster_centres(
    locations: DataFrame, k: int = 10, seed: int = 42, rounds: int = 100
) -> list[tuple[int, int]]:
    """Centres of ``k`` clusters by latitude and longitude, in millionths of a degree.

    Rows are first counted per place, so a round costs as much as there are places, and sends ``k`` sums from each
    task. The places with the least seeded hashes are the first centres; sums are whole numbers and rounded down, so
    neither the order nor the layout of rows plays a part. Stops when no centre moves. An empty cluster keeps its centre.
    """
    fixed = [F.round(F.col(c) * PER_DEGREE).cast("long").alias(f"_{c}") for c in LOCATION]
    places = settle(
        locations.na.drop("any", subset=list(LOCATION)).select(*fixed).groupBy("_lat", "_long").agg(F.count(F.lit(1)).alias("_n"))
    )
    name = F.concat_ws(":", F.lit(str(seed)), F.col("_lat").cast("string"), F.col("_long").cast("string"))
    first = places.orderBy(F.md5(name), "_lat", "_long").limit(k)
    centres = [(r["_lat"], r["_long"]) for r in first.collect()]
    for _ in range(rounds if centres else 0):
        weighted = [F.sum(F.col(c).cast("decimal(38,0)") * F.col("_n")).alias(c) for c in ("_lat", "_long")]
        sums = places.groupBy(_nearest(F.col("_lat"), F.col("_long"), centres).alias("i"))
        moved = list(centres)
        for r in sums.agg(F.sum("_n").alias("n"), *weighted).collect():
            moved[r["i"]] = (int(r["_lat"]) // r["n"], int(r["_long"]) // r["n"])
        if moved == centres:
            break
        centres = moved
    return centres


def with_clusters(locations: DataFrame, k: int = 10, seed: int = 42, rounds: int = 100) -> DataFrame:
    """Add ``cluster``, the k-means group of each row by latitude and longitude; null without a place."""
    centres = cluster_centres(locations, k, seed, rounds)
    lat, lon = (F.round(F.col(c) * PER_DEGREE).cast("long") for c in LOCATION)
    cluster = _nearest(lat, lon, centres) if centres else F.lit(None).cast("int")
    known = F.col(LOCATION[0]).isNotNull() & F.col(LOCATION[1]).isNotNull()
    return locations.withColumn("cluster", F.when(known, cluster))
