"""Top rows, running counts and exact ranks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbstone.session import settle


def top_k(df: DataFrame, score: str, tie: str, k: int = 20) -> DataFrame:
    """The k rows with the highest score; ``tie`` (unique, ascending) decides equals.

    Spark keeps k rows per task and merges those, without sorting the table.
    """
    return df.orderBy(F.col(score).desc_nulls_last(), F.col(tie).asc()).limit(k)


def in_ranges(df: DataFrame, order: Sequence[Column], sums: Mapping[str, str] = {}) -> DataFrame:
    """Add ``_number``, the place 1..n in ``order``, and running sums: column names by their new names.

    Rows are laid out in ranges of the order and written once to the shared folder. Places and sums are counted within each
    range; those of earlier ranges, one small row each, are added. No task sees more than its range.
    """
    laid = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    # A row per range that holds any.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = laid.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()]
    )
    before = totals.select(
        F.col("_part").alias("_of"),
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in totals.columns if c != "_part"],
    )
    down = Window.partitionBy("_part").orderBy(*order)
    sofar = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return laid.join(F.broadcast(before), F.col("_part") == F.col("_of")).select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.col("_rows") + F.row_number().over(down)).cast("long").alias("_number"),
        *[(F.col(f"_sum_{n}") + F.sum(c).over(sofar)).alias(n) for n, c in sums.items()],
    )


def running_hits(
    df: DataFrame, score: str, tie: str, hit: Column, k: int | None = 20
) -> DataFrame:
    """Rank 1..k by score with the number of hits so far: (rank, cumulative_hits, score, tie).

    ``k`` may be any number, None for all rows.
    """
    order = [F.col(score).desc_nulls_last(), F.col(tie).asc()]
    rows = df.select(score, tie, F.coalesce(hit.cast("long"), F.lit(0)).alias("_hit"))
    if k is not None and k <= FEW:
        rows = top_k(rows, score, tie, k)
    ranked = in_ranges(rows, order, {"cumulative_hits": "_hit"})
    ranked = ranked.select(F.col("_number").alias("rank"), "cumulative_hits", score, tie)
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def hits_in_top_k(df: DataFrame, score: str, tie: str, hit: Column, k: int = 100) -> DataFrame:
    """One row: how many of the k best scored rows are hits."""
    top = top_k(df.withColumn("_hit", hit), score, tie, k)
    return top.agg(F.count_if("_hit").alias("hits"))


# Up to so many rows Spark's own top-k is the shorter way: it keeps k rows per task.
FEW = 10_000


# A bucket table of at most this many narrow rows is broadcast; a larger one is joined as the planner
# sees fit.
BROADCAST_ROWS = 1_000_000

# Hex digits of a row's hash that name its bucket: 65,536 buckets per class, which
# bounds both the bucket table that is broadcast and, by 1/65,536 of the class, a bucket.
BUCKET_DIGITS = 4


def seeded_hash(id_column: Column, seed: int) -> Column:
    """A repeatable random order: md5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_column.cast("string")))


def bucket_ends(df: DataFrame, groups: Sequence[str], bucket: str) -> DataFrame:
    """(groups, bucket, n, before): rows per bucket and in all earlier buckets of the group."""
    sizes = df.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias("n"))
    earlier = (
        Window.partitionBy(*groups)
        .orderBy(bucket)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return sizes.withColumn("before", F.sum("n").over(earlier) - F.col("n"))


def hash_rank(
    df: DataFrame, id_column: str, seed: int, groups: Sequence[str] = (), name: str = "rank"
) -> DataFrame:
    """Exact rank 1..n of each row, within ``groups``, in the seeded random order.

    A plain window would put a whole group into one task. Here rows are ranked
    inside hash buckets, and the rows in earlier buckets are added. Rows of equal id share
    a bucket, so ids should be (nearly) unique.
    """
    hashed = df.withColumn("_hash", seeded_hash(F.col(id_column), seed)).withColumn(
        "_bucket", F.substring("_hash", 1, BUCKET_DIGITS)
    )
    by = [*groups, "_bucket"]
    inside = Window.partitionBy(*by).orderBy("_hash", id_column)
    ranked = hashed.withColumn("_inside", F.row_number().over(inside))
    ends = bucket_ends(hashed, groups, "_bucket").select(
        *[F.col(c).alias(f"_of_{i}") for i, c in enumerate(by)], "before"
    )
    same = [F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(by)]
    # Without groups there are 65,536 buckets at most; with them it depends on the columns.
    small = not groups or ends.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return ranked.join(F.broadcast(ends) if small else ends, same).select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.col("before") + F.col("_inside")).alias(name),
    )
