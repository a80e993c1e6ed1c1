"""Exact, repeatable splits of a labelled table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbstone.operators.ranking import BUCKET_DIGITS, bucket_ends, hash_rank, seeded_hash

SEED = 42
TEST_SHARE = 0.33
FOLDS = 5


def mark_test(
    df: DataFrame,
    id_column: str,
    label: str,
    share: float = TEST_SHARE,
    seed: int = SEED,
    name: str = "is_test",
) -> DataFrame:
    """Add 1/0: the first ``ceil(share * n)`` rows of each class by seeded hash are test rows.

    The table itself is not shuffled. Only the hash of the last test row of each
    class is searched: bucket sizes tell the bucket it lies in, and just the
    rows of that bucket are ranked. Each row is then compared with it.
    """
    hashed = df.withColumn("_hash", seeded_hash(F.col(id_column), seed)).withColumn(
        "_bucket", F.substring("_hash", 1, BUCKET_DIGITS)
    )
    rows = hashed.select(F.col(label).alias("_class"), "_bucket", "_hash")
    ends = bucket_ends(rows, ["_class"], "_bucket")
    whole = Window.partitionBy("_class")
    wanted = F.ceil(F.sum("n").over(whole) * F.lit(share))
    edge = ends.withColumn("wanted", wanted).filter(
        (F.col("before") < F.col("wanted")) & (F.col("wanted") <= F.col("before") + F.col("n"))
    )
    edge = edge.select(
        F.col("_class").alias("_edge_class"),
        F.col("_bucket").alias("_edge_bucket"),
        (F.col("wanted") - F.col("before")).alias("_place"),
    )
    inside = Window.partitionBy("_class").orderBy("_hash")
    last = (
        rows.join(
            F.broadcast(edge),
            F.col("_class").eqNullSafe(F.col("_edge_class"))
            & (F.col("_bucket") == F.col("_edge_bucket")),
        )
        .withColumn("_rank", F.row_number().over(inside))
        .filter(F.col("_rank") == F.col("_place"))
        .select(F.col("_edge_class"), F.col("_hash").alias("_last_hash"))
    )
    return hashed.join(
        F.broadcast(last), F.col(label).eqNullSafe(F.col("_edge_class")), "left"
    ).select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.coalesce(F.col("_hash") <= F.col("_last_hash"), F.lit(False)).cast("int").alias(name),
    )


def mark_folds(
    df: DataFrame,
    id_column: str,
    label: str,
    folds: int = FOLDS,
    seed: int = SEED,
    name: str = "fold",
) -> DataFrame:
    """Add the fold 0..folds-1 of each row; fold sizes differ by one per class at most."""
    ranked = hash_rank(df, id_column, seed, [label], "_rank")
    return ranked.withColumn(name, ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")


def shuffle_rows(df: DataFrame, id_column: str, seed: int = SEED) -> DataFrame:
    """The rows in a seeded random order."""
    return df.orderBy(seeded_hash(F.col(id_column), seed), id_column)
