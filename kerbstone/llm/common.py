"""Small expressions and helpers that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbstone.session import scratch_path

# A table of at most this many narrow rows may be broadcast; callers count first.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back.

    Cuts the lineage through files that outlive executors, and gives the planner
    the true size, by which it may or may not broadcast.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def row_key(doc_id: Column, text: Column) -> Column:
    """Stands for the content of a document row. Rows equal in id and text share it, and
    what is computed from these two columns alone holds for all of them."""
    tagged = F.coalesce(F.concat(F.lit("i"), doc_id.cast("string")), F.lit("n"))
    return F.unhex(F.sha2(F.concat(tagged, F.lit("\n"), F.coalesce(text, F.lit(""))), 256))


def id_text(doc_id: Column) -> Column:
    """An id as text, a null one as empty text."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def id_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``."""
    return (F.crc32(id_text(doc_id).cast("binary")) % buckets).cast("int")


def usable(vector: Column, width: int | None = None) -> Column:
    """Whether a vector is there, with finite components only (and the given length)."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    right = F.size(vector) == width if width else F.size(vector) > 0
    return F.coalesce(vector.isNotNull() & right & ~bad, F.lit(False))


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(_row, _key): whole rows as structs, so that their columns can't clash with others."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(whole.alias("_row"), row_key(F.col("doc_id"), F.col("text")).alias("_key"))
