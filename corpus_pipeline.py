"""The corpus pipeline: stages over documents, each written and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbstone.llm import decontaminate, langid, line_dedup, packing, simhash
from kerbstone.llm.common import settled, table
from kerbstone.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of ambiguous language, go."""
    return langid.drop_unidentified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; a document that loses some gets its new length."""
    cleaned = line_dedup.drop_boilerplate(docs)
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
    return cleaned.withColumn("n_chars", F.coalesce(changed, "n_chars")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the least id. Near are fingerprints of three-word
    shingles that differ in three bits or fewer, linked through others where need be."""
    return simhash.drop_near_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", one_of_each),
    ("decontamination", decontaminated),
    ("packing", packed),
]

# The stages fit a model, cluster and tokenize, which SQL can't express; tests/llm checks them otherwise.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name)
    return docs
