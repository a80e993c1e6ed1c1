"""Cross-site boilerplate lines, found by the spread of each line over sites.

The lines of all documents are hashed. Only a line with at least ``min_sites`` occurrences can be
spread over so many sites, so plain counts leave few lines in question. For these a HyperLogLog
sketch of the sites is built per hash, in parts that merge by aggregation. Lines whose estimate is
well above the threshold are boilerplate, those well below are not, and those near it get an exact
distinct count. Every occurrence of a boilerplate line goes but the first of the corpus (smallest
document id, then place).

Defined results: lines end at line feeds and are compared without white space around them; blank
lines stay; a null source is no site; a null text stays null; documents equal in id and text get
equal results (so the first of them keeps its line in each repeat), and a null id counts as the
largest. Text that loses nothing is returned byte for byte. Further columns stay as they are, but for
``n_lines`` and ``n_removed``, which are replaced. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbstone.llm.common import keyed_rows, row_key, settled

MIN_SITES = 8
LOG_REGISTERS = 12
# The sketch's standard error is about 1.04 / sqrt(2 ** LOG_REGISTERS); the margin is five times that.
MARGIN = 5 * 1.04 / 2 ** (LOG_REGISTERS / 2)


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def _hash(line: Column) -> Column:
    return F.unhex(F.md5(line))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """(key, doc_id, source, at, line): every line that isn't blank, as a hash."""
    placed = docs.select(
        row_key(F.col("doc_id"), F.col("text")).alias("key"),
        "doc_id",
        "source",
        F.posexplode(_lines("text")).alias("at", "_line"),
    ).withColumn("_line", _bare(F.col("_line")))
    return placed.filter(F.col("_line") != "").select(
        "key", "doc_id", "source", "at", _hash(F.col("_line")).alias("line")
    )


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line, first_id, first_at) of the lines on ``min_sites`` sites or more."""
    lines = hashed_lines(docs)
    # Necessary, and countable with nothing but a partial aggregate per task.
    frequent = settled(
        lines.groupBy("line")
        .agg(
            F.count("source").alias("n"),
            F.min("source").alias("a"),
            F.max("source").alias("b"),
        )
        .filter((F.col("n") >= min_sites) & ((F.col("a") != F.col("b")) | F.lit(min_sites <= 1)))
        .select("line"),
        "frequent-lines",
    )
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")
    sites = settled(
        lines.join(frequent, "line").groupBy("line", "source").agg(F.min(first).alias("first")),
        "line-sites",
    )
    sketch = F.hll_sketch_agg("source", F.lit(LOG_REGISTERS))
    sketched = settled(
        sites.groupBy("line").agg(
            F.hll_sketch_estimate(sketch).alias("sites"), F.min("first").alias("first")
        ),
        "line-spread",
    )
    slack = max(1.0, MARGIN * min_sites)
    far = sketched.filter(F.col("sites") > min_sites + slack).select("line", "first")
    near = sketched.filter(F.abs(F.col("sites") - min_sites) <= slack).select("line", "first")
    counted = (
        sites.select("line", "source")
        .join(near.select("line"), "line")
        .groupBy("line")
        .agg(F.count("source").alias("n"))
        .filter(F.col("n") >= min_sites)
        .select("line")
    )
    return far.unionByName(near.join(counted, "line")).select(
        "line", F.col("first.doc_id").alias("first_id"), F.col("first.at").alias("first_at")
    )


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with the repeated boilerplate taken out of ``text``, and ``n_lines`` and ``n_removed``.

    Only places of lines are shuffled to find what goes; the texts move once, to meet it.
    """
    spread = settled(boilerplate(docs, min_sites), "boilerplate")
    going = (
        hashed_lines(docs)
        .join(spread, "line")
        .filter(~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("at") == F.col("first_at"))))
        .groupBy("key")
        .agg(F.collect_set("at").alias("_going"))
        .withColumnRenamed("key", "_key")
    )
    lines = _lines("_row.text")
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.transform(F.array_except(places, F.col("_going")), lambda i: F.get(lines, i))
    gone = F.coalesce(F.size("_going"), F.lit(0))
    joined = keyed_rows(docs).join(going, "_key", "left")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    text = F.when(F.col("_going").isNull(), F.col("_row.text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in names],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("_going").isNull(), 0).otherwise(gone).cast("long").alias("n_removed"),
    )
