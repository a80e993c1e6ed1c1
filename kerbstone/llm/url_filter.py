"""URL verdicts from mined association rules and from a fixed rule list.

URLs of labelled pages become sets of tokens plus their class. Tokens that stand in the same labelled pages are one item, so a
template of many words in each URL doesn't unfold into all their combinations. FP-growth mines the frequent
combinations of items; of the rules "items -> block" those with enough support, confidence and odds are kept
unless a part of their items alone is as sure. An item occurs where any of its tokens does. A page is tested against the rules by an inverted
index: each rule is filed under its rarest item, only rules filed under one of the page's items
are candidates, and a candidate holds when all its items occur.

Defined results: a null url, or one without ``://``, has empty host and path, matches no list rule, and
takes the verdict of whatever tokens remain (none: allow). Repeated rows are judged alike, one result
each. Labels with null ids or of absent pages teach nothing; a page with several labels is bad if any
says so; null marks count as good. With no labelled page there are no mined rules and the list alone
decides. Columns beyond those read are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbstone.llm.common import lower_ascii, settled

BLOCK = "class=block"
ALLOW = "class=allow"


@dataclass(frozen=True)
class ListRule:
    """Action for a host, its subdomains, and paths that start with ``path``."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Mining:
    """``support``: share of labelled pages that hold the combination with the class, and
    ``pages``: their least number, whatever the share. ``confidence``: share of bad ones among labelled pages with the tokens. ``odds``: least ratio of
    their odds to be bad to those of the other pages; it guards against rules that only repeat a high share of bad pages, and can
    be reached whatever that share is."""

    support: float = 0.002
    pages: int = 10
    confidence: float = 0.5
    odds: float = 2.0


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 2), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens: labels of the host, words of the path, names in the query."""

    def marked(mark: str, words: Column) -> Column:
        return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(mark), w))

    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    words = F.concat(
        marked("host:", F.split(host_of(url), r"\.")),
        marked("path:", F.split(lower_ascii(path_of(url)), "[^a-z0-9\\x80-\\x{10FFFF}]+")),
        marked("query:", F.regexp_extract_all(query, F.lit("([^&=]+)(=[^&]*)?"), F.lit(1))),
    )
    return F.array_distinct(F.coalesce(words, F.array().cast("array<string>")))


def list_rule(host: Column, path: Column, rules: Sequence[ListRule]) -> Column:
    """The longest fitting rule as struct(length, rule, verdict), or null. The list is a
    parameter in the plan: for hand-kept lists, not for millions of hosts."""

    def fitting(rule: ListRule) -> Column:
        on_host = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        found = F.struct(
            F.lit(len(rule.text)).alias("length"),
            F.lit(rule.text).alias("rule"),
            F.lit(rule.action).alias("verdict"),
        )
        return F.when(on_host & F.startswith(path, F.lit(rule.path)), found)

    return F.array_max(F.array(*[fitting(r) for r in rules]))


@dataclass(frozen=True)
class Mined:
    """``rules``: (tokens, key, confidence, support) of the pruned block rules, on the heads of items; ``key``
    is a rule's rarest one. ``items``: (token, head) of all frequent tokens."""

    rules: DataFrame
    items: DataFrame


def items_of(baskets: DataFrame, least: int) -> DataFrame:
    """(token, head): tokens of ``least`` baskets (_row, _t) or more; those of the same baskets share a head.

    Equal sets of baskets have equal sums of two hashes of their rows, added up before the shuffle.
    """
    sums = [F.sum(F.xxhash64("_row", F.lit(seed)).cast("decimal(38,0)")).alias(f"s{seed}") for seed in (1, 2)]
    counted = (
        baskets.select("_row", F.explode("_t").alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"), *sums)
        .filter(F.col("n") >= least)
    )
    alike = ["n", "s1", "s2"]
    heads = counted.groupBy(*alike).agg(F.min("token").alias("head"))
    return settled(counted.join(heads, alike).select("token", "head"), "url-items")


def odds_ratio(bad: Column, good: Column, all_bad: Column, all_good: Column) -> Column:
    """Odds to be bad with the tokens against those without, each count half a page higher."""
    with_tokens = (bad + 0.5) / (good + 0.5)
    return with_tokens / ((all_bad - bad + 0.5) / (all_good - good + 0.5))


def mine_rules(pages: DataFrame, labels: DataFrame, mining: Mining = Mining()) -> Mined:
    """Rules from the labelled pages; at most as many as frequent combinations of items."""
    spark = pages.sparkSession
    marks = labels.groupBy(F.col("doc_id").alias("_id")).agg(
        F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias(
            "bad"
        )
    )
    labelled = pages.select(F.col("page_id").alias("_id"), url_tokens(F.col("url")).alias("_t"))
    rows = labelled.join(marks, "_id").select(F.monotonically_increasing_id().alias("_row"), "_t", "bad")
    rows = settled(rows, "url-baskets")
    n, bad = rows.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    if n == 0:
        schema = "tokens array<string>, key string, confidence double, support double"
        none = spark.createDataFrame([], "token string, head string")
        return Mined(spark.createDataFrame([], schema), none)
    support = min(1.0, max(mining.support, mining.pages / n))
    items = items_of(rows, math.ceil(support * n))
    heads = (
        rows.select("_row", F.explode("_t").alias("token"))
        .join(items, "token")
        .groupBy("_row")
        .agg(F.collect_set("head").alias("heads"))
    )
    known = F.coalesce("heads", F.array().cast("array<string>"))
    classed = rows.join(heads, "_row", "left").select(
        F.array_append(known, F.when(F.col("bad"), BLOCK).otherwise(ALLOW)).alias("items")
    )
    baskets = settled(classed, "url-items-of-pages")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=mining.confidence).fit(
        baskets
    )
    single = model.freqItemsets.filter(F.size("items") == 1)
    rarity = single.select(F.col("items")[0].alias("token"), "freq")
    hits = F.round(F.col("support") * n)
    misses = F.round(F.col("support") * n / F.col("confidence")) - hits
    odds = odds_ratio(hits, misses, F.lit(float(bad)), F.lit(float(n - bad)))
    rules = settled(
        model.associationRules.filter(
            (F.col("consequent")[0] == BLOCK)
            & (odds >= mining.odds)
            & ~F.array_contains("antecedent", ALLOW)
        ).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"),
        "url-rules",
    )
    rarest = (
        rules.select("tokens", F.explode("tokens").alias("token"))
        .join(rarity, "token")
        .groupBy("tokens")
        .agg(F.min(F.struct("freq", "token"))["token"].alias("key"))
    )
    keyed = rules.join(rarest, "tokens").select("tokens", "key", "confidence", "support")
    needless = (
        keyed.select("tokens", "confidence", F.explode("tokens").alias("key"))
        .join(
            keyed.select(
                "key", F.col("tokens").alias("part"), F.col("confidence").alias("part_confidence")
            ),
            "key",
        )
        .filter(
            (F.size("part") < F.size("tokens"))
            & (F.col("part_confidence") >= F.col("confidence"))
            & (F.size(F.array_except("part", "tokens")) == 0)
        )
        .select("tokens")
    )
    return Mined(settled(keyed.join(needless, "tokens", "left_anti"), "url-index"), items)


def blocked_urls(pages: DataFrame, mined: Mined) -> DataFrame:
    """Distinct urls that some mined rule blocks, with the confidence of the surest."""
    held = mined.rules.select(F.explode("tokens").alias("head")).distinct()
    # Only items that stand in a rule are looked for.
    items = mined.items.join(held, "head", "left_semi")
    tokens = (
        pages.filter(F.col("url").isNotNull())
        .select("url")
        .distinct()
        .select("url", F.explode(url_tokens(F.col("url"))).alias("token"))
        .join(items, "token")
        .groupBy("url")
        .agg(F.collect_set("head").alias("_t"))
        .select("url", "_t", F.explode("_t").alias("key"))
    )
    found = tokens.join(mined.rules, "key").filter(F.size(F.array_except("tokens", "_t")) == 0)
    return found.groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[ListRule] = (),
    mining: Mining = Mining(),
) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence), one row per row of ``pages``.

    ``confidence`` is that of the surest mined rule that holds, also where the list overrules it.
    A url may be on a third of all rows: urls are judged once each, and only the
    join back meets the repeats, as a left side that AQE can split.
    """
    slim = pages.select("page_id", "url")
    found = blocked_urls(slim, mine_rules(slim, labels, mining))
    judged = slim.join(found, "url", "left").withColumns(
        {"host": host_of(F.col("url")), "path": path_of(F.col("url"))}
    )
    listed = judged.withColumn(
        "_rule", list_rule(F.col("host"), F.col("path"), rules) if rules else F.lit(None)
    )
    if not rules:
        listed = listed.withColumn("_rule", F.lit(None).cast("struct<rule:string,verdict:string>"))
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return listed.select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), mined).alias("verdict"),
        "confidence",
    )
