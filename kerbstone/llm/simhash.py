"""Near-duplicates by SimHash fingerprints and a Gray-order hierarchical index.

Distinct fingerprints are filed under masked bit patterns they share: if two differ in at most
three of some bits, they agree on at least one of any four parts of these bits. The first level takes
the four quarters of the 64 bits; a pattern with more than ``MOST_IN_NODE`` fingerprints is divided again by four parts
of its free bits, and so on. After five levels at most 16 bits are free, so no node can exceed
2 ** 16 fingerprints, whatever the data.

Within a node the fingerprints lie in Gray rank, so that neighbours share long patterns. Runs of 16 get an upper node that
holds the bits all of them share, runs of 16 of these the next, up to one root. Pairs of nodes are
compared from the top: the differences on shared bits add up on the way down, and above the limit
the pair is pruned with all below it. What is left is compared bit by bit. Of the links found, each node passes on a forest
that connects the same fingerprints, so that groups of near copies don't unfold into pairs.

Defined results: a null text is empty; texts without words have fingerprint zero and link like any other.
Repeated rows are rows of their own in :func:`group`; :func:`drop_near_copies` keeps one of them. The component id is the least
non-null document id of the component, null if there is none. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbstone.llm.common import keyed_rows, row_key, settled
from kerbstone.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 3
PARTS = DISTANCE + 1
MOST_IN_NODE = 1 << 16
FANOUT = 16
_SLICE = 1_000_000
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


# --- fingerprints ---------------------------------------------------------------------------


def _word_runs(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in runs of bounded size."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, min(at + _SLICE, len(text)))
        end = cut.start() if cut else len(text)
        yield text[at:end].lower().split()
        at = end + 1


def _hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words joined by blanks."""
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[shingle - 1 :], strict=False)
    return np.array([digest(joined[a : b - 1], SEED) for a, b in spans], np.uint64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if more than half of the shingles' hashes have it set."""
    ones, total, tail = np.zeros(64, np.int64), 0, []
    for run in _word_runs(text or b""):
        words = tail + run
        if len(words) >= shingle:
            hashes = _hashes(words, shingle)
            bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
            ones += bits.sum(0, dtype=np.int64)
            total += len(hashes)
            tail = words[len(words) - shingle + 1 :] if shingle > 1 else []
        else:
            tail = words
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _printed(shingle: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array(
                [fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64
            )
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(found.view(np.int64))], [*kept, "fp"]
            )

    return prints


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, key, fp): one row per document row; ``fp`` holds the 64 bits as a long."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(
        "doc_id",
        row_key(F.col("doc_id"), F.col("text")).alias("key"),
        F.col("text").cast("binary").alias("text"),
    ).mapInArrow(_printed(shingle), f"doc_id {id_type}, key binary, fp long")


# --- index ----------------------------------------------------------------------------------


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def refinements(mask: int) -> list[int]:
    """``mask`` with one of the parts of its free bits added, for each part."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [round(k * len(free) / PARTS) for k in range(PARTS + 1)]
    return [
        mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)
    ]


def gray_rank(fp: Column) -> Column:
    """Place of a bit pattern in Gray order, as a long that sorts in this order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _filed(rows: DataFrame, masks: list[int]) -> DataFrame:
    """File the rows of nodes with these masks one level deeper: (mask, pattern, fp)."""
    deeper = rows.sparkSession.createDataFrame(
        [(_signed(m), [_signed(c) for c in refinements(m)]) for m in masks],
        "mask long, deeper array<long>",
    )
    # At most PARTS ** 4 rows.
    filed = rows.join(F.broadcast(deeper), "mask").select("fp", F.explode("deeper").alias("mask"))
    return filed.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"), "fp")


def index_nodes(distinct: DataFrame, most: int = MOST_IN_NODE) -> DataFrame:
    """(mask, pattern, fp): nodes that hold every linked pair, of at most ``most`` fingerprints or
    at most 16 free bits.

    ``distinct`` has one row per fingerprint. Only nodes that are too large go one level deeper.
    """
    masks = [0]
    rows = distinct.select("fp", F.lit(0).cast("long").alias("mask"))
    nodes: DataFrame | None = None
    while True:
        level = settled(_filed(rows, masks), "index-level")
        masks = [child for mask in masks for child in refinements(mask)]
        last = all(64 - mask.bit_count() <= 16 for mask in masks)
        large = settled(
            level.groupBy("mask", "pattern")
            .agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > most)
            .select("mask", "pattern"),
            "large-nodes",
        )
        if last or large.isEmpty():
            return level if nodes is None else nodes.unionByName(level)
        done = level.join(large, ["mask", "pattern"], "left_anti")
        nodes = done if nodes is None else nodes.unionByName(done)
        rows = level.join(large, ["mask", "pattern"], "left_semi").select("fp", "mask")


class _Forest:
    """Union of linked rows; a row's root is the least row it is connected with."""

    def __init__(self, size: int) -> None:
        self.parent = np.arange(size)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        found = self.parent[rows]
        while True:
            above = self.parent[found]
            if np.array_equal(above, found):
                return found
            found = above

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        while len(left):
            left, right = self.roots(left), self.roots(right)
            apart = left != right
            left, right = left[apart], right[apart]
            np.minimum.at(self.parent, np.maximum(left, right), np.minimum(left, right))


def _tree(fps: np.ndarray, starts: np.ndarray):
    """Levels from the rows up to one root per group: (shared ones, any ones, first child, end)."""
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(fps))))
    every, some = fps, fps
    levels = [(every, some, None, None)]
    while len(every) > len(starts):
        begins = np.searchsorted(group, np.arange(len(starts)))
        within = np.arange(len(every)) - begins[group]
        first = np.flatnonzero(within % FANOUT == 0)
        every = np.bitwise_and.reduceat(every, first)
        some = np.bitwise_or.reduceat(some, first)
        levels.append((every, some, first, np.append(first[1:], len(group))))
        group = group[first]
    return levels


def connected(fps: np.ndarray, starts: np.ndarray, distance: int) -> np.ndarray:
    """For each row the least row it is connected with inside its group, by steps of at most
    ``distance`` bits. Groups begin at ``starts``; rows are in Gray order within each."""
    forest = _Forest(len(fps))
    levels = _tree(fps, starts)
    top = len(levels) - 1
    if top == 0:
        return forest.parent
    sizes = np.diff(np.append(starts, len(fps)))
    roots = np.flatnonzero(sizes > 1)
    waiting = [(top, roots, roots)]
    while waiting:
        level, left, right = waiting.pop()
        if len(left) > 4096:
            waiting += [
                (level, left[k : k + 4096], right[k : k + 4096]) for k in range(0, len(left), 4096)
            ]
            continue
        _, _, first, end = levels[level]
        every, some = levels[level - 1][:2]
        wide = end[right] - first[right]
        pairs = (end[left] - first[left]) * wide
        which = np.repeat(np.arange(len(left)), pairs)
        nth = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        i = first[left][which] + nth // wide[which]
        j = first[right][which] + nth % wide[which]
        ordered = i < j if level == 1 else i <= j
        i, j = i[ordered], j[ordered]
        # On rows the shared bits are all bits, and this is their distance.
        differ = every[i] & ~some[j] | every[j] & ~some[i]
        near = np.bitwise_count(differ) <= distance
        i, j = i[near], j[near]
        if level == 1:
            forest.link(i, j)
        elif len(i):
            waiting.append((level - 1, i, j))
    return forest.roots(np.arange(len(fps)))


_ROWS = 1 << 17


def _linked(distance: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def emit(upto_last: bool) -> Iterator[pa.RecordBatch]:
            mask, pattern, fp = (np.concatenate(c) for c in zip(*held, strict=True))
            new = np.flatnonzero((np.diff(mask) != 0) | (np.diff(pattern) != 0)) + 1
            starts = np.append(0, new)
            held.clear()
            if upto_last:  # the last node may go on in the next batch
                cut = starts[-1]
                held.append((mask[cut:], pattern[cut:], fp[cut:]))
                fp, starts = fp[:cut], starts[:-1]
            if len(fp):
                root = connected(fp.view(np.uint64), starts, distance)
                moved = np.flatnonzero(root != np.arange(len(root)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp[moved]), pa.array(fp[root[moved]])], ["a", "b"]
                )

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(n).to_numpy() for n in ("mask", "pattern", "fp")))
            if sum(len(h[0]) for h in held) > max(_ROWS, 2 * len(held[0][0]) if held else 0):
                yield from emit(True)
        if held:
            yield from emit(False)

    return link


def links(distinct: DataFrame, distance: int = DISTANCE, most: int = MOST_IN_NODE) -> DataFrame:
    """(a, b): a forest per index node; together they connect what fingerprints at most
    ``distance`` bits apart connect."""
    nodes = index_nodes(distinct, most).withColumn("rank", gray_rank(F.col("fp")))
    together = nodes.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern", "rank")
    return together.drop("rank").mapInArrow(_linked(distance), "a long, b long")


def _grouped(prints: DataFrame, most: int) -> DataFrame:
    """Add ``component_id`` to (doc_id, key, fp)."""
    distinct = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    joined = components(links(distinct, most=most)).withColumnRenamed("a", "fp")
    members = settled(
        distinct.join(joined, "fp", "left").select("fp", "least", F.coalesce("b", "fp").alias("root")),
        "members",
    )
    named = members.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(members.select("fp", "root").join(named, "root").drop("root"), "fp")


def group(docs: DataFrame, most: int = MOST_IN_NODE) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document row."""
    prints = settled(fingerprints(docs).drop("key"), "prints")
    return _grouped(prints, most).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, most: int = MOST_IN_NODE) -> DataFrame:
    """One row of each component, that of the least document id (null last), as it is."""
    prints = settled(fingerprints(docs), "prints")
    # A component may lack an id, so it is told apart by its least fingerprint here.
    distinct = settled(prints.select("fp").distinct().withColumn("least", F.lit(0)), "distinct")
    joined = components(links(distinct, most=most)).withColumnRenamed("a", "fp")
    rooted = prints.join(joined, "fp", "left").withColumn("root", F.coalesce("b", "fp"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    best = rooted.groupBy("root").agg(F.min(order)["key"].alias("_key"))
    copies = prints.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("_copies"))
    kept = settled(best.select("_key").join(copies, "_key"), "kept-rows")
    keyed = keyed_rows(docs).join(kept, "_key")
    if kept.filter("_copies > 1").isEmpty():
        return keyed.select("_row.*")
    # Rows equal in id and text: any of them stands for all.
    single = keyed.filter("_copies = 1").select("_row.*")
    repeated = keyed.filter("_copies > 1").dropDuplicates(["_key"]).select("_row.*")
    return single.unionByName(repeated)
