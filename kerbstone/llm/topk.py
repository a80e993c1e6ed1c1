"""Exact top-k inner products with an M-tree on Spark.

Vectors become points of a metric space in which the largest inner product is the least distance: each gets one
more coordinate that brings it to the largest norm of all, queries get a zero there. The tree has cells (around
pivots taken from the table), shards of a cell with a bounded number of vectors, and pages of a shard. Cells,
shards and pages are metric nodes with a routing point and a covering radius, and page entries keep
the distance to their routing point.

Queries stand in bounded blocks. Each block first searches one shard of its own cell, which gives every query an
upper bound for its k-th distance; then it is sent to those groups of shards only that hold a cell which the triangle
inequality doesn't rule out. A group has neighbouring cells, and vectors of a bounded size in memory: one task holds a group and
meets one block after the other, so a block is sent once to a group and not once to each shard. Where groups are few,
the blocks are dealt into tiles, and each tile has its own copy of the groups. No side of this is ever broadcast.

Within a shard or group pages come best first, by the least distance any query of the
block could find there. A page is left out if its radius proves it too far, and an entry if its stored distance does, without
computing theirs; where hardly a page is ruled out, the block meets many pages in one matrix product. Work on one block and one
group is bounded; their number grows with queries times rows only as far as the bounds don't prune.

Defined results: a vector that is null, or holds a null or a non-finite component, takes no part, nor does a
row without id. Shorter vectors are filled up with zeros. A query never meets rows of its own id; of
several rows with one id the least vector asks, and each is a candidate for others. Ties go to the smaller id, and
equal rows tie fully. Fewer candidates than k give fewer rows. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbstone.llm.common import settled

SCALE = 64
K = 20
PIVOTS = 1024  # at most so many cells, and rows read to the driver
CELL = 4096  # rows a cell should have
SHARD = 1500
PAGE = 128
BLOCK = 400
RUN = 64  # pages compared before bounds are looked at again
GROUP = 1 << 25  # bytes of vectors a group of shards may have
GROUPS = 12  # at least so many, if there are shards enough
TASKS = 48  # pairs of groups and tiles wanted; few groups get more tiles
# Distances are rounded; bounds give way by this share of the largest distance.
SLACK = 1e-7


def quantized(embedding: Column) -> Column:
    """Integers floor(SCALE * x), or null where a component is null or not finite."""
    broken = F.exists(
        embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return F.when(~broken, whole)


def vectors_of(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    rows = embeddings.select("vec_id", quantized(F.col("embedding")).alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, filled up with zeros to ``width``."""
    flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    sizes = np.diff(ends)
    result = np.zeros((len(lists), width), np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    result[row, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return result


class Space:
    """The metric space: ``square`` is the largest squared norm, ``width`` the dimension."""

    def __init__(self, width: int, square: float) -> None:
        self.width, self.square = width, square
        self.slack = SLACK * (1 + 2 * square**0.5)
        # Below 2 ** 53 the sums of products are exact in double precision, up to 2 ** 24 in single.
        self.exact = square < 2.0**52
        self.kind = np.float32 if square <= 2.0**24 else np.float64 if self.exact else np.int64
        # The least type that holds every component.
        fits = (t for t in (np.int8, np.int16, np.int32) if square**0.5 + 1 < np.iinfo(t).max)
        self.narrow = next(fits, np.int64)

    def points(self, vectors: np.ndarray) -> np.ndarray:
        point = vectors.astype(float)
        rest = np.sqrt(np.maximum(self.square - (point**2).sum(1), 0))
        return np.column_stack([point, rest])

    def asking(self, queries: np.ndarray) -> np.ndarray:
        return np.column_stack([queries.astype(float), np.zeros(len(queries))])

    def scores(self, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        return queries.astype(self.kind, copy=False) @ vectors.astype(self.kind, copy=False).T

    def reach(self, norms: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The distance at which a vector has the given score; ``norms`` are the queries', squared."""
        return np.sqrt(np.maximum(norms + self.square - 2 * scores, 0)) + self.slack


def squares(vectors: np.ndarray) -> np.ndarray:
    return (vectors.astype(float) ** 2).sum(1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


# --- tree -----------------------------------------------------------------------------------


def _assigning(shared):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, pivots = shared.value
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column("v"), space.width)
                away = distances(space.points(vectors), pivots)
                cell = away.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns,
                        pa.array(cell.astype(np.int32)),
                        pa.array(away[np.arange(len(cell)), cell]),
                    ],
                    [*batch.schema.names, "cell", "away"],
                )

    return assign


def build_shard(space: Space, ids: np.ndarray, vectors: np.ndarray) -> dict:
    """Pages of a shard around points of its own, chosen far from each other."""
    points = space.points(vectors)
    wanted = -(-len(points) // PAGE)
    routing = [0]
    nearest = distances(points, points[:1])[:, 0]
    while len(routing) < wanted and nearest.max() > 0:
        routing.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(points, points[routing[-1:]])[:, 0])
    away = distances(points, points[routing])
    page = away.argmin(1)
    away = away[np.arange(len(page)), page]
    # Pages in a row, entries by distance to the routing point; crowded ones go on in more pages.
    order = np.lexsort((away, page))
    cuts = [0]
    for k in range(1, len(order)):
        if page[order[k]] != page[order[k - 1]] or k - cuts[-1] == PAGE:
            cuts.append(k)
    return {
        "ids": ids[order],
        "vectors": vectors[order].astype(space.narrow),
        "away": away[order],
        "starts": np.array(cuts),
        "ends": np.array([*cuts[1:], len(order)]),
        "routing": points[routing][page[order[cuts]]],
    }


def _building(space: Space):
    def build(table: pa.Table) -> pa.Table:
        shard = build_shard(
            space,
            table["vec_id"].to_numpy(),
            _matrix(table["v"].combine_chunks(), space.width),
        )
        return pa.table(
            {
                "cell": table["cell"][:1].cast(pa.int32()),
                "shard": table["shard"][:1].cast(pa.int32()),
                "group": table["group"][:1].cast(pa.int32()),
                "tree": pa.array([pickle.dumps(shard)], pa.binary()),
            }
        )

    return build


# --- search ---------------------------------------------------------------------------------


class Best:
    """The k best (score, id) of each query so far, and its k-th as ``floor`` and ``limit``."""

    def __init__(self, k: int, floor: np.ndarray, limit: np.ndarray, exact: bool) -> None:
        self.k, self.floor, self.limit, self.exact = k, floor.copy(), limit.copy(), exact
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = self.held = 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Candidates, of which those behind the k-th found so far are left out."""
        good = (score > self.floor[query]) | (ids <= self.limit[query])
        self.parts.append((query[good], ids[good], score[good]))
        self.size += int(good.sum())
        if self.size > max(2 * self.held, 4 * self.k * len(self.floor)):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            none = np.zeros(0, np.int64)
            return none, none, none.astype(float)
        if len(self.parts) > 1 or self.size > self.held:
            query, ids, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            order = np.lexsort((ids, -score, query))
            query, ids, score = query[order], ids[order], score[order]
            first = np.flatnonzero(np.diff(query, prepend=-1))
            rank = np.arange(len(query)) - np.repeat(first, np.diff(first, append=len(query)))
            last = rank == self.k - 1
            self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last])
            if self.exact:  # else floors are rounded, and equal ones no ties
                self.limit[query[last]] = ids[last]
            kept = rank < self.k
            self.parts = [(query[kept], ids[kept], score[kept])]
            self.size = self.held = int(kept.sum())
        return self.parts[0]


def search_shard(space: Space, shard: dict, block: dict, k: int):
    """(query place, id, score) of each query's k best in the shard or group that reach its floor, and these as ``Best``."""
    queries, norms = block["vectors"].astype(space.kind), squares(block["vectors"])
    limit = block.get("limit", np.full(len(queries), np.iinfo(np.int64).max))
    best = Best(k, block["floor"], limit, space.exact)
    to_page = distances(space.asking(block["vectors"]), shard["routing"])
    starts, ends = shard["starts"], shard["ends"]
    least = np.maximum(to_page - shard["away"][ends - 1], 0)
    order = least.min(0).argsort(kind="stable")

    def meet(asks: np.ndarray, part: np.ndarray | slice) -> None:
        score = space.scores(queries[asks], shard["vectors"][part])
        floor = best.floor[asks].astype(score.dtype if space.exact else float)
        hit = np.flatnonzero(score >= floor[:, None])
        q, v = np.divmod(hit, score.shape[1])
        q, ids = asks[q], shard["ids"][part][v]
        other = ids != block["ids"][q]
        best.add(q[other], ids[other], score.ravel()[hit[other]])

    most = max(1, min(RUN, GROUP // (8 * PAGE * space.width)))
    done, run = 0, most if np.isfinite(best.floor).all() else 1
    while done < len(order):
        pages = order[done : done + run]
        done, run = done + run, min(2 * run, most)
        reach = space.reach(norms, best.floor)
        near = least[:, pages] <= reach[:, None]
        pages, near = pages[near.any(0)], near[:, near.any(0)]
        asks = np.flatnonzero(near.any(1))
        if not len(asks):
            continue
        if len(pages) > 1 and 2 * np.count_nonzero(near) > len(asks) * len(pages):
            meet(asks, np.concatenate([np.arange(starts[p], ends[p]) for p in pages]))
        else:
            for p, page in enumerate(pages):
                asks = np.flatnonzero(near[:, p])
                inner = (to_page[asks, page] - reach[asks]).min()
                outer = (to_page[asks, page] + reach[asks]).max()
                away = shard["away"][starts[page] : ends[page]]
                a = starts[page] + np.searchsorted(away, inner)
                z = starts[page] + np.searchsorted(away, outer, "right")
                if a < z:
                    meet(asks, slice(a, z))
        if best.size > 1.25 * best.held:
            best.settle()
    return best.settle(), best


def join_shards(shards: list[dict]) -> dict:
    """A group: the shards' pages side by side."""
    begin = np.cumsum([0, *(len(s["ids"]) for s in shards)])[:-1]
    group = {
        name: np.concatenate([s[name] for s in shards])
        for name in ("ids", "vectors", "away", "routing")
    }
    for name in ("starts", "ends"):
        group[name] = np.concatenate([s[name] + n for s, n in zip(shards, begin, strict=True)])
    return group


def _blocking(space: Space):
    def gather(table: pa.Table) -> pa.Table:
        vectors = _matrix(table["v"].combine_chunks(), space.width)
        block = {
            "ids": table["vec_id"].to_numpy(),
            "vectors": vectors.astype(space.narrow),
            "floor": np.full(len(vectors), -np.inf),
            "limit": np.full(len(vectors), np.iinfo(np.int64).max),
        }
        return pa.table(
            {
                "cell": table["cell"][:1].cast(pa.int32()),
                "block": table["block"][:1].cast(pa.int32()),
                "queries": pa.array([pickle.dumps(block)], pa.binary()),
            }
        )

    return gather


def _first_round(space: Space, k: int):
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for tree, queries in zip(batch.column("tree"), batch.column("queries"), strict=True):
                # A shard that random dealing has left empty leaves its blocks unbounded, not unanswered.
                if tree.is_valid:
                    block = pickle.loads(queries.as_py())
                    _, best = search_shard(space, pickle.loads(tree.as_py()), block, k)
                    block["floor"], block["limit"] = best.floor, best.limit
                    found.append(pickle.dumps(block))
                else:
                    found.append(queries.as_py())
            yield pa.RecordBatch.from_arrays(
                [batch.column("tile"), pa.array(found, pa.binary())], ["tile", "queries"]
            )

    return bound


def _routing(shared):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, pivots, radius, groups = shared.value
        for batch in batches:
            for tile, queries in zip(batch.column("tile"), batch.column("queries"), strict=True):
                whole = queries.as_py()
                block = pickle.loads(whole)
                least = distances(space.asking(block["vectors"]), pivots) - radius
                near = least <= space.reach(squares(block["vectors"]), block["floor"])[:, None]
                for group, cells in enumerate(groups):
                    asks = near[:, cells].any(1)
                    if asks.any():
                        part = {name: x[asks] for name, x in block.items()}
                        load = whole if asks.all() else pickle.dumps(part)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([group], pa.int32()),
                                pa.array([tile.as_py()], pa.int32()),
                                pa.array([load], pa.binary()),
                            ],
                            ["group", "tile", "load"],
                        )

    return route


def _second_round(space: Space, k: int):
    """Trees of a part come before its blocks."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, trees, group = None, [], None
        for batch in batches:
            columns = (batch.column(n) for n in ("part", "asks", "load"))
            for at, asks, load in zip(*columns, strict=True):
                if at.as_py() != part:
                    part, trees, group = at.as_py(), [], None
                if not asks.as_py():
                    trees.append(pickle.loads(load.as_py()))
                    continue
                if trees:
                    group, trees = join_shards(trees), []
                if group is None:  # random dealing has left its shards empty
                    continue
                block = pickle.loads(load.as_py())
                (query, ids, score), _ = search_shard(space, group, block, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block["ids"][query]),
                        pa.array(ids),
                        pa.array(score.astype(np.int64)),
                    ],
                    ["query_id", "vec_id", "score"],
                )

    return search


def neighbours(pivots: np.ndarray) -> np.ndarray:
    """The pivots' numbers in an order in which near ones mostly follow each other."""
    order, left = [0], np.ones(len(pivots), bool)
    while len(order) < len(pivots):
        left[order[-1]] = False
        away = distances(pivots[order[-1:]], pivots)[0]
        order.append(int(np.where(left, away, np.inf).argmin()))
    return np.array(order)


def search(embeddings: DataFrame, asks: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every row for which ``asks`` holds.

    The driver sees at most ``PIVOTS`` vectors and one line per cell.
    """
    spark = embeddings.sparkSession
    numbered = vectors_of(embeddings).withColumn("uid", F.monotonically_increasing_id())
    rows = settled(numbered, "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size = rows.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(square).alias("top")
    ).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if not size["n"]:
        return spark.createDataFrame([], empty)
    space = Space(max(size["width"], 1), size["top"])
    wanted = min(PIVOTS, -(-size["n"] // CELL))
    chosen = rows.select("v", F.xxhash64("uid").alias("h")).orderBy("h").limit(wanted).toArrow()
    pivots = space.points(_matrix(chosen["v"].combine_chunks(), space.width))
    routing = spark.sparkContext.broadcast((space, pivots))
    celled = settled(
        rows.mapInArrow(
            _assigning(routing), "vec_id long, v array<long>, uid long, cell int, away double"
        ),
        "cells",
    )
    is_query = asks if asks is not None else F.lit(True)
    asking = (
        celled.filter(is_query)
        .groupBy("vec_id")
        .agg(F.min(F.struct("v", "cell")).alias("q"))
        .select("vec_id", "q.v", "q.cell")
    )
    asking = settled(asking, "queries")
    per_cell = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r"))
    blocks_of = asking.groupBy("cell").agg(F.count(F.lit(1)).alias("b"))
    cells = per_cell.join(blocks_of, "cell", "left").fillna(0, ["b"]).collect()
    held = {row["cell"]: row for row in cells}
    radius = np.zeros(len(pivots))
    # Shards and blocks are numbered through all cells; so many shards in a row are a group.
    plan, n_shards, n_blocks = [], 0, 0
    for cell in neighbours(pivots).tolist():
        if row := held.get(cell):
            radius[cell] = row["r"]
            shards, blocks = -(-row["n"] // SHARD), -(-row["b"] // BLOCK)
            plan.append((cell, shards, blocks, n_shards, n_blocks))
            n_shards, n_blocks = n_shards + shards, n_blocks + blocks
    fit = max(1, GROUP // (SHARD * space.width * np.dtype(space.narrow).itemsize))
    per_group = min(fit, -(-n_shards // GROUPS))
    groups = [[] for _ in range(-(-n_shards // per_group))]
    for cell, shards, _, at, _ in plan:
        for group in range(at // per_group, (at + shards - 1) // per_group + 1):
            groups[group].append(cell)
    tiles = max(1, min(n_blocks, -(-TASKS // len(groups))))
    sizes = spark.createDataFrame(
        plan, "cell int, shards long, blocks long, first_shard long, first_block long"
    )
    spread = F.xxhash64("uid")
    trees = settled(
        celled.join(F.broadcast(sizes), "cell")
        .withColumn("shard", F.pmod(spread, F.col("shards")).cast("int"))
        .withColumn("group", F.floor((F.col("first_shard") + F.col("shard")) / per_group).cast("int"))
        .select("cell", "shard", "group", "vec_id", "v")
        .groupBy("cell", "shard")
        .applyInArrow(_building(space), "cell int, shard int, group int, tree binary"),
        "trees",
    )
    blocks = (
        asking.join(F.broadcast(sizes), "cell")
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
        .select("cell", "block", "vec_id", "v")
        .groupBy("cell", "block")
        .applyInArrow(_blocking(space), "cell int, block int, queries binary")
    )
    # Spark can't tell the size of what is packed, so it gets no choice of the join.
    first = (
        blocks.join(F.broadcast(sizes), "cell")
        .withColumn("shard", F.pmod(F.col("block"), F.col("shards")).cast("int"))
        .withColumn("tile", F.pmod(F.col("first_block") + F.col("block"), F.lit(tiles)).cast("int"))
        .select("cell", "shard", "tile", "queries")
        .join(trees.select("cell", "shard", "tree").hint("merge"), ["cell", "shard"], "left")
    )
    bounded = settled(
        first.select("tile", "tree", "queries").mapInArrow(
            _first_round(space, k), "tile int, queries binary"
        ),
        "bounded",
    )
    routes = spark.sparkContext.broadcast((space, pivots, radius, groups))
    part = (F.col("group") * tiles + F.col("tile")).alias("part")
    sent = bounded.mapInArrow(_routing(routes), "group int, tile int, load binary")
    nodes = trees.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    found = (
        nodes.select(part, F.lit(False).alias("asks"), F.col("tree").alias("load"))
        .unionByName(sent.select(part, F.lit(True).alias("asks"), "load"))
        .repartitionById(len(groups) * tiles, F.col("part"))
        .sortWithinPartitions("part", "asks")
        .mapInArrow(_second_round(space, k), "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
