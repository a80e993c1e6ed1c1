"""Long repeats across documents, found by recompression.

Words are named by a hash of their bytes. Rounds then name maximal runs of one symbol, and pairs of a
"left" and a "right" symbol, where a hash of the symbol decides which it is. A name is a hash of what it stands for, so all tasks
give the same name to the same words, and no round needs a dictionary. Whether two neighbours merge depends on these two alone. Hence
inside any window of words all symbols but some at its edges are the same wherever the window occurs: its interior. Each
window is filed under one interior symbol of the highest round that has any, the one with the least mixed name. This choice
depends on the window's words alone, so equal windows meet under one symbol, at one offset.

Symbols and their windows travel to buckets by name. A symbol that several documents share reveals a possible repeat, a 64-bit
check of each window's words, beside the 64-bit name, verifies it. A task sends a window that it holds several times only for its least document; the
others are known to be repeats already. So a passage found in a third of all documents is one entry per slice of text.

A word goes if a window that covers it also starts in a document with a smaller id.

Defined results: a null text stays null and has no words; texts of fewer words than a window lose nothing. The other texts
come back as their kept words, joined by one space. Repeated rows (equal id and text) get equal results, and documents with the same id
don't take words from each other; a null id counts as the largest id. Other columns pass through, but for ``n_words`` and ``n_removed``, which
are replaced. Long texts are parsed in overlapping parts, with the same result. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

WINDOW = 13
ROUNDS = ("run", "pair", "pair")
# Text of a slice that is parsed at once, and of a bucket, in bytes.
SLICE = 1_500_000
BUCKET_TEXT = 4_000_000
NULL_ID = (1 << 63) - 1

_U = np.uint64
_MIX = _U(0xD6E8FEB86659FD93)
_STEP = _U(0x9E3779B97F4A7C15)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> _U(32))) * _MIX
    x = (x ^ (x >> _U(32))) * _MIX
    return x ^ (x >> _U(32))


# --- words ----------------------------------------------------------------------------------

# A random number per byte value and lane, and the odd base of each lane's polynomial.
_LANES = [
    (mixed(np.arange(1, 257, dtype=np.uint64) * _STEP + _U(lane)), _U(base), _U(pow(base, -1, 1 << 64)))
    for lane, base in ((17, 0xBF58476D1CE4E5B9), (91, 0x94D049BB133111EB))
]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word, and the text it is in. Texts begin at ``starts``."""
    space = _IS_SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    inner = starts[(starts > 0) & (starts < len(data))]
    begins[inner] = ~space[inner]
    first = np.flatnonzero(begins)
    # A word ends at the next blank or where the next text begins.
    closes = space.copy()
    closes[inner] = True
    stops = np.append(np.flatnonzero(closes), len(data))
    end = stops[np.searchsorted(stops, first, "right")]
    lanes = []
    for table, base, inverse in _LANES:
        powers = np.full(len(data) + 1, base, _U)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(table[data] * powers[:-1], out=sums[1:])
        powers = np.full(len(data) + 1, inverse, _U)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        lanes.append(mixed((sums[end] - sums[first]) * powers[first] + (end - first).astype(_U)))
    return lanes[0], lanes[1], np.searchsorted(starts, first, "right") - 1


# --- parsing --------------------------------------------------------------------------------


def _chosen(names: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The place of the least mixed name among ``names[low:high]``, the first of equal ones."""
    order, best = mixed(names), low.copy()
    for step in range(1, int((high - low).max(initial=1))):
        at = np.minimum(low + step, high - 1)
        best = np.where(order[at] < order[best], at, best)
    return best


def anchors(
    words: np.ndarray, windows: np.ndarray, size: int = WINDOW, rounds: tuple[str, ...] = ROUNDS
) -> tuple[np.ndarray, np.ndarray]:
    """(name, place): the symbol each window is filed under, and the word it begins at."""
    name, place = np.empty(len(windows), _U), np.empty(len(windows), np.int64)
    symbols, begins = words, np.arange(len(words))
    low, high, alive = windows, windows + size, np.arange(len(windows))

    def file(which: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> None:
        if len(which):
            best = _chosen(symbols, low, high)
            name[which] = mixed(symbols[best] + _U(level))
            place[which] = begins[best]

    for level, kind in enumerate(rounds):
        last = high - 1
        if kind == "run":
            joined = symbols[:-1] == symbols[1:]
        else:
            left = (mixed(symbols ^ _U(level)) >> _U(63)).astype(bool)
            joined = left[:-1] & ~left[1:]
        first = np.ones(len(symbols), bool)
        first[1:] = ~joined
        cell = np.cumsum(first) - 1
        if kind == "run":  # runs at the edges may go on outside
            low2, high2 = cell[low] + 1, cell[last]
        else:  # so may a pair, if it lacks its other half here
            low2, high2 = cell[low] + ~left[low], cell[last] + ~left[last]
        done = high2 <= low2
        file(alive[done], low[done], high[done], level)
        alive, low, high = alive[~done], low2[~done], high2[~done]
        heads = np.flatnonzero(first)
        length = np.diff(np.append(heads, len(symbols)))
        if kind == "run":
            whole = mixed(symbols[heads] * _STEP + length.astype(_U))
        else:
            second = symbols[np.minimum(heads + 1, len(symbols) - 1)]
            whole = mixed(symbols[heads] * _STEP + mixed(second + _U(level)))
        symbols, begins = np.where(length > 1, whole, symbols[heads]), begins[heads]
    file(alive, low, high, len(rounds))
    return name, place


def window_checks(one: np.ndarray, two: np.ndarray, windows: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of all words of each window, from both hashes of each word."""
    if not len(windows):
        return np.empty(0, _U)
    total = np.zeros(len(one) - size + 1, _U)
    for k in range(size):
        end = len(one) - size + 1 + k
        total = total * _STEP + (two[k:end] ^ (one[k:end] >> _U(17)))
    return mixed(total[windows])


def grouped(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, begins): rows with equal pairs of numbers brought together, and where groups begin."""
    both = one ^ mixed(two)
    order = np.argsort(both, kind="stable")
    a, b = one[order], two[order]
    same = both[order][1:] == both[order][:-1]
    if np.any(same & ((a[1:] != a[:-1]) | (b[1:] != b[:-1]))):
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new)


def _least_of_group(docs: np.ndarray, order: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each row the least document of its group."""
    least = np.minimum.reduceat(docs[order], begins)
    result = np.empty(len(docs), docs.dtype)
    result[order] = np.repeat(least, np.diff(np.append(begins, len(order))))
    return result


# --- map side -------------------------------------------------------------------------------

_PARSED = StructType(
    [
        StructField("bucket", LongType()),
        StructField("doc", LongType()),
        StructField("tag", LongType()),
        *[StructField(n, BinaryType()) for n in ("name", "docs", "tags", "at", "mask", "check")],
    ]
)


def text_tag(text: bytes) -> int:
    """Stands for a text among documents of one id, in 32 bits."""
    return xxhash.xxh3_64_intdigest(text) & 0xFFFFFFFF


def text_parts(text: bytes, size: int = WINDOW, limit: int = SLICE) -> Iterator[tuple[int, bytes]]:
    """(first word, part): parts of bounded length that share ``size - 1`` words, so that each
    window is in just one of them."""
    if len(text) <= limit:
        yield 0, text
        return
    word, kept, at = 0, b"", 0
    while at < len(text):
        cut = _SPACE.search(text, min(at + limit, len(text)))
        end = cut.start() if cut else len(text)
        part = kept + text[at:end]
        yield word, part
        found = part.split()
        tail = found[-(size - 1) :] if size > 1 else []
        word += len(found) - len(tail)
        kept, at = b" ".join(tail) + b" ", end


def _marks(docs: np.ndarray, tags: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(doc, tag, starts) for each document: its repeated windows."""
    order = np.lexsort((tags, docs))
    docs, tags, starts = docs[order], tags[order], starts[order].astype("<u4")
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1])
    heads = np.flatnonzero(new)
    for a, b in itertools.pairwise([*heads.tolist(), len(docs)]):
        yield int(docs[a]), int(tags[a]), starts[a:b].tobytes()


def _slice_rows(parts: list[tuple[int, int, int, bytes]], size: int, buckets: int) -> list[dict]:
    """What is sent of one slice of text parts (doc, tag, first word, text)."""
    data = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
    lengths = np.array([len(p[3]) for p in parts], np.int64)
    starts = np.cumsum(lengths) - lengths
    # Empty parts begin where the next one does.
    one, two, part = word_hashes(data, starts)
    windows = np.arange(max(len(part) - size + 1, 0))
    windows = windows[part[windows] == part[windows + size - 1]]
    if not len(windows):
        return []
    name, place = anchors(one, windows, size)
    check = window_checks(one, two, windows, size)
    doc = np.array([p[0] for p in parts], np.int64)[part[windows]]
    tag = np.array([p[1] for p in parts], np.int64)[part[windows]]
    # Words before the part within its document, minus those before it within the slice.
    words_before = np.searchsorted(part, np.arange(len(parts)))
    shift = np.array([p[2] for p in parts], np.int64) - words_before
    shift = shift[part[windows]]
    offset = place - windows
    order, begins = grouped(name + offset.astype(_U) * _STEP, check)
    least = _least_of_group(doc, order, begins)
    rows = []
    known = doc > least
    for d, t, s in _marks(doc[known], tag[known], (windows + shift)[known]):
        rows.append({"bucket": d % buckets, "doc": d, "tag": t, "at": s})
    sent = np.flatnonzero(~known)
    # Windows of one occurrence of a symbol go as one entry with a mask of offsets.
    bucket = (name[sent] % _U(buckets)).astype(np.int64)
    # In the order of the texts, so that neighbours have their documents in common.
    sent = sent[np.lexsort((offset[sent], name[sent], place[sent], bucket))]
    entry_name, entry_place = name[sent], place[sent]
    new = np.ones(len(sent), bool)
    new[1:] = (entry_name[1:] != entry_name[:-1]) | (entry_place[1:] != entry_place[:-1])
    heads = np.flatnonzero(new)
    masks = np.bitwise_or.reduceat(1 << offset[sent], heads)
    first = sent[heads]
    bucket = (name[first] % _U(buckets)).astype(np.int64)
    columns = {
        "name": name[first],
        "docs": doc[first],
        "tags": tag[first].astype("<u4"),
        "at": (place + shift)[first].astype("<u4"),
        "mask": masks.astype("<u2"),
    }
    edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(first))
    sums = np.append(heads, len(sent))
    for a, b in itertools.pairwise(edges.tolist()):
        row = {k: v[a:b].tobytes() for k, v in columns.items()}
        row |= {"bucket": int(bucket[a]), "check": check[sent[sums[a] : sums[b]]].tobytes()}
        rows.append(row)
    return rows


def _parsed(size: int, buckets: int):
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_PARSED)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        seen: set[tuple[int, int]] = set()
        amount = 0
        for batch in batches:
            for doc, value in zip(batch.column("doc").to_pylist(), batch.column("text"), strict=True):
                text = value.as_py()
                key = (doc, text_tag(text))
                if key in seen:  # a repeated row: what holds for the first holds for it
                    continue
                seen.add(key)
                for word, part in text_parts(text, size):
                    held.append((*key, word, part))
                    amount += len(part)
                    if amount >= SLICE:
                        yield pa.RecordBatch.from_pylist(_slice_rows(held, size, buckets), schema)
                        held, amount, seen = [], 0, {key}
        if held:
            yield pa.RecordBatch.from_pylist(_slice_rows(held, size, buckets), schema)

    return parse


# --- buckets --------------------------------------------------------------------------------

_MARKS = "doc long, tag long, starts binary"


def repeated(columns: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, tag, start) of the windows that start in a smaller document too, from entries."""
    bits = np.unpackbits(columns["mask"].view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    entry, offset = np.nonzero(bits)
    doc = columns["docs"][entry]
    name = columns["name"][entry] + offset.astype(_U) * _STEP
    order, begins = grouped(name, columns["check"])
    found = np.flatnonzero(doc > _least_of_group(doc, order, begins))
    entry = entry[found]
    return doc[found], columns["tags"][entry], columns["at"][entry].astype(np.int64) - offset[found]


_TYPES = {"name": "<u8", "docs": "<i8", "tags": "<u4", "at": "<u4", "mask": "<u2", "check": "<u8"}


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = {n: [] for n in _TYPES}
    bucket = None

    def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        docs, tags, starts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(tags, pa.int64()), pa.array(starts, pa.binary())],
            ["doc", "tag", "starts"],
        )

    def flush() -> Iterator[pa.RecordBatch]:
        if held["name"]:
            columns = {n: np.frombuffer(b"".join(v), _TYPES[n]) for n, v in held.items()}
            for v in held.values():
                v.clear()
            rows = list(_marks(*repeated(columns)))
            if rows:
                yield batch_of(rows)

    for batch in batches:
        known = []
        for row in batch.to_pylist():
            if row["name"] is None:
                known.append((row["doc"], row["tag"], row["at"]))
                continue
            if row["bucket"] != bucket:
                yield from flush()
                bucket = row["bucket"]
            for n, v in held.items():
                v.append(row[n])
        if known:
            yield batch_of(known)
    yield from flush()


def repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc, tag, starts): parts of the list of repeated windows of each text; ``doc`` is the id, or
    :data:`NULL_ID`, and ``tag`` stands for the text."""
    if not 2 <= size <= 16:
        raise ValueError("windows have 2 to 16 words")
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"),
        F.col("text").cast("binary").alias("text"),
    ).filter(F.length("text") > 0)
    amount = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = 1 + amount // BUCKET_TEXT
    parsed = texts.mapInArrow(_parsed(size, buckets), _PARSED)
    dealt = parsed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_matched, _MARKS)


# --- texts meet their repeats ---------------------------------------------------------------


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the way to their repeats."""
    codec = pa.Codec("zstd")
    for batch in batches:
        tags, sizes, packed = [], [], []
        for value in batch.column("text"):
            text = value.as_py()
            tags.append(text_tag(text or b""))
            sizes.append(None if text is None else len(text))
            packed.append(None if text is None else codec.compress(text, asbytes=True))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("rest"),
                batch.column("doc"),
                pa.array(tags, pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(packed, pa.binary()),
            ],
            ["rest", "doc", "tag", "size", "packed"],
        )


def _kept(text: bytes, starts: np.ndarray, size: int) -> tuple[bytes, int, int]:
    """The kept words, the number of words, the number of removed ones."""
    words = text.split()
    starts = starts[starts + size <= len(words)]
    if not len(starts):
        return b" ".join(words), len(words), 0
    edges = np.bincount(starts, minlength=len(words) + 1) - np.bincount(starts + size, minlength=len(words) + 1)
    keep = np.cumsum(edges[: len(words)]) == 0
    return b" ".join(itertools.compress(words, keep.tolist())), len(words), int(len(words) - keep.sum())


def _finished(size: int):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            texts, totals, removed = [], [], []
            columns = (batch.column(n) for n in ("size", "packed", "starts"))
            for length, packed, starts in zip(*(c.to_pylist() for c in columns), strict=True):
                text = b"" if packed is None else codec.decompress(packed, length, asbytes=True)
                found = np.frombuffer(b"".join(starts or []), "<u4").astype(np.int64)
                kept, total, gone = _kept(text, found, size)
                texts.append(None if packed is None else kept.decode())
                totals.append(total)
                removed.append(gone)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rest"),
                    pa.array(texts, pa.string()),
                    pa.array(totals, pa.int64()),
                    pa.array(removed, pa.int64()),
                ],
                ["rest", "text", "n_words", "n_removed"],
            )

    return finish


def drop_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` with ``text`` cut down to the kept words, and ``n_words`` and ``n_removed``."""
    others = [c for c in docs.columns if c != "text"]
    rest = StructType([docs.schema[c] for c in others])
    sent = StructType(
        [
            StructField("rest", rest),
            StructField("doc", LongType()),
            StructField("tag", LongType()),
            StructField("size", LongType()),
            StructField("packed", BinaryType()),
        ]
    )
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"),
        F.col("text").cast("binary").alias("text"),
    ).mapInArrow(_packed, sent)
    found = repeats(docs, size).groupBy("doc", "tag").agg(F.collect_list("starts").alias("starts"))
    done = StructType(
        [
            StructField("rest", rest),
            StructField("text", StringType()),
            StructField("n_words", LongType()),
            StructField("n_removed", LongType()),
        ]
    )
    joined = packed.join(found, ["doc", "tag"], "left").select("rest", "size", "packed", "starts")
    result = joined.mapInArrow(_finished(size), done)
    counts = ("n_words", "n_removed")
    kept = [
        F.col("text") if c == "text" else F.col("rest").getField(c).alias(c)
        for c in docs.columns
        if c not in counts
    ]
    return result.select(*kept, *counts)
