"""Token sequences of a fixed capacity, filled with as little waste as it can be.

Documents are tokenized whole, closed by an end id, and cut only where they exceed the capacity. How to
fill sequences depends on nothing but how many pieces there are of each length, at most
``capacity`` numbers whatever the corpus. From these a plan is made by linear grouping:

1. lengths above ``small`` are sorted, dealt into ``groups`` groups of about equal cardinality, and
   rounded up to the largest of their group;
2. for the few rounded sizes, configurations are chosen by an exact subset-sum search: the largest
   size left, with what fills the rest best, as often as the counts allow;
3. real lengths take the places of rounded ones;
4. small lengths go, largest first, where they fit best; what is left opens new sequences.

Plan rows hold runs ("so many equal sequences"), so the plan's size, too, is bounded by the capacity. Pieces
get their rank within their length from counts per bucket, and look up their run by it.

Defined results: a null text is empty and gives one piece, the end id. Repeated rows are pieces of
their own. No documents give no pieces. Null ids are kept. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbstone.llm.common import settled

CAPACITY = 4096
END_ID = 1
GROUPS = 1024


# --- tokenizing -----------------------------------------------------------------------------


# Words of ASCII or further Latin letters, of bounded length, with a stop or comma or without. Lower
# case changes none of these letters into another kind, but for the dotted capital I.
_ASCII = r"^[A-Za-z]{1,64}[.,]?$"
_LATIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]{1,64}[.,]?$"


def _spans(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def _gathered(ids: np.ndarray, starts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the given places in a row, and where each begins, and the end."""
    lengths = np.diff(starts)[places]
    ends = _spans(lengths)
    return ids[np.repeat(starts[places] - ends[:-1], lengths) + np.arange(ends[-1])], ends


class WordTokens:
    """Ids of white-space separated chunks, remembered up to a bound in bytes.

    Only for tokenizers that drop white space and never join across it: then the ids of a text are
    those of its chunks in a row. Letters followed by one stop or comma are two tokens' worth on
    either side, so ``word``, ``Word,`` and ``word.`` share one encoding. What is remembered lies in Arrow and numpy
    arrays, some 30 bytes a word, and is looked up a slice at a time.
    """

    MOST_BYTES = 12_000_000

    def __init__(self, path: str) -> None:
        # A task has one core; threads of the library would spin beside it.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.whole = Tokenizer.from_file(path)
        # Lower-case ASCII letters pass the normalizer and the splitting of words as they are.
        self.plain = Tokenizer(self.whole.model)
        self.plain.pre_tokenizer = WhitespaceSplit()
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        for token, place in self.whole.get_vocab().items():
            self.ends[place] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        self.known = pa.array(["", ".", ","])
        ids, lengths = self._chunk_ids(["", ".", ","])
        self.ids, self.starts = ids, _spans(lengths)

    def _chunk_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each chunk has."""
        return self._few_at_once(self.whole, chunks, 2000)

    @staticmethod
    def _few_at_once(tokenizer, texts: list[str], few: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, whose full encodings are much larger than their ids."""
        parts, lengths = [np.empty(0, "<u4")], []
        for k in range(0, len(texts), few):
            found = [f.ids for f in tokenizer.encode_batch_fast(texts[k : k + few], add_special_tokens=False)]
            lengths += map(len, found)
            parts.append(np.fromiter(itertools.chain.from_iterable(found), "<u4", sum(map(len, found))))
        return np.concatenate(parts), np.array(lengths, np.int64)

    def _word_ids(self, words: pa.Array, tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters, many of which go in one text: each is one unit to the
        tokenizer, and the last token of a unit is marked."""
        texts = [" ".join(words.slice(k, 500).to_pylist()) for k in range(0, len(words), 500)]
        ids, _ = self._few_at_once(tokenizer, texts, 8)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(words) or (len(ids) and last[-1] != len(ids) - 1):
            raise ValueError("a word is more than one unit to the tokenizer")
        return ids, np.diff(last, prepend=-1)

    def learn(self, units: pa.Array) -> pa.Array:
        """Take in units that are unknown, each once; returns them in the order of their places."""
        ascii_, latin = pc.match_substring_regex(units, _ASCII), pc.match_substring_regex(units, _LATIN)
        kinds = (
            (ascii_, lambda words: self._word_ids(words, self.plain)),
            (pc.and_not(latin, ascii_), lambda words: self._word_ids(words, self.whole)),
            (pc.invert(latin), lambda chunks: self._chunk_ids(chunks.to_pylist())),
        )
        names, ids, lengths = [self.known], [self.ids], [np.diff(self.starts)]
        for chosen, encode in kinds:
            part = units.filter(chosen)
            if len(part):
                new, sizes = encode(part)
                names.append(part)
                ids.append(new)
                lengths.append(sizes)
        self.known, self.ids = pa.concat_arrays(names), np.concatenate(ids)
        self.starts = _spans(np.concatenate(lengths))
        return pa.concat_arrays(names[1:])

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different chunks in a row, and where each begins, and the end."""
        word = pc.match_substring_regex(chunks, _LATIN)
        marked = pc.and_(word, pc.match_substring_regex(chunks, "[.,]$"))
        lower = pc.utf8_rtrim(pc.utf8_lower(chunks), ".,")
        units = pc.if_else(word, lower, chunks).dictionary_encode()
        if self.known.nbytes + self.ids.nbytes > self.MOST_BYTES:
            self.forget()
        found = pc.index_in(units.dictionary, value_set=self.known)
        place = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        fresh = units.dictionary.filter(pc.is_null(found))
        if len(fresh):
            first = len(self.known)
            place[place < 0] = first + pc.index_in(fresh, value_set=self.learn(fresh)).to_numpy()
        unit = place[units.indices.to_numpy()]
        with_mark = marked.to_numpy(zero_copy_only=False)
        # The stop and the comma are remembered at places 1 and 2.
        comma = pc.ends_with(chunks.filter(marked), ",").to_numpy(zero_copy_only=False)
        starts = _spans(1 + with_mark.astype(np.int64))
        parts = np.empty(starts[-1], np.int64)
        parts[starts[:-1]] = unit
        parts[starts[1:][with_mark] - 1] = 1 + comma
        ids, ends = _gathered(self.ids, self.starts, parts)
        return ids, ends[starts]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids begin and end."""
        chunks = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        bounds = chunks.offsets.to_numpy()
        words = chunks.flatten().dictionary_encode()
        ids, starts = self._distinct(words.dictionary)
        ids, ends = _gathered(ids, starts, words.indices.to_numpy())
        return ids, ends[bounds - bounds[0]]


_TOKENIZERS: dict[str, WordTokens] = {}


def _slices(batch: pa.RecordBatch, chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded amount of text, one text at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
    begin = 0
    while begin < batch.num_rows:
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + chars, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _pieces_of(path: str, capacity: int, end_id: int):
    closing = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _TOKENIZERS.setdefault(path, None) or WordTokens(path)
        _TOKENIZERS[path] = tokens
        for whole in batches:
            for batch in _slices(whole):
                # Spark may send texts with 32-bit offsets; one slice always fits.
                texts = pc.fill_null(batch.column("text"), "").cast(pa.string())
                ids, bounds = tokens.encode(texts)
                row, piece, start, length, check = [], [], [], [], []
                spans = zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
                for i, (begin, end) in enumerate(spans):
                    n = end - begin + 1  # with the end id
                    for p, at in enumerate(range(0, n, capacity)):
                        size = min(capacity, n - at)
                        inside = ids[begin + at : min(begin + at + size, end)]
                        crc = zlib.crc32(inside.tobytes())
                        row.append(i)
                        piece.append(p)
                        start.append(at)
                        length.append(size)
                        check.append(zlib.crc32(closing, crc) if at + size == n else crc)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(row, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(check, pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return cut


def tokenized_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): one row per piece. ``tokenizer`` is the path of a
    file on every executor."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _pieces_of(tokenizer, capacity, end_id),
        f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long",
    )


# --- planning -------------------------------------------------------------------------------


@dataclass
class Run:
    """``times`` equal sequences, each with ``count`` pieces of each (length, count)."""

    times: int
    items: list[tuple[int, int]] = field(default_factory=list)
    room: int = 0

    def part(self, times: int, length: int = 0, count: int = 0) -> Run:
        added = [(length, count)] if count else []
        return Run(times, [*self.items, *added], self.room - length * count)


def grouped(counts: Mapping[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Linear grouping: (rounded size, its (length, count) list, longest first), largest first."""
    share = sum(counts.values()) / groups
    result: list[tuple[int, list[tuple[int, int]]]] = []
    filled = share
    for length in sorted(counts, reverse=True):
        if filled >= share:
            result.append((length, []))
            filled = 0
        result[-1][1].append((length, counts[length]))
        filled += counts[length]
    return result


def best_filling(sizes: list[int], left: list[int], room: int) -> list[tuple[int, int]]:
    """(index, count) of sizes whose sum comes closest to ``room`` from below: a bounded
    subset sum over bit sets."""
    mask = (1 << (room + 1)) - 1
    reach, layers = 1, []
    for i, size in enumerate(sizes):
        if left[i] and size <= room:
            layers.append((i, reach))
            grown = reach
            for _ in range(min(left[i], room // size)):
                more = grown | (grown << size) & mask
                if more == grown:
                    break
                grown = more
            reach = grown
    total, chosen = reach.bit_length() - 1, []
    for i, before in reversed(layers):
        count = 0
        while not before >> total & 1:
            total -= sizes[i]
            count += 1
        if count:
            chosen.append((i, count))
    return chosen


def configurations(sizes: list[int], counts: list[int], capacity: int):
    """(times, [(index, count)]) that use up all counts of the descending sizes."""
    left = list(counts)
    for seed in range(len(sizes)):
        while left[seed]:
            left[seed] -= 1
            pattern = dict(best_filling(sizes, left, capacity - sizes[seed]))
            left[seed] += 1
            pattern[seed] = pattern.get(seed, 0) + 1
            times = min(left[i] // count for i, count in pattern.items())
            for i, count in pattern.items():
                left[i] -= times * count
            yield times, sorted(pattern.items())


def _take(queue: list[tuple[int, int]], count: int) -> list[tuple[int, int]]:
    """The next ``count`` pieces of a queue whose front is its last entry."""
    taken = []
    while count:
        length, there = queue.pop()
        used = min(count, there)
        taken.append((length, used))
        if there > used:
            queue.append((length, there - used))
        count -= used
    return taken


def _substituted(times: int, pattern, queues, capacity: int) -> Iterator[Run]:
    """Runs of real lengths in place of a pattern of rounded ones."""
    while times:
        # So many sequences in a row that each group serves all its places with one length.
        same = min(times, *(queues[i][-1][1] // count for i, count in pattern))
        step = max(1, same)
        items: list[tuple[int, int]] = []
        for i, count in pattern:
            taken = _take(queues[i], count * step)
            items += [(length, n // step) for length, n in taken]
        yield Run(step, items, capacity - sum(length * n for length, n in items))
        times -= step


def _best_fit(by_room: list[list[Run]], counts: Mapping[int, int], capacity: int) -> None:
    """Put small pieces, longest first, where the room they leave is least."""
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in range(length, capacity + 1):
            while left and by_room[room]:
                run = by_room[room].pop()
                each = room // length
                full = min(run.times, left // each)
                rest = left - full * each if full < run.times else 0
                parts = [run.part(full, length, each)] if full else []
                if rest:
                    parts.append(run.part(1, length, rest))
                if run.times > full + bool(rest):
                    parts.append(run.part(run.times - full - bool(rest)))
                left -= full * each + rest
                for part in parts:
                    by_room[part.room].append(part)
            if not left:
                break
        if left:
            each = capacity // length
            fresh = Run(1, [], capacity)
            if left >= each:
                by_room[capacity - each * length].append(
                    Run(left // each, [(length, each)], capacity - each * length)
                )
            if left % each:
                part = fresh.part(1, length, left % each)
                by_room[part.room].append(part)


def plan(
    counts: Mapping[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int | None = None
) -> np.ndarray:
    """Rows (length, first rank, pieces, per sequence, first sequence, offset).

    Pieces of a length with ranks from ``first rank`` on are dealt, so many per sequence, to the
    sequences from ``first sequence`` on.
    """
    small = capacity // 4 if small is None else small
    large = grouped({n: c for n, c in counts.items() if n > small}, groups)
    queues = [list(reversed(members)) for _, members in large]
    sizes = [size for size, _ in large]
    totals = [sum(c for _, c in members) for _, members in large]
    by_room: list[list[Run]] = [[] for _ in range(capacity + 1)]
    for times, pattern in configurations(sizes, totals, capacity):
        for run in _substituted(times, pattern, queues, capacity):
            by_room[run.room].append(run)
    _best_fit(by_room, {n: c for n, c in counts.items() if n <= small}, capacity)
    rows, used, sequence = [], dict.fromkeys(counts, 0), 0
    for run in (run for runs in by_room for run in runs):
        offset = 0
        for length, count in run.items:
            rows.append((length, used[length], run.times * count, count, sequence, offset))
            used[length] += run.times * count
            offset += length * count
        sequence += run.times
    assert used == dict(counts), "the plan must place every piece once"
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


# --- placing --------------------------------------------------------------------------------


def ranked(pieces: DataFrame, counts: Mapping[int, int]) -> DataFrame:
    """Add ``rank``, from 0 within each length.

    A length may be that of a third of all pieces: it is split into about half the root of its count
    buckets, which are ranked on their own and moved by the pieces of earlier buckets.
    """
    spark = pieces.sparkSession
    buckets = spark.createDataFrame(
        [(n, max(1, int(c**0.5 / 2))) for n, c in counts.items()], "length long, buckets int"
    )
    # At most ``capacity`` rows, whatever the corpus.
    split = pieces.join(F.broadcast(buckets), "length").withColumn(
        "bucket", F.pmod(F.xxhash64("uid"), F.col("buckets")).cast("int")
    )
    before = Window.partitionBy("length").orderBy("bucket")
    earlier = (
        split.groupBy("length", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("earlier", F.sum("n").over(before) - F.col("n"))
        .drop("n")
    )
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("uid")) - 1
    return (
        split.withColumn("within", within)
        .join(earlier, ["length", "bucket"])
        .withColumn("rank", F.col("earlier") + F.col("within"))
        .drop("bucket", "buckets", "within", "earlier", "uid")
    )


_RANKS = 1 << 44


def _placed(shared):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        keys = rows[:, 0] * _RANKS + rows[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            run = rows[np.searchsorted(keys, length * _RANKS + rank, "right") - 1]
            nth = rank - run[:, 1]
            sequence = run[:, 4] + nth // run[:, 3]
            offset = run[:, 5] + nth % run[:, 3] * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)],
                [*names, "sequence_id", "offset"],
            )

    return place


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    groups: int = GROUPS,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece."""
    spark = docs.sparkSession
    cut = tokenized_pieces(docs, tokenizer, capacity, end_id)
    pieces = settled(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    # At most ``capacity`` numbers reach the driver.
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    shared = spark.sparkContext.broadcast(plan(counts, capacity, groups))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return ranked(pieces, counts).mapInArrow(
        _placed(shared),
        f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, "
        "sequence_id long, offset long",
    )
