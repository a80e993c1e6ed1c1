"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

The probability of a token is that of its class given the tokens before it, times that of the
token within its class. Classes: the most frequent words one each, the end mark one, and all other
words by their last two bytes and whether they are plain ASCII. The first factor is a softmax over
classes whose features are the preceding word, the preceding pair and the word before the last (a skip
feature), hashed into one table of weights. The second is an add-``PRIOR`` estimate from exact counts.

Training: exact counts of all words; then ``ROUNDS`` passes, each over its part of the training
documents, in which every task takes gradient steps over its tokens in batches, and Spark averages the tasks'
weights, each feature by how often a task met it. Scoring runs in sparse numpy batches. Words among the ``FREQUENT``
most frequent are looked up in place; the others of each document are joined with the count table.

Defined results: a null text is empty and holds just the end mark; a null id counts as empty text, whose remainder
is 0. Without training documents all counts are 0 and all words unknown. Repeated rows are scored alike. Other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbstone.llm.common import id_bucket, id_text, settled

FOLDS, HELD_OUT = 10, 0
PRIOR = 0.1
FREQUENT = 100_000
CLASSES = 32
SINGLES, ASCII_GROUPS, OTHER_GROUPS = 15, 11, 5  # with the end mark: CLASSES
END = CLASSES - 1
ROUNDS = 2
RATE = 0.6
BATCH = 16_384
# Each training task hands on a table of weights. Their number follows from the tokens alone, so scores don't
# change with the cores.
TOKENS_PER_TASK = 4_000_000
ROWS = 1 << 16
LARGE_SCORE = 60  # below, neither exponentials nor their sums leave single precision
_SLICE = 4_000_000


# --- tokens ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tokens:
    """Words of several texts in a row: codes into ``words``, and where each text begins."""

    words: pa.Array
    codes: np.ndarray
    bounds: np.ndarray


def tokens_of(texts: pa.Array) -> Tokens:
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
    coded = split.flatten().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy()
    blank = pc.index(words, "").as_py()
    if blank >= 0:
        real = codes != blank
        bounds = np.append(0, np.cumsum(real))[bounds]
        codes = codes[real]
    return Tokens(words, codes, bounds)


def _slices(batch: pa.RecordBatch, size: int = _SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded amount of text, one text at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
    begin = 0
    while begin < batch.num_rows:
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + size, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _slices(whole, 4 * _SLICE):
            found = tokens_of(batch.column("text"))
            n = np.bincount(found.codes, minlength=len(found.words))
            yield pa.RecordBatch.from_arrays([found.words, pa.array(n)], ["word", "n"]).filter(
                pa.array(n > 0)
            )


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents."""
    parts = docs.select("text").mapInArrow(_counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


# --- model ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    frequent: pa.Array  # words, most frequent first
    log_counts: np.ndarray  # log10(count + PRIOR) of these
    class_logs: np.ndarray  # per class, log10 of its total with priors
    bias: np.ndarray
    weights: np.ndarray  # ROWS x CLASSES


def word_classes(words: pa.Array, frequent: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(class, place among the frequent words or -1) of each word."""
    place = pc.fill_null(pc.index_in(words, value_set=frequent), -1).to_numpy()
    plain = pc.equal(pc.binary_length(words), pc.utf8_length(words)).to_numpy(zero_copy_only=False)
    tails = pc.binary_slice(words.cast(pa.binary()), -2).to_pylist()
    tail = np.fromiter(map(zlib.crc32, tails), np.int64, len(words))
    grouped = np.where(
        plain, SINGLES + tail % ASCII_GROUPS, SINGLES + ASCII_GROUPS + tail % OTHER_GROUPS
    )
    return np.where((place >= 0) & (place < SINGLES), place, grouped), place


def word_hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(
        map(zlib.crc32, words.cast(pa.binary()).to_pylist()), np.uint32, len(words)
    )


def _class_sums(shared):
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            classes, _ = word_classes(batch.column("word"), shared.value)
            total += np.bincount(
                classes, weights=batch.column("n").to_numpy(), minlength=CLASSES
            ).astype(np.int64)
            kinds += np.bincount(classes, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(CLASSES)), pa.array(total), pa.array(kinds)], ["c", "total", "kinds"]
        )

    return add_up


def _with_ends(found: Tokens, per_word: np.ndarray, end: int) -> np.ndarray:
    """Values of all tokens in a row, an end mark behind each text."""
    return np.insert(per_word[found.codes], found.bounds[1:], end)


def context_rows(found: Tokens) -> np.ndarray:
    """Rows of the weight table for each token with its end marks: three columns."""
    own = _with_ends(found, word_hashes(found.words), 0)
    starts = found.bounds[:-1] + np.arange(len(found.bounds) - 1)
    one, two = np.zeros_like(own), np.zeros_like(own)
    one[1:] = own[:-1]
    one[starts] = 1
    two[1:] = one[:-1]
    two[starts] = 2
    pair = (one * np.uint32(2654435761)) ^ (two * np.uint32(2246822519))
    pair = (pair ^ (pair >> np.uint32(15))) * np.uint32(3266489917)
    quarter = ROWS // 4
    return np.stack(
        [
            (one * np.uint32(2654435761) >> np.uint32(16)) % quarter,
            (two * np.uint32(2246822519) >> np.uint32(16)) % quarter + quarter,
            (pair >> np.uint32(8)) % (2 * quarter) + 2 * quarter,
        ],
        1,
    ).astype(np.int64)


def _scores(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    scores = weights.take(rows[:, 0], 0)
    scores += weights.take(rows[:, 1], 0)
    scores += weights.take(rows[:, 2], 0)
    scores += bias
    # Weights of a row add up to about zero, so the largest score is never below the mean of the bias: only
    # large scores, which few trained tables hold, must be brought down before they are raised.
    if scores.max(initial=0) > LARGE_SCORE:
        scores -= scores.max(1, keepdims=True)
    return scores


def probabilities(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of all classes for each token. ``einsum`` sums short rows faster than ``sum``, without library threads."""
    raised = _scores(bias, weights, rows)
    np.exp(raised, out=raised)
    raised /= (np.einsum("ij->i", raised))[:, None]
    return raised


def target_logs(
    bias: np.ndarray, weights: np.ndarray, rows: np.ndarray, classes: np.ndarray
) -> np.ndarray:
    """Natural logarithms of the probability of each token's class."""
    scores = _scores(bias, weights, rows)
    chosen = scores[np.arange(len(classes)), classes]
    np.exp(scores, out=scores)
    return chosen - np.log(np.einsum("ij->i", scores))


def _step(
    model: Model, weights: np.ndarray, seen: np.ndarray, rows: np.ndarray, classes: np.ndarray
) -> None:
    """One gradient step: features move by the mean of their tokens' errors, less the more
    often they were met."""
    error = probabilities(model.bias, weights, rows)
    np.negative(error, out=error)
    error[np.arange(len(classes)), classes] += 1
    for column in rows.T:
        order = np.argsort(column.astype(np.uint16), kind="stable")
        ordered = column[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        at = ordered[first]
        count = np.diff(np.append(first, len(ordered))).astype(np.float32)
        seen[at] += count
        gain = np.add.reduceat(error[order], first, 0)
        weights[at] += RATE * gain / np.sqrt(count * seen[at])[:, None]


def _trained(shared):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights, seen = model.weights.copy(), np.zeros(ROWS, np.float32)
        for whole in batches:
            for batch in _slices(whole):
                found = tokens_of(batch.column("text"))
                classes, _ = word_classes(found.words, model.frequent)
                target = _with_ends(found, classes, END)
                rows = context_rows(found)
                for k in range(0, len(target), BATCH):
                    _step(model, weights, seen, rows[k : k + BATCH], target[k : k + BATCH])
        met = np.flatnonzero(seen)
        learned = weights[met] * seen[met, None]
        for k in range(0, len(met), 10_000):
            part = slice(k, k + 10_000)
            columns = [pa.array(np.ascontiguousarray(learned[part, c])) for c in range(CLASSES)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(met[part].astype(np.int32)), pa.array(seen[met[part]]), *columns],
                ["row", "seen", *(f"w{c}" for c in range(CLASSES))],
            )

    return train


def _averaged(docs: DataFrame, model: Model, tasks: int) -> np.ndarray:
    """The weights after one pass over ``docs``. The driver gets at most ROWS rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"w{c}" for c in range(CLASSES)]
    schema = "row int, seen float, " + ", ".join(f"{n} float" for n in names)
    parts = docs.select("text").coalesce(tasks).mapInArrow(_trained(shared), schema)
    total = F.sum("seen")
    mixed = parts.groupBy("row").agg(*[(F.sum(n) / total).cast("float").alias(n) for n in names])
    found = mixed.toArrow()
    shared.unpersist()
    weights = model.weights.copy()
    if found.num_rows:
        at = found["row"].to_numpy()
        for c, name in enumerate(names):
            weights[at, c] = found[name].to_numpy()
    return weights


@dataclass(frozen=True)
class Trained:
    model: Model
    counts: DataFrame
    tokens: int
    kinds: int
    ends: int


def _most_frequent(counts: DataFrame) -> pa.Table:
    """At most FREQUENT words, those above a count that leaves no more, most frequent first.

    The counts fall into some hundred levels, whose sizes tell where to cut: nothing is sorted
    in Spark, and no task sees more than its share.
    """
    level = F.floor(F.log2("n") * 16)
    sizes = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()
    cut, words = None, 0
    for row in sorted(sizes, key=lambda r: -r["level"]):
        words += row["words"]
        if words > FREQUENT:
            break
        cut = row["level"]
    chosen = counts.filter(level >= cut) if cut is not None else counts.limit(0)
    return chosen.toArrow().sort_by([("n", "descending"), ("word", "ascending")])


def training_tasks(tokens: int) -> int:
    """Tasks of one round, of about ``TOKENS_PER_TASK`` tokens each."""
    return max(1, -(-tokens // (ROUNDS * TOKENS_PER_TASK)))


def train(docs: DataFrame) -> Trained:
    """Count and fit on all rows of ``docs``."""
    spark = docs.sparkSession
    counts = settled(word_counts(docs), "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("n").alias("v")).first()
    ends = docs.count()
    top = _most_frequent(counts)
    frequent = pa.array(top["word"].to_pylist(), pa.string())
    known = spark.sparkContext.broadcast(frequent)
    sums = counts.mapInArrow(_class_sums(known), "c long, total long, kinds long")
    by_class = sums.groupBy("c").agg(F.sum("total").alias("total"), F.sum("kinds").alias("kinds"))
    totals, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in by_class.collect():
        totals[row["c"]], kinds[row["c"]] = row["total"], row["kinds"]
    totals[END], kinds[END] = ends, min(ends, 1)
    # One share of the prior in each class is for words never seen.
    mass = totals + PRIOR * (kinds + 1)
    model = Model(
        frequent,
        np.log10(top["n"].to_numpy() + PRIOR),
        np.log10(mass),
        np.log(mass / mass.sum()).astype(np.float32),
        np.zeros((ROWS, CLASSES), np.float32),
    )
    part = (F.crc32(id_text(F.col("doc_id")).cast("binary")) / FOLDS).cast("long") % ROUNDS
    tasks = training_tasks(total["n"] + ends)
    for number in range(ROUNDS):
        weights = _averaged(docs.filter(part == number), model, tasks)
        model = Model(frequent, model.log_counts, model.class_logs, model.bias, weights)
    return Trained(model, counts, total["n"] + ends, total["v"] + min(ends, 1), ends)


# --- scores ---------------------------------------------------------------------------------


def _scored(shared, end_log: float):
    rare_type = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in _slices(whole):
                found = tokens_of(batch.column("text"))
                classes, place = word_classes(found.words, model.frequent)
                target, rows = _with_ends(found, classes, END), context_rows(found)
                gained = np.empty(len(target))
                for k in range(0, len(target), BATCH):
                    part = slice(k, k + BATCH)
                    gained[part] = target_logs(model.bias, model.weights, rows[part], target[part])
                gained = gained / np.log(10) - model.class_logs[target]
                starts = found.bounds[:-1] + np.arange(len(found.bounds) - 1)
                size = np.diff(found.bounds) + 1
                text = np.repeat(np.arange(len(size)), size - 1)
                at = place[found.codes]
                common = at >= 0
                logs = np.bincount(
                    text[common], model.log_counts[at[common]], minlength=len(size)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("held_out"),
                        pa.array(size.astype(np.int64)),
                        pa.array(np.bincount(text[common], minlength=len(size)).astype(np.int64)),
                        pa.array(logs + end_log),
                        pa.array(np.add.reduceat(gained, starts)),
                        _rare(found, text, ~common, len(size), rare_type),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_frequent", "logs", "gained", "rare"],
                )

    return score


def _rare(found: Tokens, text: np.ndarray, chosen: np.ndarray, texts: int, kind) -> pa.Array:
    """Each text's words that are not frequent, with how often they occur there."""
    key = text[chosen] * len(found.words) + found.codes[chosen]
    pairs, n = np.unique(key, return_counts=True)
    bounds = np.searchsorted(pairs, np.arange(texts + 1) * len(found.words))
    words = found.words.take(pa.array(pairs % max(len(found.words), 1)))
    values = pa.StructArray.from_arrays([words, pa.array(n.astype(np.int32))], ["word", "n"])
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values).cast(kind)


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per
    document row, learning from the rows not held out."""
    spark = docs.sparkSession
    marked = docs.select(
        "doc_id", "text", (id_bucket(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    )
    learned = train(marked.filter(~F.col("held_out")))
    shared = spark.sparkContext.broadcast(learned.model)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = marked.mapInArrow(
        _scored(shared, float(np.log10(learned.ends + PRIOR))),
        f"doc_id {id_type}, held_out boolean, n_tokens long, n_frequent long, logs double, "
        "gained double, rare array<struct<word:string,n:int>>",
    )
    found = settled(scored.withColumn("uid", F.monotonically_increasing_id()), "scored")
    rare = found.select("uid", F.inline("rare")).withColumnRenamed("n", "times")
    counted = rare.join(learned.counts, "word", "left")
    extra = counted.groupBy("uid").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("rare_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(PRIOR))).alias("rare_logs"),
    )
    mass = float(np.log10(learned.tokens + PRIOR * (learned.kinds + 1)))
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    known = F.col("n_frequent") + F.coalesce("rare_known", F.lit(0)) + min(learned.ends, 1)
    return found.drop("rare").join(extra, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        known.cast("long").alias("n_known"),
        F.lit(learned.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * mass).alias("base_score"),
        (logs + F.col("gained")).alias("score"),
    )
