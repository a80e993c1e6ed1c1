"""Language identification with error-correcting output codes.

Each language has a codeword; each bit of the code is a binary classifier over hashed byte 2- and
3-grams that separates the languages with a one from those with a zero. Its weights are log odds of the n-gram
between the two sides, from counts over all training documents, gathered by Spark. A text's margin per bit
is the mean weight of its n-grams. Decoding weighs each bit by how well it tells its sides apart in training, adds up the
logistic loss of the margins against each codeword, and takes the nearest; the share of the nearest
in all is the score, and a score below ``AMBIGUOUS`` is flagged.

Whole texts count, in slices of bounded size. Only texts are looked at for a prediction.

Defined results: a null text or one without any letter is ``und`` with score 0, flagged. Without training
documents everything is ``und``. With one language learned, it is predicted with score 1. A null id counts as
empty text, whose bucket is 0. Ties go to the first language in alphabetical order. Repeated rows are judged alike. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbstone.llm.common import id_bucket, keyed_rows, row_key, settled

UNKNOWN = "und"
FOLDS = 3
HELD_OUT = 1
# Half for 2-grams, which are exact, half for hashed 3-grams.
FEATURES = 1 << 17
FLOOR = 1e-7
SHARPNESS = 3.0
AMBIGUOUS = 0.5
_HALF = FEATURES // 2
# Tasks and driver hold a table of counts per language.
MOST_LANGUAGES = 200
_SLICE = 250_000


def code_matrix(languages: int, seed: int = 7) -> np.ndarray:
    """Codewords of -1 and 1, one row per language.

    Up to seven languages get every split into two sides, beyond that the best of random codes of
    about ten times the logarithm of their number, by least distance between rows.
    """
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 7:
        others = range(1, languages)
        sides = [c for n in range(1, languages) for c in combinations(others, n)]
        code = np.ones((languages, len(sides)))
        for bit, side in enumerate(sides):
            code[list(side), bit] = -1
        return code
    random = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(languages)))

    def least(code: np.ndarray) -> float:
        agree = code @ code.T - 2 * bits * np.eye(languages)
        return float((bits - agree.max()) / 2)

    codes = [random.choice([-1.0, 1.0], (languages, bits)) for _ in range(50)]
    best = max(codes, key=least)
    return best[:, np.abs(best.sum(0)) < languages]


_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def ngram_features(data: np.ndarray) -> np.ndarray:
    """Feature numbers of the 2-grams and 3-grams that begin at each byte, in two columns.

    Bytes past the end count as blanks.
    """
    byte = np.empty(len(data) + 2, np.uint32)
    byte[:-2] = _LOWER[data]
    byte[-2:] = 32
    pair = byte[:-2] << 8 | byte[1:-1]
    triple = (pair << 8 | byte[2:]) * np.uint32(2654435761) >> np.uint32(16)
    return np.stack([pair, triple % _HALF + _HALF], 1)


def _parts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, bytes) of texts in bounded slices. A slice overlaps nothing: its last n-grams are
    padded, as at the end of a text."""
    for i, text in enumerate(texts):
        data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.empty(0, np.uint8)
        for at in range(0, len(data), _SLICE):
            yield i, data[at : at + _SLICE]


def _packs(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, rows): texts side by side, about ``_SLICE`` bytes at a time, blanks between."""
    blank = np.array([32, 32], np.uint8)
    data, rows, size = [], [], 0
    for row, part in _parts(texts):
        data += [part, blank]
        rows.append(row)
        size += len(part)
        if size >= _SLICE:
            yield _pack(data, rows)
            data, rows, size = [], [], 0
    if rows:
        yield _pack(data, rows)


def _pack(data: list[np.ndarray], rows: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(x) for x in data])
    starts = np.concatenate([[0], ends[1:-1:2]]) if len(rows) > 1 else np.array([0])
    return np.concatenate(data), starts, np.array(rows)


def _counting(languages: Sequence[str]):
    number = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), FEATURES), np.int64)
        for batch in batches:
            codes = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for language in np.unique(codes):
                texts = batch.column("text").filter(pa.array(codes == language))
                for data, _, _ in _packs(texts):
                    found = ngram_features(data).ravel()
                    counts[language] += np.bincount(found, minlength=FEATURES)
        language, feature = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(language.astype(np.int32)),
                pa.array(feature.astype(np.int32)),
                pa.array(counts[language, feature]),
            ],
            ["language", "feature", "n"],
        )

    return count


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray  # features x bits
    trust: np.ndarray  # per bit, mean 1


def weights_of(counts: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of every n-gram per bit, and the bits' trust: how far apart their sides are."""
    shares = counts / np.maximum(counts.sum(1, keepdims=True), 1) + FLOOR
    shares /= shares.sum(1, keepdims=True)
    sides = [(code > 0).astype(float), (code < 0).astype(float)]
    ones, zeros = ((s / np.maximum(s.sum(0), 1)).T @ shares for s in sides)
    zeros = np.where(zeros == 0, ones, zeros)
    odds = np.log(ones) - np.log(zeros)
    apart = np.abs(((ones - zeros) * odds).sum(1))
    trust = apart / apart.mean() if apart.mean() > 0 else np.ones(len(apart))
    return odds.T.astype(np.float32), trust


def train(docs: DataFrame) -> Model:
    """Count n-grams by language in all rows of ``docs`` with a text and a ``lang``.

    The driver gets the languages and at most ``FEATURES`` counts for each; a column with more than ``MOST_LANGUAGES``
    values holds no languages and is refused.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = known.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values: a table of counts each would not fit a task")
    languages = tuple(sorted(r["lang"] for r in found))
    code = code_matrix(len(languages))
    counts = np.zeros((len(languages), FEATURES), np.int64)
    if languages:
        parts = known.select(F.col("text").cast("binary").alias("text"), "lang").mapInArrow(
            _counting(languages), "language int, feature int, n long"
        )
        total = parts.groupBy("language", "feature").agg(F.sum("n").alias("n")).toArrow()
        place = (total["language"].to_numpy(), total["feature"].to_numpy())
        counts[place] = total["n"].to_numpy()
        weights, trust = weights_of(counts, code)
    else:
        weights, trust = np.zeros((FEATURES, 1), np.float32), np.ones(1)
    return Model(languages, code, weights, trust)


def margins(weights: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Mean weight of each text's n-grams, a row of bits per text."""
    total = np.zeros((len(texts), weights.shape[1]))
    grams = np.zeros(len(texts))
    for data, starts, rows in _packs(texts):
        features = ngram_features(data)
        gained = weights[features[:, 0]] + weights[features[:, 1]]
        np.add.at(total, rows, np.add.reduceat(gained, starts, 0, dtype=np.float64))
        np.add.at(grams, rows, 2 * np.diff(np.append(starts, len(data))))
    return total / np.maximum(grams, 1)[:, None]


def decode(model: Model, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language number, score) of each row of margins."""
    signed = SHARPNESS * found[:, None, :] * model.code[None]
    loss = (np.logaddexp(0, -signed) * model.trust).sum(2)
    near = np.exp(loss.min(1, keepdims=True) - loss)
    best = loss.argmin(1)
    return best, 1 / near.sum(1)


def _predicting(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array([*model.languages, UNKNOWN])
        for batch in batches:
            asked = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            language = np.full(batch.num_rows, len(model.languages))
            score = np.zeros(batch.num_rows)
            if model.languages and asked.any():
                texts = batch.column("text").filter(pa.array(asked))
                language[asked], score[asked] = decode(model, margins(model.weights, texts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("kept"),
                    names.take(pa.array(language)),
                    pa.array(score),
                    pa.array(score < AMBIGUOUS),
                ],
                ["kept", "lang_pred", "score", "ambiguous"],
            )

    return predict


def predict(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(kept, lang_pred, score, ambiguous), one row per document row; ``kept`` is a struct of the
    columns ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    asked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"),
        F.col("text").cast("binary").alias("text"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    schema = (
        T.StructType([asked.schema["kept"]])
        .add("lang_pred", "string")
        .add("score", "double")
        .add("ambiguous", "boolean")
    )
    return asked.mapInArrow(_predicting(shared), schema)


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", _held_out().alias("held_out"))


def _held_out() -> Column:
    return id_bucket(F.col("doc_id"), FOLDS) == HELD_OUT


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous), learning from the rows not held out."""
    marked = _marked(docs)
    model = train(marked.filter(~F.col("held_out")))
    found = predict(marked, model, ["doc_id", "held_out"])
    return found.select("kept.*", "lang_pred", "score", "ambiguous")


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or ambiguous, as they are.

    Only ids, by content, of rejected rows are written; the rows themselves don't pass through Python.
    """
    model = train(_marked(docs).filter(~F.col("held_out")))
    keyed = docs.select("text", row_key(F.col("doc_id"), F.col("text")).alias("_key"))
    found = predict(keyed, model, ["_key"])
    unsure = (F.col("lang_pred") == UNKNOWN) | F.col("ambiguous")
    rejected = settled(found.filter(unsure).select("kept._key").distinct(), "rejected")
    return keyed_rows(docs).join(rejected, "_key", "left_anti").select("_row.*")
