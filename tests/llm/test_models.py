"""Language ID and language-model scores."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, documents

from kerbstone.llm import langid, lm

SMALL = "/root/testdata/sf0.001"


def test_codewords_are_apart():
    for n in range(2, 12):
        code = langid.code_matrix(n)
        assert len({tuple(row) for row in code}) == n
        apart = min((a != b).sum() for i, a in enumerate(code) for b in code[:i])
        assert apart >= 2 ** (n - 2) if n <= 7 else apart >= 5


def test_decoding_equals_plain_loops():
    rng = np.random.default_rng(2)
    for n in (2, 4, 9):
        code = langid.code_matrix(n)
        trust = rng.random(code.shape[1]) + 0.5
        model = langid.Model(tuple(map(str, range(n))), code, np.zeros((1, code.shape[1]), np.float32), trust)
        found = rng.normal(size=(50, code.shape[1]))
        best, score = langid.decode(model, found)
        for row, b, s in zip(found.tolist(), best, score, strict=True):
            losses = []
            for word in code.tolist():
                bits = zip(row, word, trust, strict=True)
                losses.append(sum(t * math.log1p(math.exp(-langid.SHARPNESS * m * c)) for m, c, t in bits))
            assert b == losses.index(min(losses))
            assert math.isclose(s, 1 / sum(math.exp(min(losses) - x) for x in losses), rel_tol=1e-9)


def test_too_many_languages_are_refused(spark):
    rows = [(i, "some text here", f"l{i}", "a", 1) for i in range(langid.MOST_LANGUAGES + 1)]
    with pytest.raises(ValueError, match="more than"):
        langid.train(documents(spark, rows))
    assert len(langid.train(documents(spark, rows[1:])).languages) == langid.MOST_LANGUAGES


def test_training_tasks_follow_from_tokens():
    assert [lm.training_tasks(n) for n in (0, 1, 8_000_000, 8_000_001, 80_000_000)] == [1, 1, 1, 2, 10]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert {r.held_out for r in found} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_awkward_rows(spark):
    docs = documents(spark, AWKWARD, True)
    found = langid.identify(docs).collect()
    assert len(found) == len(AWKWARD)
    by_id = {r.doc_id: r.lang_pred for r in found if r.doc_id is not None}
    assert by_id[2] == by_id[3] == by_id[4] == by_id[5] == "und"
    assert by_id[7] != "und"
    kept = langid.drop_unidentified(docs)
    assert kept.columns == docs.columns
    assert not {2, 3, 4, 5} & {r.doc_id for r in kept.collect()}


def test_nothing_to_learn(spark):
    docs = documents(spark, [(1, "some text"), (2, None)])
    assert {r.lang_pred for r in langid.identify(docs).collect()} == {"und"}
    assert langid.identify(documents(spark, [])).count() == 0


def test_slices_leave_margins_nearly_alone():
    weights = np.random.default_rng(1).normal(size=(langid.FEATURES, 3)).astype(np.float32)
    texts = pa.array([b"abc def " * 500, b"", b"x", b"zyx " * 900])
    whole, size = langid.margins(weights, texts), langid._SLICE
    try:
        langid._SLICE = 700
        assert np.allclose(langid.margins(weights, texts), whole, atol=0.05)
    finally:
        langid._SLICE = size
    features = langid.ngram_features(np.frombuffer(b"Ab", np.uint8))
    assert features[0, 0] == ord("a") << 8 | ord("b")


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def check_scores(spark, rows, found):
    counts, ends = Counter(), 0
    for doc_id, text in rows:
        if zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10:
            counts.update(tokens(text))
    total, kinds = sum(counts.values()), len(counts)
    wanted = []
    for doc_id, text in rows:
        t = tokens(text)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t)
        wanted.append((doc_id, len(t), sum(counts[w] > 0 for w in t), total, round(base, 3)))
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in found]
    order = lambda r: (r[0] is not None, r)
    assert sorted(got, key=order) == sorted(wanted, key=order)


def test_scores(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = lm.score(docs).collect()
    check_scores(spark, rows, found)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_of_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in AWKWARD]
    kept = lm.FREQUENT
    try:
        lm.FREQUENT = 3  # most words then take the way of the join
        check_scores(spark, rows, lm.score(documents(spark, rows, True)).collect())
    finally:
        lm.FREQUENT = kept
    assert lm.score(documents(spark, [])).count() == 0


def test_no_training_documents(spark):
    rows = [(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    found = lm.score(documents(spark, rows)).collect()
    assert {(r.n_known, r.train_tokens) for r in found} == {(0, 0)}
    assert all(math.isfinite(r.score) for r in found)


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(lm.ROWS, lm.CLASSES)).astype(np.float32)
    found = lm.tokens_of(pa.array(["a b c d", "", "b  a\tc"]))
    shares = lm.probabilities(np.zeros(lm.CLASSES, np.float32), weights, lm.context_rows(found))
    assert len(shares) == 7 + 3 and np.allclose(shares.sum(1), 1, atol=1e-5)


@pytest.mark.parametrize("size", [1, 100])
def test_class_logs_equal_a_plain_softmax(size):
    rng = np.random.default_rng(1)
    weights = size * rng.normal(size=(lm.ROWS, lm.CLASSES)).astype(np.float32)
    weights -= weights.mean(1, keepdims=True)
    bias = np.log(rng.dirichlet(np.ones(lm.CLASSES))).astype(np.float32)
    rows, classes = rng.integers(0, lm.ROWS, (50, 3)), rng.integers(0, lm.CLASSES, 50)
    scores = (weights[rows].sum(1) + bias).astype(float)
    scores -= scores.max(1, keepdims=True)
    expected = scores - np.log(np.exp(scores).sum(1, keepdims=True))
    got = lm.target_logs(bias, weights, rows, classes)
    assert np.allclose(got, expected[np.arange(50), classes], rtol=1e-4, atol=1e-4)
    assert np.allclose(lm.probabilities(bias, weights, rows), np.exp(expected), atol=1e-4)


def test_tokens_split_on_ascii_space_only():
    text = "A b\x0bC\x0cd\re\x1cf É g"
    found = lm.tokens_of(pa.array([text, None, "  "]))
    split = [found.words[int(c)].as_py().encode() for c in found.codes]
    assert split == text.encode().lower().split() and found.bounds.tolist() == [0, len(split)] + [len(split)] * 2
