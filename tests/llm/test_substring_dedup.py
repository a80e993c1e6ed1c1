"""Recompression against a plain search for repeated windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import AWKWARD, documents

from kerbstone.llm import queries, substring_dedup

SMALL = "/root/testdata/sf0.001"
SIZE = 13


def words_of(text):
    return (text or "").encode().split()


def simple(rows, size=SIZE):
    """(doc_id, n_words, n_removed, kept text) of every row, in plain steps."""
    order = lambda i: substring_dedup.NULL_ID if i is None else i
    least = {}
    for doc_id, text, *_ in rows:
        w = words_of(text)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            least[key] = min(least.get(key, order(None)), order(doc_id))
    result = []
    for doc_id, text, *_ in rows:
        w = words_of(text)
        gone = set()
        for i in range(len(w) - size + 1):
            if least[tuple(w[i : i + size])] < order(doc_id):
                gone.update(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        result.append((doc_id, len(w), len(gone), None if text is None else kept))
    return Counter(result)


def found(spark, rows, size=SIZE, clashes=True):
    df = substring_dedup.drop_repeats(documents(spark, rows, clashes), size)
    return Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in df.collect())


def hard_texts(seed):
    rng = random.Random(seed)
    few, many = [f"w{i}" for i in range(4)], [f"v{i}" for i in range(3000)]
    passages = [[rng.choice(many) for _ in range(rng.randint(13, 120))] for _ in range(6)]
    passages += [["a"] * n for n in (12, 13, 14, 40)] + [["a", "b"] * 20, ["a", "b", "b"] * 9, few * 7]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.5:
                passage = rng.choice(passages)
                at = rng.randrange(len(passage))
                w += passage[at : at + rng.randint(1, 60)]
            elif kind < 0.75:
                w += [rng.choice(many) for _ in range(rng.randint(1, 40))]
            else:
                w += [rng.choice(few) for _ in range(rng.randint(1, 25))]
        blank = rng.choice([" ", "\n", "\t \r\n", "\x0b\x0c"])
        rows.append((rng.randrange(100), blank.join(w) + rng.choice(["", " ", "\n"])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_search(spark, seed):
    rows = hard_texts(seed)
    wanted = simple(rows)
    assert sum(k[2] > 0 for k in wanted) > 20
    assert found(spark, rows) == wanted


@pytest.mark.parametrize("size", [2, 5, 16])
def test_other_window_sizes(spark, size):
    rows = hard_texts(7)[:60]
    assert found(spark, rows, size) == simple(rows, size)


def test_small_slices_and_many_buckets(spark, monkeypatch):
    """Nearly every text is a slice, long ones are parsed in parts, and entries meet in buckets only."""
    monkeypatch.setattr(substring_dedup, "BUCKET_TEXT", 3_000)
    rows = hard_texts(11)
    texts = [r[1].encode() for r in rows]
    for text in texts:
        parts = list(substring_dedup.text_parts(text, SIZE, 60))
        windows = [
            (word + i, tuple(p.split()[i : i + SIZE])) for word, p in parts for i in range(len(p.split()) - SIZE + 1)
        ]
        w = text.split()
        assert windows == [(i, tuple(w[i : i + SIZE])) for i in range(len(w) - SIZE + 1)]
    df = documents(spark, rows).repartition(40)
    got = Counter(
        (r.doc_id, r.n_words, r.n_removed, r.text) for r in substring_dedup.drop_repeats(df).collect()
    )
    assert got == simple(rows)


def test_awkward_rows(spark):
    rows = AWKWARD + [(9, AWKWARD[0][1] + " twelve thirteen"), (10, "x " + AWKWARD[0][1] + " twelve thirteen")]
    rows += [(11, " ".join(f"k{i}" for i in range(20)))] * 3 + [(None, " ".join(f"k{i}" for i in range(15)))]
    assert found(spark, rows) == simple(rows)
    assert substring_dedup.drop_repeats(documents(spark, [])).count() == 0
    kept = substring_dedup.drop_repeats(documents(spark, rows, True))
    assert kept.columns == [*documents(spark, rows, True).columns, "n_words", "n_removed"]


def test_long_text_is_parsed_in_parts(spark, monkeypatch):
    rng = random.Random(3)
    body = [f"z{rng.randrange(10**6)}" for _ in range(300_000)]
    rows = [(1, " ".join(body[250_000:250_040])), (2, " ".join(body)), (3, " ".join(body[100:130]))]
    assert found(spark, rows) == simple(rows)


def test_equal_windows_choose_equal_symbols():
    rng = np.random.default_rng(1)
    window = rng.integers(0, 3, SIZE).astype(np.uint64)
    chosen = set()
    for _ in range(200):
        before, after = rng.integers(0, 40), rng.integers(0, 40)
        words = np.concatenate([rng.integers(0, 3, before), window, rng.integers(0, 3, after)]).astype(np.uint64)
        name, place = substring_dedup.anchors(substring_dedup.mixed(words), np.array([before]), SIZE)
        chosen.add((int(name[0]), int(place[0] - before)))
    assert len(chosen) == 1


def test_query_equals_plain_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.REGISTRY["op12_substring_dedup"](spark, SMALL).collect()
    wanted = {k[0]: k for k in simple(rows)}
    assert len(got) == len(rows)
    for r in got:
        _, n, gone, kept = wanted[r.doc_id]
        digest = hashlib.sha256((kept or "").encode()).hexdigest()
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, digest)
