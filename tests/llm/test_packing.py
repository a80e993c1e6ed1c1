"""Packing: exact pieces, gapless places, and few sequences."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, documents

from kerbstone.llm import packing
from kerbstone.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


HARD = [
    "Don't STOP, 'tis it's we'll.. a.b,c 12,5 x,, .hid e.g. ÉTÉ. İstanbul",
    "tab\there\x1cnel\x85nbsp end  line",
    "é combining ́alone <|endoftext|>mid<|startoftext|> Σας \U0001f600\U0001f600",
    "",
    " ",
    "a" * 500,
    "\x00 nul",
    "ẞǅ ﬁ Å",
]


def test_remembered_chunks_change_no_id(tokenizer):
    words = packing.WordTokens(tokenizer_path())
    for texts in (HARD, HARD[::-1], [*AWKWARD[0][1:2], AWKWARD[8][1]]):
        ids, bounds = words.encode(pa.array(texts))
        for i, text in enumerate(texts):
            wanted = tokenizer.encode(text, add_special_tokens=False).ids
            assert ids[bounds[i] : bounds[i + 1]].tolist() == wanted


def test_every_character_gets_its_ids(tokenizer):
    """Each code point below U+3000 on its own, inside a word and before a comma, as chunks of one text."""
    words = packing.WordTokens(tokenizer_path())
    points = [chr(c) for c in range(0x21, 0x3000) if not (chr(c).isspace() or 0xD800 <= c < 0xE000)]
    texts = [f"{c} a{c}b Q{c}, {c}." for c in points]
    ids, bounds = words.encode(pa.array(texts))
    wanted = tokenizer.encode_batch(texts, add_special_tokens=False)
    for i, w in enumerate(wanted):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == w.ids, texts[i]


def test_memory_is_bounded_in_bytes(tokenizer, monkeypatch):
    monkeypatch.setattr(packing.WordTokens, "MOST_BYTES", 20_000)
    words = packing.WordTokens(tokenizer_path())
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzäéß"
    for _ in range(30):
        text = " ".join("".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(500))
        ids, _ = words.encode(pa.array([text]))
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(words.known) <= 2000


def check_plan(counts, capacity, **options):
    rows = packing.plan(counts, capacity, **options)
    bins, used = defaultdict(list), Counter()
    for length, rank, pieces, each, sequence, offset in rows.tolist():
        assert rank == used[length]
        used[length] += pieces
        for nth in range(pieces):
            bins[sequence + nth // each].append((offset + nth % each * length, length))
    assert used == Counter(counts)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("seed", range(12))
def test_plans_are_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([64, 100, 512])
    lengths = [min(capacity, 1 + int(rng.paretovariate(1) * capacity / 20)) for _ in range(800)]
    counts = Counter(lengths)
    least = -(-sum(lengths) // capacity)
    for groups in (4, 64, 1024):
        assert check_plan(counts, capacity, groups=groups) <= 1.1 * least + 2
    assert check_plan(counts, capacity) <= 1.02 * least + 1


def test_small_plans():
    assert check_plan({}, 10) == 0
    assert check_plan({10: 3}, 10) == 3
    assert check_plan({1: 25}, 10) == 3
    assert check_plan({6: 2, 4: 2, 5: 2}, 10) == 3


def test_runs_grow_with_lengths_not_pieces():
    lengths = np.random.default_rng(3).integers(1, 4097, 20_000)
    counts = {int(k): v for k, v in Counter(lengths.tolist()).items()}
    small, large = packing.plan(counts), packing.plan({k: v * 10**7 for k, v in counts.items()})
    assert len(large) < 2 * len(small) + 10_000


def pieces_of(rows, tokenizer, capacity):
    result = Counter()
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            result[(doc_id, p, at, len(part), zlib.crc32(part.tobytes()))] += 1
    return result


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pieces_and_places(spark, tokenizer, capacity):
    rows = [(r[0], r[1]) for r in AWKWARD if r[0] != 8]
    rows += [(100 + i, t) for i, t in enumerate(HARD)] + [(200 + i, "same text") for i in range(90)]
    found = packing.pack(documents(spark, rows, True), tokenizer_path(), capacity).collect()
    assert Counter(tuple(r)[:5] for r in found) == pieces_of(rows, tokenizer, capacity)
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= 1.02 * sum(r.length for r in found) / capacity + 1


def test_no_documents(spark):
    assert packing.pack(documents(spark, []), tokenizer_path()).count() == 0
