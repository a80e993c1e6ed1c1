"""The pipeline's near-duplicate stage against brute force on fingerprints."""

import random
import re

import corpus_pipeline
import xxhash
from helpers import AWKWARD, documents

SMALL = "/root/testdata/sf0.001"


def simple_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simple_least(rows):
    """The least id of each group of linked rows."""
    prints, parent = [simple_print(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        order = (doc_id is None, doc_id or 0)
        least[root(i)] = min(least.get(root(i), order), order)
    return sorted(least.values())


def similar_texts():
    rng = random.Random(5)
    rows = []
    for g in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(300, 900))]
        rows.append((100 * g, " ".join(base)))
        for k in range(1, 5):  # from no new word to one in 80
            changed = [f"n{g}x{k}x{i}" if rng.random() < (k - 1) / 240 else w for i, w in enumerate(base)]
            rows.append((100 * g + k, " ".join(changed).upper() if k == 1 else "\n".join(changed)))
    return rows


def test_stage_keeps_one_of_each_group(spark):
    rows = similar_texts() + [(r[0] if r[0] is None else 90_000 + r[0], r[1]) for r in AWKWARD]
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, documents(spark, rows, True), SMALL)
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.select("doc_id").collect())
    wanted = simple_least(rows)
    assert len(wanted) < len(rows) - 40
    assert got == wanted


def test_texts_that_are_not_similar_enough_stay(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(300))) for i in range(40)]
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, documents(spark, rows), SMALL)
    assert sorted((False, r.doc_id) for r in kept.collect()) == simple_least(rows)
