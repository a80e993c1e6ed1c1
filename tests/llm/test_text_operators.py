"""Line dedup, decontamination and SimHash against brute force, and on awkward rows."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash
from helpers import AWKWARD, CLASHES, documents

from kerbstone.llm import decontaminate, line_dedup, simhash

# --- line dedup -----------------------------------------------------------------------------


def cleaned_lines(rows, sites):
    """Brute force: rows of (doc_id, text, source)."""
    bare = lambda line: line.strip(" \t\r\x0b\x0c")
    spread, first = defaultdict(set), {}
    for doc_id, text, source in rows:
        for at, line in enumerate(map(bare, text.split("\n")) if text is not None else ()):
            if line:
                spread[line].add(source)
                place = (doc_id is None, doc_id or 0, at)
                first[line] = min(first.get(line, place), place)
    result = []
    for doc_id, text, _ in rows:
        if text is None:
            result.append((doc_id, 0, 0, None))
            continue
        lines = text.split("\n")
        kept = []
        for at, raw in enumerate(lines):
            line = bare(raw)
            wide = line and len(spread[line] - {None}) >= sites
            if not wide or first[line] == (doc_id is None, doc_id or 0, at):
                kept.append(raw)
        result.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(result)


def test_lines_against_brute_force(spark):
    rows = []
    for i in range(120):
        lines = [f"own line {i}", "  common line", f"shared by some {i % 20}", "", "on three sites"]
        rows.append((i, "\n".join(lines[: 1 + i % 5 + (i % 3 == 0)]), None, f"s{i % 10}", 0))
    rows += [(500 + i, "rare pair\nx", None, f"s{i % 7}", 0) for i in range(20)]
    rows += [(700 + i, "a page that\nis copied\nto all sites", None, f"s{i % 10}", 0) for i in range(40)]
    rows += AWKWARD
    found = line_dedup.drop_boilerplate(documents(spark, rows, True))
    assert "_key" in found.columns and found.columns.count("n_lines") == 1
    got = Counter(map(tuple, found.select("doc_id", "n_lines", "n_removed", "text").collect()))
    assert got == cleaned_lines([(r[0], r[1], r[3]) for r in rows], line_dedup.MIN_SITES)
    assert sum(n for (doc_id, _, gone, _), n in got.items() if gone and (doc_id or 0) < 500) > 50
    # A page copied to all sites keeps its lines once.
    copied = sorted((doc_id, gone) for (doc_id, _, gone, _) in got if 700 <= (doc_id or 0) < 800)
    assert copied == [(700, 0), *((700 + i, 3) for i in range(1, 40))]


def removed(found):
    return {r.doc_id: r.n_removed for r in found.select("doc_id", "n_removed").collect()}


def test_boilerplate_that_is_the_longest_line(spark):
    notice = "we use cookies " * 60
    rows = [(i, f"own {i}\n{notice}\nshort", None, f"s{i:02}", 0) for i in range(12)]
    gone = removed(line_dedup.drop_boilerplate(documents(spark, rows)))
    assert gone == {i: 2 if i else 0 for i in range(12)}


def test_every_site_of_a_line_counts(spark):
    rows = [(100 * i + j, f"page {i}\non all sites", None, f"s{j:02}", 0) for i in range(3) for j in range(9)]
    rows += [(900 + j, "only\none page", None, f"s{j:02}", 0) for j in range(9)]
    gone = removed(line_dedup.drop_boilerplate(documents(spark, rows)))
    wanted = {100 * i + j: (j > 0) + (i + j > 0) for i in range(3) for j in range(9)}
    assert gone == wanted | {900 + j: 2 * (j > 0) for j in range(9)}


def test_no_lines(spark):
    assert line_dedup.drop_boilerplate(documents(spark, [])).count() == 0


# --- decontamination ------------------------------------------------------------------------


def words(text):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contaminated(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - 10, 0) + 1 if w else 0):
            windows[tuple(w[i : i + 10])].add("null" if item is None else str(item))
    sizes = {len(w) for w in windows}
    result = []
    for doc_id, text in rows:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                here = windows.get(tuple(w[i : i + n]))
                if here:
                    found |= here
                    hit |= set(range(i, i + n))
        result.append((doc_id, len(w), len(hit), tuple(sorted(found)), bool(hit)))
    return Counter(result)


ITEMS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, "Three short words"),
    (2, "three short words too"),
    (3, None),
    (4, "..."),
    (None, "unnamed item of four"),
    (10, "one two three four five six seven eight nine ten"),
    (11, "the the the the the the the the the the the"),
]
LEAKS = [
    (100, "x ALPHA beta gamma, delta epsilon zeta eta theta iota kappa lambda y"),
    (101, "alpha beta gamma delta epsilon zeta eta theta iota nearly kappa"),
    (102, "three short-words; unnamed item of four three short words"),
    (103, "the " * 30),
    (104, "short words three"),
]


def test_windows_against_brute_force(spark):
    rows = [(r[0], r[1]) for r in AWKWARD] + LEAKS
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark, rows, True)
    wanted = contaminated(rows, ITEMS)
    for limit in (None, 0):
        if limit == 0:  # the way for benchmarks too large to broadcast
            keep, decontaminate.small_enough = decontaminate.small_enough, lambda df: False
        try:
            found = decontaminate.mark_contaminated(docs, items).collect()
        finally:
            if limit == 0:
                decontaminate.small_enough = keep
        got = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in found]
        assert Counter(got) == wanted
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    clean = [(r.doc_id, r.text) for r in kept.collect()]
    hit = {k for k in wanted if k[4]}
    assert len(clean) == len(rows) - sum(wanted[k] for k in hit)
    assert not {d for d, _ in clean} & {k[0] for k in hit}


def test_no_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    marked = decontaminate.mark_contaminated(documents(spark, AWKWARD), none).collect()
    assert len(marked) == len(AWKWARD) and not any(r.contaminated for r in marked)
    assert decontaminate.mark_contaminated(documents(spark, []), items).count() == 0


# --- SimHash --------------------------------------------------------------------------------


def simple_fingerprint(text):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simple_groups(rows):
    prints = [simple_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

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
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return Counter((d, f"{prints[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows))


def near_copies():
    base = [hashlib.md5(str(i).encode()).hexdigest()[:5] for i in range(400)]
    rows = [(1000 + i, " ".join([*base[:i], f"new{i}", *base[i + 1 :]])) for i in range(0, 60)]
    rows += [(2000 + i, " ".join(base[i : i + 50])) for i in range(0, 300, 37)]
    return rows + [(r[0], r[1]) for r in AWKWARD if len(r[1] or "") < 100_000]


def test_groups_against_brute_force(spark):
    rows = near_copies()
    docs = documents(spark, rows, True)
    wanted = simple_groups(rows)
    for most in (1 << 16, 2):  # the second sends every node down to the last level
        found = simhash.group(docs, most)
        assert Counter(map(tuple, found.collect())) == wanted
    assert any(n > 3 for n in Counter(k[2] for k in wanted.elements()).values())


def test_one_of_each_group_stays(spark):
    rows = near_copies()
    kept = simhash.drop_near_copies(documents(spark, rows, True))
    assert set(CLASHES) < set(kept.columns)
    ids = [r.doc_id for r in kept.collect()]
    wanted = {k[2] for k in simple_groups(rows)}
    assert sorted(i for i in ids if i is not None) == sorted(i for i in wanted if i is not None)
    assert simhash.drop_near_copies(documents(spark, [])).count() == 0
    assert simhash.group(documents(spark, [])).count() == 0


def test_very_long_text_in_slices():
    text = ("some words of a text that goes on " * 60_000).encode()
    one = simhash._SLICE
    try:
        whole = simhash.fingerprint(text)
        simhash._SLICE = 1000
        assert simhash.fingerprint(text) == whole
    finally:
        simhash._SLICE = one


def test_gray_rank(spark):
    from pyspark.sql import functions as F

    fps = [0, 1, 3, 2, 6, 7, 5, 4]  # the first Gray codes in order
    df = spark.createDataFrame([(f,) for f in reversed(fps)], "fp long")
    assert [r.fp for r in df.orderBy(simhash.gray_rank(F.col("fp"))).collect()] == fps
