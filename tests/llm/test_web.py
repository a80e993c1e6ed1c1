"""URL filter and HTML extraction."""

import time
from itertools import combinations, product

import pytest

from kerbstone.llm import html_extract, url_filter
from kerbstone.llm.queries import URL_RULES

URLS = [
    (1, "http://Example.COM/de/x?q=1"),
    (2, "https://a.b.example.net/en/1#t"),
    (3, "https://example.net/fr/1"),
    (4, "x://notexample.com/de/"),
    (5, "http://example.com"),
    (6, "http://net?x/"),
    (7, "http://net/"),
    (8, "no scheme.net/"),
    (9, None),
    (None, ""),
    (10, "http://x.org/fr/a://b.net/"),
    (10, "http://x.org/fr/a://b.net/"),
    (11, "ftp://user@h.net:80/p?x#y"),
    (12, "http://bad.example.org/cheap/1?utm=2"),
]


def simple_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return host.lower(), tail[:end]


def simple_rule(host, path):
    fit = [
        r
        for r in URL_RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    return max(fit, key=lambda r: len(r.text), default=None)


def pages(spark, rows):
    schema = "page_id long, url string, key string, tokens string"
    return spark.createDataFrame([(*r, "k", "t") for r in rows], schema)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_list_rules(spark):
    found = url_filter.judge(pages(spark, URLS), labels(spark, []), URL_RULES).collect()
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in found)
    wanted = []
    for page_id, url in URLS:
        host, path = simple_parts(url)
        rule = simple_rule(host, path)
        action = rule.action if rule else "allow"
        wanted.append((str(page_id), host, path, rule.text if rule else "None", action))
    assert got == sorted(wanted)


def test_no_pages(spark):
    assert url_filter.judge(pages(spark, []), labels(spark, [(1, 0, 1)]), URL_RULES).count() == 0


def test_mined_rules_against_brute_force(spark):
    mining = url_filter.Mining(support=0.02, pages=3, confidence=0.6, odds=1.5)
    rows, marks = [], []
    for i, (a, b, c) in enumerate(product("abcd", "pqr", range(8))):
        rows.append((i, f"http://{a}.site/{b}/{c % 3}"))
        marks.append((i, 1, int((a == "a" and b == "p") or (b == "r" and c > 1) or i % 17 == 0)))
    marks += [(None, 0, 1), (9_999, 0, 1), (0, None, None)]
    df = pages(spark, [*rows, (None, rows[0][1]), (500, "http://z.site/r/9"), (501, None)])
    found = url_filter.judge(df, labels(spark, marks), (), mining).collect()

    def tokens(url):
        host, path = simple_parts(url)
        return {f"host:{h}" for h in host.split(".") if h} | {
            f"path:{p}" for p in path.split("/") if p
        }

    bad = {i for i, quality, toxic in marks if toxic == 1 or quality == 0}
    held = [(tokens(u), i in bad) for i, u in rows]
    least = max(mining.support, mining.pages / len(held))
    all_bad = sum(b for _, b in held)

    def odds(hits, misses):
        without = (all_bad - hits + 0.5) / (len(held) - all_bad - misses + 0.5)
        return (hits + 0.5) / (misses + 0.5) / without

    rules = []
    every = sorted(set().union(*(t for t, _ in held)))
    for n in (1, 2, 3, 4):
        for part in map(set, combinations(every, n)):
            both = [b for t, b in held if part <= t]
            if sum(both) / len(held) >= least:
                sure = sum(both) / len(both)
                if sure >= mining.confidence and odds(sum(both), len(both) - sum(both)) >= mining.odds:
                    rules.append((part, sure))
    assert rules
    for r in found:
        url = {**dict(rows), None: rows[0][1], 500: "http://z.site/r/9", 501: None}[r.page_id]
        sure = [c for part, c in rules if part <= tokens(url)]
        assert r.verdict == ("block" if sure else "allow")
        assert r.confidence == (pytest.approx(max(sure)) if sure else None)


def blocked(found):
    return {r.page_id for r in found.collect() if r.verdict == "block"}


def test_long_urls_of_one_template(spark):
    """Thirty tokens in each URL, most of them in all: few items, so few combinations."""
    path = "/".join(f"word{i}" for i in range(24))
    rows = [(i, f"http://www.long.example/{path}/s{i % 4}?a=1&b=2") for i in range(1000)]
    marks = [(i, 1, int(i % 4 == 1)) for i in range(1000)]
    started = time.perf_counter()
    mined = url_filter.mine_rules(pages(spark, rows), labels(spark, marks))
    assert [r.tokens for r in mined.rules.collect()] == [["path:s1"]]
    assert mined.items.select("head").distinct().count() == 5
    assert blocked(url_filter.judge(pages(spark, rows), labels(spark, marks))) == set(range(1, 1000, 4))
    assert time.perf_counter() - started < 120


def test_a_bad_host_is_learned_at_any_share_of_bad_pages(spark):
    for share in (0.1, 0.8):
        rows = [(i, f"http://h{i % 40}.example/p{i % 7}") for i in range(2000)]
        marks = [(i, 1, int(i % 40 == 5 or (i // 40 * 37 + i * 11) % 100 < 100 * share)) for i in range(2000)]
        found = blocked(url_filter.judge(pages(spark, rows), labels(spark, marks)))
        assert {i for i in range(2000) if i % 40 == 5} <= found


# --- HTML -----------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style>
<script>var a="</p>";</script></head><body class="home"><!-- a > b -->
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a><li><a href='/x>y'>News</a></ul></nav>
<div class="cookie-notice">We use cookies.</div>
<article><header><h1>A&nbsp;title &amp; more</h1></header><p>First <b>bold</b>ly
written<br>line.<p>Second &lt;one&gt; 1 < 2.<aside>By the way</aside><blockquote>Quoted</blockquote>
<form><label>Mail</label><input></form><div class="ad">Buy!</div><section id="comments"><p>Nice!</p></section></article>
<footer>&copy; us"""


def test_a_page_with_everything():
    text = html_extract.main_text(PAGE, {})
    assert text == "A title & more First boldly written line. Second <one> 1 < 2. Quoted"


@pytest.mark.parametrize(
    "page",
    [
        "<body class='has-sidebar'><main>{}</main>",
        "<body class='no-sidebar comments-open'><article>{}</article>",
        "<div class='content-sidebar-wrap'><main>{}</main></div>",
        "<div id='search-results-article'><p>{}</p></div>",
        "<form><main>{}</main></form>",
    ],
)
def test_names_on_wrappers_are_no_veto(page):
    assert html_extract.main_text(page.format("The text."), {}) == "The text."


BOILER_NAMES = """comments-section comment-list user-comments article-comments post-comments related-posts social-links
cookie-bar sidebar-left nav-links post-navigation article-ad ad-slot entry-footer newsletter-box comment-thread
share-buttons promo-box story-share signup-form ad_unit""".split()
PLAIN_NAMES = """has-sidebar no-sidebar comments-open content-sidebar-wrap search-results-article with-ads page-header-grid
article-body entry-content post-content story-text main-column""".split()


def test_named_parts_on_labelled_pages(spark):
    """Hand-written pages with each name inside and outside the article, costs learned from the driver's pages."""
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    odds = html_extract.train(table)
    body = "<p>The council met on Monday to hear the plan for the old bridge over the river.</p>"
    other = "<p>I think this is a fine idea, thanks for telling us about it.</p>"
    text = "The council met on Monday to hear the plan for the old bridge over the river."
    kept = lost = wrong = 0
    for name in BOILER_NAMES:
        for page in (
            f"<body><article>{body}{body}<div class='{name}'>{other}</div></article>",
            f"<body><main>{body}{body}</main><div id='{name}'>{other}</div>",
        ):
            found = html_extract.main_text(page, odds)
            wrong += "fine idea" in found
            lost += found.count(text) < 2
            kept += 1
    for name in PLAIN_NAMES:
        for page in (f"<body><div class='{name}'><article>{body}</article></div>", f"<body><article><div class='{name}'>{body}</div></article>"):
            lost += html_extract.main_text(page, odds) != text
            kept += 1
    assert html_extract.main_text(f"<body><form action='/'><nav>Home</nav><article>{body}{body}</article></form>", odds).count(text) == 2
    assert "Mail" not in html_extract.main_text(f"<body><article>{body}<form>Mail me</form></article>", odds)
    # Recall of the article and precision against what is around it, over these pages.
    assert (wrong, lost, kept) == (0, 0, 2 * (len(BOILER_NAMES) + len(PLAIN_NAMES)))


def test_without_marked_regions_the_classifier_decides():
    odds = {"length 8": 2.0, "tag p": 1.0, "linked 4": -4.0, "linked 0": 0.3, "tag li": -1.0}
    long = "word " * 30
    page = f"<body><ul><li><a>One</a><li><a>Two</a></ul><div><p>{long}<p>Short.<p>{long}</div>"
    assert html_extract.main_text(page, odds) == " ".join([long.strip(), "Short.", long.strip()])


@pytest.mark.parametrize("seed", range(40))
def test_cut_is_minimal(seed):
    import random

    rng = random.Random(seed)
    n = rng.randint(1, 9)
    own = [rng.uniform(-1.5, 1.5) for _ in range(n)]
    edges = [
        (i, j, rng.choice([0.15, 0.6, 0.8]))
        for i in range(n)
        for j in range(i + 1, n)
        if rng.random() < 0.5
    ]

    def cost(label):
        cut = sum(w for i, j, w in edges if label[i] != label[j])
        return cut + sum(max(o, 0) if not x else max(-o, 0) for o, x in zip(own, label, strict=True))

    least = min(cost(x) for x in product([True, False], repeat=n))
    assert cost(html_extract.min_cut(own, edges)) == pytest.approx(least, abs=1e-5)


def test_awkward_pages(spark):
    rows = [
        (1, "u", None),
        (2, None, ""),
        (None, "u", "just text"),
        (3, "u", "<script>never closed " + "x" * 1000),
        (4, "u", "<p>" * 3000 + "<main>deep</main>" + "</div>" * 3000),
        (5, "u", "<main>" + "<p>w &amp; ü</p>" * 30_000),
        (5, "u", "<main>a<!-- open"),
        (6, "u", "< 3 <main>a</main"),
    ]
    df = spark.createDataFrame(
        [(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, tag string"
    )
    found = html_extract.extract(df).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    got = {(r.page_id, len(r.text)): r.text for r in found}
    assert got[(1, 0)] == got[(2, 0)] == got[(3, 0)] == ""
    assert got[(4, 4)] == "deep" and got[(5, 1)] == "a"
    assert " ".join(["w & ü"] * 30_000) in got.values()
    assert html_extract.extract(df.limit(0)).count() == 0
