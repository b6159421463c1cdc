"""HTML extraction, ranked search and spelling variants against brute force, and their edge cases."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerrecon.llm import html_text, search
from ledgerrecon.llm.html_text import extract_main_text, main_text
from ledgerrecon.llm.queries import QUERIES
from ledgerrecon.llm.search import Best, Block, ranked_search, search_block
from ledgerrecon.llm.spelling import count_words, group_variants

DOCS = "doc_id long, text string"


# --- spelling variants ------------------------------------------------------

def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def grouped(counts, factor=10):
    """(word, n, n_near, form, form_n, root) of each word, by comparing all pairs."""
    gaps = defaultdict(set)
    for word in counts:
        for i in range(len(word)):
            gaps[word[:i] + word[i + 1 :]].add(word)
        gaps[word].add(word)
    others = defaultdict(set)
    for group in gaps.values():
        for a in group:
            others[a].update(b for b in group if near(a, b))
    form = {}
    for word, n in counts.items():
        best = min(others[word], key=lambda w: (-counts[w], w), default=None)
        form[word] = best if best and counts[best] >= factor * n else None
    out = set()
    for word, n in counts.items():
        root = word
        while form[root]:
            root = form[root]
        out.add((word, n, len(others[word]), form[word], counts.get(form[word]), root))
    return out


def words_of(rows, min_length=7, min_count=2, drop_every=31):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            code = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if drop_every and code % drop_every == 0:
                run = run[: code % len(run)] + run[code % len(run) + 1 :]
            if len(run) >= min_length:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= min_count}


def test_spelling_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_spelling_variants"](spark, sf_dir).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert {tuple(r) for r in got} == grouped(words_of(rows)) and len(got) == len({r["word"] for r in got})


def test_spelling_edges(spark):
    long = "aé" * 2000
    rows = [(1, None), (2, ""), (None, "Ação AÇÃO ação"), (3, "abcdefg abcdefg " * 300), (3, "abcdefg abcdefg " * 300),
            (4, "abcdxefg " * 50), (4, "abcdefx " * 3), (5, f"{long} {long} {long}x {long}x"), (6, "ÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀ ÷×÷×÷×÷ ÷×÷×÷×÷")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text", "doc_id AS id", "text AS word", "1 AS n", "'x' AS node")
    got = group_variants(count_words(docs, drop_every=None)).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert {tuple(r) for r in got} == grouped(words_of(rows, drop_every=None))
    assert group_variants(count_words(docs.limit(0))).count() == 0


def test_spelling_chain_and_ties(spark):
    counts = {"aaaaaaa": 10_000, "aaaaaab": 900, "aaaaabb": 80, "aaaabbb": 7, "aaaaaac": 900, "ccaaaaa": 3, "caaaaaa": 30, "daaaaaa": 30}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = group_variants(words).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert {tuple(r) for r in got} == grouped(counts)
    assert {r["root"] for r in got if r["word"] == "aaaabbb"} == {"aaaaaaa"}


@settings(max_examples=6, deadline=None)
@given(st.dictionaries(st.text("abé", min_size=2, max_size=7), st.integers(1, 500), max_size=60))
def test_spelling_any_words(spark, counts):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = group_variants(words).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert {tuple(r) for r in got} == grouped(counts)


# --- ranked search ----------------------------------------------------------

def test_search_edges(spark):
    rows = [(1, "Alpha beta beta"), (1, "Alpha beta beta"), (None, "alpha beta beta"), (2, None), (3, ""), (4, "-- !"), (5, "gamma " * 50_000)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'q' AS query", "1 AS score", "'t' AS terms")
    items = spark.createDataFrame([(1, "alpha ALPHA zeta"), (1, "alpha ALPHA zeta"), (2, None), (3, "zeta"), (4, "gamma-beta")],
                                  "item_id long, text string")
    got = [tuple(r) for r in ranked_search(docs, items, k=2).orderBy("item_id", "rank").collect()]
    assert [g[:3] for g in got] == [(1, 1, None), (1, 2, 1), (4, 1, 5), (4, 2, None)]
    assert got[0][3] == got[1][3] > 0
    assert ranked_search(docs.limit(0), items).count() == 0 and ranked_search(docs, items.limit(0)).count() == 0


def random_block(random, rows, terms):
    lists, joint = {}, {}
    for t in range(terms):
        docs = np.flatnonzero(random.random(rows) < random.uniform(0.05, 0.9))
        if len(docs):
            lists[f"t{t}"] = (docs, random.integers(1, 1000, len(docs)) ** 2)
    names = sorted(lists)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            dense = np.zeros((2, rows), np.int64)
            dense[0, lists[a][0]], dense[1, lists[b][0]] = lists[a][1], lists[b][1]
            shared = (dense > 0).all(0)
            joint[a, b] = joint[b, a] = (int(dense.sum(0)[shared].max()) if shared.any() else 0, np.packbits(shared).tobytes())
    return Block(rows, lists, {t: int(x.max()) for t, (_, x) in lists.items()}, joint)


def test_pair_bounds_skip_more_and_lose_nothing():
    random = np.random.default_rng(7)
    looked = Counter()
    for _ in range(60):
        block = random_block(random, 400, 9)
        query = {t: int(random.integers(1, 4)) for t in [*block.lists, "absent"]}
        full = np.zeros(400, np.int64)
        for t, (docs, impacts) in block.lists.items():
            full[docs] += query[t] * impacts
        for least in (0, int(np.sort(full)[-20]), int(np.sort(full)[-3])):
            want = np.flatnonzero(full >= max(least, 1))
            for pairs in (True, False):
                rows, score, n = search_block(block, query, least, pairs)
                assert rows.tolist() == want.tolist() and score.tolist() == full[want].tolist()
                looked[pairs] += n
    assert looked[True] < looked[False]


def test_best_keeps_order():
    best = Best(3)
    best.add(np.array([5, 7]), [9, 4])
    best.add(np.array([7, 5, 5]), [2, None, 1])
    assert list(zip(best.score.tolist(), best.known.tolist(), best.id.tolist())) == [(7, 1, 2), (7, 1, 4), (5, 0, 0)]
    assert best.least == 5


def test_search_in_many_passes(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    once = sorted(map(tuple, ranked_search(docs, items, 5).collect()))
    monkeypatch.setattr(search, "PASS_TERMS", 500)
    assert sorted(map(tuple, ranked_search(docs, items, 5).collect())) == once


# --- html extraction --------------------------------------------------------

def test_html_query(spark, sf_dir):
    """The given pages hold one article element each; all blocks of it, and nothing else, are the text."""
    import html

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = QUERIES["op11_html_extraction"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for row in got:
        body = re.search(r"<article>(.*?)(</article>|\Z)", pages[row["page_id"]]["html"], re.S)[1]
        body = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", body))
        want = " ".join(html.unescape(body).split())
        assert (row["text"], row["n_chars"]) == (want, len(want))


@pytest.mark.parametrize("source,want", [
    (None, ""), ("", ""), ("no markup &amp; more", "no markup & more"), ("<p>a<b>b</b>c<br>d &lt;e&gt;\n\n f</p>", "abc d <e> f"),
    ("<body><nav>x<article><p>one<aside>no</aside></article>", "one"),
    ("<body><header>site</header><main><header><h1>T</h1></header><p>x</p><form>f</form></main><footer>y", "T x"),
    ("<body><div class='Cookie-notice'>c</div><div class=adBox>a</div><div id=read>r<div role=navigation>n</div></div>", "r"),
    ("<article>a<section class=comments><article class=comment>c</article></section></article>", "a"),
    ("<p>a</p><script>var s='<p>x</p>';</script><style>p{}</style><!-- <p>c</p> --><p>b", "a b"),
    ("</div></p>a<p", "a"), ("<textarea>t</textarea><p title=\"a>b\">q</p>", "q"), ("<ul><li>a<li>b</ul>", "a b"),
    ("<p>" + "long words " * 50_000, ("long words " * 50_000).strip()),
])
def test_html_without_template(source, want):
    assert main_text(source) == want


def test_html_template_texts_and_copies(spark):
    page = "<html><body><div><p>{shared}</p><p>{own}</p></div><div><p>Subscribe today</p></div></body></html>"
    rows = [(i, "http://a.example/x", page.format(shared="Read this first", own=f"text {i} here"), "t") for i in range(10)]
    rows += [(20 + i, "HTTP://A.EXAMPLE/y", rows[0][2], "t") for i in range(30)]
    rows += [(60 + i, "http://few.example/", rows[0][2], "t") for i in range(30)]  # copies are no support
    rows += [(100, None, None, None), (101, "no host", "<p>x", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").selectExpr("*", "1 AS _host", "2 AS _fixed", "3 AS token")
    got = {r["page_id"]: r for r in extract_main_text(pages).collect()}
    assert got[3]["text"] == "text 3 here" and got[25]["text"] == "text 0 here"
    assert got[60]["text"] == "Read this first text 0 here Subscribe today"
    assert got[100]["text"] == "" and got[101]["text"] == "x" and got[0]["_fixed"] == 2
    assert extract_main_text(pages.limit(0)).count() == 0


def test_html_templates_joined_by_host(spark, sf_dir, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    once = sorted(map(tuple, extract_main_text(pages).collect()))
    monkeypatch.setattr(html_text, "BROADCAST_TOKENS", -1)
    assert sorted(map(tuple, extract_main_text(pages).collect())) == once


def test_repeated_template_texts_are_told_apart_by_their_place(spark):
    # "more" stands before and behind the text in every page: no page has it once, each of its roles does
    page = "<html><body><div class=a><p>more</p></div><div class=b><p>own words {0}</p>{1}</div><div class=a><p>more</p></div></body></html>"
    rows = [(k, "http://h.net/", page.format(k, "<p>more</p>" if k == 3 else "")) for k in range(12)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"own words {k}" + (" more" if k == 3 else "") for k in range(12)}
