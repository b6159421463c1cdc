"""Operators that pass columns through do so whatever the columns are called."""

import inspect
import re

import pytest

import ledgerrecon.llm.decontaminate
import ledgerrecon.llm.html_text
import ledgerrecon.llm.licenses
import ledgerrecon.llm.quality
import ledgerrecon.llm.secrets
import ledgerrecon.llm.substrings
import ledgerrecon.llm.urls
from ledgerrecon.llm import licenses, urls
from ledgerrecon.llm.decontaminate import cut_passages
from ledgerrecon.llm.html_text import extract_main_text
from ledgerrecon.llm.licenses import find_licenses
from ledgerrecon.llm.quality import COUNTS, judge
from ledgerrecon.llm.secrets import find_secrets, redact_secrets
from ledgerrecon.llm.substrings import remove_repeats
from ledgerrecon.llm.urls import judge_urls, site_rule, word_rule

PROSE = " ".join(f"word{i}" for i in range(70))
TEXTS = [PROSE, PROSE + " password = hunter2hunter2", "License: MIT\nother", None, "", "casino http"]


def names_in(module, taken):
    """Every string of a module that could be a column."""
    found = re.findall(r"[\"\']([A-Za-z_][A-Za-z0-9_]*)[\"\']", inspect.getsource(module))
    found += re.findall(r"(_[a-z]+)", inspect.getsource(module))
    return sorted({n.lower() for n in found} - taken)


def operators(spark):
    labels = spark.createDataFrame([(0, 1), (5, 0)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(5, 25)))], "item_id long, text string")
    rules = [site_rule("block", "net/"), word_rule("block", "casino")]
    counts = {*COUNTS, "base_failed", "rule", "kept"}
    return {
        "judge": (ledgerrecon.llm.quality, lambda d: judge(d, labels)[0], counts),
        "remove_repeats": (ledgerrecon.llm.substrings, remove_repeats, {"n_words", "n_removed", "kept_text"}),
        "find_secrets": (ledgerrecon.llm.secrets, find_secrets, {"base_spans", "spans"}),
        "redact_secrets": (ledgerrecon.llm.secrets, redact_secrets, set()),
        "find_licenses": (ledgerrecon.llm.licenses, find_licenses, {"text_digest", "license_id", "notices"}),
        "judge_urls": (ledgerrecon.llm.urls, lambda d: judge_urls(d, rules, url_col="text"), {"host", "path", "rule", "verdict"}),
        "cut_passages": (ledgerrecon.llm.decontaminate, lambda d: cut_passages(d, items), set()),
        "extract_main_text": (ledgerrecon.llm.html_text, lambda d: extract_main_text(
            d.withColumnRenamed("text", "page"), "page", "page"), {"text"}),
    }


@pytest.mark.parametrize("name", ["judge", "remove_repeats", "find_secrets", "redact_secrets", "find_licenses", "judge_urls", "cut_passages", "extract_main_text"])
def test_any_column_name_passes_through(spark, name):
    module, run, added = operators(spark)[name]
    extra = names_in(module, {"doc_id", "text", "page", "n_chars"} | added)
    assert len(extra) > 15
    plain = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    full = plain.selectExpr("*", *[f"concat('own {k} ', doc_id) AS `{c}`" for k, c in enumerate(extra)])
    want = run(plain)
    got = run(full)
    assert set(got.columns) == set(want.columns) | set(extra)
    key = lambda r: str(r["doc_id"])
    rows = sorted(got.collect(), key=key)
    assert [tuple(r[c] for c in want.columns) for r in rows] == [tuple(r) for r in sorted(want.collect(), key=key)]
    assert {c for r in rows for k, c in enumerate(extra) if r[c] != f"own {k} {r['doc_id']}"} == set()


def test_long_rule_lists_are_joined(spark, monkeypatch):
    rules = [site_rule("block", "net/"), site_rule("allow", "example.net/en/"), word_rule("block", "cheap", "pills"), word_rule("block", "casino")]
    addresses = ["http://a.example.net/en/x", "http://a.example.net/de/", "https://www.cheap-pills.org/", "http://casino.org", None, "", "no host"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(addresses * 2)], "page_id long, url string")
    one = sorted(map(str, judge_urls(pages, rules).collect()))
    monkeypatch.setattr(urls, "INDEX_RULES", 1)
    assert sorted(map(str, judge_urls(pages, rules).collect())) == one
    monkeypatch.setattr(urls, "BROADCAST_RULES", 1)
    assert sorted(map(str, judge_urls(pages, rules).collect())) == one


def test_long_lists_of_known_texts_are_joined(spark, monkeypatch):
    known = spark.createDataFrame([("A", "one two three"), ("B", "four five"), ("C", "Four, FIVE!"), (None, "x"), ("D", " ")], "license_id string, text string")
    docs = spark.createDataFrame([(1, "one two\nthree"), (2, "x\nfour five\nOne two three."), (3, None), (3, "four five"), (4, "")], "doc_id long, text string")
    one = sorted(map(str, find_licenses(docs, known).collect()))
    monkeypatch.setattr(licenses, "MAX_NOTICES", 1)
    assert sorted(map(str, find_licenses(docs, known).collect())) == one
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 0)
    assert sorted(map(str, find_licenses(docs, known).collect())) == one


@pytest.mark.parametrize("length", [20, 25, 30, 45])
def test_windows_of_any_length(spark, length):
    shared = " ".join(f"s{i}" for i in range(60))
    texts = [f"a b {shared} c", f"{shared} d", " ".join(f"s{i}" for i in range(length - 1)), f"x {' '.join(f's{i}' for i in range(3, 3 + length))} y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeats(docs, length=length).collect()}
    assert got == {0: 0, 1: 60, 2: 0, 3: length}
