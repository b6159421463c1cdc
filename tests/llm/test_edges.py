"""NULLs, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import re
import textwrap

import pytest
from pyspark.sql import functions as F

from ledgerrecon.llm.common import tokenizer_path
from ledgerrecon.llm.decontaminate import cut_passages, find_passages
from ledgerrecon.llm.jaccard import similar_documents
from ledgerrecon.llm.licenses import KNOWN_TEXTS, find_licenses, whole_texts
from ledgerrecon.llm.packing import assign_sequences, token_pieces
from ledgerrecon.llm.quality import judge
from ledgerrecon.llm.secrets import find_secrets, redact_secrets
from ledgerrecon.llm.sharding import shard_by_size
from ledgerrecon.llm.substrings import remove_repeats
from ledgerrecon.llm.token_files import read_tokens, write_tokens
from ledgerrecon.llm.urls import judge_urls, site_rule
from ledgerrecon.session import shared_path

PROSE = " ".join(f"word{i}" for i in range(60))
SCHEMA = (
    "doc_id long, text string, lang string, n_words string, size string, shard string, hash string, key string, id string, "
    "cls string, label string, spans string, hit_runs string, kept string, start string, ids string, length string, part string"
)


def frame(spark, rows):
    extra = len(SCHEMA.split(",")) - 2
    return spark.createDataFrame([(*r, *[f"x{k}" for k in range(extra)]) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """A NULL id, a NULL text, empty and blank texts, repeated rows, one id twice, a long text."""
    return frame(spark, [
        (None, PROSE), (1, None), (2, ""), (3, " \n\t "), (4, PROSE), (4, PROSE), (5, "other text"), (5, PROSE + " tail"),
        (6, " ".join(f"long{i % 5000}" for i in range(60_000))), (7, "five words are in here"), (7, None),
    ])


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(
        [(1, " ".join(f"word{i}" for i in range(5, 25))), (2, "in here"), (3, None), (None, "tail"), (4, "...")], "item_id long, text string"
    )


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 0, 0), (None, 0, 1), (7, None, 0)], "doc_id long, quality int, toxic int")


def test_decontaminate(spark, odd, none, benchmark):
    found = find_passages(odd, benchmark)
    assert found.drop("n_words", "hit_runs", "hit_items").columns == odd.drop("n_words", "hit_runs").columns
    rows = found.select("doc_id", F.substring("text", 1, 5), "n_words", "hit_runs", "hit_items").collect()
    by = {(r[0], r[1]): ([tuple(x) for x in r[3]], r[4]) for r in rows}
    assert by[4, "word0"] == ([(5, 25)], ["1"]) and by[None, "word0"] == ([(5, 25)], ["1"])
    assert by[7, "five "] == ([(3, 5)], ["2"]) and by[7, None] == ([], []) and by[2, ""] == ([], [])
    assert {r["n_words"] for r in rows if r["doc_id"] == 6} == {60_000}
    assert find_passages(none, benchmark).count() == 0
    assert find_passages(odd, benchmark.limit(0)).where("size(hit_runs) > 0").count() == 0


def test_cut_until_clean(spark, benchmark):
    words = [f"word{i}" for i in range(5, 25)]
    nested = " ".join([*words[:5], *words[2:14], *words[5:], "clean", "end", "of", "it", *map(str, range(40))])
    docs = spark.createDataFrame([(1, nested, len(nested)), (2, "untouched  text\n", 16), (3, " ".join(words), 9), (4, None, None)], "doc_id long, text string, n_chars int")
    cut = {r["doc_id"]: r for r in cut_passages(docs, benchmark).collect()}
    assert set(cut) == {1, 2, 4} and cut[2]["text"] == "untouched  text\n" and cut[4]["text"] is None
    assert cut[1]["n_chars"] == len(cut[1]["text"]) < len(nested) and "clean end" in cut[1]["text"]
    again = find_passages(spark.createDataFrame(list(cut.values()), docs.schema), benchmark)
    assert again.where("size(hit_runs) > 0").count() == 0


def test_quality(spark, odd, none, labels):
    judged, rules = judge(odd, labels)
    rows = judged.select("doc_id", "n_words", "base_failed", "kept").collect()
    assert rules == [] and len(rows) == odd.count()
    assert {(r["n_words"], r["base_failed"]) for r in rows if r["doc_id"] in (1, 2, 3)} == {(0, True)}
    assert judge(none, labels)[0].count() == 0
    assert judge(odd, labels.limit(0))[0].where("kept").count() == sum(r["kept"] for r in rows)


def test_packing(spark, odd, none):
    path = tokenizer_path("byte_bpe_50k.json")
    packed = assign_sequences(token_pieces(odd, path, 0, 2048), 2048)
    rows = packed.collect()
    assert sum(r["length"] == 1 for r in rows) == 3 and len({r["doc_id"] for r in rows}) == 8
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert assign_sequences(token_pieces(none, path, 0, 2048), 2048).count() == 0


def test_token_files(spark, odd, none):
    path = tokenizer_path("word_bpe_49k.json")
    for docs in (odd, none):
        folder = shared_path(spark, "tokens")
        write_tokens(docs, folder, path, 1)
        rows = sorted(read_tokens(spark, folder).collect(), key=lambda r: r["start"])
        assert len(rows) == docs.count()
        at = 0
        for row in rows:
            assert row["start"] == at
            at += len(row["ids"]) // 4
        assert [r["doc_id"] for r in rows][1:] == sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] is not None)[0 if docs is odd else 1:]


def test_sharding(spark, odd, none):
    rows = shard_by_size(odd, 3).collect()
    assert len(rows) == odd.count() and {r["shard"] for r in rows} <= {0, 1, 2}
    prose = {r["shard"] for r in rows if r["size"] == len(PROSE) + 16}
    assert len(prose) == 1
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] == 1} == {(16, 0)}
    assert shard_by_size(none, 3).count() == 0
    with pytest.raises(ValueError):
        shard_by_size(odd, 0)


def test_substrings(spark, odd, none):
    out = remove_repeats(odd)
    rows = {(r["doc_id"], (r["text"] or "")[-5:]): (r["n_words"], r["n_removed"]) for r in out.collect()}
    assert out.count() == odd.count() and "lang" in out.columns
    assert rows[None, "ord59"] == (60, 0) and rows[4, "ord59"] == (60, 60) and rows[5, " tail"] == (61, 60)
    assert rows[6, "g4999"] == (60_000, 55_000) and rows[1, ""] == (0, 0)
    assert remove_repeats(none).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_substrings_of_repeated_rows(spark, parts):
    alone = " ".join(f"alone{i}" for i in range(60))
    twice = " ".join([*(f"twice{i}" for i in range(30)), "between", *(f"twice{i}" for i in range(30))])
    rows = [(4, alone)] * 3 + [(None, PROSE)] * 2 + [(7, PROSE)] * 2 + [(8, twice)] * 2 + [(9, "x " + alone)]
    got = remove_repeats(frame(spark, rows).repartition(parts, F.rand(1))).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in got) == [
        (0, 60, 0), (0, 60, 0), (4, 60, 0), (4, 60, 0), (4, 60, 0), (7, 60, 60), (7, 60, 60), (8, 61, 30), (8, 61, 30), (9, 61, 60),
    ]
    assert {r["kept_text"] for r in got if r["doc_id"] == 4} == {alone}
    assert {r["kept_text"] for r in got if r["doc_id"] == 8} == {" ".join(twice.split()[:31])}


def test_secrets(spark, odd, none):
    docs = odd.withColumn("text", F.when(F.col("doc_id") == 7, F.concat(F.lit("é 𝄞 password = '"), F.lit("hunter22' AKIA"), F.lit("ABCDEFGH23456789"))).otherwise(F.col("text")))
    rows = find_secrets(docs).where("size(spans) > 0").collect()
    assert {r["doc_id"] for r in rows} == {7}
    assert [(s["kind"], s["start"], s["end"]) for s in rows[0]["base_spans"]] == [("assign", 4, 24), ("access", 26, 46)]
    clean = redact_secrets(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert {r["text"] for r in clean.where("doc_id = 7").collect()} == {"é 𝄞 [SECRET]' [SECRET]"}
    assert find_secrets(none).count() == 0 and redact_secrets(none).count() == 0


def test_jaccard(spark, odd, none):
    rows = similar_documents(odd).collect()
    assert len(rows) == odd.count()
    prose = [r for r in rows if r["n_shingles"] in (56, 57)]
    assert len(prose) == 4 and {r["component_id"] for r in prose} == {4}
    assert {(r["id"], r["component_id"]) for r in rows if r["n_shingles"] == 0} == {(1, 1), (2, 2), (3, 3), (7, 7)}
    assert similar_documents(none).count() == 0


def test_urls(spark):
    rules = [site_rule("block", "net/"), site_rule("allow", "example.net/en/")]
    pages = spark.createDataFrame([
        (1, "http://A.Example.NET/en/x?y", "r"), (2, "https://example.net/english", "r"), (3, None, "r"), (4, "", "r"), (5, "no scheme.net/", "r"),
        (6, "http://notexample.net/en/", "r"), (7, "http://example.net", "r"), (8, "x://y://net/", "r"), (1, "http://A.Example.NET/en/x?y", "r"),
    ], "page_id long, url string, rule string")
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, rules).collect()}
    assert rows[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert rows[2][2:] == ("net/", "block") and rows[6][2:] == ("net/", "block") and rows[7][2:] == (None, "allow")
    assert rows[3] == rows[4] == rows[5] == ("", "", None, "allow") and rows[8][:2] == ("y:", "//net/")
    assert judge_urls(pages, []).where("verdict = 'allow'").count() == 9
    assert judge_urls(pages.limit(0), rules).count() == 0


def test_licenses(spark, odd, none):
    mit = dict(KNOWN_TEXTS[2:3])["MIT"]
    docs = spark.createDataFrame([
        (1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "sub-license") + " --- \n", "a"), (2, "some prose\n  *LICENSED under CC BY-NC 4.0*\nmore", "a"),
        (3, "Released under the MIT Licence.\nLicensed under the Apache License, Version 2.0.", "a"), (4, None, "a"), (5, " ...\n(c) me", "a"), (6, mit[:-20], "a"),
        (7, "Released under the MIT License.", "a"), (7, "Released under the MIT License.", "a"),
    ], "doc_id long, text string, license_id string")
    rows = find_licenses(docs).collect()
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in rows}
    assert len(rows) == 8 and got == {
        1: ("MIT", []), 2: (None, ["CC-BY-NC-4.0"]), 3: (None, ["Apache-2.0", "MIT"]), 4: (None, []), 5: (None, []), 6: (None, []), 7: ("MIT", ["MIT"]),
    }
    assert {r["doc_id"] for r in rows if r["text_digest"] is None} == {4, 5}
    assert find_licenses(odd).where("license_id is not null").count() == 0 and find_licenses(none).count() == 0
    assert find_licenses(docs, docs.select("license_id", "text").limit(0)).where("size(notices) > 0").count() == 0


def rewrapped(text, width):
    """Paragraphs and list items filled anew; lines that name the owner stay lines."""
    parts = re.split(r"(\n[ \t]*\n|\n(?=[ \t]*(?:\d\.|\*|\([a-z]\)) )|(?<=\n)[ \t]*Copyright (?:\(C\) 2|\[)[^\n]*\n)", text)
    return "".join(x if k % 2 else "\n" * (k > 0) + textwrap.fill(" ".join(x.split()), width, break_long_words=False, break_on_hyphens=False) for k, x in enumerate(parts))


def test_licenses_however_wrapped(spark):
    texts = [(name, text) for name, text in (*KNOWN_TEXTS, *whole_texts()) if len(text) > 400]
    assert {name for name, _ in texts} == {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "CC0-1.0"}
    rows = [(f"{name} {k} {width}", name, "Copyright (c) 2020, Some One\nAll rights reserved.\n\n" + rewrapped(text, width))
            for k, (name, text) in enumerate(texts) for width in (40, 60, 64, 68, 72, 76, 80, 100, 120)]
    docs = spark.createDataFrame(rows, "key string, name string, text string").repartition(4)
    missed = find_licenses(docs, keep_text=False).where("license_id is null or license_id <> name").select("key").collect()
    assert [r["key"] for r in missed] == []


def test_licenses_of_wrapped_isc(spark):
    isc = next(text for name, text in KNOWN_TEXTS if name == "ISC" and text.startswith("Permission"))
    wrapped = isc.replace("\n", " ").replace("above copyright", "above\ncopyright").replace("all copies. ", "all copies.\n\n")
    docs = spark.createDataFrame([(1, "Copyright 2019 Me <me@x.org>\n\n" + wrapped)], "doc_id long, text string")
    assert [r["license_id"] for r in find_licenses(docs).collect()] == ["ISC"]
