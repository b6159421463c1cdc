"""Stages of the pipeline with NULL ids, repeated rows and clashing columns."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from ledgerrecon.llm import common, jaccard, quality
from ledgerrecon.llm.common import tokenizer_path
from ledgerrecon.llm.quality import judge
from ledgerrecon.llm.secrets import find_secrets

WORDS = [f"word{i}" for i in range(60)]
PROSE = " ".join(WORDS)
CLASHING = (
    "n_words", "word_chars", "base_failed", "rule", "kept", "hit_items", "hit_runs", "spans", "base_spans", "_candidates", "_cut",
    "_row", "_text", "_keeper", "_copies", "component_id", "n_shingles", "id", "cls", "piece", "length", "start", "offset", "ids",
)


def texts(name, n=60):
    return " ".join(f"{name}{i}" for i in range(n))


def frame(spark, rows):
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *(f"own {c}" for c in CLASHING)) for r in rows], schema)


def test_near_duplicates_keep_one_row(spark):
    rows = [
        (None, texts("alone")), (None, texts("group")), (None, texts("group") + " tail"), (3, texts("twice")), (3, texts("twice")), (3, texts("twice")),
        (None, PROSE), (9, PROSE), (5, PROSE + " tail"), (5, PROSE + " tail"), (1, None), (1, None), (None, ""), (7, "same"), (7, "other words are here now and here"),
    ]
    docs = frame(spark, rows)
    out = pipeline.near_duplicates(spark, docs, "")
    kept = Counter((r["doc_id"], r["text"]) for r in out.collect())
    group = [k for k in kept if k[1] and k[1].startswith("group0")]
    assert out.columns == docs.columns and out.schema == docs.schema
    assert len(group) == 1 and kept.pop(group[0]) == 1
    assert kept == {
        (None, texts("alone")): 1, (3, texts("twice")): 1, (5, PROSE + " tail"): 1, (1, None): 2, (None, ""): 1, (7, "same"): 1,
        (7, "other words are here now and here"): 1,
    }
    assert {r[c] for r in out.collect() for c in CLASHING} == {f"own {c}" for c in CLASHING}


def test_near_duplicates_leave_the_texts_where_they_lie(spark):
    """Rows that go are few numbers for all tasks; no whole text is shuffled to meet its verdict."""
    docs = spark.createDataFrame([(k, texts(f"own{k // 2}")) for k in range(8)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = pipeline.near_duplicates(spark, docs, "")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["doc_id"] for r in out.collect()) == [0, 2, 4, 6]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def noise(rng, n, length=7):
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=length)) for _ in range(n))


@pytest.mark.parametrize("name", ["quality_rules", "secret_scans", "best_fit_packing"])
def test_stages_leave_no_texts_behind(spark, tmp_path, monkeypatch, name):
    """What a stage has stored when its result is read is far smaller than the texts, or the ids, that go through it."""
    rng = random.Random(name)
    docs = spark.createDataFrame([(k, noise(rng, 400) + " password = 'hunter22'") for k in range(100)], "doc_id long, text string")
    spark.createDataFrame([(k, k % 2, 0) for k in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(common, "shared_path", lambda spark, label: f"{tmp_path}/stored/{label}-{rng.random()}")
    assert getattr(pipeline, name)(spark, docs, str(tmp_path)).count() >= 100
    stored = sum(f.stat().st_size for f in (tmp_path / "stored").rglob("*.parquet"))
    assert stored < 400 * 8 * 100 / 4


def test_rules_are_the_same_with_and_without_texts(spark, monkeypatch):
    """Rows to train on are found by ids alone; with a cut through them, repeated ids and NULLs, they are those of the stored counts."""
    rng = random.Random(5)
    ids = [k // 2 if k % 3 else k for k in range(400)]
    rows = [(i, PROSE + (" # $ %" * 9 if i % 4 == 0 else f" {noise(rng, i % 40)}")) for i in ids] + [(None, PROSE), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(500)] + [(8, 1), (None, 0), (9, None)], "doc_id int, quality int")
    for most in (40_000, 150):
        monkeypatch.setattr(quality, "TRAIN_ROWS", most)
        (judged, rules), (narrow, same) = judge(docs, labels), judge(docs, labels, keep_text=False)
        assert rules == same and judged.drop("text").exceptAll(narrow).count() == 0 and judged.count() == narrow.count() == len(rows)
        assert rules


def test_spans_are_the_same_with_and_without_texts(spark):
    """Candidates that are tested once for the bound and again for the spans give those of the stored scan."""
    rng = random.Random(6)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = [(k, f"see {''.join(rng.choices(letters, k=40))} and {'source/library/' * 4} x") for k in range(30)] + [(50, None), (51, "no such thing"), (51, "token: abcdef99")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found, narrow = find_secrets(docs), find_secrets(docs, keep_text=False)
    assert found.drop("text").exceptAll(narrow).count() == 0 and found.count() == narrow.count() == len(rows)
    assert found.where("exists(spans, s -> s.kind = 'random')").count() >= 25


def test_lower_halves_are_stored_for_near_pairs_only(spark, monkeypatch):
    stored, stage = [], jaccard.stage

    def seen(df, label, paths=None):
        out = stage(df, label, paths)
        if label == "sets":
            stored.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(jaccard, "stage", seen)
    rng = random.Random(7)
    own = [noise(rng, 200).split() for _ in range(12)]
    # copies with a word changed at the end, and one at the threshold: 84 of 112 n-grams are shared
    rows = [(k, " ".join(words)) for k, words in enumerate(own)] + [(100 + k, " ".join([*words[:-1], "other"])) for k, words in enumerate(own[:11])]
    first = noise(rng, 102).split()
    rows += [(200, " ".join(first)), (201, " ".join([*first[:88], *noise(rng, 14).split()])), (202, " ".join([*first[:88], *noise(rng, 14).split()]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["id"]: r["component_id"] for r in jaccard.similar_documents(docs).collect()}
    assert [columns for columns, _ in stored][:1] == [["cls", "high"]] and all(n <= 3 for _, n in stored[1:]) and len(stored) > 1
    assert found == {**{k: k for k in range(12)}, **{100 + k: k for k in range(11)}, 200: 200, 201: 200, 202: 200}


@pytest.mark.parametrize("name", ["quality_rules", "decontaminate", "secret_scans"])
def test_stages_pass_columns_through(spark, sf_dir, name):
    docs = frame(spark, [(None, PROSE), (4, PROSE), (4, PROSE), (5, PROSE + " password = 'hunter22' end")])
    out = getattr(pipeline, name)(spark, docs, sf_dir)
    rows = out.collect()
    assert out.schema == docs.schema
    assert {r[c] for r in rows for c in CLASHING} == ({f"own {c}" for c in CLASHING} if rows else set())
    if name != "quality_rules":
        assert sorted((r["doc_id"] or 0) for r in rows) == [0, 4, 4, 5]


def test_packing_of_clashing_columns(spark):
    docs = frame(spark, [(None, PROSE), (4, PROSE), (4, PROSE)])
    assert sorted((r["doc_id"] or 0) for r in pipeline.best_fit_packing(spark, docs, "").collect()) == [0, 4, 4]


# --- the whole pipeline on planted documents --------------------------------

def prose(rng, n=120):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder of tables and, by document, the text that must reach packing (None: the document must go)."""
    rng = random.Random(11)
    folder = tmp_path_factory.mktemp("planted")
    item = prose(rng, 40)
    passage = " ".join(item.split()[5:30])
    want, rows = {}, []

    def add(text, final):
        rows.append((len(rows), text, "en", "s", len(text) if text is not None else None))
        want[len(rows) - 1] = final

    for _ in range(40):
        text = prose(rng)
        add(text, text)
    original = prose(rng)
    words = original.split()
    add(original, original)
    add(original, None)  # exact copies, then near ones
    add(original, None)
    add(" ".join([*words[:60], "changed", *words[61:]]), None)
    add(" ".join([*words[:-1], "end"]), None)
    before, after = prose(rng), prose(rng)
    add(f"{before} {passage} {after}", f"{before}  {after}")
    add(f"{' '.join(before.split()[:10])} {item} {' '.join(after.split()[:12])}", None)  # mostly a benchmark item
    text = prose(rng)
    add(f"{text} password = hunter22hunter22 {text[:40]}", f"{text} [SECRET] {text[:40]}")
    add("too short", None)
    add(None, None)
    add("", None)
    add("again and again " * 60, None)
    long = prose(rng, 9000)
    add(long, long)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), want


def test_run_on_planted_documents(spark, planted):
    folder, want = planted
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    pieces = set()
    for key, text in want.items():
        if text is None:
            continue
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        at = 0
        for piece, stop in enumerate(range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)):
            part = ids[at:stop]
            pieces.add((key, piece, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
            at = stop
    got = pipeline.run(spark, folder).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == pieces and len(got) == len(pieces)
    places = defaultdict(list)
    for row in got:
        places[row["sequence_id"]].append((row["offset"], row["length"]))
    for own in places.values():
        assert sum(n for _, n in own) <= 2048
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:])) and min(own)[0] == 0


def test_stages_on_an_empty_table(spark, planted):
    folder, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0, name
        docs = out if name != "best-fit packing" else docs


def test_every_stage_keeps_a_very_long_text(spark, planted):
    folder, want = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    longest = max((t for t in want.values() if t), key=len)
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.where(f"length(text) = {len(longest)}").count() == 1, name
