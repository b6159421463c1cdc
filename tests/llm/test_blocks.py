"""Benchmarks of several blocks: one block is in memory at a time, and nothing is lost."""

import random

import pytest

from ledgerrecon.llm import decontaminate
from ledgerrecon.llm.common import stage
from ledgerrecon.llm.decontaminate import cut_passages, find_passages
from ledgerrecon.llm.packing import assign_sequences


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(12)] + [(20, "one two three"), (21, None)]
    rows = []
    for i in range(30):
        own = [f"d{i}x{j}" for j in range(60)]
        item = items[i % 12][1].split()
        other = items[(i + 5) % 12][1].split()
        # cutting the inner passage brings the two halves of the outer one together
        text = own[:30] + item[:12] + other[3:18] + item[12:24] + own[30:] if i % 3 else own
        rows.append((i, " ".join(text), len(" ".join(text))))
    rows += [(40, "one two three", 13), (41, None, None), (42, "one one two three two three x", 29)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    return docs, spark.createDataFrame(items, "item_id long, text string")


def test_blocks_give_what_one_block_gives(spark, tables, monkeypatch):
    docs, items = tables
    found = sorted(map(str, find_passages(docs, items).collect()))
    short = sorted(map(str, find_passages(docs, items, keep_text=False).collect()))
    cut = sorted(map(str, cut_passages(docs, items).collect()))
    assert len(cut) < len(found)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 70)
    assert sorted(map(str, find_passages(docs, items).collect())) == found
    assert sorted(map(str, find_passages(docs, items, keep_text=False).collect())) == short
    assert sorted(map(str, cut_passages(docs, items).collect())) == cut


def test_cutting_takes_no_workers_of_its_own(spark, tables):
    """Two passes in the same tasks take twice the workers, which stay with all they hold."""
    plan = cut_passages(*tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_documents_that_are_mostly_passages_go_whole(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([
        (1, " ".join(words)), (2, " ".join(["own"] * 5 + words)), (3, " ".join(words[:12] + ["own"] * 12)), (4, " ".join(words[:12] + ["own"] * 11)),
    ], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert [tuple(r) for r in cut_passages(docs, items).collect()] == [(3, " " + " ".join(["own"] * 12))]


def test_packing_starts_no_second_set_of_workers(spark):
    """A frame made of a list of tuples runs in Python workers of another kind than ``mapInArrow``, which stay as well."""
    pieces = spark.createDataFrame([(0, 5, 0), (0, 5, 1), (1, 7, 0)], "part int, length int, rank long")
    packed = assign_sequences(stage(pieces, "some-pieces"), 12)
    leaves = packed._jdf.queryExecution().analyzed().collectLeaves()
    made = [leaves.apply(i).rdd().toDebugString() for i in range(leaves.size()) if leaves.apply(i).nodeName() == "LogicalRDD"]
    assert not any("PythonRDD" in x for x in made)
    assert sorted((r["length"], r["offset"]) for r in packed.collect()) == [(5, 0), (5, 7), (7, 0)]


def test_table_sizes_of_the_tokenizer_change_no_ids():
    from ledgerrecon.llm.common import tokenizer_path
    from ledgerrecon.llm.tokens import FULL, LEAN, PieceTokenizer, Tables

    texts = [b"one two three", b"two  two", None, b"three, two\none zwei" * 40, b" ".join(b"w%d" % k for k in range(500))]
    made = [PieceTokenizer(tokenizer_path("byte_bpe_50k.json"), t) for t in (FULL, LEAN, Tables(3, 40, 2, 10))]
    first, *others = [[t.encode(texts) for _ in range(2)] for t in made]
    assert all(o == first for o in others) and first[0] == first[1] and FULL.pieces > LEAN.pieces
