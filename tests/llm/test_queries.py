"""Registered queries of the package against SQL, or against brute force where SQL cannot say it."""

import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from tokenizers import Tokenizer

from ledgerrecon.llm.common import tokenizer_path
from ledgerrecon.llm.oracles import ORACLES
from ledgerrecon.llm.queries import QUERIES
from workloads.check import TABLES, sorted_rows


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    yield connection
    connection.close()


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return sorted((r["doc_id"], r["text"]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, db, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = db.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted_rows(got.columns, got.collect()) == sorted_rows(want.columns, want.fetchall())


def encoded(name, text, end):
    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_token_files(spark, sf_dir, documents):
    at, want = 0, []
    for key, text in documents:
        ids = encoded("word_bpe_49k.json", text, 1)
        want.append((key, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, QUERIES["op10_token_files"](spark, sf_dir).collect())) == want


def test_packing(spark, sf_dir, documents):
    got = QUERIES["op4_best_fit_packing"](spark, sf_dir).collect()
    want = set()
    for key, text in documents:
        ids = encoded("byte_bpe_50k.json", text, 0)
        at = 0
        for piece, stop in enumerate(range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)):
            want.add((key, piece, at, stop - at, crc(ids[at:stop])))
            at = stop
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    sequences = defaultdict(list)
    for row in got:
        sequences[row["sequence_id"]].append((row["offset"], row["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(r["length"] for r in got) // 2048)
    assert len(sequences) <= least * 1.02 + 1


def test_sharding(spark, sf_dir, documents):
    got = QUERIES["op1_sharding"](spark, sf_dir).collect()
    text_of = dict(documents)
    groups, totals, slots, shard_of = defaultdict(list), Counter(), defaultdict(list), {}
    for row in got:
        text = text_of[row["doc_id"]].encode()
        assert (row["size"], row["text_crc32"]) == (len(text) + 16, zlib.crc32(text))
        groups[text].append(row["shard"])
        totals[row["shard"]] += row["size"]
        slots[row["shard"]].append(row["slot"])
        shard_of[row["doc_id"]] = row["shard"]
    assert len(shard_of) == len(documents) and set(shard_of.values()) <= set(range(40))
    assert all(len(set(shards)) == 1 for shards in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = {}
    for key, text in documents:
        sizes[text] = sizes.get(text, 0) + len(text.encode()) + 16
    assert max(totals.values()) == smallest(list(sizes.values()), 40)


def smallest(sizes, shards):
    """The least capacity with which greedy filling needs no more shards; tried upwards by bisection."""
    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        used, filled = 1, 0
        for size in sizes:
            if filled + size > middle:
                used, filled = used + 1, 0
            filled += size
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low
