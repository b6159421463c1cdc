"""Reversal detection against brute force, with and without hot groups."""

import random
from collections import Counter
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerrecon.config import ReversalConfig
from ledgerrecon.labels import REVERSAL_FLAG
from ledgerrecon.operators.reversals import (
    mark_reversals, reversal_counts, reversal_pairs, reversal_pairs_one_to_one, reversal_pairs_within, reversal_results,
    reversal_rows,
)

PAIRS = ReversalConfig("a", "b", "v")
HOT = dict(hot_rows=3, slab_rows=16)


def ledger(seed, n=400, keys=4, amounts=(-2, -1, 0, 1, 2), nulls=True):
    rng = random.Random(seed)
    pick = lambda: None if nulls and rng.random() < 0.05 else rng.randrange(keys)
    rows = [(i * 3, pick(), pick(), None if nulls and rng.random() < 0.05 else rng.choice(amounts) * 0.25) for i in range(n)]
    # one account pair holds a third of all rows
    return [(i, 0, 1, 0.25 if i % 2 else -0.25) if k % 3 == 0 else (i, a, b, v) for k, (i, a, b, v) in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_index long, a long, b long, v double").repartition(5)


def brute_pairs(rows, tolerance=1e-9):
    full = [(i, a, b, 0 if v is None else v) for i, a, b, v in rows if a is not None and b is not None]
    return [(x[0], y[0]) for x in full for y in full
            if x[0] < y[0] and x[1] == y[2] and x[2] == y[1] and abs(x[3] + y[3]) <= tolerance]


def brute_one_to_one(rows):
    queues = {}
    for i, a, b, v in sorted(rows):
        if a is not None and b is not None:
            queues.setdefault((a, b, v or 0.0), []).append(i)
    found = {(min(p), max(p)) for (a, b, v), mine in queues.items() for p in zip(mine, queues.get((b, a, -v), [])) if p[0] != p[1]}
    return sorted(found)


def flagged(df):
    return sorted(r["row_index"] for r in df.where(F.col(REVERSAL_FLAG)).collect())


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot", [{}, HOT])
def test_flags_match_brute_force(spark, seed, hot):
    rows = ledger(seed)
    want = sorted({i for pair in brute_pairs(rows) for i in pair})
    marked = mark_reversals(frame(spark, rows), PAIRS, **hot)
    assert flagged(marked) == want
    assert marked.count() == len(rows)


def test_pair_groups_count_every_pair(spark):
    rows = ledger(3)
    pairs = brute_pairs(rows)
    counts = reversal_counts(frame(spark, rows), PAIRS).head()
    assert counts["reversals"] == len(pairs)
    assert counts["rows_marked"] == len({i for p in pairs for i in p})
    groups = reversal_pairs(frame(spark, rows), PAIRS)
    assert groups.agg(F.sum("pairs")).head()[0] == len(pairs)
    assert groups.groupBy("low", "high", "level").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("hot", [{}, HOT])
def test_rows_and_groups_spell_out_every_pair(spark, hot):
    rows = ledger(8, n=120)
    pairs = brute_pairs(rows)
    members = reversal_rows(frame(spark, rows), PAIRS, **hot).collect()
    assert sum(r["partners"] for r in members) == 2 * len(pairs)
    by_group = {}
    for r in members:
        by_group.setdefault((r["low"], r["high"], r["level"]), []).append((r["row_index"], r["side"]))
    spelled = {tuple(sorted((x, y))) for (low, high, level), m in by_group.items() for x, s in m for y, t in m
               if x != y and (s != t or (low == high and level == 0))}
    assert spelled == set(pairs)


@pytest.mark.parametrize("seed", [4, 5])
@pytest.mark.parametrize("hot", [{}, HOT])
def test_one_to_one_matches_brute_force(spark, seed, hot):
    rows = ledger(seed)
    got = sorted(tuple(r) for r in reversal_pairs_one_to_one(frame(spark, rows), PAIRS, **hot).collect())
    assert got == brute_one_to_one(rows)
    used = [i for pair in got for i in pair]
    assert len(used) == len(set(used))
    assert set(got) <= set(brute_pairs(rows))


def test_one_to_one_flags(spark):
    rows = ledger(6)
    want = sorted({i for pair in brute_one_to_one(rows) for i in pair})
    assert flagged(mark_reversals(frame(spark, rows), replace(PAIRS, mode="one_to_one"), **HOT)) == want


@pytest.mark.parametrize("tolerance", [0.01, 0.02, 0.05, 0.005])
@pytest.mark.parametrize("hot", [{}, HOT])
def test_wider_tolerance_matches_brute_force(spark, tolerance, hot):
    rng = random.Random(int(tolerance * 1000))
    rows = [(i, rng.randrange(3), rng.randrange(3), rng.randint(-9, 9) / 100 + rng.choice([0, 7.5, -7.5])) for i in range(250)]
    exact = [(i, a, b, Decimal(repr(round(v, 2)))) for i, a, b, v in rows]
    want = sorted({i for pair in brute_pairs(exact, Decimal(repr(tolerance))) for i in pair})
    rows = [(i, a, b, float(v)) for i, a, b, v in exact]
    assert flagged(mark_reversals(frame(spark, rows), replace(PAIRS, tolerance=tolerance), **hot)) == want


@pytest.mark.parametrize("tolerance", [0.01, 0.05, 3.0])
@pytest.mark.parametrize("hot", [{}, HOT])
def test_pairs_within_a_tolerance_match_brute_force(spark, tolerance, hot):
    rng = random.Random(int(tolerance * 1000) + 1)
    rows = [(i, rng.choice([None, 0, 1, 2]), rng.randrange(3), rng.randint(-9, 9) / 100 + rng.choice([0, 7.5, -7.5])) for i in range(250)]
    exact = [(i, a, b, Decimal(repr(round(v, 2)))) for i, a, b, v in rows]
    pairs = brute_pairs([r for r in exact if r[1] is not None], Decimal(repr(tolerance)))
    df = frame(spark, [(i, a, b, float(v)) for i, a, b, v in exact])
    config = replace(PAIRS, tolerance=tolerance)
    partners = Counter(i for pair in pairs for i in pair)
    assert {r["row_index"]: r["partners"] for r in reversal_rows(df, config, **hot).collect()} == partners
    counts = reversal_counts(df, config).head()
    assert (int(counts["reversals"]), counts["rows_marked"]) == (len(pairs), len(partners))
    assert sum(r["pairs"] for r in reversal_pairs_within(df, config).collect()) == len(pairs)


def test_counting_within_a_tolerance_lists_no_pairs(spark):
    """2 x 3000 rows of one account pair: nine million pairs, no plan node with more than three rows for each level."""
    rows = [(i, 1, 2, 1.0 + i / 1e6) for i in range(3000)] + [(3000 + i, 2, 1, -1.0 - i / 1e6) for i in range(3000)]
    counts = reversal_counts(frame(spark, rows).repartition(8), replace(PAIRS, tolerance=0.5)).head()
    assert (int(counts["reversals"]), counts["rows_marked"]) == (9_000_000, 6000)
    empty = reversal_counts(frame(spark, rows).limit(0), replace(PAIRS, tolerance=0.5)).head()
    assert (int(empty["reversals"]), empty["rows_marked"]) == (0, 0)


def test_sparse_tolerance(spark):
    rows = [(1, 5, 5, 0.004), (2, 7, 7, 0.004), (3, 7, 7, 0.003), (4, 8, 8, 0.02), (5, 8, 8, -0.011), (6, 1, 2, 1.0),
            (7, 2, 1, -1.009), (8, 3, 4, 1.0), (9, 4, 3, -1.011)]
    assert flagged(mark_reversals(frame(spark, rows), replace(PAIRS, tolerance=0.01))) == [2, 3, 4, 5, 6, 7]


def test_same_result_for_any_partitioning(spark):
    df = frame(spark, ledger(7))
    assert flagged(mark_reversals(df.repartition(1), PAIRS)) == flagged(mark_reversals(df.repartition(7), PAIRS, **HOT))


def test_text_values_and_mixed_key_types(spark):
    df = spark.createDataFrame(
        [(1, "10", 20.0, "R$ 5,00"), (2, "20", 10.0, "(5,00)"), (3, "20", 10.0, "abc"), (4, None, 10.0, "1")],
        "row_index long, a string, b double, v string")
    assert flagged(mark_reversals(df, PAIRS)) == [1, 2]


def test_existing_flag_is_kept(spark):
    df = frame(spark, [(1, 1, 2, 1.0), (2, 3, 4, 5.0)]).withColumn(REVERSAL_FLAG, F.col("row_index") == 2)
    assert flagged(mark_reversals(df, PAIRS)) == [2]


def test_bad_arguments(spark):
    df = frame(spark, [(1, 1, 2, 1.0)])
    with pytest.raises(KeyError):
        mark_reversals(df, replace(PAIRS, value_column="gone"))
    with pytest.raises(ValueError):
        mark_reversals(df, replace(PAIRS, tolerance=-1))
    with pytest.raises(ValueError):
        mark_reversals(df, replace(PAIRS, mode="other"))


def test_result_records(spark):
    df = mark_reversals(frame(spark, [(1, 1, 2, 1.0), (2, 2, 1, -1.0), (3, 2, 1, 9.0)]), PAIRS)
    got = sorted(tuple(r) for r in reversal_results(df, 4, 9).collect())
    assert got == [(4, 9, "1", "Conciliado_Estorno", "01_Conciliado", None, 0.0),
                   (4, 9, "2", "Conciliado_Estorno", "01_Conciliado", None, 0.0)]
