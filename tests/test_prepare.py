"""Filling, cancelling and the preprocessing jobs."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ledgerrecon.config import CancellationConfig, ReversalConfig
from ledgerrecon.labels import CANCELED_FLAG, REVERSAL_FLAG
from ledgerrecon.operators.prepare import cancel_counts, fill_counts, fill_nulls, mark_canceled
from ledgerrecon.plans.preprocess import preprocess, preprocess_base_b, preprocess_generic, reversal_run_results

CANCEL = CancellationConfig("ind", "S")
EXACT = replace(CANCEL, mode="exact")


def flags(df, column=CANCELED_FLAG):
    return [r[column] for r in df.collect()]


def frame(spark, cells, kind="string"):
    return spark.createDataFrame([(c, i) for i, c in enumerate(cells)], f"ind {kind}, i int").coalesce(1)


def test_fill(spark):
    df = spark.createDataFrame([("a", 1.0, "z", 1), (None, None, None, None), (" \t\u000b", float("nan"), "", 2)],
                               "s string, n double, other string, k int").coalesce(1)
    out = fill_nulls(df, {"s": "string", "n": " Number ", "gone": "string", "k": "date"})
    assert [tuple(r) for r in out.collect()] == [("a", 1.0, "z", 1), ("NULL", 0.0, None, None), ("NULL", 0.0, "", 2)]
    assert tuple(fill_counts(df, {"s": "string", "n": "number"}).head()) == (2, 2)
    assert fill_nulls(df, None) is df
    with pytest.raises(TypeError):
        fill_nulls(df, ["s"])


def test_fill_across_types(spark):
    df = spark.createDataFrame([(1.0, " ", True), (None, "7", None)], "n double, s string, f boolean").coalesce(1)
    out = fill_nulls(df, {"n": "string", "s": "number", "f": "number"})
    assert [tuple(r) for r in out.collect()] == [("1", "0", True), ("NULL", "7", False)]


def test_cancel_exact(spark):
    assert flags(mark_canceled(frame(spark, ["S", "N", None, "s"]), EXACT)) == [True, False, False, False]
    assert flags(mark_canceled(frame(spark, ["S", "N"]), replace(EXACT, canceled_value=1))) == [False, False]
    numbers = frame(spark, [1, None, 2], "int")
    assert flags(mark_canceled(numbers, replace(EXACT, canceled_value=1))) == [True, False, False]
    assert flags(mark_canceled(numbers, EXACT)) == [False, False, False]
    assert flags(mark_canceled(spark.createDataFrame([(1,), (2,)], "a int"), EXACT)) == [False, False]


def test_cancel_normalized(spark):
    cells = ["S", " s ", "1", "true", "Yes", "y", "T", "N", "", None, "cancelada"]
    assert flags(mark_canceled(frame(spark, cells), CANCEL)) == [True] * 7 + [False] * 4
    assert flags(mark_canceled(frame(spark, cells), replace(CANCEL, canceled_value=" Cancelada"))) == [False] * 10 + [True]
    assert not any(flags(mark_canceled(frame(spark, cells), replace(CANCEL, canceled_value=None))))
    numbers = frame(spark, [1.0, 0.0, None], "double")
    assert flags(mark_canceled(numbers, replace(CANCEL, canceled_value=0))) == [False, True, False]
    assert flags(mark_canceled(numbers, CANCEL)) == [True, False, False]


def test_set_flags_stay(spark):
    df = frame(spark, ["N", "S", "N"]).withColumn(CANCELED_FLAG, F.when(F.col("i") == 0, True))
    assert flags(mark_canceled(df, CANCEL)) == [True, True, False]
    assert flags(mark_canceled(df, EXACT)) == [False, True, False]
    assert flags(mark_canceled(df.drop("ind"), CANCEL)) == [True, False, False]
    with pytest.raises(ValueError):
        mark_canceled(df, replace(CANCEL, mode="other"))


def test_base_b(spark):
    df = spark.createDataFrame(
        [(1, "a", "x", "S", 10), (2, "b", "y", "N", 20), (3, "c", "z", "S", 30), (4, "d", "w", None, 40)],
        "row_index long, id_a string, id_b string, indicator string, value int")
    config = CancellationConfig("indicator", "S", "N")
    rows, counts = preprocess_base_b(df, " b ", config)
    assert tuple(counts.head()) == (4, 2, 2)
    assert rows.where(F.col("indicator") == "NULL").count() == 1
    with pytest.raises(ValueError):
        preprocess_base_b(df, "A", config)
    with pytest.raises(ValueError):
        preprocess_base_b(df, "B", None)
    assert tuple(cancel_counts(df).head()) == (4, 0, 4)


def journal(spark):
    return spark.createDataFrame(
        [(1, None, "9", 5.0, "S"), (2, "9", None, -5.0, "N"), (3, "1", "2", 1.0, ""), (4, "2", "1", -1.0, "N"), (5, "3", "4", None, "N")],
        "row_index long, a string, b string, v double, ind string")


PAIRS = ReversalConfig("a", "b", "v")
TYPES = {"a": "string", "b": "string", "v": "number", "ind": "string"}


def reversed_rows(df):
    return sorted(r["row_index"] for r in df.where(F.col(REVERSAL_FLAG)).collect())


def test_missing_keys_meet_once_filled(spark):
    assert reversed_rows(preprocess(journal(spark), TYPES, CANCEL, [PAIRS])) == [1, 2, 3, 4]
    assert reversed_rows(preprocess(journal(spark), TYPES, CANCEL, [PAIRS], detect_on_raw=True)) == [3, 4]
    out = preprocess(journal(spark), None, CANCEL, [replace(PAIRS, column_a="gone")])
    assert REVERSAL_FLAG not in out.columns and CANCELED_FLAG in out.columns


def test_generic(spark):
    rows, summary = preprocess_generic(journal(spark), "a", "b", "v", TYPES)
    assert tuple(summary.head()) == (5, 6, 4)
    rows, summary = preprocess_generic(journal(spark), "a", "b", None, TYPES)
    assert tuple(summary.head()) == (5, 6, 0) and REVERSAL_FLAG in rows.columns


def test_one_run_per_reversal_config(spark):
    got = reversal_run_results(fill_nulls(journal(spark), TYPES), [PAIRS, PAIRS], 8, 2)
    assert sorted((r["run_id"], r["row_identifier"]) for r in got.collect()) == [(n, str(i)) for n in (8, 9) for i in (1, 2, 3, 4)]
