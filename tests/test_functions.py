"""Column functions against plain Python readings of the same rules."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerrecon.functions import (
    amount, classify, composite_key, duplicate_columns, first_scalar, invert_value, key_part, number_or_zero,
    parse_number, title_words, translate_status, truthy, unflagged, yes_no,
)
from ledgerrecon.functions.amounts import number_text
from ledgerrecon.labels import CANCELED_FLAG, REVERSAL_FLAG


def values(df, name="r"):
    return [row[name] for row in df.collect()]


def frame(spark, cells, kind="string"):
    return spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, c {kind}").coalesce(1)


NUMBER_CASES = {
    "12": 12.0, " 12.5 ": 12.5, "12,5": 12.5, "1.234,56": 1234.56, "1,234.56": 1234.56, "1.234.567": 1234567.0,
    "1,234,567": 1234567.0, "1.234": 1.234, "(12,5)": -12.5, "( 7 )": -7.0, "R$ 1.234,50": 1234.5, "$5": 5.0,
    "€ 3,2": 3.2, "£4": 4.0, "50%": 50.0, "12,5%": 12.5, "7;": 7.0, "9:": 9.0, "1,234.": 1234.0, "5.,": 5.0,
    "-3": -3.0, "+3": 3.0, "1e3": 1000.0, "(R$ 10)": -10.0, " 8 ": 8.0, "-R$ 5,00": -5.0, "1.234,5,6": None,
    "1,234.5.6": None, "(-5)": None, "5-": None, "abc": None, "": None, "   ": None, "()": None, "(": None, ".": None,
    "1d": None, "NaN": None, "Infinity": None, "--4": None, "1 234,5": 1234.5, "0x1A": None, ".5": 0.5, "1e999": None,
}


def test_number_spellings(spark):
    got = values(frame(spark, list(NUMBER_CASES)).select(parse_number(F.col("c"), T.StringType()).alias("r")))
    assert dict(zip(NUMBER_CASES, got)) == NUMBER_CASES


def _spelled(rng):
    """A random number and one of the ways a ledger may write it."""
    whole, places = rng.randint(1, 10 ** rng.randint(1, 10)), rng.randint(1, 4)
    cents = rng.randint(0, 10 ** places - 1)
    value = Decimal(whole) + Decimal(cents).scaleb(-places)
    tail = str(cents).zfill(places)
    grouped = f"{whole:,}"
    styles = [f"{whole}.{tail}", f"{whole},{tail}", f"{grouped}.{tail}"]
    if whole >= 1000:
        styles.append(f"{grouped.replace(',', '.')},{tail}")
    text = rng.choice(styles)
    text = rng.choice(["", "R$ ", "$", "€", "£ "]) + text + rng.choice(["", "%", ";", " :"])
    if rng.random() < 0.3:
        return f"({text})" if text[-1].isdigit() else f"-{text}", -value
    return rng.choice(["", " "]) + text + rng.choice(["", "  "]), value


def test_number_spellings_random(spark):
    import random

    rng = random.Random(5)
    cases = [_spelled(rng) for _ in range(4000)]
    got = values(frame(spark, [text for text, _ in cases]).select(parse_number(F.col("c"), T.StringType()).alias("r")))
    assert [(c, g) for c, g in zip(cases, got) if g != float(c[1])] == []


def test_number_of_other_types(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (float("inf"),), (None,)], "c double")
    assert values(df.select(number_or_zero(F.col("c"), T.DoubleType()).alias("r"))) == [1.5, 0.0, 0.0, 0.0]
    assert values(df.select(amount(F.col("c"), T.DoubleType()).alias("r"))) == [Decimal("1.5"), 0, 0, 0]
    whole = spark.createDataFrame([(True,), (False,), (None,)], "c boolean")
    assert values(whole.select(amount(F.col("c"), T.BooleanType()).alias("r"))) == [1, 0, 0]


def test_amount_sum_is_exact(spark):
    df = spark.createDataFrame([(0.1,)] * 10 + [(-1.0,)], "c double").repartition(7)
    assert values(df.agg(F.sum(amount(F.col("c"), T.DoubleType())).alias("r"))) == [0]


def test_number_text_skips_plain_cells(spark):
    assert values(frame(spark, ["0012.50", "7"]).select(number_text(F.col("c")).alias("r"))) == ["0012.50", "7"]


def test_key_parts(spark):
    doubles = [1.0, 1.5, 12345678.0, 12345678.9, -0.0, 1e17, 1e22, 0.00015, None, float("nan")]
    got = values(frame(spark, doubles, "double").select(key_part(F.col("c"), T.DoubleType()).alias("r")))
    assert got == ["1", "1.5", "12345678", "12345678.9", "0", "100000000000000000", "10000000000000000000000",
                   "0.00015", "", ""]
    decimals = frame(spark, [Decimal("1.00"), Decimal("1.50"), None], "decimal(10,2)")
    assert values(decimals.select(key_part(F.col("c"), T.DecimalType(10, 2)).alias("r"))) == ["1", "1.5", ""]
    times = frame(spark, [datetime(2020, 1, 2), datetime(2020, 1, 2, 3, 4, 5, 6)], "timestamp_ntz")
    got = values(times.select(key_part(F.col("c"), T.TimestampNTZType()).alias("r")))
    assert got == ["2020-01-02T00:00:00", "2020-01-02T03:04:05.000006"]
    flags = frame(spark, [True, False, None], "boolean")
    assert values(flags.select(key_part(F.col("c"), T.BooleanType()).alias("r"))) == ["1", "0", ""]


def test_composite_key_intent(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "y")], "a double, b string")
    assert values(df.select(composite_key(df, ["a", "b"]).alias("r"))) == ["1|x", "|y"]
    assert values(df.select(composite_key(df, ["b", "gone", "a"]).alias("r"))) == ["x||1", "y||"]
    assert values(df.select(composite_key(df, []).alias("r"))) == ["", ""]


def test_unflagged_mixed(spark):
    df = spark.createDataFrame(
        [(1, "false", 0), (2, "true", 0), (3, "0", 1), (4, None, None)], f"v int, {REVERSAL_FLAG} string, {CANCELED_FLAG} int")
    assert values(unflagged(df), "v") == [1, 4]
    assert values(unflagged(df, strict=True), "v") == [1]
    assert values(unflagged(df.select("v")), "v") == [1, 2, 3, 4]


def test_truthy_by_type(spark):
    words = frame(spark, ["1", "TRUE", "Yes", "y", "t", "no", " 1", "2", None])
    assert values(words.select(truthy(F.col("c"), T.StringType()).alias("r"))) == [True] * 5 + [False] * 4
    numbers = frame(spark, [2.0, 0.0, None], "double")
    assert values(numbers.select(truthy(F.col("c"), T.DoubleType()).alias("r"))) == [True, False, False]


def test_invert(spark):
    df = spark.createDataFrame([("1",), ("2",), ("x",), (None,)], "val string")
    assert values(invert_value(df, "val"), "val") == [-1.0, -2.0, None, None]
    with pytest.raises(KeyError):
        invert_value(df, "gone")


@pytest.mark.parametrize("a, b, threshold, expected", [
    (0.0, 0.0, 0, ("Ambos zero", "Conciliados", 0.0)),
    (100.0, 99.0, 1, ("Conferem", "Conciliados", 1.0)),
    (5.0, 0.0, 0, ("Apenas A", "Não conciliados", 5.0)),
    (0.0, 3.0, 0, ("Apenas B", "Não conciliados", -3.0)),
    (5.0, 3.0, 0, ("Divergência", "Não conciliados", 2.0)),
    (5.0, 0.0, 10, ("Conferem", "Conciliados", 5.0)),
    (None, 3.0, 0, ("Apenas B", "Não conciliados", -3.0)),
    (1.1, 1.0, 0.1, ("Conferem", "Conciliados", 0.1)),
])
def test_classify(spark, a, b, threshold, expected):
    df = spark.createDataFrame([(a, b)], "a double, b double")
    assert tuple(values(df.select(classify(F.col("a"), F.col("b"), threshold).alias("r")))[0]) == expected


def test_classify_text(spark):
    df = spark.createDataFrame([("x", "2,5")], "a string, b string")
    got = values(df.select(classify(F.col("a"), F.col("b"), 0, T.StringType(), T.StringType()).alias("r")))[0]
    assert tuple(got) == ("Apenas B", "Não conciliados", -2.5)


def test_nested_values(spark):
    df = spark.createDataFrame(
        [([None, float("nan"), 2.0], {"k": 1.0}, (7.0, 8.0)), ([], {"x": 3.0, "amount": 4.0}, (1.0, 2.0)), (None, {}, None)],
        "l array<double>, m map<string,double>, s struct<other:double,val:double>")
    assert values(df.select(first_scalar(F.col("l"), df.schema["l"].dataType)[0].alias("r"))) == [2.0, None, None]
    assert values(df.select(first_scalar(F.col("m"), df.schema["m"].dataType)[0].alias("r"))) == [1.0, 4.0, None]
    assert values(df.select(first_scalar(F.col("s"), df.schema["s"].dataType)[0].alias("r"))) == [8.0, 2.0, None]


def test_duplicate_columns(spark):
    df = spark.createDataFrame([(1.0, None, "x", None), (2.0, 3.0, None, "y")], "a double, b double, c string, d string")
    assert values(df.select(duplicate_columns(df, ["a", "b"]).alias("r"))) == [1.0, 5.0]
    assert values(df.select(duplicate_columns(df, ["c", "d"]).alias("r"))) == ["x", "y"]


def test_presentation(spark):
    words = frame(spark, ["sim", "NO", "talvez", None])
    assert values(words.select(yes_no(F.col("c"), T.StringType()).alias("r"))) == ["Sim", "Não", "talvez", ""]
    numbers = frame(spark, [1.0, 0.0, 0.5, None], "double")
    assert values(numbers.select(yes_no(F.col("c"), T.DoubleType()).alias("r"))) == ["Sim", "Não", "Não", ""]
    names = frame(spark, ["NOTA_FISCAL", "ABC", "Mixed_Case", "2024", "A__B", None])
    assert values(names.select(title_words(F.col("c")).alias("r"))) == [
        "Nota Fiscal", "Abc", "Mixed_Case", "2024", "A B", ""]
    states = frame(spark, ["matched", "both_zero", "Apenas A", "other", None])
    assert values(states.select(translate_status(F.col("c")).alias("r"))) == [
        "Conciliado", "Ambos zero", "Apenas A", "other", None]
