"""Amounts: text cleaning, coercion and exact decimals.

Ledger sums decide ``== 0`` and ``<= threshold``, so they must not depend on the
order rows arrive in. Amounts are therefore summed as decimals with nine places
and turned into doubles only at the very end.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerrecon.functions.refs import column_type, ref, require
from ledgerrecon.labels import (
    CURRENCY_MARKS, NESTED_VALUE_FIELDS, PLAIN_NUMBER, READY_NUMBER, TRAILING_MARKS,
)

AMOUNT_SCALE = 9
AMOUNT = T.DecimalType(38, AMOUNT_SCALE)

# private-use characters, so no ledger text holds them
_COMMA_DECIMAL = "\ue000"
_NO_DECIMAL = "\ue001"


def number_text(col: Column) -> Column:
    """Number text in any of the accepted spellings -> plain ``[-]digits[.digits]`` text.

    Brackets mean negative; currency marks and blanks go; with both separators
    the later one is the decimal mark; a single comma is a decimal mark; repeated
    commas or dots are thousands marks; trailing ``% ; : , .`` go.

    One straight chain of replacements, where each step reads the one before once:
    a mark at the end of the text carries what the separators mean. Cells that are
    plain numbers already, the usual case, skip it.
    """
    body = F.regexp_replace(col, r"(?U)^\s+|\s+$", "")
    body = F.regexp_replace(body, r"(?s)^\((.*)\)$", "-$1")
    body = F.regexp_replace(body, CURRENCY_MARKS, "")
    body = F.regexp_replace(body, r"^(.*\..*,[^.]*|[^.,]*,[^.,]*)$", f"$1{_COMMA_DECIMAL}")  # 1.234,5 and 12,5
    body = F.regexp_replace(body, r"^([^,.]*\.[^,.]*\.[^,]*)$", f"$1{_NO_DECIMAL}")         # 1.234.567
    body = F.regexp_replace(body, rf"\.(?=.*[{_COMMA_DECIMAL}{_NO_DECIMAL}]$)", "")
    body = F.regexp_replace(body, rf",(?=.*{_COMMA_DECIMAL}$)", ".")
    body = F.translate(body, f",{_COMMA_DECIMAL}{_NO_DECIMAL}", "")                         # 1,234.5 and 1,234,567
    body = F.regexp_replace(body, TRAILING_MARKS, "")
    number = F.get(F.regexp_extract_all(body, F.lit(PLAIN_NUMBER), F.lit(0)), F.lit(0))
    return F.when(col.rlike(READY_NUMBER), col).otherwise(number)


def parse_number(col: Column, dtype: T.DataType) -> Column:
    """Double value of a column; NULL when it holds no finite number."""
    infinite = F.lit(float("inf"))
    if isinstance(dtype, T.StringType):
        return F.nullif(F.nullif(number_text(col).try_cast("double"), infinite), -infinite)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(F.abs(col) < infinite, col.cast("double"))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return col.cast("double")
    return F.lit(None).cast("double")


def number_or_zero(col: Column, dtype: T.DataType) -> Column:
    """Double value; missing, unparsable, NaN and infinite values are 0."""
    return F.coalesce(parse_number(col, dtype), F.lit(0.0))


def amount(col: Column, dtype: T.DataType) -> Column:
    """Exact decimal of a value column; missing or unparsable values are 0.

    Nested cells give their first scalar. A finite value too large for the decimal
    raises rather than turning into 0, and so does a column of a type that holds no amounts.
    """
    while isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        col, dtype = first_scalar(col, dtype)
    if isinstance(dtype, T.StringType):
        value = number_text(col).cast(AMOUNT)
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        value = F.when(F.abs(col) < F.lit(float("inf")), col).cast(AMOUNT)
    elif isinstance(dtype, T.BooleanType):
        value = col.cast("int").cast(AMOUNT)
    elif isinstance(dtype, T.NumericType):
        value = col.cast(AMOUNT)
    elif isinstance(dtype, T.NullType):
        return F.lit(0).cast(AMOUNT)
    else:
        raise TypeError(f"a column of type {dtype.simpleString()} holds no amounts")
    return F.coalesce(value, F.lit(0).cast(AMOUNT))


def amount_of(df: DataFrame, names: str | Sequence[str]) -> Column:
    """Exact decimal of a value column, or of several that carry the same header.

    When at least half of several columns are numeric their amounts are added, otherwise the
    first cell that is not missing counts.
    """
    columns = [names] if isinstance(names, str) else list(names)
    require(df, *columns)
    types = [column_type(df, n) for n in columns]
    if len(columns) == 1:
        return amount(ref(columns[0]), types[0])
    if sum(isinstance(t, (T.NumericType, T.BooleanType)) for t in types) * 2 >= len(columns):
        return reduce(lambda x, y: (x + y).cast(AMOUNT), [amount(ref(n), t) for n, t in zip(columns, types)])
    return amount(F.coalesce(*[ref(n).cast("string") for n in columns]), T.StringType())


def first_scalar(col: Column, dtype: T.DataType) -> tuple[Column, T.DataType]:
    """Scalar inside a nested cell, with its type.

    Arrays give their first non-missing element; maps and structs the entry
    ``value``, ``val``, ``amount`` or ``amt``, else their first entry.
    """
    if isinstance(dtype, T.ArrayType):
        present = lambda x: x.isNotNull()
        if isinstance(dtype.elementType, (T.DoubleType, T.FloatType)):
            present = lambda x: x.isNotNull() & ~F.isnan(x)
        return F.get(F.filter(col, present), F.lit(0)), dtype.elementType
    if isinstance(dtype, T.MapType):
        picked = F.when(F.size(col) > 0, F.get(F.map_values(col), F.lit(0)))
        for field in reversed(NESTED_VALUE_FIELDS):
            picked = F.when(F.map_contains_key(col, field), F.try_element_at(col, F.lit(field))).otherwise(picked)
        return picked, dtype.valueType
    if isinstance(dtype, T.StructType):
        names = dtype.fieldNames()
        if not names:
            return F.lit(None), T.NullType()
        field = next((n for n in NESTED_VALUE_FIELDS if n in names), names[0])
        return col.getField(field), dtype[field].dataType
    return col, dtype


def duplicate_columns(df: DataFrame, names: list[str]) -> Column:
    """One value from columns that carry the same header.

    When at least half of them are numeric the row sum (missing = 0), otherwise
    the first non-missing value as text.
    """
    require(df, *names)
    types = [column_type(df, n) for n in names]
    numeric = [isinstance(t, (T.NumericType, T.BooleanType)) for t in types]
    if sum(numeric) * 2 >= len(names):
        parts = [
            F.coalesce(ref(n).try_cast("double") if isinstance(t, T.StringType) else ref(n).cast("double"), F.lit(0.0))
            for n, t in zip(names, types)
        ]
        return reduce(lambda x, y: x + y, parts)
    return F.coalesce(*[ref(n).cast("string") for n in names])


def invert_value(df: DataFrame, name: str) -> DataFrame:
    """Column times -1; text that is no plain number becomes NULL."""
    require(df, name)
    dtype = column_type(df, name)
    if isinstance(dtype, T.StringType):
        text = F.trim(ref(name))
        value = F.when(text.rlike(PLAIN_NUMBER), text).try_cast("double")
    else:
        value = ref(name)
    return df.withColumn(name, -value)
