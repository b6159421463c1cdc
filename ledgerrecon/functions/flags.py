"""Row flags and blank tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerrecon.functions.refs import column_type, ref
from ledgerrecon.labels import CANCELED_FLAG, REVERSAL_FLAG, TRUE_TOKENS


def truthy(col: Column, dtype: T.DataType | None) -> Column:
    """Boolean reading of a flag: numbers by != 0, text by its true words."""
    if dtype is None:
        return F.lit(False)
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(col, F.lit(False))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.nanvl(col, F.lit(0.0)) != 0, F.lit(False))  # not a number: not flagged
    if isinstance(dtype, T.NumericType):
        return F.coalesce(col != 0, F.lit(False))
    return F.coalesce(F.lower(col.cast("string")).isin(*TRUE_TOKENS), F.lit(False))


def _clear(df: DataFrame, flag: str, strict: bool) -> Column | None:
    """Predicate "flag is not set", in a form the Parquet reader can filter by."""
    dtype = column_type(df, flag)
    if dtype is None:
        return None
    col = ref(flag)
    if isinstance(dtype, T.BooleanType):
        off = ~col
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        off = (col == 0) | (F.isnan(col) & F.lit(not strict))
    elif isinstance(dtype, T.NumericType):
        off = col == 0
    else:
        off = ~F.lower(col.cast("string")).isin(*TRUE_TOKENS)
    return off if strict else (col.isNull() | off)


def unflagged(df: DataFrame, strict: bool = False) -> DataFrame:
    """Rows that are neither cancelled nor reversed.

    A missing flag column counts as not flagged, and so does a NULL flag unless
    ``strict``, where both flags must be known to be off.
    """
    for flag in (CANCELED_FLAG, REVERSAL_FLAG):
        clear = _clear(df, flag, strict)
        if clear is not None:
            df = df.where(clear)
    return df


def is_blank(col: Column, dtype: T.DataType) -> Column:
    """Missing, or text made of whitespace only; NaN counts as missing."""
    if isinstance(dtype, T.StringType):
        return col.isNull() | col.rlike(r"^\s*$")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()
