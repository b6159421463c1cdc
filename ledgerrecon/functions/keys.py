"""Composite keys with one canonical text per value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerrecon.functions.refs import column_type, ref

# doubles below this are rendered through bigint, larger whole ones through decimal
_BIGINT_SAFE = 9e18


def _decimal_text(text: Column) -> Column:
    """Decimal text without trailing zeros and without a bare decimal point."""
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def key_part(col: Column, dtype: T.DataType | None) -> Column:
    """Text of one key column; missing values and missing columns are ''.

    A whole number has the same text whatever its type (``1``, never ``1.0`` or
    ``1E0``), so a numeric key on one side meets a text key on the other.
    """
    if dtype is None or isinstance(dtype, T.NullType):
        return F.lit("")
    if isinstance(dtype, T.StringType):
        text = col
    elif isinstance(dtype, T.BooleanType):
        text = col.cast("int").cast("string")
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        value = col.cast("double")
        whole = (value % 1) == 0
        text = (
            F.when(F.isnan(value), F.lit(None))
            .when(whole & (F.abs(value) < _BIGINT_SAFE), value.try_cast("bigint").cast("string"))
            .when(whole, F.coalesce(value.try_cast("decimal(38,0)").cast("string"), col.cast("string")))
            .when(col.try_cast("decimal(38,18)").cast("double") == value, _decimal_text(col.try_cast("decimal(38,18)").cast("string")))
            .otherwise(col.cast("string"))  # more places than the decimal holds
        )
    elif isinstance(dtype, T.DecimalType) and dtype.scale > 0:
        text = _decimal_text(col.cast("string"))
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        seconds = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(col, "SSSSSS")
        text = F.when(micros == "000000", seconds).otherwise(F.concat_ws(".", seconds, micros))
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(""))


def composite_key(df: DataFrame, columns: Sequence[str], sep: str = "|") -> Column:
    """Key text of a row: the parts in order, joined by ``sep``; no columns give ''."""
    parts = [key_part(ref(c), column_type(df, c)) if c in df.columns else F.lit("") for c in columns]
    if not parts:
        return F.lit("")
    return parts[0] if len(parts) == 1 else F.concat_ws(sep, *parts)
