"""Row preparation: blanks, cancelled rows and their counts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerrecon.config import CancellationConfig
from ledgerrecon.functions import column_type, is_blank, key_part, ref, truthy
from ledgerrecon.labels import CANCELED_FLAG, CANCELED_TOKENS, NUMBER_FILL, STRING_FILL


def _fillable(df: DataFrame, schema: Mapping[str, str] | None) -> dict[str, str]:
    """Listed columns the frame has, with 'string' or 'number'."""
    if not schema:
        return {}
    if not isinstance(schema, Mapping):
        raise TypeError("schema must map column names to types")
    kinds = {name: (kind or "").strip().lower() for name, kind in schema.items()}
    return {n: k for n, k in kinds.items() if n in df.columns and k in ("string", "number")}


def fill_nulls(df: DataFrame, schema: Mapping[str, str] | None) -> DataFrame:
    """Blank cells of listed columns become 'NULL' (string) or 0 (number).

    The filled columns are known to be non-null, which lets null tests on them
    disappear from later plans.
    """
    filled = {}
    for name, kind in _fillable(df, schema).items():
        col, dtype = ref(name), column_type(df, name)
        blank = is_blank(col, dtype)
        if kind == "string":
            text = col if isinstance(dtype, T.StringType) else key_part(col, dtype)
            filled[name] = F.coalesce(F.when(~blank, text), F.lit(STRING_FILL))
        elif isinstance(dtype, (T.StringType, T.BooleanType)):
            zero = F.lit(str(NUMBER_FILL)) if isinstance(dtype, T.StringType) else F.lit(False)
            filled[name] = F.coalesce(F.when(~blank, col), zero)
        elif isinstance(dtype, T.NumericType):
            filled[name] = F.coalesce(F.when(~blank, col), F.lit(NUMBER_FILL).cast(dtype))
    return df.withColumns(filled) if filled else df


def fill_counts(df: DataFrame, schema: Mapping[str, str] | None) -> DataFrame:
    """One row: how many string and number cells filling would touch."""
    kinds = _fillable(df, schema)

    def cells(kind: str) -> Column:
        blanks = [is_blank(ref(n), column_type(df, n)).cast("bigint") for n, k in kinds.items() if k == kind]
        per_row = reduce(lambda x, y: x + y, blanks, F.lit(0).cast("bigint"))
        return F.coalesce(F.sum(per_row), F.lit(0))

    return df.agg(cells("string").alias("filled_string"), cells("number").alias("filled_number"))


def _exact_match(df: DataFrame, config: CancellationConfig) -> Column:
    col, dtype, value = ref(config.indicator_column), column_type(df, config.indicator_column), config.canceled_value
    if isinstance(value, str):
        comparable = isinstance(dtype, T.StringType)
    else:
        comparable = isinstance(value, (int, float)) and isinstance(dtype, (T.NumericType, T.BooleanType))
        col = col.cast("double")
        value = float(value) if comparable else None
    return F.coalesce(col == F.lit(value), F.lit(False)) if comparable else F.lit(False)


def _normalized_match(df: DataFrame, config: CancellationConfig) -> Column:
    if config.canceled_value is None:
        return F.lit(False)
    dtype = column_type(df, config.indicator_column)
    col = ref(config.indicator_column)
    text = col if isinstance(dtype, T.StringType) else F.when(col.isNotNull(), key_part(col, dtype))
    target = str(config.canceled_value).strip().upper()
    wanted = CANCELED_TOKENS if target in CANCELED_TOKENS else (target,)
    return F.coalesce(F.upper(F.trim(text)).isin(*wanted), F.lit(False))


def mark_canceled(df: DataFrame, config: CancellationConfig) -> DataFrame:
    """``df`` with ``__is_canceled__``.

    'normalized' compares trimmed upper-case text, treats all cancel words alike
    and keeps flags that are already set; 'exact' compares value and type and
    replaces the flag. Without the indicator column flags stay as they are.
    """
    existing = truthy(ref(CANCELED_FLAG), column_type(df, CANCELED_FLAG)) if CANCELED_FLAG in df.columns else F.lit(False)
    if config.indicator_column not in df.columns:
        flag = existing
    elif config.mode == "exact":
        flag = _exact_match(df, config)
    elif config.mode == "normalized":
        match = _normalized_match(df, config)
        flag = existing | match if CANCELED_FLAG in df.columns else match
    else:
        raise ValueError(f"unknown cancellation mode: {config.mode}")
    return df.withColumn(CANCELED_FLAG, flag)


def cancel_counts(df: DataFrame) -> DataFrame:
    """One row: total, cancelled and active rows."""
    flag = truthy(ref(CANCELED_FLAG), column_type(df, CANCELED_FLAG)) if CANCELED_FLAG in df.columns else F.lit(False)
    return df.agg(
        F.count("*").alias("total_rows"), F.count_if(flag).alias("canceled_rows"), F.count_if(~flag).alias("active_rows")
    )
