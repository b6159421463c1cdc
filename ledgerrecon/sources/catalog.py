"""Column types and the column catalog of a ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerrecon.functions.refs import ref
from ledgerrecon.labels import BOOLEAN_CELLS, PLAIN_NUMBER, WHOLE_NUMBER


Catalog = Sequence[tuple[str, str | None]]  # (name, logical name) per column


def infer_column_types(df: DataFrame) -> dict[str, str]:
    """Column -> 'number', 'date' or 'string', from the declared types."""
    return {f.name: _logical_type(f.dataType) for f in df.schema.fields}


def _logical_type(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return "number"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType, T.DayTimeIntervalType)):
        return "date"
    return "string"


def _cell_kind(text: Column) -> Column:
    return (
        F.when(text.rlike(WHOLE_NUMBER), F.when(text.try_cast("bigint").isNotNull(), 4).otherwise(3))
        .when(text.rlike(PLAIN_NUMBER), 2)
        .when(text.isin(*BOOLEAN_CELLS), 1)
        .when(text.isNotNull(), 0)
    )


def text_column_evidence(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per text column: how many cells are filled, and how many read as what.

    One aggregation over the whole input; an input without rows gives no evidence.
    """
    # each cell is read once: 4 bigint, 3 longer whole number, 2 other number, 1 boolean, 0 text
    kinds = F.array(*[
        F.struct(F.lit(i).alias("position"), _cell_kind(F.trim(ref(n))).alias("kind")) for i, n in enumerate(names)
    ])
    kind = F.col("kind")
    seen = df.select(F.inline(kinds)).groupBy("position").agg(
        F.count(kind).alias("filled"), F.count_if(kind >= 2).alias("numbers"), F.count_if(kind >= 3).alias("wholes"),
        F.count_if(kind == 4).alias("longs"), F.count_if(kind == 1).alias("booleans"), F.count("*").alias("cells"),
    )
    titles = F.array(*[F.lit(n) for n in names])
    seen = seen.select(F.get(titles, F.col("position")).alias("column"), "filled", "numbers", "wholes", "longs", "booleans", "cells")
    filled = F.col("filled")
    storage = (
        F.when(filled == 0, "double")
        .when(F.col("booleans") == F.col("cells"), "boolean")  # with blanks in between they stay text
        .when((F.col("wholes") == filled) & (F.col("longs") == filled), "bigint")
        .when(F.col("wholes") == filled, "string")
        .when(F.col("numbers") == filled, "double")
        .otherwise("string")
    )
    logical = F.when(F.col("storage") == "string", "string").otherwise("number")
    return seen.withColumn("storage", storage).withColumn("data_type", logical)


def infer_text_types(df: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """Text column -> storage type. Whole numbers too long for a bigint stay text."""
    if not names:
        return {}
    return {r["column"]: r["storage"] for r in text_column_evidence(df, names).collect()}


def cast_text_columns(df: DataFrame, storage: dict[str, str]) -> DataFrame:
    """Text columns in their storage types; a cell that does not fit becomes NULL."""
    casts = {n: F.trim(ref(n)).try_cast(t) for n, t in storage.items() if t != "string"}
    return df.withColumns(casts) if casts else df


def column_profile(df: DataFrame) -> DataFrame:
    """The column catalog: one row per column, in column order."""
    rows = [
        (i, name, name, kind, kind == "number", False) for i, (name, kind) in enumerate(infer_column_types(df).items())
    ]
    return df.sparkSession.createDataFrame(
        rows, "id int, name string, logical_name string, data_type string, is_value_column boolean, "
              "is_candidate_key boolean"
    )


def mapped_columns(catalog: DataFrame) -> DataFrame:
    """Catalog rows that have a logical name."""
    return catalog.where(F.col("logical_name").isNotNull() & (F.col("logical_name") != ""))


def logical_headers(catalog: Catalog) -> list[str]:
    """Logical name of each column, else its name."""
    return [logical if logical is not None and logical.strip() else (name or "") for name, logical in catalog]


def apply_headers(df: DataFrame, catalog: Catalog) -> DataFrame:
    """``df`` under its logical names, if the catalog covers all its columns."""
    headers = logical_headers(catalog)
    return df.toDF(*headers) if headers and len(headers) == len(df.columns) else df


def resolve_column(df: DataFrame, requested: str | None,
                   catalog: Catalog | None = None) -> str | None:
    """Column meant by a requested name: exact, then logical name, then name, then part of either."""
    if not requested:
        return None
    if requested in df.columns:
        return requested
    wanted = requested.strip().lower()
    entries = [(n or "", l or "") for n, l in (catalog if catalog is not None else [(c, c) for c in df.columns])]
    tests = (
        lambda name, logical: name if logical.strip().lower() == wanted else None,
        lambda name, logical: name if name.strip().lower() == wanted else None,
        lambda name, logical: name if wanted in name.strip().lower() and name in df.columns
        else logical if wanted in logical.strip().lower() else None,
    )
    for test in tests:
        for name, logical in entries:
            found = test(name, logical)
            if found and found in df.columns:
                return found
    return None
