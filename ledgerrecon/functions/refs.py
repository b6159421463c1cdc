"""Column references by exact name, and their declared types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ref(name: str) -> Column:
    """Column by its literal name, also when it holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def column_type(df: DataFrame, name: str) -> T.DataType | None:
    """Declared type of a column, None when the frame lacks it."""
    return next((f.dataType for f in df.schema.fields if f.name == name), None)


def require(df: DataFrame, *names: str) -> None:
    """Raise KeyError naming the columns that are not there."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}; available: {df.columns[:25]}")
