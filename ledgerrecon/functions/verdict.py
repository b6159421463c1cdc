"""The verdict on a pair of totals."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerrecon.functions.amounts import AMOUNT_SCALE, amount
from ledgerrecon.labels import (
    AGREE, BOTH_ZERO, DIVERGENT, NOT_RECONCILED, ONLY_A, ONLY_B, RECONCILED,
)

# One integer digit below the widest decimal, so that a difference keeps all places.
TOTAL = T.DecimalType(37, AMOUNT_SCALE)


def verdict(total_a: Column, total_b: Column, threshold: float = 0.0) -> dict[str, Column]:
    """Columns ``status``, ``group`` and ``difference`` for two decimal totals.

    The first rule that fits wins. "Only A" says that B's total is zero, not that
    the key is absent in B.
    """
    a, b = total_a.cast(TOTAL), total_b.cast(TOTAL)
    difference = a - b
    limit = F.lit(Decimal(repr(float(threshold or 0.0))))
    status = (
        F.when((a == 0) & (b == 0), BOTH_ZERO)
        .when(F.abs(difference) <= limit, AGREE)
        .when(a == 0, ONLY_B)
        .when(b == 0, ONLY_A)
        .otherwise(DIVERGENT)
    )
    reconciled = ((a == 0) & (b == 0)) | (F.abs(difference) <= limit)
    group = F.when(reconciled, RECONCILED).otherwise(NOT_RECONCILED)
    return {"status": status, "group": group, "difference": difference.cast("double")}


def classify(a: Column, b: Column, threshold: float = 0.0,
             a_type: T.DataType = T.DoubleType(), b_type: T.DataType = T.DoubleType()) -> Column:
    """Struct (status, group, difference) for two value columns of any type."""
    parts = verdict(amount(a, a_type), amount(b, b_type), threshold)
    return F.struct(*[col.alias(name) for name, col in parts.items()])
