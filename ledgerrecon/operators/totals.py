"""Totals per key, key sets and run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerrecon.functions import composite_key, ref, unflagged
from ledgerrecon.functions.amounts import amount_of
from ledgerrecon.labels import GROUP_LABELS, RECONCILED, STATUS_LABELS


def side_totals(df: DataFrame, key_columns: Sequence[str], value_column: str | Sequence[str],
                strict_flags: bool = False) -> DataFrame:
    """Exact total per composite key over the rows that are not flagged.

    Several value columns are read as columns with the same header.
    """
    value = amount_of(df, value_column)
    rows = unflagged(df, strict=strict_flags)
    return (
        rows.select(composite_key(df, key_columns).alias("key"), value.alias("value"))
        .groupBy("key").agg(F.sum("value").cast("double").alias("total"))
    )


def missing_keys(a: DataFrame, a_columns: Sequence[str], b: DataFrame, b_columns: Sequence[str]) -> DataFrame:
    """Distinct keys found on one side only, with ``side`` 'a' or 'b'; one shuffle."""
    tagged = a.select(composite_key(a, a_columns).alias("key"), F.lit(1).alias("side")).unionByName(
        b.select(composite_key(b, b_columns).alias("key"), F.lit(2).alias("side"))
    )
    return (
        tagged.groupBy("key").agg(F.bit_or("side").alias("seen"))
        .where(F.col("seen") < 3)
        .select("key", F.when(F.col("seen") == 1, "a").otherwise("b").alias("side"))
    )


def run_summary(recon: DataFrame) -> DataFrame:
    """One row: keys evaluated, matched and unmatched."""
    group = "group" if "group" in recon.columns else "group_name"
    matched = ref(group) == RECONCILED
    return recon.agg(
        F.count("*").alias("keys_evaluated"), F.count_if(matched).alias("matched_keys"),
        (F.count("*") - F.count_if(matched)).alias("unmatched_keys"),
    )


def _label_tally(recon: DataFrame, labels: Sequence[tuple[str, str, str]], column: str) -> DataFrame:
    spark = recon.sparkSession
    table = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(labels)], "position int, value string, label string, description string"
    )
    counts = recon.groupBy(ref(column).alias("value")).agg(F.count("*").alias("keys"))
    return table.join(counts, "value", "left").select(
        "position", "value", "label", "description", F.coalesce("keys", F.lit(0)).alias("keys")
    )


def status_breakdown(recon: DataFrame) -> DataFrame:
    """Every known status with its label and number of keys, also when 0."""
    return _label_tally(recon, STATUS_LABELS, "status")


def group_breakdown(recon: DataFrame) -> DataFrame:
    """Both result groups with their label and number of keys."""
    return _label_tally(recon, GROUP_LABELS, "group" if "group" in recon.columns else "group_name")
