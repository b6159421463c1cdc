"""Reconcile two ledgers in one shuffle, keep the run, write verdicts back."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerrecon.config import ReconConfig
from ledgerrecon.functions import AMOUNT, amount, column_type, composite_key, ref, unflagged, verdict
from ledgerrecon.labels import RUN_COMPLETED
from ledgerrecon.operators.enrich import enrich
from ledgerrecon.operators.results import result_rows
from ledgerrecon.operators.totals import run_summary
from ledgerrecon.sources.catalog import Catalog, resolve_column


def _whole_number_keys(a: DataFrame | None, b: DataFrame | None, config: ReconConfig) -> list[bool]:
    """Which key definitions are one integer column on every side that is there.

    Their text says no more than the number, so rows are grouped by the number and
    the text is made once per key, not once per row.
    """
    def whole(df: DataFrame | None, columns: tuple[str, ...]) -> bool:
        return df is None or (len(columns) == 1 and isinstance(column_type(df, columns[0]), T.IntegralType))

    return [whole(a, k.columns("a")) and whole(b, k.columns("b")) for k in config.keys]


def _side_entries(df: DataFrame | None, side: str, config: ReconConfig, whole: list[bool],
                  catalog: Catalog | None) -> DataFrame | None:
    """(key_ordinal, key_number, key_text, amount_a, amount_b) of one ledger, all keys at once."""
    requested = config.value_column_a if side == "a" else config.value_column_b
    invert = config.invert_a if side == "a" else config.invert_b
    if df is None or (not requested and not config.allow_no_value):
        return None
    value: Column = F.lit(0).cast(AMOUNT)
    if requested:
        name = resolve_column(df, requested, catalog)
        if name is None:
            raise KeyError(f"value column not found: {requested}; available: {df.columns[:25]}")
        value = amount(ref(name), column_type(df, name))
        value = (-value).cast(AMOUNT) if invert else value

    def key(i: int) -> list[Column]:
        columns = config.keys[i].columns(side)
        if whole[i]:
            number, text = ref(columns[0]).cast("bigint"), F.lit(None).cast("string")
        else:
            number, text = F.lit(None).cast("bigint"), composite_key(df, columns)
        return [F.lit(i).alias("key_ordinal"), number.alias("key_number"), text.alias("key_text")]

    rows = unflagged(df)
    if len(config.keys) == 1:
        entries = rows.select(*key(0), value.alias("value"))
    else:
        tagged = F.array(*[F.struct(*key(i)) for i in range(len(config.keys))])
        # the value is converted once per row, before rows are multiplied by the keys
        entries = rows.withColumn("value", value).select("value", F.inline(tagged))
    nothing = F.lit(None).cast(AMOUNT)
    amounts = {"a": (F.col("value"), nothing), "b": (nothing, F.col("value"))}[side]
    return entries.select(*_GROUP, amounts[0].alias("amount_a"), amounts[1].alias("amount_b"))


_GROUP = ("key_ordinal", "key_number", "key_text")
RECON_SCHEMA = (
    "key_ordinal int, key_name string, key string, value_a double, value_b double, in_a boolean, in_b boolean, "
    "status string, group string, difference double"
)


def reconcile(a: DataFrame | None, b: DataFrame | None, config: ReconConfig, catalog_a: Catalog | None = None,
              catalog_b: Catalog | None = None) -> DataFrame:
    """One row per (key definition, key) with both totals and the verdict.

    Both ledgers are read once. Their rows are stacked and summed by one
    aggregation whatever the number of keys; the map-side part of it collapses a
    key that many rows share before anything is shuffled. A side without value
    column is left out, unless ``allow_no_value`` counts it as zeros.
    """
    whole = _whole_number_keys(a, b, config)
    parts = [_side_entries(a, "a", config, whole, catalog_a), _side_entries(b, "b", config, whole, catalog_b)]
    parts = [p for p in parts if p is not None]
    if not parts or not config.keys:
        frame = a if a is not None else b
        return frame.sparkSession.createDataFrame([], RECON_SCHEMA)
    stacked = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    zero = F.lit(0).cast(AMOUNT)
    totals = stacked.groupBy(*_GROUP).agg(
        F.coalesce(F.sum("amount_a"), zero).alias("total_a"), F.coalesce(F.sum("amount_b"), zero).alias("total_b"),
        (F.count("amount_a") > 0).alias("in_a"), (F.count("amount_b") > 0).alias("in_b"),
    )
    names = F.array(*[F.lit(k.name) for k in config.keys])
    columns = verdict(F.col("total_a"), F.col("total_b"), config.threshold)
    return totals.select(
        "key_ordinal", F.get(names, F.col("key_ordinal")).alias("key_name"),
        F.coalesce("key_text", F.col("key_number").cast("string"), F.lit("")).alias("key"),
        F.col("total_a").cast("double").alias("value_a"), F.col("total_b").cast("double").alias("value_b"),
        "in_a", "in_b", *[col.alias(name) for name, col in columns.items()],
    )


def run_record(results: DataFrame, config: ReconConfig, run_id: int, started_at: datetime) -> DataFrame:
    """One row that describes a run, with its summary."""
    finished_at = datetime.now(timezone.utc).replace(tzinfo=None)
    summary = run_summary(results).select(F.struct(
        F.lit(config.id).cast("bigint").alias("config_id"), F.lit(config.name).alias("config_name"),
        "keys_evaluated", "matched_keys", "unmatched_keys",
    ).alias("summary"))
    return summary.select(
        F.lit(run_id).cast("bigint").alias("run_id"), F.lit(config.id).cast("bigint").alias("config_id"),
        F.lit(RUN_COMPLETED).alias("status"), F.lit(started_at.isoformat()).alias("started_at"),
        F.lit(finished_at.isoformat()).alias("finished_at"), "summary",
    )


def persist_run(spark: SparkSession, recon: DataFrame, config: ReconConfig, run_id: int,
                results_path: str, runs_path: str) -> DataFrame:
    """Keep a run and its results; returns the stored results of the run.

    The verdicts are computed once: the summary reads what was just written. Only
    the folder of this run is replaced, also by a run without results, so a job that
    died can be run again, and only that folder is listed.
    """
    started_at = datetime.now(timezone.utc).replace(tzinfo=None)
    rows = result_rows(recon, run_id)
    folder = f"{results_path.rstrip('/')}/run_id={run_id}"
    rows.drop("run_id").write.mode("overwrite").parquet(folder)
    stored = spark.read.schema(rows.drop("run_id").schema).parquet(folder)
    stored = stored.select(F.lit(run_id).cast("bigint").alias("run_id"), "*")
    (
        run_record(stored, config, run_id, started_at).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(runs_path)
    )
    return stored


def run_and_enrich(spark: SparkSession, a: DataFrame | None, b: DataFrame | None, config: ReconConfig, run_id: int,
                   results_path: str, runs_path: str, catalog_a: Catalog | None = None,
                   catalog_b: Catalog | None = None) -> dict[str, DataFrame]:
    """Reconcile, keep the run, and give both ledgers back with their verdicts.

    The catalogs resolve logical names of value columns.
    """
    recon = reconcile(a, b, config, catalog_a, catalog_b)
    stored = persist_run(spark, recon, config, run_id, results_path, runs_path)
    sides = {"a": a, "b": b}
    return {side: enrich(df, stored, config, side, run_id=run_id) for side, df in sides.items() if df is not None}
