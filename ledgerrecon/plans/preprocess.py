"""Jobs that turn an ingested ledger into one ready to reconcile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerrecon.config import CancellationConfig, ReversalConfig
from ledgerrecon.functions import column_type, ref, truthy
from ledgerrecon.labels import CANCELED_FLAG, REVERSAL_FLAG, RUN_COMPLETED
from ledgerrecon.operators.prepare import cancel_counts, fill_nulls, mark_canceled
from ledgerrecon.operators.results import result_rows_by_run
from ledgerrecon.operators.reversals import mark_all_reversals, reversal_hit_results, reversal_hits
from ledgerrecon.session import remove_path
from ledgerrecon.sources.catalog import apply_headers, infer_column_types
from ledgerrecon.sources.headers import ORDINAL
from ledgerrecon.sources.sinks import write_prepared_counted


def _schema_of(df: DataFrame, schema: Mapping[str, str] | None, ordinal: str) -> Mapping[str, str]:
    if schema is not None:
        return schema
    return {n: t for n, t in infer_column_types(df).items() if n != ordinal and not n.startswith("__is_")}


def _applicable(df: DataFrame, configs: Sequence[ReversalConfig]) -> list[ReversalConfig]:
    """Configurations whose columns are all there."""
    return [c for c in configs if {c.column_a, c.column_b, c.value_column} <= set(df.columns)]


def _mark_all(df: DataFrame, configs: Sequence[ReversalConfig], ordinal: str) -> DataFrame:
    present = _applicable(df, configs)
    return mark_all_reversals(df, present, ordinal) if present else df


def preprocess(df: DataFrame, schema: Mapping[str, str] | None = None, cancellation: CancellationConfig | None = None,
               reversals: Sequence[ReversalConfig] = (), ordinal: str = ORDINAL,
               detect_on_raw: bool = False) -> DataFrame:
    """Fill blanks, flag cancelled rows, flag reversals - in this order.

    Reversals are looked for in the filled rows, so missing account keys meet as
    'NULL'; ``detect_on_raw`` looks at the rows as they came, where a missing key
    meets nothing. A reversal config that names a missing column is passed over.
    Errors surface; no step is skipped because it failed.
    """
    kinds = _schema_of(df, schema, ordinal)
    if detect_on_raw:
        df = _mark_all(df, reversals, ordinal)
    out = fill_nulls(df, kinds)
    if cancellation is not None:
        out = mark_canceled(out, cancellation)
    return out if detect_on_raw else _mark_all(out, reversals, ordinal)


def reversal_run_results(df: DataFrame, configs: Sequence[ReversalConfig], first_run_id: int, dataset_id: int,
                         ordinal: str = ORDINAL) -> DataFrame:
    """Result records of one run per reversal config, over already filled rows, from one pass over them.

    A config that names a missing column gives its run no records, and no configs give none at all.
    """
    known = [(first_run_id + i, c) for i, c in enumerate(configs) if c in _applicable(df, configs)]
    hits = reversal_hits(df, [c for _, c in known], ordinal)
    return reversal_hit_results(hits, [run for run, _ in known] or [first_run_id], dataset_id)


RUN_SCHEMA = (
    "run_id bigint, config_id bigint, status string, started_at string, finished_at string, summary struct<config_id:bigint, "
    "config_name:string, keys_evaluated:bigint, matched_keys:bigint, unmatched_keys:bigint>"
)


def persist_reversal_runs(spark: SparkSession, df: DataFrame, configs: Sequence[ReversalConfig], first_run_id: int,
                          dataset_id: int, results_path: str, runs_path: str, ordinal: str = ORDINAL) -> DataFrame:
    """Keep one run per reversal config whose columns are there, with its results; returns the stored results.

    The runs have no config of their own and an empty summary. Only the folders of these runs are replaced,
    also of runs without results, so a job that died can be run again.
    """
    started_at = _now()
    run_ids = [first_run_id + i for i, c in enumerate(configs) if c in _applicable(df, configs)]
    rows = result_rows_by_run(reversal_run_results(df, configs, first_run_id, dataset_id, ordinal))
    root = results_path.rstrip("/")
    for run_id in run_ids:
        remove_path(spark, f"{root}/run_id={run_id}")
    rows.write.mode("append").partitionBy("run_id").parquet(root)
    runs = [(run_id, None, RUN_COMPLETED, started_at, _now(), None) for run_id in run_ids]
    _write_runs(spark.createDataFrame(runs, RUN_SCHEMA), runs_path)
    return spark.read.schema(rows.schema).parquet(root).where(F.col("run_id").isin(run_ids))


def _now() -> str:
    return datetime.now(timezone.utc).replace(tzinfo=None).isoformat()


def _write_runs(runs: DataFrame, path: str) -> None:
    runs.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


PREPROCESS_RUN_SCHEMA = (
    "run_id bigint, dataset_id bigint, status string, started_at string, finished_at string, summary struct<rows:bigint, "
    "columns:int, total_rows:bigint, canceled_rows:bigint, active_rows:bigint, reversals_count:bigint, storage_path:string>"
)


def _save(spark: SparkSession, rows: DataFrame, catalog: Sequence[tuple[str, str | None]] | None, run_id: int, dataset_id: int,
          path: str, runs_path: str, started_at: str, base_b: bool) -> DataFrame:
    """Store prepared rows under logical names, and the record of the run; its counts come from the write itself."""
    renamed = apply_headers(rows, catalog or ())
    named = dict(zip(rows.columns, renamed.columns))
    flag = lambda name: truthy(ref(named[name]), column_type(rows, name)) if name in named else F.lit(False)
    counts = {"canceled_rows": F.count_if(flag(CANCELED_FLAG)), "reversals_count": F.count_if(flag(REVERSAL_FLAG))}
    stored, seen = write_prepared_counted(renamed, path, counts)
    total = seen["rows"]
    summary = (
        (None, None, total, seen["canceled_rows"], total - seen["canceled_rows"], None, path) if base_b
        else (total, len(stored.columns), None, None, None, seen["reversals_count"], path)
    )
    record = spark.createDataFrame([(run_id, dataset_id, RUN_COMPLETED, started_at, _now(), summary)], PREPROCESS_RUN_SCHEMA)
    _write_runs(record, runs_path)
    return record


def preprocess_base_b(df: DataFrame, base_type: str, cancellation: CancellationConfig | None,
                      catalog: Sequence[tuple[str, str | None]] | None = None,
                      ordinal: str = ORDINAL) -> tuple[DataFrame, DataFrame]:
    """Fill and cancel a base-B ledger; returns it with total/canceled/active counts."""
    out = _base_b(df, base_type, cancellation, ordinal)
    return apply_headers(out, catalog or ()), cancel_counts(out)


def _base_b(df: DataFrame, base_type: str, cancellation: CancellationConfig | None, ordinal: str) -> DataFrame:
    if (base_type or "").strip().upper() != "B":
        raise ValueError(f"dataset is not of base type B: {base_type}")
    if cancellation is None:
        raise ValueError("a base-B ledger needs a cancellation configuration")
    return preprocess(df, cancellation=cancellation, ordinal=ordinal)


def run_base_b(spark: SparkSession, df: DataFrame, base_type: str, cancellation: CancellationConfig | None, run_id: int,
               dataset_id: int, path: str, runs_path: str, catalog: Sequence[tuple[str, str | None]] | None = None,
               ordinal: str = ORDINAL) -> DataFrame:
    """Fill and cancel a base-B ledger, store it under its logical names, and keep the run.

    Returns the run's record: total, canceled and active rows and where they lie. The ledger is computed once.
    """
    started_at = _now()
    out = _base_b(df, base_type, cancellation, ordinal)
    return _save(spark, out, catalog, run_id, dataset_id, path, runs_path, started_at, base_b=True)


def preprocess_generic(df: DataFrame, col_a: str | None = None, col_b: str | None = None,
                       value_column: str | None = None, schema: Mapping[str, str] | None = None,
                       ordinal: str = ORDINAL) -> tuple[DataFrame, DataFrame]:
    """Fill, and flag reversals when all three columns are named.

    Returns the rows and one summary row: rows, columns, rows flagged as reversal.
    """
    configs = [ReversalConfig(col_a, col_b, value_column)] if col_a and col_b and value_column else []
    out = preprocess(df, schema, None, configs, ordinal)
    if REVERSAL_FLAG not in out.columns:
        out = out.withColumn(REVERSAL_FLAG, F.lit(False))
    summary = out.agg(
        F.count("*").alias("rows"), F.lit(len(out.columns)).alias("columns"),
        F.count_if(ref(REVERSAL_FLAG)).alias("reversals_count"),
    )
    return out, summary


def run_generic(spark: SparkSession, df: DataFrame, run_id: int, dataset_id: int, path: str, runs_path: str,
                col_a: str | None = None, col_b: str | None = None, value_column: str | None = None,
                schema: Mapping[str, str] | None = None, catalog: Sequence[tuple[str, str | None]] | None = None,
                ordinal: str = ORDINAL) -> DataFrame:
    """``preprocess_generic``, stored under logical names, with the run's record: rows, columns, reversals, place."""
    started_at = _now()
    configs = [ReversalConfig(col_a, col_b, value_column)] if col_a and col_b and value_column else []
    out = preprocess(df, schema, None, configs, ordinal)
    return _save(spark, out, catalog, run_id, dataset_id, path, runs_path, started_at, base_b=False)
