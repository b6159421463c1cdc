"""Writing prepared ledgers, exports and run reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerrecon.functions.refs import ref
from ledgerrecon.labels import REVERSAL_FLAG
from ledgerrecon.operators.results import present, present_headers
from ledgerrecon.sources.headers import ORDINAL


def _write(df: DataFrame, path: str, fmt: str, counts: Mapping[str, Column] | None = None) -> dict[str, int]:
    """Write a frame and return how many ``rows`` it had, and other counts, taken while writing."""
    seen = Observation()
    wanted = [F.count("*").alias("rows"), *[c.alias(n) for n, c in (counts or {}).items()]]
    writer = df.observe(seen, *wanted).write.mode("overwrite").format(fmt)
    if fmt == "csv":
        # blanks around a cell are part of it; an empty cell is quoted, a missing one is not
        writer = writer.options(
            header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue='""',
        )
    writer.save(path)
    return {name: int(count) for name, count in seen.get.items()}


def write_prepared_counted(df: DataFrame, path: str, counts: Mapping[str, Column],
                           fmt: str = "parquet") -> tuple[DataFrame, dict[str, int]]:
    """Store a prepared ledger, which always has a reversal flag; with the counts taken by the write."""
    stored = df if REVERSAL_FLAG in df.columns else df.withColumn(REVERSAL_FLAG, F.lit(False))
    return stored, _write(stored, path, fmt, counts)


def write_prepared(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Store a prepared ledger; the stored frame always has a reversal flag."""
    return write_prepared_counted(df, path, {}, fmt)[0]


def export_prepared(spark: SparkSession, prepared_path: str, path: str, fmt: str = "csv", ordinal: str = ORDINAL) -> dict:
    """Export a stored prepared ledger in order, under presentation names; one that is not there raises."""
    try:
        prepared = spark.read.parquet(prepared_path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no prepared ledger in {prepared_path}") from error
    return export_ledger(prepared, path, fmt, ordinal)


def in_file_order(df: DataFrame, ordinal: str = ORDINAL, last: int | None = None) -> DataFrame:
    """Rows so that the files written, read by name, are in ordinal order.

    Ordinals are whole numbers without large gaps, so each row's file follows from its ordinal and the ``last``
    one (looked up in a narrow read if not given); nothing is sampled.
    """
    if last is None:
        last = df.agg(F.max(ref(ordinal))).head()[0] or 0
    files = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    width = max(1, -(-(last + 1) // files))
    file = F.least(F.greatest(F.coalesce(F.floor(ref(ordinal) / width), F.lit(0)), F.lit(0)), F.lit(files - 1)).cast("int")
    return df.repartitionById(files, file).sortWithinPartitions(ref(ordinal))


def export_ledger(df: DataFrame, path: str, fmt: str = "csv", ordinal: str = ORDINAL, last: int | None = None) -> dict:
    """Export all columns but the ordinal, in order, under presentation names."""
    out = present_headers(in_file_order(df, ordinal, last).drop(ordinal))
    return {"path": path, "rows": _write(out, path, fmt)["rows"], "columns": out.columns}


def run_summary_sheet(runs: DataFrame, run_id: int) -> DataFrame:
    """The run's row with its summary fields side by side."""
    run = runs.where(F.col("run_id") == run_id)
    return run.select(
        "run_id", "config_id", "status", "started_at", "finished_at", "summary.config_name",
        "summary.keys_evaluated", "summary.matched_keys", "summary.unmatched_keys",
    )


def run_details_sheet(results: DataFrame, run_id: int, translated: bool = False) -> DataFrame:
    """The run's results; ``translated`` puts labels in place of raw values."""
    details = results.where(F.col("run_id") == run_id)
    return present(details) if translated else details


def export_run(runs: DataFrame, results: DataFrame, run_id: int, path: str, fmt: str = "csv",
               translated: bool = False) -> dict:
    """Write ``summary`` and ``details`` of a run as two folders."""
    details = run_details_sheet(results, run_id, translated)
    ordered = details.repartitionByRange("key_ordinal", "row_identifier").sortWithinPartitions("key_ordinal", "row_identifier")
    paths = {"summary": f"{path}/summary", "details": f"{path}/details"}
    if not _write(run_summary_sheet(runs, run_id), paths["summary"], fmt)["rows"]:
        raise LookupError(f"run not found: {run_id}")
    return {**paths, "rows": _write(ordered, paths["details"], fmt)["rows"]}


def export_enriched(enriched: DataFrame, path: str, fmt: str = "csv") -> str:
    """Write rows that carry their verdicts."""
    _write(enriched, path, fmt)
    return path
