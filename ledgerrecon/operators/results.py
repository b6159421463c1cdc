"""The results table: filters, pages, run lookup, purge and presentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ledgerrecon.functions import ref, translate_status
from ledgerrecon.labels import HEADER_TRANSLATION, PAGE_ROWS

ORDER = ("run_id", "key_ordinal", "row_identifier")
# what tells records of the same run, key definition and row apart
TIES = ("dataset_id", "status", "key_used", "group_name", "difference")


# column of the results table -> names it may come under, and its type
_RESULT_FIELDS = {
    "dataset_id": (("dataset_id",), "bigint"),
    "row_identifier": (("row_identifier", "key"), "string"),
    "status": (("status",), "string"),
    "group_name": (("group", "group_name"), "string"),
    "key_used": (("key_name", "key_used"), "string"),
    "difference": (("difference",), "double"),
    "key_ordinal": (("key_ordinal",), "int"),
}


def result_rows(df: DataFrame, run_id: int) -> DataFrame:
    """Reconciliation rows, or records under other names, in the shape of the results table."""
    return _result_columns(df, F.lit(run_id))


def result_rows_by_run(df: DataFrame) -> DataFrame:
    """Records that name their run, in the shape of the results table."""
    return _result_columns(df, ref("run_id"))


def _result_columns(df: DataFrame, run_id: Column) -> DataFrame:
    columns = [run_id.cast("bigint").alias("run_id")]
    for name, (sources, kind) in _RESULT_FIELDS.items():
        found = [ref(c) for c in sources if c in df.columns]
        value = F.coalesce(*found) if found else F.lit(0 if name == "key_ordinal" else None)
        columns.append(value.cast(kind).alias(name))
    return df.select(*columns)


def append_results(df: DataFrame, run_id: int, path: str) -> None:
    """Add result records to a run that is already stored."""
    result_rows(df, run_id).write.mode("append").partitionBy("run_id").parquet(path)


def filter_results(results: DataFrame, run_id: int | None = None, status: str | None = None,
                   key_used: str | None = None, group_name: str | None = None) -> DataFrame:
    """Rows equal to every filter that is given; ``run_id`` prunes partitions."""
    wanted = {"run_id": run_id, "status": status, "key_used": key_used, "group_name": group_name}
    for name, value in wanted.items():
        if value is not None:
            results = results.where(ref(name) == F.lit(value))
    return results


def page(results: DataFrame, limit: int = PAGE_ROWS, offset: int = 0) -> DataFrame:
    """One page in result order. A deep page is cheaper through ``page_after``."""
    return results.orderBy(*_order(results)).offset(offset).limit(limit)


def _order(results: DataFrame) -> list[str]:
    return [*ORDER, *(c for c in TIES if c in results.columns)]


def page_after(results: DataFrame, last: tuple | Row, limit: int = PAGE_ROWS) -> DataFrame:
    """The page that follows ``last``: the last row of the page before, or its (run_id, key_ordinal, row_identifier).

    With a whole row, records that share those three columns are told apart by their other
    columns, so none is passed over; NULLs come first. Records equal in everything cannot be told apart.
    """
    order = _order(results)
    values = [last[c] for c in order] if isinstance(last, Row) and hasattr(last, "__fields__") else list(last)
    later, same = F.lit(False), F.lit(True)
    for name, value in zip(order, values):
        at = F.lit(value).cast(results.schema[name].dataType)
        beyond = ref(name).isNotNull() if value is None else F.coalesce(ref(name) > at, F.lit(False))
        later, same = later | (same & beyond), same & ref(name).eqNullSafe(at)
    bound = ref(order[0]) >= F.lit(values[0])  # a plain comparison, to prune partitions by
    return results.where(bound & later).orderBy(*order).limit(limit)


def store_pages(results: DataFrame, path: str) -> None:
    """Store results in page order with an index of how many rows each file holds; ``stored_page`` reads them.

    The data is dealt by ranges and sorted inside them, never brought to one task.
    """
    order = _order(results)
    rows, index = f"{path.rstrip('/')}/rows", f"{path.rstrip('/')}/index"
    results.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(rows)
    counts = results.sparkSession.read.parquet(rows).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # one row for each file
    counts.withColumn("before", F.coalesce(before, F.lit(0))).write.mode("overwrite").parquet(index)


def stored_page(spark: SparkSession, path: str, limit: int = PAGE_ROWS, offset: int = 0) -> DataFrame:
    """A page of stored results, however deep: only the files that hold its rows are opened."""
    index = spark.read.parquet(f"{path.rstrip('/')}/index")
    wanted = index.where((F.col("before") < offset + limit) & (F.col("before") + F.col("rows") > offset)).orderBy("before").collect()
    rows = f"{path.rstrip('/')}/rows"
    schema = spark.read.parquet(rows).schema
    if not wanted:
        return spark.createDataFrame([], schema)
    files = spark.read.schema(schema).parquet(*[f"{rows}/{r['file']}" for r in wanted])
    starts = F.create_map(*[F.lit(x) for r in wanted for x in (r["file"], r["before"])])  # files of one page
    at = F.element_at(starts, F.col("_metadata.file_name")) + F.col("_metadata.row_index")
    return files.withColumn("__at__", at).where(F.col("__at__").between(offset, offset + limit - 1)).drop("__at__")


def total_rows(results: DataFrame) -> DataFrame:
    """One row: how many results the filters leave."""
    return results.agg(F.count("*").alias("total"))


def run_with_results(runs: DataFrame, results: DataFrame, run_id: int) -> tuple[DataFrame, DataFrame]:
    """The run's row and its results; raises when there is no such run."""
    run = runs.where(F.col("run_id") == run_id)
    if run.isEmpty():
        raise LookupError(f"run not found: {run_id}")
    return run, filter_results(results, run_id=run_id)


def present(results: DataFrame) -> DataFrame:
    """Results with translated status and '' for a missing group or key."""
    return results.withColumns({
        "status": translate_status(ref("status")),
        "group_name": F.coalesce(ref("group_name"), F.lit("")),
        "key_used": F.coalesce(ref("key_used"), F.lit("")),
    })


def present_headers(df: DataFrame) -> DataFrame:
    """Flag and verdict columns under their presentation names."""
    return df.withColumnsRenamed({k: v for k, v in HEADER_TRANSLATION.items() if k in df.columns})


def purge(results: DataFrame, runs: DataFrame, configs: DataFrame, dataset_id: int) -> dict[str, DataFrame]:
    """What is left of results, runs and configs once a dataset is deleted.

    Configs that use the dataset on either side go, with their runs and those
    runs' results; so do results that name the dataset itself.
    """
    doomed = configs.where((F.col("base_a_id") == dataset_id) | (F.col("base_b_id") == dataset_id)).select("config_id")
    doomed_runs = runs.join(doomed, "config_id", "left_semi").select("run_id")
    own = F.col("dataset_id").isNull() | (F.col("dataset_id") != dataset_id)
    return {
        "results": results.where(own).join(doomed_runs, "run_id", "left_anti"),
        "runs": runs.join(doomed, "config_id", "left_anti"),
        "configs": configs.join(doomed, "config_id", "left_anti"),
    }
