"""Every registered query: operator under test over whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerrecon.config import CancellationConfig, ReversalConfig, SourceSpec
from ledgerrecon.functions import (
    classify, composite_key, duplicate_columns, first_scalar, invert_value, key_part, number_or_zero, title_words,
    truthy, unflagged, yes_no,
)
from ledgerrecon.labels import CANCELED_FLAG, REVERSAL_FLAG
from ledgerrecon.operators.enrich import attach_results, enrich, merge_results
from ledgerrecon.operators.prepare import cancel_counts, fill_counts, fill_nulls, mark_canceled
from ledgerrecon.operators.results import (
    append_results, filter_results, page, page_after, present, present_headers, purge, result_rows, run_with_results,
    store_pages, stored_page, total_rows,
)
from ledgerrecon.operators.reversals import (
    mark_reversals, reversal_counts, reversal_pairs, reversal_pairs_one_to_one, reversal_results, reversal_rows,
)
from ledgerrecon.operators.totals import group_breakdown, missing_keys, run_summary, side_totals, status_breakdown
from ledgerrecon.plans.preprocess import (
    persist_reversal_runs, preprocess, preprocess_base_b, preprocess_generic, reversal_run_results, run_base_b, run_generic,
)
from ledgerrecon.plans.purge import purge_dataset, run_block
from ledgerrecon.plans.reconcile import persist_run, reconcile, run_and_enrich
from ledgerrecon.session import shared_path
from ledgerrecon.sources.catalog import (
    apply_headers, cast_text_columns, column_profile, infer_text_types, mapped_columns, text_column_evidence,
)
from ledgerrecon.sources.headers import promote_header
from ledgerrecon.sources.readers import ingest, preview, read_rows, read_source
from ledgerrecon.sources.sinks import (
    export_enriched, export_ledger, export_prepared, export_run, in_file_order, write_prepared,
)
from workloads.ledgers import (
    BY_ORDER, BY_PARTY, BY_YEAR, MESSY_TYPES, journal, messy, recon_a, recon_b, recon_config, table, text_journal,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PAIRS = ReversalConfig("a", "b", "v")
TEXT_PAIRS = ReversalConfig("acct_a", "acct_b", "v")
CANCEL_S = CancellationConfig("ind", "S")
FOUND = ("key_name", "key", "value_a", "value_b", "status", "group", "difference")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- reconcile --------------------------------------------------------------

def _recon(spark: SparkSession, sf_dir: str, config=None) -> DataFrame:
    return reconcile(recon_a(spark, sf_dir), recon_b(spark, sf_dir), config or recon_config())


def _results(spark: SparkSession, sf_dir: str, run_id: int = 1) -> DataFrame:
    return result_rows(_recon(spark, sf_dir, recon_config(BY_ORDER, BY_YEAR)), run_id)


def _stored_run(spark: SparkSession, sf_dir: str, run_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """Runs and results tables with one two-key run in them."""
    results_path, runs_path = shared_path(spark, "results"), shared_path(spark, "runs")
    config = recon_config(BY_ORDER, BY_YEAR)
    persist_run(spark, _recon(spark, sf_dir, config), config, run_id, results_path, runs_path)
    return spark.read.parquet(runs_path), spark.read.parquet(results_path)


@query
def recon_basic(spark, sf_dir):
    return _recon(spark, sf_dir).select(*FOUND)


@query
def recon_multi_key(spark, sf_dir):
    return _recon(spark, sf_dir, recon_config(BY_ORDER, BY_YEAR)).select("key_ordinal", *FOUND)


@query
def recon_invert(spark, sf_dir):
    return _recon(spark, sf_dir, recon_config(invert_b=True)).select(*FOUND)


@query
def recon_presence(spark, sf_dir):
    return _recon(spark, sf_dir).select("key", "in_a", "in_b", "status")


@query
def recon_text_values(spark, sf_dir):
    rows = messy(spark, sf_dir).withColumn("text_key", F.col("k").cast("string"))
    config = recon_config(replace(BY_ORDER, a_cols=("k",), b_cols=("text_key",)),
                          value_column_a="num", value_column_b="num_text", threshold=0.0)
    return reconcile(rows.select("k", "num"), rows.select("text_key", "num_text"), config).select(*FOUND)


@query
def recon_resolved_column(spark, sf_dir):
    return _recon(spark, sf_dir, recon_config(value_column_a=" ExtendedPrice ", value_column_b="AMOUNT")).select(*FOUND)


@query
def recon_no_value(spark, sf_dir):
    config = recon_config(value_column_a=None, value_column_b=None, allow_no_value=True)
    return _recon(spark, sf_dir, config).select(*FOUND)


@query
def recon_one_side(spark, sf_dir):
    return _recon(spark, sf_dir, recon_config(value_column_b=None)).select(*FOUND)


@query
def recon_summary(spark, sf_dir):
    return run_summary(_recon(spark, sf_dir, recon_config(BY_ORDER, BY_YEAR)))


@query
def recon_status_breakdown(spark, sf_dir):
    return status_breakdown(_recon(spark, sf_dir))


@query
def recon_group_breakdown(spark, sf_dir):
    return group_breakdown(_recon(spark, sf_dir))


@query
def classify_rows(spark, sf_dir):
    verdicts = classify(F.col("l_extendedprice"), F.col("l_quantity") * 1500, 1000.0)
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", verdicts.alias("v"))
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                F.col("v.status").alias("status"), F.col("v.group").alias("group_name"))
    )


@query
def side_totals_kept(spark, sf_dir):
    return side_totals(_half_flagged(spark, sf_dir), ["o_custkey"], "amount")


@query
def side_totals_strict(spark, sf_dir):
    return side_totals(_half_flagged(spark, sf_dir), ["o_custkey"], "amount", strict_flags=True)


def _half_flagged(spark, sf_dir):
    known = F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col(CANCELED_FLAG))
    return recon_b(spark, sf_dir).withColumn(CANCELED_FLAG, known)


@query
def missing_order_keys(spark, sf_dir):
    a, b = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").withColumn("next", F.col("o_orderkey") + 100)
    return missing_keys(a, ["l_orderkey"], b, ["next"])


# --- keys and values --------------------------------------------------------

@query
def composite_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumns({
        "half": F.col("o_custkey") / 2, "blank": F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")),
    })
    key = composite_key(rows, ["o_custkey", "half", "blank", "no_such_column", "o_orderdate"])
    return rows.select("o_orderkey", key.alias("key"))


@query
def number_clean(spark, sf_dir):
    cleaned = number_or_zero(F.col("num_text"), T.StringType())
    return messy(spark, sf_dir).select("k", cleaned.alias("value"))


@query
def truthy_flags(spark, sf_dir):
    return messy(spark, sf_dir).select(
        "k", truthy(F.col("ind"), T.StringType()).alias("text_flag"),
        truthy(F.col("num"), T.DoubleType()).alias("number_flag"),
        truthy(F.col("cents") % 2, T.LongType()).alias("odd_flag"),
    )


@query
def inverted_values(spark, sf_dir):
    rows = messy(spark, sf_dir).select("k", "num", "num_text")
    return invert_value(invert_value(rows, "num"), "num_text")


@query
def nested_list_value(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    value, _ = first_scalar(F.col("embedding"), rows.schema["embedding"].dataType)
    return rows.select("vec_id", value.cast("double").alias("value"))


@query
def nested_map_value(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.from_json("props", "map<string,double>").alias("props"), "value",
        F.from_json(F.to_json(F.struct(F.col("user_id").alias("a"), F.col("value").alias("amount"))),
                    "map<string,double>").alias("named"))
    first, _ = first_scalar(F.col("props"), rows.schema["props"].dataType)
    named, _ = first_scalar(F.col("named"), rows.schema["named"].dataType)
    return rows.select("event_id", first.alias("first_value"), named.alias("named_value"))


@query
def dup_column_sum(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn(
        "price_again", F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")))
    value = duplicate_columns(rows, ["l_extendedprice", "price_again"])
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", value.alias("value"))


@query
def dup_column_first(spark, sf_dir):
    rows = messy(spark, sf_dir)
    return rows.select("k", duplicate_columns(rows, ["num_text", "ind", "txt"]).alias("value"))


@query
def yes_no_labels(spark, sf_dir):
    return messy(spark, sf_dir).select(
        "k", yes_no(F.col("ind"), T.StringType()).alias("text_label"),
        yes_no(F.col("cents") % 2, T.LongType()).alias("odd_label"),
    )


@query
def title_labels(spark, sf_dir):
    name = F.concat_ws("_", F.col("c_mktsegment"), F.upper("c_name"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", title_words(name).alias("snake"), title_words(F.col("c_mktsegment")).alias("word"),
        title_words(F.col("c_name")).alias("mixed"),
    )


# --- preparation ------------------------------------------------------------

@query
def fill_null_cells(spark, sf_dir):
    return fill_nulls(messy(spark, sf_dir), MESSY_TYPES)


@query
def fill_null_counts(spark, sf_dir):
    return fill_counts(messy(spark, sf_dir), MESSY_TYPES)


@query
def cancel_exact(spark, sf_dir):
    rows = mark_canceled(messy(spark, sf_dir), CancellationConfig("ind", "S", mode="exact"))
    return rows.select("k", F.col(CANCELED_FLAG).alias("is_canceled"))


@query
def cancel_normalized(spark, sf_dir):
    return mark_canceled(messy(spark, sf_dir), CANCEL_S).select("k", F.col(CANCELED_FLAG).alias("is_canceled"))


@query
def cancel_flag_counts(spark, sf_dir):
    return cancel_counts(mark_canceled(messy(spark, sf_dir), CANCEL_S))


@query
def concilable_rows(spark, sf_dir):
    rows = mark_reversals(text_journal(spark, sf_dir), TEXT_PAIRS)
    return unflagged(mark_canceled(rows, CANCEL_S)).select("row_index", "acct_a", "acct_b", "v")


# --- reversals --------------------------------------------------------------

@query
def reversal_pair_groups(spark, sf_dir):
    pairs = reversal_pairs(journal(spark, sf_dir), PAIRS)
    return pairs.withColumn("pairs", F.col("pairs").cast("bigint"))


@query
def reversal_group_rows(spark, sf_dir):
    return reversal_rows(journal(spark, sf_dir), PAIRS).select("row_index", "low", "high", "level", "partners")


@query
def reversal_pairs_1to1(spark, sf_dir):
    return reversal_pairs_one_to_one(journal(spark, sf_dir), PAIRS)


@query
def reversal_flags(spark, sf_dir):
    rows = mark_reversals(journal(spark, sf_dir), PAIRS)
    return rows.select("row_index", "a", "b", "v", F.col(REVERSAL_FLAG).alias("is_reversal"))


@query
def reversal_flags_1to1(spark, sf_dir):
    rows = mark_reversals(journal(spark, sf_dir), replace(PAIRS, mode="one_to_one"))
    return rows.select("row_index", F.col(REVERSAL_FLAG).alias("is_reversal"))


@query
def reversal_flags_tolerance(spark, sf_dir):
    rows = mark_reversals(journal(spark, sf_dir, drift=0.01), replace(PAIRS, tolerance=0.01))
    return rows.select("row_index", F.col(REVERSAL_FLAG).alias("is_reversal"))


@query
def reversal_totals(spark, sf_dir):
    counts = reversal_counts(journal(spark, sf_dir), PAIRS)
    return counts.withColumn("reversals", F.col("reversals").cast("bigint"))


@query
def reversal_totals_tolerance(spark, sf_dir):
    counts = reversal_counts(journal(spark, sf_dir, drift=0.01), replace(PAIRS, tolerance=0.01))
    return counts.withColumn("reversals", F.col("reversals").cast("bigint"))


@query
def reversal_rows_tolerance(spark, sf_dir):
    rows = reversal_rows(journal(spark, sf_dir, drift=0.01), replace(PAIRS, tolerance=0.01))
    return rows.select("row_index", "low", "high", "partners")


@query
def reversal_result_records(spark, sf_dir):
    return reversal_results(mark_reversals(journal(spark, sf_dir), PAIRS), 7, 3)


# --- verdicts on rows -------------------------------------------------------

@query
def enrich_first(spark, sf_dir):
    _, results = _stored_run(spark, sf_dir)
    rows = enrich(recon_b(spark, sf_dir), results, recon_config(BY_ORDER, BY_YEAR), "b", ordinal="o_orderkey")
    return rows.select("o_orderkey", "o_custkey", "status", "group_name", "key_used")


@query
def enrich_last(spark, sf_dir):
    _, results = _stored_run(spark, sf_dir)
    rows = merge_results(recon_b(spark, sf_dir), results, recon_config(BY_ORDER, BY_YEAR), "b", ordinal="o_orderkey")
    return rows.select("o_orderkey", "recon_key_name", "recon_status", "recon_group", "recon_difference")


@query
def enrich_many_keys(spark, sf_dir):
    config = recon_config(BY_ORDER, BY_PARTY, BY_YEAR)
    results = result_rows(_recon(spark, sf_dir, config), 1)
    rows = enrich(recon_b(spark, sf_dir), results, config, "b", precedence="last", ordinal="o_orderkey")
    return rows.select("o_orderkey", "o_custkey", "status", "group_name", "key_used")


@query
def enrich_items(spark, sf_dir):
    _, results = _stored_run(spark, sf_dir)
    items = read_source(spark, SourceSpec(f"{sf_dir}/lineitem.parquet", "parquet"), ordinal="row_index")
    rows = enrich(items.withColumn("ship_year", F.year("l_shipdate")), results, recon_config(BY_ORDER, BY_YEAR), "a")
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice", "status", "group_name", "key_used")


@query
def attach_by_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("key", F.concat(F.col("o_orderkey").cast("string"), F.lit("")))
    found = _recon(spark, sf_dir).where(F.col("group") == "Conciliados").select("key", "status", "group", "difference")
    return attach_results(orders, found).select("o_orderkey", "status", F.col("group").alias("group_name"), "difference")


@query
def run_then_enrich(spark, sf_dir):
    config = recon_config(BY_ORDER, BY_YEAR)
    sides = run_and_enrich(spark, recon_a(spark, sf_dir), recon_b(spark, sf_dir), config, 5,
                           shared_path(spark, "results"), shared_path(spark, "runs"))
    count = lambda side: sides[side].groupBy("key_used", "status").agg(F.count("*").alias("rows")).withColumn("side", F.lit(side))
    return count("a").unionByName(count("b"))


# --- results ----------------------------------------------------------------

@query
def persisted_run(spark, sf_dir):
    runs, _ = _stored_run(spark, sf_dir, run_id=12)
    return runs.select(F.col("run_id").cast("bigint").alias("run_id"), "config_id", "status", "summary.config_name",
                       "summary.keys_evaluated", "summary.matched_keys", "summary.unmatched_keys")


@query
def appended_results(spark, sf_dir):
    path = shared_path(spark, "results")
    persist_run(spark, _recon(spark, sf_dir), recon_config(), 3, path, shared_path(spark, "runs"))
    append_results(reversal_results(mark_reversals(journal(spark, sf_dir), PAIRS), 3, 10), 3, path)
    stored = filter_results(spark.read.parquet(path), run_id=3)
    return stored.select("row_identifier", "dataset_id", "status", "group_name", "key_used")


@query
def run_lookup(spark, sf_dir):
    runs, results = _stored_run(spark, sf_dir, run_id=12)
    run, found = run_with_results(runs, results, 12)
    tally = found.groupBy("run_id", "key_used", "status").agg(F.count("*").alias("keys"))
    return tally.join(run.select("run_id", F.col("status").alias("run_status")), "run_id").drop("run_id")


@query
def results_page(spark, sf_dir):
    return page(filter_results(_results(spark, sf_dir), run_id=1, status="Divergência"), limit=100, offset=50)


@query
def results_page_after(spark, sf_dir):
    return page_after(filter_results(_results(spark, sf_dir), key_used="pedido"), (1, 0, "100"), limit=100)


@query
def results_total(spark, sf_dir):
    return total_rows(filter_results(_results(spark, sf_dir), group_name="Conciliados", key_used="pedido"))


@query
def label_translate(spark, sf_dir):
    return present(_results(spark, sf_dir)).select("row_identifier", "status", "group_name", "key_used", "difference")


@query
def header_translate(spark, sf_dir):
    rows = mark_reversals(mark_canceled(text_journal(spark, sf_dir), CANCEL_S), TEXT_PAIRS)
    return present_headers(rows.select("row_index", CANCELED_FLAG, REVERSAL_FLAG))


def _history(spark, sf_dir):
    """Configs from nations, runs from suppliers, results from line items."""
    configs = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("config_id"), F.col("n_regionkey").alias("base_a_id"),
        (F.col("n_nationkey") % 7).alias("base_b_id"))
    runs = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("run_id"), F.col("s_nationkey").alias("config_id"), F.col("s_name").alias("name"))
    results = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("run_id"), F.when(F.col("l_partkey") % 11 != 0, F.col("l_partkey") % 11).alias("dataset_id"),
        F.col("l_orderkey").alias("row_identifier"), F.col("l_extendedprice").alias("difference"))
    return results, runs, configs


@query
def purge_results(spark, sf_dir):
    left = purge(*_history(spark, sf_dir), dataset_id=3)["results"]
    return left.select("run_id", "dataset_id", "row_identifier", "difference")


@query
def purge_runs(spark, sf_dir):
    return purge(*_history(spark, sf_dir), dataset_id=3)["runs"].select("run_id", "config_id", "name")


# --- sources and sinks ------------------------------------------------------

def _text_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    date = key_part(F.col("o_orderdate"), orders.schema["o_orderdate"].dataType)
    return orders.withColumn("o_orderdate", date)


@query
def infer_types(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    text = orders.select(*[F.col(c).cast("string") for c in orders.columns],
                         F.when(F.col("o_orderstatus") != "P", F.initcap((F.col("o_orderstatus") == "F").cast("string"))).alias("final"),
                         F.concat(F.lpad(F.col("o_orderkey").cast("string"), 44, "9")).alias("access_key"))
    return text_column_evidence(text, text.columns).select("column", "filled", "storage", "data_type")


@query
def column_catalog(spark, sf_dir):
    text = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_returnflag").select(
        F.col("l_orderkey").cast("string"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("l_extendedprice"),
        "l_returnflag")
    typed = cast_text_columns(text, infer_text_types(text, text.columns))
    catalog = mapped_columns(column_profile(typed)).drop("id")
    filled = typed.agg(*[F.count(c).alias(c) for c in typed.columns])
    cells = filled.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).alias("filled")) for c in typed.columns])))
    return catalog.join(F.broadcast(cells), "name")


@query
def logical_names(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return apply_headers(rows, [("c_custkey", "cliente"), ("c_name", ""), ("c_acctbal", "saldo")])


@query
def ingest_roundtrip(spark, sf_dir):
    source, stored = shared_path(spark, "csv"), shared_path(spark, "ledger")
    export_ledger(_text_orders(spark, sf_dir).withColumn("at", F.col("o_orderkey")), source, "csv", ordinal="at")
    ingest(spark, SourceSpec(source, "CSV"), stored)
    return spark.read.parquet(stored)


def _with_preamble(spark, sf_dir, preamble: list[str], lead: str) -> str:
    """Orders as delimited text whose header line is not the first line."""
    orders = _text_orders(spark, sf_dir)
    parts = [F.lit(lead)] if lead else []
    line = F.concat(*parts, F.concat_ws(",", *[
        F.col(c).cast("decimal(18,2)").cast("string") if c == "o_totalprice" else F.col(c).cast("string") for c in orders.columns]))
    path = shared_path(spark, "preamble")
    first = spark.createDataFrame([(text,) for text in preamble], "value string").coalesce(1)
    rest = in_file_order(orders, "o_orderkey").select(line.alias("value"))
    first.union(rest).write.text(path)
    return path


@query
def header_at_coordinates(spark, sf_dir):
    path = _with_preamble(spark, sf_dir, ["Relatorio de pedidos,,", ",emitido,hoje", ",pedido,cliente,situacao,valor,data,data,"], ",")
    return read_source(spark, SourceSpec(path, "csv", header_row=3, header_col="B"), ordinal="row_index")


@query
def header_detected(spark, sf_dir):
    path = _with_preamble(spark, sf_dir, [",,,,,", ",resumo,,,,", "pedido,cliente,situacao,valor,data,prioridade"], "")
    return read_source(spark, SourceSpec(path, "txt"), ordinal="row_index")


@query
def row_ordinals(spark, sf_dir):
    spec = SourceSpec(f"{sf_dir}/orders.parquet", "parquet")
    return read_source(spark, spec, ordinal="row_index").select("row_index", "o_orderkey", "o_totalprice")


def _ordered_orders(spark, sf_dir, fmt: str) -> DataFrame:
    path = shared_path(spark, fmt)
    in_file_order(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey").write.format(fmt).save(path)
    return read_source(spark, SourceSpec(path, fmt), ordinal="row_index").select("row_index", "o_orderkey", "o_orderstatus")


@query
def ordinals_json(spark, sf_dir):
    return _ordered_orders(spark, sf_dir, "json")


@query
def ordinals_orc(spark, sf_dir):
    return _ordered_orders(spark, sf_dir, "orc")


@query
def preview_rows(spark, sf_dir):
    rows = read_source(spark, SourceSpec(f"{sf_dir}/customer.parquet", "parquet"), ordinal="row_index")
    return preview(rows.orderBy("row_index")).select("row_index", "c_custkey", "c_name")


@query
def export_ordered(spark, sf_dir):
    path = shared_path(spark, "export")
    rows = mark_canceled(messy(spark, sf_dir), CANCEL_S).withColumnRenamed("k", "row_index").withColumn("k", F.col("row_index"))
    export_ledger(rows, path, "parquet")
    return spark.read.parquet(path)


@query
def prepared_sink(spark, sf_dir):
    path = shared_path(spark, "prepared")
    write_prepared(fill_nulls(messy(spark, sf_dir), MESSY_TYPES), path)
    return spark.read.parquet(path).withColumnRenamed(REVERSAL_FLAG, "is_reversal")


@query
def run_export(spark, sf_dir):
    runs, results = _stored_run(spark, sf_dir, run_id=4)
    paths = export_run(runs, results, 4, shared_path(spark, "report"), "parquet", translated=True)
    return spark.read.parquet(paths["details"]).select("row_identifier", "status", "group_name", "key_used", "difference")


@query
def run_export_summary(spark, sf_dir):
    runs, results = _stored_run(spark, sf_dir, run_id=4)
    paths = export_run(runs, results, 4, shared_path(spark, "report"), "csv")
    return spark.read.option("header", True).option("inferSchema", True).csv(paths["summary"]).select(
        "run_id", "status", "config_name", "keys_evaluated", "matched_keys", "unmatched_keys")


@query
def enriched_export(spark, sf_dir):
    _, results = _stored_run(spark, sf_dir)
    rows = merge_results(recon_a(spark, sf_dir), results, recon_config(BY_ORDER, BY_YEAR), "a")
    path = export_enriched(rows, shared_path(spark, "enriched"), "parquet")
    return spark.read.parquet(path).groupBy("recon_key_name", "recon_status").agg(
        F.count("*").alias("rows"), F.count_if(F.col("recon_difference") > 0).alias("positive"))


# --- preprocessing jobs -----------------------------------------------------

_TEXT_JOURNAL_TYPES = {"acct_a": "string", "acct_b": "string", "v": "number", "ind": "string"}


@query
def preprocess_upload(spark, sf_dir):
    rows = preprocess(text_journal(spark, sf_dir), _TEXT_JOURNAL_TYPES, CANCEL_S, [TEXT_PAIRS])
    return rows.select("row_index", "acct_a", "acct_b", "v", "ind", F.col(CANCELED_FLAG).alias("is_canceled"),
                       F.col(REVERSAL_FLAG).alias("is_reversal"))


@query
def preprocess_raw_keys(spark, sf_dir):
    rows = preprocess(text_journal(spark, sf_dir), _TEXT_JOURNAL_TYPES, None, [TEXT_PAIRS], detect_on_raw=True)
    return rows.select("row_index", "acct_a", "acct_b", F.col(REVERSAL_FLAG).alias("is_reversal"))


@query
def upload_reversal_runs(spark, sf_dir):
    rows = fill_nulls(text_journal(spark, sf_dir), _TEXT_JOURNAL_TYPES)
    return reversal_run_results(rows, [TEXT_PAIRS, replace(TEXT_PAIRS, column_a="acct_b", column_b="acct_a")], 31, 2)


@query
def base_b_rows(spark, sf_dir):
    rows, _ = preprocess_base_b(messy(spark, sf_dir), "b", CANCEL_S, ordinal="k")
    return rows.withColumnRenamed(CANCELED_FLAG, "is_canceled")


@query
def base_b_counts(spark, sf_dir):
    return preprocess_base_b(messy(spark, sf_dir), "B", CANCEL_S, ordinal="k")[1]


@query
def generic_preprocess(spark, sf_dir):
    return preprocess_generic(text_journal(spark, sf_dir), "acct_a", "acct_b", "v", _TEXT_JOURNAL_TYPES)[1]


# --- files, pages and values that need care ---------------------------------

def _awkward_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with cells that hold blanks, quotes, commas and line breaks, or nothing."""
    k = F.col("o_orderkey")
    cell = F.lit(None).cast("string")
    values = (" x ", "", "  y", None, 'q"uo"te', "line\nbreak", "a,b", "plain")
    for i, value in enumerate(values):
        if value is not None:
            cell = F.when(k % 8 == i, F.lit(value)).otherwise(cell)
    return table(spark, sf_dir, "orders").select(k.alias("at"), k.alias("k"), cell.alias("cell"))


@query
def export_csv_roundtrip(spark, sf_dir):
    path = shared_path(spark, "export")
    export_ledger(_awkward_cells(spark, sf_dir), path, "csv", ordinal="at")
    return read_source(spark, SourceSpec(path, "csv"), typed=False)


@query
def ingest_quoted_lines(spark, sf_dir):
    source, stored = shared_path(spark, "csv"), shared_path(spark, "ledger")
    export_ledger(_awkward_cells(spark, sf_dir), source, "csv", ordinal="at")
    ingest(spark, SourceSpec(source, "csv"), stored)
    return spark.read.parquet(stored)


@query
def header_many_files(spark, sf_dir):
    path = shared_path(spark, "preamble")
    orders = table(spark, sf_dir, "orders")
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    # a file for each thousand orders, with its own preamble and header
    part = F.floor(F.col("o_orderkey") / 4000).cast("string")
    top = lambda at, text: F.struct(F.lit(at).alias("at"), text.alias("value"))
    heads = orders.select(part.alias("part")).distinct().select("part", F.inline(F.array(
        top(0, F.concat(F.lit("parte "), F.col("part"), F.lit(",,"))), top(1, F.lit("pedido,situacao,prioridade")))))
    rows = orders.select(part.alias("part"), (F.col("o_orderkey") + 2).alias("at"), line.alias("value"))
    files = heads.select("part", F.col("at").cast("bigint").alias("at"), "value").unionByName(rows)
    files.repartition("part").sortWithinPartitions("part", "at").drop("at").write.partitionBy("part").text(path)
    read = read_source(spark, SourceSpec(f"{path}/part=*", "csv", header_row=2), ordinal="row_index")
    return read.groupBy("situacao", "prioridade").agg(
        F.count("*").alias("pedidos"), F.min("pedido").alias("primeiro"), F.max("pedido").alias("ultimo"),
    )


@query
def preprocess_many_reversals(spark, sf_dir):
    configs = [TEXT_PAIRS, ReversalConfig("acct_a", "ind", "v"), ReversalConfig("acct_b", "ind", "v"), ReversalConfig("acct_a", "gone", "v")]
    rows = preprocess(text_journal(spark, sf_dir), _TEXT_JOURNAL_TYPES, None, configs)
    return rows.select("row_index", "acct_a", "acct_b", F.col(REVERSAL_FLAG).alias("is_reversal"))


@query
def pages_cover_all(spark, sf_dir):
    _, results = _stored_run(spark, sf_dir, run_id=6)
    path = shared_path(spark, "pages")
    store_pages(results, path)
    files = spark.read.parquet(f"{path}/index").agg(F.max(F.col("before") + F.col("rows")).alias("rows"), F.count("*").alias("files")).head()
    # a page for each file of the store, cut across the files' borders
    limit = -(-files["rows"] // files["files"])
    pages = [stored_page(spark, path, limit, offset) for offset in range(0, files["rows"], limit)]
    return reduce(DataFrame.unionByName, pages).select("key_used", "row_identifier", "status")


@query
def results_page_deep(spark, sf_dir):
    path = shared_path(spark, "pages")
    results = _results(spark, sf_dir)
    store_pages(results, path)
    rows = spark.read.parquet(f"{path}/index").agg(F.sum("rows")).head()[0]
    return stored_page(spark, path, 100, rows - 150).select("key_used", "row_identifier", "status", "group_name", "difference")


@query
def purge_applied(spark, sf_dir):
    results, runs, configs = _history(spark, sf_dir)
    paths = [shared_path(spark, n) for n in ("results", "runs", "configs")]
    # many small runs: blocks of them, each written by few tasks
    results.withColumn("run_block", run_block()).hint("rebalance", "run_block").write.partitionBy("run_block").parquet(paths[0])
    runs.withColumn("run_block", run_block()).hint("rebalance", "run_block").write.partitionBy("run_block").parquet(paths[1])
    configs.write.parquet(paths[2])
    purge_dataset(spark, 3, *paths, folders="run_block")
    left = spark.read.parquet(paths[0])
    return left.select(F.col("run_id").cast("bigint").alias("run_id"), "dataset_id", "row_identifier", "difference")


@query
def preprocess_run_record(spark, sf_dir):
    runs = shared_path(spark, "preprocess_runs")
    stored = shared_path(spark, "prepared")
    run_base_b(spark, messy(spark, sf_dir), "b", CANCEL_S, 1, 5, stored, runs, ordinal="k")
    run_generic(spark, text_journal(spark, sf_dir), 2, 6, shared_path(spark, "prepared"), runs, "acct_a", "acct_b", "v", _TEXT_JOURNAL_TYPES)
    kept = spark.read.parquet(stored).agg(F.count("*").alias("stored_rows"))
    return spark.read.parquet(runs).select(
        F.col("run_id").cast("bigint").alias("run_id"), "dataset_id", "status", "summary.rows", "summary.columns", "summary.total_rows",
        "summary.canceled_rows", "summary.active_rows", "summary.reversals_count").crossJoin(F.broadcast(kept))


@query
def reversal_run_rows(spark, sf_dir):
    results, runs = shared_path(spark, "results"), shared_path(spark, "runs")
    rows = fill_nulls(text_journal(spark, sf_dir), _TEXT_JOURNAL_TYPES)
    configs = [TEXT_PAIRS, ReversalConfig("acct_a", "gone", "v"), ReversalConfig("acct_a", "ind", "v")]
    persist_reversal_runs(spark, rows, configs, 41, 2, results, runs)
    run, found = run_with_results(spark.read.parquet(runs), spark.read.parquet(results), 41)
    tally = found.groupBy(F.col("run_id").cast("bigint").alias("run_id"), "dataset_id", "status").agg(F.count("*").alias("rows"))
    return tally.join(run.select(F.col("run_id").cast("bigint").alias("run_id"), F.col("status").alias("run_status"), "config_id"), "run_id")


@query
def reload_promoted(spark, sf_dir):
    path = _with_preamble(spark, sf_dir, ["Relatorio de pedidos,,", ",emitido,hoje", ",pedido,cliente,situacao,valor,data,data,"], ",")
    stored = shared_path(spark, "ledger")
    # stored as it is, as text under plain names; the header is promoted on reload
    read_rows(spark, SourceSpec(path, "csv"), 7, "row_index").write.parquet(stored)
    return promote_header(spark.read.parquet(stored), 3, "B")


@query
def preprocessed_export(spark, sf_dir):
    stored, out = shared_path(spark, "prepared"), shared_path(spark, "export")
    write_prepared(mark_canceled(text_journal(spark, sf_dir), CANCEL_S), stored)
    export_prepared(spark, stored, out, "parquet")
    return spark.read.parquet(out)


@query
def side_totals_nested(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "map<string,bigint>").alias("props"))
    return side_totals(events, ["event_type"], "props")


@query
def side_totals_duplicates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("n_1"), "l_returnflag")
    return side_totals(rows, ["l_orderkey"], ["n", "n_1", "l_returnflag"])
