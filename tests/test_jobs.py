"""Jobs that keep, page, export and delete: what they leave behind, also when they die."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerrecon.config import CancellationConfig, KeyDef, ReconConfig, ReversalConfig
from ledgerrecon.labels import REVERSAL_FLAG
from ledgerrecon.operators.enrich import enrich, merge_results
from ledgerrecon.operators.results import page, run_with_results, store_pages, stored_page
from ledgerrecon.operators.reversals import mark_all_reversals, mark_reversals
from ledgerrecon.plans import purge as purging
from ledgerrecon.plans.preprocess import persist_reversal_runs, run_base_b, run_generic
from ledgerrecon.plans.purge import finish_purges, purge_dataset
from ledgerrecon.sources.sinks import export_ledger, export_prepared, export_run, in_file_order


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan_of(df).split("Initial Plan")[0]


RESULTS = "run_id long, dataset_id long, row_identifier string, status string, group_name string, key_used string, difference double, key_ordinal int"


# --- write-back -------------------------------------------------------------

@pytest.fixture(scope="module")
def ledger(spark):
    return spark.range(2000).select(F.col("id").alias("row_index"), *[(F.col("id") % n).alias(f"c{n}") for n in (7, 50, 400, 3)])


def verdicts(spark, keys):
    rows = [(1, None, str(v), f"s{name}", "g", name, float(v), 0) for name, values in keys.items() for v in values]
    return spark.createDataFrame(rows, RESULTS)


def config(*columns):
    return ReconConfig(tuple(KeyDef(c, (c,), (c,)) for c in columns), id=1)


@pytest.mark.parametrize("columns", [("c7", "c50", "c400"), ("c400", "c7", "c50", "c3")])
def test_one_exchange_gives_what_one_join_per_key_gives(spark, ledger, columns):
    results = verdicts(spark, {"c7": [1, 2], "c50": range(0, 50, 3), "c400": range(0, 400, 7), "c3": [0]})
    for write_back in (enrich, merge_results):
        by_ordinal = write_back(ledger, results, config(*columns), "a")
        by_join = write_back(ledger, results, config(*columns), "a", ordinal="no such column")
        assert sorted(map(str, by_ordinal.collect())) == sorted(map(str, by_join.collect()))


def test_exchanges_do_not_grow_with_the_keys(spark, ledger, tmp_path):
    ledger.write.parquet(str(tmp_path / "ledger"))
    verdicts(spark, {"c7": [1], "c50": [2], "c400": [3], "c3": [0]}).write.parquet(str(tmp_path / "results"))
    rows, results = spark.read.parquet(str(tmp_path / "ledger")), spark.read.parquet(str(tmp_path / "results"))
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = {n: len(re.findall(r"\bExchange hashpartitioning", plan_of(enrich(rows, results, config(*("c7", "c50", "c400", "c3")[:n]), "a"))))
                  for n in (3, 4)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)
    assert len(set(counts.values())) == 1, counts


# --- reversals --------------------------------------------------------------

CONFIGS = [ReversalConfig("a", "b", "v"), ReversalConfig("a", "c", "v"), ReversalConfig("b", "c", "w"), ReversalConfig("c", "a", "w")]


def accounts(spark, n=400):
    return spark.range(n).select(
        F.col("id").alias("row_index"), (F.col("id") % 5).alias("a"), (F.col("id") % 7).cast("string").alias("b"),
        F.when(F.col("id") % 11 != 0, F.col("id") % 4).alias("c"), ((F.col("id") % 9) - 4).cast("double").alias("v"),
        ((F.col("id") % 3) - 1).cast("decimal(9,2)").alias("w"))


@pytest.mark.parametrize("hot", [{}, dict(hot_rows=3, slab_rows=16)])
def test_configs_in_one_pass_find_what_each_finds(spark, hot):
    df = accounts(spark)
    configs = [*CONFIGS, ReversalConfig("a", "b", "v", tolerance=0.5), ReversalConfig("a", "b", "v", mode="one_to_one")]
    want = set()
    for c in configs:
        want |= {r["row_index"] for r in mark_reversals(df, c).where(f"`{REVERSAL_FLAG}`").collect()}
    got = mark_all_reversals(df, configs, **hot)
    assert {r["row_index"] for r in got.where(f"`{REVERSAL_FLAG}`").collect()} == want and got.count() == 400


def test_scans_do_not_grow_with_the_configs(spark, tmp_path):
    accounts(spark).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    scans = {n: plan_of(mark_all_reversals(rows, CONFIGS[:n])).split("Initial Plan")[0].count("FileScan") for n in (2, 4)}
    assert scans[2] == scans[4]


def test_reversal_runs_can_be_looked_up_and_run_again(spark, tmp_path):
    results, runs = str(tmp_path / "results"), str(tmp_path / "runs")
    configs = [CONFIGS[0], ReversalConfig("a", "gone", "v"), ReversalConfig("a", "a", "row_index")]
    for _ in range(2):
        persist_reversal_runs(spark, accounts(spark), configs, 5, 9, results, runs)
    kept = spark.read.parquet(runs)
    assert sorted(r["run_id"] for r in kept.collect()) == [5, 7]
    run, found = run_with_results(kept, spark.read.parquet(results), 5)
    marked = mark_reversals(accounts(spark), CONFIGS[0]).where(f"`{REVERSAL_FLAG}`")
    assert {r["row_identifier"] for r in found.collect()} == {str(r["row_index"]) for r in marked.collect()} and found.count() == marked.count()
    assert run.head()["status"] == "completed" and run.head()["summary"] is None
    assert export_run(kept, spark.read.parquet(results), 5, str(tmp_path / "report"))["rows"] == found.count()
    with pytest.raises(LookupError):
        run_with_results(kept, spark.read.parquet(results), 6)


# --- preprocessing runs -----------------------------------------------------

def test_run_records(spark, tmp_path):
    df = spark.createDataFrame([(1, "S", 5.0), (2, None, None), (3, "N", 1.0)], "row_index long, ind string, v double")
    runs = str(tmp_path / "runs")
    record = run_base_b(spark, df, "B", CancellationConfig("ind", "S"), 1, 4, str(tmp_path / "b"), runs,
                        [("row_index", None), ("ind", "Situação"), ("v", None), ("f", None)]).head()
    assert (record["summary"]["total_rows"], record["summary"]["canceled_rows"], record["summary"]["active_rows"]) == (3, 1, 2)
    assert spark.read.parquet(record["summary"]["storage_path"]).columns[1] == "Situação"
    record = run_generic(spark, df, 2, 4, str(tmp_path / "g"), runs).head()
    assert (record["summary"]["rows"], record["summary"]["columns"], record["summary"]["reversals_count"]) == (3, 4, 0)
    assert sorted((r["run_id"], r["dataset_id"], r["status"]) for r in spark.read.parquet(runs).collect()) == [(1, 4, "completed"), (2, 4, "completed")]
    with pytest.raises(ValueError):
        run_base_b(spark, df, "A", CancellationConfig("ind", "S"), 3, 4, str(tmp_path / "x"), runs)


def test_prepared_export(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("row_index"), F.col("id").alias("v"), F.lit(False).alias(REVERSAL_FLAG))
    df.repartition(5).write.parquet(str(tmp_path / "pre"))
    done = export_prepared(spark, str(tmp_path / "pre"), str(tmp_path / "out"), "parquet")
    assert done["rows"] == 50 and done["columns"] == ["v", "Estorno"]
    with pytest.raises(FileNotFoundError):
        export_prepared(spark, str(tmp_path / "none"), str(tmp_path / "out2"))


@pytest.mark.parametrize("ids", [range(1, 301), [0, 5, 10**12, None, -3]])
def test_export_in_order_without_sampling(spark, tmp_path, ids):
    df = spark.createDataFrame([(i,) for i in ids], "row_index long").withColumn("v", F.col("row_index")).repartition(6)
    assert "rangepartitioning" not in plan_of(in_file_order(df))
    export_ledger(df, str(tmp_path / "out"), "parquet")
    files = sorted((tmp_path / "out").glob("*.parquet"))
    seen = [r["v"] for f in files for r in spark.read.parquet(str(f)).collect()]
    assert seen == sorted(ids, key=lambda x: (x is not None, x or 0))


# --- pages ------------------------------------------------------------------

def result_table(spark, n=1000):
    return spark.range(n).select(
        F.lit(1).cast("long").alias("run_id"), (F.col("id") % 2).cast("int").alias("key_ordinal"), F.col("id").cast("string").alias("row_identifier"),
        F.when(F.col("id") % 3 == 0, "x").alias("status"))


def test_stored_pages_equal_pages_and_open_few_files(spark, tmp_path):
    results, path = result_table(spark), str(tmp_path / "pages")
    saved = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store_pages(results, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", saved)
    assert len(list((tmp_path / "pages" / "rows").glob("*.parquet"))) > 2
    for offset, limit in ((0, 10), (480, 60), (930, 20), (990, 50), (1000, 5)):
        got = stored_page(spark, path, limit, offset)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, page(results, limit, offset).collect())), offset
        assert len(got.inputFiles()) <= 2


# --- purge ------------------------------------------------------------------

def stored_tables(spark, folder):
    paths = [str(folder / n) for n in ("results", "runs", "configs")]
    rows = [(run, dataset, f"k{run}-{dataset}") for run in range(1, 7) for dataset in (3, 8, None)] + [(7, 3, "only")]
    spark.createDataFrame(rows, "run_id long, dataset_id long, row_identifier string").write.partitionBy("run_id").parquet(paths[0])
    spark.createDataFrame([(run, run % 3) for run in range(1, 8)], "run_id long, config_id long").write.partitionBy("run_id").parquet(paths[1])
    spark.createDataFrame([(0, 3, 1), (1, 1, 2), (2, 4, 5)], "config_id long, base_a_id long, base_b_id long").write.parquet(paths[2])
    return paths


def contents(spark, paths):
    return [sorted(map(str, spark.read.parquet(p).select("*").collect())) for p in paths]


def test_purge_deletes(spark, tmp_path):
    paths = stored_tables(spark, tmp_path)
    before = {p.name for p in (tmp_path / "results" / "run_id=5").iterdir()}
    done = purge_dataset(spark, 3, *paths)
    assert done == {"configs": 1, "runs": 2, "rewritten": 5}
    left = {(r["run_id"], r["dataset_id"]) for r in spark.read.parquet(paths[0]).collect()}
    assert left == {(run, d) for run in (1, 2, 4, 5) for d in (8, None)}
    assert sorted(r["run_id"] for r in spark.read.parquet(paths[1]).collect()) == [1, 2, 4, 5, 7]
    assert sorted(r["config_id"] for r in spark.read.parquet(paths[2]).collect()) == [1, 2]
    assert not list((tmp_path / "results").glob("_purge*")) and before
    assert purge_dataset(spark, 3, *paths) == {"configs": 0, "runs": 0, "rewritten": 0}


def test_purge_in_blocks_of_runs(spark, tmp_path):
    old, paths = stored_tables(spark, tmp_path / "runs"), [str(tmp_path / "blocks" / n) for n in ("results", "runs", "configs")]
    for source, target in zip(old[:2], paths):
        rows = spark.read.parquet(source)
        if source == old[0]:
            rows = rows.unionByName(spark.createDataFrame([(None, 3, "no run")], "run_id long, dataset_id long, row_identifier string"))
        rows.withColumn("run_block", purging.run_block(3)).write.partitionBy("run_block").parquet(target)
    spark.read.parquet(old[2]).write.parquet(paths[2])
    assert len(list((tmp_path / "blocks" / "results").glob("run_block=*"))) <= 3
    assert purge_dataset(spark, 3, *paths, folders="run_block")["runs"] == 2
    left = sorted((r["run_id"] or 0, r["dataset_id"] or 0) for r in spark.read.parquet(paths[0]).collect())
    assert left == sorted([(0, 3)] + [(run, d) for run in (1, 2, 4, 5) for d in (8, 0)])  # what has no run stays
    assert sorted(r["run_id"] for r in spark.read.parquet(paths[1]).collect()) == [1, 2, 4, 5, 7]
    assert sorted(r["config_id"] for r in spark.read.parquet(paths[2]).collect()) == [1, 2]
    assert purge_dataset(spark, 3, *paths, folders="run_block") == {"configs": 0, "runs": 0, "rewritten": 0}


def test_purge_that_dies_leaves_the_old_state_or_is_finished(spark, tmp_path, monkeypatch):
    paths = stored_tables(spark, tmp_path)
    old = contents(spark, paths)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # before anything is decided
        m.setattr(purging._Store, "write", dies)
        with pytest.raises(KeyboardInterrupt):
            purge_dataset(spark, 3, *paths)
    assert contents(spark, paths) == old
    assert finish_purges(spark, paths[0]) == 0 and not list((tmp_path / "results").glob("_purge*"))

    moves = []
    rename = purging._Store.rename
    with monkeypatch.context() as m:  # half way through putting folders in place
        def third(self, source, target):
            moves.append(target)
            if len(moves) == 3:
                raise KeyboardInterrupt
            rename(self, source, target)

        m.setattr(purging._Store, "rename", third)
        with pytest.raises(KeyboardInterrupt):
            purge_dataset(spark, 3, *paths)
    assert finish_purges(spark, paths[0]) == 1
    left = {(r["run_id"], r["dataset_id"]) for r in spark.read.parquet(paths[0]).collect()}
    assert left == {(run, d) for run in (1, 2, 4, 5) for d in (8, None)}
    assert sorted(r["config_id"] for r in spark.read.parquet(paths[2]).collect()) == [1, 2]
