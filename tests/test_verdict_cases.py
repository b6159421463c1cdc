"""Cases where files, stores or values used to be read wrongly."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerrecon.config import KeyDef, ReconConfig, ReversalConfig, SourceSpec
from ledgerrecon.functions import amount, key_part, truthy
from ledgerrecon.operators.enrich import enrich
from ledgerrecon.operators.results import append_results, page, page_after
from ledgerrecon.operators.reversals import mark_all_reversals, mark_reversals
from ledgerrecon.operators.totals import side_totals
from ledgerrecon.plans.preprocess import preprocess, reversal_run_results
from ledgerrecon.plans.reconcile import persist_run, reconcile
from ledgerrecon.session import shared_dir, shared_path
from ledgerrecon.sources.readers import ingest, read_source
from ledgerrecon.sources.sinks import export_ledger

ONE = ReconConfig(keys=(KeyDef("k", ("id",), ("id",)),), value_column_a="v", value_column_b="v")


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.csv").write_bytes(text.encode())
    return str(folder)


def test_blank_line_above_the_header(spark, tmp_path):
    path = put(tmp_path / "a", f="titulo\n   \nid,valor,nome\n1,2,x\n")
    assert [tuple(r) for r in read_source(spark, SourceSpec(path, "csv", header_row=2), "n").collect()] == [(1, 1, 2, "x")]
    path = put(tmp_path / "b", f=",,\n   \nid,valor,nome\n1,2,x\n")
    found = read_source(spark, SourceSpec(path, "csv"), "n")
    assert found.columns == ["n", "id", "valor", "nome"] and found.count() == 1


def test_row_wider_than_the_header(spark, tmp_path):
    path = put(tmp_path / "a", f="id,valor\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="more than 2 cells"):
        read_source(spark, SourceSpec(path, "csv")).collect()


def test_quoted_line_breaks(spark, tmp_path):
    path = put(tmp_path / "a", f='id,nota,v\n1,"a\nb",2\n2,c,3\n')
    assert [tuple(r) for r in read_source(spark, SourceSpec(path, "csv"), "n").collect()] == [(1, 1, "a\nb", 2), (2, 2, "c", 3)]


def test_preamble_of_every_file(spark, tmp_path):
    path = put(tmp_path / "a", f1="titulo,\nid,valor\n1,2\n3,4\n", f2="titulo,\nid,valor\n5,6\n", f3="7,8\n9,10\n")
    rows = read_source(spark, SourceSpec(path, "csv", header_row=2), "n").orderBy("n").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 2), (2, 3, 4), (3, 5, 6), (4, 7, 8), (5, 9, 10)]


def test_ingest_leaves_no_staging(spark, tmp_path):
    import os

    path = put(tmp_path / "a", f="id,valor\n1,2\n")
    before = set(os.listdir(shared_dir(spark).removeprefix("file://").removeprefix("file:")))
    assert ingest(spark, SourceSpec(path, "csv"), str(tmp_path / "out")).rows == 1
    assert set(os.listdir(shared_dir(spark).removeprefix("file://").removeprefix("file:"))) == before


def test_csv_round_trip(spark, tmp_path):
    cells = [" x ", "  y", 'q"uo"te', "line\nbreak", "a,b", "", None, "plain"]
    df = spark.createDataFrame([(i + 1, c, "end") for i, c in enumerate(cells)], "row_index long, cell string, last string")
    out = export_ledger(df, str(tmp_path / "out"))
    back = read_source(spark, SourceSpec(out["path"], "csv"), "n", typed=False).orderBy("n").collect()
    # an empty cell means "missing" in a ledger file
    assert [r["cell"] for r in back] == [c or None for c in cells]
    raw = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert '"",end' in raw and " x ,end" in raw


def test_nested_and_repeated_value_columns(spark):
    df = spark.createDataFrame([("a", [None, 10.0], 1, "2,5", date(2024, 1, 1)), ("a", [2.0], 3, "x", None)], "k string, v array<double>, n int, t string, d date")
    assert side_totals(df, ["k"], "v").collect()[0]["total"] == 12.0
    assert side_totals(df, ["k"], ["n", "t"]).collect()[0]["total"] == 6.5
    with pytest.raises(TypeError):
        amount(F.col("d"), df.schema["d"].dataType)


def test_empty_run_again(spark, tmp_path):
    full = spark.createDataFrame([(1, 5.0)], "id int, v double")
    paths = (str(tmp_path / "results"), str(tmp_path / "runs"))
    assert persist_run(spark, reconcile(full, full, ONE), ONE, 1, *paths).count() == 1
    assert persist_run(spark, reconcile(full.limit(0), full.limit(0), ONE), ONE, 1, *paths).count() == 0
    runs = spark.read.parquet(paths[1]).collect()
    assert [r["summary"]["keys_evaluated"] for r in runs] == [0]


def test_enrich_takes_one_run(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5.0)], "id int, v double")
    paths = (str(tmp_path / "results"), str(tmp_path / "runs"))
    for run in (1, 2):
        persist_run(spark, reconcile(rows, rows, ONE), ONE, run, *paths)
    assert enrich(rows, spark.read.parquet(paths[0]), ONE, "a", run_id=2).count() == 1


def test_pages_hold_every_record(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 7.0)], "id int, v double")
    paths = (str(tmp_path / "results"), str(tmp_path / "runs"))
    persist_run(spark, reconcile(rows, rows, ONE), ONE, 1, *paths)
    more = spark.createDataFrame([("2", "x", None), ("2", "y", 1.0), ("2", None, None)], "key string, status string, difference double")
    append_results(more, 1, paths[0])
    stored = spark.read.parquet(paths[0])
    seen, got = page(stored, 1).collect(), []
    while seen:
        got += seen
        seen = page_after(stored, got[-1], 1).collect()
    assert len(got) == len({tuple(r) for r in got}) == stored.count() == 6


def test_flags_and_keys(spark):
    df = spark.createDataFrame([(float("nan"), 1e-20), (0.0, 2e-19), (1.0, 0.0), (None, 0.5)], "flag double, key double")
    got = df.select(truthy(F.col("flag"), df.schema["flag"].dataType), key_part(F.col("key"), df.schema["key"].dataType)).collect()
    assert [r[0] for r in got] == [False, False, True, False]
    assert [r[1] for r in got] == ["1.0E-20", "2.0E-19", "0", "0.5"]


def test_many_reversal_configs(spark):
    df = spark.createDataFrame([(1, "a", "b", 5.0, "p", "q"), (2, "b", "a", -5.0, "r", "s"), (3, "x", "y", 5.0, "q", "p"), (4, "x", "y", -5.0, "q", "p")],
                               "row_index long, a string, b string, v double, c string, d string")
    configs = [ReversalConfig("a", "b", "v"), ReversalConfig("c", "d", "v"), ReversalConfig("a", "none", "v")]
    both = {r["row_index"]: r["__is_reversal__"] for r in preprocess(df, reversals=configs).collect()}
    chained = mark_reversals(mark_reversals(df, configs[0]), configs[1])
    assert both == {r["row_index"]: r["__is_reversal__"] for r in chained.collect()} == {1: True, 2: True, 3: False, 4: True}
    scans = [mark_all_reversals(df, [configs[0], configs[1]] * n)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") for n in (1, 2)]
    assert scans[1] - scans[0] <= 4  # two reads for each configuration, not twice as many for each
    assert {r["run_id"] for r in reversal_run_results(df, configs, 5, 1).collect()} == {5, 6}
    assert reversal_run_results(df, [], 5, 1).count() == 0 and reversal_run_results(df, [configs[2]], 5, 1).count() == 0
