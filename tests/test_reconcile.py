"""Totals, verdicts, runs and write-back."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ledgerrecon.config import KeyDef, ReconConfig
from ledgerrecon.labels import CANCELED_FLAG, REVERSAL_FLAG
from ledgerrecon.operators.enrich import attach_results, enrich, merge_results
from ledgerrecon.operators.results import (
    append_results, filter_results, page, page_after, present, present_headers, purge, result_rows, run_with_results,
    total_rows,
)
from ledgerrecon.operators.totals import group_breakdown, missing_keys, run_summary, side_totals, status_breakdown
from ledgerrecon.plans.reconcile import persist_run, reconcile, run_and_enrich
from ledgerrecon.session import shared_path

ONE = ReconConfig(keys=(KeyDef("id", ("ida",), ("idb",)),), value_column_a="va", value_column_b="vb",
                  id=3, name="teste", base_a_id=1, base_b_id=2)
TWO = replace(ONE, keys=(KeyDef("id", ("ida",), ("idb",)), KeyDef("tipo", ("ta", "year"), ("tb", "year"))))


def small(spark):
    a = spark.createDataFrame([("K1", 100), ("K2", 50)], "ida string, va int")
    b = spark.createDataFrame([("K1", 100), ("K3", 20)], "idb string, vb int")
    return a, b


def statuses(df):
    return {r["key"]: r["status"] for r in df.collect()}


def ledgers(spark, seed=1, n=300):
    """Two ledgers where one key holds a third of the rows of both."""
    rng = random.Random(seed)
    key = lambda: "hot" if rng.random() < 0.33 else f"k{rng.randrange(40)}"
    kind = lambda: rng.choice(["x", "y", None])
    rows = lambda: [(i, key(), kind(), rng.randrange(2020, 2023), rng.randint(-500, 500) / 100,
                     rng.choice([True, False, None])) for i in range(n)]
    a = spark.createDataFrame(rows(), f"row_index long, ida string, ta string, year int, va double, {CANCELED_FLAG} boolean")
    b = spark.createDataFrame(rows(), f"row_index long, idb string, tb string, year int, vb double, {REVERSAL_FLAG} boolean")
    return a, b


def brute(a, b, flag_a, flag_b, columns_a, columns_b, threshold):
    cents = {}
    for side, (df, flag, cols, v) in enumerate(((a, flag_a, columns_a, "va"), (b, flag_b, columns_b, "vb"))):
        for r in df.collect():
            if not r[flag]:
                k = "|".join("" if r[c] is None else str(r[c]) for c in cols)
                cents.setdefault(k, [0, 0])[side] += round(r[v] * 100)
    out = {}
    for k, (x, y) in cents.items():
        out[k] = ("Ambos zero" if x == y == 0 else "Conferem" if abs(x - y) <= threshold * 100
                  else "Apenas B" if x == 0 else "Apenas A" if y == 0 else "Divergência")
    return out


def test_small_run(spark):
    a, b = small(spark)
    assert statuses(reconcile(a, b, ONE)) == {"K1": "Conferem", "K2": "Apenas A", "K3": "Apenas B"}


@pytest.mark.parametrize("threshold", [0.0, 3.0])
def test_two_keys_match_brute_force(spark, threshold):
    a, b = ledgers(spark)
    got = reconcile(a, b, replace(TWO, threshold=threshold))
    for name, ca, cb in (("id", ["ida"], ["idb"]), ("tipo", ["ta", "year"], ["tb", "year"])):
        want = brute(a, b, CANCELED_FLAG, REVERSAL_FLAG, ca, cb, threshold)
        assert statuses(got.where(F.col("key_name") == name)) == want


def test_same_result_for_any_partitioning(spark):
    a, b = ledgers(spark, seed=2)
    one = reconcile(a.repartition(1), b.repartition(1), TWO).orderBy("key_ordinal", "key").collect()
    many = reconcile(a.repartition(7), b.repartition(5), TWO).orderBy("key_ordinal", "key").collect()
    assert one == many


def test_counts_add_up(spark):
    a, b = ledgers(spark, seed=3)
    recon = reconcile(a, b, TWO)
    summary = run_summary(recon).head()
    assert summary["keys_evaluated"] == recon.count() == summary["matched_keys"] + summary["unmatched_keys"]
    tally = status_breakdown(recon).collect()
    assert sum(r["keys"] for r in tally) == summary["keys_evaluated"] and len(tally) == 5
    groups = {r["value"]: r["keys"] for r in group_breakdown(recon).collect()}
    assert groups["Conciliados"] == summary["matched_keys"]


def test_one_exchange_for_any_number_of_keys(spark):
    a, b = ledgers(spark)
    for config in (ONE, TWO):
        plan = reconcile(a, b, config)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_whole_number_keys_meet_text_keys(spark):
    a = spark.createDataFrame([(1, 2.0), (None, 3.0)], "ida long, va double")
    as_text = spark.createDataFrame([("1", 2.0), (None, 1.0)], "idb string, vb double")
    as_int = spark.createDataFrame([(1, 2.0), (None, 1.0)], "idb int, vb double")
    as_double = spark.createDataFrame([(1.0, 2.0), (None, 1.0)], "idb double, vb double")
    for b in (as_text, as_int, as_double):
        assert statuses(reconcile(a, b, ONE)) == {"1": "Conferem", "": "Divergência"}


def test_invert_and_sides(spark):
    a, b = small(spark)
    inverted = reconcile(a, b.withColumn("vb", -F.col("vb")), replace(ONE, invert_b=True))
    assert statuses(inverted) == {"K1": "Conferem", "K2": "Apenas A", "K3": "Apenas B"}
    assert statuses(reconcile(a, b, replace(ONE, value_column_b=None))) == {"K1": "Apenas A", "K2": "Apenas A"}
    assert statuses(reconcile(a, None, ONE)) == {"K1": "Apenas A", "K2": "Apenas A"}
    no_value = replace(ONE, value_column_a=None, value_column_b=None)
    assert reconcile(a, b, no_value).count() == 0
    assert set(statuses(reconcile(a, b, replace(no_value, allow_no_value=True))).values()) == {"Ambos zero"}
    with pytest.raises(KeyError):
        reconcile(a, b, replace(ONE, value_column_a="zzz"))
    with pytest.raises(ValueError):
        ReconConfig(keys=(KeyDef("x"), KeyDef("x")))


def test_float_noise_does_not_decide(spark):
    a = spark.createDataFrame([("k", 0.1)] * 3, "ida string, va double")
    b = spark.createDataFrame([("k", 0.3)], "idb string, vb double")
    assert statuses(reconcile(a.repartition(3), b, ONE)) == {"k": "Conferem"}
    zero = spark.createDataFrame([("k", 0.1), ("k", 0.2), ("k", -0.3), ("k", float("nan"))], "ida string, va double")
    assert statuses(reconcile(zero, None, ONE)) == {"k": "Ambos zero"}


def test_side_totals(spark):
    df = spark.createDataFrame([("A", 10), ("B", 5), ("A", 2)], "key string, amt int")
    assert {r["key"]: r["total"] for r in side_totals(df, ["key"], "amt").collect()} == {"A": 12.0, "B": 5.0}
    assert side_totals(df, [], "amt").collect()[0]["key"] == ""
    with pytest.raises(KeyError):
        side_totals(df, ["key"], "gone")


def test_missing_keys(spark):
    a = spark.createDataFrame([("k1",), ("k2",), ("k1",)], "k string")
    b = spark.createDataFrame([("k2",), ("k3",)], "k string")
    assert {tuple(r) for r in missing_keys(a, ["k"], b, ["k"]).collect()} == {("k1", "a"), ("k3", "b")}


def test_enrich_first_and_last(spark):
    a, b = ledgers(spark, seed=4)
    results = result_rows(reconcile(a, b, TWO), 1).cache()
    by_key = {(r["key_used"], r["row_identifier"]): r for r in results.collect()}
    first = enrich(a, results, TWO, "a").collect()
    last = merge_results(a, results, TWO, "a").collect()
    assert len(first) == len(last) == a.count()
    for r in first:
        hit = by_key.get(("id", r["ida"])) or by_key.get(("tipo", f"{r['ta'] or ''}|{r['year']}"))
        assert (r["status"], r["group_name"], r["key_used"]) == (
            (hit["status"], hit["group_name"], hit["key_used"]) if hit else (None, None, None))
    for r in last:
        hit = by_key.get(("tipo", f"{r['ta'] or ''}|{r['year']}")) or by_key.get(("id", r["ida"]))
        assert (r["recon_key_name"], r["recon_status"], r["recon_difference"]) == (
            (hit["key_used"], hit["status"], hit["difference"]) if hit else (None, None, None))


def test_enrich_other_ledger_uses_both_column_lists(spark):
    config = replace(ONE, keys=(KeyDef("id", ("x",), ("y",)), KeyDef("none")))
    results = spark.createDataFrame(
        [(1, None, "p|q", "Conferem", "Conciliados", "id", 0.0, 0)],
        "run_id long, dataset_id long, row_identifier string, status string, group_name string, key_used string, "
        "difference double, key_ordinal int")
    rows = spark.createDataFrame([("p", "q"), ("p", "z")], "x string, y string")
    got = sorted(tuple(r) for r in enrich(rows, results, config, config.side_of(9)).select("x", "y", "status", CANCELED_FLAG).collect())
    assert got == [("p", "q", "Conferem", None), ("p", "z", None, None)]


def test_hot_key_is_split_when_writing_back(spark):
    """The join that writes verdicts back is one adaptive execution can split."""
    a, b = ledgers(spark, seed=5, n=20000)
    results_path, runs_path = shared_path(spark, "results"), shared_path(spark, "runs")
    stored = persist_run(spark, reconcile(a, b, ONE), ONE, 1, results_path, runs_path)
    saved = {k: spark.conf.get(k, None) for k in (
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "20KB")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20KB")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.2")
        rows = enrich(a.repartition(8), stored, ONE, "a")
        assert len(rows.collect()) == 20000
        assert "skew" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        for k, v in saved.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_attach(spark):
    rows = spark.createDataFrame([("k1", 1), ("k2", 2), ("k3", 3)], "k string, v int")
    found = spark.createDataFrame([("k1", "Conferem", "Conciliados", 0.0), ("k3", "Apenas A", None, None)],
                                  "key string, status string, group string, difference double")
    got = {r["k"]: (r["status"], r["group"], r["difference"]) for r in attach_results(rows, found, "k").collect()}
    assert got == {"k1": ("Conferem", "Conciliados", 0.0), "k2": (None, None, None), "k3": ("Apenas A", None, None)}
    only_status = attach_results(rows, found.select("key", "status"), "k", status_col="s", group_col="g", diff_col="d")
    assert only_status.columns == ["k", "v", "s", "g", "d"]
    with pytest.raises(KeyError):
        attach_results(rows, found, "gone")


def test_runs_are_kept_and_can_be_repeated(spark, tmp_path):
    a, b = small(spark)
    paths = str(tmp_path / "results"), str(tmp_path / "runs")
    for run_id in (1, 2, 2):
        persist_run(spark, reconcile(a, b, ONE), ONE, run_id, *paths)
    results, runs = spark.read.parquet(paths[0]), spark.read.parquet(paths[1])
    assert sorted((r["run_id"], r["count"]) for r in results.groupBy("run_id").count().collect()) == [(1, 3), (2, 3)]
    run, found = run_with_results(runs, results, 2)
    assert run.head()["summary"]["matched_keys"] == 1 and run.head()["status"] == "completed" and found.count() == 3
    with pytest.raises(LookupError):
        run_with_results(runs, results, 99)


def test_run_and_enrich(spark, tmp_path):
    a, b = small(spark)
    sides = run_and_enrich(spark, a, b, ONE, 1, str(tmp_path / "results"), str(tmp_path / "runs"))
    assert {r["ida"]: r["status"] for r in sides["a"].collect()} == {"K1": "Conferem", "K2": "Apenas A"}
    assert {r["idb"]: r["status"] for r in sides["b"].collect()} == {"K1": "Conferem", "K3": "Apenas B"}


def test_pages_cover_all_results(spark):
    a, b = ledgers(spark, seed=6)
    results = result_rows(reconcile(a, b, TWO), 1).cache()
    everything = [tuple(r) for r in results.orderBy("run_id", "key_ordinal", "row_identifier").collect()]
    by_offset, by_key, last = [], [], (0, 0, "")
    for n in range(0, len(everything), 20):
        by_offset += [tuple(r) for r in page(results, 20, n).collect()]
        rows = page_after(results, last, 20).collect()
        by_key += [tuple(r) for r in rows]
        last = tuple(rows[-1][c] for c in ("run_id", "key_ordinal", "row_identifier"))
    assert by_offset == by_key == everything
    filtered = filter_results(results, run_id=1, status="Divergência", key_used="id", group_name="Não conciliados")
    assert total_rows(filtered).head()[0] == sum(r[3] == "Divergência" and r[5] == "id" for r in everything)


def test_present_and_purge(spark):
    results = spark.createDataFrame(
        [(1, 5, "k", "mismatch", None, None), (2, None, "k", "Conferem", "Conciliados", "id"), (3, None, "k", "x", "g", "n")],
        "run_id long, dataset_id long, row_identifier string, status string, group_name string, key_used string")
    got = [(r["status"], r["group_name"], r["key_used"]) for r in present(results).orderBy("run_id").collect()]
    assert got == [("Divergência", "", ""), ("Conferem", "Conciliados", "id"), ("x", "g", "n")]
    runs = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "run_id long, config_id long")
    configs = spark.createDataFrame([(10, 1, 2), (20, 3, 5), (30, 1, 3)], "config_id long, base_a_id long, base_b_id long")
    left = purge(results, runs, configs, 5)
    assert [r["run_id"] for r in left["results"].collect()] == [3]
    assert sorted(r["run_id"] for r in left["runs"].collect()) == [1, 3]
    assert sorted(r["config_id"] for r in left["configs"].collect()) == [10, 30]
    flags = spark.createDataFrame([(True, "x")], f"{CANCELED_FLAG} boolean, other string")
    assert present_headers(flags).columns == ["Cancelado", "other"]


def test_value_column_by_logical_name(spark):
    a, b = small(spark)
    config = replace(ONE, value_column_a="Valor da nota")
    got = reconcile(a, b, config, catalog_a=[("ida", "Nota"), ("va", "valor da nota")])
    assert statuses(got) == {"K1": "Conferem", "K2": "Apenas A", "K3": "Apenas B"}


def test_records_under_other_names(spark, tmp_path):
    path = str(tmp_path / "results")
    records = spark.createDataFrame([("k1", "Conferem", "Conciliados", "id", 0.0)],
                                    "key string, status string, group string, key_name string, difference double")
    append_results(records, 5, path)
    other = records.toDF("row_identifier", "status", "group_name", "key_used", "difference").withColumn("dataset_id", F.lit(8))
    append_results(other, 5, path)
    got = [(r["run_id"], r["row_identifier"], r["dataset_id"], r["key_used"]) for r in spark.read.parquet(path).collect()]
    assert sorted(got, key=str) == [(5, "k1", 8, "id"), (5, "k1", None, "id")]
