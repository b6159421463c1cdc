"""Files in, typed numbered frames out; headers; catalog; exports."""

import pytest
from pyspark.sql import functions as F

from ledgerrecon.config import SourceSpec
from ledgerrecon.labels import REVERSAL_FLAG
from ledgerrecon.session import shared_dir, shared_path
from ledgerrecon.sources.catalog import (
    apply_headers, column_profile, infer_column_types, logical_headers, mapped_columns, resolve_column,
)
from ledgerrecon.sources.headers import (
    column_position, detect_header, header_names, promote_header, sanitized_names, unique_names,
)
from ledgerrecon.sources.readers import ingest, preview, read_source
from ledgerrecon.sources.sinks import export_ledger, export_run, write_prepared


def csv_file(tmp_path, text, name="in.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_upload_csv(spark, tmp_path):
    spec = SourceSpec(csv_file(tmp_path, "a,b,c\n1,2,3\n"))
    df = read_source(spark, spec, ordinal="row_index")
    assert df.dtypes == [("row_index", "bigint"), ("a", "bigint"), ("b", "bigint"), ("c", "bigint")]
    assert rows(df) == [(1, 1, 2, 3)]


def test_types_missing_cells_and_quotes(spark, tmp_path):
    text = ('id,valor,nome,ok,chave,vazio\n'
            '1,1.5,"a, ""b""",True,12345678901234567890123456789012345678901234,\n'
            '2,NA,null,False,12345678901234567890123456789012345678901235,N/A\n'
            '3,-2e3, x ,,12345678901234567890123456789012345678901236,\n')
    df = read_source(spark, SourceSpec(csv_file(tmp_path, text), "TXT"), ordinal="row_index").orderBy("row_index")
    assert dict(df.dtypes) == {"row_index": "bigint", "id": "bigint", "valor": "double", "nome": "string",
                               "ok": "string", "chave": "string", "vazio": "double"}
    assert rows(df.select("id", "valor", "nome", "ok", "vazio")) == [
        (1, 1.5, 'a, "b"', "True", None), (2, None, None, "False", None), (3, -2000.0, " x ", None, None)]
    df = read_source(spark, SourceSpec(csv_file(tmp_path, "ok,n\nTrue,1\nfalse,2\n", "full.csv")))
    assert df.dtypes == [("ok", "boolean"), ("n", "bigint")]


def test_duplicate_names_and_errors(spark, tmp_path):
    df = read_source(spark, SourceSpec(csv_file(tmp_path, "a,a,a_1\n1,2,3\n")))
    assert df.columns == ["a", "a_1", "a_1_1"]
    with pytest.raises(ValueError):
        read_source(spark, SourceSpec("x", "xlsx"))
    with pytest.raises(ValueError):
        read_source(spark, SourceSpec("x", "pdf"))
    with pytest.raises(Exception):
        read_source(spark, SourceSpec(str(tmp_path / "gone.csv")))


def test_header_at_coordinates(spark, tmp_path):
    text = "Relatorio,,,\n,gerado,hoje,\n,id,valor,id,\n,1,2.5,x,\n,2,3.5,y,\n"
    spec = SourceSpec(csv_file(tmp_path, text), header_row=3, header_col="B")
    df = read_source(spark, spec, ordinal="row_index").orderBy("row_index")
    assert df.columns == ["row_index", "id", "valor", "id_1"]
    assert rows(df) == [(1, 1, 2.5, "x"), (2, 2, 3.5, "y")]
    with pytest.raises(IndexError):
        read_source(spark, SourceSpec(spec.path, header_row=50))
    with pytest.raises(ValueError):
        read_source(spark, SourceSpec(spec.path, header_row=3, header_col="F"))


def test_header_detected(spark, tmp_path):
    text = ",,\nresumo,,\nid,valor,nome\n1,2,x\n2,3,y\n"
    df = read_source(spark, SourceSpec(csv_file(tmp_path, text)), ordinal="n").orderBy("n")
    assert df.columns == ["n", "id", "valor", "nome"]
    assert rows(df) == [(1, 1, 2, "x"), (2, 2, 3, "y")]


def test_blank_names_without_a_header_row(spark, tmp_path):
    wide = ",".join(["a"] + [""] * 9)
    text = wide + "\n" + ",".join(["1"] + [""] * 9) + "\n"
    df = read_source(spark, SourceSpec(csv_file(tmp_path, text)))
    assert df.columns[:2] == ["a", "column_1"]


def test_header_helpers():
    assert [column_position(c) for c in ("A", "h", "AA", 1, 3, 0, "2", None)] == [0, 7, 26, 0, 2, 0, 1, 0]
    with pytest.raises(ValueError):
        column_position("A-1")
    assert unique_names(["a", "a", "a_1", "b"]) == ["a", "a_1", "a_1_1", "b"]
    assert sanitized_names(["Unnamed: 0", None, " x "]) == ["column_0", "column_1", "x"]
    assert detect_header([["", "a"], ["b", "c"], ["d", "e"]], 2) == 1
    assert detect_header([["", None]], 2) is None
    assert header_names(["", "a", None, "b", " "], "B") == (1, ["a", "column_2", "b"])


def test_promote_header_on_stored_rows(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "id", "v"), (3, "1", "2"), (4, "3", "4")], "row_index long, c0 string, c1 string")
    assert rows(promote_header(df, 2).orderBy("row_index")) == [(1, "1", "2"), (2, "3", "4")]
    assert promote_header(df, 0) is df
    assert promote_header(df, 9, strict=False) is df
    with pytest.raises(IndexError):
        promote_header(df, 9)


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json", "orc"])
def test_row_ordinals_follow_file_order(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    data = spark.range(5000).select("id", F.md5(F.col("id").cast("string")).alias("text"))
    data.repartitionByRange(6, "id").sortWithinPartitions("id").write.option("header", True).format(fmt).save(path)
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8KB")  # many splits per file
    try:
        df = read_source(spark, SourceSpec(path, fmt), ordinal="row_index")
        assert df.where(F.col("row_index") != F.col("id") + 1).isEmpty() and df.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved)


def quoted(i):
    """A cell with line breaks, quotes and blank lines in every third row."""
    return f'x{i}' if i % 3 else f'l"{i}"\n\n{"y" * (i % 50)}\nend, "q"\n' * (i % 4 + 1)


@pytest.mark.parametrize("preamble,ends", [([], "\n"), (["relatorio,", "emitido,hoje"], "\n"), ([], "\r\n")])
def test_quoted_line_breaks_are_read_in_splits(spark, tmp_path, preamble, ends):
    folder, want = tmp_path / "in", []
    folder.mkdir()
    for part in range(3):
        data = [(str(part * 1000 + i), quoted(part * 1000 + i)) for i in range(400)]
        cells = [[f"{k}", '"' + v.replace('"', '""').replace("\n", ends) + '"'] for k, v in data]
        lines = [*preamble, "id,texto", *map(",".join, cells)]
        lines.insert(len(preamble) + 5, " \t")  # a blank line between rows
        (folder / f"p{part}.csv").write_bytes((ends.join(lines) + ends).encode())
        want += [(k, v.replace("\n", ends)) for k, v in data]
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4KB")
    try:
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 8
        spec = SourceSpec(str(folder), header_row=len(preamble) + 1 if preamble else None)
        df = read_source(spark, spec, ordinal="n", typed=False)
        assert [tuple(r) for r in df.orderBy("n").collect()] == [(i + 1, *row) for i, row in enumerate(want)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved)


def test_quoted_line_breaks_with_bare_carriage_returns(spark, tmp_path):
    path = tmp_path / "mac.csv"
    path.write_bytes(b'a,b\r1,"x\ry"\r2,z\r')
    assert rows(read_source(spark, SourceSpec(str(path)), ordinal="n").orderBy("n")) in (
        [(1, 1, "x\ry"), (2, 2, "z")], [(1, 1, "x\ny"), (2, 2, "z")])


def test_wide_quoted_row_raises_and_open_quote_ends_with_the_file(spark, tmp_path):
    path = csv_file(tmp_path, 'a,b\n1,"x\ny",3\n')
    with pytest.raises(Exception, match="more than 2 cells"):
        read_source(spark, SourceSpec(path)).collect()
    path = csv_file(tmp_path, 'a,b\n1,x\n2,"never\nclosed\n', "open.csv")
    assert rows(read_source(spark, SourceSpec(path), typed=False))[0] == ("1", "x")


def test_ingest_and_preview(spark, tmp_path):
    spec = SourceSpec(csv_file(tmp_path, "id,v\n" + "".join(f"{i},{i / 4}\n" for i in range(120))))
    done = ingest(spark, spec, str(tmp_path / "stored"))
    assert (done.rows, done.columns) == (120, ("row_index", "id", "v"))
    stored = spark.read.parquet(done.path)
    assert stored.where("row_index <> id + 1").isEmpty()
    assert preview(stored).count() == 50
    assert ingest(spark, spec, done.path).rows == 120  # replaces what was there


def test_types_and_catalog(spark):
    df = spark.createDataFrame([], "n int, d date, t timestamp_ntz, s string, f boolean, m decimal(5,2)")
    assert infer_column_types(df) == {"n": "number", "d": "date", "t": "date", "s": "string", "f": "number", "m": "number"}
    profile = column_profile(df)
    assert [(r["name"], r["is_value_column"]) for r in profile.orderBy("id").collect()] == [
        ("n", True), ("d", False), ("t", False), ("s", False), ("f", True), ("m", True)]
    assert mapped_columns(profile.withColumn("logical_name", F.when(F.col("id") < 2, F.col("name")))).count() == 2


def test_logical_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert logical_headers([("a", "Conta"), ("b", " ")]) == ["Conta", "b"]
    assert apply_headers(df, [("a", "Conta"), ("b", None)]).columns == ["Conta", "b"]
    assert apply_headers(df, [("a", "Conta")]).columns == ["a", "b"]


def test_resolve_column(spark):
    df = spark.createDataFrame([(1, 2, 3)], "vl_total int, qtd int, Preco int")
    catalog = [("vl_total", "Valor Total"), ("qtd", "quantidade"), ("Preco", None)]
    assert resolve_column(df, "qtd", catalog) == "qtd"
    assert resolve_column(df, " valor total ", catalog) == "vl_total"
    assert resolve_column(df, "PRECO", catalog) == "Preco"
    assert resolve_column(df, "total", catalog) == "vl_total"
    assert resolve_column(df, "nada", catalog) is None
    assert resolve_column(df, None, catalog) is None


def test_prepared_sink_adds_flag(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    write_prepared(df, str(tmp_path / "pre"))
    assert spark.read.parquet(str(tmp_path / "pre")).columns == ["a", "b", REVERSAL_FLAG]
    assert df.columns == ["a", "b"]


def test_export_keeps_order(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") + 1).alias("row_index"), F.col("id").alias("v"), F.lit("x").alias("status")).repartition(7)
    done = export_ledger(df, str(tmp_path / "out"))
    assert done["columns"] == ["v", "Status"]
    back = read_source(spark, SourceSpec(done["path"]), ordinal="n")
    assert back.where("n <> v + 1").isEmpty() and back.count() == 1000


def test_run_export(spark, tmp_path):
    results = spark.createDataFrame([(1, "k", "mismatch", None, "id", 1.0, 0), (2, "z", "Conferem", "g", "id", 0.0, 0)],
                                    "run_id long, row_identifier string, status string, group_name string, key_used string, "
                                    "difference double, key_ordinal int")
    runs = spark.createDataFrame([(1, 4, "completed", "s", "f", ("c", 1, 0, 1))],
                                 "run_id long, config_id long, status string, started_at string, finished_at string, "
                                 "summary struct<config_name:string,keys_evaluated:long,matched_keys:long,unmatched_keys:long>")
    paths = export_run(runs, results, 1, str(tmp_path / "run"), "parquet", translated=True)
    assert spark.read.parquet(paths["summary"]).count() == 1
    assert [r["status"] for r in spark.read.parquet(paths["details"]).collect()] == ["Divergência"]


def test_shared_dir_is_the_sessions_own(spark):
    assert shared_path(spark, "x").startswith(shared_dir(spark))
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (named or spark.sparkContext.getCheckpointDir())
