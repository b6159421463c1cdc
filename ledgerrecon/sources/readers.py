"""Reading ledger files into typed frames with a stable row ordinal."""

from __future__ import annotations

import csv
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ledgerrecon.config import SourceSpec
from ledgerrecon.functions.refs import ref
from ledgerrecon.labels import HEADER_SCAN_ROWS, MISSING_CELLS, PREVIEW_ROWS, SPREADSHEET_FORMATS, TEXT_FORMATS
from ledgerrecon.session import remove_path, shared_path
from ledgerrecon.sources.catalog import cast_text_columns, infer_text_types
from ledgerrecon.sources.headers import (
    ORDINAL, detect_header, has_blank_names, header_names, sanitized_names, unique_names,
)

_BEYOND = "__beyond__"
STORED_FORMATS = ("parquet", "orc", "json")
BROADCAST_SPLITS = 200_000
BROADCAST_TEXT = 64_000_000


@dataclass(frozen=True)
class Ingested:
    path: str
    rows: int
    columns: tuple[str, ...]


def _format(spec: SourceSpec) -> str:
    fmt = (spec.format or "").strip().lower()
    if fmt in TEXT_FORMATS or fmt in STORED_FORMATS:
        return fmt
    if fmt in SPREADSHEET_FORMATS:
        raise ValueError(f"spreadsheets must be saved as delimited text first: {spec.format}")
    raise ValueError(f"unsupported format: {spec.format}")


# blanks around a cell are part of it
_CSV = dict(sep=",", quote='"', escape='"', mode="PERMISSIVE", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
_PLACE = ("__file__", "__block__", "__seq__")


def _odd_quotes() -> Column:
    """1 for a line with an odd number of quotes: a cell begins or ends its life in other lines."""
    return (F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2


def _spans_lines(spark: SparkSession, spec: SourceSpec) -> bool:
    """Whether some cell holds a line break: a line with an odd number of quotes. Stops at the first one."""
    if spec.multi_line is not None:
        return spec.multi_line
    return not spark.read.text(spec.path).where(_odd_quotes() == 1).isEmpty()


def _placed(df: DataFrame, *columns: Column) -> DataFrame:
    """Rows of a scan with their file, their split of it and an id that counts up inside the split.

    The ids are those of the scan's tasks, and files are dealt to tasks in the same way each time they are
    read, so a table of splits made by one read fits the next.
    """
    return df.select(*columns, F.col("_metadata.file_path").alias("__file__"), F.col("_metadata.file_block_start").alias("__block__"),
                     F.monotonically_increasing_id().alias("__seq__"))


def _kept(spark: SparkSession, df: DataFrame, label: str, staged_paths: list[str] | None) -> DataFrame:
    path = shared_path(spark, label)
    if staged_paths is not None:
        staged_paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _few(splits: DataFrame) -> DataFrame:
    """The table of splits, broadcast if its counted size allows."""
    return F.broadcast(splits) if splits.count() <= BROADCAST_SPLITS else splits


def _quoted_records(spark: SparkSession, spec: SourceSpec, names: list[str], header: bool,
                    staged_paths: list[str] | None) -> DataFrame:
    """Cells of text whose quoted cells hold line breaks, read in splits like any other text.

    Whether a line begins inside a cell is the parity of all quotes before it in the file. Each split
    counts its own; the parities of the splits before it, a running XOR over the table of splits, say how it
    begins. Lines that begin outside start a record; only what of a record lies in later splits moves to it. Blank lines outside of cells do not count, and with ``header`` the first record of each file goes.
    """
    lines = _placed(spark.read.option("lineSep", "\n").text(spec.path), F.col("value"), _odd_quotes().alias("__odd__"))
    parities = _kept(spark, lines.groupBy("__file__", "__block__").agg((F.sum("__odd__") % 2).alias("__odd__")), "parities", staged_paths)
    earlier = Window.partitionBy("__file__").orderBy("__block__").rowsBetween(Window.unboundedPreceding, -1)
    begins = parities.select("__file__", "__block__", (F.coalesce(F.sum("__odd__").over(earlier), F.lit(0)) % 2).alias("__begins__"))
    split = Window.partitionBy("__file__", "__block__").orderBy("__seq__")
    before, so_far = (split.rowsBetween(Window.unboundedPreceding, end) for end in (-1, Window.currentRow))
    inside = (F.col("__begins__") + F.coalesce(F.sum("__odd__").over(before), F.lit(0))) % 2 == 1
    lines = lines.join(_few(begins), ["__file__", "__block__"]).withColumn("__inside__", inside)
    starts = ~F.col("__inside__") & (F.col("value").rlike(r"[^\x00-\x20]"))
    lines = lines.withColumn("__starts__", starts).withColumns({
        "__index__": F.count_if("__starts__").over(so_far),
        "__record__": F.last(F.when(F.col("__starts__"), F.col("__seq__")), ignorenulls=True).over(so_far),
    })
    lines = _kept(spark, lines.drop("__begins__"), "lines", staged_paths)
    # a split may begin with the rest of a record that started in one before it
    ends = lines.groupBy("__file__", "__block__").agg(F.max("__record__").alias("__last__"), F.max("__index__").alias("__records__"))
    carried = ends.select(
        "__file__", "__block__", F.last("__last__", ignorenulls=True).over(earlier).alias("__carried__"),
        (F.coalesce(F.sum("__records__").over(earlier), F.lit(0)) == 0).alias("__leads__"))
    lines = lines.join(_few(_kept(spark, carried, "carried", staged_paths)), ["__file__", "__block__"])
    if header:
        lines = lines.withColumn("__gone__", F.col("__starts__") & F.col("__leads__") & (F.col("__index__") == 1))
    else:
        lines = lines.withColumn("__gone__", F.lit(False))
    # the lines of a record that lie in its own split stand next to each other there
    own = Window.partitionBy("__file__", "__block__", "__record__").orderBy("__seq__").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    counts = F.col("__inside__") | F.col("__starts__")
    records = lines.withColumn("__lines__", F.collect_list(F.when(counts, F.col("value"))).over(own)).where(F.col("__starts__") & ~F.col("__gone__"))
    # the others, at most one rest for each split, are brought to it
    rests = _kept(spark, lines.where(F.col("__inside__") & F.col("__record__").isNull()).groupBy(
        "__file__", F.col("__carried__").alias("__seq__")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("__seq__", "value"))), lambda x: x["value"]).alias("__rest__")), "rests", staged_paths)
    size = rests.agg(F.count("*"), F.sum(F.length(F.array_join("__rest__", "\n")))).head()
    if size[0]:
        rests = F.broadcast(rests) if size[0] <= BROADCAST_SPLITS and (size[1] or 0) <= BROADCAST_TEXT else rests
        records = records.join(rests, ["__file__", "__seq__"], "left").withColumn(
            "__lines__", F.concat("__lines__", F.coalesce("__rest__", F.array().cast("array<string>"))))
    records = records.select("__file__", "__block__", F.col("__index__").alias("__seq__"), F.array_join("__lines__", "\n").alias("__text__"))
    text = F.regexp_replace("__text__", "\r$", "")
    parsed = records.withColumn("__cells__", F.from_csv(text, _text_schema(names), {k: str(v) for k, v in _CSV.items()}))
    return parsed.select(*_checked(names, lambda n: F.col("__cells__").getField(n)), *_PLACE)


def _first_lines(spark: SparkSession, spec: SourceSpec, n: int) -> list[list[str]]:
    """Cells of the first ``n`` lines of the first file that are not blank, which is how the CSV reader counts."""
    files = spark.read.format("text").load(spec.path).inputFiles()
    if not files:
        raise FileNotFoundError(f"no files in {spec.path}")
    lines = (
        spark.read.text(unquote(min(files)))
        .where((F.col("_metadata.file_block_start") == 0) & F.col("value").rlike(r"[^\x00-\x20]")).limit(n).collect()
    )
    return [next(csv.reader([line.value])) for line in lines]


def _text_schema(names: list[str]) -> str:
    return ", ".join("`" + n.replace("`", "``") + "` string" for n in [*names, _BEYOND])


def _checked(names: list[str], cell: Callable[[str], Column]) -> list[Column]:
    """The cells of a row; one with more cells than there are columns raises."""
    told = F.raise_error(F.concat(F.lit(f"a row has more than {len(names)} cells: "), F.concat_ws(",", *[cell(n) for n in [*names, _BEYOND]])))
    first = F.when(cell(_BEYOND).isNull(), cell(names[0])).otherwise(told.cast("string")).alias(names[0])
    return [first, *[cell(n).alias(n) for n in names[1:]]]


def _cells(spark: SparkSession, spec: SourceSpec, names: list[str], header: bool, staged_paths: list[str] | None) -> DataFrame:
    """The file as text columns with the place of each row."""
    if _spans_lines(spark, spec):
        # a line break of another kind than the last byte of a line: such a file is read whole
        odd_breaks = spark.read.option("lineSep", "\n").text(spec.path).where(F.col("value").rlike("\r(?!$)"))
        if odd_breaks.isEmpty():
            return _quoted_records(spark, spec, names, header, staged_paths)
        reader = spark.read.options(**_CSV, multiLine=True)
    else:
        reader = spark.read.options(**_CSV)
    raw = reader.options(header=header, enforceSchema=True).schema(_text_schema(names)).csv(spec.path)
    return _placed(raw, *_checked(names, ref))


def _missing_to_null(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.when(~ref(n).isin(*MISSING_CELLS), ref(n)) for n in names})


def _number_rows(spark: SparkSession, rows: DataFrame, names: list[str], ordinal: str, header: list[str] | None = None,
                 skip: int = 0, staged_paths: list[str] | None = None) -> DataFrame:
    """Rows with their place (``_PLACE``) numbered by ``ordinal`` 1..N in file order.

    The first ``skip`` lines go from the first file, and from every other one whose line ``skip``
    is the same ``header``: files that go on where the one before ends have none.

    A first, narrow read counts the rows of each split, which gives each split its offset; only that
    table of splits is ever ordered as a whole, never the data, and nothing of the data is staged.
    """
    counted = rows.groupBy("__file__", "__block__").agg(F.min("__seq__").alias("__first__"), F.count("*").alias("__rows__"))
    counted = _kept(spark, counted, "splits", staged_paths)
    splits = counted
    # rows of the split that belong to the file's first ``skip``
    inside = Window.partitionBy("__file__").orderBy("__block__").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("__before__", F.coalesce(F.sum("__rows__").over(inside), F.lit(0))).withColumn("__skip__", F.lit(0))
    if skip:
        padded = [*(header or []), *[""] * len(names)]
        same = [F.coalesce(ref(n), F.lit("")) == F.lit(cell or "") for n, cell in zip(names, padded)]
        line = F.col("__seq__") - F.col("__first__") + F.col("__before__") + 1
        headed = rows.where(reduce(lambda x, y: x & y, same)).select("__file__", "__block__", "__seq__").join(
            splits.select("__file__", "__block__", "__first__", "__before__"), ["__file__", "__block__"]
        ).where(line == skip).select("__file__").union(splits.agg(F.min("__file__").alias("__file__"))).distinct()
        splits = splits.join(headed.withColumn("__headed__", F.lit(skip)), "__file__", "left").withColumn(
            "__skip__", F.coalesce("__headed__", F.lit(0)))
    gone = F.least("__rows__", F.greatest(F.col("__skip__") - F.col("__before__"), F.lit(0)))
    splits = splits.withColumn("__gone__", gone).withColumn("__kept__", F.col("__rows__") - F.col("__gone__"))
    order = Window.orderBy("__file__", "__block__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "__file__", "__block__", (F.col("__first__") + F.col("__gone__")).alias("__from__"),
        (F.coalesce(F.sum("__kept__").over(order), F.lit(0)) - F.col("__first__") - F.col("__gone__")).alias("__shift__"),
    )
    if counted.count() <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    numbered = rows.join(offsets, ["__file__", "__block__"])
    if skip:
        numbered = numbered.where(F.col("__seq__") >= F.col("__from__"))
    return numbered.select((F.col("__seq__") + F.col("__shift__") + 1).alias(ordinal), *[ref(n) for n in names])


def _number_stored_rows(df: DataFrame, ordinal: str) -> DataFrame:
    """Parquet rows with ``ordinal`` 1..N by file path and place in the file; no shuffle, no sort."""
    names = df.columns
    rows = df.select(*[ref(n) for n in names], F.col("_metadata.file_path").alias("__file__"),
                     F.col("_metadata.row_index").alias("__seq__"))
    files = df.select(F.col("_metadata.file_path").alias("__file__")).groupBy("__file__").agg(F.count("*").alias("__rows__"))
    order = Window.orderBy("__file__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("__file__", F.coalesce(F.sum("__rows__").over(order), F.lit(0)).alias("__shift__"))
    if len(df.inputFiles()) <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    return rows.join(offsets, "__file__").select(
        (F.col("__seq__") + F.col("__shift__") + 1).alias(ordinal), *[ref(n) for n in names]
    )


def _text_layout(spark: SparkSession, spec: SourceSpec) -> tuple[list[str], int | None, list[str]]:
    """Column names as read, and the header line with its cells when it is below line 1.

    A file is as wide as the widest line down to its header.
    """
    header_row = spec.header_row
    if header_row and header_row > 1 or (header_row == 1 and spec.header_col):
        lines = _first_lines(spark, spec, header_row)
        if len(lines) < header_row:
            raise IndexError(f"header row {header_row} is out of range for a file of {len(lines)} lines")
        return [f"_c{i}" for i in range(max(map(len, lines)))], header_row, lines[header_row - 1]
    lines = _first_lines(spark, spec, HEADER_SCAN_ROWS + 1)
    if not lines:
        raise ValueError(f"no columns to read in {spec.path}")
    first, rest = lines[0], lines[1:]
    if not has_blank_names(first):
        return unique_names([n.strip() for n in first]), None, []
    rest = [[None if c in MISSING_CELLS else c for c in row] for row in rest]
    detected = detect_header(rest, len(first))
    if detected is None:
        return sanitized_names(first), None, []
    return [f"_c{i}" for i in range(max(map(len, lines)))], detected + 2, lines[detected + 1]


def _read_text(spark: SparkSession, spec: SourceSpec, ordinal: str | None,
               staged_paths: list[str] | None = None) -> DataFrame:
    """Text columns under their final names, missing cells as NULL.

    What stands above the header, and the header, is left out of every file of a folder that has it.
    """
    names, header_row, header = _text_layout(spark, spec)
    cells = _cells(spark, spec, names, header_row is None, staged_paths)
    if header_row is None:
        rows = _number_rows(spark, cells, names, ordinal, staged_paths=staged_paths) if ordinal else cells.select(*[ref(n) for n in names])
    else:
        start, titles = header_names([None if c in MISSING_CELLS else c for c in header], spec.header_col)
        numbered = _number_rows(spark, cells, names, ORDINAL, header, header_row, staged_paths)
        kept = [ref(c).alias(t) for c, t in zip(names[start:], titles)]
        rows = numbered.select(*([ref(ORDINAL).alias(ordinal)] if ordinal else []), *kept)
    return _missing_to_null(rows, [c for c in rows.columns if c != ordinal])


def read_rows(spark: SparkSession, spec: SourceSpec, width: int, ordinal: str = ORDINAL) -> DataFrame:
    """A text file as it is: ``width`` text columns ``_c0``..., no header taken out, lines numbered from 1 in file order."""
    names = [f"_c{i}" for i in range(width)]
    return _missing_to_null(_number_rows(spark, _cells(spark, spec, names, False, None), names, ordinal), names)


def read_source(spark: SparkSession, spec: SourceSpec, ordinal: str | None = None, typed: bool = True,
                staged_paths: list[str] | None = None) -> DataFrame:
    """Read a ledger file; with ``ordinal`` rows are numbered 1..N in file order.

    Text columns get their types from one pass over the data (``typed``). Folders staged
    for the numbers are added to ``staged_paths``; the frame reads them.
    """
    fmt = _format(spec)
    if fmt in TEXT_FORMATS:
        df = _read_text(spark, spec, ordinal, staged_paths)
        if not typed:
            return df
        return cast_text_columns(df, infer_text_types(df, [c for c in df.columns if c != ordinal]))
    df = spark.read.format(fmt).load(spec.path)
    if ordinal is None:
        return df
    if fmt == "parquet":
        return _number_stored_rows(df, ordinal)
    return _number_rows(spark, _placed(df, *[ref(c) for c in df.columns]), df.columns, ordinal, staged_paths=staged_paths)


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows."""
    return df.limit(rows)


def ingest(spark: SparkSession, spec: SourceSpec, out_path: str) -> Ingested:
    """Store a ledger file as Parquet with ``row_index``, replacing what is there."""
    staged: list[str] = []
    df = read_source(spark, spec, ordinal=ORDINAL, staged_paths=staged)
    seen = Observation("ingest")
    df.observe(seen, F.count("*").alias("rows")).write.mode("overwrite").parquet(out_path)
    for path in staged:
        remove_path(spark, path)
    return Ingested(out_path, int(seen.get["rows"]), tuple(df.columns))
