"""What several operators of this package need: staging, word hashes, prefix sums."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable, Hashable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerrecon.session import remove_path, shared_path

#: Words kept with their hashes by each Python worker.
WORD_CACHE = 120_000
LOWER_ASCII = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def stage(df: DataFrame, label: str, paths: list[str] | None = None) -> DataFrame:
    """The frame written below the shared folder and read again: cuts lineage, survives lost executors.

    The folder's path is added to ``paths``, for a job to remove once nothing reads it any more (``clear``).
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, paths: list[str]) -> None:
    """Removes staged folders that nothing reads any more."""
    while paths:
        remove_path(spark, paths.pop())


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of frames that nothing holds any more: its cleaner learns of them when the
    driver collects its garbage, which a long job may not do before its disks are full."""
    gc.collect()
    spark._jvm.System.gc()


def small(df: DataFrame, limit: int = 2_000_000) -> DataFrame:
    """Marked for broadcast if it has at most ``limit`` rows of a few numbers; a stored frame."""
    return F.broadcast(df) if df.count() <= limit else df


#: Bytes of a batch that goes to a worker, unless the session has another setting than Spark's own.
BATCH_BYTES = 8 * 1024 * 1024
_BATCH_SETTING, _SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64MB", "67108864")
_SHIPPED: set[str] = set()


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with this library sent to the executors, once for each application, and batches of bounded size."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        target = Path(tempfile.mkdtemp(prefix="ledgerrecon-")) / f"{package.name}_sources.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for file in sorted(package.rglob("*.py")):
                archive.write(file, file.relative_to(package.parent))
        sc.addPyFile(str(target))  # the driver hands it out; nothing else reads this folder
        _SHIPPED.add(sc.applicationId)
        if df.sparkSession.conf.get(_BATCH_SETTING, _SPARKS_OWN[0]) in _SPARKS_OWN:
            df.sparkSession.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(_Lean(run), schema)


def lower_ascii(column: Column) -> Column:
    """A-Z as a-z, all other characters as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before this one by ``order`` (a total order).

    Rows are dealt by ranges of ``order``; only one sum for each partition passes
    through the driver. The frame must be a stored one: it is read twice.
    """
    ranged = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = {r["_part"]: r["s"] for r in ranged.groupBy("_part").agg(F.sum(value).alias("s")).collect()}
    before, total = [], 0
    for part in range(max(sums, default=-1) + 1):
        before.append(total)
        total += sums.get(part) or 0
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    base = F.element_at(F.lit(before), F.col("_part") + 1) if before else F.lit(0)
    return ranged.withColumn(name, (base + F.coalesce(inside, F.lit(0))).cast("long")).drop("_part")


_HELD: list = [None, None]
_OPERATOR = [""]


def held(kind: Hashable, make: Callable[[], object]) -> object:
    """What a worker keeps between tasks of one operator: one thing at a time, made when a task first asks for its kind.

    Workers live as long as the session. If each operator kept its own tables in them, an executor would hold
    those of every job it ever ran; so another kind, or a task of another operator, lets the one before go.
    """
    if _HELD[0] != kind:
        _HELD[:] = [None, None]
        _give_back()
        _HELD[:] = [kind, make()]
    return _HELD[1]


def _give_back() -> None:
    """Memory that nothing uses any more goes back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass


class _Lean:
    """Runs a task of an operator: without what others left in the worker, and leaving no unused memory behind."""

    def __init__(self, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
        self.run, self.operator = run, run.__module__

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _OPERATOR[0] != self.operator:
            _OPERATOR[0] = self.operator
            _HELD[:] = [None, None]
            _give_back()
        yield from self.run(batches)
        _give_back()


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORD_CACHE:
            self[word] = value
        return value


def binary_list(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a text column."""
    return column.cast(pa.binary()).to_pylist()


def hashed_words(texts: list[bytes | None], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between ASCII white space of all texts, and where each text begins (one more at the end)."""
    known = held("words", _WordHashes)
    parts, ends = [], [0]
    for text in texts:
        words = (text.translate(LOWER_ASCII) if lower else text).split() if text else ()
        parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        ends.append(ends[-1] + len(words))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), np.array(ends, np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of ``length`` words, made by joining runs of half that length."""
    if len(words) < length:
        return np.empty(0, np.uint64)
    if length == 1:
        return mixed(words * np.uint64(2 * seed + 1))
    half = window_hashes(words, length // 2, seed)
    n = len(words) - length + 1
    joined = mixed(half[:n] * np.uint64(0x9E3779B97F4A7C15) + half[length // 2 : length // 2 + n])
    if length % 2:
        joined = mixed(joined * np.uint64(0x9E3779B97F4A7C15) + words[length - 1 : length - 1 + n])
    return joined


def text_runs(batches: Iterator[pa.RecordBatch], limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows whose texts hold about ``limit`` bytes, to bound what is unpacked at once."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text").cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
        groups = np.cumsum(sizes, dtype=np.int64) // limit
        edges = np.flatnonzero(np.diff(groups)) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(sizes)]):
            if end > start:
                yield batch.slice(start, end - start)


def set_aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with its columns of these names under private ones, and what selects all its columns as they were."""
    taken, moved = {c.lower() for c in docs.columns}, {}
    for name in docs.columns:
        if name.lower() in names:
            private = f"_own_{name}"
            while private.lower() in taken:
                private = f"_{private}"
            taken.add(private.lower())
            moved[name] = private
    return docs.withColumnsRenamed(moved), [F.col(f"`{moved.get(c, c)}`").alias(c) for c in docs.columns]


def private_name(df: DataFrame, name: str) -> str:
    """``name``, or the like of it, that no column of the frame has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def rows_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    """Where this machine has a public tokenizer file; the same place on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)
