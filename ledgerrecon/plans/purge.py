"""Deleting a ledger's traces from stored tables, safely against jobs that die.

Results lie in one folder for each run, or, where a table keeps tens of thousands of small runs, for
each block of runs: a file for each run would cost more than its rows. Runs that go with the ledger lose their folder by name;
folders that hold rows of others besides are written anew without them, next to the
table under a name Spark does not read. Only when all that is written a small file says what
is to be dropped and what put in place: a job that dies before leaves the tables as they were,
and one that dies after is finished by the next (``finish_purges``), since every step may be
repeated.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerrecon.operators.results import purge

_DECIDED = "_decided.json"
#: Run folders that are dropped or put in place at once.
FOLDERS_AT_ONCE = 8
#: Blocks of a table that keeps many runs in one folder.
RUN_BLOCKS = 64


class _Store:
    """What is needed of the file system that a path lies in."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._io = spark._jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def rename(self, source: str, target: str) -> None:
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"could not rename {source} to {target}")

    def folders(self, path: str, prefix: str) -> list[str]:
        if not self.exists(path):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(path))]
        return sorted(n for n in names if n.startswith(prefix))

    def write(self, path: str, text: str) -> None:
        """The whole text or nothing: written beside and renamed."""
        out = self._fs.create(self._path(f"{path}.part"), True)
        self._io.write(text, out, "UTF-8")
        out.close()
        self.rename(f"{path}.part", path)

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        text = self._io.toString(stream, "UTF-8")
        stream.close()
        return text


def run_block(blocks: int = RUN_BLOCKS) -> Column:
    """The block of a run, for tables that keep many small runs: folders of ``run_block`` instead of ``run_id``."""
    return F.pmod(F.xxhash64(F.col("run_id").cast("string")), F.lit(blocks)).cast("int")


def purge_dataset(spark: SparkSession, dataset_id: int, results_path: str, runs_path: str, configs_path: str, folders: str = "run_id") -> dict[str, int]:
    """Delete a ledger's configs, their runs and results, and all results that name the ledger itself.

    ``results_path`` and ``runs_path`` are tables with one folder for each run, or for each block of runs
    (``folders="run_block"``), ``configs_path`` is a small table. Results without a run stay. Returns how many configs and runs went, and how
    many folders of results that hold rows of others, too, or rows of the ledger, changed.
    """
    finish_purges(spark, results_path)
    store = _Store(spark, results_path)
    results, runs, configs = (spark.read.parquet(p) for p in (results_path, runs_path, configs_path))
    left = purge(results, runs, configs, dataset_id)
    root, work = results_path.rstrip("/"), f"{results_path.rstrip('/')}/_purge-{uuid.uuid4().hex}"
    mine = F.coalesce(F.col("dataset_id") == dataset_id, F.lit(False))
    if folders == "run_id":
        # runs of one ledger's configs, by name; nothing of their results is read
        doomed = [r["run_id"] for r in runs.join(left["runs"], "run_id", "left_anti").select("run_id").distinct().toLocalIterator()]
        gone_runs, others = len(doomed), results.where(~F.col("run_id").isin(doomed))
        drop, replace = [f"{table.rstrip('/')}/run_id={run}" for run in doomed for table in (root, runs_path)], []
    else:
        configs_gone = configs.where((F.col("base_a_id") == dataset_id) | (F.col("base_b_id") == dataset_id)).select("config_id")
        doomed = runs.join(configs_gone, "config_id", "left_semi").select("run_id").distinct().withColumn("_doomed", F.lit(True))
        gone_runs, others = doomed.count(), results.join(doomed, "run_id", "left")
        unnamed = results.where(F.col("run_id").isNull() & mine)  # as with a folder for each run, rows without a run stay
        left["results"] = left["results"].unionByName(unnamed)
        mine = F.col("run_id").isNotNull() & (mine | F.coalesce("_doomed", F.lit(False)))
        stale_runs = runs.join(configs_gone.distinct().withColumn("_doomed", F.lit(True)), "config_id", "left")
        drop, replace, _ = _rewrite(stale_runs, F.coalesce("_doomed", F.lit(False)), left["runs"], folders, runs_path, f"{work}/runs")
    emptied, rewritten, changed = _rewrite(others, mine, left["results"], folders, root, f"{work}/results")
    left["configs"].write.parquet(f"{work}/configs")
    gone = configs.count() - spark.read.schema(configs.schema).parquet(f"{work}/configs").count()
    plan = {"drop": drop + emptied, "replace": [*replace, *rewritten, [f"{work}/configs", configs_path.rstrip("/")]]}
    store.write(f"{work}/{_DECIDED}", json.dumps(plan))
    _apply(store, work)
    return {"configs": gone, "runs": gone_runs, "rewritten": changed}


def _rewrite(rows: DataFrame, stale: Column, left: DataFrame, folders: str, path: str, work: str) -> tuple[list[str], list[list[str]], int]:
    """Writes what is ``left`` of the folders that hold stale rows: the folders to drop, those to replace, how many both are."""
    found = rows.groupBy(folders).agg(F.bool_or(stale).alias("some"), F.bool_and(stale).alias("all"))
    found.where(F.col("some") & F.col(folders).isNotNull()).write.parquet(f"{work}-folders")
    found = rows.sparkSession.read.parquet(f"{work}-folders")
    names = {r[folders]: r["all"] for r in found.toLocalIterator()}
    kept = [name for name, nothing_left in names.items() if not nothing_left]
    if kept:
        left.join(F.broadcast(found.where("not all")), folders, "left_semi").select(left.columns).write.partitionBy(folders).parquet(work)
    drop = [f"{path.rstrip('/')}/{folders}={name}" for name, nothing_left in names.items() if nothing_left]
    return drop, [[f"{work}/{folders}={name}", f"{path.rstrip('/')}/{folders}={name}"] for name in kept], len(names)


def _apply(store: _Store, work: str) -> None:
    plan = json.loads(store.read(f"{work}/{_DECIDED}"))

    def replace(folders: list[str]) -> None:
        source, target = folders
        if store.exists(source):  # else it is in place
            store.remove(target)
            store.rename(source, target)

    # every folder is a step of its own: tens of thousands of runs go many at a time
    with ThreadPoolExecutor(FOLDERS_AT_ONCE) as pool:
        for step, folders in ((store.remove, plan["drop"]), (replace, plan["replace"])):
            for _ in pool.map(step, folders):
                pass
    store.remove(work)


def finish_purges(spark: SparkSession, results_path: str) -> int:
    """Finish purges that were decided, clear away those that were not; returns how many were finished."""
    store, finished = _Store(spark, results_path), 0
    for name in store.folders(results_path, "_purge-"):
        work = f"{results_path.rstrip('/')}/{name}"
        if store.exists(f"{work}/{_DECIDED}"):
            _apply(store, work)
            finished += 1
        else:
            store.remove(work)
    return finished
