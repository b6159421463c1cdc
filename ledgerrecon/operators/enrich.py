"""Writing verdicts back onto ledger rows.

Rows meet the verdicts by composite key. The verdict table has one row per key, so
rows are never multiplied. With one or two key definitions, or rows without an ordinal,
that is one left join per definition. Otherwise every row is told by its ordinal: narrow
(ordinal, definition, key) tags of all definitions meet the verdicts in one join, the
best hit of each ordinal is kept, and the ledger itself is shuffled once, by ordinal,
however many definitions there are. Adaptive execution broadcasts a verdict table that
turns out small and splits a key that many rows share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerrecon.config import ReconConfig
from ledgerrecon.functions import composite_key, ref
from ledgerrecon.functions.refs import require
from ledgerrecon.labels import CANCELED_FLAG, ENRICHED_COLUMNS, MERGED_COLUMNS, REVERSAL_FLAG
from ledgerrecon.sources.headers import ORDINAL

#: Key definitions from which on a ledger is shuffled once for all of them, and not once for each.
MANY_KEYS = 3
_FIELDS = ("status", "group_name", "key_used", "difference")


def _keys_of(rows: DataFrame, config: ReconConfig, side: str | None) -> list[tuple[int, str, tuple[str, ...]]]:
    """Position, name and columns of the key definitions that this side has."""
    named = [(i, k.name, k.columns(side)) for i, k in enumerate(config.keys)]
    return [k for k in named if k[2]]


def _hits_by_ordinal(rows: DataFrame, verdicts: DataFrame, keys: list[tuple[int, str, tuple[str, ...]]], last: bool,
                     ordinal: str) -> DataFrame:
    """The best hit of each ordinal that has one."""
    tags = F.array(*[F.struct(F.lit(name).alias("key_used"), F.lit(i).alias("__at__"), composite_key(rows, columns).alias("row_identifier"))
                     for i, name, columns in keys])
    tagged = rows.select(ref(ordinal).alias("__row__"), F.inline(tags))
    hits = tagged.join(verdicts, ["key_used", "row_identifier"])
    best = F.max_by if last else F.min_by
    return hits.groupBy("__row__").agg(best(F.struct(*_FIELDS), F.col("__at__")).alias("__best__"))


def _with_verdict(rows: DataFrame, results: DataFrame, config: ReconConfig, side: str | None, precedence: str,
                  ordinal: str) -> DataFrame:
    """Rows plus ``__best__``, the hit that wins."""
    if precedence not in ("first", "last"):
        raise ValueError(f"unknown precedence: {precedence}")
    keys = _keys_of(rows, config, side)
    if not keys:
        empty = F.struct(*[F.lit(None).cast("double" if f == "difference" else "string").alias(f) for f in _FIELDS])
        return rows.withColumn("__best__", empty)
    known = results.where(F.col("key_used").isin([name for _, name, _ in keys]) & F.col("row_identifier").isNotNull())
    if len(keys) >= MANY_KEYS and ordinal in rows.columns:
        best = _hits_by_ordinal(rows, known.select("row_identifier", *_FIELDS), keys, precedence == "last", ordinal)
        return rows.join(best, ref(ordinal) == F.col("__row__"), "left").drop("__row__")
    out, hits = rows, []
    for i, name, columns in keys:
        key, hit = f"__key{i}__", f"__hit{i}__"
        verdicts = known.where(F.col("key_used") == name).select(F.col("row_identifier").alias(key), F.struct(*_FIELDS).alias(hit))
        out = out.withColumn(key, composite_key(rows, columns)).join(verdicts, key, "left").drop(key)
        hits.append(F.col(hit))
    return out.withColumn("__best__", F.coalesce(*(hits if precedence == "first" else reversed(hits))))


def _of_run(results: DataFrame, run_id: int | None) -> DataFrame:
    """The results of one run; several runs would give a row several verdicts."""
    return results if run_id is None else results.where(F.col("run_id") == run_id)


def enrich(rows: DataFrame, results: DataFrame, config: ReconConfig, side: str | None,
           precedence: str = "first", run_id: int | None = None, ordinal: str = ORDINAL) -> DataFrame:
    """Rows with ``status``, ``group_name`` and ``key_used``; the first matching key wins.

    Every row is enriched, cancelled and reversed ones too. Missing flag columns
    are added as NULL, and earlier verdict columns are replaced. ``results`` hold one run,
    or ``run_id`` says which one counts. A column ``ordinal`` must tell rows apart and be known for all.
    """
    base = rows.select(*[ref(c) for c in rows.columns if c not in ENRICHED_COLUMNS])
    for flag in (CANCELED_FLAG, REVERSAL_FLAG):
        if flag not in base.columns:
            base = base.withColumn(flag, F.lit(None).cast("boolean"))
    joined = _with_verdict(base, _of_run(results, run_id), config, side, precedence, ordinal)
    return joined.select(
        *[ref(c) for c in base.columns], *[F.col("__best__")[c].alias(c) for c in ENRICHED_COLUMNS]
    )


def merge_results(rows: DataFrame, results: DataFrame, config: ReconConfig, side: str | None,
                  precedence: str = "last", run_id: int | None = None, ordinal: str = ORDINAL) -> DataFrame:
    """Rows with ``recon_key_name``, ``recon_status``, ``recon_group``, ``recon_difference``."""
    base = rows.select(*[ref(c) for c in rows.columns if c not in MERGED_COLUMNS])
    joined = _with_verdict(base, _of_run(results, run_id), config, side, precedence, ordinal)
    fields = ("key_used", "status", "group_name", "difference")
    return joined.select(
        *[ref(c) for c in base.columns], *[F.col("__best__")[f].alias(n) for f, n in zip(fields, MERGED_COLUMNS)]
    )


def attach_results(rows: DataFrame, mapping: DataFrame, key_column: str = "key", status_col: str = "status",
                   group_col: str = "group", diff_col: str = "difference") -> DataFrame:
    """Rows with the status, group and difference their key has in ``mapping``.

    ``mapping`` holds one row per ``key``; fields it lacks come out as NULL.
    """
    require(rows, key_column)
    require(mapping, "key")
    names = {"status": (status_col, "string"), "group": (group_col, "string"), "difference": (diff_col, "double")}
    found = mapping.select(ref("key").alias("__key__"), *[
        (ref(f).cast(kind) if f in mapping.columns else F.lit(None).cast(kind)).alias(name)
        for f, (name, kind) in names.items()
    ])
    replaced = [name for name, _ in names.values()]
    base = rows.select(*[ref(c) for c in rows.columns if c not in replaced])
    return base.join(found, ref(key_column) == F.col("__key__"), "left").drop("__key__")
