"""Joining rows to facts about their group when one group may be huge.

A join of rows to a per-group table hashes each group to one task. If one group
holds a third of all rows, that task never ends. ``attach_group`` therefore takes
the largest groups out of the hash join:

* the at most ``HOT_GROUPS`` largest groups above ``HOT_ROWS`` rows are broadcast
  (the list is bounded by its limit, whatever the data), and their rows are
  spread over the shuffle in slabs of ``SLAB_ROWS`` consecutive row ordinals;
* rows without a complete key match nothing and are spread by their ordinal;
* all other groups, also those beyond the list, go through the shuffle join, so
  the result never depends on what the list holds. A group left out of a full
  list holds less than 1 / HOT_GROUPS of all rows.

The spread value is part of the grouping keys of the group table, so both sides
of the join share one partitioning and the group table is shuffled only once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerrecon.functions import ref

HOT_GROUPS = 10_000
HOT_ROWS = 1_000_000
SLAB_ROWS = 1_000_000
SPREAD = "__spread__"
HOT = "__is_hot__"


def spread_of(keys: Sequence[str]) -> Column:
    """Hash that goes with the group keys; add it to the keys of the group table."""
    return F.xxhash64(*[ref(k) for k in keys])


def complete_key(keys: Sequence[str]) -> Column:
    """No key part is missing. Group tables filter by this before they aggregate, which
    is what the joins below would infer for one of their two uses of the table; said
    for both, they share one aggregation."""
    return reduce(lambda x, y: x & y, [ref(k).isNotNull() for k in keys])


def attach_group(rows: DataFrame, groups: DataFrame, keys: Sequence[str], facts: Sequence[str], size: str,
                 ordinal: str, hot_rows: int = HOT_ROWS, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """Rows with the ``facts`` of their group (NULL where no group fits).

    ``groups`` holds one row per (``__spread__``, keys) with its row count in
    ``size``. The result is partitioned by (``__spread__``, keys). For the rows of a
    hot group, which ``__is_hot__`` tells, the spread is the first ordinal of their
    slab, so one (spread, keys) holds at most ``slab_rows`` of them, in slab order.
    A hot row whose slab should equal the hash of its keys finds the same facts.
    """
    named = [ref(k) for k in keys]
    hot = (
        groups.where(ref(size) > hot_rows)
        .orderBy(ref(size).desc(), *named)
        .limit(HOT_GROUPS)
        .select(*named, F.struct(*[ref(f) for f in facts]).alias("__hot__"))
    )
    is_hot = F.col("__hot__").isNotNull()
    spread = (
        F.when(is_hot, ref(ordinal) - F.pmod(ref(ordinal), F.lit(slab_rows)))
        .when(~complete_key(keys), ref(ordinal))
        .otherwise(spread_of(keys))
    )
    marked = rows.join(F.broadcast(hot), list(keys), "left").withColumns({SPREAD: spread.cast("bigint"), HOT: is_hot})
    cold = groups.select(SPREAD, *named, F.struct(*[ref(f) for f in facts]).alias("__cold__"))
    joined = marked.join(cold, [SPREAD, *keys], "left")
    return joined.withColumn("__facts__", F.coalesce(F.col("__hot__"), F.col("__cold__"))).select(
        *[ref(c) for c in rows.columns], SPREAD, HOT, *[F.col("__facts__")[f].alias(f) for f in facts]
    )
