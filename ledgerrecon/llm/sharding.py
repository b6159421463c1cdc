"""Sharding: minimax contiguous partition of ordered atomic groups.

Groups (equal texts) stay whole and in order. The smallest feasible capacity is found
by bisection, each trial filling shards greedily. The driver never sees the groups: it
sees at most about ``2 * RESOLUTION`` runs of neighbouring groups. What a run hides gives bounds, a lower
one as if it could be cut anywhere, an upper one as if nowhere; runs in which a cut may fall are
split finer until both bounds meet.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerrecon.llm.common import running_total, stage

#: Runs of groups that the driver looks at in one round: about twice as many at most.
RESOLUTION = 20_000
#: and at least so many for each shard.
PER_SHARD = 256
#: Times as many runs are looked at when loose bounds leave much undecided.
LOOSE = 16
ROUNDS = 24


@dataclass(frozen=True)
class Runs:
    """Neighbouring groups in runs: where each begins, its size and whether it is one group."""

    start: np.ndarray
    size: np.ndarray
    single: np.ndarray

    @property
    def total(self) -> int:
        return int(self.size.sum())


def whole_cuts(runs: Runs, capacity: int, shards: int, at: int = 0) -> list[int] | None:
    """Greedy ends (places in ``runs``) with no run cut; None if ``shards`` are not enough."""
    ends = np.append(runs.start[1:], runs.start[-1] + runs.size[-1]) if len(runs.start) else runs.start
    cuts, k = [], at
    for _ in range(shards):
        if k == len(ends):
            break
        begin = int(runs.start[k])
        k = int(np.searchsorted(ends, begin + capacity, "right"))
        if k < len(ends) and int(runs.start[k]) == begin:
            return None
        cuts.append(k)
    return cuts if k == len(ends) else None


def fluid_cuts(runs: Runs, capacity: int, shards: int) -> list[int] | None:
    """The furthest greedy ends (in size from the beginning) if runs of several groups could be cut anywhere."""
    total, begin, cuts = runs.total, 0, []
    for _ in range(shards):
        if begin >= total:
            break
        end = min(total, begin + capacity)
        k = int(np.searchsorted(runs.start, end, "right")) - 1
        if end < total and runs.single[k] and end < runs.start[k] + runs.size[k]:
            end = int(runs.start[k])
        if end <= begin:
            return None
        cuts.append(end)
        begin = end
    return cuts if begin >= total else None


def _smallest(low: int, high: int, feasible) -> int:
    """The smallest capacity in (low, high] that is feasible; ``high`` is."""
    while high - low > 1:
        middle = (low + high) // 2
        if feasible(middle):
            high = middle
        else:
            low = middle
    return high


def smallest_capacity(runs: Runs, shards: int) -> tuple[int, int]:
    """Bounds of the smallest feasible capacity; equal if every run is a single group."""
    if not len(runs.start):
        return 0, 0
    upper = _smallest(0, runs.total, lambda c: whole_cuts(runs, c, shards) is not None)
    lower = _smallest(0, upper, lambda c: fluid_cuts(runs, c, shards) is not None)
    return lower, upper


def even_cuts(runs: Runs, capacity: int, shards: int) -> list[int]:
    """Beginnings of shards 1, 2, ... within ``capacity``, each shard as near as may be to an even share of the rest.

    A share leaves out groups that are larger than it: they take a shard of their own. Where the even
    cut would leave too much for the shards that follow, the greedy one stands.
    """
    if not len(runs.start):
        return []
    edges = np.append(runs.start, runs.start[-1] + runs.size[-1])
    large = [(int(s), int(z)) for s, z, one in zip(runs.start, runs.size, runs.single) if one and z * shards > runs.total]
    cuts, k = [], 0
    for left in range(shards, 1, -1):
        if k == len(runs.start):
            break
        begin = int(edges[k])
        rest, places = int(edges[-1]) - begin, left
        share = rest / places
        for size in sorted((z for s, z in large if s >= begin), reverse=True):
            if size > share and places > 1:
                rest, places = rest - size, places - 1
                share = rest / places
        furthest = int(np.searchsorted(edges, begin + capacity, "right")) - 1
        end = int(np.searchsorted(edges, begin + share, "right")) - 1
        if end < furthest and edges[end + 1] - begin - share < begin + share - edges[end]:
            end += 1
        end = min(max(end, k + 1), furthest)
        if whole_cuts(runs, capacity, left - 1, end) is None:
            end = furthest
        if end == len(runs.start):
            break
        cuts.append(int(edges[end]))
        k = end
    return cuts


def _windows(runs: Runs, lower: int, upper: int, shards: int) -> list[tuple[int, int]]:
    """Where the cut after each shard may fall for a capacity within the bounds."""
    far = fluid_cuts(runs, upper, shards) or []
    near, begin = [], 0
    ends = runs.start + runs.size
    for _ in far:
        k = int(np.searchsorted(ends, begin + lower, "right"))
        begin = int(ends[k - 1]) if k and ends[k - 1] > begin else begin
        near.append(begin)
    spans: list[tuple[int, int]] = []
    for a, b in sorted(zip(near, far)):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans


def _summed(groups: DataFrame, width: int) -> list[tuple[int, int, bool]]:
    """Runs of groups whose beginnings share a slab of ``width``; groups of that size or more stand alone."""
    rows = (
        groups.groupBy((F.col("start") / width).cast("long").alias("slab"), (F.col("size") >= width).alias("large"))
        .agg(F.min("start").alias("start"), F.sum("size").alias("size"), F.count("*").alias("n"))
    )
    return sorted((r["start"], r["size"], r["n"] == 1) for r in rows.collect())


def _runs(rows: list[tuple[int, int, bool]]) -> Runs:
    columns = list(zip(*rows)) or [(), (), ()]
    return Runs(np.array(columns[0], np.int64), np.array(columns[1], np.int64), np.array(columns[2], bool))


def find_cuts(groups: DataFrame, shards: int) -> list[int]:
    """Beginnings of all shards but the first, for stored ``groups`` (``start`` and ``size`` of each, in order)."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    wanted = max(RESOLUTION, PER_SHARD * shards)
    width = max(1, total // wanted)
    rows = _summed(groups, width)
    for _ in range(ROUNDS):
        runs = _runs(rows)
        lower, upper = smallest_capacity(runs, shards)
        if lower == upper or runs.single.all():
            break
        inside, ranges = np.zeros(len(rows), bool), []
        for a, b in _windows(runs, lower, upper, shards):
            own = (runs.start <= b) & (runs.start + runs.size > a)
            if (own & ~runs.single).any():
                ranges.append((int(runs.start[own][0]), int((runs.start + runs.size)[own][-1])))
                inside |= own
        hidden = int(runs.size[inside & ~runs.single].sum())
        if not hidden:
            break
        finer = max(1, hidden // wanted)
        if finer > width // 2:
            finer = max(1, width // 2)
            if hidden // finer > LOOSE * wanted:
                break  # too much is undecided to look at finer: the upper bound is feasible
        width = finer
        # one range for each shard at most
        within = [(F.col("start") >= low) & (F.col("start") < high) for low, high in ranges]
        part = groups.where(reduce(lambda x, y: x | y, within))
        rows = sorted({*(r for r, gone in zip(rows, inside) if not gone), *_summed(part, width)})
    runs = _runs(rows)
    return even_cuts(runs, smallest_capacity(runs, shards)[1], shards)


def place(cuts: list[int], start: Column) -> Column:
    """The shard of a group that begins at ``start``."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.lit(cuts), lambda c: c <= start))


def shard_by_size(docs: DataFrame, shards: int, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row.

    Sizes are UTF-8 bytes plus ``overhead`` (at least 1); NULL and empty texts have the overhead only
    and crc32 0, and are two groups. Equal texts are one group and stay in one shard; groups
    follow each other by their smallest id (NULL first), then by digest. Slots are gapless from 0 in that
    order, then by id; repeated rows take a slot each. Only these columns are returned, so other columns'
    names do not matter. Shards beyond the number of groups stay empty, as all do without rows.
    """
    if shards < 1 or overhead < 1:
        raise ValueError("at least one shard and an overhead of one byte")
    text = F.col(text_col)
    rows = stage(docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(text.isNull(), F.lit("")).otherwise(F.sha2(text, 256)).alias("key"),
    ), "sizes")
    grouped = stage(rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.sum("size").alias("size")), "groups")
    groups = stage(running_total(grouped, ["first", "key"], "size", "start").select("key", "start", "size"), "starts")
    cuts = find_cuts(groups, shards)
    placed = rows.join(groups.select("key", "start"), "key").select("doc_id", "size", "text_crc32", "start")
    placed = placed.withColumn("shard", place(cuts, F.col("start")).cast("int"))
    ranked = running_total(stage(placed.withColumn("one", F.lit(1)), "placed"), ["start", "doc_id"], "one", "rank")
    ranked = stage(ranked, "ranked")
    first = ranked.groupBy("shard").agg(F.min("rank").alias("first_rank"))
    return ranked.join(F.broadcast(first), "shard").select(  # one row for each shard
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first_rank")).alias("slot"),
    )
