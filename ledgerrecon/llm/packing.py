"""Best-fit packing after Martello-Toth reduction, on counts of lengths instead of items.

Lengths are whole numbers up to the capacity, so the number of pieces of each length
says all about an instance, however many pieces there are: reduction and best fit
work on that histogram and give sequence patterns with how often each is used. Pieces then
find their sequence by their rank among the pieces of their length: ranks are
counted within partitions and shifted by the partitions before.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerrecon.llm.common import arrow_map, stage, text_runs
from ledgerrecon.llm.tokens import FULL, Tables, piece_tokenizer

Pattern = tuple[int, ...]


class _Lengths:
    """Counts of lengths with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: v for k, v in counts.items() if v > 0}
        self.sizes = sorted(self.counts)

    def take(self, size: int, n: int) -> None:
        self.counts[size] -= n
        if not self.counts[size]:
            del self.counts[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def largest(self, room: int) -> int | None:
        """The largest length that fits."""
        at = bisect_right(self.sizes, room)
        return self.sizes[at - 1] if at else None

    def smallest(self, k: int, without: Counter) -> int | None:
        """Sum of the ``k`` smallest pieces, besides some that are spoken for; None if there are fewer."""
        total = 0
        for size in self.sizes:
            n = min(k, self.counts[size] - without[size])
            total, k = total + n * size, k - n
            if not k:
                return total
        return None


def reduce_lengths(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fixes sets that dominate every other feasible set with their largest piece; what is left over.

    For a largest piece ``j``: alone, if nothing fits beside it; with ``k``, if the two fill
    the capacity, or if no two pieces fit beside ``j`` and ``k`` is the largest that does; as a
    triple, if no three pieces fit beside ``j`` and its two companions are the best pair: they fill
    the rest, or the larger of them is the largest that fits at all and the smaller the largest
    beside it while no pair has a larger smaller piece.
    """
    left, fixed = _Lengths(counts), []
    for j in sorted(left.counts, reverse=True):
        while left.counts.get(j, 0):
            n, room, own = left.counts[j], capacity - j, Counter({j: 1})
            k = left.largest(room)
            if k == j and n == 1:
                at = bisect_left(left.sizes, j)
                k = left.sizes[at - 1] if at else None
            if k is None:
                chosen: Pattern = (j,)
            else:
                two = left.smallest(2, own)
                if k == room or two is None or two > room:
                    chosen = (j, k)
                else:
                    three = left.smallest(3, own)
                    chosen = _best_pair(left, j, room) if three is None or three > room else ()
            if not chosen:
                break
            use = Counter(chosen)
            times = min(left.counts[s] // c for s, c in use.items())
            # the test holds for all of them only while the same pieces are at hand: leave one out
            times = max(1, times - 1) if len(chosen) > 1 else times
            fixed.append((tuple(sorted(chosen, reverse=True)), times))
            for size, c in use.items():
                left.take(size, c * times)
    return fixed, left.counts


def _best_pair(left: _Lengths, j: int, room: int) -> Pattern:
    """``j`` with a pair that dominates all pairs and single pieces beside it, or nothing.

    The pair must hold the largest single piece that fits and, given that no pair is
    larger in either place, no other pair can do more.
    """
    def free(size: int) -> int:
        return left.counts.get(size, 0) - (size == j)

    big = left.largest(room)
    if big is not None and not free(big):
        at = bisect_left(left.sizes, big)
        big = left.sizes[at - 1] if at else None
    if big is None:
        return ()
    small = left.largest(room - big)
    while small is not None and free(small) - (small == big) <= 0:
        at = bisect_left(left.sizes, small)
        small = left.sizes[at - 1] if at else None
    if small is None:
        return ()
    # the smaller piece of any pair is at most half the room: none may be larger than ``small``
    half = left.largest(room // 2)
    while half is not None and free(half) <= 0:
        at = bisect_left(left.sizes, half)
        half = left.sizes[at - 1] if at else None
    return (j, big, small) if half is None or half <= small else ()


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit, largest pieces first, many equal pieces at a time.

    Open sequences with the same contents are one entry; a length goes to the fullest
    ones it fits, in all of them at once, and opens new ones when none has room.
    """
    rooms: list[int] = []
    open_by_room: dict[int, list[tuple[Pattern, int]]] = {}

    def put(room: int, pattern: Pattern, n: int) -> None:
        if room not in open_by_room:
            open_by_room[room] = []
            insort(rooms, room)
        open_by_room[room].append((pattern, n))

    done: list[tuple[Pattern, int]] = []
    for size in sorted((s for s in counts if counts[s]), reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                if n >= each:
                    put(capacity - each * size, (size,) * each, n // each)
                if n % each:
                    put(capacity - n % each * size, (size,) * (n % each), 1)
                break
            room = rooms[at]
            pattern, have = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
                rooms.pop(at)
            used = min(n, have)
            n -= used
            if have > used:
                put(room, pattern, have - used)
            if room == size:
                done.append(((*pattern, size), used))
            else:
                put(room - size, (*pattern, size), used)
    return done + [entry for entries in open_by_room.values() for entry in entries]


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Sequence patterns and how often each is used; no worse than best fit alone."""
    fixed, left = reduce_lengths(counts, capacity)
    reduced = fixed + best_fit(left, capacity)
    plain = best_fit(counts, capacity)
    return reduced if sum(n for _, n in reduced) <= sum(n for _, n in plain) else plain


def layout(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, ranks, first sequence, offset): ranks take sequences one after the other."""
    rows, rank, sequence = [], Counter(), 0
    for pattern, n in patterns:
        offset = 0
        for size in pattern:
            rows.append((size, rank[size], n, sequence, offset))
            rank[size] += n
            offset += size
        sequence += n
    return rows


PIECES = "doc_id long, piece int, start long, length int, ids binary, part int, rank long"


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", tables: Tables = FULL,
    ids: Column | None = None,
) -> DataFrame:
    """All documents as pieces of at most ``capacity`` ids, stored: the ids, and the piece's rank
    among those of its length in its partition. Only longer documents are cut; their first piece is
    the shorter one. NULL and empty texts are ``end_id`` alone. Who wants no more of the ids than, say, a digest names it
    as ``ids``, a column over ``ids`` that is stored in their place."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("part", F.spark_partition_id())
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, seen = piece_tokenizer(tokenizer, tables), Counter()
        for batch in text_runs(batches, tables.text_bytes):
            out: list[tuple] = []
            encoded = tok.encode(batch.column("text").cast(pa.binary()).to_pylist())
            for key, part, x in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), encoded):
                x += end
                n = len(x) // 4
                first = n % capacity or capacity
                at = 0
                for k, stop in enumerate(range(first, n + 1, capacity)):
                    size = stop - at
                    out.append((key, k, at, size, x[at * 4 : stop * 4], part, seen[size]))
                    seen[size] += 1
                    at = stop
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids", "part", "rank"]
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    pieces = arrow_map(rows, run, PIECES)
    return stage(pieces if ids is None else pieces.select(*(c for c in pieces.columns if c != "ids"), ids), "pieces")


def _plan(spark: SparkSession, rows: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Rows of ``layout`` as a frame, by way of Arrow: a list of tuples would start a second set of Python workers on every
    executor, which outlive their one small task."""
    names = ["length", "first", "n", "sequence", "at"]
    return spark.createDataFrame(pa.table([pa.array(c, pa.int64() if k else pa.int32()) for k, c in enumerate(zip(*rows))], names))


def assign_sequences(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored pieces; ``part`` and ``rank`` go.

    The driver sees one count for each length, at most ``capacity``. Repeated documents are
    packed as often as they occur; an empty frame stays empty. Only what the frame has besides is
    carried along, so leave the ids out where a digest will do.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("part", "length", before.alias("before"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = layout(pack_lengths(totals, capacity))
    plan = _plan(spark, rows or [(0, 0, 0, 0, 0)])
    # by length the steps in order of their first rank; a piece finds its step by bisection of ranks
    steps = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "n", "sequence", "at"))).alias("steps"))
    ranked = pieces.join(shifts, ["part", "length"]).withColumn("_rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(steps), "length")  # one row for each length, at most ``capacity``
    step = F.element_at(F.filter("steps", lambda s: (s["first"] <= F.col("_rank")) & (F.col("_rank") < s["first"] + s["n"])), 1)
    return (
        placed.withColumn("_step", step)
        .withColumns({"sequence_id": F.col("_step.sequence") + F.col("_rank") - F.col("_step.first"), "offset": F.col("_step.at")})
        .drop("part", "rank", "before", "steps", "_rank", "_step")
    )
