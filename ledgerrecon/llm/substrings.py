"""Substring dedup by level-wise doubling.

Windows of a short length are counted first. Only where they are repeated can a window of
twice that length be repeated, so each level looks only at what the last one left, until
the wanted length is reached or nothing is left.

A level below the wanted length does not need all its windows: in every wanted window the short
window with the smallest hash stands for it (equal windows choose the same one), so about two in
``length - level + 2`` are counted, and no repeated window is lost. At the wanted length every
surviving window is looked at: the first in document order stays, all others are removed.

Hot windows: what is known to be repeated, or known not to be the first, inside one batch of rows is
marked there and dealt out by salt; one row for each window and batch meets the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerrecon.llm.common import arrow_map, binary_list, hashed_words, mixed, private_name, stage, text_runs, window_hashes

#: Bytes of text whose windows a task looks at together.
RUN_BYTES = 8_000_000
#: Stands for a NULL id: before all others.
NO_ID = -(2**63)


def windows_of(ends: np.ndarray, length: int) -> np.ndarray:
    """Places where a window of ``length`` words inside one text begins."""
    counts = np.diff(ends)
    starts = np.arange(ends[-1])
    return starts[np.repeat(ends[1:], counts) - starts >= length]


def anchors(words: np.ndarray, at: np.ndarray, level: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted window (beginning at ``at``): the place and hash of the smallest window of ``level`` words in it."""
    hashes = window_hashes(words, level)
    if not len(at):
        return at, np.empty(0, np.uint64)
    best, place = hashes[at].copy(), at.copy()
    for shift in range(1, length - level + 1):
        other = hashes[at + shift]
        less = other < best
        best[less] = other[less]
        place[less] = at[less] + shift
    return place, best


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _levels(length: int, first: int) -> list[int]:
    """Window lengths below ``length``: halves of it, rounded down, of ``first`` words or more."""
    out = []
    while length // 2 >= first:
        length //= 2
        out.append(length)
    return out[::-1]


def _selected(words: np.ndarray, ends: np.ndarray, length: int, level: int, done: list[int], survivors: list[np.ndarray | None] | None):
    """Wanted windows left by the levels ``done`` and, for each, its document and its anchor at ``level``."""
    at = windows_of(ends, length)
    doc = np.searchsorted(ends, at, "right") - 1
    if survivors is not None:
        _, best = anchors(words, at, done[-1], length)
        keep = np.zeros(len(at), bool)
        edges = np.searchsorted(doc, np.arange(len(survivors) + 1))
        for own, start, end in zip(survivors, edges[:-1].tolist(), edges[1:].tolist()):
            if own is not None and end > start:
                keep[start:end] = np.isin(best[start:end], own)
        at, doc = at[keep], doc[keep]
    return at, doc, anchors(words, at, level, length)


def _left_hashes(column: pa.Array) -> list[np.ndarray | None]:
    return [None if x is None else np.array(x, np.int64).view(np.uint64) for x in column.to_pylist()]


def _level_rows(level: int, length: int, done: list[int]):
    """For a level: (hash, document key, salt, known) of each anchor; ``known``: repeated inside the batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches, RUN_BYTES):
            words, ends = hashed_words(binary_list(batch.column("text")), False)
            survivors = _left_hashes(batch.column("left")) if done else None
            at, doc, (place, best) = _selected(words, ends, length, level, done, survivors)
            _, chosen = np.unique(place, return_index=True)
            best, doc = best[chosen], doc[chosen]
            keys = batch.column("key").to_numpy(zero_copy_only=False)[doc]
            order = np.lexsort((keys, best))
            best, keys = best[order], keys[order]
            new = np.ones(len(best), bool)
            new[1:] = best[1:] != best[:-1]
            group = np.cumsum(new) - 1
            known = np.bincount(group)[group] > 1 if len(best) else new
            # one row of each hash meets the other batches; known ones only need to reach their document
            fresh = new.copy()
            fresh[1:] |= keys[1:] != keys[:-1]
            send = new | fresh
            salt = np.where(new, 0, (mixed(keys.view(np.uint64)) >> np.uint64(58)).astype(np.int64) + 1)
            yield pa.RecordBatch.from_arrays(
                [_signed(best[send]), pa.array(keys[send], pa.int64()), pa.array(salt[send].astype(np.int8)), pa.array(known[send])],
                ["hash", "key", "salt", "known"],
            )
    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (salt, hash): those known, and those whose hash another row of salt 0 has."""
    held: pa.RecordBatch | None = None
    last = None

    def judged(batch: pa.RecordBatch, before, after) -> pa.RecordBatch:
        hashes = batch.column("hash").to_numpy()
        salts = batch.column("salt").to_numpy()
        same = (hashes[1:] == hashes[:-1]) & (salts[1:] == 0) & (salts[:-1] == 0)
        keep = batch.column("known").to_numpy(zero_copy_only=False).copy()
        keep[1:] |= same
        keep[:-1] |= same
        if before is not None and before == (hashes[0], salts[0]) and salts[0] == 0:
            keep[0] = True
        if after is not None and after == (hashes[-1], salts[-1]) and salts[-1] == 0:
            keep[-1] = True
        return batch.select(["hash", "key"]).filter(pa.array(keep))

    for batch in batches:
        if not batch.num_rows:
            continue
        first = (batch.column("hash")[0].as_py(), batch.column("salt")[0].as_py())
        if held is not None:
            yield judged(held, last, first)
            last = (held.column("hash")[-1].as_py(), held.column("salt")[-1].as_py())
        held = batch
    if held is not None:
        yield judged(held, last, None)


WINDOWS = "hash long, id long, key long, start long, size long, salt byte"


def _window_rows(length: int, done: list[int]):
    """Surviving wanted windows. Not the first of their kind in the batch: runs of beginnings to remove, under a salt."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches, RUN_BYTES):
            words, ends = hashed_words(binary_list(batch.column("text")), False)
            survivors = _left_hashes(batch.column("left")) if done else None
            at, doc, (_, best) = _selected(words, ends, length, length, done, survivors)
            ids = batch.column("id").to_numpy(zero_copy_only=False)[doc]
            keys = batch.column("key").to_numpy(zero_copy_only=False)[doc]
            start = at - ends[doc]
            order = np.lexsort((start, keys, ids, best))
            first = np.ones(len(order), bool)
            first[1:] = best[order][1:] != best[order][:-1]
            lead = order[first]
            # a repeated row has the same windows at the same places: none of these starts earlier
            held = lead[np.cumsum(first) - 1]
            tied = (ids[order] == ids[held]) & (keys[order] == keys[held]) & (start[order] == start[held])
            rest = np.sort(order[~tied])  # in order of documents and beginnings
            edge = np.ones(len(rest), bool)
            edge[1:] = (at[rest][1:] != at[rest][:-1] + 1) | (doc[rest][1:] != doc[rest][:-1])
            heads = rest[edge]
            sizes = np.diff(np.append(np.flatnonzero(edge), len(rest)))
            salt = (mixed(keys[heads].view(np.uint64)) >> np.uint64(58)).astype(np.int8) + 1
            yield pa.RecordBatch.from_arrays([
                _signed(np.concatenate([best[lead], mixed(keys[heads].view(np.uint64))])),
                pa.array(np.concatenate([ids[lead], ids[heads]]), pa.int64()), pa.array(np.concatenate([keys[lead], keys[heads]]), pa.int64()),
                pa.array(np.concatenate([start[lead], start[heads]]), pa.int64()),
                pa.array(np.concatenate([np.ones(len(lead), np.int64), sizes]), pa.int64()),
                pa.array(np.concatenate([np.zeros(len(lead), np.int8), salt.astype(np.int8)]), pa.int8()),
            ], ["hash", "id", "key", "start", "size", "salt"])
    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by (salt, hash, id, key, start): those that start later than the first of their hash; salted runs as they are."""
    head = None
    for batch in batches:
        if not batch.num_rows:
            continue
        salts = batch.column("salt").to_numpy()
        rows = np.stack([salts.astype(np.int64), *(batch.column(c).to_numpy() for c in ("hash", "id", "key", "start"))])
        new = np.ones(batch.num_rows, bool)
        new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
        new[0] = head is None or (head[:2] != rows[:2, 0]).any()
        group = np.cumsum(new)  # 0: the hash the batch before ended with
        heads = np.concatenate([(rows[:, :1] if head is None else head[:, None]), rows[:, new]], axis=1)
        keep = (salts > 0) | (rows[2:] != heads[2:, group]).any(axis=0)
        head = heads[:, -1]
        yield batch.select(["key", "start", "size"]).filter(pa.array(keep))


def remove_repeats(
    docs: DataFrame, length: int = 20, first_level: int = 10, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True,
) -> DataFrame:
    """Adds ``n_words``, ``n_removed`` and ``kept_text`` (kept words, one space between) to ``docs``.

    A word goes if a window of ``length`` words over it also starts earlier: at a smaller id (NULL
    before all), or earlier in the same document; all windows are judged on the input. Rows with the
    same id count in the order of a hash of their text; rows with the same id and text are one document:
    they do not count as repeats of each other, and each of them gets the same result. NULL, empty and short texts have no windows and lose nothing.
    Columns of the names added here are replaced, all others pass through.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_words", "n_removed", "kept_text")])
    own_key, gone_key, gone_col = (private_name(docs, n) for n in ("_own", "_key", "_gone"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    key = F.xxhash64("id", "text")
    left, done = rows.select("id", key.alias("key"), "text"), []
    for level in _levels(length, first_level):
        found = arrow_map(left, _level_rows(level, length, list(done)), "hash long, key long, salt byte, known boolean")
        met = found.repartition("hash", "salt").sortWithinPartitions("salt", "hash")
        again = stage(arrow_map(met, _repeated, "hash long, key long"), "repeated")
        by_doc = again.groupBy(F.col("key").alias("_key")).agg(F.collect_set("hash").alias("left"))
        # a document's own windows: as many as it has words at most
        left = rows.select("id", key.alias("key"), "text").join(by_doc, F.col("key") == F.col("_key")).drop("_key")
        done.append(level)
    windows = arrow_map(left, _window_rows(length, list(done)), WINDOWS)
    met = windows.repartition("hash", "salt").sortWithinPartitions("salt", "hash", "id", "key", "start")
    later = arrow_map(met, _later, "key long, start long, size long")
    gone = stage(later.groupBy(F.col("key").alias(gone_key)).agg(F.collect_list(F.struct("start", "size")).alias(gone_col)), "gone")
    keyed = docs.withColumn(own_key, F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.col(text_col)))
    joined = keyed.join(gone, F.col(own_key) == F.col(gone_key), "left").drop(own_key, gone_key)
    kept = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(text_col).cast(pa.binary()), batch.column(gone_col)
            counts, removed, out = [], [], []
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or b"").split()
                own = spans[i].as_py()
                counts.append(len(words))
                if own:
                    covered = np.zeros(len(words) + 1, np.int64)
                    starts = np.array([s["start"] for s in own])
                    np.add.at(covered, starts, 1)
                    np.add.at(covered, starts + np.array([s["size"] for s in own]) + length - 1, -1)
                    stay = np.cumsum(covered)[:-1] == 0
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                removed.append(counts[-1] - len(words))
                out.append(b" ".join(words))
            columns = [*(batch.column(n) for n in names), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_words", "n_removed", "kept_text"])

    schema = docs.select(*names).withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept_text": F.lit("")}).schema
    return arrow_map(joined, run, schema)
