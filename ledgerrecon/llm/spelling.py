"""Spelling variants: words one code point apart, found on a trie that is a table.

The vocabulary is held twice, as it is and reversed, in a trie without unary nodes: a node
is a prefix under which words go on in different ways or end. Its edges (node, first
character, label, child, whether a word ends there) are a distributed table.

Two words one edit apart share everything before the edit and everything after it, so from
either word's view the edit lies in the latter half of the word or of the reversed word. A
state is (word, position, node, edits). States without edits are a word's own nodes in its
latter half: a walk without edits cannot leave them. Joining these with the edges that turn
off the word's own path makes the one edit (replace, insert or delete), and from then on the
frontier is joined with the edges level by level, each time by node and next character. A
state whose word is used up at a node where a word ends is a neighbour. The rounds end when
no state is left; a frontier is written before the next one is made.

Prefixes are told apart by 64-bit hashes. No group is collected: a node that very many words
pass is met by an aggregation with a map side part and by sort-merge joins, whose hot keys
adaptive execution splits.

Edge cases: NULL and empty texts have no words; a NULL id counts as an empty one; repeated
rows count as often as they occur; a word is as long as it is (prefix hashes are summed up,
not made anew for each prefix); no words, or no neighbours, give empty or neighbourless rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerrecon.llm.common import arrow_map, mixed, stage, text_runs
from ledgerrecon.session import remove_path, shared_path

#: Distinct words a task holds before it hands their counts on.
HELD_WORDS = 200_000
#: Bytes of words whose prefixes are laid out at once.
LAID_BYTES = 500_000
# A-Z in lower case, a-z and U+00C0 to U+00FF as they are, all else a blank
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _counter(min_length: int, drop_every: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[bytes, int] = {}

        def flushed() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in tally], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(tally.values(), pa.int64())], ["word", "n"])

        for batch in text_runs(batches):
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                seed = zlib.crc32(f"{key}:".encode())
                # code points above U+00FF are no letters here, and so as good as "?"
                for word, n in Counter(text.encode("latin-1", "replace").translate(_LETTERS).split()).items():
                    if len(word) < min_length:
                        continue
                    if drop_every:
                        code = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
                        if code % drop_every == 0:
                            at = code % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_length:
                                continue
                    tally[word] = tally.get(word, 0) + n
            if len(tally) > HELD_WORDS:
                yield flushed()
                tally = {}
        if tally:
            yield flushed()

    return run


def count_words(docs: DataFrame, min_length: int = 7, min_count: int = 2, drop_every: int | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n``: maximal runs of letters (A-Z in lower case) of whole texts with their occurrences.

    ``drop_every`` plants typing errors: a run of a document whose CRC-32 of ``id:run`` it divides
    loses one code point.
    """
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("key"), F.col(f"`{text_col}`").alias("text"))
    counted = arrow_map(rows, _counter(min_length, drop_every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _prefixes(shallowest: int):
    """(node, id, side, depth, next) for the prefixes of each word from ``shallowest`` on; ``next`` is 0 where the word ends."""
    factor = np.uint64(0x9E3779B97F4A7C15)

    def laid(ids: list[int], words: list[str]) -> pa.RecordBatch:
        lengths = np.array([len(w) for w in words])
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        owner = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(text)) - starts[owner]
        columns = []
        for side in (0, 1):
            chars = text if side == 0 else text[starts[owner] + lengths[owner] - 1 - place]
            with np.errstate(over="ignore"):
                # sum of (character value * factor ** place): one value for each prefix
                powers = np.cumprod(np.full(int(lengths.max()), factor))
                terms = mixed(chars.astype(np.uint64) + np.uint64(1)) * powers[place]
                total = np.cumsum(terms)
                before = np.concatenate([[np.uint64(0)], total])[starts]
                node = mixed(total - before[owner] + np.uint64(side))
            following = np.append(chars[1:], np.uint32(0))
            following[ends - 1] = 0
            keep = place + 1 >= shallowest
            columns.append((node[keep].view(np.int64), np.array(ids, np.int64)[owner[keep]], np.full(int(keep.sum()), side, np.int32),
                            (place[keep] + 1).astype(np.int32), following[keep].astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*columns)], ["node", "id", "side", "depth", "next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words, size = [], [], 0
            for key, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist()):
                ids.append(key)
                words.append(word)
                size += len(word)
                if size >= LAID_BYTES:
                    yield laid(ids, words)
                    ids, words, size = [], [], 0
            if words:
                yield laid(ids, words)

    return run


def _from(text: Column, start: Column | int, size: Column | None = None) -> Column:
    """Code points of ``text`` from ``start`` (0-based) on, at most ``size``."""
    return F.substring(text, F.lit(start) + 1, F.lit(2**31 - 1) if size is None else size)


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tries of a stored table of distinct (id, word): edges, and each word's own nodes in its latter half.

    Edges: node, first, label, child, ends (a word ends at the child), nexts (first characters of the
    child's edges). Own nodes: id, node, rest (what the word still has after the node).
    """
    # no word looks at a node above its middle, so the tries begin at the middle of the shortest one
    shortest = words.agg(F.min(F.length("word"))).head()[0] or 2
    laid = stage(arrow_map(words.select("id", "word"), _prefixes(max(1, shortest // 2)), "node long, id long, side int, depth int, next int"), "prefixes")
    nodes = laid.groupBy("node").agg(F.min("next").alias("low"), F.max("next").alias("high"))
    # a prefix that ends a word, or goes on in two ways
    nodes = nodes.where((F.col("low") == 0) | (F.col("low") != F.col("high"))).select("node")
    own = laid.join(nodes, "node").groupBy("id", "side").agg(
        F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("path"))  # no longer than the word
    w = F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word"))
    paths = stage(words.join(own, "id").select("id", w.alias("w"), F.length("word").alias("size"), "path"), "paths")
    step = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(
        F.get("path", i - 1).alias("a"), F.get("path", i).alias("b")))
    steps = paths.where(F.size("path") > 1).select("w", "size", F.inline(step))
    edges = steps.select(
        F.col("a.node").alias("node"), F.col("b.node").alias("child"),
        _from(F.col("w"), F.col("a.depth"), F.col("b.depth") - F.col("a.depth")).alias("label"),
        (F.col("b.depth") == F.col("size")).alias("ends"),
    ).groupBy("node", "child").agg(F.min("label").alias("label"), F.max("ends").alias("ends"))
    edges = stage(edges.withColumn("first", F.substring("label", 1, 1)), "branches")
    nexts = edges.groupBy(F.col("node").alias("child")).agg(F.concat_ws("", F.collect_list("first")).alias("nexts"))  # an alphabet at most
    edges = edges.join(nexts, "child", "left").select("node", "first", "label", "child", "ends", F.coalesce("nexts", F.lit("")).alias("nexts"))
    latter = F.filter("path", lambda p: p["depth"] * 2 >= F.col("size") - 1)
    starts = paths.select("id", "w", F.inline(latter)).select("id", "node", _from(F.col("w"), F.col("depth")).alias("rest"))
    return stage(edges, "edges"), stage(starts, "starts")


def _alive(rest: Column) -> Column:
    """The word is used up where a word ends, or the child has an edge that begins as it goes on."""
    return F.when(rest == "", F.col("ends")).otherwise(F.instr(F.col("nexts"), F.substring(rest, 1, 1)) > 0)


def near_ids(words: DataFrame) -> DataFrame:
    """``id`` and ``near_id``: all ordered pairs of words that differ by one inserted, deleted or replaced code point.

    ``words`` is a stored table of distinct (id, word), of words with at least 2 code points. A pair is found
    once, from the shorter word, or from the one with the smaller code point at the edit.
    """
    spark = words.sparkSession
    edges, starts = trie(words)
    rest, label = F.col("rest"), F.col("label")
    more = F.length("label")
    # where an edge turns off: its label after the edited code point must be how the word goes on
    replaced = (F.col("first") > F.substring(rest, 1, 1)) & (rest != "") & (_from(label, 1) == _from(rest, 1, more - 1))
    inserted = _from(label, 1) == _from(rest, 0, more - 1)
    after_replaced, after_inserted = _from(rest, more), _from(rest, more - 1)
    takes = (replaced & _alive(after_replaced), inserted & _alive(after_inserted))
    turns = starts.join(edges, (starts.node == edges.node) & (F.col("first") != F.substring(rest, 1, 1)) & (takes[0] | takes[1]))
    rests = F.array_compact(F.array(F.when(takes[0], after_replaced), F.when(takes[1], after_inserted)))
    states = turns.select("id", F.col("child").alias("node"), F.explode(rests).alias("rest"))
    path, done = shared_path(spark, "neighbours"), []
    while True:
        states = stage(states, f"states-{len(done)}")
        done.append(f"{path}/level={len(done)}")
        states.where("rest = ''").select("id", "node").write.parquet(done[-1])
        frontier = states.where("rest <> ''")
        if frontier.isEmpty():
            break
        ahead = frontier.withColumn("first", F.substring("rest", 1, 1)).join(edges, ["node", "first"]).where(
            (label == F.substring(rest, F.lit(1), more)) & _alive(_from(rest, more)))
        states = ahead.select("id", F.col("child").alias("node"), _from(rest, more).alias("rest"))
    ended = starts.where("rest = ''").select("node", F.col("id").alias("near_id"))
    pairs = spark.read.schema("id long, node long").parquet(*done).join(ended, "node").select("id", "near_id").distinct()
    both = F.array(F.struct("id", "near_id"), F.struct(F.col("near_id").alias("id"), F.col("id").alias("near_id")))
    return pairs.select(F.inline(both))


def group_variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """Each word with its form and root.

    ``words`` has distinct ``word`` and its occurrences ``n``. A word's form is its near word with the
    largest ``n`` (ties: smallest in code-point order) if that is at least ``factor`` (2 or more) times
    its own, else NULL; the root is where the forms end, or the word itself. Returns word, n, n_near,
    form, form_n, root.
    """
    words = stage(words.select(F.xxhash64("word").alias("id"), "word", "n"), "words")
    other = words.select(F.col("id").alias("near_id"), F.col("word").alias("near"), F.col("n").alias("m"))
    best = near_ids(words).join(other, "near_id").groupBy("id").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("order"), F.col("near"), F.col("m"))).alias("best"))
    takes = F.col("best.m") >= factor * F.col("n")
    formed = stage(words.join(best, "id", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, F.col("best.near")).alias("form"), F.when(takes, F.col("best.m")).alias("form_n")), "forms")
    # every step multiplies n by the factor, so chains are short, and each round doubles the steps taken
    roots = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved"))
    while True:
        roots = stage(roots, "roots")
        if roots.where("moved").isEmpty():
            break
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        roots = roots.join(further, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
    return formed.join(roots.drop("moved"), "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
