"""Ranked lexical search: MaxScore whose bounds come from pairs of terms.

The index is made of blocks of documents that no other block needs: term dictionary, postings,
term frequencies and lengths, built where the documents are read. Once the corpus counts are
known, the postings of the terms in question become impacts, and each block gets its pair
table: for the terms most of its documents hold, the intersection of every two lists (as a
bitmap) with the largest joint impact. Both indexes are stored tables.

A query meets a block with the score its k-th document has so far. Terms are taken singly or as
disjoint pairs, pairs first where the joint maximum is further below the sum of the two maxima.
The units with the smallest bounds that together stay below that score are not essential: only
documents of the other lists are candidates, and a candidate is dropped as soon as its score
and the bounds of what is left (for a pair: the joint maximum only if the candidate is in the
intersection) stay below it. Bounds are never below what a document can reach, and a document
that ties is not dropped, so results are those of scoring everything.

A term's weight is ``floor(1000 ln((2N+2)/(2df+1)))``, its part of the score the weight times
``(10^9 tf) div (1000 tf + 12 m)`` with ``m = 75 + (25 n N) div L``.

Edge cases: NULL and empty texts are no documents and ask for nothing; a NULL id is an id and
sorts first; repeated rows of documents are ranked each, repeated rows of queries count once;
queries without a term that occurs give no rows; very long texts are read in slices and make a
block of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerrecon.llm.common import arrow_map, stage, text_runs

#: Bytes of text in one block of the index.
BLOCK_BYTES = 8_000_000
#: Bytes of one text split into words at once.
SLICE_BYTES = 1_000_000
#: Terms of queries searched for in one pass over the index (about; more queries make more passes).
PASS_TERMS = 200_000
#: Frequent terms of a block that its pair table covers.
PAIRED_TERMS = 32
# digits, letters and all bytes of other characters are kept, A-Z in lower case, all else a blank
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, some at a time."""
    start = 0
    while start < len(text):
        end = text.find(b" ", start + SLICE_BYTES)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


class _Numbers(dict):
    """Numbers words in the order they come up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _packed(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs."""
    top = int(values.max()) if len(values) else 0
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def _unpacked(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // count}" if count else "<u1").astype(np.int64)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_runs(batches, BLOCK_BYTES):
        numbers, parts, lengths = _Numbers(), [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            found = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in _slices((text or b"").translate(_TERM_BYTES))]
            parts += found
            lengths.append(sum(map(len, found)))
        if not numbers:
            continue
        rows = len(lengths)
        of_row = np.repeat(np.arange(rows), lengths)
        keys, tf = np.unique(np.concatenate(parts) * rows + of_row, return_counts=True)
        df = np.bincount(keys // rows, minlength=len(numbers))
        yield pa.RecordBatch.from_pydict({
            "ids": [batch.column("id").to_pylist()], "lengths": [_packed(np.array(lengths))], "terms": [[w.decode() for w in numbers]],
            "df": [df.tolist()], "docs": [_packed(keys % rows)], "tf": [_packed(tf)],
            "n_docs": [sum(n > 0 for n in lengths)], "n_terms": [sum(lengths)],
        }, schema=_INDEX_ARROW)


_INDEX = "ids array<long>, lengths binary, terms array<string>, df array<long>, docs binary, tf binary, n_docs long, n_terms long"
_INDEX_ARROW = pa.schema([
    ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("terms", pa.list_(pa.string())), ("df", pa.list_(pa.int64())),
    ("docs", pa.binary()), ("tf", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64())])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents with their dictionaries and postings, for ids that are whole numbers."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return arrow_map(rows, _index, _INDEX)


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_runs(batches):
        for query, text in zip(batch.column("query").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            repeats: dict[bytes, int] = {}
            for words in _slices((text or b"").translate(_TERM_BYTES)):
                for word in words:
                    repeats[word] = repeats.get(word, 0) + 1
            if repeats:
                yield pa.RecordBatch.from_pydict({"query": pa.array([query] * len(repeats), pa.int64()), "term": [w.decode() for w in repeats],
                                                  "repeats": pa.array(repeats.values(), pa.int64())})


class Block(NamedTuple):
    """One block as a search needs it; lists by term, pair facts by pair of terms."""

    rows: int
    lists: dict[str, tuple[np.ndarray, np.ndarray]]
    maxima: dict[str, int]
    joint: dict[tuple[str, str], tuple[int, np.ndarray]]


_IMPACTS = ("ids array<long>, terms array<string>, df array<long>, docs binary, impacts binary, "
            "pair_a array<int>, pair_b array<int>, pair_max array<long>, pair_docs array<binary>")


def _impacts(weights: dict[str, int], documents: int, terms_in_all: int):
    """Blocks with the impacts of the weighted terms and their pair table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = len(row["ids"])
                m = 75 + (25 * _unpacked(row["lengths"], rows) * documents) // terms_in_all
                df = np.array(row["df"], np.int64)
                ends = np.cumsum(df)
                docs, tf = _unpacked(row["docs"], int(df.sum())), _unpacked(row["tf"], int(df.sum()))
                kept, lists = [], []
                for i, term in enumerate(row["terms"]):
                    if weights.get(term):
                        at = slice(ends[i] - df[i], ends[i])
                        kept.append(i)
                        lists.append((docs[at], (1_000_000_000 * tf[at]) // (1000 * tf[at] + 12 * m[docs[at]])))
                if not kept:
                    continue
                terms = [row["terms"][i] for i in kept]
                # terms that most documents hold; among equals the first
                frequent = np.argsort(-df[kept], kind="stable")[:PAIRED_TERMS].tolist()
                dense = np.zeros((len(frequent), rows), np.int64)
                for line, i in zip(dense, frequent):
                    line[lists[i][0]] = weights[terms[i]] * lists[i][1]
                pairs = []
                for x, a in enumerate(frequent):
                    for y in range(x + 1, len(frequent)):
                        shared = (dense[x] > 0) & (dense[y] > 0)
                        top = int((dense[x] + dense[y])[shared].max()) if shared.any() else 0
                        pairs.append((a, frequent[y], top, np.packbits(shared).tobytes()))
                columns = list(zip(*pairs)) or [()] * 4
                yield pa.RecordBatch.from_pydict({
                    "ids": [row["ids"]], "terms": [terms], "df": [df[kept].tolist()],
                    "docs": [_packed(np.concatenate([d for d, _ in lists]))], "impacts": [_packed(np.concatenate([x for _, x in lists]))],
                    "pair_a": pa.array([columns[0]], pa.list_(pa.int32())), "pair_b": pa.array([columns[1]], pa.list_(pa.int32())),
                    "pair_max": pa.array([columns[2]], pa.list_(pa.int64())), "pair_docs": pa.array([columns[3]], pa.list_(pa.binary())),
                })

    return run


def _opened(row: dict, weights: dict[str, int]) -> Block:
    terms, df = row["terms"], np.array(row["df"], np.int64)
    docs, impacts = _unpacked(row["docs"], int(df.sum())), _unpacked(row["impacts"], int(df.sum()))
    edges = np.concatenate([[0], np.cumsum(df)])
    lists = {t: (docs[a:b], weights[t] * impacts[a:b]) for t, a, b in zip(terms, edges[:-1].tolist(), edges[1:].tolist())}
    joint = {}
    for a, b, top, bits in zip(row["pair_a"], row["pair_b"], row["pair_max"], row["pair_docs"]):
        joint[terms[a], terms[b]] = joint[terms[b], terms[a]] = (top, bits)
    return Block(len(row["ids"]), lists, {t: int(x.max()) for t, (_, x) in lists.items()}, joint)


def _units(block: Block, query: dict[str, int], use_pairs: bool) -> list[tuple[int, tuple[str, ...], int]]:
    """(bound, terms, joint bound) of disjoint pairs and single terms, smallest bound first."""
    alone = {t: n * block.maxima[t] for t, n in query.items() if t in block.lists}
    saved = []
    if use_pairs:
        paired = {t for pair in block.joint for t in pair}
        names = [t for t in alone if t in paired]
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                if (a, b) in block.joint:
                    both = min(query[a], query[b])
                    together = both * block.joint[a, b][0] + (query[a] - both) * block.maxima[a] + (query[b] - both) * block.maxima[b]
                    together = together if block.joint[a, b][0] else 0
                    bound = max(alone[a], alone[b], together)
                    if bound < alone[a] + alone[b]:
                        saved.append((alone[a] + alone[b] - bound, bound, a, b, together))
    units, taken = [], set()
    for _, bound, a, b, together in sorted(saved, reverse=True):
        if a not in taken and b not in taken:
            taken |= {a, b}
            units.append((bound, (a, b), together))
    units += [(bound, (t,), bound) for t, bound in alone.items() if t not in taken]
    return sorted(units)


def search_block(block: Block, query: dict[str, int], least: int, use_pairs: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of a block that score ``least`` or more (and above 0), their scores, and how many rows were looked at.

    ``query`` has terms with their repeats.
    """
    units = _units(block, query, use_pairs)
    bounds = np.cumsum([u[0] for u in units]) if units else np.empty(0, np.int64)
    first = int(np.searchsorted(bounds, least, "left"))  # units before it stay below together
    score = np.zeros(block.rows, np.int64)
    for _, terms, _ in units[first:]:
        for term in terms:
            docs, impacts = block.lists[term]
            score[docs] += query[term] * impacts
    rows = np.flatnonzero(score)
    looked = len(rows)
    for i in range(first - 1, -1, -1):
        bound, terms, together = units[i]
        reach = np.full(len(rows), bound, np.int64)
        if len(terms) == 2:
            single = max(query[t] * block.maxima[t] for t in terms)
            inside = np.unpackbits(np.frombuffer(block.joint[terms][1], np.uint8), count=block.rows)[rows] > 0
            reach = np.where(inside, together, single)
        rest = int(bounds[i - 1]) if i else 0
        rows = rows[score[rows] + reach + rest >= least]
        if not len(rows):
            break
        for term in terms:
            docs, impacts = block.lists[term]
            part = np.zeros(block.rows, np.int64)
            part[docs] = query[term] * impacts
            score[rows] += part[rows]
    rows = rows[score[rows] >= max(least, 1)]
    return rows, score[rows], looked


class Best:
    """The k best rows of a query so far: highest score, then smallest id (none before all)."""

    def __init__(self, k: int):
        self.k, self.score, self.known, self.id = k, np.empty(0, np.int64), np.empty(0, np.int8), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, score: np.ndarray, ids: list[int | None]) -> None:
        known = np.array([i is not None for i in ids], np.int8)
        self.score = np.concatenate([self.score, score])
        self.known = np.concatenate([self.known, known])
        self.id = np.concatenate([self.id, np.array([i or 0 for i in ids], np.int64)])
        order = np.lexsort((self.id, self.known, -self.score))[: self.k]
        self.score, self.known, self.id = self.score[order], self.known[order], self.id[order]


def _searcher(queries: dict[int, dict[str, int]], weights: dict[str, int], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {q: Best(k) for q in queries}
        for batch in batches:
            for row in batch.to_pylist():
                block = _opened(row, weights)
                for q, query in queries.items():
                    rows, score, _ = search_block(block, query, best[q].least)
                    if len(rows):
                        best[q].add(score, [row["ids"][i] for i in rows.tolist()])
        for q, found in best.items():
            if len(found.score):
                yield pa.RecordBatch.from_pydict({
                    "query": pa.array([q] * len(found.score), pa.int64()), "doc_id": pa.array(found.id, mask=found.known == 0),
                    "score": pa.array(found.score)})

    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """The ``k`` best documents of each item: item id, rank, doc_id, score (above 0).

    Queries are taken in passes of about ``PASS_TERMS`` terms, so what the driver and a task hold of
    them does not grow with their number. Tops of single tasks, k rows for a query each, are merged by Spark.
    """
    index = stage(build_index(docs, id_col), "index")
    asked = items.select(F.col(f"`{item_col}`").alias("item"), F.col("text")).distinct().withColumn(
        "query", F.xxhash64(F.col("item").cast("string"), F.col("item").isNull(), "text"))
    asked = stage(asked, "queries")
    totals = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).head()
    documents, terms_in_all = totals["docs"] or 0, totals["terms"] or 1
    wanted = stage(arrow_map(asked.select("query", "text"), _query_terms, "query long, term string, repeats long"), "wanted")
    held = index.select(F.inline(F.arrays_zip("terms", F.col("df").alias("df")))).join(
        wanted.select(F.col("term").alias("terms")).distinct(), "terms", "left_semi")
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = held.groupBy(F.col("terms").alias("term")).agg(F.sum("df").alias("df")).select("term", weight.alias("weight"))
    passes = max(1, -(-wanted.count() // PASS_TERMS))
    ready = stage(wanted.join(weighed, "term").where("weight > 0").withColumn("pass", F.pmod(F.xxhash64("query"), F.lit(passes))), "ready")
    found = None
    for number in range(passes):
        queries: dict[int, dict[str, int]] = {}
        weights: dict[str, int] = {}
        for row in ready.where(F.col("pass") == number).toLocalIterator():
            queries.setdefault(row["query"], {})[row["term"]] = row["repeats"]
            weights[row["term"]] = row["weight"]
        impacts = stage(arrow_map(index, _impacts(weights, documents, terms_in_all), _IMPACTS), "impacts")
        tops = stage(arrow_map(impacts, _searcher(queries, weights, k), "query long, doc_id long, score long"), "tops")
        found = tops if found is None else found.union(tops)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("query", "item"), "query").select(
        F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
