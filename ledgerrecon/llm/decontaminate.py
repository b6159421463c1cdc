"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of all items (one block of bounded size at a time) form one automaton.
The words of a document run through it: a state and the length of the longest item
passage that ends at this word. Whenever that length reaches a window, the words of
the window are hit. Nothing is shuffled: each block passes over the documents as
part of the same scan.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerrecon.llm.common import arrow_map, clear, held, private_name, set_aside, stage

#: Words of benchmark items in one automaton, and so the bound on what an executor is sent.
BLOCK_WORDS = 100_000
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def item_words(text: bytes | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, all ASCII but letters and digits between them."""
    return text.translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """All passages of the items; ``fires`` has the shortest window that ends in a state.

    ``step`` maps ``state * n_words + word`` to the next state.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.words: dict[bytes, int] = {}
        for _, words in items:
            for word in words:
                self.words.setdefault(word, len(self.words))
        self.size = max(1, len(self.words))
        self.step: dict[int, int] = {}
        self.link, self.length, self.edges = [-1], [0], [{}]
        ends: list[list[tuple[int, int]]] = [[]]
        for index, (_, words) in enumerate(items):
            last = 0
            for word in words:
                last = self._extend(last, self.words[word])
                while len(ends) < len(self.link):
                    ends.append([])
                ends[last].append((index, len(words)))
        self._mark(items, ends, window)
        for state, edges in enumerate(self.edges):
            for word, target in edges.items():
                self.step[state * self.size + word] = target
        del self.edges

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.edges.append(edges)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, state: int, word: int) -> int:
        """The state that ``word`` leads to, holding no passage longer than by one word."""
        target = self.edges[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1, dict(self.edges[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.edges[state].get(word) == target:
            self.edges[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.edges[last]:
            return self._split(last, word)
        new, state = self._state(self.length[last] + 1, {}, 0), last
        while state >= 0 and word not in self.edges[state]:
            self.edges[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word)
        return new

    def _mark(self, items: list[tuple[str, list[bytes]]], ends: list[list[tuple[int, int]]], window: int) -> None:
        """Finds the state of each window and which items have it; hands both down to longer passages."""
        n = len(self.link)
        own: list[dict[int, set[int]]] = [{} for _ in range(n)]
        whole = {}
        for index, (_, words) in enumerate(items):
            state = 0
            for word in words:
                state = self.edges[state][self.words[word]]
            whole[index] = state
        ends += [[] for _ in range(n - len(ends))]
        for state, here in enumerate(ends):
            for index, n_words in here:
                size = min(window, n_words)
                if n_words < window and whole[index] != state:
                    continue
                at = state
                while self.length[self.link[at]] >= size and at:
                    at = self.link[at]
                if self.length[at] >= size:
                    own[at].setdefault(size, set()).add(index)
        self.windows: list[tuple[tuple[int, tuple[int, ...]], ...]] = [()] * n
        for state in sorted(range(n), key=self.length.__getitem__):
            above = self.windows[self.link[state]] if state else ()
            self.windows[state] = above + tuple((size, tuple(sorted(own[state][size]))) for size in sorted(own[state]))
        self.fires = [w[0][0] if w else 1 << 60 for w in self.windows]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit runs of words (from, to) and the items whose windows occur."""
        step, link, length, fires, size = self.step, self.link, self.length, self.fires, self.size
        runs: list[tuple[int, int]] = []
        found: set[int] = set()
        state = matched = 0
        for at, word in enumerate(map(self.words.get, words)):
            if word is None:
                state = matched = 0
                continue
            target = step.get(state * size + word)
            while target is None and state:
                state = link[state]
                matched = length[state]
                target = step.get(state * size + word)
            if target is None:
                continue
            state = target
            matched += 1
            if matched >= fires[state]:
                for window, items in self.windows[state]:
                    if matched >= window:
                        found.update(items)
                        longest = window
                start = at + 1 - longest
                if runs and start <= runs[-1][1]:
                    while len(runs) > 1 and start <= runs[-2][1]:
                        runs.pop(-2)
                    runs[-1] = (min(start, runs[-1][0]), at + 1)
                else:
                    runs.append((start, at + 1))
        return runs, found


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of ``BLOCK_WORDS`` words, one row at a time through the driver."""
    block, total = [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    for row in rows.toLocalIterator():
        words = item_words(bytes(row["text"]) if row["text"] is not None else None)
        if not words or row["item"] is None:
            continue
        block.append((row["item"], words))
        total += len(words)
        if total >= BLOCK_WORDS:
            yield block
            block, total = [], 0
    if block:
        yield block


def find_passages(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", keep_text: bool = True,
) -> DataFrame:
    """Adds ``n_words``, ``hit_runs`` (array of [from, to) word runs) and ``hit_items`` (sorted item ids) to ``docs``.

    A window is ``window`` consecutive words of an item, or a whole shorter item.
    NULL and empty texts have no words and no hits; items without words, and items
    without an id, are no items; repeated items count by their id. Repeated rows are
    judged each by itself, and other columns pass through: columns of the names added
    here are replaced. An empty benchmark hits nothing. ``keep_text=False`` leaves the text out.
    """
    return _scanned(docs, benchmark, window, text_col, item_col, item_text_col, keep_text)


def _scanned(
    docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, item_col: str, item_text_col: str,
    keep_text: bool = True, cut: bool = False,
) -> DataFrame:
    """What ``find_passages`` gives; with ``cut``, texts have lost their ``hit_runs``, and what those cuts brought together.

    The worker that scans a text cuts it as well: a second pass of its own in the same tasks would take as many workers
    again, and all of them stay. With several blocks of items the last one's pass cuts, once.
    """
    docs = docs.drop("n_words", "hit_runs", "hit_items")
    runs_type = T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))
    out = docs.withColumns({
        "n_words": F.lit(0).cast("long"), "hit_runs": F.lit(None).cast(runs_type),
        "hit_items": F.lit(None).cast("array<string>"),
    })
    sc = docs.sparkSession.sparkContext
    blocks = _blocks(benchmark, item_col, item_text_col)
    block, before = next(blocks, []), []
    while True:
        following = next(blocks, None)
        fields = [f for f in out.schema.fields if keep_text or following is not None or f.name != text_col]
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
        handle = sc.broadcast((block, window))
        cutting = None if not cut or following is not None else "once" if before else "until clean"
        out = arrow_map(out, _scanner(uuid.uuid4().hex, handle, text_col, schema.fieldNames(), cutting), schema)
        if following is None:
            return out
        # one block at a time: it is searched for before the next one is read
        made: list[str] = []
        out = stage(out, "passages", made)
        handle.destroy()
        clear(docs.sparkSession, before)
        block, before = following, made


def _automaton(key: str, handle) -> SuffixAutomaton:
    """Built once in each worker from the block it was sent."""
    built = held("automata", dict)
    if key not in built:
        if len(built) > 1:
            built.clear()
        built[key] = SuffixAutomaton(*handle.value)
    return built[key]


def _scanner(key: str, handle, text_col: str, names_out: list[str], cutting: str | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, handle)
        names = [item for item, _ in handle.value[0]]
        for batch in batches:
            texts, counts, all_runs, all_items = batch.column(text_col).cast(pa.binary()), [], [], []
            for i in range(batch.num_rows):
                words = item_words(texts[i].as_py())
                runs, found = automaton.scan(words)
                counts.append(len(words))
                all_runs.append(runs)
                all_items.append({names[f] for f in found})
            before = [batch.column(c).to_pylist() for c in ("hit_runs", "hit_items")]
            new = {
                "n_words": counts,
                "hit_runs": [
                    [{"from": a, "to": b} for a, b in merged([*runs, *((r["from"], r["to"]) for r in old or ())])]
                    for runs, old in zip(all_runs, before[0])
                ],
                "hit_items": [sorted(found | set(old or ())) for found, old in zip(all_items, before[1])],
            }
            columns = [
                pa.array(new[name], batch.schema.field(name).type) if name in new else batch.column(name)
                for name in names_out
            ]
            if cutting:
                at = names_out.index(text_col)
                columns[at] = _cut_texts(columns[at], new["hit_runs"], automaton if cutting == "until clean" else None)
            yield pa.RecordBatch.from_arrays(columns, names_out)

    return run


def _cut_texts(texts: pa.Array, hit_runs: list[list[dict] | None], automaton: SuffixAutomaton | None) -> pa.Array:
    """Texts without their hit runs; with an automaton, judged and cut again until nothing is hit."""
    if not any(hit_runs):
        return texts
    cut = texts.cast(pa.binary()).to_pylist()
    for i, found_runs in enumerate(hit_runs):
        left = [(r["from"], r["to"]) for r in found_runs or ()]
        while left:
            cut[i] = _without(cut[i], left)
            left = merged(automaton.scan(item_words(cut[i]))[0]) if automaton is not None else []
    return pa.array(cut, pa.binary()).cast(texts.type)


def cut_passages(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``docs`` without benchmark passages: hit runs are cut out of the text, and a document goes
    when more than ``max_coverage`` of its words are hit.

    A cut can bring the two ends of an item together; a cut text is therefore judged again until
    nothing is hit (in the worker, or if the items make several blocks in rounds of one block each). Documents without hits keep their text byte for byte; NULL texts stay. A text
    that was cut leaves no words goes too. ``n_chars``, where there is one, follows the text.
    All other columns pass through, whatever their names.
    """
    names, types = docs.columns, docs.schema
    docs, originals = set_aside(docs, ("n_words", "hit_runs", "hit_items"))
    found = _scanned(docs, benchmark, window, text_col, item_col, item_text_col, cut=True)
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda n, r: n + r["to"] - r["from"])
    dirty = F.size("hit_runs") > 0
    # documents that are mostly hits have been cut with the others, and go by what was found before that
    cut = found.where(n_hit <= max_coverage * F.col("n_words")).drop("n_words", "hit_items")
    blocks = _blocks(benchmark, item_col, item_text_col)
    next(blocks, None)
    if next(blocks, None) is not None:
        # with several blocks the text is judged again against each of them, in another round
        cut = _cut_until_clean(
            stage(cut, "cut"), lambda df: find_passages(df, benchmark, window, text_col, item_col, item_text_col), _cutter(text_col, cut.columns), cut.schema)
    cut = cut.where(~dirty | F.col(text_col).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    if "n_chars" in names:
        cut = cut.withColumn("n_chars", F.when(dirty, F.length(text_col)).otherwise(F.col("n_chars")).cast(types["n_chars"].dataType))
    return cut.select(*originals)


def _cutter(text_col: str, names_out: list[str]):
    """Cuts ``hit_runs`` out of the texts, once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _cut_texts(batch.column(text_col), batch.column("hit_runs").to_pylist(), None)
            yield pa.RecordBatch.from_arrays([texts if n == text_col else batch.column(n) for n in names_out], names_out)

    return run


def _cut_until_clean(cut: DataFrame, find, run, schema: T.StructType) -> DataFrame:
    """Rows whose cut texts are hit by nothing; those that a cut made hit again are cut again, round by round.

    ``hit_runs`` of a row stay those of its first round, which tell that it was cut.
    """
    clean, dirty = cut.where(F.size("hit_runs") == 0), cut.where(F.size("hit_runs") > 0)
    first = private_name(cut, "_first")
    while not dirty.isEmpty():
        again = stage(find(dirty.withColumnRenamed("hit_runs", first)), "again")
        still = F.size("hit_runs") > 0
        done = again.where(~still).drop("n_words", "hit_items", "hit_runs").withColumnRenamed(first, "hit_runs")
        clean = clean.unionByName(done)
        dirty = stage(arrow_map(again.where(still).drop("n_words", "hit_items", first), run, schema), "cut")
    return clean


def _without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without the given runs of words and what stands between these words."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for start, end in runs:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, text[at:]])
