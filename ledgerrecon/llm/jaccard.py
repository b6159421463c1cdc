"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

A document is its set of word n-gram hashes; documents with equal sets are one class.
In one order of all n-grams, rare ones first, two sets with a Jaccard similarity of at least
``t`` share ``l`` n-grams within the first ``n - ceil(t n) + l`` of each, for every ``l``. Each class
takes the ``l`` whose prefix is estimated to cost the least: a longer prefix is read in more lists, but
a candidate must then share more. A pair is verified on whole sets once it shares as many
prefix n-grams as the smaller ``l`` of the two asks for.

Links are wanted for their components, so a list of thousands of near copies need not be turned
into all its pairs: classes in long lists are first verified against a few members of the list, and
only pairs that these links leave in different components are looked at one by one. No such pair
is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerrecon.llm.common import arrow_map, binary_list, clear, hashed_words, mixed, release, small, stage, text_runs, window_hashes

#: Frequent n-grams whose counts all tasks get (16 bytes each): bounds the broadcast, not the result.
FREQUENT = 500_000
#: N-grams counted at least so often are candidates for that table.
LEAST_COUNT = 3
#: N-grams counted together by one task, about (4 bytes each): the number of buckets follows from it.
BUCKET_GRAMS = 2_000_000
#: Bytes of the sets of hubs that go to all tasks.
HUB_BYTES = 16_000_000
#: Lists up to this length give all their pairs; longer ones are joined through hubs first.
SHORT_LIST = 3
HUB_ROUNDS = 3
MAX_MATCH = 4
RUN_BYTES = 4_000_000


def needed(n, threshold: int):
    """ceil(threshold n / 100)."""
    return -((-threshold * n) // 100)


def ngram_sets(texts: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts, sorted within each, and where each begins.

    Words stand between ASCII white space, A-Z lower-cased. Texts with fewer words are one n-gram,
    texts without words none.
    """
    words, ends = hashed_words(texts, True)
    counts = np.diff(ends)
    starts = np.arange(len(words))
    doc = np.repeat(np.arange(len(counts)), counts)
    whole = starts[(ends[1:][doc] - starts) >= size] if len(words) else starts
    grams, owner = window_hashes(words, size)[whole], doc[whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        single = [window_hashes(words[ends[k] : ends[k + 1]], int(counts[k]), 7)[0] for k in short.tolist()]
        grams, owner = np.concatenate([grams, np.array(single, np.uint64)]), np.concatenate([owner, short])
    if len(short):
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
    edges = np.searchsorted(owner, np.arange(len(counts) + 1))
    for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        grams[start:end].sort()
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.concatenate([[0], np.cumsum(new)])[edges]


def digests(grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One number for each set, the same for equal sets; 0 for empty ones."""
    out = np.zeros(len(ends) - 1, np.uint64)
    full = np.diff(ends) > 0
    if full.any():
        out[full] = mixed(np.add.reduceat(mixed(grams ^ np.uint64(0x5851F42D4C957F2D)), ends[:-1][full])) | np.uint64(1)
    return out.view(np.int64)


def _sets_of(batches: Iterator[pa.RecordBatch], size: int, once: bool):
    """Per run of rows: grams, ends, digests and the rows taken; ``once``: equal sets of a batch once."""
    for batch in text_runs(batches, RUN_BYTES):
        grams, ends = ngram_sets(binary_list(batch.column("text")), size)
        digest = digests(grams, ends)
        rows = np.flatnonzero(np.diff(ends) > 0)
        if once:
            rows = rows[np.unique(digest[rows], return_index=True)[1]]
        counts = np.diff(ends)[rows]
        places = np.repeat(ends[:-1][rows] - np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64), counts) + np.arange(counts.sum()) if len(rows) else np.empty(0, np.int64)
        yield batch, grams[places], np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), digest, rows, ends


def bucket_bits(grams: int) -> int:
    """How many leading bits of an n-gram's hash name its bucket, for so many n-grams in all."""
    return min(24, max(6, (grams // BUCKET_GRAMS).bit_length()))


def _count_blocks(size: int, bits: int):
    """N-grams of each batch by bucket, 32 bits of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, grams, *_ in _sets_of(batches, size, True):
            grams = np.sort(grams)
            bucket = (grams >> np.uint64(64 - bits)).astype(np.int64)
            low = ((grams >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(starts[1:], len(bucket))
            yield pa.RecordBatch.from_arrays([
                pa.array(bucket[starts]), pa.array([low[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())], pa.binary()),
            ], ["bucket", "grams"])
    return run


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequent n-grams of each bucket; rows come sorted by bucket."""
    def counted(bucket: int, parts: list[bytes]) -> pa.RecordBatch:
        values, counts = np.unique(np.frombuffer(b"".join(parts), "<u4"), return_counts=True)
        often = counts >= LEAST_COUNT
        key = (np.int64(bucket) << np.int64(32)) | values[often].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(counts[often].astype(np.int64))], ["gram", "n"])

    at, parts = None, []
    for batch in batches:
        for bucket, grams in zip(batch.column("bucket").to_pylist(), batch.column("grams").to_pylist()):
            if bucket != at and parts:
                yield counted(at, parts)
                parts = []
            at = bucket
            parts.append(grams)
    if parts:
        yield counted(at, parts)


def frequent_ngrams(rows: DataFrame, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams, by a prefix of their hash, with how many classes hold each (in each batch once).

    At most ``FREQUENT`` of those in ``LEAST_COUNT`` classes or more; all others are taken as rare.
    """
    paths: list[str] = []
    blocks = arrow_map(rows, _count_blocks(size, bits), "bucket long, grams binary").repartition("bucket").sortWithinPartitions("bucket")
    counts = stage(arrow_map(blocks, _bucket_counts, "gram long, n long"), "counts", paths)
    del blocks
    release(rows.sparkSession)
    # sixteen steps for each doubling of the count: a few hundred rows
    step = F.floor(F.log2("n") * 16).cast("int")
    per_step = {r["step"]: r["k"] for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect()}
    taken, total, open_step = [], 0, None
    for at in sorted(per_step, reverse=True):
        if total + per_step[at] > FREQUENT:
            open_step = at
            break
        taken.append(at)
        total += per_step[at]
    wanted = step >= (min(taken) if taken else 1 << 30)
    if open_step is not None:  # of the step that is too large, as large a part as fits, by hash
        part = int((FREQUENT - total) / per_step[open_step] * 0.95 * (1 << 20))
        wanted = wanted | ((step == open_step) & (F.pmod(F.xxhash64("gram"), F.lit(1 << 20)) < part))
    table = counts.where(wanted).limit(FREQUENT).toArrow()
    clear(rows.sparkSession, paths)
    keys, n = table.column("gram").to_numpy().astype(np.int64), table.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def _prefix_rows(size: int, threshold: int, bits: int, shared):
    """(n-gram, class, meta) of each prefix; meta packs set size, place in the order, level of the n-gram and ``l`` of the class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = shared.value
        for _, grams, ends, digest, rows, _ in _sets_of(batches, size, True):
            n = np.diff(ends)
            doc = np.repeat(np.arange(len(n)), n)
            often = np.zeros(len(grams), np.int64)
            if len(keys):
                short = (grams >> np.uint64(32 - bits)).astype(np.int64)
                place = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
                hit = keys[place] == short
                often[hit] = counts[place[hit]]
            # within a document the n-grams are sorted already; rare ones come first
            order = np.argsort((doc << 24) + np.minimum(often, (1 << 24) - 1), kind="stable")
            grams, often = grams[order], often[order]
            spot = np.arange(len(grams)) - ends[:-1][doc]
            base = n - needed(n, threshold) + 1
            level = np.maximum(spot - base[doc] + 2, 1)
            # cost of reading the lists of the prefix, and of verifying the candidates that can share l of them
            running = np.concatenate([[0], np.cumsum(np.maximum(often - 1, 0))])
            cost = np.stack([
                (lambda read: read + read / match * n)((running[np.minimum(ends[:-1] + base + match - 1, ends[1:])] - running[ends[:-1]]).astype(float))
                for match in range(1, MAX_MATCH + 1)
            ])
            match = np.argmin(cost, axis=0) + 1
            keep = level <= match[doc]
            meta = (n[doc] << 32) | (np.minimum(spot, (1 << 24) - 1) << 8) | (level << 4) | match[doc]
            yield pa.RecordBatch.from_arrays([
                pa.array(grams[keep].view(np.int64)), pa.array(digest[rows][doc][keep]), pa.array(meta[keep]),
            ], ["gram", "cls", "meta"])
    return run


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (n-gram, class): one of each, where a n-gram has two classes or more."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([held, batch]) if held is not None else pa.Table.from_batches([batch])
        gram, cls = (table.column(c).to_numpy() for c in ("gram", "cls"))
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (cls[1:] != cls[:-1])
        places = np.flatnonzero(new)
        own = gram[places]
        # the last row is kept back: what follows may be of its list; one before it tells that a list goes on
        shared = np.zeros(len(own), bool)
        same = own[1:] == own[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        back = 2 if len(own) > 1 and same[-1] else 1
        first = 1 if held is not None and held.num_rows == 2 else 0  # of two rows kept back, the first is out already
        ready = places[first : len(own) - 1][shared[first : len(own) - 1]]
        yield table.take(pa.array(ready)).combine_chunks().to_batches()[0] if len(ready) else batch.slice(0, 0)
        held = table.take(pa.array(places[len(own) - back :])).combine_chunks().to_batches()[0]
    if held is not None and held.num_rows == 2:
        yield held.slice(1, 1)


def _set_rows(size: int, columns: tuple[str, ...]):
    """Sets as columns in one order: the upper 32 bits of each n-gram (``high``), and the lower ones (``low``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, grams, ends, digest, rows, _ in _sets_of(batches, size, False):
            halves = {"high": (grams >> np.uint64(32)).astype("<u4"), "low": (grams & np.uint64(0xFFFFFFFF)).astype("<u4")}
            cuts = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest[rows]), *(pa.array([halves[c][a:b].tobytes() for a, b in cuts], pa.binary()) for c in columns)], ["cls", *columns])
    return run


def _stored_sets(rows: DataFrame, classes: DataFrame, wanted: DataFrame, size: int, columns: tuple[str, ...], paths: list[str]) -> DataFrame:
    """These columns of the sets of some stored classes, made from one text of each; stored."""
    wanted = small(wanted)
    each = classes.join(wanted, "cls", "left_semi").groupBy("cls", "id").count()
    one_each = stage(each.groupBy("cls").agg(F.min(F.struct("id", "count")).alias("one")).select("one.*"), "one-each", paths)
    ids = stage(one_each.select(F.col("id").alias("_id")).distinct(), "ids", paths)
    source = rows.join(small(ids), F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    found = arrow_map(source, _set_rows(size, columns), ", ".join(["cls long", *(f"{c} binary" for c in columns)])).join(wanted, "cls", "left_semi")
    if one_each.where("count > 1").limit(1).count():
        found = found.dropDuplicates(["cls"])  # rows are repeated
    return stage(found, "sets", paths)


def _class_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, digest, _, ends in _sets_of(batches, size, False):
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(digest), pa.array(np.diff(ends).astype(np.int64))], ["id", "cls", "n_shingles"]
            )
    return run


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many values of two sets are equal; equal ones within a set count, too."""
    both = np.sort(np.concatenate([a, b]))
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _by_chance(n: int) -> int:
    """No more than so many of ``n`` different n-grams have upper halves that others have, but for odds below 1e-20."""
    mean, odds, k = n * n / 2.0**33, 1.0, 0
    if mean > 100:
        return n
    while odds >= 1e-20:
        k += 1
        odds *= mean / k
    return k - 1


def _halves_compared(threshold: int):
    """Pairs that can be linked by the upper halves of their n-grams, which are equal where the n-grams are, and whether
    they are linked even if some halves are equal by chance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, sure = [], []
            for a, b in zip(batch.column("a_high"), batch.column("b_high")):
                a, b = (np.frombuffer(x.as_buffer(), "<u4") for x in (a, b))
                n, both = len(a) + len(b), _equal(a, b)
                linked.append(100 * both >= threshold * (n - both))
                both -= _by_chance(n)
                sure.append(100 * both >= threshold * (n - both))
            out = [batch.column("a"), batch.column("b"), pa.array(sure, pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, ["a", "b", "sure"]).filter(pa.array(linked, pa.bool_()))
    return run


def _verified(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, columns = [], [batch.column(c) for c in ("a_high", "a_low", "b_high", "b_low")]
            for halves in zip(*columns):
                high, low, high_b, low_b = (np.frombuffer(x.as_buffer(), "<u4").astype(np.uint64) for x in halves)
                a, b = high << np.uint64(32) | low, high_b << np.uint64(32) | low_b
                both = _equal(a, b)
                linked.append(100 * both >= threshold * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))
    return run


def _with_sets(pairs: DataFrame, sets: DataFrame, columns: tuple[str, ...], paths: list[str]) -> DataFrame:
    """Stored pairs (a, b) with these columns of the sets of both, as ``a_`` and ``b_``.

    Sets meet their pairs where they lie, as long as the pairs are few. Where few sets stand on the side of ``b``,
    as hubs do, these go to all tasks as well; beyond a counted size the sets of ``a`` are shuffled to those of ``b``.
    """
    sets = sets.select("cls", *columns)
    needed_b = stage(pairs.select(F.col("b").alias("cls")).distinct(), "needed", paths)
    hubs = stage(sets.join(small(needed_b), "cls", "left_semi"), "hubs", paths)
    size = hubs.agg(F.coalesce(F.sum(sum(F.octet_length(c) for c in columns)), F.lit(0))).head()[0]
    hubs = hubs.select(F.col("cls").alias("b"), *(F.col(c).alias(f"b_{c}") for c in columns))
    met = small(pairs)
    if met is pairs:  # too many to go to all tasks
        sets = sets.join(small(stage(pairs.select(F.col("a").alias("cls")).distinct(), "needed", paths)), "cls", "left_semi")
    own = sets.select(F.col("cls").alias("a"), *(F.col(c).alias(f"a_{c}") for c in columns)).join(met, "a")
    return own.join(F.broadcast(hubs) if size <= HUB_BYTES else hubs, "b")


def _verify(pairs: DataFrame, sets: DataFrame, whole_sets: Callable[[DataFrame, list[str]], DataFrame], threshold: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; stored.

    The upper halves of n-grams tell most pairs: too few equal ones rule a link out, and more than enough, by more than
    chance can add, prove it. The few pairs between are compared on whole n-grams, which are made from the texts once more
    (``whole_sets``), so that the lower halves of all sets need no place on disk.
    """
    paths: list[str] = []
    pairs = stage(pairs, "pairs", paths)
    told = stage(arrow_map(_with_sets(pairs, sets, ("high",), paths), _halves_compared(threshold), "a long, b long, sure boolean"), "links")
    links, near = told.where("sure").select("a", "b"), told.where("not sure").select("a", "b")
    if near.limit(1).count():
        needed = stage(near.select(F.col("a").alias("cls")).union(near.select("b")).distinct(), "needed", paths)
        whole = _with_sets(near, whole_sets(needed, paths), ("high", "low"), paths)
        links = links.union(stage(arrow_map(whole, _verified(threshold), "a long, b long"), "links"))
        del whole
    clear(links.sparkSession, paths)
    release(links.sparkSession)
    return links


def _ordered_pairs(pairs: DataFrame, threshold: int) -> DataFrame:
    """Distinct (a, b) with a < b from (x, nx, y, ny), less those whose sizes alone rule a link out."""
    near = F.lit(100) * F.least("nx", "ny") >= F.lit(threshold) * F.greatest("nx", "ny")
    return pairs.where((F.col("x") != F.col("y")) & near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(cls, label) of every class in a link: the smallest class that links lead to.

    Each round, every class takes the smallest label among its neighbours, then the label of that
    label, so paths halve; it ends when a round changes nothing.
    """
    paths: list[str] = []
    both = stage(links.select(F.col("a").alias("cls"), F.col("b").alias("other")).union(links.select("b", "a")).distinct(), "edges", paths)
    labels = stage(both.groupBy("cls").agg(F.min("other").alias("m")).select("cls", F.least("cls", "m").alias("label")), "labels", paths)
    while True:
        seen = both.join(labels.select(F.col("cls").alias("other"), F.col("label").alias("seen")), "other")
        lower = seen.groupBy("cls").agg(F.min("seen").alias("seen"))
        step = labels.join(lower, "cls").select("cls", F.least("label", "seen").alias("next"), "label")
        up = labels.select(F.col("cls").alias("next"), F.col("label").alias("above"))
        made: list[str] = []
        step = stage(step.join(up, "next", "left").select("cls", F.least("next", F.coalesce("above", "next")).alias("new"), "label"), "labels", made)
        labels = step.select("cls", F.col("new").alias("label"))
        if not step.where(F.col("new") != F.col("label")).limit(1).count():
            clear(links.sparkSession, paths)
            return labels
        paths += made


def _labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of lists that still hold several components."""
    known = lists.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    open_lists = known.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("gram")
    return known.join(open_lists, "gram", "left_semi")


def _size(column: str):
    return F.shiftright(column, 32)


def _spot(column: str):
    """Place of the n-gram in its class's order; the last one it can hold for sets beyond 16 million."""
    return F.shiftright(column, 8).bitwiseAND(F.lit((1 << 24) - 1))


def similar_documents(
    docs: DataFrame, size: int = 5, threshold: int = 75, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id`` (of ``id_col``), ``cls`` (digest of the set), ``n_shingles`` and ``component_id`` of every row.

    Documents link when 100 |A and B| >= ``threshold`` |A or B| of their distinct word n-grams;
    ``component_id`` is the smallest id that links lead to (NULL only if none of them has one). NULL and
    empty texts, and those of white space, have no set and stay alone, each under its own id. Equal sets are always
    linked; repeated rows are returned as often as they occur. Only these columns are returned.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sc, paths = docs.sparkSession.sparkContext, []
    classes = stage(arrow_map(rows, _class_rows(size), "id long, cls long, n_shingles long"), "classes")
    texts = rows.select("text")
    bits = bucket_bits(classes.agg(F.sum("n_shingles")).head()[0] or 0)
    shared = sc.broadcast(frequent_ngrams(texts, size, bits))  # at most FREQUENT entries
    prefixes = arrow_map(texts, _prefix_rows(size, threshold, bits, shared), "gram long, cls long, meta long")
    met = prefixes.repartition("gram").sortWithinPartitions("gram", "cls")
    entries = stage(arrow_map(met, _shared_only, "gram long, cls long, meta long"), "entries", paths)
    del prefixes, met
    release(docs.sparkSession)
    lengths = entries.groupBy("gram").agg(F.count("*").alias("length"))
    long_ones = stage(lengths.where(F.col("length") > SHORT_LIST).select("gram"), "long", paths)
    long_ones = small(long_ones)
    in_lists = entries.join(long_ones, "gram", "left_semi")
    in_long = stage(in_lists.groupBy("cls").agg(F.count("*").alias("hidden")), "in-long", paths)
    long_lists = stage(in_lists.join(small(in_long), "cls"), "lists", paths)
    short_lists = entries.join(long_ones, "gram", "left_anti").join(small(in_long), "cls", "left").withColumn("hidden", F.coalesce("hidden", F.lit(0)))
    left, right = short_lists.alias("l"), short_lists.alias("r")
    level = lambda meta: F.shiftright(meta, 4).bitwiseAND(F.lit(15))
    ask = F.least(F.col("l.meta").bitwiseAND(F.lit(15)), F.col("r.meta").bitwiseAND(F.lit(15)))
    counted = (
        left.join(right, (F.col("l.gram") == F.col("r.gram")) & (F.col("l.cls") < F.col("r.cls")))
        .where(F.lit(100) * F.least(_size("l.meta"), _size("r.meta")) >= F.lit(threshold) * F.greatest(_size("l.meta"), _size("r.meta")))
        .groupBy(F.col("l.cls").alias("a"), F.col("r.cls").alias("b"))
        .agg(
            F.count("*").alias("k"), F.sum(((level("l.meta") <= ask) & (level("r.meta") <= ask)).cast("int")).alias("matches"), F.max(ask).alias("ask"),
            F.max(_size("l.meta")).alias("na"), F.max(_size("r.meta")).alias("nb"), F.max(_spot("l.meta")).alias("sa"), F.max(_spot("r.meta")).alias("sb"), F.least(F.max("l.hidden"), F.max("r.hidden")).alias("hidden"),
        )
    )
    # after the last n-gram shared in both prefixes no more can be shared than either set has left; what the two
    # may share in long lists besides is not in these counts and is allowed for
    bound = F.col("k") + F.col("hidden") + F.least(F.col("na") - F.col("sa"), F.col("nb") - F.col("sb")) - 1
    enough = (F.col("matches") + F.col("hidden") >= F.col("ask")) & (bound * (100 + threshold) >= (F.col("na") + F.col("nb")) * threshold)
    tested = stage(counted.where(enough).select("a", "b"), "pairs", paths)

    # sets of the classes that are to be compared
    wanted = stage(tested.select(F.col("a").alias("cls")).union(tested.select("b")).union(in_long.select("cls")).distinct(), "wanted", paths)
    sets = _stored_sets(rows, classes, wanted, size, ("high",), paths)
    whole_sets = lambda near, made: _stored_sets(rows, classes, near, size, ("high", "low"), made)

    links, rest = None, long_lists.withColumn("label", F.col("cls"))
    for turn in range(HUB_ROUNDS):
        # first the member of the most long lists, which is the least changed copy; then any. Both say the same in
        # all lists, so lists of the same members have one hub, and a member is not compared once for each list
        rank = F.struct(-F.col("hidden") if turn == 0 else F.lit(0), F.xxhash64("cls", F.lit(turn)))
        hub = rest.groupBy("gram").agg(F.min_by(F.struct("cls", "meta", "label"), rank).alias("hub"))
        tried = rest.join(hub, "gram").where("label <> hub.label")
        # what the two can share after this n-gram must be enough; a pair that shares an earlier one meets there, too
        left_over = F.least(_size("meta") - _spot("meta"), _size("hub.meta") - _spot("hub.meta"))
        stars = tried.where(left_over * (100 + threshold) >= (_size("meta") + _size("hub.meta")) * threshold)
        new = _verify(stars.select(F.col("cls").alias("a"), F.col("hub.cls").alias("b")).distinct(), sets, whole_sets, threshold)
        links = _verify(tested, sets, whole_sets, threshold).union(new) if links is None else links.union(new)
        labels = components(links)
        rest = stage(_labelled(long_lists, labels), "open", paths)
        if not rest.limit(1).count():
            break
    sizes = rest.groupBy("gram", "label").count()
    main = sizes.groupBy("gram").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    marked = rest.join(main, "gram")
    strays = marked.where("label <> main").select("gram", F.col("cls").alias("x"), F.col("meta").alias("mx"), F.col("label").alias("lx"))
    others = marked.select(F.col("gram").alias("g"), F.col("cls").alias("y"), F.col("meta").alias("my"), F.col("label").alias("ly"), "main")
    # a pair comes up at the first n-gram it shares: from there on both sets must have enough left
    left_over = F.least(_size("mx") - _spot("mx"), _size("my") - _spot("my"))
    apart = strays.join(others, (
        (F.col("gram") == F.col("g")) & (F.col("lx") != F.col("ly")) & ((F.col("ly") == F.col("main")) | (F.col("x") < F.col("y")))
        & (left_over * (100 + threshold) >= (_size("mx") + _size("my")) * threshold)
    ))
    last = _ordered_pairs(apart.select("x", _size("mx").alias("nx"), "y", _size("my").alias("ny")), threshold)
    labels = components(links.union(_verify(last, sets, whole_sets, threshold)))
    clear(docs.sparkSession, paths)

    known = classes.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    smallest = known.where("n_shingles > 0").groupBy("label").agg(F.min("id").alias("component_id"))
    joined = known.join(smallest, "label", "left")
    return joined.select(
        "id", "cls", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )
