"""The methods themselves against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import ledgerrecon.llm.jaccard as jaccard
import ledgerrecon.llm.sharding as sharding
from ledgerrecon.llm.common import tokenizer_path
from ledgerrecon.llm.decontaminate import SuffixAutomaton, merged
from ledgerrecon.llm.packing import best_fit, layout, pack_lengths, reduce_lengths
from ledgerrecon.llm.quality import judge, learn_rules, covers, repeated_words, text_counts, training_rows, with_counts
from ledgerrecon.llm.queries import QUERIES
from ledgerrecon.llm.secrets import CANDIDATE, ENCODINGS, battery, find_secrets, located, redact_secrets, thresholds
from ledgerrecon.llm.token_files import Block, EliasFano, encode_block
from ledgerrecon.llm.tokens import PieceTokenizer
from tests.llm.test_queries import smallest

words = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(words, max_size=5), st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=40), st.integers(1, 5))
def test_automaton(items, text, window):
    named = [(str(k), w) for k, w in enumerate(items) if w]
    runs, found = SuffixAutomaton(named, window).scan(text)
    hit, have = set(), set()
    for k, (_, item) in enumerate(named):
        size = min(window, len(item))
        for i in range(len(item) - size + 1):
            for j in range(len(text) - size + 1):
                if text[j : j + size] == item[i : i + size]:
                    hit.update(range(j, j + size))
                    have.add(k)
    assert {w for a, b in merged(runs) for w in range(a, b)} == hit and found == have


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 10_000), max_size=300))
def test_elias_fano(steps):
    values = np.cumsum(np.array(steps, np.int64))
    coded = EliasFano.of(values)
    assert [coded.select(k) for k in range(len(values))] == values.tolist() == coded.all().tolist()
    assert len(coded.low) + len(coded.high) <= (2 + np.log2(max(2, (values[-1] if len(values) else 1) / max(1, len(values))))) * len(values) / 8 + 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65_535), max_size=20), max_size=200))
def test_block_round_trip(docs):
    block = Block(encode_block([np.array(d, "<u4").tobytes() for d in docs], 2))
    assert [block.ids(k).tolist() for k in range(block.documents)] == docs


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_packing_is_best_after_reduction(sizes):
    """What reduction fixes can be completed to a packing with as few sequences as any."""
    def fewest(left, capacity=12):
        best = [len(left)]

        def go(k, rooms):
            if len(rooms) >= best[0]:
                return
            if k == len(left):
                best[0] = len(rooms)
                return
            for i in range(len(rooms)):
                if rooms[i] >= left[k] and rooms[i] not in rooms[:i]:
                    go(k + 1, [*rooms[:i], rooms[i] - left[k], *rooms[i + 1 :]])
            go(k + 1, [*rooms, capacity - left[k]])

        go(0, [])
        return best[0]

    fixed, rest = reduce_lengths(dict(Counter(sizes)), 12)
    left = sorted((s for s, n in rest.items() for _ in range(n)), reverse=True)
    assert sorted(left + [s for p, n in fixed for s in p * n]) == sorted(sizes)
    assert sum(n for _, n in fixed) + fewest(left) == fewest(sorted(sizes, reverse=True))


def test_packing_places_all():
    rng = random.Random(3)
    for _ in range(200):
        counts = Counter(min(64, int(rng.expovariate(0.1)) + 1) for _ in range(rng.randint(1, 400)))
        patterns = pack_lengths(dict(counts), 64)
        assert sum((Counter({s: n for s, n in Counter(p).items()}) if k == 1 else Counter({s: c * k for s, c in Counter(p).items()}) for p, k in patterns), Counter()) == counts
        assert all(sum(p) <= 64 for p, _ in patterns)
        assert sum(k for _, k in patterns) <= sum(k for _, k in best_fit(dict(counts), 64))
        ranks = defaultdict(list)
        for size, first, n, _, _ in layout(patterns):
            ranks[size] += range(first, first + n)
        assert all(sorted(r) == list(range(counts[s])) for s, r in ranks.items())


def test_smallest_capacity():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.choice([1, 5, 20, 200]) * rng.randint(1, 30) for _ in range(rng.randint(1, 200))]
        shards, rows, at = rng.randint(1, 45), [], 0
        for size in sizes:
            rows.append((at, size, True))
            at += size
        runs, best = sharding._runs(rows), smallest(sizes, shards)
        assert sharding.smallest_capacity(runs, shards) == (best, best)
        edges = [0, *sharding.even_cuts(runs, best, shards), at]
        assert len(edges) <= shards + 1 and max(b - a for a, b in zip(edges, edges[1:])) <= best
        coarse, k = [], 0
        while k < len(rows):
            own = rows[k : k + rng.randint(1, 4)]
            coarse.append((own[0][0], sum(r[1] for r in own), len(own) == 1))
            k += len(own)
        low, high = sharding.smallest_capacity(sharding._runs(coarse), shards)
        assert low <= best <= high


def test_cuts_are_refined(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RESOLUTION", 1)
    monkeypatch.setattr(sharding, "PER_SHARD", 40)
    rng = random.Random(5)
    sizes = [rng.randint(1, 60) if k != 700 else 9_000 for k in range(3_000)]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist()
    groups = spark.createDataFrame(list(zip(starts, sizes)), "start long, size long")
    for shards in (1, 3, 4, 7):
        edges = [0, *sharding.find_cuts(groups, shards), sum(sizes)]
        assert set(edges[:-1]) <= set(starts) and len(edges) <= shards + 1
        assert max(b - a for a, b in zip(edges, edges[1:])) == smallest(sizes, shards)


def test_counts():
    assert text_counts(None) == text_counts(b"") == (0,) * 8
    text = "Aa bé\nAa bé\n \n# x x x x $"
    counts = text_counts(text.encode())
    assert counts[:5] == (10, 14, 2, 1, 4)
    rng = random.Random(2)
    for _ in range(300):
        some = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 15))]
        windows = Counter(tuple(some[i : i + 3]) for i in range(len(some) - 2))
        want = {i + k for i in range(len(some) - 2) for k in range(3) if windows[tuple(some[i : i + 3])] > 1}
        assert repeated_words(some) == len(want)


def test_rules_on_held_out_labels(spark):
    """Fitted on one half of the labelled rows, judged on the other."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    data, bad = training_rows(with_counts(docs, keep_text=False), labels)
    order = np.random.default_rng(0).permutation(len(bad))
    fit, held = order[: len(order) // 2], order[len(order) // 2 :]
    rules = learn_rules({k: v[fit] for k, v in data.items()}, bad[fit])
    hit = np.zeros(len(held), bool)
    for rule in rules:
        hit |= covers(rule, {k: v[held] for k, v in data.items()}, len(held))
    assert rules and (hit & ~bad[held]).mean() <= 0.01 and (hit & bad[held]).sum() >= 0.9 * bad[held].sum()


def test_rules_become_one_expression(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    judged, rules = judge(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), keep_text=False)
    assert rules
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan
    assert judged.where("rule > 0 and kept").count() == 0 and judged.where("rule > 0").count() > 0


def test_tokens_in_pieces():
    odd = [
        "", " a", "a ", "a  b", "a\n\nb c", "a b c  d", "İSTANBUL é x\u0001y", "don't I'll 12 34.5% ###\tb", "\n",
        "<|endoftext|> x", "“quotes” — dash… ok", "日本語 テキスト", "a\x00b \x00", "word\n.word", "a\xa0 b\xa0\n c", "x\x1cy \x85z",
    ]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        tokenizer = PieceTokenizer(tokenizer_path(name))
        for _ in range(2):
            for text, got in zip(odd, tokenizer.encode([t.encode() for t in odd])):
                assert np.frombuffer(got, "<u4").tolist() == tokenizer.tokenizer.encode(text, add_special_tokens=False).ids


_WORDS = ("the quick brown fox jumps over lazy dog customer order account value total import export reversal config reconcile pipeline "
          "dataset column header result status group difference number string integer settings manager controller service").split()
_ALPHABETS = {name: letters for name, _, letters in ENCODINGS if name != "decimal"}


def ordinary(rng, encoding, n):
    """Words, names joined by case or signs, padded numbers: what stands in ordinary text in such characters."""
    out = ""
    while len(out) < n:
        word = rng.choice(_WORDS)
        number = str(rng.randrange(100)) if rng.random() < 0.1 else ""
        out += {
            "lower36": word + number, "upper36": word.upper() + number, "base32": word.upper(), "base62": word.capitalize() + number,
            "base64url": (word if rng.random() < 0.7 else word.capitalize()) + rng.choice("-_"), "base64": word + "/",
        }.get(encoding) or rng.choice(["0" * rng.randrange(4, 12) + f"{rng.randrange(5000):x}", "ffff", "00000000", "aaaa0000"])
    out = out[:n]
    return out.upper() if encoding == "HEX" else out


def judged(spark, strings):
    """The reported ones of (name, string) among all strings."""
    rows = spark.createDataFrame(strings, "name string, text string").repartition(8)
    scanned = rows.withColumn("_candidates", battery(located(F.col("text"), CANDIDATE))).cache()
    limits = thresholds(scanned, 0.01)
    out = [r["name"] for r in scanned.collect() if any(c["step"] >= limits.get(c["stratum"], 1 << 30) for c in r["_candidates"])]
    scanned.unpersist()
    return Counter(out)


@pytest.mark.parametrize("length,wanted", [(24, {}), (32, {"base64"}), (40, {"hex", "HEX", "base64", "base64url"}), (64, set(_ALPHABETS))])
def test_battery_recall_with_one_secret_in_a_hundred(spark, length, wanted):
    rng = random.Random(length)
    strings = []
    for encoding, letters in _ALPHABETS.items():
        made = 0
        while made < 40:
            secret = "".join(rng.choice(letters) for _ in range(length))
            # one that happens to look like a narrower encoding is none of this one
            if next((n for n, pattern, _ in ENCODINGS if re.search(pattern, secret)), None) == encoding:
                strings.append((f"secret {encoding}", secret))
                made += 1
        strings += [(f"ordinary {encoding}", ordinary(rng, encoding, length)) for _ in range(3960)]
    found = judged(spark, strings)
    recall = {e: found[f"secret {e}"] / 40 for e in _ALPHABETS}
    false = sum(n for name, n in found.items() if name.startswith("ordinary"))
    assert false <= 0.02 * sum(found.values()), (recall, found)
    assert all(recall[e] >= 0.9 for e in wanted), recall


def test_battery_reports_where_no_pattern_does(spark):
    rng = random.Random(4)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(k, f"see {pick(_ALPHABETS['base64'], 40)} and") for k in range(20)] + [(100, f"x {'source/library/' * 4} y"), (101, "9" * 40), (102, None)]
    rows += [(200 + k, f"fingerprint {pick('0123456789ABCDEF', 40)}.") for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'own' AS _candidates", "1 AS _cut")
    found = {r["doc_id"]: r for r in find_secrets(docs).collect()}
    spans = {k: [s["kind"] for s in r["spans"]] for k, r in found.items()}
    assert sum(spans[k] == ["random"] for k in range(20)) >= 18 and sum(spans[200 + k] == ["random"] for k in range(10)) >= 9
    assert spans[100] == spans[101] == spans[102] == [] and found[101]["_candidates"] == "own"
    assert redact_secrets(docs).columns == docs.columns


def brute_base_spans(text):
    """Spans of the fixed patterns as the task words them, with Python's own regular expressions."""
    text, out = text or "", []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        out += [(m.start(), 0, "assign", m.end())] if len(m[2]) >= 6 else []
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_query_equals_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op6_secret_scans"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    for row in got:
        base = brute_base_spans(docs[row["doc_id"]])
        kinds = Counter(kind for _, _, kind, _ in base)
        text = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in base)
        assert (row["n_assign"], row["n_access"], row["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert row["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) <= set(row["spans"].split(","))


def brute_counts(text):
    """The base columns of the quality query for one text."""
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again))


def test_quality_query_equals_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op3_quality_rules"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    for row in got:
        want = brute_counts(docs[row["doc_id"]])
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert row["base_failed"] == failed and not (failed and row["kept"])


def links_of(sets, threshold=75):
    keys = sorted(sets)
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {k: root(k) for k in keys}


def test_components_of_large_groups(spark, monkeypatch):
    """Near copies, shared passages and chains, with lists long enough for hubs and for what hubs leave apart."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(80)]
    passage = [f"p{i}" for i in range(30)]
    docs = {}
    for k in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(80)] = f"e{rng.randrange(999)}"
        docs[k] = own
    for k in range(60, 110):
        docs[k] = passage + [f"o{k}_{i}" for i in range(rng.choice([2, 4, 6, 10]))]
    for k in range(110, 125):  # a chain: neighbours are similar, the ends are not
        docs[k] = [f"c{i}" for i in range((k - 110) * 6, (k - 110) * 6 + 60)]
    docs |= {125: [], 126: ["one"], 127: ["one"], 128: ["one", "two"]}
    rows = [(k, " ".join(w)) for k, w in docs.items()]
    rng.shuffle(rows)
    grams = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for k, w in docs.items()}
    want = links_of(grams)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for rounds, short in ((3, 12), (1, 2)):
        monkeypatch.setattr(jaccard, "HUB_ROUNDS", rounds)
        monkeypatch.setattr(jaccard, "SHORT_LIST", short)
        got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(frame).collect()}
        assert got == {k: (len(grams[k]), want[k]) for k in docs}


def test_shared_lists_over_batches():
    rng = random.Random(6)
    for _ in range(200):
        rows = sorted((rng.randint(0, 8), rng.randint(0, 5)) for _ in range(rng.randint(0, 30)))
        batches, k = [], 0
        while k < len(rows):
            own = rows[k : k + rng.randint(1, 5)]
            k += len(own)
            batches.append(pa.RecordBatch.from_arrays([pa.array([r[0] for r in own]), pa.array([r[1] for r in own]), pa.array([0] * len(own))], ["gram", "cls", "meta"]))
        got = [(g, c) for b in jaccard._shared_only(iter(batches)) for g, c in zip(b.column("gram").to_pylist(), b.column("cls").to_pylist())]
        have = defaultdict(set)
        for g, c in rows:
            have[g].add(c)
        assert got == sorted((g, c) for g, own in have.items() if len(own) > 1 for c in own)


def test_pairs_told_by_halves_are_those_of_whole_sets():
    """Sets around the threshold, some with equal upper halves of different n-grams; no pair is lost or won."""
    rng = np.random.default_rng(8)
    pairs, want, near = [], set(), 0
    for k in range(300):
        n, shared = int(rng.integers(1, 120)), 0
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        shared = int(rng.integers(0, len(a) + 1)) if k % 3 else int(len(a) * 6 / 7)
        other = rng.integers(0, 1 << 63, len(a) - shared, dtype=np.uint64)
        if k % 5 == 0 and len(other):  # chance made to happen: another n-gram with the same upper half
            other[0] = a[-1] ^ np.uint64(1)
        b = np.unique(np.concatenate([a[:shared], other]))
        pairs.append((k, a, b))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            want.add(k)
    half = lambda x, which: ((x >> np.uint64(32)) if which == "high" else (x & np.uint64(0xFFFFFFFF))).astype("<u4").tobytes()
    columns = {"a": pa.array([k for k, *_ in pairs]), "b": pa.array([k for k, *_ in pairs])}
    columns |= {f"{side}_{w}": pa.array([half(p[1 + i], w) for p in pairs], pa.binary()) for i, side in enumerate("ab") for w in ("high", "low")}
    batch = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    told = next(jaccard._halves_compared(75)(iter([batch]))).to_pydict()
    sure = {k for k, s in zip(told["a"], told["sure"]) if s}
    assert set(next(jaccard._verified(75)(iter([batch]))).to_pydict()["a"]) == want
    assert sure < want < set(told["a"]) and len(sure) > 10
    assert jaccard._by_chance(2) <= 2 < jaccard._by_chance(100_000) < 40 and jaccard._by_chance(10**7) == 10**7


def test_token_files_use_full_tables():
    """A worker of its own keeps what it learned: no piece of a job of this size goes through the tokenizer twice."""
    import inspect

    from ledgerrecon.llm.token_files import write_tokens
    from ledgerrecon.llm.tokens import FULL

    assert inspect.signature(write_tokens).parameters["tables"].default == FULL
