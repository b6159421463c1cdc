"""Quality rules: an ordered decision list learned from labelled text statistics.

Sequential covering: a rule (a conjunction of thresholds) is grown on one part of the
labelled rows until it covers no good document, pruned on the other part, kept if it
is precise there, and the rows it covers are taken out before the next one. The list is
then one Spark ``CASE WHEN``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerrecon.llm.common import arrow_map, clear, small, stage

#: Labelled rows the list is fitted on, at most, chosen by the hash of their id.
TRAIN_ROWS = 40_000
#: A rule is kept if at least this share of what it covers in the pruning part is of low quality.
PRECISION = 0.95
#: Rows a rule must cover in the pruning part, at least.
SUPPORT = 3
CUTS = 64
MAX_RULES = 24
MAX_CONDITIONS = 4

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_distinct_words", "n_lines")
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_SPACE = b" \t\n\v\f\r"


def text_counts(text: bytes | None) -> tuple[int, ...]:
    """``COUNTS`` of one UTF-8 text; words stand between ASCII white space."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()
    n = len(words)
    solid = text.translate(None, _SPACE)
    word_chars = len(solid.decode("utf-8", "replace")) if not solid.isascii() else len(solid)
    seen, dup_lines, lines = set(), 0, text.split(b"\n")
    for line in lines:
        if line.strip():
            dup_lines += line in seen
            seen.add(line)
    return (
        n, word_chars, len(text) - len(text.translate(None, _SYMBOLS)), dup_lines, repeated_words(words),
        len(text) - len(text.translate(None, _UPPER)), len(set(words)), len(lines),
    )


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that are found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, end = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + 3 - max(at, end)
            end = at + 3
    return covered


def with_counts(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``COUNTS`` as longs, replacing columns of these names; NULL and empty texts count 0 everywhere."""
    docs = docs.drop(*COUNTS)
    kept = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in COUNTS)])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).cast(pa.binary())
            counted = np.array([text_counts(t.as_py()) for t in texts], np.int64).reshape(-1, len(COUNTS))
            columns = [batch.column(n) for n in names] + [pa.array(counted[:, k]) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays(columns, [*names, *COUNTS])

    return arrow_map(docs, run, schema)


def _ratio(top: str | Column, bottom: str) -> Column:
    return (F.col(top) if isinstance(top, str) else top) / F.greatest(F.col(bottom), F.lit(1))


#: What conditions are made of; each is a column over ``COUNTS``.
STATISTICS = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "chars_per_word": lambda: _ratio("word_chars", "n_words"),
    "symbols_per_word": lambda: _ratio("n_symbols", "n_words"),
    "dup_line_share": lambda: _ratio("n_dup_lines", "n_lines"),
    "repeat_share": lambda: _ratio("n_repeat_words", "n_words"),
    "upper_share": lambda: _ratio("n_upper", "word_chars"),
    "distinct_share": lambda: _ratio("n_distinct_words", "n_words"),
}


@dataclass(frozen=True)
class Condition:
    """``statistic > threshold`` if ``above``, else ``statistic <= threshold``."""

    statistic: str
    above: bool
    threshold: float

    def holds(self, data: dict[str, np.ndarray]) -> np.ndarray:
        values = data[self.statistic]
        return values > self.threshold if self.above else values <= self.threshold

    def column(self) -> Column:
        value = STATISTICS[self.statistic]()
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, data: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for condition in rule:
        hit &= condition.holds(data)
    return hit


def _grow(data: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Adds the condition with the largest information gain until no good row is covered."""
    rule: list[Condition] = []
    hit = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (hit & ~bad).any():
        p0, n0 = (hit & bad).sum(), (hit & ~bad).sum()
        best, best_gain = None, 1e-9
        for name, values in data.items():
            own = values[hit]
            cuts = np.unique(np.quantile(own, np.linspace(0, 1, CUTS + 1)))
            for cut in (cuts[:-1] + cuts[1:]) / 2:
                over = hit & (values > cut)
                for above, inside in ((True, over), (False, hit & ~over)):
                    p = (inside & bad).sum()
                    if not p:
                        continue
                    n = inside.sum() - p
                    gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                    if gain > best_gain:
                        best, best_gain = Condition(name, above, float(cut)), gain
        if best is None:
            break
        rule.append(best)
        hit &= best.holds(data)
    return tuple(rule)


def _prune(rule: Rule, data: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule that separates the pruning part best."""
    def worth(r: Rule) -> float:
        hit = covers(r, data, len(bad))
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def learn_rules(data: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """The ordered list: a document covered by any rule is of low quality, all others are kept."""
    part = np.arange(len(bad)) % 3 == 2
    sides = [({k: v[m] for k, v in data.items()}, bad[m]) for m in (~part, part)]
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and sides[0][1].any():
        rule = _prune(_grow(*sides[0]), *sides[1])
        if not rule:
            break
        hit = covers(rule, sides[1][0], len(sides[1][1]))
        if hit.sum() < SUPPORT or (hit & sides[1][1]).sum() < PRECISION * hit.sum():
            break
        rules.append(rule)
        left = []
        for own, own_bad in sides:
            stay = ~covers(rule, own, len(own_bad))
            left.append(({k: v[stay] for k, v in own.items()}, own_bad[stay]))
        sides = left
    return rules


def rule_number(rules: list[Rule]) -> Column:
    """Number of the first rule that holds (from 1), 0 if none does, as one ordered ``CASE WHEN``."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column()
        for condition in rule[1:]:
            test = test & condition.column()
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def _marks(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """The lowest label of each id that has one, and the hash of the id, by which training rows are chosen."""
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(f"`{id_col}`").alias("_id")).agg(F.min(label_col).alias("_good"))
    return marks.withColumn("_order", F.xxhash64("_id"))


def _first(rows: DataFrame) -> DataFrame:
    """Where there are more than ``TRAIN_ROWS``: those below a cut through the hashes that leaves a little more than wanted."""
    some = rows.count()
    share = min(1.0, 1.2 * TRAIN_ROWS / max(some, 1) + 100 / max(some, 1))
    return rows.where(F.col("_order") < F.lit(int((share - 0.5) * 2**64) if share < 1 else 2**63 - 1)) if some > TRAIN_ROWS else rows


def training_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Ids and texts of the rows that ``training_rows`` can take, found by their ids alone; no text is shuffled."""
    paths: list[str] = []
    keys = docs.select(F.col(f"`{id_col}`").alias("_key"))
    found = stage(keys.join(_marks(labels, id_col, label_col), F.col("_key") == F.col("_id")).select("_key", "_order"), "labelled", paths)
    taken = small(stage(_first(found).select("_key").distinct(), "taken"))
    clear(docs.sparkSession, paths)
    return docs.select(f"`{id_col}`", f"`{text_col}`").join(taken, F.col(f"`{id_col}`") == F.col("_key"), "left_semi")


def training_rows(counted: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Statistics and low-quality flags of at most ``TRAIN_ROWS`` labelled rows.

    A document labelled twice takes its lowest label; NULL labels and ids are left out. Where there are more,
    those with the smallest hashes of their ids are taken; the rest never leaves its tasks.
    """
    found = counted.select(F.col(f"`{id_col}`").alias("_key"), *(column().alias(name) for name, column in STATISTICS.items()))
    rows = _first(found.join(_marks(labels, id_col, label_col), F.col("_key") == F.col("_id")).select(*STATISTICS, "_good", "_order"))
    taken = rows.orderBy("_order", *STATISTICS).limit(TRAIN_ROWS).toPandas()
    return {name: taken[name].to_numpy(float) for name in STATISTICS}, (taken["_good"] == 0).to_numpy(bool)


def base_failed() -> Column:
    """Too short, or mostly repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    keep_text: bool = True,
) -> tuple[DataFrame, list[Rule]]:
    """``docs`` with ``COUNTS``, ``base_failed``, ``rule`` (0: none holds) and ``kept``, and the rules.

    The list is fitted on labelled rows. Counts without texts are made once and stored. With texts nothing as large as these is
    stored: the rows to train on are counted first, and all rows where the frame is read.
    NULL and empty texts have no words and fail; rows are judged each by itself, repeated
    ones alike. Without labelled rows, or without low-quality ones, the list is empty and
    the base test decides alone. Columns of the names added here are replaced.
    """
    counted = with_counts(docs.drop("base_failed", "rule", "kept"), text_col, keep_text)
    some = with_counts(training_texts(docs, labels, id_col, text_col, label_col), text_col, False) if keep_text else counted
    some = stage(some, "counts")
    rules = learn_rules(*training_rows(some, labels, id_col, label_col))
    counted = counted if keep_text else some
    judged = counted.withColumns({"base_failed": base_failed(), "rule": rule_number(rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules
