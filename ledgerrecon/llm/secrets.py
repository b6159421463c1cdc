"""Secret scans: fixed patterns, and a battery of randomness tests on token-like strings.

A candidate is a run of characters that keys and tokens are made of. Its encoding is
inferred from its characters, and three statistics say how far it is from an ordinary
string of that encoding (words, names joined by case or signs, padded numbers):

* chi-squared distance of its character counts from uniform: ordinary strings agree with
  themselves more often (``AGREEMENT``), which makes the distance noncentral;
* runs of character classes (digits, small, capital, signs): ordinary strings change class
  at most at a known rate (``CHANGES``) from one character to the next;
* serial correlation: in ordinary words vowels and consonants take turns, in ordinary hexadecimal
  strings neighbours are alike (``SERIAL``).

Each test gives a p-value, that of an ordinary string being so random, whose
power grows with length. They depend on each other, so Fisher's sum is scaled as for a
variance half as large again (Brown): ``p = exp(-t)(1 + t)`` with ``t = -2/3 (ln p1 + ln p2 + ln p3)``. The
Benjamini-Hochberg procedure, within each encoding and length band over all documents, bounds
the share of ordinary strings among those reported. If one candidate in a hundred is a secret, base64 strings
are found (nine of ten) from about 32 characters on, hexadecimal and base64url ones from 40, all from 64; at 24
characters, and without such a share, no test of this kind can tell them from ordinary strings. Strings of digits alone are never reported: identifiers
are as random as secrets.

Everything is column expressions. The p-values are rounded up to steps, so the procedure needs
only how many candidates fell on each step.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerrecon.llm.common import private_name, set_aside, stage

#: Share of ordinary strings among those reported, at most, in each encoding and length band.
FALSE_DISCOVERIES = 0.01
#: What ordinary strings do at most: chance that two characters agree, that the next one is of another class, and
#: the correlation of neighbours (negative: of vowels and consonants), by encoding.
AGREEMENT = {"hex": 0.16, "HEX": 0.16, "base62": 0.048, "base64url": 0.058}, 0.065
CHANGES = {"hex": 0.22, "HEX": 0.22, "base32": 0.05, "lower36": 0.08, "upper36": 0.08, "base62": 0.38, "base64url": 0.36}, 0.33
SERIAL = {"hex": 0.3, "HEX": 0.3}, -0.25
MIN_LENGTH = 20
BANDS = (20, 32, 48, 64, 128)
STEPS = 400  # p-values are kept as -10 log10, rounded down, up to 40 decades


@dataclass(frozen=True)
class Kind:
    """A fixed pattern; ``group`` is what ``least`` characters are asked of."""

    name: str
    pattern: str
    group: int
    least: int


#: The patterns asked for, in their order.
KINDS = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20),
    Kind("hex", r"[0-9a-f]+", 0, 24),
)
_VOWELS = "aeiouyAEIOUY"
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}={{0,2}}"

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CHARACTERS = _DIGITS + _LOWER + _UPPER + "-_+/"
_CLASSES = "0" * 10 + "a" * 26 + "A" * 26 + "-" * 4
#: Encodings from the narrowest alphabet to the widest: name, what they are written in, alphabet.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", _DIGITS),
    ("hex", r"^[0-9a-f]+$", _DIGITS + _LOWER[:6]),
    ("HEX", r"^[0-9A-F]+$", _DIGITS + _UPPER[:6]),
    ("base32", r"^[A-Z2-7]+=*$", _UPPER + "234567"),
    ("lower36", r"^[0-9a-z]+$", _DIGITS + _LOWER),
    ("upper36", r"^[0-9A-Z]+$", _DIGITS + _UPPER),
    ("base62", r"^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    ("base64url", r"^[0-9A-Za-z_-]+=*$", _UPPER + _LOWER + _DIGITS + "-_"),
    ("base64", r"^[0-9A-Za-z+/]+=*$", _UPPER + _LOWER + _DIGITS + "+/"),
)


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost matches that do not overlap: array of (start, end, part), in code points.

    ``split`` and ``regexp_extract_all`` find the same matches; what stands between them gives the places.
    """
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )
    empty = F.expr("cast(array() as array<struct<start:int,end:int,part:string>>)")
    walked = F.aggregate(
        F.filter(found, lambda x: x["match"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.char_length(x["gap"]) + F.char_length(x["match"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.char_length(x["gap"])).alias("start"),
                (acc["at"] + F.char_length(x["gap"]) + F.char_length(x["match"])).alias("end"),
                x["part"].alias("part"),
            ))).alias("out"),
        ),
    )["out"]
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns: array of (start, rank, kind, end), in order."""
    def of(rank: int, kind: Kind) -> Column:
        # a run shorter than asked for cannot match in part, so these two patterns can ask for the length at once
        pattern = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}.get(kind.name, kind.pattern)
        good = F.filter(located(text, pattern, kind.group), lambda m: F.char_length(m["part"]) >= kind.least)
        return F.transform(good, lambda m: F.struct(
            m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), m["end"].alias("end")))

    return F.array_sort(F.concat(*(of(rank, kind) for rank, kind in enumerate(KINDS))))


def _below(z: Column) -> Column:
    """-ln P(Z <= z) of a standard normal, a little too small (Pollak's bound), so that no p-value is too small."""
    x = F.abs(z)
    far = x * x / 2 + F.log((x + F.sqrt(x * x + 8 / math.pi)) * (math.sqrt(2 * math.pi) / 2))
    return F.when(z <= 0, far).otherwise(-F.log1p(-F.exp(-far)))


def _more(share: Column, n: Column, rate: Column) -> Column:
    """-ln P(share or more of n tries succeed) at a success rate, by the Bahadur-Rao form of the large-deviation bound."""
    x = F.least(share, 1 - 0.25 / n)
    excess = x * F.log(x / rate) + (1 - x) * F.log((1 - x) / (1 - rate))
    tilt = 1 - rate * (1 - x) / (x * (1 - rate))
    spread = F.sqrt(F.greatest(x * (1 - x), 0.25 / n) * n * (2 * math.pi))
    return F.when(x > rate, n * excess + F.greatest(F.log(tilt * spread), F.lit(0.0))).otherwise(F.lit(0.0))


def _by_encoding(table: tuple[dict[str, float], float], encoding: Column) -> Column:
    out = F.lit(table[1])
    for name, value in table[0].items():
        out = F.when(encoding == name, F.lit(value)).otherwise(out)
    return out


def _with(array: Column, kept: tuple[str, ...], **added: Callable[[Column], Column]) -> Column:
    """Each struct of an array with further fields; what a step made is a value in the next one, made once."""
    return F.transform(array, lambda x: F.struct(*(x[k].alias(k) for k in kept), *(f(x).alias(k) for k, f in added.items())))


def _coded(value: str) -> Callable[[Column], Column]:
    def pick(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern, letters in reversed(ENCODINGS):
            out = F.when(x["part"].rlike(pattern), F.lit(name if value == "name" else letters)).otherwise(out)
        return out

    return pick


def battery(matches: Column) -> Column:
    """(start, end, stratum, step) of each candidate: its encoding and length band, and its p-value's step (-10 log10 p)."""
    places = ("start", "end")
    one = _with(matches, places, body=lambda x: F.rtrim(x["part"], F.lit("=")), encoding=_coded("name"), letters=_coded("letters"))
    two = _with(
        one, (*places, "body", "encoding"),
        n=lambda x: F.char_length(x["body"]).cast("double"), size=lambda x: F.char_length(x["letters"]).cast("double"),
        # places in the alphabet, or which are vowels
        at=lambda x: F.transform(F.split(x["body"], ""), lambda c: F.when(
            x["encoding"].isin("hex", "HEX"), F.instr(x["letters"], c)).otherwise(F.lit(_VOWELS).contains(c).cast("int")).cast("double")),
        # counts by taking each letter out: linear in the token for each of at most 64 letters
        squares=lambda x: F.aggregate(
            F.array_distinct(F.split(x["body"], "")), F.lit(0.0),
            lambda total, c: total + F.pow(F.char_length(x["body"]) - F.char_length(F.replace(x["body"], c)), F.lit(2.0)),
        ),
        changes=lambda x: F.regexp_count(F.translate(x["body"], _CHARACTERS, _CLASSES), F.lit("0+|a+|A+|-+")).cast("double") - 1,
    )
    three = _with(
        two, (*places, "encoding", "n", "size", "at", "squares", "changes"),
        mean=lambda x: F.aggregate(x["at"], F.lit(0.0), lambda total, p: total + p) / x["n"],
        next=lambda x: F.arrays_zip(F.slice(x["at"], 1, F.size(x["at"]) - 1).alias("a"), F.slice(x["at"], 2, F.size(x["at"]) - 1).alias("b")),
    )
    four = _with(
        three, (*places, "encoding", "n", "size", "changes"),
        distance=lambda x: F.greatest(x["size"] * x["squares"] / x["n"] - x["n"], F.lit(0.0)),
        # what ordinary strings add to the distance
        beyond=lambda x: F.greatest(F.lit(0.2), _by_encoding(AGREEMENT, x["encoding"]) * x["size"] - 1) * x["n"],
        spread=lambda x: F.aggregate(x["at"], F.lit(0.0), lambda total, p: total + (p - x["mean"]) * (p - x["mean"])),
        together=lambda x: F.aggregate(x["next"], F.lit(0.0), lambda total, y: total + (y["a"] - x["mean"]) * (y["b"] - x["mean"])),
    )
    five = _with(
        four, (*places, "encoding", "n"),
        uniform=_uniform,
        runs=lambda x: _more(x["changes"] / (x["n"] - 1), x["n"] - 1, _by_encoding(CHANGES, x["encoding"])),
        serial=_serial,
    )
    six = _with(five, (*places, "encoding", "n"), t=lambda x: (x["uniform"] + x["runs"] + x["serial"]) * (2 / 3))
    tested = lambda x: (x["n"] >= MIN_LENGTH) & x["encoding"].isNotNull() & (x["encoding"] != "decimal")
    step = lambda x: F.least(F.lit(STEPS), F.floor((x["t"] - F.log1p(x["t"])) * (10 / math.log(10)))).cast("int")
    return _with(
        six, places,
        stratum=lambda x: F.concat_ws(":", x["encoding"], _band(x["n"]).cast("string")),
        step=lambda x: F.when(tested(x), step(x)).otherwise(0),
    )


def _uniform(x: Column) -> Column:
    """The distance against a noncentral chi-squared one, by the normal approximation of its cube root."""
    mean = x["size"] - 1 + x["beyond"]
    variance = (1 + x["beyond"] / mean) * 2 / (9 * mean)
    return _below((F.pow(x["distance"] / mean, F.lit(1 / 3)) - (1 - variance)) / F.sqrt(variance))


def _serial(x: Column) -> Column:
    correlation = x["together"] / x["spread"]
    limit = _by_encoding(SERIAL, x["encoding"])
    off = F.when(x["encoding"].isin("hex", "HEX"), correlation - limit).otherwise(limit - correlation) * F.sqrt(x["n"])
    # without vowels, or of one character, a string has no correlation and this test says nothing
    return F.when(x["spread"] > 0, _below(off)).otherwise(F.lit(0.0))


def _band(n: Column) -> Column:
    band = F.lit(BANDS[0])
    for least in BANDS[1:]:
        band = F.when(n >= least, F.lit(least)).otherwise(band)
    return band


def thresholds(scanned: DataFrame, false_discoveries: float) -> dict[str, int]:
    """The least step reported in each stratum: Benjamini-Hochberg on counts of steps.

    The driver sees at most one row for each encoding, band and step.
    """
    counted = (
        # the outer form, as Spark tests the array of the other one first, and so makes it twice
        scanned.select(F.explode_outer("_candidates").alias("c")).where("c IS NOT NULL").groupBy(F.col("c.stratum").alias("stratum"), F.col("c.step").alias("step"))
        .count().collect()
    )
    by_stratum: dict[str, dict[int, int]] = {}
    for row in counted:
        by_stratum.setdefault(row["stratum"], {})[row["step"]] = row["count"]
    out = {}
    for stratum, counts in by_stratum.items():
        total, rank, best = sum(counts.values()), 0, None
        for step in sorted(counts, reverse=True):
            rank += counts[step]
            if 10 ** (-step / 10) <= false_discoveries * rank / total:
                best = step
        if best is not None:
            out[stratum] = best
    return out


def find_secrets(
    docs: DataFrame, text_col: str = "text", false_discoveries: float = FALSE_DISCOVERIES, keep_text: bool = True,
) -> DataFrame:
    """Adds ``base_spans`` and ``spans`` to ``docs``: arrays of (start, rank, kind, end), by start and
    then kind, in code points, end exclusive.

    ``spans`` has the base spans and those the battery reports (kind ``random``, last in rank) that no
    base span holds. NULL and empty texts have none. Rows are judged each by itself but for the
    discovery bound, which is over all candidates of the frame. Columns ``base_spans`` and ``spans`` are
    replaced, all others pass through. Without texts the scan is stored; with them nothing as large as these is: candidates
    are tested once for the bound, and again where the frame is read and any are to be reported.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    tested = private_name(docs, "_candidates")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("base_spans", "spans") and (keep_text or c != text_col)]
    scanned = docs.select(*kept, base_spans(text).alias("base_spans"), battery(located(text, CANDIDATE)).alias(tested))
    scanned = scanned if keep_text else stage(scanned, "scanned")
    limits = thresholds(scanned.select(F.col(tested).alias("_candidates")), false_discoveries)
    found = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)")
    if limits:
        least = F.create_map(*(F.lit(x) for pair in sorted(limits.items()) for x in pair))
        reported = F.filter(tested, lambda c: c["step"] >= F.try_element_at(least, c["stratum"]))
        new = F.filter(reported, lambda c: ~F.exists("base_spans", lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"])))
        found = F.transform(new, lambda c: F.struct(
            c["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit("random").alias("kind"), c["end"].alias("end")))
    return scanned.withColumn("spans", F.array_sort(F.concat("base_spans", found))).drop(tested)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", false_discoveries: float = FALSE_DISCOVERIES) -> DataFrame:
    """``docs`` with every span replaced by ``mark``, overlapping ones by one; ``n_chars``, where there is one, follows.

    Documents without spans, and NULL texts, stay as they are.
    """
    docs, originals = set_aside(docs, ("base_spans", "spans"))
    found = find_secrets(docs, text_col, false_discoveries)
    text, place = F.col(f"`{text_col}`"), private_name(found, "_cut")
    cut = F.aggregate(
        "spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
    )
    out = found.withColumn(place, F.when(F.size("spans") > 0, cut))
    done = F.col(place)
    whole = F.concat(done["out"], F.substr(text, done["at"] + 1, F.char_length(text)))
    out = out.withColumn(text_col, F.when(done.isNotNull(), whole).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(done.isNotNull(), F.char_length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*originals)
