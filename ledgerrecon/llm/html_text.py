"""Main text of web pages, by the template that pages of one host share.

A page is a sequence of tokens: its structural tags, each with the path of open elements, and
its text blocks. The occurrence vector of a token says how often it stands in each page of its
host. It is never built: the sum of one hash for each (page, number of times) stands for it, so
one aggregation gives the vectors of all tokens of all hosts, however many pages a host has.
Tokens of a host with equal vectors are an equivalence class.

A class is valid if it is large and frequent enough and its tokens keep one order in all its
pages, which a second aggregation tells from the token before each. Valid classes nest by their
paths into the host's template; pages with the same content count once as support. What stands
between template tokens is a slot. A token that stands in several slots has a role in each: with the
tags of the template known, occurrences are told apart by the last such tag before them, their vectors
are taken anew, and so on until no page of any host tells more (``differentiated``). So a text that
every page has twice, at the top and at the bottom, is found in both places. A text block that is itself in the class of tokens that
every page holds exactly once is part of the template, not of a slot. Of the slots, those go
whose place in the template, a path of element names, classes, ids and roles, says menu,
header, footer, sidebar, notice, advert, form, script, style or comment; if the template (or,
with too few pages to deduce one, the page itself) has an article or main element, slots
outside it go, too. What remains is decoded, cleaned and joined in page order.

Edge cases: NULL or empty html gives ''; a NULL url or one without host makes its page one of
the host ''; hosts with fewer than ``SUPPORT`` different pages have no text in their template;
repeated rows and copies count once for a vector; unclosed, crossed and cut tags are taken as
they come, an end tag without its start is passed over; columns of the input are not touched.
"""

from __future__ import annotations

import html
import re
import struct
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerrecon.llm.common import arrow_map, lower_ascii, stage

#: Different pages of a host that a template with texts needs.
SUPPORT = 8
#: Tokens of a class that is not just a chance agreement.
CLASS_TOKENS = 3
#: Template tokens that are broadcast; more are joined by host, and adaptive execution splits hot hosts.
BROADCAST_TOKENS = 500_000
TAG, TEXT, ARTICLE = 0, 1, 2

# names of the HTML standard: elements whose content is no markup, that stay inside a line, that have no end tag,
# that make up the structure of a page
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "noembed", "noframes", "xmp")
INLINE = frozenset((
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
))
STRUCTURE = frozenset((
    "html", "head", "body", "nav", "header", "footer", "aside", "main", "article", "section", "div", "form", "ul", "ol", "li", "dl",
    "table", "figure", "menu", "dialog", "fieldset", "details", "center", "search", "select", "button", "object", "video", "audio",
))
# places of a page that hold no main text: elements, roles, and words of classes and ids
CHROME_ELEMENTS = frozenset((
    "head", "nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "select", "button", "object", "video", "audio", "search",
))
CHROME_ROLES = frozenset((
    "navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form", "toolbar",
))
CHROME_WORDS = frozenset((
    "ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertisements", "advertising", "banner", "breadcrumb", "breadcrumbs",
    "comment", "comments", "consent", "cookie", "cookies", "disclaimer", "footer", "gdpr", "header", "login", "masthead", "menu",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promotion", "related",
    "replies", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
))
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?P<rawattrs>[^>]*)>.*?(?:</(?P=raw)\b[^>]*>|\Z)|"
    r"<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</[^>]*>?|"
    r"<(?P<cut>/?[A-Za-z][^<>]*)\Z", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _step(name: str, attributes: str) -> tuple[str, bool]:
    """An element as a step of a path, and whether it holds no main text."""
    words, roles = set(), set()
    if attributes and "=" in attributes:
        for kind, *values in _ATTRIBUTE.findall(attributes):
            value = "".join(values)
            (roles if kind.lower() == "role" else words).update(_WORD.findall(_CAMEL.sub(" ", value).lower()))
    chrome = name in CHROME_ELEMENTS or bool(roles & CHROME_ROLES) or (name not in ("html", "body", "main") and bool(words & CHROME_WORDS))
    return ".".join([name, *sorted(words | roles)]), chrome


class Piece:
    """A text block with where it stands."""

    __slots__ = ("path", "chrome", "main", "at", "parts")

    def __init__(self, path: str, chrome: bool, main: bool, at: int):
        self.path, self.chrome, self.main, self.at, self.parts = path, chrome, main, at, []  # ``at``: tags before it

    @property
    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def read_page(source: str) -> tuple[list[tuple[str, bool]], list[Piece]]:
    """Tags that are not inside a line, by path and whether they begin an article, and the text blocks, in page order."""
    steps: list[tuple[str, str, bool, bool]] = []  # open elements: name, path, whether chrome, whether in an article
    tags: list[tuple[str, bool]] = []
    pieces: list[Piece] = []
    current: Piece | None = None
    at = 0

    def add(text: str) -> None:
        nonlocal current
        if current is None:
            current = Piece(*(steps[-1][1:] if steps else ("", False, False)), len(tags))
            pieces.append(current)
        current.parts.append(text)

    for token in _TOKEN.finditer(source):
        if token.start() > at:
            add(source[at : token.start()])
        at = token.end()
        name = (token["name"] or "").lower()
        if not name or name in INLINE:
            continue
        current = None
        path = steps[-1][1] if steps else ""
        if name not in STRUCTURE:
            tags.append((f"{path}/{token['end']}{name}", False))
            continue
        if token["end"]:
            if any(s[0] == name for s in steps):
                while steps.pop()[0] != name:
                    pass
                tags.append((f"{steps[-1][1] if steps else ''}/-{name}", False))
            continue
        step, chrome = _step(name, token["attrs"])
        article = name in ("article", "main") and not chrome
        if name == "body":  # a head ends where the body begins
            steps = [s for s in steps if s[0] != "head"]
        while article and steps and steps[-1][0] in ("nav", "header", "ul", "ol", "li", "menu", "head"):
            steps.pop()  # never closed
        if name == "li" and steps and steps[-1][0] == "li":
            steps.pop()
        path, around, inside = steps[-1][1:] if steps else ("", False, False)
        # the header of a page is no text, the header of an article is
        chrome = chrome or around or (name == "header" and not inside)
        steps.append((name, f"{path}/{step}", chrome, inside or article))
        tags.append((f"{path}/{step}", article))
    if at < len(source):
        add(source[at:])
    return tags, pieces


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _text_token(piece: Piece, text: str) -> int:
    return _hash(f"{piece.path}\0{text}")


def _page_tokens(tags: list[tuple[str, bool]], pieces: list[Piece]) -> tuple[list[int], list[int], list[int]]:
    """Tokens of a page in its order, their kinds, and which piece each is (-1: a tag); pieces without text are none."""
    tokens, kinds, owners, done = [], [], [], 0

    def pass_tags(end: int) -> None:
        nonlocal done
        for path, article in tags[done:end]:
            tokens.append(_hash(path))
            kinds.append(ARTICLE if article else TAG)
            owners.append(-1)
        done = max(done, end)

    for k, piece in enumerate(pieces):
        if text := piece.text:
            pass_tags(piece.at)
            tokens.append(_text_token(piece, text))
            kinds.append(TEXT)
            owners.append(k)
    pass_tags(len(tags))
    return tokens, kinds, owners


def differentiated(tokens: list[int], rounds: list[dict]) -> list[int]:
    """Tokens in their roles: in each round, what is not of the template yet is named after the last template tag before it."""
    for known in rounds:
        slots, fixed, slot, roles = frozenset(known["slots"]), frozenset(known["fixed"]), None, []
        for token in tokens:
            if token in slots:
                slot = token
            elif slot is not None and token not in fixed:
                token = xxhash.xxh3_64_intdigest(struct.pack("<qq", token, slot)) - (1 << 63)
            roles.append(token)
        tokens = roles
    return tokens


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, tokens, kinds) of each page; ``page`` is a digest of its content."""
    for batch in batches:
        for start in range(0, len(batch), 100):
            rows: list[tuple] = []
            for host, source in zip(*(batch.column(c).slice(start, 100).to_pylist() for c in ("host", "html"))):
                if source:
                    tokens, kinds, _ = _page_tokens(*read_page(source))
                    page = xxhash.xxh3_64_intdigest(struct.pack(f"<{len(tokens)}q", *tokens)) - (1 << 63)
                    rows.append((host, page, tokens, kinds))
            if rows:
                host, page, tokens, kinds = zip(*rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(host, pa.string()), pa.array(page), pa.array(tokens, pa.list_(pa.int64())), pa.array(kinds, pa.list_(pa.int8()))], [*_SEQUENCE])


_SEQUENCE = ("host", "page", "tokens", "kinds")


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, token, kind, times, place) for each role of a token in a page."""
    for batch in batches:
        for start in range(0, len(batch), 100):
            rows: list[tuple] = []
            for host, page, tokens, kinds, rounds in zip(*(batch.column(c).slice(start, 100).to_pylist() for c in (*_SEQUENCE, "rounds"))):
                found = Counter(zip(differentiated(tokens, rounds or []), kinds))
                rows += [(host, page, token, kind, n, i) for i, ((token, kind), n) in enumerate(found.items())]  # by first occurrence
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["host", "page", "token", "kind", "times", "place"])


def _template_tokens(occurrences: DataFrame) -> DataFrame:
    """By ``host``: the texts (``fixed``) and tags (``slots``) that every page has exactly once, and whether the template has an article."""
    seen = stage(occurrences, "occurrences")
    # copies of a page are one page
    seen = seen.groupBy("host", "page", "token", "kind").agg(F.max("times").alias("times"), F.min("place").alias("place"))
    support = seen.groupBy("host", "page").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("host_pages"))
    vector = F.sum(F.xxhash64("page", "times").cast("decimal(38,0)")).alias("vector")
    tokens = seen.groupBy("host", "token", "kind").agg(vector, F.count("*").alias("pages"), F.max("times").alias("most"))
    tokens = stage(tokens.where(F.col("pages") >= SUPPORT), "vectors")
    classes = tokens.groupBy("host", "vector", "pages", "most").agg(F.count("*").alias("size")).where(F.col("size") >= CLASS_TOKENS)
    members = stage(tokens.join(classes.drop("size"), ["host", "vector", "pages", "most"]), "members")
    # the tags of a class, page by page, in the order they first come up: one order in all pages, or the class is none
    tags = members.where(F.col("kind") != TEXT).select("host", "token", "vector")
    if members.count() <= BROADCAST_TOKENS:
        tags = F.broadcast(tags)
    orders = seen.join(tags, ["host", "token"]).groupBy("host", "vector", "page").agg(
        F.xxhash64(F.transform(F.sort_array(F.collect_list(F.struct("place", "token"))), lambda t: t["token"])).alias("order"))
    crossed = orders.groupBy("host", "vector").agg(F.min("order").alias("a"), F.max("order").alias("b")).where("a <> b")
    valid = members.join(crossed.select("host", "vector"), ["host", "vector"], "left_anti").join(support, "host")
    everywhere = (F.col("pages") == F.col("host_pages")) & (F.col("most") == 1)
    return valid.groupBy("host").agg(  # lists no longer than a page
        F.collect_list(F.when((F.col("kind") == TEXT) & everywhere, F.col("token"))).alias("fixed"),
        F.collect_list(F.when((F.col("kind") != TEXT) & everywhere, F.col("token"))).alias("slots"),
        F.bool_or(F.col("kind") == ARTICLE).alias("limited"))


def _beside(rows: DataFrame, facts: DataFrame, host: str, rounds: str = "rounds") -> DataFrame:
    """Rows with the facts of their host, which are broadcast up to a counted size; a stored frame of few rows a host."""
    size = facts.agg(F.count("*") + F.coalesce(F.sum(F.aggregate(
        rounds, F.lit(0), lambda n, r: n + F.size(r["fixed"]) + F.size(r["slots"]))), F.lit(0))).head()[0]
    return rows.join(F.broadcast(facts) if size <= BROADCAST_TOKENS else facts, host, "left")


def deduce_templates(pages: DataFrame) -> DataFrame:
    """The template of each ``host`` from the ``html`` of its pages: one row for each host that has one, stored.

    ``rounds`` holds, for each round of telling roles apart, the texts and tags, in the roles of that round,
    that every page of the host has exactly once; ``limited`` says that an article or main element is part of the template.
    """
    sequences = stage(arrow_map(pages.select("host", "html"), _sequences, "host string, page long, tokens array<long>, kinds array<byte>"), "sequences")
    none = F.array().cast(_ROUNDS).alias("rounds")
    found = _template_tokens(arrow_map(sequences.select("*", none), _occurrences, _OCCURRENCE))
    known = F.struct("slots", "fixed")
    templates = stage(found.select("host", F.array(known).alias("rounds"), "limited", (F.size("slots") > 0).alias("open")), "templates")
    while templates.where("open").limit(1).count():
        # only hosts whose last round found more tags of the template
        told = stage(templates.where("open").select("host", "rounds"), "told")
        rows = _beside(sequences, told, "host").where("rounds is not null")
        found = _template_tokens(arrow_map(rows.select(*_SEQUENCE, "rounds"), _occurrences, _OCCURRENCE))
        more = found.select("host", known.alias("more"))
        before = F.element_at("rounds", -1)
        grown = F.col("more").isNotNull() & F.col("open") & (
            (F.size("more.slots") > F.size(before["slots"])) | (F.size("more.fixed") > F.size(before["fixed"])))
        templates = stage(templates.join(more, "host", "left").withColumn("grown", grown).select(
            "host", F.when(F.col("grown"), F.concat("rounds", F.array("more"))).otherwise(F.col("rounds")).alias("rounds"), "limited",
            (F.col("grown") & (F.size("more.slots") > F.size(before["slots"]))).alias("open")), "templates")
    return templates.select("host", "rounds", "limited")


_ROUNDS = "array<struct<slots:array<bigint>,fixed:array<bigint>>>"
_OCCURRENCE = "host string, page long, token long, kind long, times long, place long"


def main_text(source: str | None, rounds: list[dict] | None = None, limited: bool | None = None) -> str:
    """Text of the slots of a page that are no menus, adverts and the like.

    ``rounds`` are those of its host's template; ``limited`` says whether that has an article or main
    element (None: there is no template, the page decides).
    """
    if not source:
        return ""
    tags, pieces = read_page(source)
    kept = [(k, p) for k, p in enumerate(pieces) if not p.chrome]
    if limited is not False and any(p.main for _, p in kept):
        kept = [(k, p) for k, p in kept if p.main]
    template = set()
    if rounds and any(known["fixed"] for known in rounds):
        tokens, _, owners = _page_tokens(tags, pieces)
        # a token of the template keeps its name from its round on, so the last round tells them all
        fixed = frozenset(rounds[-1]["fixed"]).union(*(known["fixed"] for known in rounds))
        template = {owner for token, owner in zip(differentiated(tokens, rounds[:-1]), owners) if token in fixed}
    return " ".join(text for k, p in kept if k not in template and (text := p.text))


def _extractor(html_col: str, rounds_col: str, limited_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 200):
                part = batch.slice(start, 200)
                texts = [
                    main_text(source, rounds, limited)
                    for source, rounds, limited in zip(*(part.column(c).to_pylist() for c in (html_col, rounds_col, limited_col)))
                ]
                kept = part.drop_columns([rounds_col, limited_col])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(texts, pa.string())], [*kept.schema.names, "text"])

    return run


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of its html; an own column of that name is replaced."""
    rows = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() != "text"])
    taken = {c.lower() for c in rows.columns}

    def private(name: str) -> str:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        return name

    host, rounds, limited = private("_host"), private("_rounds"), private("_limited")
    named = lower_ascii(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    templates = deduce_templates(rows.select(named.alias("host"), F.col(f"`{html_col}`").alias("html")))
    facts = templates.select(F.col("host").alias(host), F.col("rounds").alias(rounds), F.col("limited").alias(limited))
    placed = _beside(rows.withColumn(host, named), facts, host, rounds).drop(host)
    schema = T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())])
    return arrow_map(placed, _extractor(html_col, rounds, limited), schema)
