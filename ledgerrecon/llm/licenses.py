"""License scans: digests of canonical texts, looked up among those of known licence texts.

A text is made canonical: lower case, lines that name an owner or a year out, equivalent spellings as one, all
punctuation and white space as single spaces. Equal canonical texts have equal digests, so the whole
text of a document is found by a hash join with the known ones. Each line of a document is a text
of its own as well, which finds the one-line notices that stand in other prose.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerrecon.llm.common import private_name, stage

#: Spellings that licence texts use for each other, the second is kept.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"),
    ("favour", "favor"), ("honour", "honor"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"),
    ("whilst", "while"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
)
#: Fixed value: lines that name owners and years. A line of the body that wraps before 'copyright' is none, nor is an
#: item '(c)' of a list, which stands after a semicolon.
OWNER_LINE = (
    r"(?m)^[ \t]*(?:copyright[ \t]*:?[ \t]*(?:(?:\(c\)|©)(?![ \t]*<)|\[|[12][0-9]{3})"
    r"|(?<!;\s{0,9}(?:and|or)?\s{0,40})\(c\)(?![ \t]*<)|©|all rights reserved[^\p{L}\p{N}\n]*$)[^\n]*$"
)
#: The lines that the SQL leaves out. Of the given tables it leaves out the same.
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
#: Known texts a scan holds in one value for lines, at most; the lines of a longer list are joined by their digests.
MAX_NOTICES = 10_000
#: Known digests that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Licence texts and one-line notices with the name of their licence.
KNOWN_TEXTS = (
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "ISC License\n" + _ISC),
    ("ISC", _ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
)

_TEXTS = Path(__file__).parent / "license_texts"
_CLAUSES = (
    """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.""",
    """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.""",
    """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.""",
)
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT {} AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {} OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def whole_texts() -> list[tuple[str, str]]:
    """Whole licences besides those of ``KNOWN_TEXTS``, in the forms they are usually kept in. Read on the driver."""
    out = []
    for clauses, title in ((2, "BSD 2-Clause License\n"), (3, "BSD 3-Clause License\n")):
        for head in ("", title):
            for numbered in (True, False):
                items = "\n".join(f"{k}. {x}" if numbered else f"* {x}" for k, x in enumerate(_CLAUSES[:clauses], 1))
                for first, second in (("HOLDERS", "HOLDER"), ("HOLDER", "HOLDER"), ("HOLDERS", "HOLDERS")):
                    out.append((f"BSD-{clauses}-Clause", head + _BSD.format(items, first, second)))
    for name, rest in (("Apache-2.0", "END OF TERMS AND CONDITIONS"), ("GPL-3.0", "END OF TERMS AND CONDITIONS"), ("CC0-1.0", None)):
        text = (_TEXTS / f"{name}.txt").read_text("utf-8")
        forms = [text]
        if rest:
            body = text[: text.index(rest)]
            forms += [body, body + rest]
        else:
            forms.append(text[text.index("CC0 1.0 Universal") :])
        out += [(name, form.replace("https://", scheme).replace("http://", scheme)) for form in forms for scheme in ("http://", "https://")]
    return out


def _lines(text: Column) -> Column:
    """Canonical but for line breaks."""
    out = F.regexp_replace(F.lower(text), F.lit(OWNER_LINE), F.lit(""))
    for other, kept in SPELLINGS:
        if " " in other or "-" in other:  # may be wrapped there; the white space stays
            pattern = other.replace(" ", r"(\s+)").replace("-", r"-(\s*)")
            out = F.regexp_replace(out, F.lit(pattern), F.lit(kept.replace(" ", "$1") if " " in kept else kept + "$1"))
        else:
            out = F.replace(out, F.lit(other), F.lit(kept))
    return F.regexp_replace(out, F.lit(r"[^\p{L}\p{N}\n]+"), F.lit(" "))


def canonical(text: Column) -> Column:
    """The canonical form of a text; '' for NULL."""
    return F.trim(F.regexp_replace(_lines(F.coalesce(text, F.lit(""))), F.lit(r"[ \n]+"), F.lit(" ")))


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, license_id, length) of known texts (``license_id``, ``text``); texts that are canonically empty are left out.

    Where two licences share a canonical text, the smaller name stands.
    """
    form = known.select("license_id", canonical(F.col("text")).alias("form")).where("form <> '' and license_id is not null")
    return form.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"), F.first(F.length("form")).alias("length"))


def default_texts(docs: DataFrame) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(a).alias("license_id"), F.lit(b).alias("text")) for a, b in (*KNOWN_TEXTS, *whole_texts())))
    return docs.sparkSession.range(1).select(F.inline(rows))


def find_licenses(docs: DataFrame, known: DataFrame | None = None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``text_digest``, ``license_id`` and ``notices`` to ``docs``.

    ``license_id``: the licence whose known text is the whole document; ``notices``: sorted licences whose
    known text is a whole line of it. NULL texts, and those canonically empty, have no digest, no licence and no
    notices. Rows are judged each by itself. Columns of the names added here are replaced, all others pass through.
    """
    added = ("text_digest", "license_id", "notices")
    digests = known_digests(default_texts(docs) if known is None else known)
    texts = digests.count()
    if texts > MAX_NOTICES:
        digests = stage(digests, "digests")
    names = [c for c in docs.columns if c.lower() not in added and (keep_text or c != text_col)]
    column = private_name(docs, "_lines")
    rows = docs.select(*[F.col(f"`{c}`") for c in names], _lines(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias(column))
    whole = F.trim(F.regexp_replace(F.col(column), F.lit(r"[ \n]+"), F.lit(" ")))
    rows = rows.withColumn("text_digest", F.when(F.length(whole) > 0, F.sha2(whole, 256)))
    table = digests.select(F.col("digest").alias("text_digest"), "license_id")
    small = lambda df: F.broadcast(df) if texts <= BROADCAST_ROWS else df
    empty = F.expr("cast(array() as array<string>)")
    if texts > MAX_NOTICES:
        rows = _notices_by_join(rows, column, digests, small, empty)
        return rows.join(small(table), "text_digest", "left").select(*[F.col(f"`{c}`") for c in names], *added)
    found = digests.collect()  # at most MAX_NOTICES short rows
    if found:
        by_digest = F.create_map(*(F.lit(x) for r in found for x in (r["digest"], r["license_id"])))
        sizes = F.lit(sorted({r["length"] for r in found}))
        # only a line as long as some known text can be one
        lines = F.filter(F.transform(F.split(F.col(column), "\n"), lambda x: F.trim(x)), lambda x: F.array_contains(sizes, F.length(x)))
        named = F.transform(F.array_distinct(lines), lambda x: F.try_element_at(by_digest, F.sha2(x, 256)))
        notices = F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull())))
    else:
        notices = empty
    rows = rows.withColumn("notices", notices).drop(column)
    return rows.join(small(table), "text_digest", "left").select(*[F.col(f"`{c}`") for c in names], *added)


def _notices_by_join(rows: DataFrame, column: str, digests: DataFrame, small, empty: Column) -> DataFrame:
    """``rows`` with their notices, the lines of each different text joined with the known digests."""
    spare = [private_name(rows, n) for n in ("_text", "_line", "_found")]
    key, line, found = spare
    keyed = rows.withColumn(key, F.sha2(F.col(column), 256))
    lines = keyed.select(F.col(key), F.explode(F.split(F.col(column), "\n")).alias(line)).select(F.col(key), F.sha2(F.trim(F.col(line)), 256).alias("digest"))
    hits = lines.join(small(digests.select("digest", "license_id")), "digest").groupBy(key).agg(F.sort_array(F.collect_set("license_id")).alias(found))
    joined = keyed.drop(column).join(hits, key, "left")
    return joined.withColumn("notices", F.coalesce(F.col(found), empty)).drop(key, found)

