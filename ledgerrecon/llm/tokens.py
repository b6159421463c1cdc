"""Token ids of whole texts by the ``tokenizers`` library, each distinct piece between spaces encoded once.

A byte-level BPE never merges across the start of a space-led word, and a word-level
BPE never across white space. So a text is cut there, pieces seen before come from a
table in the worker, and only new pieces go through the tokenizer, many at a time.
Texts with white space of other kinds than single spaces and line breaks between words
are encoded whole.

What a worker learns it keeps in two tables: pieces met again are in a dictionary, and all pieces,
most of which are met once, in arrays sorted by a 64-bit hash, about 30 bytes for each. So a
worker sends each piece through the tokenizer once, and holds about 80 MB when both are full
(``FULL``); where other stages leave less room, smaller tables and chunks of text do with 30 MB (``LEAN``).
"""

from __future__ import annotations

import os
import re
from typing import NamedTuple

import numpy as np
import xxhash

from ledgerrecon.llm.common import held


class Tables(NamedTuple):
    """Pieces a worker keeps in its dictionary, in its sorted arrays, new ones it holds before it sorts them in, and
    bytes of text cut into pieces at once: memory against pieces encoded again, never a result."""

    hot: int
    pieces: int
    new: int
    text_bytes: int


FULL, LEAN = Tables(150_000, 1_500_000, 100_000, 2_000_000), Tables(60_000, 400_000, 25_000, 500_000)
#: Bytes of new pieces encoded in one call.
CALL_BYTES = 60_000
_WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_UNEVEN = (b"  ", b"\n\n", b" \n", b"\n ", b"\t", b"\r", b"\v", b"\f", b"\x1c", b"\x1d", b"\x1e", b"\x1f")
_WIDE_LEADS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


class _Shelf:
    """Pieces by their hash, with their ids: sorted keys, and where the ids of each lie in one run of bytes."""

    def __init__(self, tables: Tables = FULL):
        self.tables = tables
        self.keys, self.starts, self.ends = np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint32)
        self.ids, self.new = b"", {}

    def find(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids of those pieces that are here."""
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), np.uint64, len(pieces))
        found = {p: self.new[k] for p, k in zip(pieces, keys.tolist()) if k in self.new} if self.new else {}
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == keys)
            at, ids = at[hit], self.ids
            found.update(zip([pieces[i] for i in hit.tolist()], [ids[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist())]))
        return found

    def add(self, found: dict[bytes, bytes]) -> None:
        if len(self.keys) >= self.tables.pieces:
            return
        self.new.update(zip(map(xxhash.xxh3_64_intdigest, found), found.values()))
        if len(self.new) >= self.tables.new:
            ends = np.cumsum([len(x) for x in self.new.values()]) + len(self.ids)
            keys = np.concatenate([self.keys, np.fromiter(self.new, np.uint64, len(self.new))])
            order = np.argsort(keys, kind="stable")
            self.starts = np.concatenate([self.starts, np.concatenate([[len(self.ids)], ends[:-1]]).astype(np.uint32)])[order]
            self.ends = np.concatenate([self.ends, ends.astype(np.uint32)])[order]
            self.keys, self.ids, self.new = keys[order], b"".join([self.ids, *self.new.values()]), {}


class PieceTokenizer:
    """``encode`` gives the ids of a text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, tables: Tables = FULL):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.hot: dict[bytes, bytes] = {}
        self.tables, self.shelf = tables, _Shelf(tables)
        byte_level = "use_regex=True" in str(self.tokenizer.pre_tokenizer) and "Split" not in str(self.tokenizer.pre_tokenizer)
        #: Byte-level: pieces keep their space, and the bytes of ids tell where a piece ends.
        self.widths = self._byte_widths() if byte_level else None
        self.mark = None if byte_level else self.tokenizer.encode("\x01", add_special_tokens=False).ids

    def _byte_widths(self) -> np.ndarray:
        vocab = self.tokenizer.get_vocab()
        widths = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            widths[i] = len(token)  # one character for each byte
        return widths

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, text: bytes) -> bytes:
        return np.array(self._ids([text.decode()])[0], "<u4").tobytes()

    def _pieces(self, text: bytes) -> list[bytes] | None:
        """Pieces that can be encoded apart; None: the text must be encoded whole."""
        if self.widths is None:
            return text.split()
        if text[0] in b" \n" or text[-1] in b" \n" or any(x in text for x in _UNEVEN):
            return None
        if any(x in text for x in _WIDE_LEADS) and _WIDE_SPACE.search(text.decode()):
            return None
        pieces = text.replace(b"\n", b" \n").split(b" ")
        pieces[0] = b" " + pieces[0]  # the first word has no space before it
        return pieces

    def _learn(self, pieces: list[bytes], found: dict[bytes, bytes]) -> None:
        for start in range(0, len(pieces), 4000):
            group, some = [], 0
            for piece in pieces[start : start + 4000]:
                group.append(piece)
                some += len(piece) + 1
                if some >= CALL_BYTES:
                    self._encode_group(group, found)
                    group, some = [], 0
            self._encode_group(group, found)

    def _encode_group(self, group: list[bytes], found: dict[bytes, bytes]) -> None:
        if not group:
            return
        if self.widths is not None:
            first = [p for p in group if p[:1] == b" "]  # first words of texts, without a space
            found.update(zip(first, [np.array(i, "<u4").tobytes() for i in self._ids([p[1:].decode() for p in first])]))
            group = [p for p in group if p[:1] != b" "]
            spelled = [p if p[:1] == b"\n" else b" " + p for p in group]
            ids = np.array(self._ids([b"".join(spelled).decode()])[0], "<u4")
            cuts = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum([len(p) for p in spelled]), "left") + 1
            starts = np.concatenate([[0], cuts[:-1]])
        else:
            odd = [p for p in group if b"\x01" in p]
            for piece in odd:
                found[piece] = self._whole(piece)
            group = [p for p in group if b"\x01" not in p]
            ids = np.array(self._ids([b" \x01 ".join([*group, b""]).decode()])[0], "<u4")
            cuts = np.flatnonzero(ids == self.mark[0])
            starts = np.concatenate([[0], cuts[:-1] + 1])
        data = ids.tobytes()
        found.update(zip(group, [data[a:b] for a, b in zip((4 * starts).tolist(), (4 * cuts).tolist())]))

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text; none for NULL and empty ones."""
        hot, cut = self.hot, [self._pieces(t) if t else [] for t in texts]
        cold = list(set().union(*(c for c in cut if c)).difference(hot))
        again = self.shelf.find(cold)
        new: dict[bytes, bytes] = {}
        if len(again) < len(cold):
            self._learn([p for p in cold if p not in again], new)
            self.shelf.add(new)
        # for these texts all pieces are in one dictionary; those met again stay there while there is room
        hot.update(new)
        hot.update(again)
        out = [self._whole(text) if pieces is None else b"".join(map(hot.__getitem__, pieces)) for text, pieces in zip(texts, cut)]
        for piece in new:
            del hot[piece]
        if len(hot) > self.tables.hot:
            for piece in list(again)[: len(hot) - self.tables.hot]:
                del hot[piece]
        return out


def piece_tokenizer(path: str, tables: Tables = FULL) -> PieceTokenizer:
    """The worker's own, with what it learned in earlier tasks of the same tokenizer."""
    return held(("tokenizer", path, tables), lambda: PieceTokenizer(path, tables))
