"""Where the header of a file is, and what its columns are called."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import DataFrame

from ledgerrecon.functions.refs import ref
from ledgerrecon.labels import HEADER_SCAN_ROWS, HEADER_SCAN_SHARE

ORDINAL = "row_index"


def column_position(column: str | int | None) -> int:
    """0-based position of a column letter ('A', 'AB') or a 1-based number."""
    if column is None:
        return 0
    if isinstance(column, int):
        return column - 1 if column > 0 else column
    letters = column.strip().upper()
    if letters.isdigit():
        return max(int(letters) - 1, 0)
    if not letters or any(ch not in string.ascii_uppercase for ch in letters):
        raise ValueError(f"invalid column letter: {column!r}")
    position = 0
    for ch in letters:
        position = position * 26 + string.ascii_uppercase.index(ch) + 1
    return position - 1


def unique_names(names: Sequence[str]) -> list[str]:
    """Names with a suffix ``_1``, ``_2``, ... where one is already taken."""
    taken: dict[str, None] = {}
    for name in names:
        candidate, n = name, 0
        while candidate in taken:
            n += 1
            candidate = f"{name}_{n}"
        taken[candidate] = None
    return list(taken)


def has_blank_names(names: Sequence[str | None]) -> bool:
    """Some column has no name of its own."""
    return any(_nameless(n) for n in names)


def _nameless(name: str | None) -> bool:
    return name is None or not name.strip() or name.startswith("Unnamed")


def _filled(cell: str | None) -> bool:
    return cell is not None and bool(cell.strip())


def sanitized_names(names: Sequence[str | None]) -> list[str]:
    """Own names, ``column_{i}`` for the nameless, all different."""
    return unique_names([f"column_{i}" if _nameless(n) else n.strip() for i, n in enumerate(names)])


def detect_header(rows: Sequence[Sequence[str | None]], width: int) -> int | None:
    """0-based position of the fullest of the first rows; None if all are too empty."""
    counts = [sum(map(_filled, row)) for row in rows[:HEADER_SCAN_ROWS]]
    if not counts or max(counts) < max(1, int(HEADER_SCAN_SHARE * width)):
        return None
    return counts.index(max(counts))


def header_names(cells: Sequence[str | None], header_col: str | int | None = None) -> tuple[int, list[str]]:
    """First column and names of a header line, up to its last filled cell."""
    start = column_position(header_col)
    filled = [i for i, cell in enumerate(cells) if i >= start and _filled(cell)]
    if not filled:
        raise ValueError(f"no header cells from column {header_col} on")
    names = [c.strip() if c is not None else f"column_{i}" for i, c in enumerate(cells)][start:filled[-1] + 1]
    return start, unique_names(names)


def promote_header(df: DataFrame, header_row: int | None, header_col: str | int | None = None,
                   ordinal: str = ORDINAL, strict: bool = True) -> DataFrame:
    """Make a row of text cells the header and keep the rows below it.

    ``df`` has the 1-based line number in ``ordinal``; the rows that stay are
    numbered from 1 again. A header row that does not exist raises IndexError, or
    leaves ``df`` as it is when not ``strict``.
    """
    if not header_row:
        return df
    cells = [c for c in df.columns if c != ordinal]
    line = df.where(ref(ordinal) == header_row).select(*[ref(c) for c in cells]).head()
    if line is None:
        if strict:
            raise IndexError(f"header row {header_row} is out of range")
        return df
    start, names = header_names([None if v is None else str(v) for v in line], header_col)
    kept = [ref(c).alias(n) for c, n in zip(cells[start:], names)]
    return df.where(ref(ordinal) > header_row).select((ref(ordinal) - header_row).alias(ordinal), *kept)
