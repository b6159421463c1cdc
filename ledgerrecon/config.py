"""Job parameters as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class KeyDef:
    """One reconciliation key: the columns that build it on each side."""

    name: str
    a_cols: tuple[str, ...] = ()
    b_cols: tuple[str, ...] = ()

    def columns(self, side: str | None) -> tuple[str, ...]:
        """Columns for side 'a' or 'b'; any other ledger uses both lists."""
        if side == "a":
            return tuple(self.a_cols)
        if side == "b":
            return tuple(self.b_cols)
        return tuple(self.a_cols) + tuple(self.b_cols)


@dataclass(frozen=True)
class ReconConfig:
    """How two ledgers are compared. Key order is key priority."""

    keys: tuple[KeyDef, ...]
    value_column_a: str | None = None
    value_column_b: str | None = None
    invert_a: bool = False
    invert_b: bool = False
    threshold: float = 0.0
    allow_no_value: bool = False
    id: int = 0
    name: str = ""
    base_a_id: int | None = None
    base_b_id: int | None = None

    def __post_init__(self) -> None:
        names = [k.name for k in self.keys]
        if len(set(names)) != len(names):
            raise ValueError(f"key names must be unique: {names}")

    def side_of(self, dataset_id: int | None) -> str | None:
        """'a' or 'b' for the ledgers of this config, None for any other."""
        if dataset_id is not None and dataset_id == self.base_a_id:
            return "a"
        if dataset_id is not None and dataset_id == self.base_b_id:
            return "b"
        return None


@dataclass(frozen=True)
class CancellationConfig:
    indicator_column: str
    canceled_value: object
    active_value: object = None
    mode: str = "normalized"


@dataclass(frozen=True)
class ReversalConfig:
    column_a: str
    column_b: str
    value_column: str
    mode: str = "all_pairs"
    tolerance: float = 1e-9


@dataclass(frozen=True)
class SourceSpec:
    """Where a ledger file lies and where its header is (1-based line)."""

    path: str
    format: str = "csv"
    header_row: int | None = None
    header_col: str | int | None = None
    multi_line: bool | None = None  # None: looked up in the file
