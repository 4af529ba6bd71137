"""Statements and expressions of the SQL dialect."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Literal:
    value: Any  # int, float, str, bool, None or a tuple of floats (a vector)


@dataclass(frozen=True)
class Param:
    index: int  # from 0


@dataclass(frozen=True)
class Name:
    column: str
    qualifier: str | None = None


@dataclass(frozen=True)
class Unary:
    op: str
    operand: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class IsNull:
    operand: Any
    negated: bool


@dataclass(frozen=True)
class Like:
    operand: Any
    pattern: Any
    negated: bool


@dataclass(frozen=True)
class InList:
    operand: Any
    items: tuple
    negated: bool


@dataclass(frozen=True)
class Call:
    name: str  # lower case
    args: tuple


@dataclass(frozen=True)
class Aggregate:
    """COUNT, SUM, AVG, MIN or MAX of a column; of all rows where `arg` is None."""

    name: str
    arg: Name | None
    distinct: bool = False

    @property
    def display(self) -> str:
        inner = "*" if self.arg is None else f"{self.arg.qualifier}.{self.arg.column}" if self.arg.qualifier else self.arg.column
        return f"{self.name}({'DISTINCT ' if self.distinct else ''}{inner})"


@dataclass(frozen=True)
class Item:
    """A projected column or aggregate."""

    expr: Any
    alias: str | None = None

    @property
    def header(self) -> str:
        return self.alias or (self.expr.display if isinstance(self.expr, Aggregate) else self.expr.column)


@dataclass(frozen=True)
class Source:
    table: str
    alias: str | None = None

    @property
    def scope(self) -> str:
        return self.alias or self.table


@dataclass(frozen=True)
class Join:
    source: Source
    how: str  # inner, left, right, full
    on: Any = None
    using: tuple[str, ...] = ()
    natural: bool = False
    cross: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...] | None  # None: *
    source: Source
    joins: tuple[Join, ...] = ()
    where: Any = None
    group: tuple[Name, ...] = ()
    having: Any = None
    order: Any = None
    descending: bool = False
    limit: Any = None
    distinct: bool = False


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple, ...]


@dataclass(frozen=True)
class Update:
    source: Source
    sets: tuple[tuple[str, Any], ...]
    where: Any = None


@dataclass(frozen=True)
class Delete:
    source: Source
    where: Any = None


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str  # int, real, text, bool, json, vector
    declared: str
    dim: int = 0
    primary_key: bool = False
    unique: bool = False
    not_null: bool = False
    default: Any = None
    has_default: bool = False


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnDef, ...]
    if_not_exists: bool = False


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str
    unique: bool = False
    using: str = "btree"
    metric: str = "l2"
    if_not_exists: bool = False


@dataclass(frozen=True)
class Drop:
    kind: str  # table or index
    name: str
    if_exists: bool = False


@dataclass(frozen=True)
class Alter:
    table: str
    action: str  # rename, rename_column, add_column, drop_column
    old: str = ""
    new: str = ""
    column: ColumnDef | None = None
    if_exists: bool = False
    column_guard: bool = False  # ADD COLUMN IF NOT EXISTS, DROP COLUMN IF EXISTS


@dataclass(frozen=True)
class Pragma:
    name: str
    value: Any = None  # None: read


@dataclass(frozen=True)
class Plain:
    """BEGIN, BEGIN CONCURRENT, COMMIT, ROLLBACK, VACUUM."""

    kind: str


@dataclass
class Parsed:
    statement: Any
    params: int = 0
    info: dict = field(default_factory=dict)
