"""Syntax tree of the query dialect."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class QueryError(ValueError):
    """A query that can't be read or doesn't make sense."""


class ParseError(QueryError):
    """A query that can't be read."""


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Col:
    name: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Call:
    """and, or, not, = != < <= > >=, + - * /, coalesce, nullif, isnull, isnotnull, between, in, like, ilike, get, has, match."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Case:
    branches: tuple  # of (condition, value)
    other: Any = None


@dataclass(frozen=True)
class Sub:
    """kind: in (with of), scalar, exists."""

    kind: str
    query: Any
    of: Any = None


@dataclass(frozen=True)
class Agg:
    func: str
    arg: Any  # None: *
    alias: str | None = None


@dataclass(frozen=True)
class Frame:
    kind: str
    start: int | None  # None: unbounded; rows from the current one
    end: int | None


@dataclass(frozen=True)
class Window:
    func: str
    arg: str | None
    n: int | None
    partition: tuple
    order: Any
    frame: Frame | None
    alias: str | None


@dataclass(frozen=True)
class Hop:
    out: bool
    label: str
    table: str
    fields: tuple = ()


@dataclass(frozen=True)
class Path:
    hops: tuple
    alias: str | None


@dataclass(frozen=True)
class Named:
    expr: Any
    alias: str | None


@dataclass(frozen=True)
class Order:
    column: str
    desc: bool


@dataclass(frozen=True)
class Join:
    kind: str
    table: str
    left: tuple | None = None
    right: tuple | None = None


@dataclass(frozen=True)
class Knn:
    column: str
    k: int
    vector: tuple
    mode: str


@dataclass(frozen=True)
class Select:
    items: tuple  # () is *
    source: Any  # table name, or (Select, alias)
    distinct: bool = False
    join: Join | None = None
    where: Any = None
    knn: Knn | None = None
    traverse: tuple | None = None  # (column, depth)
    group: tuple = ()
    having: tuple = ()  # of (Agg, op, literal)
    order: tuple = ()
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class SetOp:
    op: str
    all: bool
    left: Any
    right: Any


@dataclass(frozen=True)
class With:
    ctes: tuple  # of (name, query)
    recursive: bool
    body: Any


@dataclass(frozen=True)
class Command:
    """explain, analyze, drop_table, drop_index, insert, update, delete, relate, let, return."""

    kind: str
    args: dict = field(default_factory=dict)
