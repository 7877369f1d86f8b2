"""The syntax tree, and its JSON form: an object whose "_" names the kind of node."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Ident:
    name: str


@dataclass(frozen=True)
class FieldAccess:
    target: Any  # None: of the row that ``each`` stands for
    field: str


@dataclass(frozen=True)
class ItemAccess:
    target: Any
    key: Any


@dataclass(frozen=True)
class Invoke:
    func: Any
    args: tuple


@dataclass(frozen=True)
class Lambda:
    params: tuple
    body: Any


@dataclass(frozen=True)
class If:
    cond: Any
    then: Any
    orelse: Any


@dataclass(frozen=True)
class BinOp:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class UnaryOp:
    op: str
    operand: Any


@dataclass(frozen=True)
class ListExpr:
    items: tuple


@dataclass(frozen=True)
class RecordExpr:
    fields: tuple  # of (name, expression)


@dataclass(frozen=True)
class LetExpr:
    steps: tuple  # of (name, expression)
    body: Any


@dataclass(frozen=True)
class TryExpr:
    body: Any
    otherwise: Any


@dataclass(frozen=True)
class TypeLit:
    raw: str


KINDS = {c.__name__: c for c in (Lit, Ident, FieldAccess, ItemAccess, Invoke, Lambda, If, BinOp, UnaryOp, ListExpr, RecordExpr, LetExpr, TryExpr, TypeLit)}


def to_json(node: Any) -> Any:
    if type(node).__name__ in KINDS:
        return {"_": type(node).__name__} | {f.name: to_json(getattr(node, f.name)) for f in fields(node)}
    return [to_json(x) for x in node] if isinstance(node, (tuple, list)) else node


def from_json(value: Any) -> Any:
    if isinstance(value, dict) and "_" in value:
        kind = KINDS[value["_"]]
        return kind(**{f.name: from_json(value.get(f.name)) for f in fields(kind)})
    return tuple(from_json(x) for x in value) if isinstance(value, list) else value
