"""Column names of a query that cannot be run, from its steps."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..m import from_json
from ..m import nodes as N


@dataclass
class Inferred:
    columns: list[str] = field(default_factory=list)
    dynamic_rename: bool = False
    names_are_post_rename: bool = False
    source_columns: dict[str, str] = field(default_factory=dict)


def _texts(node: Any) -> list[str] | None:
    if isinstance(node, N.Lit) and isinstance(node.value, str):
        return [node.value]
    if isinstance(node, N.ListExpr) and all(isinstance(x, N.Lit) and isinstance(x.value, str) for x in node.items):
        return [x.value for x in node.items]
    return None


def _pairs(node: Any) -> list[tuple] | None:
    """The items of a list of pairs, or of one pair."""
    if not isinstance(node, N.ListExpr):
        return None
    if node.items and isinstance(node.items[0], N.Lit):
        return [node.items]
    return [x.items for x in node.items] if all(isinstance(x, N.ListExpr) for x in node.items) else None


def infer(steps: list[tuple[str, Any]]) -> Inferred:
    """Folds over (label, operation) steps; only steps on the chain of the first count."""
    out, head, origin = Inferred(), None, {}
    for label, operation in steps:
        op = from_json(operation) if isinstance(operation, dict) else operation
        if not isinstance(op, N.Invoke):
            head = label
            continue
        on = op.args[0].name if op.args and isinstance(op.args[0], N.Ident) else None
        if head is not None and on != head:
            continue
        head = label
        name = op.func.name if isinstance(op.func, N.Ident) else ""
        arg = op.args[1] if len(op.args) > 1 else None
        if name in ("Table.TransformColumnTypes", "Table.TransformColumns"):
            listed = [p[0].value for p in _pairs(arg) or [] if p and isinstance(p[0], N.Lit)]
            if listed and (name == "Table.TransformColumnTypes" or not out.columns):
                if not out.columns:
                    out.names_are_post_rename = out.dynamic_rename
                out.columns = listed if not out.columns else [*out.columns, *[c for c in listed if c not in out.columns]]
                origin |= {c: c for c in listed if c not in origin}
        elif name == "Table.SelectColumns":
            chosen = _texts(arg)
            if chosen is not None:
                out.columns = chosen
                origin = {c: origin.get(c, c) for c in chosen}
        elif name == "Table.RemoveColumns":
            gone = set(_texts(arg) or [])
            out.columns = [c for c in out.columns if c not in gone]
        elif name == "Table.RenameColumns":
            pairs = _pairs(arg)
            if pairs is None or not all(len(p) == 2 and all(isinstance(x, N.Lit) for x in p) for p in pairs):
                out.dynamic_rename = True
                continue
            new = {p[0].value: p[1].value for p in pairs}
            out.columns = [new.get(c, c) for c in out.columns]
            origin = {new.get(c, c): o for c, o in origin.items()}
    out.source_columns = {c: origin[c] for c in out.columns if origin.get(c, c) != c}
    return out


def entity_name(operations: list[Any]) -> str | None:
    """E of a step ``X{[Name="E"]}[Data]``, the name of a table on the far side."""
    for operation in operations:
        op = from_json(operation) if isinstance(operation, dict) else operation
        if isinstance(op, N.FieldAccess) and op.field == "Data" and isinstance(op.target, N.ItemAccess) and isinstance(op.target.key, N.RecordExpr):
            for name, value in op.target.key.fields:
                if name in ("Name", "Item") and isinstance(value, N.Lit):
                    return value.value
    return None
