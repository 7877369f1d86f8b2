"""The library that programs call: every function and constant under its M name."""

from __future__ import annotations

from typing import Any

from ..plans.values import Function
from .constants import constants
from .lists import lists
from .scalars import scalars


def library(compiler) -> dict[str, Any]:
    from ..operators.tables import tables
    from ..sources.connectors import connectors

    out: dict[str, Any] = dict(constants())
    for part in (scalars, lists, tables, connectors):
        for name, f in part(compiler).items():
            out[name] = f if name.startswith("__fused") else Function(f, name)
    return out
