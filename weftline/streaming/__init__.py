"""M programs over streams.

Programs of row-wise steps (select, add, transform, types, rename, split,
replace, expand) compile to the same plan over a streaming DataFrame. Steps
that need an order, a driver read or all rows are refused by name before the
query starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..m import nodes as N
from ..m import parse
from ..plans.compiler import Compiler
from ..plans.values import MError

#: Steps that see more than one row at a time in a way that a stream cannot serve.
BOUND = {"Table.Sort", "Table.Distinct", "Table.Pivot", "Table.PromoteHeaders", "Table.ToRows", "Table.NestedJoin", "List.First", "Table.Group"}


def calls(node) -> set[str]:
    """The names of all functions that a tree calls."""
    found: set[str] = set()
    if isinstance(node, N.Invoke) and isinstance(node.func, N.Ident):
        found.add(node.func.name)
    for v in vars(node).values() if hasattr(node, "__dict__") else node if isinstance(node, tuple) else ():
        if hasattr(v, "__dict__") or isinstance(v, tuple):
            found |= calls(v)
    return found


def compile_stream(spark: SparkSession, source: str, streams: dict[str, DataFrame], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The streaming DataFrame of a row-wise program."""
    bound = calls(parse(source)) & BOUND
    if bound:
        raise MError(f"a stream cannot serve {', '.join(sorted(bound))}")
    return Compiler(spark, {**(tables or {}), **streams}).frame(source)
