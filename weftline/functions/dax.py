"""DAX: references in an expression, and a safe subset of measures as aggregates.

A measure of the subset becomes a Column aggregate over one table; measures
that refer to others are inlined. Anything else is named as unsupported, and
using it raises.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.values import quoted

# Fixed value: a bracketed name, after an optional table name, quoted or not.
REFERENCE = r"(?:'([^']+)'|\b([A-Za-z_][A-Za-z0-9_]*)\b)?\[([^\[\]]+)\]"
_REFERENCE = re.compile(REFERENCE)


class MeasureNotSupported(Exception):
    """A measure outside the subset was used."""


def references(expression: str | None) -> list[tuple[str | None, str]]:
    """(table or None, name) of each reference, in order."""
    return [(m[1] or m[2], m[3]) for m in _REFERENCE.finditer(expression or "")]


def reference_rows(df: DataFrame, expression: str) -> DataFrame:
    """df with one row for each reference in the column ``expression``: ref_table (null if none) and ref_name."""
    found = F.explode(F.regexp_extract_all(F.col(expression), F.lit(REFERENCE), 0))
    rows = df.select("*", found.alias("__ref"))
    part = lambda i: F.regexp_extract("__ref", REFERENCE, i)
    table = F.when(part(1) != "", part(1)).when(part(2) != "", part(2))
    return rows.select("*", table.alias("ref_table"), part(3).alias("ref_name")).drop("__ref")


_TABLE = r"(?:'([^']+)'|([A-Za-z_]\w*))"
_ONE = re.compile(rf"^\s*(SUM|AVERAGE|MIN|MAX|COUNT|COUNTA|MEDIAN|STDEV\.P|STDEV\.S|DISTINCTCOUNT)\s*\(\s*{_TABLE}\s*\[([^\[\]]+)\]\s*\)\s*$", re.I)
_ROWS = re.compile(rf"^\s*COUNTROWS\s*\(\s*{_TABLE}\s*\)\s*$", re.I)
_DIVIDE = re.compile(r"^\s*DIVIDE\s*\((.*)\)\s*$", re.I | re.S)
_NUMBER = re.compile(r"^\s*-?\d+(\.\d+)?\s*$")
_MEASURE = re.compile(rf"^\s*{_TABLE}?\s*\[([^\[\]]+)\]\s*$")

_AGGREGATES = {
    "SUM": lambda c: F.coalesce(F.sum(c), F.lit(0)), "AVERAGE": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": F.count, "COUNTA": F.count,
    "MEDIAN": F.median, "STDEV.P": F.stddev_pop, "STDEV.S": F.stddev_samp, "DISTINCTCOUNT": F.count_distinct,
}


@dataclass
class Measure:
    """A translated measure: its value over the tables, or why there is none."""

    table: str | None
    name: str
    expression: str
    supported: bool = False
    reason: str = ""
    tables: frozenset[str] = field(default_factory=frozenset)


def arguments(body: str) -> list[str]:
    """The top-level arguments of a call, commas in strings and brackets aside."""
    out, depth, start, quote = [], 0, 0, ""
    for i, c in enumerate(body):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(body[start:i])
            start = i + 1
    return [*out, body[start:]]


class Measures:
    """The measures of a model, over its tables."""

    def __init__(self, expressions: dict[tuple[str, str], str], tables: dict[str, DataFrame] | None = None):
        self.expressions, self.frames = expressions, tables or {}

    def translate(self, expression: str, open_: tuple = (), leaves: dict[str, tuple[str, Column]] | None = None) -> tuple[Column, frozenset[str]]:
        """(value, tables it is over), or MeasureNotSupported.

        The value is an aggregate; with ``leaves`` it is an expression over the aggregates that are added to it, by name with their table.
        """

        def leaf(table: str, value: Column) -> tuple[Column, frozenset[str]]:
            if leaves is None:
                return value, frozenset([table])
            name = f"__leaf{len(leaves)}"
            leaves[name] = (table, value.alias(name))
            return F.col(name), frozenset([table])

        if m := _ONE.match(expression):
            return leaf(m[2] or m[3], _AGGREGATES[m[1].upper()](quoted(m[4].strip())))
        if m := _ROWS.match(expression):
            return leaf(m[1] or m[2], F.count(F.lit(1)))
        if m := _DIVIDE.match(expression):
            args = arguments(m[1])
            if len(args) not in (2, 3):
                raise MeasureNotSupported(f"DIVIDE takes two or three arguments: {expression!r}")
            (a, ta), (b, tb), (c, tc) = (self.translate(x, open_, leaves) for x in (args[0], args[1], args[2] if len(args) == 3 else "0"))
            b = b.cast("double")
            return F.when(b.isNull() | (b != 0), a.cast("double") / b).otherwise(c.cast("double")), ta | tb | tc
        if _NUMBER.match(expression):
            s = expression.strip()
            return F.lit(float(s) if "." in s else int(s)), frozenset()
        if m := _MEASURE.match(expression):
            table, name = m[1] or m[2], m[3]
            key = next((k for k in self.expressions if k[1] == name and table in (None, k[0])), None)
            if key is None:
                raise MeasureNotSupported(f"no measure {expression.strip()}")
            if key in open_:
                raise MeasureNotSupported(f"measures refer to each other in a circle: {key[1]}")
            return self.translate(self.expressions[key], (*open_, key), leaves)
        raise MeasureNotSupported(f"outside the supported subset: {expression.strip()!r}")

    def describe(self) -> list[Measure]:
        out = []
        for (table, name), expression in self.expressions.items():
            try:
                _, over = self.translate(expression)
                out.append(Measure(table, name, expression, True, "", over))
            except MeasureNotSupported as e:
                out.append(Measure(table, name, expression, False, str(e)))
        return out

    def frame(self, names: list[tuple[str, str]] | None = None) -> DataFrame:
        """One row with the given (by default, all supported) measures; all aggregates over one table share one pass over it."""
        wanted = names or [(m.table, m.name) for m in self.describe() if m.supported]
        leaves: dict[str, tuple[str, Column]] = {}
        values = [self.translate(self.expressions[key], leaves=leaves)[0].alias(key[1]) for key in wanted]
        by_table: dict[str, list[Column]] = {}
        for table, value in leaves.values():
            by_table.setdefault(table, []).append(value)
        rows = [self.frames[t].agg(*cols) for t, cols in by_table.items()]
        if not rows:  # numbers only: a row of any table's session
            rows = [next(iter(self.frames.values())).sparkSession.range(1)]
        out = rows[0]
        for r in rows[1:]:  # one row each
            out = out.join(r)
        return out.select(*values)
