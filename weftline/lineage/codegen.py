"""A model as a PySpark script, and the datasets of its charts.

The script holds each query's M text and compiles it when it runs, in the
order of their dependencies; measures outside the supported subset stand in it
as functions that raise.
"""

from __future__ import annotations

from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.dax import Measures
from ..m import parse
from ..plans.compiler import Compiler
from ..plans.values import quoted
from . import layout
from .build import Model, dependencies


@dataclass
class Stats:
    queries: int
    unreadable: list[str]
    measures: int
    unsupported_measures: list[str]
    visuals: int


def query_order(model: Model) -> list[str]:
    """Queries after what they need; in the given order if they need each other in a circle."""
    names = [r["table"] for r in model.queries.select("table").collect()]
    needs: dict[str, set[str]] = {n: set() for n in names}
    for r in dependencies(model.queries).collect():
        needs[r["table"]].add(r["needs"])
    try:
        return list(TopologicalSorter(needs).static_order())
    except CycleError:
        return names


def chart_dataset(tables: dict[str, DataFrame], visual: layout.Visual) -> DataFrame | None:
    """The rows that a visual shows: its columns of one table; None if it mixes tables or shows only measures."""
    uses = [(role, t, f) for role, refs in visual.roles.items() for t, f, kind in refs if kind != "Measure"]
    over = {t for _, t, _ in uses}
    if len(over) != 1 or next(iter(over)) not in tables:
        return None
    df = tables[next(iter(over))]
    cols = list(dict.fromkeys(f for _, _, f in uses if f in df.columns))
    return df.select(*map(quoted, cols)) if cols else None


class ModelRuntime:
    """A model's queries and measures, compiled on demand."""

    def __init__(self, spark: SparkSession, model: Model, tables: dict[str, DataFrame] | None = None, fetch=None):
        self.model = model
        sources = {r["table"]: r["expression"] for r in model.queries.collect()}
        self.compiler = Compiler(spark, tables, queries=sources, fetch=fetch)

    def table(self, name: str) -> DataFrame:
        return self.compiler.as_frame(self.compiler.query(name) if name in self.compiler.sources else self.compiler.tables[name])

    def measures(self) -> Measures:
        rows = self.model.measures.collect()
        found = Measures({(r["table"], r["name"]): r["expression"] for r in rows})
        names = {t for m in found.describe() for t in m.tables}
        found.frames = {n: self.table(n) for n in names if n in self.compiler.sources or n in self.compiler.tables}
        return found

    def charts(self) -> list[tuple[layout.Visual, DataFrame | None]]:
        shown = layout.visuals(self.model.layout) if self.model.layout else []
        names = {t for v in shown for refs in v.roles.values() for t, _, _ in refs if t}
        tables = {n: self.table(n) for n in names if n in self.compiler.sources or n in self.compiler.tables}
        return [(v, chart_dataset(tables, v)) for v in shown]


def script(model: Model) -> tuple[str, Stats]:
    sources = {r["table"]: r["expression"] for r in model.queries.collect()}
    measures = Measures({(r["table"], r["name"]): r["expression"] for r in model.measures.collect()}).describe()
    unreadable = []
    lines = ["from pyspark.sql import SparkSession", "", "from weftline.functions.dax import Measures", "from weftline.plans.compiler import Compiler", "", "QUERIES = {"]
    for name in query_order(model):
        try:
            parse(sources[name])
        except ValueError:
            unreadable.append(name)
            lines.append(f"    # {name!r} cannot be read as M")
            continue
        lines.append(f"    {name!r}: {sources[name]!r},")
    lines += ["}", "", "MEASURES = {"]
    lines += [f"    ({m.table!r}, {m.name!r}): {m.expression!r}," if m.supported else f"    # unsupported: {m.table}[{m.name}]: {' '.join(m.reason.split())}" for m in measures]
    lines += ["}", "", "VISUALS = ["]
    shown = layout.visuals(model.layout) if model.layout else []
    lines += [f"    {{'page': {v.page!r}, 'chart': {v.chart!r}, 'roles': {v.roles!r}}}," for v in shown]
    lines += [
        "]", "", "", "def main(spark, tables=None):", '    """All queries as lazy DataFrames, and the measures over them."""',
        "    compiler = Compiler(spark, tables, queries=QUERIES)", "    frames = {name: compiler.as_frame(compiler.query(name)) for name in QUERIES}",
        "    return frames, Measures(MEASURES, {**(tables or {}), **frames})", "", "", 'if __name__ == "__main__":',
        "    frames, measures = main(SparkSession.builder.getOrCreate())", "    for name, frame in frames.items():", "        print(name)", "        frame.show()", "",
    ]
    return "\n".join(lines), Stats(len(sources), unreadable, len(measures), [m.name for m in measures if not m.supported], len(shown))


def write_script(model: Model, path: str | Path) -> Stats:
    text, stats = script(model)
    Path(path).write_text(text, encoding="utf-8")
    return stats

