"""The operations of a lineage service: graphs by path, cached until their file changes, and every query on them.

A report file's binary data model needs a decoder, which is injected as
``load(path) -> Model``; folders of Parquet relations are read without one.
"""

from __future__ import annotations

import os
import threading
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from . import codegen, graph, layout, reports
from .build import Model, build


def model_from_folder(spark: SparkSession, path: str) -> Model:
    """A model of Parquet relations named queries, columns, calculated, measures and relationships, and layout.json."""
    import json

    df = lambda name: spark.read.parquet(f"{path}/{name}.parquet")
    try:
        shown = json.loads("".join(r["value"] for r in spark.read.option("wholetext", True).text(f"{path}/layout.json").collect()))
    except Exception:  # a model without a report
        shown = None
    return Model(df("queries"), df("columns"), df("calculated"), df("measures"), df("relationships"), shown, os.path.basename(path.rstrip("/")))


def layout_of(path: str) -> dict[str, Any] | None:
    try:
        return layout.read_layout(path)
    except KeyError:  # a file with data only
        return None


class LineageService:
    def __init__(self, spark: SparkSession, load: Callable[[str], Model] | None = None):
        self.spark = spark
        self.load = load or (lambda path: model_from_folder(spark, path))
        self.cache: dict[str, tuple[float, Model, graph.Graph]] = {}
        self.lock = threading.Lock()

    def _entry(self, path: str) -> tuple[float, Model, graph.Graph]:
        key = os.path.realpath(path) if os.path.exists(path) else path
        changed = os.path.getmtime(key) if os.path.exists(key) else 0.0
        with self.lock:
            if key not in self.cache or self.cache[key][0] != changed:
                model = self.load(path)
                g = build(model)
                self.cache[key] = (changed, model, graph.Graph(g.nodes.persist(), g.edges.persist()))
            return self.cache[key]

    def graph(self, path: str) -> graph.Graph:
        return self._entry(path)[2]

    def graphs(self) -> list[str]:
        return sorted(self.cache)

    def invalidate(self, path: str | None = None) -> int:
        """Forgets one graph, or all; how many it forgot."""
        with self.lock:
            keys = list(self.cache) if path is None else [k for k in self.cache if k in (path, os.path.realpath(path))]
            for k in keys:
                g = self.cache.pop(k)[2]
                g.nodes.unpersist()
                g.edges.unpersist()
            return len(keys)

    def summary(self, path: str) -> dict[str, int]:
        return {r["type"]: r["count"] for r in graph.summary(self.graph(path)).collect()}

    def search(self, path: str, text: str) -> list[str]:
        return [r["id"] for r in graph.find_nodes(self.graph(path), text).select("id").orderBy("id").collect()]

    def upstream(self, path: str, node: str, include_relations: bool = False) -> list[str]:
        return [r["id"] for r in graph.upstream(self.graph(path), node, include_relations).orderBy("id").collect()]

    def downstream(self, path: str, node: str, include_relations: bool = False) -> list[str]:
        return [r["id"] for r in graph.downstream(self.graph(path), node, include_relations).orderBy("id").collect()]

    def tree(self, path: str, node: str, up: bool = True, max_depth: int = 12) -> dict[str, Any] | None:
        return graph.tree(self.graph(path), node, up, max_depth)

    def source_schema(self, path: str) -> dict[str, Any]:
        return graph.source_schema(self.graph(path))

    def output_schema(self, path: str) -> dict[str, Any]:
        return graph.output_schema(self.graph(path))

    def export(self, path: str, kind: str, out: str) -> str:
        g = self.graph(path)
        writers = {
            "graphml": graph.write_graphml, "json": graph.write_json, "nodes_csv": graph.write_nodes_csv, "edges_csv": graph.write_edges_csv,
            "markdown": reports.write_source_report,
        }
        if kind not in writers:
            raise ValueError(f"unknown export {kind!r}; there are {', '.join(writers)}")
        writers[kind](g, out)
        return out

    def codegen(self, path: str, out: str) -> codegen.Stats:
        return codegen.write_script(self._entry(path)[1], out)
