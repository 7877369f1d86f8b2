"""The lineage graph as two DataFrames, and its queries.

nodes(id, type, label, table, …) and edges(src, dst, type, seq); edges lead
downstream, and of parallel edges the one with the highest seq counts.
Closures run as semi-naive searches: each round joins only the nodes that are
new, and the rounds end when there are none, so cycles do no harm.
"""

from __future__ import annotations

import csv
import json
from dataclasses import dataclass
from pathlib import Path
from typing import Any
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODE_COLUMNS = {
    "id": "string", "type": "string", "label": "string", "table": "string", "system": "string", "view": "string", "body": "string", "function": "string",
    "operation": "string", "ord": "int", "inferred": "boolean", "dynamic_rename": "boolean", "names_are_post_rename": "boolean",
    "source_column": "string", "dax_expression": "string", "page": "string", "visual_index": "int", "visual_type": "string", "role": "string",
}
NODE_SCHEMA = ", ".join(f"`{c}` {t}" for c, t in NODE_COLUMNS.items())
EDGE_SCHEMA = "src string, dst string, type string, seq long"
RELATES = "relates_to"


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, nodes: list[dict[str, Any]], edges: list[tuple]) -> Graph:
        """A graph of driver lists; attributes of a repeated id merge, and edges get their place as seq."""
        merged: dict[str, dict[str, Any]] = {}
        for n in nodes:
            merged.setdefault(n["id"], {}).update({k: v for k, v in n.items() if v is not None})
        rows = [tuple(n.get(c) for c in NODE_COLUMNS) for n in merged.values()]
        links = [(s, d, t, i) for i, (s, d, t) in enumerate((*e, "feeds")[:3] for e in edges)]
        return cls(spark.createDataFrame(rows, NODE_SCHEMA), latest(spark.createDataFrame(links, EDGE_SCHEMA)))


def latest(edges: DataFrame) -> DataFrame:
    """One edge for each pair of nodes: of several, the type of the last."""
    return edges.groupBy("src", "dst").agg(F.max_by("type", "seq").alias("type"), F.max("seq").alias("seq"))


def _settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the checkpoint folder if there is one."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.persist()


def closure(edges: DataFrame, start: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """origin, id, depth: all nodes that each (origin, id) of start reaches along the edges, with the least number of steps."""
    links = edges.select(F.col("src").alias("id"), F.col("dst").alias("next")).distinct()
    reached = _settled(start.select("origin", "id").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = reached, 0
    while max_rounds is None or depth < max_rounds:
        depth += 1
        step = frontier.join(links, "id").select("origin", F.col("next").alias("id")).distinct()
        frontier = _settled(step.join(reached.select("origin", "id"), ["origin", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        if depth % 8 == 0:
            reached = _settled(reached)
    return reached


def _walk(g: Graph, node: str, up: bool, include_relations: bool) -> DataFrame:
    edges = g.edges if include_relations else g.edges.where(F.col("type") != RELATES)
    if up:
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    start = g.nodes.where(F.col("id") == node).select(F.lit(node).alias("origin"), "id")
    return closure(edges, start).where(F.col("depth") > 0).where(F.col("id") != node).select("id", "depth")


def upstream(g: Graph, node: str, include_relations: bool = False) -> DataFrame:
    """id, depth of everything that node depends on; of an unknown node, nothing."""
    return _walk(g, node, True, include_relations)


def downstream(g: Graph, node: str, include_relations: bool = False) -> DataFrame:
    """id, depth of everything that depends on node; of an unknown node, nothing."""
    return _walk(g, node, False, include_relations)


def find_nodes(g: Graph, text: str) -> DataFrame:
    return g.nodes.where(F.contains(F.lower("id"), F.lit(text.lower())))


def summary(g: Graph) -> DataFrame:
    """type, count for each type of node, and the totals ``nodes`` and ``edges``."""
    by_type = g.nodes.groupBy("type").agg(F.count("*").alias("count"))
    totals = [g_.agg(F.count("*").alias("count")).select(F.lit(n).alias("type"), "count") for n, g_ in (("nodes", g.nodes), ("edges", g.edges))]
    return by_type.unionByName(totals[0]).unionByName(totals[1])


def level(g: Graph, depth: int, root_type: str = "source") -> DataFrame:
    """The nodes depth - 1 edges below the nodes of a type, each once."""
    if depth < 1:
        raise ValueError("depth begins at 1")
    ids = g.nodes.where(F.col("type") == root_type).select("id")
    for _ in range(depth - 1):
        ids = ids.join(g.edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
    return g.nodes.join(ids, "id", "left_semi")


def list_sources(g: Graph) -> DataFrame:
    return level(g, 1)


def tree_paths(g: Graph, node: str, up: bool = True, max_depth: int = 12) -> DataFrame:
    """path (array of ids from node) of every branch, relations included; a branch ends before it would meet itself."""
    edges = g.edges.select("src", "dst") if not up else g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    paths = g.nodes.where(F.col("id") == node).select(F.array("id").alias("path"))
    out, last = paths, paths
    for _ in range(max_depth):
        last = _settled(
            last.join(edges, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
            .select(F.concat("path", F.array("dst")).alias("path"))
        )
        if last.isEmpty():
            break
        out = out.unionByName(last)
    return out


def tree(g: Graph, node: str, up: bool = True, max_depth: int = 12) -> dict[str, Any] | None:
    """The nested tree below a node: id, label, type and children ordered by id. Small by nature: one node's branches."""
    found = [r["path"] for r in tree_paths(g, node, up, max_depth).collect()]
    if not found:
        return None
    ids = {i for p in found for i in p}
    about = {r["id"]: r for r in g.nodes.where(F.col("id").isin(list(ids))).select("id", "label", "type").collect()}
    made: dict[tuple, dict[str, Any]] = {}
    for p in sorted(found, key=lambda p: (len(p), p)):
        r = about.get(p[-1])
        item = {"id": p[-1], "label": r["label"] if r else p[-1], "type": r["type"] if r else None, "children": []}
        made[tuple(p)] = item
        if len(p) > 1:
            made[tuple(p[:-1])]["children"].append(item)
    return made[node,]


def tree_lines(item: dict[str, Any], depth: int = 0) -> list[str]:
    return ["  " * depth + f"- [{item['type']}] {item['label']}", *(line for c in item["children"] for line in tree_lines(c, depth + 1))]


def source_tables(g: Graph) -> DataFrame:
    """source, query, view, columns (sorted), names_reliable, renamed (current name to source name).

    From each source along ``feeds``; the walk passes through a query only if it has neither columns nor a view.
    """
    feeds = g.edges.where(F.col("type") == "feeds").select("src", "dst")
    queries = g.nodes.where(F.col("type") == "query").select("id", "label", "view", "dynamic_rename", "names_are_post_rename")
    columns = g.nodes.where(F.col("type") == "column").select("id", "label", "source_column")
    held = (
        feeds.join(columns, feeds["dst"] == columns["id"]).groupBy("src")
        .agg(F.array_sort(F.collect_set("label")).alias("columns"),
             F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("source_column").isNotNull() & (F.col("source_column") != F.col("label")), F.struct("label", "source_column"))))).alias("renamed"))
    )
    known = queries.join(held, queries["id"] == held["src"], "left").drop("src")
    between = feeds.join(queries.select(F.col("id").alias("dst")), "dst", "left_semi")
    open_ = known.where(F.col("columns").isNull() & F.col("view").isNull()).select(F.col("id").alias("src"))
    starts = g.nodes.where(F.col("type") == "source").select(F.col("id").alias("origin"), "id")
    sources = starts.select(F.col("id").alias("src"))
    reached = closure(between.join(open_.union(sources), "src", "left_semi"), starts).where(F.col("depth") > 0)
    labels = g.nodes.where(F.col("type") == "source").select(F.col("id").alias("origin"), F.col("label").alias("source"))
    return reached.join(known, "id").join(labels, "origin").select(
        "source", F.col("label").alias("query"), "view", F.coalesce("columns", F.array().cast("array<string>")).alias("columns"),
        (~F.coalesce("dynamic_rename", F.lit(False))).alias("names_reliable"), F.coalesce("renamed", F.create_map().cast("map<string,string>")).alias("renamed"),
    )


def source_schema(g: Graph) -> dict[str, dict[str, Any]]:
    out: dict[str, dict[str, Any]] = {}
    for r in source_tables(g).orderBy("source", "query").collect():
        out.setdefault(r["source"], {})[r["query"]] = {"view": r["view"], "columns": list(r["columns"]), "names_reliable": r["names_reliable"], "renamed_columns": dict(r["renamed"])}
    return out


def output_pages(g: Graph) -> DataFrame:
    """page, source_type, n, unresolved: the report fields of each page by the type of their first source."""
    fields = g.nodes.where(F.col("type") == "visual_field").select(F.col("id").alias("dst"), "page")
    first = g.edges.join(g.nodes.select(F.col("id").alias("src"), F.col("type").alias("source_type"), F.col("label").alias("source_label")), "src")
    w = Window.partitionBy("dst").orderBy("seq")
    first = first.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("dst", "source_type", "source_label")
    return fields.join(first, "dst", "left").groupBy("page", "source_type").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set(F.when(F.col("source_type") == "unresolved", F.col("source_label")))).alias("unresolved")
    )


def output_schema(g: Graph) -> dict[str, dict[str, Any]]:
    out: dict[str, dict[str, Any]] = {}
    for r in output_pages(g).orderBy("page", "source_type").collect():
        page = out.setdefault(r["page"], {"visual_count": 0, "by_source_type": {}, "unresolved": []})
        page["visual_count"] += r["n"]
        if r["source_type"] is not None:
            page["by_source_type"][r["source_type"]] = r["n"]
        page["unresolved"] += list(r["unresolved"])
    return out


# -- exports --
def write_nodes_csv(g: Graph, path: str) -> None:
    """A folder of CSV files, written in parallel."""
    g.nodes.write.mode("overwrite").option("header", True).csv(path)


def write_edges_csv(g: Graph, path: str) -> None:
    """Edges with the types of both ends."""
    kinds = g.nodes.select("id", F.col("type").alias("kind"))
    out = g.edges.join(kinds.withColumnsRenamed({"id": "src", "kind": "src_type"}), "src", "left").join(kinds.withColumnsRenamed({"id": "dst", "kind": "dst_type"}), "dst", "left")
    out.select("src", "dst", "type", "src_type", "dst_type").write.mode("overwrite").option("header", True).csv(path)


def node_link(g: Graph) -> dict[str, Any]:
    """The graph as one JSON value, operations and bodies decoded. For graphs of report size."""
    nodes = []
    for r in g.nodes.orderBy("id").collect():
        n = {k: v for k, v in r.asDict().items() if v is not None}
        for k in ("operation", "body"):
            if k in n:
                n[k] = json.loads(n[k])
        nodes.append(n)
    links = [{"source": r["src"], "target": r["dst"], "type": r["type"]} for r in g.edges.orderBy("seq").collect()]
    return {"directed": True, "nodes": nodes, "links": links}


def write_json(g: Graph, path: str | Path) -> Path:
    Path(path).write_text(json.dumps(node_link(g), ensure_ascii=False, indent=1), encoding="utf-8")
    return Path(path)


def write_graphml(g: Graph, path: str | Path) -> Path:
    """GraphML of a graph of report size; what is missing is an empty text."""
    keys = [c for c in NODE_COLUMNS if c != "id"]
    lines = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    lines += [f'<key id="{k}" for="node" attr.name="{k}" attr.type="string"/>' for k in keys]
    lines += ['<key id="edge_type" for="edge" attr.name="type" attr.type="string"/>', '<graph edgedefault="directed">']
    for r in g.nodes.orderBy("id").toLocalIterator():
        data = "".join(f'<data key="{k}">{escape("" if r[k] is None else str(r[k]))}</data>' for k in keys)
        lines.append(f"<node id={quoteattr(r['id'])}>{data}</node>")
    for r in g.edges.orderBy("seq").toLocalIterator():
        lines.append(f"<edge source={quoteattr(r['src'])} target={quoteattr(r['dst'])}><data key=\"edge_type\">{escape(r['type'])}</data></edge>")
    Path(path).write_text("\n".join([*lines, "</graph>", "</graphml>"]), encoding="utf-8")
    return Path(path)


def write_rows(rows: list[dict[str, Any]], path: str | Path) -> Path:
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, fieldnames=list(rows[0]) if rows else [])
        w.writeheader()
        w.writerows(rows)
    return Path(path)
