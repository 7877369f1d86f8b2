"""A report model's relations to its lineage graph.

M texts are parsed where they are, one task for each part of the query table;
everything else is joins. Priorities (a calculated column before a physical
one, a measure of the same table before one of any other) are ranks in a join
result, of which the first row wins.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dax
from ..m import nodes as N
from ..m import parse, to_json
from . import detect, infer, layout
from .graph import EDGE_SCHEMA, NODE_COLUMNS, NODE_SCHEMA, Graph, latest


@dataclass
class Model:
    """The relations of a report model, as DataFrames of strings."""

    queries: DataFrame  # table, expression (parameters among them)
    columns: DataFrame  # table, name
    calculated: DataFrame  # table, name, expression
    measures: DataFrame  # table, name, expression
    relationships: DataFrame  # from_table, from_column, to_table, to_column
    layout: dict[str, Any] | None = None
    name: str = "report"

    @classmethod
    def of(cls, spark: SparkSession, queries=(), columns=(), calculated=(), measures=(), relationships=(), layout=None, name="report") -> Model:
        df = lambda rows, schema: spark.createDataFrame([tuple(r) for r in rows], schema)
        return cls(
            df(queries.items() if isinstance(queries, dict) else queries, "table string, expression string"), df(columns, "table string, name string"),
            df(calculated, "table string, name string, expression string"), df(measures, "table string, name string, expression string"),
            df(relationships, "from_table string, from_column string, to_table string, to_column string"), layout, name,
        )


def node_id(kind: str, *parts: str) -> str:
    return "::".join([kind, *parts])


def _id(kind: str, *parts) -> Any:
    return F.concat_ws("::", F.lit(kind), *parts)


def parsed(expression: str) -> tuple[str | None, list[tuple[str, str, str, int]], str | None]:
    """(body JSON, steps of (label, function, operation JSON, order), far-side table) of an M text; (None, [], None) if it is none."""
    try:
        node = parse(expression)
    except Exception:  # whatever the text is: a query that cannot be read is a node without a body
        return None, [], None
    steps = node.steps if isinstance(node, N.LetExpr) else ()
    body = node.body if isinstance(node, N.LetExpr) else node
    function = lambda e: e.func.name if isinstance(e, N.Invoke) and isinstance(e.func, N.Ident) else ""
    rows = [(label, function(e), json.dumps(to_json(e)), i) for i, (label, e) in enumerate(steps)]
    return json.dumps(to_json(body)), rows, infer.entity_name([e for _, e in steps])


_PARSED = """table string, body string, view string,
 steps array<struct<label:string,function:string,operation:string,ord:int>>,
 columns array<struct<name:string,source:string>>, dynamic_rename boolean, post_rename boolean"""


def _parse_all(queries: DataFrame) -> DataFrame:
    """One row for each query: its steps, and the columns that they imply."""
    import pandas as pd

    def run(it):
        for frame in it:
            out = []
            for table, expression in zip(frame["table"], frame["expression"]):
                body, steps, view = parsed(expression or "")
                found = infer.infer([(label, json.loads(op)) for label, _, op, _ in steps])
                out.append({
                    "table": table, "body": body, "view": view, "dynamic_rename": found.dynamic_rename, "post_rename": found.names_are_post_rename,
                    "steps": [dict(zip(("label", "function", "operation", "ord"), s)) for s in steps],
                    "columns": [{"name": c, "source": found.source_columns.get(c)} for c in found.columns],
                })
            yield pd.DataFrame(out, columns=["table", "body", "view", "steps", "columns", "dynamic_rename", "post_rename"])

    return queries.select("table", "expression").mapInPandas(run, _PARSED)


def dependencies(queries: DataFrame) -> DataFrame:
    """table, needs: the queries whose name occurs as a word in another's text.

    Texts are cut into words once and joined with the names, so the cost follows
    the text and not the number of pairs; names of several words are tested
    against the texts that hold their first word.
    """
    names = queries.select(F.col("table").alias("needs")).distinct().withColumn("first", F.regexp_extract("needs", r"\w+", 0))
    words = queries.select("table", "expression", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("expression", F.lit("")), F.lit(r"\w+"), 0))).alias("first"))
    held = words.join(names, "first").where(F.col("table") != F.col("needs"))
    whole = F.concat(F.lit(r"(?s).*(?<!\w)\Q"), F.col("needs"), F.lit(r"\E(?!\w).*"))
    return held.where((F.col("first") == F.col("needs")) | F.regexp_like("expression", whole)).select("table", "needs").distinct()


def _nodes(df: DataFrame, **values) -> DataFrame:
    return df.select(*[(values[c] if c in values else F.lit(None)).cast(t).alias(c) for c, t in NODE_COLUMNS.items()])


def _edges(df: DataFrame, src, dst, kind: str, stage: int) -> DataFrame:
    """Edges of one stage of the build; a later stage wins over an earlier one."""
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit(stage).cast("long").alias("seq"))


def _resolved(refs: DataFrame, columns: DataFrame, measures: DataFrame, order: list[tuple]) -> DataFrame:
    """refs (owner, owner_table, ref_table, ref_name) with ``target``: the id that the reference means, or null."""
    rules = []
    for rank, (kind, qualified, where) in enumerate(order):
        c = (columns if kind == "column" else measures).select(F.col("table").alias("__t"), F.col("name").alias("__n"), F.col("id").alias("target"))
        r = refs.where(F.col("ref_table").isNotNull() if qualified else F.col("ref_table").isNull())
        cond = F.col("ref_name") == F.col("__n")
        if where:
            cond &= F.col("__t") == F.col(where)
        rules.append(r.join(c, cond).withColumn("__rank", F.lit(rank)))
    found = rules[0]
    for r in rules[1:]:
        found = found.unionByName(r)
    keys = ["owner", "ref_table", "ref_name"]
    w = Window.partitionBy(*keys).orderBy("__rank", "__t", "target")
    best = found.withColumn("__first", F.row_number().over(w)).where("__first = 1").select(*[F.col(k).alias(f"__{k}") for k in keys], "target")
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return refs.join(best, on, "left").select(*refs.columns, "target")


#: What a reference may mean, in order of preference: kind, whether the reference names a table, and the column with the table to look in.
QUALIFIED = [("column", True, "ref_table"), ("measure", True, "ref_table")]
DAX_ORDER = [*QUALIFIED, ("measure", False, "owner_table"), ("measure", False, None), ("column", False, "owner_table")]


def build(model: Model) -> Graph:
    spark = model.queries.sparkSession
    q = model.queries.groupBy("table").agg(F.first("expression").alias("expression"))
    steps = _parse_all(q).persist()
    nodes, edges = [], []

    # sources and queries
    src = detect.source_rows(q, "expression", ["table"])
    source_id = _id("source", F.col("system"), F.col("identifier"))
    nodes.append(_nodes(src.select("system", "identifier").distinct(), id=source_id, type=F.lit("source"), label=F.col("identifier"), system=F.col("system")))
    edges.append(_edges(src, source_id, _id("query", F.col("table")), "feeds", 0))
    has_columns = model.columns.select(F.col("table").alias("__t")).distinct()
    known = steps.join(has_columns, F.col("table") == F.col("__t"), "left")
    flag = lambda c: F.when(F.col("__t").isNull() & (F.size("columns") > 0) & F.col(c), F.lit(True))
    nodes.append(_nodes(known, id=_id("query", F.col("table")), type=F.lit("query"), label=F.col("table"), view=F.col("view"), body=F.col("body"), dynamic_rename=flag("dynamic_rename"), names_are_post_rename=flag("post_rename")))
    each = steps.select("table", F.explode("steps").alias("s")).select("table", "s.*")
    step_id = F.concat_ws("::", F.lit("query"), F.col("table"), F.col("label"))
    nodes.append(_nodes(each, id=step_id, type=F.lit("step"), label=F.col("label"), function=F.col("function"), operation=F.col("operation"), ord=F.col("ord"), table=F.col("table")))
    edges.append(_edges(each, _id("query", F.col("table")), step_id, "contains", 1))
    chain = each.withColumn("before", F.lag(step_id).over(Window.partitionBy("table").orderBy("ord"))).where("before IS NOT NULL")
    edges.append(_edges(chain, F.col("before"), step_id, "feeds", 1))
    edges.append(_edges(dependencies(q), _id("query", F.col("needs")), _id("query", F.col("table")), "feeds", 2))

    # columns: given, implied by the steps, calculated
    given = model.columns.select("table", "name", F.lit(None).cast("string").alias("source"), F.lit(None).cast("boolean").alias("inferred"))
    implied = known.where("__t IS NULL").select("table", F.explode("columns").alias("c")).select("table", "c.name", "c.source", F.lit(True).alias("inferred"))
    physical = given.unionByName(implied).dropDuplicates(["table", "name"]).withColumn("id", _id("column", F.col("table"), F.col("name")))
    nodes.append(_nodes(physical, id=F.col("id"), type=F.lit("column"), label=F.col("name"), table=F.col("table"), inferred=F.col("inferred"), source_column=F.col("source")))
    edges.append(_edges(physical.join(q.select("table"), "table", "left_semi"), _id("query", F.col("table")), F.col("id"), "feeds", 3))
    calculated = model.calculated.withColumn("id", _id("calculated_column", F.col("table"), F.col("name")))
    nodes.append(_nodes(calculated, id=F.col("id"), type=F.lit("calculated_column"), label=F.col("name"), table=F.col("table"), dax_expression=F.col("expression")))
    hidden = calculated.select("table", "name")
    columns = calculated.select("table", "name", "id").unionByName(physical.select("table", "name", "id").join(hidden, ["table", "name"], "left_anti"))
    measures = model.measures.withColumn("id", _id("measure", F.col("table"), F.col("name")))
    nodes.append(_nodes(measures, id=F.col("id"), type=F.lit("measure"), label=F.col("name"), table=F.col("table"), dax_expression=F.col("expression")))

    # references of measures and calculated columns
    owners = measures.select("id", "table", "expression").unionByName(calculated.select("id", "table", "expression"))
    refs = dax.reference_rows(owners.select(F.col("id").alias("owner"), F.col("table").alias("owner_table"), F.coalesce("expression", F.lit("")).alias("expression")), "expression").drop("expression").distinct()
    meant = _resolved(refs, columns, measures.select("table", "name", "id"), DAX_ORDER)
    missing = _id("unresolved", F.coalesce("ref_table", F.col("owner_table")), F.col("ref_name"))
    meant = meant.withColumn("missing", F.col("target").isNull()).withColumn("target", F.coalesce("target", missing)).where(F.col("target") != F.col("owner"))
    nodes.append(_nodes(meant.where("missing"), id=F.col("target"), type=F.lit("unresolved"), label=F.col("ref_name"), table=F.coalesce("ref_table", F.col("owner_table"))))
    edges.append(_edges(meant, F.col("target"), F.col("owner"), "derives_from", 4))

    # relationships, both ways
    end = lambda side: columns.select(F.col("table").alias(f"{side}_table"), F.col("name").alias(f"{side}_column"), F.col("id").alias(f"{side}_id"))
    related = model.relationships.join(end("from"), ["from_table", "from_column"]).join(end("to"), ["to_table", "to_column"])
    edges += [_edges(related, F.col("from_id"), F.col("to_id"), "relates_to", 5), _edges(related, F.col("to_id"), F.col("from_id"), "relates_to", 5)]

    # report fields
    uses = layout.field_uses(model.layout) if model.layout else []
    if uses:
        fields = spark.createDataFrame([(u.page, u.visual_index, u.visual_type, u.table, u.field, u.kind, u.role) for u in uses], "page string, visual_index int, visual_type string, ref_table string, ref_name string, kind string, role string")
        fields = fields.withColumn("owner", _id("visual_field", F.lit(model.name), F.col("page"), F.col("visual_index").cast("string"), F.col("ref_name"))).withColumn("owner_table", F.col("ref_table"))
        nodes.append(_nodes(fields, id=F.col("owner"), type=F.lit("visual_field"), label=F.col("ref_name"), table=F.col("ref_table"), page=F.col("page"), visual_index=F.col("visual_index"), visual_type=F.col("visual_type"), role=F.col("role")))
        named = measures.select("table", "name", "id")
        plain = _resolved(fields.where("kind <> 'Measure'"), columns, named, QUALIFIED)
        measured = _resolved(fields.where("kind = 'Measure'"), columns, named, QUALIFIED[1:])
        shown = plain.unionByName(measured)
        missing = _id("unresolved", F.coalesce("ref_table", F.lit("?")), F.col("ref_name"))
        shown = shown.withColumn("missing", F.col("target").isNull()).withColumn("target", F.coalesce("target", missing))
        nodes.append(_nodes(shown.where("missing"), id=F.col("target"), type=F.lit("unresolved"), label=F.col("ref_name"), table=F.col("ref_table")))
        edges.append(_edges(shown, F.col("target"), F.col("owner"), "displayed_in", 6))

    every, links = spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA)
    for n in nodes:
        every = every.unionByName(n)
    for e in edges:
        links = links.unionByName(e)
    merged = every.groupBy("id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in NODE_COLUMNS if c != "id"])
    return Graph(merged.select(*NODE_COLUMNS), latest(links))

