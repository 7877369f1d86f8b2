"""Registered queries over the lineage graph of a report model made from the supplier table, and over small literals, each with its SQL.

Supplier k gives the query S<k>. By k modulo 3 it reads its neighbour S<k+1>, a
database's table (with columns, measures, a relationship and, for even k, a
calculated column with an unknown reference), or a file whose columns follow
from its steps.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import build as B
from ..lineage import codegen, graph


def _field(kind: str, name: str) -> dict:
    return {kind: {"Expression": {"SourceRef": {"Source": "s"}}, "Property": name}}


#: One visual over S1: a column, a measure, a column that is not there, and an item that no rule reads.
LAYOUT = {"sections": [{"displayName": "Page", "visualContainers": [{"config": json.dumps({"singleVisual": {
    "visualType": "columnChart",
    "prototypeQuery": {"From": [{"Name": "s", "Entity": "S1"}], "Select": [
        {"Name": "q1", **_field("Column", "Amount")}, {"Name": "q2", **_field("Measure", "Total1")}, {"Name": "q3", **_field("Column", "Gone")}, {"Name": "q4", "Other": {}},
    ]},
    "projections": {"Category": [{"queryRef": "q1"}], "Y": [{"queryRef": "q2"}]},
}})}]}]}


def model(spark: SparkSession, sf_dir: str) -> B.Model:
    t = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    table = F.format_string("S%d", "k")
    text = (
        F.when(F.col("k") % 3 == 0, F.format_string("let a = S%d, b = Table.SelectRows(a, each [x] > 1) in b", F.col("k") + 1))
        .when(F.col("k") % 3 == 1, F.format_string('let s = Sql.Database("srv", "db%d"), t = s{[Name="V%d"]}[Data] in t', "n", "k"))
        .otherwise(F.format_string('let s = Csv.Document("u"), t = Table.TransformColumnTypes(s, {{"a%d", type text}}), r = Table.RenameColumns(t, {{"a%d", "b"}}) in r', "n", "n"))
    )
    held = t.where("k % 3 = 1").withColumn("table", table)
    return B.Model(
        t.select(table.alias("table"), text.alias("expression")),
        held.select("table", F.explode(F.array(F.lit("Amount"), F.lit("Cost"))).alias("name")),
        held.where("k % 2 = 0").select("table", F.lit("Margin").alias("name"), F.lit("[Amount] - [Cost] - [Nope]").alias("expression")),
        held.select("table", F.explode(F.array(
            F.struct(F.format_string("Total%d", "k").alias("name"), F.format_string("SUM(S%d[Amount])", "k").alias("expression")),
            F.struct(F.format_string("Twice%d", "k").alias("name"), F.format_string("[Total%d] * 2", "k").alias("expression")),
        )).alias("m")).select("table", "m.*"),
        held.select(F.col("table").alias("from_table"), F.lit("Amount").alias("from_column"), F.col("table").alias("to_table"), F.lit("Cost").alias("to_column")),
        LAYOUT, "r",
    )


def _graph(spark: SparkSession, sf_dir: str) -> graph.Graph:
    return B.build(model(spark, sf_dir))


_S = "s AS (SELECT s_suppkey AS k, s_nationkey AS n, 'S' || s_suppkey AS t FROM supplier), h AS (SELECT * FROM s WHERE k % 3 = 1)"
_NODES = f"""WITH {_S}
SELECT DISTINCT 'source::sql::srv/db' || n AS id, 'source' AS type, 'srv/db' || n AS label, NULL AS "table", NULL AS view, NULL::BOOLEAN AS inferred, NULL AS source_column FROM h
UNION ALL SELECT 'query::' || t, 'query', t, NULL, CASE WHEN k % 3 = 1 THEN 'V' || k END, NULL, NULL FROM s
UNION ALL SELECT 'query::' || t || '::' || x, 'step', x, t, NULL, NULL, NULL FROM s, (VALUES (0, 'a'), (0, 'b'), (1, 's'), (1, 't'), (2, 's'), (2, 't'), (2, 'r')) v(m, x) WHERE k % 3 = m
UNION ALL SELECT 'column::' || t || '::' || c, 'column', c, t, NULL, NULL, NULL FROM h, (VALUES ('Amount'), ('Cost')) v(c)
UNION ALL SELECT 'column::' || t || '::b', 'column', 'b', t, NULL, true, 'a' || n FROM s WHERE k % 3 = 2
UNION ALL SELECT 'calculated_column::' || t || '::Margin', 'calculated_column', 'Margin', t, NULL, NULL, NULL FROM h WHERE k % 2 = 0
UNION ALL SELECT 'unresolved::' || t || '::Nope', 'unresolved', 'Nope', t, NULL, NULL, NULL FROM h WHERE k % 2 = 0
UNION ALL SELECT 'measure::' || t || '::' || m || k, 'measure', m || k, t, NULL, NULL, NULL FROM h, (VALUES ('Total'), ('Twice')) v(m)
UNION ALL SELECT 'visual_field::r::Page::0::' || f, 'visual_field', f, CASE WHEN f <> 'q4' THEN 'S1' END, NULL, NULL, NULL FROM (VALUES ('Amount'), ('Total1'), ('Gone'), ('q4')) v(f)
UNION ALL SELECT * FROM (VALUES ('unresolved::S1::Gone', 'unresolved', 'Gone', 'S1', NULL, NULL::BOOLEAN, NULL), ('unresolved::?::q4', 'unresolved', 'q4', NULL, NULL, NULL, NULL)) v"""
_LINKS = f"""{_S}, links AS (
SELECT 'source::sql::srv/db' || n AS src, 'query::' || t AS dst, 'feeds' AS type FROM h
UNION ALL SELECT 'query::' || t, 'query::' || t || '::' || x, 'contains' FROM s, (VALUES (0, 'a'), (0, 'b'), (1, 's'), (1, 't'), (2, 's'), (2, 't'), (2, 'r')) v(m, x) WHERE k % 3 = m
UNION ALL SELECT 'query::' || t || '::' || x, 'query::' || t || '::' || y, 'feeds' FROM s, (VALUES (0, 'a', 'b'), (1, 's', 't'), (2, 's', 't'), (2, 't', 'r')) v(m, x, y) WHERE k % 3 = m
UNION ALL SELECT 'query::' || h.t, 'query::' || s.t, 'feeds' FROM s JOIN h ON h.k = s.k + 1 WHERE s.k % 3 = 0
UNION ALL SELECT 'query::' || t, 'column::' || t || '::' || c, 'feeds' FROM h, (VALUES ('Amount'), ('Cost')) v(c)
UNION ALL SELECT 'query::' || t, 'column::' || t || '::b', 'feeds' FROM s WHERE k % 3 = 2
UNION ALL SELECT 'column::' || t || '::' || c, 'calculated_column::' || t || '::Margin', 'derives_from' FROM h, (VALUES ('Amount'), ('Cost')) v(c) WHERE k % 2 = 0
UNION ALL SELECT 'unresolved::' || t || '::Nope', 'calculated_column::' || t || '::Margin', 'derives_from' FROM h WHERE k % 2 = 0
UNION ALL SELECT 'column::' || t || '::Amount', 'measure::' || t || '::Total' || k, 'derives_from' FROM h
UNION ALL SELECT 'measure::' || t || '::Total' || k, 'measure::' || t || '::Twice' || k, 'derives_from' FROM h
UNION ALL SELECT 'column::' || t || '::' || a, 'column::' || t || '::' || b, 'relates_to' FROM h, (VALUES ('Amount', 'Cost'), ('Cost', 'Amount')) v(a, b)
UNION ALL SELECT * FROM (VALUES ('column::S1::Amount', 'visual_field::r::Page::0::Amount', 'displayed_in'), ('measure::S1::Total1', 'visual_field::r::Page::0::Total1', 'displayed_in'),
 ('unresolved::S1::Gone', 'visual_field::r::Page::0::Gone', 'displayed_in'), ('unresolved::?::q4', 'visual_field::r::Page::0::q4', 'displayed_in')) v)"""


def lin_build_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).nodes.select("id", "type", "label", "table", "view", "inferred", "source_column")


def lin_build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).edges.select("src", "dst", "type")


def lin_source_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.source_tables(_graph(spark, sf_dir)).select("source", "query", "view", F.array_join("columns", ",").alias("columns"), "names_reliable")


def lin_output_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.output_pages(_graph(spark, sf_dir)).select("page", "source_type", "n", F.array_join("unresolved", ",").alias("unresolved"))


def lin_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.tree_paths(_graph(spark, sf_dir), "measure::S1::Twice1").select(F.array_join("path", " ").alias("path"))


def lin_query_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each query that reads another, whether it comes after that one in the topological order."""
    m = model(spark, sf_dir)
    place = {t: i for i, t in enumerate(codegen.query_order(m))}
    at = spark.createDataFrame(list(place.items()), "t string, i int")
    found = B.dependencies(m.queries).join(at.withColumnRenamed("t", "table").withColumnRenamed("i", "later"), "table").join(at.withColumnRenamed("t", "needs").withColumnRenamed("i", "sooner"), "needs")
    return found.select("table", "needs", (F.col("later") > F.col("sooner")).alias("after"))


def dax_over_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import dax

    frames = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "customer")}
    own = {("orders", "Orders"): "COUNTROWS(orders)", ("customer", "Customers"): "COUNTROWS(customer)", ("orders", "Per customer"): "DIVIDE([Orders], [Customers])", ("customer", "Spread"): "STDEV.S(customer[c_acctbal])"}
    df = dax.Measures(own, frames).frame()
    return df.select(F.col("Orders").alias("orders"), F.col("Customers").alias("customers"), F.round("`Per customer`", 6).alias("per_customer"), F.round("Spread", 4).alias("spread"))


MODEL = {
    "lin_build_nodes": (lin_build_nodes, _NODES),
    "lin_build_edges": (lin_build_edges, f"WITH {_LINKS} SELECT * FROM links"),
    "lin_source_schema": (lin_source_schema, f"WITH {_S} SELECT 'srv/db' || n AS source, t AS query, 'V' || k AS view, 'Amount,Cost' AS columns, true AS names_reliable FROM h"),
    "lin_output_schema": (lin_output_schema, "SELECT * FROM (VALUES ('Page', 'column', 1::BIGINT, ''), ('Page', 'measure', 1, ''), ('Page', 'unresolved', 2, 'Gone,q4')) v(page, source_type, n, unresolved)"),
    "lin_tree": (
        lin_tree,
        f"""WITH RECURSIVE {_LINKS}, p AS (SELECT ['measure::S1::Twice1'] AS path UNION ALL SELECT list_append(path, src) FROM p JOIN links ON dst = path[len(path)] WHERE NOT list_contains(path, src) AND len(path) <= 12)
SELECT array_to_string(path, ' ') AS path FROM p""",
    ),
    "lin_query_order": (lin_query_order, f"""WITH {_S} SELECT s.t AS "table", h.t AS needs, true AS after FROM s JOIN h ON h.k = s.k + 1 WHERE s.k % 3 = 0"""),
    "dax_over_tables": (
        dax_over_tables,
        """SELECT (SELECT count(*) FROM orders) AS orders, count(*) AS customers, round((SELECT count(*) FROM orders) / count(*), 6) AS per_customer, round(stddev_samp(c_acctbal), 4) AS spread FROM customer""",
    ),
}

#: name -> (M program, select list, SQL): functions that no other registered program uses.
PROGRAMS: dict[str, tuple[str, str | None, str]] = {
    "m_trim_ends": (
        """let a = Table.AddColumn(nation, "p", each "  " & [n_name] & " "), b = Table.AddColumn(a, "s", each Text.TrimStart([p])), c = Table.AddColumn(b, "e", each Text.TrimEnd([p])) in c""",
        "n_nationkey; s; e",
        "SELECT n_nationkey, n_name || ' ' AS s, '  ' || n_name AS e FROM nation",
    ),
    "m_divide": (
        """Table.AddColumn(lineitem, "unit", each [l_extendedprice] / [l_quantity])""",
        "l_orderkey; l_linenumber; floor(unit) AS unit",
        "SELECT l_orderkey, l_linenumber, floor(l_extendedprice / l_quantity)::BIGINT AS unit FROM lineitem",
    ),
    "m_datetime": (
        """Table.AddColumn(Table.SelectRows(orders, each [o_orderdate] >= #datetime(1997, 1, 1, 12, 30, 0)), "now", each DateTime.LocalNow() > [o_orderdate])""",
        "o_orderkey; now",
        "SELECT o_orderkey, true AS now FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 12:30:00'",
    ),
    "m_error_row": (
        """Table.AddColumn(part, "v", each try (if [p_size] > 25 then error "too large" else [p_size]) otherwise -1)""",
        "p_partkey; cast(v AS bigint) AS v",
        "SELECT p_partkey, CASE WHEN p_size > 25 THEN -1 ELSE p_size END::BIGINT AS v FROM part",
    ),
    "m_remove_nulls": (
        """let j = Table.Join(customer, {"c_custkey"}, orders, {"o_custkey"}, JoinKind.LeftOuter),
  g = Table.Group(j, {"c_nationkey"}, {{"n", each List.Count(List.RemoveNulls([o_orderkey])), Int64.Type}}) in g""",
        "c_nationkey; cast(n AS bigint) AS n",
        "SELECT c_nationkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    ),
    "m_to_rows": (
        """let r = Table.ToRows(region), t = Table.FromRows(r, {"key", "name"}) in t""",
        "cast(key AS bigint) AS key; name",
        "SELECT r_regionkey::BIGINT AS key, r_name AS name FROM region",
    ),
    "m_binary": (
        """let j = Json.Document(Binary.Decompress(Binary.FromText("q1YqSa0oUbJSKikqTVWqBQA=", BinaryEncoding.Base64), Compression.Deflate)), t = Table.AddColumn(region, "x", each Record.Field(j, "text")) in t""",
        "r_regionkey; x",
        "SELECT r_regionkey, 'true' AS x FROM region",
    ),
    "m_split_nothing": (
        """Table.SplitColumn(region, "r_name", Splitter.SplitByNothing(), {"whole"})""",
        "r_regionkey; whole",
        "SELECT r_regionkey, r_name AS whole FROM region",
    ),
    "m_csv_text": (
        """let c = Csv.Document("key,name#(lf)1,""a#(lf)b""#(lf)2,c"), h = Table.PromoteHeaders(c) in h""",
        "cast(key AS bigint) AS key; name",
        "SELECT * FROM (VALUES (1::BIGINT, 'a' || chr(10) || 'b'), (2, 'c')) v(key, name)",
    ),
}
