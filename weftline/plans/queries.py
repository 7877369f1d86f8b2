"""The engine's registered queries over the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dax
from ..lineage import detect, graph
from . import model_queries as more
from .compiler import Compiler

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")
Query = Callable[[SparkSession, str], DataFrame]


def tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def _m(source: str, finish: str | None = None) -> Query:
    """A query of an M program; ``finish`` selects over it, to align types and rounding with the SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        needed = tuple(t for t in TABLES if t in source)
        df = Compiler(spark, tables(spark, sf_dir, needed)).frame(source)
        return df.selectExpr(*[x.strip() for x in finish.split(";")]) if finish else df

    return run


#: name -> (M program, select list or None, DuckDB SQL)
PROGRAMS: dict[str, tuple[str, str | None, str]] = {
    "m_pricing_summary": (
        """let
  shipped = Table.SelectRows(lineitem, each [l_shipdate] <= #date(1998, 9, 2)),
  priced = Table.AddColumn(shipped, "charge", each [l_extendedprice] * (1 - [l_discount]) * (1 + [l_tax])),
  grouped = Table.Group(priced, {"l_returnflag", "l_linestatus"}, {
    {"sum_qty", each List.Sum([l_quantity]), type number}, {"sum_charge", each List.Sum([charge]), type number},
    {"max_price", each List.Max([l_extendedprice]), type number}, {"n", each List.Count([l_orderkey]), Int64.Type}})
in Table.Sort(grouped, {{"l_returnflag", Order.Ascending}, {"l_linestatus", Order.Ascending}})""",
        "l_returnflag; l_linestatus; round(sum_qty, 2) AS sum_qty; round(sum_charge, 0) AS sum_charge; max_price; n",
        """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 0) AS sum_charge,
 max(l_extendedprice) AS max_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
    ),
    "m_select_rows": (
        """Table.SelectRows(orders, each ([o_totalprice] > 100000 and [o_orderstatus] = "F") or not ([o_orderpriority] <> "1-URGENT"))""",
        "o_orderkey; o_orderstatus; o_totalprice",
        "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE (o_totalprice > 100000 AND o_orderstatus = 'F') OR o_orderpriority = '1-URGENT'",
    ),
    "m_null_compare": (
        """let j = Table.Join(customer, "c_custkey", Table.RenameColumns(orders, {{"o_custkey", "k"}}), "k", JoinKind.LeftOuter),
  f = Table.SelectRows(j, each [o_orderkey] = null or [o_totalprice] < 20000) in Table.SelectColumns(f, {"c_custkey", "o_orderkey"})""",
        None,
        "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL OR coalesce(o_totalprice < 20000, false)",
    ),
    "m_add_column": (
        """Table.AddColumn(Table.SelectColumns(part, {"p_partkey", "p_retailprice", "p_size"}), "price", each [p_retailprice] * 2 - [p_size], type number)""",
        "p_partkey; round(price, 2) AS price",
        "SELECT p_partkey, round(p_retailprice * 2 - p_size, 2) AS price FROM part",
    ),
    "m_if": (
        """Table.AddColumn(customer, "band", each if [c_acctbal] < 0 then "debt" else if [c_acctbal] >= 5000 then "high" else "low")""",
        "c_custkey; band",
        "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal >= 5000 THEN 'high' ELSE 'low' END AS band FROM customer",
    ),
    "m_coalesce": (
        """let j = Table.Join(customer, "c_custkey", Table.RenameColumns(orders, {{"o_custkey", "k"}}), "k", JoinKind.LeftOuter)
in Table.AddColumn(j, "status", each [o_orderstatus] ?? "none")""",
        "c_custkey; o_orderkey; status",
        "SELECT c_custkey, o_orderkey, coalesce(o_orderstatus, 'none') AS status FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
    ),
    "m_try_otherwise": (
        """Table.AddColumn(part, "n", each try Number.From(Text.Start([p_brand], 1)) otherwise -1)""",
        "p_partkey; n",
        "SELECT p_partkey, coalesce(TRY_CAST(left(p_brand, 1) AS DOUBLE), -1.0) AS n FROM part",
    ),
    "m_project": ("""Table.SelectColumns(supplier, {"s_name", "s_suppkey"})""", None, "SELECT s_name, s_suppkey FROM supplier"),
    "m_rename_swap": (
        """Table.RenameColumns(Table.SelectColumns(nation, {"n_nationkey", "n_regionkey", "n_name"}), {{"n_nationkey", "n_regionkey"}, {"n_regionkey", "n_nationkey"}})""",
        None,
        "SELECT n_nationkey AS n_regionkey, n_regionkey AS n_nationkey, n_name FROM nation",
    ),
    "m_reorder": ("""Table.ReorderColumns(region, {"r_name", "r_regionkey"})""", None, "SELECT r_name, r_regionkey FROM region"),
    "m_remove": ("""Table.RemoveColumns(customer, {"c_name", "c_acctbal", "absent"})""", None, "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer"),
    "m_column_names": ("Table.ColumnNames(region)", None, "SELECT unnest(['r_regionkey', 'r_name']) AS \"Column1\""),
    "m_group_distinct": (
        """Table.Group(orders, {"o_orderstatus"}, {{"customers", each List.Count(List.Distinct([o_custkey]))}, {"any_big", each List.AnyTrue([o_totalprice])}})""".replace(
            "List.AnyTrue([o_totalprice])", 'List.Contains([o_orderpriority], "1-URGENT")'
        ),
        "o_orderstatus; cast(customers AS bigint) AS customers; any_big",
        "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, bool_or(o_orderpriority = '1-URGENT') AS any_big FROM orders GROUP BY 1",
    ),
    "m_group_first": (
        """Table.Group(Table.Sort(orders, {{"o_totalprice", Order.Descending}, {"o_orderkey", Order.Ascending}}), {"o_custkey"}, {{"top", each List.First([o_orderkey])}})""",
        None,
        "SELECT o_custkey, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS top FROM orders GROUP BY 1",
    ),
    "m_group_nested": (
        """let g = Table.Group(lineitem, {"l_returnflag"}, {{"rows", each _}, {"n", each List.Count([l_orderkey])}}),
  e = Table.ExpandTableColumn(g, "rows", {"l_orderkey", "l_quantity"}) in Table.Group(e, {"l_returnflag"}, {{"n", each List.Count([l_orderkey])}, {"q", each List.Sum([l_quantity])}})""",
        "l_returnflag; n; round(q, 2) AS q",
        "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1",
    ),
    "m_group_filtered": (
        """Table.Group(lineitem, {"l_linestatus"}, {{"returned", each List.Count(Table.SelectRows(_, each [l_returnflag] = "R")[l_orderkey])}})""".replace("[l_orderkey])}", "[l_orderkey])}"),
        None,
        "SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1",
    ),
    "m_sort_head": (
        """let s = Table.Sort(customer, {{"c_acctbal", Order.Descending}, {"c_custkey", Order.Ascending}}), r = s{0} in #table({"key", "bal"}, {{r[c_custkey], r[c_acctbal]}})""",
        None,
        "SELECT c_custkey AS key, c_acctbal AS bal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 1",
    ),
    "m_distinct": ("""Table.Distinct(Table.SelectColumns(orders, {"o_orderstatus", "o_orderpriority"}))""", None, "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "m_distinct_keyed": (
        """Table.Distinct(Table.Sort(orders, {{"o_orderkey", Order.Ascending}}), {"o_custkey"})""",
        "o_custkey; o_orderkey; o_totalprice",
        "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1",
    ),
    "m_combine": (
        """let c = Table.RenameColumns(Table.SelectColumns(customer, {"c_name", "c_acctbal", "c_mktsegment"}), {{"c_name", "name"}, {"c_acctbal", "bal"}}),
  s = Table.RenameColumns(Table.SelectColumns(supplier, {"s_name", "s_acctbal"}), {{"s_name", "name"}, {"s_acctbal", "bal"}}) in Table.Combine({c, s})""",
        None,
        "SELECT c_name AS name, c_acctbal AS bal, c_mktsegment FROM customer UNION ALL BY NAME SELECT s_name AS name, s_acctbal AS bal FROM supplier",
    ),
    "m_nested_unexpanded": (
        """let j = Table.NestedJoin(customer, {"c_custkey"}, orders, {"o_custkey"}, "o", JoinKind.LeftOuter),
  n = Table.AddColumn(j, "n", each List.Count([o])) in Table.SelectColumns(n, {"c_custkey", "n"})""",
        "c_custkey; cast(n AS bigint) AS n",
        "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    ),
    "m_nested_expand": (
        """let j = Table.NestedJoin(nation, {"n_regionkey"}, region, {"r_regionkey"}, "r"), k = Table.AddColumn(j, "x", each 1)
in Table.ExpandTableColumn(k, "r", {"r_name"}, {"region"})""",
        "n_name; region; x",
        "SELECT n_name, r_name AS region, 1 AS x FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
    ),
    "m_types": (
        """Table.TransformColumnTypes(Table.AddColumn(Table.SelectColumns(part, {"p_partkey", "p_size", "p_brand"}), "t", each Text.From([p_size])), {{"t", type number}, {"p_size", type text}, {"p_brand", type number}})""",
        None,
        "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size, TRY_CAST(p_brand AS DOUBLE) AS p_brand, CAST(p_size AS DOUBLE) AS t FROM part",
    ),
    "m_transform_columns": (
        """Table.TransformColumns(Table.SelectColumns(nation, {"n_nationkey", "n_name"}), {{"n_name", Text.Lower}, {"n_nationkey", each _ * 10}})""",
        "cast(n_nationkey AS bigint) AS n_nationkey; n_name",
        "SELECT CAST(n_nationkey * 10 AS BIGINT) AS n_nationkey, lower(n_name) AS n_name FROM nation",
    ),
    "m_replace_value": (
        """Table.ReplaceValue(Table.SelectColumns(orders, {"o_orderkey", "o_orderstatus", "o_orderpriority"}), each [o_orderstatus] = "F", "done", Replacer.ReplaceValue, {"o_orderstatus", "o_orderpriority"})""",
        None,
        "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders",
    ),
    "m_replace_text": (
        """Table.ReplaceValue(Table.SelectColumns(part, {"p_partkey", "p_name"}), "e", "3", Replacer.ReplaceText, {"p_name"})""",
        None,
        "SELECT p_partkey, replace(p_name, 'e', '3') AS p_name FROM part",
    ),
    "m_replace_errors": (
        """Table.ReplaceErrorValues(Table.TransformColumnTypes(Table.SelectColumns(part, {"p_partkey", "p_brand"}), {{"p_brand", type number}}), {{"p_brand", -1}})""",
        "p_partkey; cast(p_brand AS double) AS p_brand",
        "SELECT p_partkey, coalesce(TRY_CAST(p_brand AS DOUBLE), -1.0) AS p_brand FROM part",
    ),
    "m_split": (
        """Table.SplitColumn(Table.SelectColumns(part, {"p_partkey", "p_name"}), "p_name", Splitter.SplitTextByEachDelimiter({" "}), {"a", "b", "c"})""",
        None,
        "SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, string_split(p_name, ' ')[3] AS c FROM part",
    ),
    "m_combine_columns": (
        """Table.CombineColumns(Table.SelectColumns(part, {"p_partkey", "p_brand", "p_type"}), {"p_brand", "p_type"}, Combiner.CombineTextByDelimiter("/"), "both")""",
        None,
        "SELECT p_partkey, p_brand || '/' || p_type AS \"both\" FROM part",
    ),
    "m_text": (
        """let t = Table.SelectColumns(customer, {"c_custkey", "c_name", "c_mktsegment"}), add = (t, n, f) => Table.AddColumn(t, n, f),
  a = add(t, "upper", each Text.Upper([c_name])), b = add(a, "len", each Text.Length([c_name])), c = add(b, "start", each Text.Start([c_name], 4)),
  d = add(c, "tail", each Text.End([c_name], 3)), e = add(d, "mid", each Text.Middle([c_name], 2, 5)), f = add(e, "has", each Text.Contains([c_name], "01")),
  g = add(f, "begins", each Text.StartsWith([c_mktsegment], "B")), h = add(g, "ends", each Text.EndsWith([c_name], "7")), i = add(h, "after", each Text.AfterDelimiter([c_name], "#")),
  j = add(i, "before", each Text.BeforeDelimiter([c_name], "#")), k = add(j, "proper", each Text.Proper([c_mktsegment])), l = add(k, "repl", each Text.Replace([c_name], "0", "o")),
  m = add(l, "joined", each [c_mktsegment] & "-" & Text.From([c_custkey])), n = add(m, "trimmed", each Text.Trim("  " & [c_name] & " ")), o = add(n, "lower", each Text.Lower([c_name]))
in o""",
        'c_custkey; upper; cast(len AS bigint) AS len; start; tail; mid; has; begins; ends; after; before; proper; repl; joined; trimmed; lower',
        """SELECT c_custkey, upper(c_name) AS upper, length(c_name) AS len, left(c_name, 4) AS start, right(c_name, 3) AS tail, substring(c_name, 3, 5) AS mid,
 contains(c_name, '01') AS has, starts_with(c_mktsegment, 'B') AS begins, ends_with(c_name, '7') AS ends, split_part(c_name, '#', 2) AS after, split_part(c_name, '#', 1) AS before,
 upper(left(c_mktsegment, 1)) || lower(substring(c_mktsegment, 2)) AS proper, replace(c_name, '0', 'o') AS repl, c_mktsegment || '-' || c_custkey AS joined, c_name AS trimmed, lower(c_name) AS lower FROM customer""",
    ),
    "m_number": (
        """let t = Table.SelectColumns(customer, {"c_custkey", "c_acctbal"}), a = Table.AddColumn(t, "abs", each Number.Abs([c_acctbal])),
  b = Table.AddColumn(a, "whole", each Number.IntegerDivide([c_acctbal], 7)), c = Table.AddColumn(b, "half", each Number.Round([c_acctbal], 0)) in c""",
        "c_custkey; abs; whole; abs(half - c_acctbal) <= 0.5 AS near",
        "SELECT c_custkey, abs(c_acctbal) AS abs, CAST(floor(trunc(c_acctbal) / 7) AS BIGINT) AS whole, true AS near FROM customer",
    ),
    "m_date": (
        """let t = Table.SelectColumns(orders, {"o_orderkey", "o_orderdate"}), add = (t, n, f) => Table.AddColumn(t, n, f), a = add(t, "y", each Date.Year([o_orderdate])),
  b = add(a, "m", each Date.Month([o_orderdate])), c = add(b, "d", each Date.Day([o_orderdate])), e = add(c, "dow", each Date.DayOfWeek([o_orderdate])),
  f = add(e, "week", each Date.WeekOfYear([o_orderdate])), g = add(f, "sow", each Date.ToText(Date.StartOfWeek([o_orderdate]))), h = add(g, "eow", each Date.ToText(Date.EndOfWeek([o_orderdate]))),
  i = add(h, "age", each Duration.Days(#date(2000, 1, 1) - Date.From([o_orderdate]))) in i""",
        "o_orderkey; cast(y AS bigint) AS y; cast(m AS bigint) AS m; cast(d AS bigint) AS d; cast(dow AS bigint) AS dow; cast(week AS bigint) AS week; sow; eow; age",
        """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, CAST(isodow(o_orderdate) - 1 AS BIGINT) AS dow, weekofyear(o_orderdate) AS week,
 strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS sow, strftime(date_trunc('week', o_orderdate) + INTERVAL 6 DAY, '%Y-%m-%d') AS eow,
 date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS age FROM orders""",
    ),
    "m_list": (
        """let t = Table.SelectColumns(part, {"p_partkey", "p_name"}), w = Table.AddColumn(t, "w", each Text.Split([p_name], " ")), add = (t, n, f) => Table.AddColumn(t, n, f),
  a = add(w, "n", each List.Count([w])), b = add(a, "first", each List.First([w])), c = add(b, "largest", each List.Max([w])),
  d = add(c, "lens", each List.Accumulate([w], 0, (s, x) => s + Text.Length(x))), e = add(d, "has", each List.Contains([w], "small")),
  f = add(e, "up", each Text.Combine(List.Transform([w], each Text.Upper(_)), "+")), g = add(f, "long", each List.Count(List.Select([w], each Text.Length(_) > 5))),
  h = add(g, "none", each List.IsEmpty([w])), i = add(h, "kinds", each List.Count(List.Distinct([w]))) in i""",
        "p_partkey; cast(n AS bigint) AS n; first; largest; cast(lens AS bigint) AS lens; has; up; cast(long AS bigint) AS long; none; cast(kinds AS bigint) AS kinds",
        """SELECT p_partkey, len(w) AS n, w[1] AS first, list_max(w) AS largest, CAST(list_sum(list_transform(w, lambda x : length(x))) AS BIGINT) AS lens, list_contains(w, 'small') AS has,
 list_aggregate(list_transform(w, lambda x : upper(x)), 'string_agg', '+') AS up, len(list_filter(w, lambda x : length(x) > 5)) AS long, false AS none, len(list_distinct(w)) AS kinds
FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""",
    ),
    "m_list_column": (
        """#table({"total", "largest", "n", "distinct"}, {{List.Sum(supplier[s_acctbal]), List.Max(supplier[s_acctbal]), List.Count(supplier[s_name]), List.Count(List.Distinct(supplier[s_nationkey]))}})""",
        "round(total, 2) AS total; largest; n; distinct",
        "SELECT round(sum(s_acctbal), 2) AS total, max(s_acctbal) AS largest, count(*) AS n, count(DISTINCT s_nationkey) AS \"distinct\" FROM supplier",
    ),
    "m_list_dates": (
        """Table.FromList(List.Dates(#date(2024, 2, 27), 4, #duration(1, 0, 0, 0)))""",
        "date_format(Column1, 'yyyy-MM-dd') AS d",
        "SELECT strftime(x, '%Y-%m-%d') AS d FROM (SELECT unnest(generate_series(TIMESTAMP '2024-02-27', TIMESTAMP '2024-03-01', INTERVAL 1 DAY)) AS x)",
    ),
    "m_pivot": (
        """let s = Table.Sort(orders, {{"o_orderkey", Order.Ascending}}), t = Table.SelectColumns(s, {"o_custkey", "o_orderstatus", "o_orderkey"}),
  g = Table.Group(t, {"o_custkey", "o_orderstatus"}, {{"n", each List.Count([o_orderkey])}}) in Table.Pivot(g, "o_orderstatus", "n")""",
        "o_custkey; F; O; P",
        """SELECT o_custkey, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS "F", nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS "O",
 nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS "P" FROM orders GROUP BY 1""",
    ),
    "m_json": (
        """let p = Table.AddColumn(events, "p", each Json.Document([props])), k = Table.AddColumn(p, "k", each Record.Field([p], "k")), d = Table.AddColumn(k, "absent", each Record.FieldOrDefault([p], "zz", "none")) in d""",
        "event_id; k; absent",
        "SELECT event_id, json_extract_string(props, '$.k') AS k, 'none' AS absent FROM events",
    ),
    "m_expand_record": (
        """Table.ExpandRecordColumn(Table.AddColumn(Table.SelectColumns(events, {"event_id", "props"}), "p", each Json.Document([props])), "p", {"k"}, {"key"})""",
        "event_id; key",
        "SELECT event_id, json_extract_string(props, '$.k') AS key FROM events",
    ),
    "m_literal_tables": (
        """let a = Table.FromRecords({[x = 1, y = "p"], [x = 2, z = "q"]}), b = Table.FromRows({{3, "r"}}, {"x", "y"}), c = Table.PromoteHeaders(#table(2, {{"x", "y"}, {"4", "s"}})),
  d = Table.TransformColumnTypes(c, {{"x", Int64.Type}}) in Table.Combine({a, b, d})""",
        "cast(x AS bigint) AS x; y; z",
        "SELECT * FROM (VALUES (1::BIGINT, 'p', NULL), (2, NULL, 'q'), (3, 'r', NULL), (4, 's', NULL)) t(x, y, z)",
    ),
    "m_value_is": (
        """Table.AddColumn(Table.AddColumn(supplier, "is_text", each Value.Is([s_name], type text)), "whole", each Value.Is([s_acctbal], Int64.Type))""",
        "s_suppkey; is_text; whole",
        "SELECT s_suppkey, true AS is_text, s_acctbal = floor(s_acctbal) AS whole FROM supplier",
    ),
}

JOINS = {"inner": "Inner", "left": "LeftOuter", "right": "RightOuter", "full": "FullOuter", "left_anti": "LeftAnti", "right_anti": "RightAnti"}
_FEW = "Table.SelectRows(customer, each [c_acctbal] > 2000)"


def _joins() -> dict[str, tuple[str, str | None, str]]:
    out = {}
    for how, kind in JOINS.items():
        source = f"""let c = {_FEW}, o = Table.SelectRows(orders, each [o_totalprice] > 200000) in Table.Join(c, {{"c_custkey"}}, o, {{"o_custkey"}}, JoinKind.{kind})"""
        few, big = "(SELECT * FROM customer WHERE c_acctbal > 2000) c", "(SELECT * FROM orders WHERE o_totalprice > 200000) o"
        if how == "left_anti":
            out[f"m_join_{how}"] = (source, "c_custkey; c_name", f"SELECT c_custkey, c_name FROM {few} WHERE NOT EXISTS (SELECT 1 FROM {big} WHERE o_custkey = c_custkey)")
        elif how == "right_anti":
            out[f"m_join_{how}"] = (source, "o_custkey; o_orderkey", f"SELECT o_custkey, o_orderkey FROM {big} WHERE NOT EXISTS (SELECT 1 FROM {few} WHERE o_custkey = c_custkey)")
        else:
            out[f"m_join_{how}"] = (source, "c_custkey; c_name; o_orderkey; o_totalprice", f"SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM {few} {how.upper()} JOIN {big} ON c_custkey = o_custkey")
    return out


MEASURES = {
    ("orders", "Revenue"): "SUM(orders[o_totalprice])", ("orders", "Mean"): "AVERAGE('orders'[o_totalprice])", ("orders", "Least"): "MIN(orders[o_totalprice])",
    ("orders", "Most"): "max(orders[o_totalprice])", ("orders", "Middle"): "MEDIAN(orders[o_totalprice])", ("orders", "Orders"): "COUNTROWS(orders)",
    ("orders", "Keys"): "COUNT(orders[o_custkey])", ("orders", "Statuses"): "COUNTA(orders[o_orderstatus])", ("orders", "Customers"): "DISTINCTCOUNT(orders[o_custkey])",
    ("orders", "Per order"): "DIVIDE([Revenue], [Orders], 0)", ("orders", "Spread"): "STDEV.P(orders[o_totalprice])", ("orders", "Per customer"): "DIVIDE([Orders], DISTINCTCOUNT(orders[o_custkey]))",
}


def dax_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dax.Measures(MEASURES, tables(spark, sf_dir, ("orders",))).frame()
    names = {"Revenue": "revenue", "Mean": "mean", "Least": "least", "Most": "most", "Middle": "middle", "Orders": "orders", "Keys": "keys", "Statuses": "statuses", "Customers": "customers", "Per order": "per_order", "Spread": "spread", "Per customer": "per_customer"}
    rounded = {"Revenue": 0, "Mean": 2, "Middle": 2, "Per order": 2, "Spread": 2, "Per customer": 4}
    return df.select(*[(F.round(F.col(f"`{n}`"), rounded[n]) if n in rounded else F.col(f"`{n}`")).alias(a) for n, a in names.items()])


DAX_SQL = """SELECT round(sum(o_totalprice), 0) AS revenue, round(avg(o_totalprice), 2) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most, round(median(o_totalprice), 2) AS middle,
 count(*) AS orders, count(o_custkey) AS keys, count(o_orderstatus) AS statuses, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice) / count(*), 2) AS per_order,
 round(stddev_pop(o_totalprice), 2) AS spread, round(count(*) / count(DISTINCT o_custkey), 4) AS per_customer FROM orders"""


def lin_source_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables(spark, sf_dir, ("pages",))["pages"]
    text = F.concat(F.lit('let a = Web.Contents("'), "url", F.lit('"), b = Sql.Database("srv", "db'), (F.col("page_id") % 3).cast("string"), F.lit('"), c = OData.Feed("'), "url", F.lit('/o") in a'))
    return detect.source_rows(pages.select("page_id", text.alias("m")), "m", ["page_id"])


SOURCE_SQL = """SELECT page_id, 'http' AS system, url AS identifier FROM pages UNION ALL SELECT page_id, 'sql', 'srv/db' || (page_id % 3) FROM pages
UNION ALL SELECT page_id, 'odata', url || '/o' FROM pages UNION ALL SELECT page_id, 'http', url || '/o' FROM pages"""


def lin_source_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables(spark, sf_dir, ("pages",))["pages"]
    return detect.source_rows(pages.select("page_id", F.concat(F.lit('"'), "url", F.lit('"')).alias("m")), "m", ["page_id"]).groupBy("system", "identifier").agg(F.count("*").alias("n"))


def lin_dax_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables(spark, sf_dir, ("part",))["part"]
    text = F.concat(F.lit("SUM(Sales["), "p_brand", F.lit("]) / [Total] + MAX('My Table'["), "p_type", F.lit("])"))
    return dax.reference_rows(part.select("p_partkey", text.alias("e")), "e").select("p_partkey", "ref_table", "ref_name")


REFS_SQL = """SELECT p_partkey, 'Sales' AS ref_table, p_brand AS ref_name FROM part UNION ALL SELECT p_partkey, NULL, 'Total' FROM part UNION ALL SELECT p_partkey, 'My Table', p_type FROM part"""


def key_graph(spark: SparkSession, sf_dir: str) -> graph.Graph:
    """region -> nation -> customer -> order, by foreign keys."""
    t = tables(spark, sf_dir, ("region", "nation", "customer", "orders"))
    ids = {"region": ("r_regionkey", None, None), "nation": ("n_nationkey", "region", "n_regionkey"), "customer": ("c_custkey", "nation", "c_nationkey"), "orders": ("o_orderkey", "customer", "o_custkey")}
    nodes, edges = None, None
    for name, (key, parent, ref) in ids.items():
        n = t[name].select(F.concat_ws("::", F.lit(name), F.col(key).cast("string")).alias("id"), F.lit(name).alias("type"), F.col(key).cast("string").alias("label"))
        nodes = n if nodes is None else nodes.unionByName(n)
        if parent:
            e = t[name].select(F.concat_ws("::", F.lit(parent), F.col(ref).cast("string")).alias("src"), F.concat_ws("::", F.lit(name), F.col(key).cast("string")).alias("dst"), F.lit("feeds").alias("type"), F.lit(0).cast("long").alias("seq"))
            edges = e if edges is None else edges.unionByName(e)
    return graph.Graph(nodes, edges)


_EDGES_SQL = """edges AS (SELECT 'region::' || n_regionkey AS src, 'nation::' || n_nationkey AS dst FROM nation UNION ALL SELECT 'nation::' || c_nationkey, 'customer::' || c_custkey FROM customer
 UNION ALL SELECT 'customer::' || o_custkey, 'orders::' || o_orderkey FROM orders)"""

LINEAGE: dict[str, tuple[Query, str]] = {
    "lin_source_detect": (lin_source_detect, SOURCE_SQL),
    "lin_source_urls": (lin_source_urls, "SELECT 'http' AS system, url AS identifier, count(DISTINCT page_id) AS n FROM pages GROUP BY 2"),
    "lin_dax_refs": (lin_dax_refs, REFS_SQL),
    "lin_downstream": (
        lambda s, d: graph.downstream(key_graph(s, d), "region::1").select("id", F.col("depth").cast("long").alias("depth")),
        f"WITH RECURSIVE {_EDGES_SQL}, r AS (SELECT dst AS id, 1::BIGINT AS depth FROM edges WHERE src = 'region::1' UNION SELECT e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.id) SELECT id, min(depth) AS depth FROM r GROUP BY 1",
    ),
    "lin_upstream": (
        lambda s, d: graph.upstream(key_graph(s, d), "orders::7").select("id", F.col("depth").cast("long").alias("depth")),
        f"WITH RECURSIVE {_EDGES_SQL}, r AS (SELECT src AS id, 1::BIGINT AS depth FROM edges WHERE dst = 'orders::7' UNION SELECT e.src, r.depth + 1 FROM r JOIN edges e ON e.dst = r.id) SELECT id, min(depth) AS depth FROM r GROUP BY 1",
    ),
    "lin_levels": (
        lambda s, d: graph.level(key_graph(s, d), 3, "region").select("id", "type", "label"),
        "SELECT 'customer::' || c_custkey AS id, 'customer' AS type, CAST(c_custkey AS VARCHAR) AS label FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region))",
    ),
    "lin_summary": (
        lambda s, d: graph.summary(key_graph(s, d)),
        """WITH c AS (SELECT 'region' AS type, count(*) AS count FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders)
SELECT * FROM c UNION ALL SELECT 'nodes', CAST(sum(count) AS BIGINT) FROM c UNION ALL SELECT 'edges', CAST(sum(count) AS BIGINT) FROM c WHERE type <> 'region'""",
    ),
    "lin_find_nodes": (
        lambda s, d: graph.find_nodes(key_graph(s, d), "CUSTOMER::12").select("id"),
        "SELECT 'customer::' || c_custkey AS id FROM customer WHERE contains('customer::' || c_custkey, 'customer::12')",
    ),
}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: _m(source, finish) for name, (source, finish, _) in (PROGRAMS | more.PROGRAMS | _joins()).items()}
    return out | {"dax_measures": dax_measures} | {name: q for name, (q, _) in (LINEAGE | more.MODEL).items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, _, sql) in (PROGRAMS | more.PROGRAMS | _joins()).items()} | {"dax_measures": DAX_SQL} | {name: sql for name, (_, sql) in (LINEAGE | more.MODEL).items()}
