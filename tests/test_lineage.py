import json
import zipfile

import pytest

from weftline import cli
from weftline.lineage import build as B
from weftline.lineage import codegen, detect, graph, infer, layout, reports
from weftline.lineage.service import LineageService

LAYOUT = {
    "sections": [{
        "displayName": "P1", "visualContainers": [{"config": json.dumps({"singleVisual": {
            "visualType": "columnChart",
            "prototypeQuery": {"From": [{"Name": "s", "Entity": "Sales"}], "Select": [
                {"Name": "q1", "Column": {"Expression": {"SourceRef": {"Source": "s"}}, "Property": "Amount"}},
                {"Name": "q2", "Aggregation": {"Expression": {"Measure": {"Expression": {"SourceRef": {"Source": "s"}}, "Property": "Total"}}}},
                {"Name": "q3", "Column": {"Expression": {"SourceRef": {"Source": "s"}}, "Property": "Gone"}},
            ]},
            "projections": {"Category": [{"queryRef": "q1"}], "Y": [{"queryRef": "q2"}]},
        }})}],
    }]
}


@pytest.fixture(scope="module")
def model(spark):
    return B.Model.of(
        spark,
        queries={
            "Root": 'let a = OData.Feed("http://x/o") in a',
            "Sales": 'let S = Root, D = S{[Name="Remote"]}[Data], T = Table.TransformColumnTypes(D, {{"amt", type number}}) in T',
            "Bad": "let let let", "Infer": 'let s = Csv.Document("u"), t = Table.TransformColumnTypes(s, {{"a", type text}}), r = Table.RenameColumns(t, {{"a", "b"}}) in r',
        },
        columns=[("Sales", "Amount"), ("Sales", "Cost")], calculated=[("Sales", "Margin", "[Amount] - [Cost] - [Nope]")],
        measures=[("Sales", "Total", "SUM(Sales[Amount])"), ("Sales", "Twice", "[Total] * 2")], relationships=[("Sales", "Amount", "Sales", "Cost")], layout=LAYOUT, name="r.pbix",
    )


@pytest.fixture(scope="module")
def g(model):
    g = B.build(model)
    return graph.Graph(g.nodes.persist(), g.edges.persist())


def test_build(g):
    edges = {(r.src, r.dst, r.type) for r in g.edges.collect()}
    nodes = {r.id: r for r in g.nodes.collect()}
    assert ("source::odata::http://x/o", "query::Root", "feeds") in edges
    assert ("query::Root", "query::Sales", "feeds") in edges
    assert ("column::Sales::Amount", "measure::Sales::Total", "derives_from") in edges
    assert ("measure::Sales::Total", "measure::Sales::Twice", "derives_from") in edges
    assert ("unresolved::Sales::Nope", "calculated_column::Sales::Margin", "derives_from") in edges
    assert ("column::Sales::Cost", "column::Sales::Amount", "relates_to") in edges
    assert ("unresolved::Sales::Gone", "visual_field::r.pbix::P1::0::Gone", "displayed_in") in edges
    assert ("measure::Sales::Total", "visual_field::r.pbix::P1::0::Total", "displayed_in") in edges
    assert nodes["query::Sales"].view == "Remote" and nodes["query::Bad"].body is None
    assert nodes["column::Infer::b"].inferred and nodes["column::Infer::b"].source_column == "a"
    assert nodes["query::Sales::T"].function == "Table.TransformColumnTypes"
    assert nodes["visual_field::r.pbix::P1::0::Amount"].role == "Category"


def test_queries_of_the_graph(g):
    up = {r.id for r in graph.upstream(g, "measure::Sales::Twice").collect()}
    assert {"measure::Sales::Total", "column::Sales::Amount", "query::Sales", "query::Root", "source::odata::http://x/o"} <= up
    assert "column::Sales::Cost" not in up
    assert "column::Sales::Cost" in {r.id for r in graph.upstream(g, "measure::Sales::Twice", True).collect()}
    assert graph.upstream(g, "nope").count() == 0
    assert graph.source_schema(g)["http://x/o"]["Sales"] == {"view": "Remote", "columns": ["Amount", "Cost"], "names_reliable": True, "renamed_columns": {}}
    assert graph.output_schema(g) == {"P1": {"visual_count": 3, "by_source_type": {"column": 1, "measure": 1, "unresolved": 1}, "unresolved": ["Gone"]}}
    top = graph.tree(g, "measure::Sales::Twice")
    assert top["children"][0]["id"] == "measure::Sales::Total"
    assert any("Remote" in line for line in reports.source_tree_lines(g))
    assert "# Source lineage" in reports.source_markdown(g)


def test_closure_of_a_cycle_ends(spark):
    g = graph.Graph.of(spark, [{"id": x, "type": "query", "label": x} for x in "abc"], [("a", "b"), ("b", "c"), ("c", "a")])
    assert {r.id for r in graph.downstream(g, "a").collect()} == {"b", "c"}


def test_parallel_edges_keep_the_last_type(spark):
    g = graph.Graph.of(spark, [{"id": "a", "type": "q"}], [("a", "b", "feeds"), ("a", "b", "relates_to")])
    assert [r.type for r in g.edges.collect()] == ["relates_to"]


def test_levels(spark):
    g = graph.Graph.of(spark, [{"id": "s", "type": "source"}, {"id": "t", "type": "query"}, {"id": "u", "type": "query"}], [("s", "t"), ("t", "u")])
    assert [r.id for r in graph.level(g, 2).collect()] == ["t"]
    with pytest.raises(ValueError):
        graph.level(g, 0)


def test_pass_through_stops_at_columns(spark):
    kind = lambda i, t, **k: {"id": i, "type": t, "label": i, **k}
    g = graph.Graph.of(spark, [kind("s", "source"), kind("q1", "query"), kind("q2", "query"), kind("c1", "column"), kind("c2", "column")], [("s", "q1"), ("q1", "q2"), ("q1", "c1"), ("q2", "c2")])
    assert graph.source_schema(g) == {"s": {"q1": {"view": None, "columns": ["c1"], "names_reliable": True, "renamed_columns": {}}}}


def test_detect():
    assert detect.sources('Sql.Database("s", "d") Web.Contents("http://a") "http://a"') == [("http", "http://a"), ("sql", "s/d")]
    assert detect.sources('OData.Feed("http://b")') == [("odata", "http://b"), ("http", "http://b")]


def test_infer_flags_dynamic_renames():
    from weftline.m import parse

    steps = parse('let s = Csv.Document("u"), t = Table.TransformColumnTypes(s, {{"a", type text}}), r = Table.RenameColumns(t, names) in r').steps
    got = infer.infer(list(steps))
    assert got.columns == ["a"] and got.dynamic_rename


def test_layout_file_and_roles(tmp_path):
    path = tmp_path / "r.pbix"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("Report/Layout", json.dumps(LAYOUT).encode("utf-16-le"))
    v = layout.visuals(layout.read_layout(str(path)))[0]
    assert v.chart == "bar" and v.roles == {"Category": [("Sales", "Amount", "Column")], "Y": [("Sales", "Total", "Measure")]}


def test_codegen_runs(spark, model):
    text, stats = codegen.script(model)
    assert stats.unreadable == ["Bad"] and stats.unsupported_measures == ["Twice"] and stats.visuals == 1
    scope = {"__name__": "generated"}
    exec(compile(text, "generated", "exec"), scope)
    assert set(scope["QUERIES"]) == {"Root", "Sales", "Infer"}
    order = codegen.query_order(model)
    assert order.index("Root") < order.index("Sales")


def test_service_exports_and_cli(spark, model, tmp_path, capsys):
    loads = []
    service = LineageService(spark, lambda path: loads.append(path) or model)
    assert service.summary("m")["query"] == 4
    assert service.search("m", "twice") == ["measure::Sales::Twice"]
    assert len(loads) == 1 and service.graphs() == ["m"]
    for kind, name in (("graphml", "g.xml"), ("json", "g.json"), ("markdown", "g.md"), ("nodes_csv", "n"), ("edges_csv", "e")):
        service.export("m", kind, str(tmp_path / name))
    assert json.loads((tmp_path / "g.json").read_text())["directed"]
    assert cli.main(["upstream", "m", "measure::Sales::Total"], service) == 0
    assert "column::Sales::Amount" in capsys.readouterr().out
    assert service.invalidate() == 1 and service.graphs() == []


def test_stream(spark, tmp_path):
    from weftline.plans.values import MError
    from weftline.streaming import compile_stream

    spark.range(20).selectExpr("id", "id % 3 AS k").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, k long").parquet(f"{tmp_path}/in")
    df = compile_stream(spark, 'Table.AddColumn(Table.SelectRows(s, each [k] = 1), "d", each [id] * 2)', {"s": stream})
    q = df.writeStream.format("memory").queryName("weft_out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("weft_out").count() == 7
    with pytest.raises(MError, match="Table.Sort"):
        compile_stream(spark, 'Table.Sort(s, {{"id", Order.Ascending}})', {"s": stream})
