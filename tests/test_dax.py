import pytest

from weftline.functions.dax import Measures, MeasureNotSupported, reference_rows, references


def test_references(spark):
    text = "SUM(Sales[Amount]) / [Total] + MAX('My T'[a b])"
    want = [("Sales", "Amount"), (None, "Total"), ("My T", "a b")]
    assert references(text) == want
    got = reference_rows(spark.createDataFrame([(text,), ("none",)], "e string"), "e").collect()
    assert [(r.ref_table, r.ref_name) for r in got] == want


def test_measures(spark):
    t = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, "b")], "x double, k string")
    m = Measures({("T", "S"): "SUM(T[x])", ("T", "N"): "COUNTROWS(T)", ("T", "D"): "DIVIDE([S], [Z], 9)", ("T", "Z"): "0", ("T", "K"): "DISTINCTCOUNT(T[k])", ("T", "Q"): "CALCULATE(SUM(T[x]))"}, {"T": t})
    assert {x.name: x.supported for x in m.describe()} == {"S": True, "N": True, "D": True, "Z": True, "K": True, "Q": False}
    assert m.frame([("T", "S"), ("T", "N"), ("T", "D"), ("T", "K")]).first().asDict() == {"S": 4.0, "N": 3, "D": 9.0, "K": 2}
    with pytest.raises(MeasureNotSupported):
        m.translate("CALCULATE(1)")


def test_measures_in_a_circle_are_refused():
    with pytest.raises(MeasureNotSupported, match="circle"):
        Measures({("T", "A"): "[B]", ("T", "B"): "[A]"}).translate("[A]")
