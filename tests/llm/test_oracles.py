"""The SQL of op2 and op6 against the operators on small, awkward tables."""

import duckdb
import pyarrow as pa
import pytest

from test_corpus import DOCUMENTS, prose
from weftline.llm import decontaminate, oracles, substring

DOC = "doc_id long, text string, lang string, source string, item_id string"


def asked(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        first = "doc_id" if name == "documents" else "item_id"
        con.register(name, pa.table({first: pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    found = con.sql(sql)
    return sorted((dict(zip(found.columns, r)) for r in found.fetchall()), key=str)


def collected(df, columns):
    return sorted((r.asDict() for r in df.select(*columns).collect()), key=str)


def test_substring_sql(spark):
    want = asked(oracles.SUBSTRING, documents=DOCUMENTS)
    got = substring.remove_repeats(spark.createDataFrame(DOCUMENTS, DOC), texts=False)
    assert sorted(collected(got, want[0]), key=str) == want
    assert sum(r["n_removed"] for r in want) > 0


@pytest.mark.parametrize("size", [3, 12, 60])
def test_decontamination_sql(spark, size):
    items = [(1, prose(size)), (2, prose(size)), (2, prose(size)), (3, None), (4, ""), (None, prose(size))]
    first, second = items[0][1].split(), items[1][1].split()
    changed = [*first[: size // 2], "changed", *first[size // 2 + 1 :]]
    leaks = [first, [*prose(9).split(), *first, *prose(9).split()], [*second, *second], changed, first[: size - 1]]
    rows = [*DOCUMENTS, *((100 + i, " ".join(w), "en", "s", "x") for i, w in enumerate(leaks)), (None, items[0][1], None, None, None)]
    want = asked(oracles.DECONTAMINATION, documents=rows, benchmark=items)
    got = decontaminate.contaminated(spark.createDataFrame(rows, DOC), spark.createDataFrame(items, "item_id long, text string"))
    assert collected(got, want[0]) == want
    assert {r["doc_id"] for r in want} >= {None, 100, 101, 102}
