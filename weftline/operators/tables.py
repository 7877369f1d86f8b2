"""Table functions: each one DataFrame operation, with M's order and null rules where they can be seen."""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cast
from ..m import nodes as N
from ..plans.compiler import truth
from ..plans.values import Function, Group, GroupValues, Marker, MError, Nested, Row, Table, column, is_column, quoted


def names(v: Any) -> list[str]:
    return [v] if isinstance(v, str) else list(v)


def pairs(v: Any) -> list[list[Any]]:
    """One pair, or a list of pairs."""
    v = list(v)
    return [v] if v and not isinstance(v[0], (list, tuple)) else [list(x) for x in v]


def row_of(t: Table) -> Row:
    return Row(tuple(t.df.columns))


# -- projection --
def select_columns(t: Table, cols: Any, *_: Any) -> Table:
    missing = [c for c in names(cols) if c not in t.df.columns]
    if missing:
        raise MError(f"no column {missing[0]!r}; there are {', '.join(t.df.columns)}")
    return Table(t.df.select(*map(quoted, names(cols)))).nesting(t)


def remove_columns(t: Table, cols: Any, *_: Any) -> Table:
    gone = set(names(cols))
    return Table(t.df.select(*[quoted(c) for c in t.df.columns if c not in gone])).nesting(t)


def rename_columns(t: Table, renames: Any, *_: Any) -> Table:
    new = dict(pairs(renames))
    return Table(t.df.select(*[quoted(c).alias(new.get(c, c)) for c in t.df.columns]))


def reorder_columns(t: Table, cols: Any, *_: Any) -> Table:
    first = [c for c in names(cols) if c in t.df.columns]
    return t.with_df(t.df.select(*map(quoted, [*first, *[c for c in t.df.columns if c not in first]]))).nesting(t)


def add_column(t: Table, name: str, fn: Function, *_: Any) -> Table:
    return t.with_df(t.df.withColumn(name, column(fn(row_of(t))))).nesting(t, (name,))


def transform_columns(t: Table, changes: Any, *_: Any) -> Table:
    out = {}
    for name, fn, *kind in pairs(changes):
        if name in t.df.columns:
            c = column(fn(quoted(name)))
            out[name] = cast(c, kind[0], strict_int=False) if kind else c
    return t.with_df(t.df.withColumns(out)) if out else t


def transform_types(t: Table, types: Any, *_: Any) -> Table:
    out = {name: cast(quoted(name), kind) for name, kind in pairs(types) if name in t.df.columns}
    return t.with_df(t.df.withColumns(out)) if out else t


def _replaced(t: Table, new: dict[str, Column], gone: list[str]) -> Table:
    """t without some columns, and with new ones last."""
    kept = [quoted(c) for c in t.df.columns if c not in gone and c not in new]
    return Table(t.df.select(*kept, *[c.alias(n) for n, c in new.items()]))


def split_column(t: Table, name: str, splitter: Function, into: Any, *_: Any) -> Table:
    out = [f"{name}.{i + 1}" for i in range(into)] if isinstance(into, int) else names(into)
    parts = column(splitter(quoted(name)))
    return _replaced(t, {n: F.get(parts, F.lit(i)) for i, n in enumerate(out)}, [name])


def combine_columns(t: Table, cols: Any, combiner: Function, name: str) -> Table:
    return _replaced(t, {name: column(combiner([quoted(c) for c in names(cols)]))}, names(cols))


def replace_value(t: Table, old: Any, new: Any, replacer: Function, cols: Any) -> Table:
    """Columns one after the other, so that later predicates see what earlier ones replaced."""
    df = t.df
    for name in names(cols):
        row = Row(tuple(df.columns))
        value = new(row) if isinstance(new, Function) else new
        if isinstance(old, Function):
            hit = old(row)
            c = F.when(column(truth(hit)), column(value)).otherwise(quoted(name))
        else:
            c = column(replacer(quoted(name), old, value))
        df = df.withColumn(name, c)
    return t.with_df(df)


def replace_errors(t: Table, values: Any, *_: Any) -> Table:
    out = {name: F.coalesce(quoted(name), column(v)) for name, v in pairs(values) if name in t.df.columns}
    return t.with_df(t.df.withColumns(out)) if out else t


def expand_record(t: Table, name: str, fields: Any, new: Any = None) -> Table:
    out = {}
    kind = t.df.schema[name].dataType
    for f, n in zip(names(fields), names(new if new is not None else fields)):
        if kind.typeName() == "struct":
            out[n] = quoted(name).getField(f) if f in kind.names else F.lit(None).cast("string")
        elif kind.typeName() == "map":
            out[n] = F.try_element_at(quoted(name), F.lit(f))
        else:
            out[n] = F.lit(None).cast("string")
    return _replaced(t, out, [name])


# -- filter, order, distinct, union --
def select_rows(t: Any, pred: Function) -> Any:
    if isinstance(t, Group):
        cond = column(truth(pred(Row(t.columns))))
        return Group(t.columns, t.order, cond if t.where is None else t.where & cond)
    return t.with_df(t.df.where(column(truth(pred(row_of(t)))))).nesting(t)


def sort(t: Table, keys: Any, *_: Any) -> Table:
    """By each key, nulls last both ways. The table remembers its order for what depends on it."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if len(keys) == 2 and isinstance(keys[0], str) and (isinstance(keys[1], Marker) or isinstance(keys[1], int)):
        keys = [keys]
    by = []
    for k in keys:
        name, way = (k, "asc") if isinstance(k, str) else (k[0], k[1] if len(k) > 1 else "asc")
        down = getattr(way, "value", way) in ("desc", 1)
        by.append(quoted(name).desc_nulls_last() if down else quoted(name).asc_nulls_last())
    return Table(t.df.orderBy(*by), tuple(by)).nesting(t)


def distinct(t: Table, keys: Any = None, *_: Any) -> Table:
    """Without keys, distinct rows; with keys, the first row of each, by the table's order."""
    if keys is None or set(names(keys)) == set(t.df.columns):
        return Table(t.df.distinct())
    df, order = t.ranked()
    w = Window.partitionBy(*map(quoted, names(keys))).orderBy(*order)
    return t.with_df(df.withColumn("__first", F.row_number().over(w)).where("__first = 1").drop("__first", "__ord"))


def combine(tables: Any) -> Table | None:
    if not tables:
        raise MError("Table.Combine of no tables has no columns")
    return Table(functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.df for t in tables]))


# -- joins --
def _how(kind: Any) -> str:
    return kind.value if isinstance(kind, Marker) else {None: "left", 0: "inner", 1: "left", 2: "right", 3: "full", 4: "left_anti", 5: "right_anti"}.get(kind, "left")


def flat_join(left: DataFrame, lkeys: list[str], right: DataFrame, rkeys: list[str], how: str, keep: list[tuple[str, str]], prefix: str = "") -> DataFrame:
    """left ⋈ right on equal keys (null equals nothing); of the right side, columns ``keep`` under new names."""
    if how in ("right_anti", "right_semi"):
        return flat_join(right, rkeys, left, lkeys, how.replace("right", "left"), [])
    l = left.select(*[quoted(c).alias(f"l{i}") for i, c in enumerate(left.columns)])
    r = right.select(*[quoted(c).alias(f"r{i}") for i, c in enumerate(right.columns)])
    on = [F.col(f"l{left.columns.index(a)}") == F.col(f"r{right.columns.index(b)}") for a, b in zip(lkeys, rkeys)]
    joined = l.join(r, on, how)
    out = [F.col(f"l{i}").alias(c) for i, c in enumerate(left.columns)]
    if how not in ("left_anti", "left_semi"):
        out += [F.col(f"r{right.columns.index(c)}").alias(n) for c, n in keep]
    return joined.select(*out)


def nested_join(t1: Table, keys1: Any, t2: Table, keys2: Any, name: str, kind: Any = None, *_: Any) -> Table:
    """Each left row with the array of its right rows. Inner and anti kinds keep or drop rows; right and full add rows."""
    lk, rk, how = names(keys1), names(keys2), _how(kind)
    right = t2.df
    grouped = right.where(functools.reduce(lambda a, b: a & b, [quoted(k).isNotNull() for k in rk])).groupBy(*[quoted(k).alias(f"__k{i}") for i, k in enumerate(rk)]).agg(F.collect_list(F.struct(*map(quoted, right.columns))).alias("__rows"))
    on = [quoted(a) == F.col(f"__k{i}") for i, a in enumerate(lk)]
    kinds = {"left_semi": "left_semi", "left_anti": "left_anti", "inner": "inner", "right": "right", "full": "full", "right_anti": "right_anti"}
    how = kinds.get(how, "left")
    if how == "right_anti":
        gone = grouped.join(t1.df.select(*[quoted(a).alias(f"__l{i}") for i, a in enumerate(lk)]), [F.col(f"__k{i}") == F.col(f"__l{i}") for i in range(len(lk))], "left_anti")
        return Table(gone.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in t1.df.schema], F.col("__rows").alias(name)))
    if how in ("left_semi", "left_anti"):
        joined = t1.df.join(grouped.drop("__rows"), on, how)
        return Table(joined.select(*map(quoted, t1.df.columns), F.array().cast(grouped.schema["__rows"].dataType).alias(name)))
    joined = t1.df.join(grouped, on, how)
    rows = F.coalesce(F.col("__rows"), F.array().cast(grouped.schema["__rows"].dataType))
    return Table(joined.select(*map(quoted, t1.df.columns), rows.alias(name)))


def join(t1: Table, keys1: Any, t2: Table, keys2: Any, kind: Any = None, *_: Any) -> Table:
    """A flat join. Right columns whose name is taken by the left are left out, as equal keys mostly are."""
    if isinstance(kind, str):  # a column name: the nested form
        return nested_join(t1, keys1, t2, keys2, kind, *_)
    how = "inner" if kind is None else _how(kind)
    keep = [(c, c) for c in t2.df.columns if c not in t1.df.columns]
    return Table(flat_join(t1.df, names(keys1), t2.df, names(keys2), how, keep))


def expand_table(t: Table, name: str, cols: Any, new: Any = None) -> Table:
    """One row for each nested row; of an empty nested table, one row of nulls."""
    out = names(new if new is not None else cols)
    if name in t.nested:
        return expand_group(t, name, names(cols), out)
    rows = t.df.withColumn("__row", F.explode_outer(quoted(name)))
    have = t.df.schema[name].dataType.elementType.names
    picked = [(F.col("__row").getField(c) if c in have else F.lit(None).cast("string")).alias(n) for c, n in zip(names(cols), out)]
    return Table(rows.select(*[quoted(c) for c in t.df.columns if c != name], *picked))


def expand_group(t: Table, name: str, cols: list[str], out: list[str]) -> Table:
    """The same of a group's sub-tables: rows are joined to their group by its keys, so that no group is held as a whole.

    The rows come in no order; that of the groups is remembered for what depends on it.
    """
    nested, left = t.nested[name], [c for c in t.df.columns if c != name]
    have = nested.rows.columns
    groups = t.df.select(*[quoted(c).alias(f"l{i}") for i, c in enumerate(left)])
    picked = [(quoted(c) if c in have else F.lit(None).cast("string")).alias(f"r{i}") for i, c in enumerate(cols)]
    rows = nested.rows.select(*[quoted(k).alias(f"k{i}") for i, k in enumerate(nested.keys)], *picked)
    if nested.keys:
        on = [F.col(f"l{left.index(k)}").eqNullSafe(F.col(f"k{i}")) for i, k in enumerate(nested.keys)]
        full = groups.join(rows, on)
        bare = groups.join(rows.select(*[f"k{i}" for i in range(len(nested.keys))]).distinct(), on, "left_anti")
    else:
        full, bare = groups.crossJoin(rows), groups.join(rows.limit(1), F.lit(True), "left_anti")
    nulls = [F.lit(None).cast(rows.schema[f"r{i}"].dataType).alias(f"r{i}") for i in range(len(cols))]
    df = full.select(*groups.columns, *[f"r{i}" for i in range(len(cols))]).unionAll(bare.select(*groups.columns, *nulls)) if nested.gaps else full
    df = df.select(*[F.col(f"l{i}").alias(c) for i, c in enumerate(left)], *[F.col(f"r{i}").alias(n) for i, n in enumerate(out)])
    if len(set(df.columns)) < len(df.columns):
        return Table(df)
    return Table(df, t.order).nesting(t)


# -- groups, pivots --
def group(t: Table, keys: Any, aggregates: Any, *_: Any) -> Table:
    """One row a group, null keys included, ordered by the keys with nulls last."""
    keys = names(keys)
    specs = pairs(aggregates)
    # the rows' order costs a row id, which is made only where some aggregate depends on it
    plain, ordered = Group(tuple(t.df.columns)), Group(tuple(t.df.columns), (F.col("__ord"),))
    columns, needs, nested = [], False, {}
    for name, fn, *kind in specs:
        got = fn(plain)
        c, by_order = _aggregate(got), _aggregate(fn(ordered))
        if str(c) != str(by_order):
            c, needs = by_order, True
        as_kind = cast(c, kind[0], strict_int=False) if kind else c
        if isinstance(got, Group) and as_kind is c and name not in keys:
            nested[name] = got
        columns.append(as_kind.alias(name))
    nested = _nested(t.df, keys, nested)
    base = t.ranked()[0] if needs else t.df
    out = base.groupBy(*map(quoted, keys)).agg(*columns) if keys else base.agg(*columns)
    by = tuple(quoted(k).asc_nulls_last() for k in keys)
    return Table(out.orderBy(*by) if keys else out, by, nested)


def _nested(df: DataFrame, keys: list[str], groups: dict[str, Group]) -> dict[str, Nested]:
    """What columns of sub-tables stand for. Rows that another reading might find otherwise are left to the arrays."""
    if not groups or df.isStreaming or not df._jdf.queryExecution().analyzed().deterministic():
        return {}
    return {n: Nested(df if g.where is None else df.where(g.where), tuple(keys), gaps=g.where is not None or not keys) for n, g in groups.items()}


def _aggregate(got: Any) -> Column:
    if isinstance(got, Group):
        return got.rows()
    if isinstance(got, GroupValues):
        return got.array()
    return column(got)


def pivot(t: Table, *args: Any) -> Table:
    """Columns from the values of one column; the first non-null value of another fills them.

    Both (table, attribute, value) and M's (table, values, attribute, value) are read. Rows with a null key go.
    """
    values = names(args[0]) if isinstance(args[0], list) else None
    attr, val = (args[1], args[2]) if values is not None else (args[0], args[1])
    keys = [c for c in t.df.columns if c not in (attr, val)]
    df, order = t.ranked()
    for k in keys:
        df = df.where(quoted(k).isNotNull())
    if values is None:  # the schema depends on the data: one job for the distinct attributes
        values = sorted(r[0] for r in t.df.where(quoted(attr).isNotNull()).select(quoted(attr)).distinct().collect())
    rank = F.when(quoted(val).isNotNull(), F.col("__ord"))
    out = df.groupBy(*map(quoted, keys)).agg(*[F.min_by(F.when(quoted(attr) == F.lit(v), quoted(val)), F.when(quoted(attr) == F.lit(v), rank)).alias(str(v)) for v in values])
    return Table(out.orderBy(*[quoted(k).asc_nulls_last() for k in keys]) if keys else out)


# -- constructors and materialisers --
def tables(compiler) -> dict[str, Callable[..., Any]]:
    spark = compiler.spark

    def frame(rows: list, cols: list[str]) -> Table:
        if any(is_column(v) for r in rows for v in r):
            parts = [spark.range(1).select(*[column(v).alias(c) for c, v in zip(cols, r)]) for r in rows]
            return Table(functools.reduce(DataFrame.unionByName, parts))
        if not rows:
            return Table(spark.createDataFrame([], ", ".join(f"`{c}` string" for c in cols) or "Column1 string"))
        fixed = [tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) and any(isinstance(r[i], float) for r in rows) else v for i, v in enumerate(r)) for r in rows]
        empty = [all(r[i] is None for r in rows) for i in range(len(cols))]
        if any(empty):
            fixed = [tuple(None if e else v for v, e in zip(r, empty)) for r in fixed]
            full = [i for i, e in enumerate(empty) if not e]
            df = spark.createDataFrame([tuple(r[i] for i in full) or (0,) for r in fixed], [f"c{i}" for i in full] or ["none"])
            return Table(df.select(*[(F.lit(None).cast("string") if e else F.col(f"c{i}")).alias(cols[i]) for i, e in enumerate(empty)]))
        df = spark.createDataFrame(fixed, [f"c{i}" for i in range(len(cols))])
        return Table(df.toDF(*cols))

    def from_records(records: list[dict], *_: Any) -> Table:
        cols = list(dict.fromkeys(k for r in records for k in r))
        return frame([[r.get(c) for c in cols] for r in records], cols)

    def from_rows(rows: list, cols: Any = None) -> Table:
        width = max(map(len, rows), default=0)
        return frame(rows, names(cols) if cols else [f"Column{i + 1}" for i in range(width)])

    def literal_table(cols: Any, rows: list) -> Table:
        return frame(rows, [f"Column{i + 1}" for i in range(cols)] if isinstance(cols, int) else names(cols))

    def promote_headers(t: Table, *_: Any) -> Table:
        """Row 0 names the columns; its text is needed to know the schema, so one row is read."""
        df, order = t.ranked()
        head = df.orderBy(*order).limit(1).collect()
        if not head:
            return t
        rest = df.where(F.col("__ord") != head[0]["__ord"]).drop("__ord")
        return t.with_df(rest.toDF(*[str(head[0][c]) for c in t.df.columns]))

    def to_rows(t: Table) -> list:
        df, order = t.ranked()
        return [list(r) for r in df.orderBy(*order).drop("__ord").collect()]

    def fused_expand(node: N.Invoke, scope: Any) -> Table | None:
        """Table.ExpandTableColumn right over Table.NestedJoin of that column: one flat join, without nested arrays."""
        inner = node.args[0]
        if not (isinstance(inner, N.Invoke) and isinstance(inner.func, N.Ident) and inner.func.name == "Table.NestedJoin" and len(inner.args) >= 5):
            return None
        name, cols, *new = [compiler.value(a, scope) for a in node.args[1:]]
        t1, k1, t2, k2, nested, *kind = [compiler.value(a, scope) for a in inner.args]
        how = _how(kind[0] if kind else None)
        if nested != name or how in ("right_anti", "left_anti", "left_semi") or nested in t1.df.columns or any(c not in t2.df.columns for c in names(cols)):
            return None
        keep = list(zip(names(cols), names(new[0] if new and new[0] is not None else cols)))
        return Table(flat_join(t1.df, names(k1), t2.df, names(k2), how, keep))

    return {
        "Table.FromRecords": from_records, "Table.FromList": lambda xs, *_: frame([[x] for x in xs], ["Column1"]) if isinstance(xs, list) else Table(compiler.as_frame(xs)),
        "Table.FromRows": from_rows, "#table": literal_table, "Table.PromoteHeaders": promote_headers,
        "Table.SelectColumns": select_columns, "Table.RemoveColumns": remove_columns, "Table.RenameColumns": rename_columns,
        "Table.ReorderColumns": reorder_columns, "Table.ColumnNames": lambda t: list(t.df.columns), "Table.AddColumn": add_column,
        "Table.TransformColumns": transform_columns, "Table.TransformColumnTypes": transform_types, "Table.SplitColumn": split_column,
        "Table.CombineColumns": combine_columns, "Table.ReplaceValue": replace_value, "Table.ReplaceErrorValues": replace_errors,
        "Table.ExpandRecordColumn": expand_record, "Table.SelectRows": select_rows, "Table.Sort": sort, "Table.Distinct": distinct,
        "Table.Combine": combine, "Table.NestedJoin": nested_join, "Table.Join": join, "Table.ExpandTableColumn": expand_table,
        "Table.Group": group, "Table.Pivot": pivot, "Table.ToRows": to_rows, "__fused_expand__": fused_expand,
    }
