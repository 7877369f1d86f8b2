"""List functions: over driver lists, array columns, a table's column, and a group's values.

A list that stands for a group's values becomes an aggregate; one that stands
for a whole column of another table becomes a scalar subquery of it.
"""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.compiler import truth
from ..plans.values import Function, Group, GroupValues, MError, Table, TableColumn, column, is_column, is_constant


def _aggregate(xs: TableColumn, agg) -> Column:
    """agg over a table's column, as a scalar."""
    return xs.table.df.agg(agg(xs.col).alias("v")).scalar()


def _values(xs: Any) -> Any:
    """A driver list or an array column."""
    if isinstance(xs, (list, tuple)):
        return list(xs)
    if isinstance(xs, TableColumn):
        df, keys = xs.table.ranked()
        rows = df.agg(F.array_sort(F.collect_list(F.struct(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("k"), F.struct(xs.col.alias("v")).alias("x")))).alias("a"))
        return F.transform(rows.scalar(), lambda r: r["x"]["v"])
    return column(xs)


def select(xs: Any, pred: Function) -> Any:
    if isinstance(xs, Table):
        raise MError("List.Select needs a list; use Table.SelectRows for a table")
    v = _values(xs)
    if isinstance(v, list):
        kept = [(x, truth(pred(x))) for x in v]
        if any(is_column(k) for _, k in kept):
            return F.filter(column(v), lambda x: column(truth(pred(x))))
        return [x for x, k in kept if k]
    return F.filter(v, lambda x: column(truth(pred(x))))


def transform(xs: Any, fn: Function) -> Any:
    v = _values(xs)
    return [fn(x) for x in v] if isinstance(v, list) else F.transform(v, lambda x: column(fn(x)))


def any_true(xs: Any) -> Any:
    if isinstance(xs, GroupValues):
        return F.coalesce(F.bool_or(xs.group.kept(xs.col.cast("boolean"))), F.lit(False))
    if isinstance(xs, TableColumn):
        return _aggregate(xs, lambda c: F.coalesce(F.bool_or(c.cast("boolean")), F.lit(False)))
    v = _values(xs)
    if isinstance(v, list) and is_constant(v):
        return any(map(bool, v))
    return F.exists(column(v), lambda x: F.coalesce(x.cast("boolean"), F.lit(False)))


def remove_nulls(xs: Any) -> Any:
    if isinstance(xs, GroupValues):
        return GroupValues(xs.col, xs.group, xs.distinct, True)
    if isinstance(xs, TableColumn):
        return TableColumn(xs.table.with_df(xs.table.df.where(xs.col.isNotNull())), xs.name)
    v = _values(xs)
    return [x for x in v if x is not None] if isinstance(v, list) and is_constant(v) else F.array_compact(column(v))


def dates(start: Any, n: Any, step: Any = dt.timedelta(days=1)) -> Any:
    if is_constant([start, n, step]):
        return [start + i * step for i in range(int(n))]
    s, step = column(start).cast("timestamp_ntz"), column(step)
    return F.transform(F.sequence(F.lit(0), column(n).cast("int") - 1), lambda i: (s + step * i).cast("timestamp_ntz"))


def distinct(xs: Any) -> Any:
    if isinstance(xs, GroupValues):
        return GroupValues(xs.col, xs.group, True, xs.no_nulls)
    if isinstance(xs, TableColumn):
        return TableColumn(Table(xs.table.df.select(xs.col).distinct()), xs.name)
    v = _values(xs)
    if isinstance(v, list) and is_constant(v):
        return [x for i, x in enumerate(v) if not any(type(x) is type(y) and x == y for y in v[:i])]
    return F.array_distinct(column(v))


def count(xs: Any) -> Any:
    if isinstance(xs, Group):
        return F.count(xs.kept(F.lit(1)))
    if isinstance(xs, GroupValues):
        if xs.distinct:
            n = F.count_distinct(xs.group.kept(xs.col))
            return n if xs.no_nulls else n + F.max(xs.group.kept(xs.col.isNull().cast("int"))).cast("bigint")
        return F.count(xs.group.kept(xs.col if xs.no_nulls else F.lit(1)))
    if isinstance(xs, TableColumn):
        return _aggregate(xs, lambda c: F.count(F.lit(1)))
    if isinstance(xs, Table):
        return xs.df.agg(F.count(F.lit(1))).scalar()
    v = _values(xs)
    return len(v) if isinstance(v, list) else F.coalesce(F.size(v), F.lit(0))


def total(xs: Any) -> Any:
    """The sum without nulls; of nothing, 0."""
    if isinstance(xs, GroupValues):
        c = xs.group.kept(xs.col)
        return F.coalesce(F.sum_distinct(c) if xs.distinct else F.sum(c), F.lit(0))
    if isinstance(xs, TableColumn):
        return _aggregate(xs, lambda c: F.coalesce(F.sum(c), F.lit(0)))
    v = _values(xs)
    if isinstance(v, list) and is_constant(v):
        return sum(x for x in v if x is not None)
    return F.aggregate(F.transform(column(v), lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def largest(xs: Any, *_: Any) -> Any:
    if isinstance(xs, GroupValues):
        return F.max(xs.group.kept(xs.col))
    if isinstance(xs, TableColumn):
        return _aggregate(xs, F.max)
    v = _values(xs)
    if isinstance(v, list) and is_constant(v):
        return max((x for x in v if x is not None), default=None)
    return F.array_max(column(v))


def first(xs: Any, default: Any = None) -> Any:
    if isinstance(xs, GroupValues):
        by = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(xs.group.order)]) if xs.group.order else None
        value = F.struct(xs.col.alias("v"))
        got = (F.min_by(value, xs.group.kept(by)) if by is not None else F.first(xs.group.kept(value), ignorenulls=True)).getField("v")
        return got if default is None else F.coalesce(got, column(default))
    if isinstance(xs, TableColumn):
        df, keys = xs.table.ranked()
        got = df.orderBy(*keys).limit(1).select(xs.col).scalar()
        return got if default is None else F.coalesce(got, column(default))
    v = _values(xs)
    if isinstance(v, list):
        return v[0] if v else default
    return F.when(F.size(v) > 0, F.get(v, F.lit(0))).otherwise(column(default))


def contains(xs: Any, value: Any, *_: Any) -> Any:
    if isinstance(xs, GroupValues):
        return F.coalesce(F.bool_or(xs.group.kept(xs.col.eqNullSafe(column(value)))), F.lit(False))
    if isinstance(xs, TableColumn):
        return _aggregate(xs, lambda c: F.coalesce(F.bool_or(c.eqNullSafe(column(value))), F.lit(False)))
    v = _values(xs)
    if isinstance(v, list) and is_constant([v, value]):
        return value in v
    return F.exists(column(v), lambda x: x.eqNullSafe(column(value)))


def is_empty(xs: Any) -> Any:
    if isinstance(xs, Table):
        return xs.df.isEmpty()
    n = count(xs)
    return n == 0


def accumulate(xs: Any, seed: Any, fn: Function) -> Any:
    v = xs.array() if isinstance(xs, GroupValues) else _values(xs)
    if isinstance(v, list):
        for x in v:
            seed = fn(seed, x)
        return seed
    start = F.lit(float(seed)) if isinstance(seed, (int, float)) and not isinstance(seed, bool) else column(seed)
    cast = "double" if isinstance(seed, (int, float)) and not isinstance(seed, bool) else None
    return F.aggregate(v, start, lambda s, x: column(fn(s, x)).cast(cast) if cast else column(fn(s, x)))


def lists(compiler) -> dict[str, Any]:
    return {
        "List.Select": select, "List.Transform": transform, "List.AnyTrue": any_true, "List.RemoveNulls": remove_nulls, "List.Dates": dates,
        "List.Distinct": distinct, "List.Count": count, "List.Sum": total, "List.Accumulate": accumulate, "List.Contains": contains,
        "List.First": first, "List.IsEmpty": is_empty, "List.Max": largest,
    }

