"""What M expressions stand for while a program is compiled."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class MError(Exception):
    """An M program that cannot be compiled, or an error that it raises itself."""


@dataclass(frozen=True)
class Nested:
    """What a column of sub-tables that Table.Group made stands for: those of rows with the group's keys; with gaps, some groups may have none."""

    rows: DataFrame
    keys: tuple[str, ...]
    gaps: bool


@dataclass(frozen=True)
class Table:
    """A table: a lazy DataFrame, the keys that order it where its order is known, and what its columns of sub-tables stand for."""

    df: DataFrame
    order: tuple[Column, ...] = ()
    nested: dict[str, Nested] = field(default_factory=dict, compare=False)

    def with_df(self, df: DataFrame) -> Table:
        return Table(df, self.order)

    def nesting(self, other: Table, changed: tuple[str, ...] = ()) -> Table:
        """This table, made of other's rows, with those sub-tables of other whose column and keys are as they were."""
        have = set(self.df.columns) - set(changed)
        return Table(self.df, self.order, {n: x for n, x in other.nested.items() if have.issuperset((n, *x.keys))})

    def ranked(self) -> tuple[DataFrame, list[Column]]:
        """(df, keys of a total order): the known order, then the order of the scan."""
        return self.df.withColumn("__ord", F.monotonically_increasing_id()), [*self.order, F.col("__ord")]


@dataclass(frozen=True)
class TableColumn:
    """T[c]: the list of one column's values."""

    table: Table
    name: str

    @property
    def col(self) -> Column:
        return quoted(self.name)


@dataclass(frozen=True)
class Row:
    """The row that ``each`` is about: the columns of the current DataFrame."""

    columns: tuple[str, ...]

    def get(self, name: str) -> Column:
        if name not in self.columns:
            raise MError(f"no column {name!r}; there are {', '.join(self.columns)}")
        return quoted(name)

    def whole(self) -> Column:
        return F.struct(*[quoted(c) for c in self.columns])


@dataclass(frozen=True)
class Group:
    """The sub-table that a Table.Group function is about; ``where`` keeps some of its rows."""

    columns: tuple[str, ...]
    order: tuple[Column, ...] = ()
    where: Column | None = None

    def values(self, name: str) -> GroupValues:
        if name not in self.columns:
            raise MError(f"no column {name!r}; there are {', '.join(self.columns)}")
        return GroupValues(quoted(name), self)

    def kept(self, col: Column) -> Column:
        return col if self.where is None else F.when(self.where, col)

    def rows(self) -> Column:
        return F.collect_list(self.kept(F.struct(*[quoted(c) for c in self.columns])))


@dataclass(frozen=True)
class GroupValues:
    """The list of one column's values in a group, possibly without repeats or nulls."""

    col: Column
    group: Group
    distinct: bool = False
    no_nulls: bool = False

    def array(self) -> Column:
        """The values as an array, in the group's order, nulls kept."""
        by = F.struct(*[F.struct(o).alias(f"o{i}") for i, o in enumerate(self.group.order)], F.struct(self.col.alias("v")).alias("x"))
        rows = F.collect_list(self.group.kept(by))
        out = F.transform(F.array_sort(rows) if self.group.order else rows, lambda r: r["x"]["v"])
        out = F.filter(out, lambda v: v.isNotNull()) if self.no_nulls else out
        return F.array_distinct(out) if self.distinct else out


@dataclass(frozen=True)
class Function:
    """A callable value: a lambda with its scope, or an entry of the library."""

    call: Callable[..., Any]
    name: str = ""

    def __call__(self, *args: Any) -> Any:
        return self.call(*args)


@dataclass(frozen=True)
class Marker:
    """A named constant of the library: a type, an order, a join kind, an option."""

    kind: str
    value: Any


@dataclass(frozen=True)
class Handle:
    """A source that has not been read: its kind and what locates it."""

    kind: str
    location: dict[str, Any] = field(default_factory=dict)
    select: Callable[[dict[str, Any]], Any] | None = None


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def is_column(v: Any) -> bool:
    return isinstance(v, Column)


def is_constant(v: Any) -> bool:
    if isinstance(v, (list, tuple)):
        return all(map(is_constant, v))
    if isinstance(v, dict):
        return all(map(is_constant, v.values()))
    return not isinstance(v, (Column, Table, TableColumn, Row, Group, GroupValues, Function, Marker, Handle))


def column(v: Any) -> Column:
    """A value as a Column."""
    if is_column(v):
        return v
    if isinstance(v, Row):
        return v.whole()
    if isinstance(v, GroupValues):
        return v.array()
    if isinstance(v, Group):
        return v.rows()
    if isinstance(v, TableColumn):
        return v.table.df.agg(F.collect_list(v.col)).scalar()
    if isinstance(v, (list, tuple)):
        return F.array(*map(column, v))
    if isinstance(v, dict):
        return F.struct(*[column(x).alias(k) for k, x in v.items()])
    if isinstance(v, (Table, Function, Marker, Handle)):
        raise MError(f"a {type(v).__name__.lower()} cannot stand in a row")
    return F.lit(v)
