"""Text, Number, Date, Duration, Record, Value and binary functions as Column expressions."""

from __future__ import annotations

import base64
import datetime as dt
import json
import zlib
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.compiler import text
from ..plans.values import Function, Marker, MError, Row, column, is_column, is_constant, quoted
from .constants import spark_type


def strings(v: Any) -> Column:
    return column(v).cast("string")


def literal(s: str) -> Column:
    """A regular expression that matches s itself."""
    return F.lit("\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E")


def null_false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def proper(s: Any) -> Column:
    """Each run of letters begins with a capital and goes on in lower case."""
    runs = F.regexp_extract_all(strings(s), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1 << 30)))), "")


def middle(s: Any, start: Any, n: Any = None) -> Column:
    size = F.lit(1 << 30) if n is None else column(n).cast("int")
    return F.substr(strings(s), column(start).cast("int") + 1, size)


def after(s: Any, d: str, index: Any = None) -> Column:
    """What follows the last d, or nothing."""
    c = strings(s)
    return F.when(c.isNull(), None).when(F.contains(c, F.lit(d)), F.substring_index(c, d, -1)).otherwise(F.lit(""))


def before(s: Any, d: str, index: Any = None) -> Column:
    return F.substring_index(strings(s), d, 1)


def combine(xs: Any, sep: str = "") -> Any:
    if isinstance(xs, list):
        if is_constant(xs):
            return sep.join(map(text, xs))
        return F.concat_ws(sep, *[column(text(x)) for x in xs])
    return F.array_join(F.transform(column(xs), lambda x: F.coalesce(x.cast("string"), F.lit(""))), sep)


def split(s: Any, sep: str) -> Column:
    return F.coalesce(F.split(strings(s), literal(sep), -1), F.array().cast("array<string>"))


def split_each(delimiters: list[str]) -> Function:
    pattern = "|".join("\\Q" + d + "\\E" for d in delimiters)
    return Function(lambda s: F.split(strings(s), F.lit(pattern), -1) if delimiters else F.array(strings(s)))


def floor_divide(a: Any, b: Any) -> Column:
    x, y = column(a).cast("bigint"), column(b).cast("bigint")
    # pmod is never negative for a positive divisor, so what is left divides exactly
    up = (x - F.pmod(x, F.abs(y))) / F.abs(y)
    down = (-x - F.pmod(-x, F.abs(y))) / F.abs(y)
    return F.when(y > 0, up).otherwise(down).cast("bigint")


def value_is(v: Any, kind: Marker) -> Any:
    """Whether a value has a type, as far as it is known: by Spark's type for columns."""
    name = str(kind.value).replace(".Type", "").lower()
    if is_constant(v):
        whole = isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer()
        tests = {
            "any": True, "none": v is None, "null": v is None, "text": isinstance(v, str), "logical": isinstance(v, bool), "int64": whole, "byte": whole,
            "number": isinstance(v, (int, float)) and not isinstance(v, bool), "double": isinstance(v, (int, float)) and not isinstance(v, bool),
            "date": isinstance(v, dt.date), "datetime": isinstance(v, dt.datetime), "binary": isinstance(v, bytes),
        }
        return tests.get(name, True)
    c = column(v)
    number = F.typeof(c).rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$")
    tests = {
        "any": F.lit(True), "none": c.isNull(), "null": c.isNull(), "text": (F.typeof(c) == "string") & c.isNotNull(),
        "logical": (F.typeof(c) == "boolean") & c.isNotNull(), "number": number & c.isNotNull(), "double": number & c.isNotNull(),
        "int64": number & null_false(c.try_cast("double") == F.floor(c.try_cast("double"))), "byte": number & null_false(c.try_cast("double") == F.floor(c.try_cast("double"))),
        "date": F.typeof(c).rlike("^(date|timestamp.*)$") & c.isNotNull(), "datetime": F.typeof(c).rlike("^(date|timestamp.*)$") & c.isNotNull(),
        "binary": (F.typeof(c) == "binary") & c.isNotNull(),
    }
    return tests.get(name, F.lit(True))


def cast(c: Column, kind: Marker | str, strict_int: bool = True) -> Column:
    """A coercing cast: what cannot be read becomes null; whole-number types refuse fractions."""
    try:
        target = spark_type(kind)
    except KeyError:
        raise MError(f"unknown type {getattr(kind, 'value', kind)!r}") from None
    if target is None:
        return c
    if target == "bigint" and strict_int:
        d = c.try_cast("double")
        exact = F.coalesce(c.try_cast("bigint"), d.cast("bigint"))
        return F.when(d.isNotNull() & (d != F.floor(d)), F.raise_error(F.lit("a fraction cannot become Int64")).cast("bigint")).otherwise(exact)
    return c.try_cast(target)


def _midnight(v: Any) -> Column:
    return F.date_trunc("day", column(v).cast("timestamp_ntz")).cast("timestamp_ntz")


def _week_start(v: Any) -> Column:
    return F.date_trunc("week", column(v).cast("timestamp_ntz")).cast("timestamp_ntz")


def duration_days(v: Any) -> Any:
    if isinstance(v, dt.timedelta):
        return v.days
    if isinstance(v, (int, float)):
        return int(v)
    seconds = column(v).cast("interval day to second").cast("interval second").cast("decimal(20,6)")
    return F.floor(seconds / 86400).cast("bigint")


def decompress(v: Any, kind: Any = None) -> Any:
    """Raw deflate or zlib."""
    def one(b: bytes | None) -> bytes | None:
        if b is None:
            return None
        try:
            return zlib.decompress(b, -15)
        except zlib.error:
            return zlib.decompress(b)

    if isinstance(v, bytes):
        return one(v)

    @F.pandas_udf("binary")
    def inflate(s: pd.Series) -> pd.Series:
        return s.map(one)

    return inflate(column(v))


def from_text(v: Any, encoding: Any = None) -> Any:
    hexadecimal = isinstance(encoding, Marker) and encoding.value == "Hex"
    if isinstance(v, str):
        return bytes.fromhex(v) if hexadecimal else base64.b64decode(v)
    return F.unhex(strings(v)) if hexadecimal else F.unbase64(strings(v))


def json_document(v: Any) -> Any:
    """A constant text becomes its values; a column becomes a variant-free map of texts."""
    if isinstance(v, (str, bytes)):
        return json.loads(v)
    return F.from_json(strings(v), "map<string,string>")


def record_field(r: Any, name: str) -> Any:
    if isinstance(r, dict):
        return r.get(name)
    if isinstance(r, Row):
        return quoted(name) if name in r.columns else None
    return column(r).getField(name)


def record_or_default(r: Any, name: str, default: Any = None) -> Any:
    if isinstance(r, dict):
        return r.get(name, default)
    if isinstance(r, Row):
        return quoted(name) if name in r.columns else default
    c = column(r)
    return F.when(F.map_contains_key(c, name), F.try_element_at(c, F.lit(name))).otherwise(column(default))


def constant_or(plain, lowered):
    """One function for constants, folded on the driver, and another for columns."""
    return lambda *args: plain(*args) if all(map(is_constant, args)) else lowered(*args)


def scalars(compiler) -> dict[str, Any]:
    def number_from(v: Any, *_: Any) -> Any:
        if is_constant(v):
            try:
                return None if v is None else float(v)
            except (TypeError, ValueError):
                raise MError(f"{v!r} is no number") from None
        return column(v).try_cast("double") if compiler.trying else column(v).cast("double")

    def fail(message: Any) -> Any:
        if is_column(message):
            return F.lit(None) if compiler.trying else F.raise_error(message.cast("string"))
        return _Raise(text(message) if not isinstance(message, dict) else str(message.get("Message", message))).as_value(compiler)

    def binary_op(f):
        return lambda s, sub, *_: null_false(f(strings(s), strings(sub)))

    ws = r"^\s+|\s+$"
    return {
        "Text.Combine": combine,
        "Text.Contains": binary_op(F.contains), "Text.StartsWith": binary_op(F.startswith), "Text.EndsWith": binary_op(F.endswith),
        "Text.Lower": constant_or(lambda s, *_: s and s.lower(), lambda s, *_: F.lower(strings(s))),
        "Text.Upper": constant_or(lambda s, *_: s and s.upper(), lambda s, *_: F.upper(strings(s))),
        "Text.Proper": lambda s, *_: proper(s),
        "Text.Trim": lambda s, *_: F.regexp_replace(strings(s), ws, ""),
        "Text.TrimStart": lambda s, *_: F.regexp_replace(strings(s), r"^\s+", ""),
        "Text.TrimEnd": lambda s, *_: F.regexp_replace(strings(s), r"\s+$", ""),
        "Text.From": lambda v, *_: text(v),
        "Text.Length": constant_or(lambda s: len(s or ""), lambda s: F.coalesce(F.length(strings(s)), F.lit(0))),
        "Text.Replace": lambda s, old, new: F.replace(strings(s), strings(old), strings(new)),
        "Text.Split": split,
        "Text.Middle": middle,
        "Text.Range": middle,
        "Text.Start": lambda s, n: F.left(strings(s), column(n).cast("int")),
        "Text.End": lambda s, n: F.right(strings(s), column(n).cast("int")),
        "Text.AfterDelimiter": after, "Text.BeforeDelimiter": before,
        "Combiner.CombineTextByDelimiter": lambda d, *_: Function(lambda xs: combine(xs, d)),
        "Splitter.SplitTextByDelimiter": lambda d, *_: split_each([d]),
        "Splitter.SplitTextByEachDelimiter": lambda ds, *_: split_each(ds),
        "Splitter.SplitByNothing": lambda *_: Function(lambda s: F.array(strings(s))),
        "Number.From": number_from,
        "Number.Round": lambda v, digits=0, *_: F.bround(column(v).cast("double"), int(digits)),
        "Number.Abs": constant_or(lambda v: None if v is None else abs(v), lambda v: F.abs(column(v))),
        "Number.IntegerDivide": constant_or(lambda a, b: int(a) // int(b), floor_divide),
        "Value.Is": value_is,
        "Date.From": lambda v, *_: _midnight(v), "DateTime.From": lambda v, *_: column(v).cast("timestamp_ntz"),
        "Date.Year": lambda d: F.year(column(d)), "Date.Month": lambda d: F.month(column(d)), "Date.Day": lambda d: F.dayofmonth(column(d)),
        "Date.DayOfWeek": lambda d, *_: F.weekday(column(d)), "Date.WeekOfYear": lambda d, *_: F.weekofyear(column(d)),
        "Date.StartOfWeek": lambda d, *_: _week_start(d), "Date.EndOfWeek": lambda d, *_: (_week_start(d) + F.expr("INTERVAL 6 DAYS")).cast("timestamp_ntz"),
        "Date.ToText": lambda d, *_: F.date_format(column(d), "yyyy-MM-dd"),
        "DateTime.LocalNow": lambda: F.localtimestamp(),
        "Duration.Days": duration_days,
        "#date": lambda y, m, d: dt.datetime(int(y), int(m), int(d)) if is_constant([y, m, d]) else F.make_date(column(y), column(m), column(d)).cast("timestamp_ntz"),
        "#datetime": lambda y, mo, d, h, mi, s: dt.datetime(int(y), int(mo), int(d), int(h), int(mi), int(s)) if is_constant([y, mo, d, h, mi, s]) else F.make_timestamp_ntz(*map(column, (y, mo, d, h, mi, s))),
        "#duration": lambda d, h, m, s: dt.timedelta(days=d, hours=h, minutes=m, seconds=s) if is_constant([d, h, m, s]) else F.make_dt_interval(*map(column, (d, h, m, s))),
        "Record.Field": record_field, "Record.FieldOrDefault": record_or_default,
        "Binary.FromText": from_text, "Binary.Decompress": decompress, "Json.Document": lambda v, *_: json_document(v),
        "Replacer.ReplaceValue": lambda v, old, new: F.when(column(v).eqNullSafe(column(old)), column(new)).otherwise(column(v)),
        "Replacer.ReplaceText": lambda v, old, new: F.replace(strings(v), strings(old), strings(new)),
        "__m_error__": fail,
    }


class _Raise:
    def __init__(self, message: str):
        self.message = message

    def as_value(self, compiler) -> Any:
        """In a row, an error is one of the row that meets it; elsewhere it stops the program."""
        if compiler.trying:
            raise MError(self.message)
        return F.raise_error(F.lit(self.message))

