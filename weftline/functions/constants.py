"""Named constants of the library."""

from __future__ import annotations

from ..plans.values import Marker

#: Spark types of M's type names, by last part and in lower case; None means no cast.
SPARK_TYPES = {
    "int64": "bigint", "int32": "bigint", "int16": "bigint", "int8": "bigint", "byte": "bigint", "number": "double", "double": "double",
    "single": "double", "decimal": "double", "currency": "double", "percentage": "double", "text": "string", "logical": "boolean",
    "date": "timestamp_ntz", "datetime": "timestamp_ntz", "datetimezone": "timestamp_ntz", "time": "timestamp_ntz",
    "any": None, "binary": None, "none": None, "null": None, "duration": None,
}


def spark_type(marker: Marker | str) -> str | None:
    raw = marker.value if isinstance(marker, Marker) else marker
    name = str(raw).replace(".Type", "").split(".")[-1].strip().lower()
    if name not in SPARK_TYPES:
        raise KeyError(raw)
    return SPARK_TYPES[name]


def constants() -> dict[str, Marker]:
    out = {"Order.Ascending": Marker("order", "asc"), "Order.Descending": Marker("order", "desc")}
    joins = {"Inner": "inner", "LeftOuter": "left", "RightOuter": "right", "FullOuter": "full", "LeftAnti": "left_anti", "RightAnti": "right_anti", "LeftSemi": "left_semi", "RightSemi": "right_semi"}
    out |= {f"JoinKind.{k}": Marker("join", v) for k, v in joins.items()}
    types = "Int64 Int32 Int16 Int8 Byte Number Double Single Decimal Currency Percentage Text Logical Date DateTime DateTimeZone Time Any Binary None Duration"
    out |= {f"{t}.Type": Marker("type", f"{t}.Type") for t in types.split()}
    options = {
        "Compression": "Deflate GZip None", "BinaryEncoding": "Base64 Hex", "QuoteStyle": "Csv None", "TextEncoding": "Utf8 Windows Ascii Utf16",
        "ExtraValues": "Error Ignore List", "MissingField": "Error Ignore UseNull", "Occurrence": "First Last All",
        "RoundingMode": "AwayFromZero Down ToEven TowardZero Up", "Precision": "Double Decimal",
    }
    return out | {f"{g}.{n}": Marker("option", n) for g, names in options.items() for n in names.split()}
