"""Physical sources named in M texts, as driver functions and as DataFrame expressions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How each connector's call names its source; two arguments join as server/database.
PATTERNS = {
    "http": r'Web\.Contents\(\s*"([^"]+)"',
    "odata": r'OData\.Feed\(\s*"([^"]+)"',
    "sql": r'Sql\.Databases?\(\s*"([^"]+)"(?:\s*,\s*"([^"]+)")?',
    "postgresql": r'PostgreSQL\.Database\(\s*"([^"]+)"(?:\s*,\s*"([^"]+)")?',
    "mysql": r'MySQL\.Database\(\s*"([^"]+)"(?:\s*,\s*"([^"]+)")?',
    "odbc": r'Odbc\.DataSource\(\s*"([^"]+)"',
    "folder": r'Folder\.Files\(\s*"([^"]+)"',
    "sharepoint": r'SharePoint\.(?:Files|Contents)\(\s*"([^"]+)"',
    "excel_file": r'Excel\.Workbook\(\s*File\.Contents\(\s*"([^"]+)"',
    "analysis_services": r'AnalysisServices\.Database\(\s*"([^"]+)"(?:\s*,\s*"([^"]+)")?',
    "azure_blob": r'AzureStorage\.Blobs\(\s*"([^"]+)"',
}
LITERAL_URL = r'"(https?://[^"\s]+)"'


def sources(text: str, patterns: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(system, identifier) of each distinct source, known connectors first, then bare addresses."""
    found = [(system, "/".join(g for g in m.groups() if g)) for system, p in (patterns or PATTERNS).items() for m in re.finditer(p, text or "")]
    found += [("http", m[1]) for m in re.finditer(LITERAL_URL, text or "")]
    return list(dict.fromkeys(found))


def source_rows(df: DataFrame, expression: str, key: list[str]) -> DataFrame:
    """key, system, identifier: the distinct sources named in a column, in one pass over df."""
    text = F.coalesce(F.col(expression), F.lit(""))
    found = []
    for system, p in [*PATTERNS.items(), ("http", LITERAL_URL)]:
        first = F.regexp_extract_all(text, F.lit(p), 1)
        if re.compile(p).groups == 2:
            second = F.regexp_extract_all(text, F.lit(p), 2)
            ids = F.zip_with(first, second, lambda a, b: F.when(F.coalesce(b, F.lit("")) == "", a).otherwise(F.concat(a, F.lit("/"), b)))
        else:
            ids = first
        found.append(_tagged(ids, system))
    each = df.select(*key, F.explode(F.array_distinct(F.concat(*found))).alias("s"))
    return each.select(*key, F.col("s.system").alias("system"), F.col("s.identifier").alias("identifier")).distinct()


def _tagged(ids, system: str):
    return F.transform(ids, lambda i: F.struct(F.lit(system).alias("system"), i.alias("identifier")))
