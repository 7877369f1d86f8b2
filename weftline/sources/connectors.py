"""Sources: files and folders, JDBC databases, HTTP and OData, Excel and CSV.

Files are read by Spark's own readers. HTTP goes through ``compiler.fetch``, a
function from address to bytes that tests and offline runs replace.
"""

from __future__ import annotations

import csv as csv_module
import io
import json
import urllib.request
from typing import Any

from pyspark.sql import functions as F

from ..plans.values import Handle, MError, Table, column, is_column

TIMEOUT = 60


def http_get(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=TIMEOUT) as r:
        return r.read()


def jdbc_url(server: str, database: str) -> str:
    return f"jdbc:sqlserver://{server};databaseName={database};trustServerCertificate=true"


#: Stand for line breaks within a quoted field while its record is one line.
_BREAKS = str.maketrans("\r\n", "\ue000\ue001")


def _parsed(spark, reader, text: str):
    """A text that the driver holds, as Spark's reader types it; a quoted field may hold line breaks."""
    lines = []
    for record in csv_module.reader(io.StringIO(text, newline="")):
        line = io.StringIO()
        csv_module.writer(line, lineterminator="").writerow([x.translate(_BREAKS) for x in record])
        lines.append(line.getvalue())
    df = reader.option("escape", '"').csv(spark.sparkContext.parallelize(lines))
    return df.select(*[F.translate(c, "\ue000\ue001", "\r\n").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def connectors(compiler) -> dict[str, Any]:
    spark = compiler.spark
    fetch = lambda url: (compiler.fetch or http_get)(url)

    def csv(source: Any, *_: Any) -> Table:
        """Without a header: Column1..n, types inferred."""
        reader = spark.read.option("inferSchema", True).option("header", False)
        if isinstance(source, Handle) and source.kind == "file":
            df = reader.option("multiLine", True).option("escape", '"').csv(source.location["path"])
        else:
            raw = source.location["bytes"]() if isinstance(source, Handle) else source
            text = raw.decode("utf-8-sig") if isinstance(raw, bytes) else str(raw)
            df = _parsed(spark, reader, text) if text else spark.createDataFrame([], "_c0 string")
        return Table(df.toDF(*[f"Column{i + 1}" for i in range(len(df.columns))]))

    def content(source: Any) -> bytes:
        if isinstance(source, Handle):
            return source.location["bytes"]()
        return source.encode() if isinstance(source, str) else source

    def file_contents(path: str, *_: Any) -> Handle:
        def read() -> bytes:
            rows = spark.read.format("binaryFile").load(path).select("content").limit(1).collect()
            return bytes(rows[0][0])

        return Handle("file", {"path": path, "bytes": read})

    def folder_files(path: str, *_: Any) -> Table:
        files = spark.read.format("binaryFile").load(path)
        name = F.substring_index("path", "/", -1)
        df = files.select(
            F.col("content").alias("Content"), name.alias("Name"),
            F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("").alias("Extension"),
            F.regexp_replace("path", r"[^/]*$", "").alias("Folder Path"),
        )
        return Table(df.orderBy("Name"), (F.col("Name").asc_nulls_last(),))

    def web_contents(url: str, *_: Any) -> Handle:
        return Handle("web", {"url": url, "bytes": lambda: fetch(url)})

    def excel(source: Any, *_: Any) -> list[dict[str, Any]]:
        import pandas as pd

        path = source.location["path"] if isinstance(source, Handle) and source.kind == "file" else io.BytesIO(content(source))
        sheets = pd.read_excel(path, sheet_name=None, header=None)
        out = []
        for name, frame in sheets.items():
            frame.columns = [f"Column{i + 1}" for i in range(frame.shape[1])]
            out.append({"Name": name, "Item": name, "Kind": "Sheet", "Data": Table(spark.createDataFrame(frame))})
        return out

    def sql_database(server: str, database: str, *_: Any) -> Handle:
        def pick(key: dict[str, Any]) -> Table:
            name = f"{key['Schema']}.{key['Item']}" if "Schema" in key else key.get("Item", key.get("Name"))
            query = key.get("Query")
            reader = spark.read.format("jdbc").option("url", jdbc_url(server, database))
            return Table((reader.option("query", query) if query else reader.option("dbtable", name)).load())

        return Handle("sql", {"server": server, "database": database}, pick)

    def records(values: list[dict]) -> Table:
        def flat(r: dict, prefix: str = "") -> dict[str, Any]:
            out: dict[str, Any] = {}
            for k, v in r.items():
                out |= flat(v, f"{prefix}{k}.") if isinstance(v, dict) else {prefix + k: json.dumps(v) if isinstance(v, list) else v}
            return out

        return compiler.library["Table.FromRecords"]([flat(r) for r in values])

    def odata(url: str, *_: Any) -> Handle:
        def pick(key: dict[str, Any]) -> dict[str, Any]:
            values: list[dict] = []
            page = f"{url.rstrip('/')}/{key['Name']}"
            while page:  # the service tells where the next page is
                body = json.loads(fetch(page))
                values += body.get("value", [])
                page = body.get("@odata.nextLink")
            return {"Name": key["Name"], "Data": records(values)}

        return Handle("odata", {"url": url}, pick)

    def json_document(source: Any, *_: Any) -> Any:
        if is_column(source):
            return F.from_json(column(source).cast("string"), "map<string,string>")
        try:
            return json.loads(content(source))
        except ValueError as e:
            raise MError(f"no JSON: {e}") from None

    return {
        "Csv.Document": csv, "Excel.Workbook": excel, "File.Contents": file_contents, "Folder.Files": folder_files, "Web.Contents": web_contents,
        "Sql.Database": sql_database, "OData.Feed": odata, "Json.Document": json_document,
    }
