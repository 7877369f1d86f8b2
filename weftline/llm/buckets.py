"""Documents in buckets, and exchanges of keys between buckets.

Operators that look for equal windows anywhere in a corpus first deal the
documents into buckets of a few megabytes by a hash of their id. A bucket's
task reduces its windows to distinct 64-bit keys, and sends them, packed as
arrays, to the partition that owns each key's range. The owner sees every key
at most once from each bucket, however often it occurs there, and answers each
bucket in one packed row. So neither a frequent key nor a large group of copies
gathers more than one entry a bucket anywhere, and nothing comes to the driver.

n buckets send at most n * n rows, and never more than they have distinct keys.
Beyond ``GROWS_FROM`` bytes a bucket grows as the square root of the corpus, so
n does too, and the rows grow in proportion to the corpus.

The rows to deal should come from a scan or a checkpoint: rows get a number that
spreads repeated ones, and a lost task must number them as before.
"""

from __future__ import annotations

import ctypes
import math
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches
from .shared import settle, shared_folder

#: Bytes of text in a bucket of a corpus up to GROWS_FROM bytes, and most rows.
BUCKET_BYTES, BUCKET_ROWS, GROWS_FROM = 8 << 20, 8192, 60 << 30
SENT = "owner int, b int, payload binary"
ANSWER = "b int, part int, payload binary"


def n_buckets(total: int, rows: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for total bytes in so many rows; in proportion to the root of total beyond GROWS_FROM."""
    grown = bucket_bytes * max(1.0, (total / GROWS_FROM) ** 0.5)
    return max(1, math.ceil(total / grown), math.ceil(rows / (BUCKET_ROWS * grown / bucket_bytes)))


def dealt(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int, int]:
    """(rows of b, doc_id, text; number of buckets; bytes of text): a written table, bucketed by b, that is read as often as needed."""
    spark = docs.sparkSession
    rows = batches.id_and_text(docs)
    held = rows.agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("rows")).first()
    total = int(held["n"] or 0)
    n = n_buckets(total, held["rows"], bucket_bytes)
    files = max(1, -(-n // 2))
    name = f"weftline_{uuid.uuid4().hex}"
    # text and row number take part in the hash, so that neither rows of one id nor equal rows meet in one bucket
    bucket = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(n)).cast("int")
    (
        rows.select(bucket.alias("b"), "doc_id", "text").repartition(files, "b")
        .write.format("parquet").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}").bucketBy(files, "b").saveAsTable(name)
    )
    return spark.table(name), n, total


def ordered(table: pa.Table) -> pa.Table:
    """A bucket's documents by id, then text; null ids last. Every pass over a bucket sees them in this order."""
    return table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))


def owners(keys: np.ndarray, n: int) -> np.ndarray:
    """The owner of each key: keys are split into n equal ranges, so that sorted keys are sorted by owner."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def pieces(keys: np.ndarray, n_owners: int) -> tuple[np.ndarray, np.ndarray]:
    """(owners of some of the sorted keys, where each one's keys begin, and their number at the end)."""
    own = owners(keys, n_owners)
    cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return own[cuts], np.append(cuts, len(own))


def sent_rows(b: int, own: np.ndarray, payloads: list[bytes]) -> pa.Table:
    return pa.table({"owner": pa.array(own, pa.int32()), "b": pa.array(np.full(len(own), b), pa.int32()), "payload": pa.array(payloads, pa.binary())})


def send(b: int, keys: np.ndarray, n_owners: int, pack: Callable[[slice], bytes]) -> pa.Table:
    """One row for each owner of some of the sorted, distinct keys; pack gives the bytes for a slice of them."""
    own, cuts = pieces(keys, n_owners)
    return sent_rows(b, own, [pack(slice(lo, hi)) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist())])


def exchange(sent: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Rows (b, part, payload): what answer makes of each payload of an owner. Kept in the checkpoint folder."""

    def own(table: pa.Table) -> pa.Table:
        table = table.sort_by("b")
        out = answer(table["payload"].to_pylist())
        return pa.table({"b": table["b"], "part": table["owner"], "payload": pa.array(out, pa.binary())})

    return settle(sent.groupBy("owner").applyInArrow(own, ANSWER))


def answers(table: pa.Table) -> list[bytes]:
    """A bucket's answers in the order of its keys."""
    return table.sort_by("part")["payload"].to_pylist()


def _give_back() -> None:
    """A worker's freed memory goes back to the system: workers stay, idle, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def each(docs: DataFrame, work: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
    """work(bucket, its documents in order) for every bucket."""

    def run(t: pa.Table) -> pa.Table:
        out = work(t["b"][0].as_py(), ordered(t))
        _give_back()
        return out

    return docs.groupBy("b").applyInArrow(run, schema)


def each_with(docs: DataFrame, more: DataFrame, work: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """The same with the rows of more that have the bucket's b; buckets without documents give nothing."""
    empty = pa.schema([(f.name, t) for f, t in zip(_fields(schema), _arrow(schema))]).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left["b"][0].as_py(), ordered(left), right) if left.num_rows else empty
        _give_back()
        return out

    return docs.groupBy("b").cogroup(more.groupBy("b")).applyInArrow(run, schema)


def _fields(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fields


def _arrow(schema: str):
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in _fields(schema)]
