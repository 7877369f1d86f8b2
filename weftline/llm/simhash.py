"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint's 64 bits form 32 segments of two; the number of bits set in each
is its embedding. The Manhattan distance of two embeddings is never more than
the Hamming distance of the fingerprints, so a range join on the embedding
finds every link. The join is a grid: the 32 coordinates form six groups, and
within Manhattan distance 3 at least three groups are equal, so that each
fingerprint goes into the twenty cells of three groups each. Within a cell the
lower bound is tested first, then the exact Hamming distance.

Only distinct fingerprints are joined, and a cell gives the edges of a spanning
forest of its links, not its pairs; both keep large groups of copies cheap and
lose no connection.

Nulls: a null text is an empty one, with fingerprint zero; empty texts are
linked like any others. A null id stands for no document id: it is never
returned as a component, unless all ids of the component are null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches
from .components import components
from .shared import settle

SEED = 42
GROUPS, RADIUS = 6, 3
#: Cells up to this size are compared pair by pair, shift by shift; larger ones by a search from link to link.
SMALL = 16


def _shingle_hashes(text: str, size: int, seed: int) -> list[int]:
    words = text.encode().lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) < size:
        return [xxhash.xxh64_intdigest(line, seed)]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0] + [e + 1 for e in ends[:-1]]
    digest = xxhash.xxh64_intdigest
    return [digest(line[s:e], seed) for s, e in zip(starts, ends[size - 1 :])]


def fingerprints_of(texts: list[str], size: int = 3, seed: int = SEED) -> np.ndarray:
    """The 64-bit fingerprint of each text as a signed integer."""
    hashes = [_shingle_hashes(t, size, seed) for t in texts]
    counts = np.array([len(h) for h in hashes], dtype=np.int64)
    out = np.zeros(len(texts), np.int64)
    full = np.flatnonzero(counts)
    if len(full):
        flat = np.concatenate([np.array(hashes[i], dtype="<u8") for i in full])
        at = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * ones > counts[full, None], axis=1, bitorder="little").view("<i8")[:, 0]
    return out


def fingerprints(docs: DataFrame, size: int = 3, seed: int = SEED) -> DataFrame:
    """doc_id, fp (signed 64 bits) and text_hash of every row of docs."""

    def make():
        def work(batch):
            fp = fingerprints_of(batch.column("text").to_pylist(), size, seed)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp), batch.column("text_hash")], ["doc_id", "fp", "text_hash"])

        return work

    rows = batches.id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(batches.each_slice(make), "doc_id long, fp long, text_hash long")


def embedding(fp):
    """Two-bit segments in unary: 00, 01 or 11 for no, one or two bits set; bit_count of an XOR is the Manhattan distance."""
    low = F.lit(0x5555555555555555)
    shifted = F.shiftrightunsigned(fp, 1)
    either, both = fp.bitwiseOR(shifted).bitwiseAND(low), fp.bitwiseAND(shifted).bitwiseAND(low)
    return either.bitwiseOR(F.shiftleft(both, 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cell_masks() -> list[int]:
    cuts = [round(i * 32 / GROUPS) for i in range(GROUPS + 1)]
    group = [sum(3 << (2 * c) for c in range(cuts[i], cuts[i + 1])) for i in range(GROUPS)]
    return [_signed(sum(group[i] for i in pick)) for pick in combinations(range(GROUPS), GROUPS - RADIUS)]


def _unary(fp: np.ndarray) -> np.ndarray:
    low = np.uint64(0x5555555555555555)
    up = fp >> np.uint64(1)
    return ((fp | up) & low) | ((fp & up & low) << np.uint64(1))


def _linked(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Whether fingerprints differ in at most radius bits; first by the lower bound."""
    ok = np.bitwise_count(_unary(a) ^ _unary(b)) <= radius
    ok[ok] = np.bitwise_count(a[ok] ^ b[ok] if len(b) == len(a) else a[ok] ^ b) <= radius
    return ok


def _forest(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect the fingerprints of one cell as their links do: a search from link to link."""
    edges, rest = [], fps
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            hit = _linked(rest, np.array([x], np.uint64), radius)
            if hit.any():
                found = rest[hit]
                edges.append((np.full(len(found), x), found))
                frontier.extend(found)
                rest = rest[~hit]
    return edges


def links_in_cells(it, radius: int = RADIUS):
    """mapInArrow over rows sorted by (cell kind, cell, fp): edges (a, b) of links within cells."""
    carry = None

    def handle(kind, cell, fp):
        edges = []
        new = np.ones(len(fp), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (cell[1:] != cell[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(fp)))
        of = np.repeat(np.arange(len(at)), size)
        small = np.flatnonzero((size[of] <= SMALL) & (size[of] > 1))
        f, g = fp[small], of[small]
        for k in range(1, SMALL):
            if len(f) <= k:
                break
            same = np.flatnonzero(g[k:] == g[:-k])
            if not len(same):
                break
            a, b = f[same], f[same + k]
            ok = _linked(a, b, radius)
            edges.append((a[ok], b[ok]))
        for i in np.flatnonzero(size > SMALL):
            edges += _forest(np.unique(fp[at[i] : at[i] + size[i]]), radius)
        a = np.concatenate([np.zeros(0, np.uint64), *(e[0] for e in edges)])
        b = np.concatenate([np.zeros(0, np.uint64), *(e[1] for e in edges)])
        a, b = a.view(np.int64), b.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for batch in it:
        cols = [np.asarray(batch.column(c)) for c in ("kind", "cell", "fp")]
        cols[2] = cols[2].astype(np.int64).view(np.uint64)
        if carry is not None:
            cols = [np.concatenate(x) for x in zip(carry, cols)]
        if not len(cols[0]):
            continue
        # the last cell may go on in the next batch
        last = int(np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))[-1]) + 1 if (
            (cols[0][0] != cols[0][-1]) or (cols[1][0] != cols[1][-1])
        ) else 0
        if last:
            yield handle(*(c[:last] for c in cols))
        carry = [c[last:] for c in cols]
    if carry is not None and len(carry[0]):
        yield handle(*carry)


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose closure is that of all links."""
    u = embedding(F.col("fp"))
    cells = F.array(*[F.struct(F.lit(i).alias("kind"), u.bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(cell_masks())])
    rows = fps.select("fp", F.explode(cells).alias("c")).select(F.col("c.kind").alias("kind"), F.col("c.cell").alias("cell"), "fp")
    dealt = rows.repartition("kind", "cell").sortWithinPartitions("kind", "cell", "fp")
    return dealt.mapInArrow(links_in_cells, "a long, b long").distinct()


def _rooted(rows: DataFrame) -> DataFrame:
    """fp and root (one fingerprint for all that links reach) of the distinct fingerprints of rows."""
    distinct = rows.select("fp").distinct()
    roots = components(links(distinct)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (the smallest id that links reach) of every row of docs."""
    rows = settle(fingerprints(docs))
    rooted = _rooted(rows)
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    least = rooted.join(first, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", "fp").join(rooted.join(least, "root").select("fp", "component_id"), "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of docs, unchanged: that of the smallest id, and of rows of one id the first by a hash of the text.

    Rows are told apart by id and text, so texts of one id in different components all keep their rows; a null id is
    larger than any other. Of rows equal in both, one stays, whatever their other columns. An empty table gives none.
    """
    rows = settle(fingerprints(docs))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    of_fp = rows.groupBy("fp").agg(F.min(row).alias("row"))  # first by fingerprint, so that a large group is one row
    first = _rooted(rows).join(of_fp, "fp").groupBy("root").agg(F.min("row").alias("row"))
    keep = first.select(F.col("row.doc_id").alias("__id"), F.col("row.text_hash").alias("__hash"))
    own = docs.withColumn("__own_hash", F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))).withColumn("__own_id", docs["doc_id"].cast("long"))
    kept = own.join(keep, own["__own_id"].eqNullSafe(keep["__id"]) & (own["__own_hash"] == keep["__hash"]), "left_semi")
    return kept.dropDuplicates(["__own_id", "__own_hash"]).drop("__own_id", "__own_hash")
