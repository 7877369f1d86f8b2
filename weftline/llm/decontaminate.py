"""Benchmark decontamination with DataFrame functions only.

Texts are lower-cased and cut into words of letters and digits; shingles are
five words, weighted by how often they occur. For each benchmark item, windows
of the item's size are laid over a document wherever the document holds one of
the item's shingles, aligned to it. Aligned windows and items get SimHash
fingerprints, and a multi-index over four 16-bit blocks finds all items of the
window's size within ``radius`` bits: of 15 differing bits at most 3 fall into
some block, so each item is indexed under every block value at most 3 bits away.

A window may also be like an item without being aligned to any shingle of it,
as when the item's parts are in another order. A window of similarity s has at
least s / (1 + s) of its and the item's shingles together in common, so every
start, aligned or not, at which that many places hold shingles of the item is
laid too, and aligned windows beyond the radius are found by the same bound, so
that none is lost. Candidates are verified by the exact weighted Jaccard similarity of
their shingles. An item's leak into a document is told by its aligned windows,
and by the others where no aligned one is similar enough.

Item shingles are broadcast only up to ``broadcast_shingles``; beyond that the
same join shuffles.

Nulls: null texts have no words and match nothing; rows with a null item id
form no item; a null doc_id is a document like any other. Items shorter than
five words have one shingle, the whole item. Repeated rows give one result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 15, 4
BROADCAST_SHINGLES = 1_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def grams(words: Column, k: int) -> Column:
    """Hashes of all runs of k words."""
    n = F.size(words)
    at = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))


def shingles(words: Column) -> Column:
    """Hashes of the five-word shingles; a shorter text has one, its whole; an empty one none."""
    n = F.size(words)
    short = F.when(n == 0, F.array().cast("array<bigint>"))
    for k in range(1, SHINGLE):
        short = short.when(n == k, grams(words, k))
    return short.otherwise(grams(words, SHINGLE))


def simhash(hashes: Column) -> Column:
    """64 bits, each set where more than half of the hashes, repeats included, set it."""
    def ones_at(b: int) -> Column:
        return F.aggregate(hashes, F.lit(0), lambda acc, h: acc + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1)).cast("int"))

    n = F.size(hashes)
    out = F.lit(0).cast("bigint")
    for b in range(64):
        ones = ones_at(b)
        out = out.bitwiseOR(F.when(2 * ones > n, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("bigint"))
    return out


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingle hashes."""
    def count(xs: Column, x: Column) -> Column:
        return F.size(F.filter(xs, lambda y: y == x))

    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)).cast("int")


def _near_masks() -> list[int]:
    """XOR masks of all 16-bit values within the distance that one block must keep to."""
    most = RADIUS // BLOCKS
    return [sum(1 << i for i in pick) for r in range(most + 1) for pick in combinations(range(16), r)]


def _key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words), k (words of a shingle) and the shingles of every item with words."""
    words = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("w"))
    known = words.where(F.size("w") > 0).distinct()
    return known.select("item_id", F.size("w").alias("n"), F.least(F.size("w"), F.lit(SHINGLE)).alias("k"), shingles(F.col("w")).alias("item_shingles"))


def _starts(places: Column, least: Column, width: Column, last: Column) -> Column:
    """All starts up to last of windows of width that hold at least so many of the places (sorted, without repeats)."""
    def of(i: Column) -> Column:
        before = F.when(i > 0, F.get(places, i - 1) + 1).otherwise(F.lit(0))  # smaller ones belong to an earlier i
        lo = F.greatest(before, F.get(places, i + least - 1) - width + 1)
        hi = F.least(last, F.get(places, i))
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    n = F.size(places)
    return F.when(n >= least, F.flatten(F.transform(F.sequence(F.lit(0), n - least), of))).otherwise(F.array().cast("array<int>"))


def _windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """key, doc_id, n, start, aligned, item_ids and the shingles of item-sized windows.

    aligned: to a shingle shared with an item of n words. item_ids: the items of which the window holds enough places.
    """
    placed = items.select("item_id", "n", "k", F.posexplode("item_shingles").alias("q", "gram")).distinct()
    held = placed.agg(F.count("*").alias("c"), F.array_sort(F.collect_set("k")).alias("k")).first()
    if held["c"] <= BROADCAST_SHINGLES:
        placed = F.broadcast(placed)
    rows = docs.select(_key(docs).alias("key"), words_of(docs["text"]).alias("w"))
    found = None
    for k in held["k"] or [SHINGLE]:  # one kind of shingle, and one more for each length of items under five words
        each = rows.select("key", F.size("w").alias("size"), F.lit(k).alias("k"), F.posexplode(grams(F.col("w"), k)).alias("p", "gram"))
        found = each if found is None else found.unionByName(each)
    pairs = found.join(placed, ["k", "gram"]).groupBy("key", "size", "item_id", "n", "k").agg(
        F.array_sort(F.collect_set("p")).alias("places"), F.collect_set(F.col("p") - F.col("q")).alias("shifts")
    )
    width, whole = F.least("n", "size") - F.col("k") + 1, F.col("n") - F.col("k") + 1
    # in units of a tenth of the similarity: shared >= s * (width + whole - shared)
    s = round(10 * SIMILARITY)
    enough = F.ceil(F.lit(s) * (width + whole) / F.lit(10 + s)).cast("int")
    last = F.greatest(F.lit(0), F.col("size") - F.col("n"))
    at = F.concat(
        F.transform("shifts", lambda x: F.struct(F.greatest(F.lit(0), F.least(x, last)).alias("start"), F.lit(True).alias("aligned"), F.lit(None).cast("long").alias("item_id"))),
        F.transform(_starts(F.col("places"), enough, width, last), lambda x: F.struct(x.alias("start"), F.lit(False).alias("aligned"), F.col("item_id").alias("item_id"))),
    )
    starts = pairs.select("key", "n", F.explode(at).alias("x")).groupBy("key", "n", F.col("x.start").alias("start")).agg(
        F.max("x.aligned").alias("aligned"), F.array_sort(F.collect_set("x.item_id")).alias("item_ids")
    )
    per_doc = starts.groupBy("key").agg(F.collect_list(F.struct("n", "start", "aligned", "item_ids")).alias("at"))
    texts = docs.select(_key(docs).alias("key"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    hit = texts.join(per_doc, "key").select("key", "doc_id", words_of(F.col("text")).alias("w"), "at")
    laid = hit.select("key", "doc_id", "w", F.explode("at").alias("x")).select("key", "doc_id", "x.*", F.slice("w", F.col("x.start") + 1, F.col("x.n")).alias("w"))
    return laid.distinct().select("key", "doc_id", "n", "start", "aligned", "item_ids", shingles(F.col("w")).alias("shingles"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key, doc_id, item_id, start (in words), n_words, aligned and similarity of every verified window."""
    items = items_of(benchmark)
    indexed = items.select("item_id", "n", "item_shingles", simhash(F.col("item_shingles")).alias("item_fp"))
    masks = F.array(*[F.lit(m) for m in _near_masks()])
    cells = indexed.select("item_id", "n", "item_fp", "item_shingles", F.explode(F.array(*[F.struct(F.lit(i).alias("b"), block(F.col("item_fp"), i).alias("v")) for i in range(BLOCKS)])).alias("c"))
    index = cells.select("item_id", "n", "item_fp", F.col("c.b").alias("b"), F.explode(F.transform(masks, lambda m: F.col("c.v").bitwiseXOR(m))).alias("v"))
    windows = _windows(docs, items)
    fps = windows.where("aligned").withColumn("fp", simhash(F.col("shingles")))
    probes = fps.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("b"), block(F.col("fp"), i).alias("v")) for i in range(BLOCKS)])).alias("c"))
    near = (
        probes.select("key", "doc_id", "n", "start", "shingles", "fp", F.col("c.b").alias("b"), F.col("c.v").alias("v"))
        .join(index, ["n", "b", "v"])
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
        .select("key", "doc_id", "n", "start", F.lit(True).alias("aligned"), "shingles", "item_id")
    )
    full = windows.select("key", "doc_id", "n", "start", "aligned", "shingles", F.explode("item_ids").alias("item_id"))
    return (
        near.unionByName(full).distinct().join(indexed.select("item_id", "n", "item_shingles"), ["item_id", "n"])
        .select("key", "doc_id", "item_id", "start", F.col("n").alias("n_words"), "aligned", similarity(F.col("shingles"), F.col("item_shingles")).alias("similarity"))
        .where(F.col("similarity") >= SIMILARITY)
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, similarity (the best) and start (the first of the best) of every leak of an item into a document."""
    order = F.struct("similarity", -F.col("start"))
    best = F.max_by(F.struct("similarity", "start"), F.struct("aligned", order))
    of_kind = [F.count_distinct(F.when(F.col("aligned") == kind, F.col("start"))) for kind in (True, False)]
    return leaks(docs, benchmark).groupBy("doc_id", "item_id").agg(
        F.when(F.max("aligned"), of_kind[0]).otherwise(of_kind[1]).alias("n_windows"), best.alias("best")
    ).select("doc_id", "item_id", "n_windows", "best.similarity", "best.start")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, unchanged."""
    bad = leaks(docs, benchmark).select("key").distinct()
    return docs.join(bad, _key(docs) == bad["key"], "left_anti")
