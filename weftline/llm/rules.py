"""Quality rules: counts of repetition, and the divergence from language references.

Base counts come from white-space words. The method's verdict compares two
histograms of a document, its character classes and its common words, with the
reference of its language by Jensen-Shannon distance (base 2, 0 to 1). The
references are means over all documents of the language that pass the base
rules; a language without any uses the mean over all languages. Documents under
the minimum length are not judged by a histogram. References are a table of one
row a language, joined to the documents, so there may be any number of languages.

Nulls: a null text has no words; a null language is a language of its own.
Rows with a repeated id are judged row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches
from .shared import settle
from .textbuf import LOWER, Rolling, hash_spans, mix, spans_of, text_buffer, window_starts, word_spans

#: Frequent words of four languages.
COMMON = (
    "the of and a to in is was that for it as with be on by at this from are "
    "le la les de des et un une que qui dans en est pour pas sur au avec "
    "der die das und ein eine ist nicht zu den von mit sich auf im dem "
    "el los las del y es por con para se lo como su al"
).split()

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Character classes by leading byte; 255 marks the later bytes of a character.
CLASSES = np.full(256, 9, np.uint8)
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58] = 0, 1, 2
CLASSES[[0x20, *range(9, 14)]] = 3
CLASSES[list(b".,;:!?'\"()-")] = 4
CLASSES[list(b"#*$%&|<>@+=_~^`{}[]/\\")] = 5
CLASSES[0xC0:0xE0], CLASSES[0xE0:0xF0], CLASSES[0xF0:] = 6, 7, 8
CLASSES[0x80:0xC0] = 255
N_CLASSES = 10


@dataclass
class Settings:
    window: int = 8
    min_words: int = 20
    max_repeat_percent: int = 30
    max_class_distance: float = 0.30
    max_word_distance: float = 0.60
    min_chars: int = 200
    min_judged_words: int = 100


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether each sorted key equals the one before)."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order][1:] == keys[order][:-1]
    return order, same


def measure(column, s: Settings) -> dict[str, np.ndarray]:
    """Counts and histograms of a slice of texts."""
    buf, offsets = text_buffer(column)
    n = len(offsets) - 1
    starts, ends, word_off = word_spans(buf, offsets)
    n_words = np.diff(word_off)
    first_bytes = (buf & 0xC0) != 0x80
    inside = np.ones(len(buf), bool)
    inside[np.isin(buf, [0x20, 9, 10, 11, 12, 13])] = False
    word_chars = _per_doc(first_bytes & inside, offsets)
    n_symbols = _per_doc(SYMBOLS[buf], offsets)
    # lines with a word, equal to an earlier line of their document
    ls, le = spans_of(buf != 10, offsets)
    worded = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le = ls[worded], le[worded]
    doc = np.searchsorted(offsets, ls, side="right") - 1
    order, same = _repeats(mix(hash_spans(buf, ls, le) + mix(doc.astype(np.uint64) + np.uint64(1))))
    n_dup_lines = np.bincount(doc[order][same], minlength=n)
    # words in windows that the text holds twice
    wh = hash_spans(buf, starts, ends)
    at = window_starts(word_off, s.window)
    wdoc = np.searchsorted(word_off, at, side="right") - 1
    keys = mix(Rolling(wh).of(at, s.window) + mix(wdoc.astype(np.uint64) + np.uint64(1)))
    order, same = _repeats(keys)
    twice = same.copy()
    twice[:-1] |= same[1:]
    hit = np.zeros(len(starts) + 1, np.int64)
    begun = at[order][twice]
    np.add.at(hit, begun, 1)
    np.add.at(hit, begun + s.window, -1)
    n_repeat_words = _per_doc(np.cumsum(hit)[:-1] > 0, word_off)
    # histograms
    cls = CLASSES[buf]
    docs_of = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    real = cls != 255
    chars = np.bincount(docs_of[real] * N_CLASSES + cls[real], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    bins = word_bins(buf, starts, ends)
    of_word = np.repeat(np.arange(n, dtype=np.int64), n_words)
    k = len(COMMON) + 1
    words = np.bincount(of_word * k + bins, minlength=n * k).reshape(n, k)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat_words, "chars": chars, "words": words,
    }


_LISTED = np.frombuffer("".join(COMMON).encode(), np.uint8)
_ENDS = np.cumsum([len(w) for w in COMMON])
_COMMON_HASH = hash_spans(_LISTED, np.concatenate([[0], _ENDS[:-1]]), _ENDS)
_COMMON_ORDER = np.argsort(_COMMON_HASH)


def word_bins(buf, starts, ends) -> np.ndarray:
    """The place in COMMON of each word without its trailing punctuation, or len(COMMON)."""
    ends = ends - np.isin(buf[ends - 1], list(b".,;:!?")) * (ends - starts > 1)
    short = np.flatnonzero(ends - starts <= 8)
    out = np.full(len(starts), len(COMMON))
    h = hash_spans(LOWER[buf], starts[short], ends[short])
    sorted_hash = _COMMON_HASH[_COMMON_ORDER]
    at = np.minimum(np.searchsorted(sorted_hash, h), len(COMMON) - 1)
    found = sorted_hash[at] == h
    out[short[found]] = _COMMON_ORDER[at[found]]
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of rows of histograms; a row without counts has distance 0."""
    total = p.sum(1, keepdims=True)
    p = np.divide(p, total, out=np.zeros_like(p, dtype=np.float64), where=total > 0)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum((a + b) / 2, 0)), 0.0)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(docs: DataFrame, s: Settings) -> DataFrame:
    """One row for each row of docs: id, lang, counts and both histograms."""
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["lang"].cast("string"), F.lit("\0null")).alias("lang"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
    )

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            m = measure(batch.column("text"), s)
            cols = [batch.column("doc_id"), batch.column("lang"), *(pa.array(m[c], pa.int64()) for c in _COUNTS)]
            cols += [pa.array(list(m[c].astype(np.int32)), pa.list_(pa.int32())) for c in ("chars", "words")]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "lang", *_COUNTS, "chars", "words"])

        return work

    schema = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", chars array<int>, words array<int>"
    return rows.mapInArrow(batches.each_slice(make), schema)


def base_failed(s: Settings):
    return (F.col("n_words") < s.min_words) | (100 * F.col("n_repeat_words") > s.max_repeat_percent * F.col("n_words"))


def _matrix(column, k: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, k)


WIDTH = N_CLASSES + len(COMMON) + 1


def references(rows: DataFrame, s: Settings) -> tuple[DataFrame, list[float]]:
    """(lang and ref, the mean normalised histograms, of each language; the same over all). Each task gives one row a language and bin."""

    def partial(it):
        sums: dict[str, np.ndarray] = {}

        def flush():
            for lang, v in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([v], pa.list_(pa.float64()))], ["lang", "v"])
            sums.clear()

        for batch in it:
            h = [_matrix(batch.column(c), k) for c, k in (("chars", N_CLASSES), ("words", len(COMMON) + 1))]
            h = np.hstack([x / np.maximum(x.sum(1, keepdims=True), 1) for x in h] + [np.ones((batch.num_rows, 1))])
            langs, of = np.unique(np.asarray(batch.column("lang")).astype(str), return_inverse=True)
            for i, lang in enumerate(langs.tolist()):
                sums[lang] = sums.get(lang, 0) + h[of == i].sum(0)
            if len(sums) > 4096:  # bounds what a task holds; sums of one language are added below
                yield from flush()
        yield from flush()

    sums = rows.where(~base_failed(s)).select("lang", "chars", "words").mapInArrow(partial, "lang string, v array<double>")
    at = [F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(WIDTH + 1)]
    table = sums.groupBy("lang").agg(*at)
    mean = F.array(*[F.col(f"v{i}") / F.greatest(F.col(f"v{WIDTH}"), F.lit(1.0)) for i in range(WIDTH)])
    every = table.agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(WIDTH + 1)]).select(mean.alias("ref")).first()["ref"]
    return table.select("lang", mean.alias("ref")), [0.0 if x is None else x for x in every]


def judge(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, both distances and kept, for every row of docs. An empty table gives none."""
    s = settings or Settings()
    rows = settle(features(docs, s))
    refs, every = references(rows, s)
    spare = np.array(every)

    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            column = batch.column("ref")
            there = np.asarray(column.is_valid())
            ref = np.tile(spare, (batch.num_rows, 1))
            ref[there] = np.asarray(column.drop_null().flatten(), dtype=np.float64).reshape(-1, WIDTH)
            dc = js_distance(_matrix(batch.column("chars"), N_CLASSES), ref[:, :N_CLASSES])
            dw = js_distance(_matrix(batch.column("words"), len(COMMON) + 1), ref[:, N_CLASSES:])
            blank = ref.sum(1) == 0
            dc[blank], dw[blank] = 0, 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", *_COUNTS)] + [pa.array(dc), pa.array(dw)], ["doc_id", *_COUNTS, "class_distance", "word_distance"]
            )

    # a few languages hold most rows: the join is broadcast where Spark finds the references small, and else split by adaptive execution
    judged = rows.join(refs, "lang", "left").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", class_distance double, word_distance double")
    odd = ((F.col("word_chars") >= s.min_chars) & (F.col("class_distance") > s.max_class_distance)) | (
        (F.col("n_words") >= s.min_judged_words) & (F.col("word_distance") > s.max_word_distance)
    )
    return judged.select("doc_id", *_COUNTS, base_failed(s).alias("base_failed"), (~base_failed(s) & ~odd).alias("kept"), "class_distance", "word_distance")
