"""Exact removal of repeated word sequences by fixed-block anchors.

A window is ``window`` consecutive words. Every document's non-overlapping
blocks of ``window // 2`` words are indexed, and every rolling window of that
size probes the index: a repeated window contains a whole block of the other
text, so each repeat is hit. Around the hits, every window that contains one is
compared in full, which extends hits to their maximal repeats, window by
window. A word goes where a window that covers it also starts in a document
with a smaller id.

Words are runs of anything but space and the control characters 9 to 13.
Nulls: a null text has no words; a null id counts as larger than any other, and
rows without an id, like rows of one id, are no smaller than each other.
Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import buckets
from .textbuf import Rolling, hash_spans, text_buffer, window_starts, word_spans

WINDOW = 50
NO_ID = np.iinfo(np.int64).max


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


class _Words:
    """The words of a bucket, hashed, and the distinct keys of its rolling anchors."""

    def __init__(self, table: pa.Table, window: int):
        self.buf, offsets = text_buffer(table["text"])
        starts, ends, self.first = word_spans(self.buf, offsets)
        self.rolling = Rolling(hash_spans(self.buf, starts, ends))
        self.n = len(starts)
        ids = table["doc_id"].fill_null(NO_ID) if table["doc_id"].null_count else table["doc_id"]
        self.ids = np.asarray(ids, dtype=np.int64)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1

    def anchors(self, size: int):
        """(positions, their order by key, distinct keys, where each begins in that order)."""
        at = window_starts(self.first, size)
        keys = self.rolling.of(at, size)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        begin = np.flatnonzero(new)
        return at, order, keys[begin], begin


def _probe(table: pa.Table, b: int, window: int, n: int) -> pa.Table:
    w = _Words(table, window)
    size = window // 2
    at, order, keys, begin = w.anchors(size)
    if not len(keys):
        return buckets.send(b, keys, n, lambda s: b"")
    block = (at - w.first[w.doc_of(at)]) % size == 0
    is_block = np.logical_or.reduceat(block[order], begin)
    many = np.diff(np.append(begin, len(at))) > 1
    low = keys.astype(np.uint32)
    return buckets.send(b, keys, n, lambda s: low[s].tobytes() + _bits(np.concatenate([many[s], is_block[s]])))


def _hits(payloads: list[bytes]) -> list[bytes]:
    """Which keys are a block somewhere and occur twice."""
    lows, many, block = [], [], []
    for p in payloads:
        # n keys take 4n bytes and 2n bits
        n = len(p) * 8 // 34
        while 4 * n + (2 * n + 7) // 8 < len(p):
            n += 1
        lows.append(np.frombuffer(p, np.uint32, n))
        f = _flags(p[4 * n :], 2 * n)
        many.append(f[:n])
        block.append(f[n:])
    sizes = [len(x) for x in lows]
    low, many, block = np.concatenate(lows), np.concatenate(many), np.concatenate(block)
    order = np.argsort(low, kind="stable")
    low = low[order]
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    begin = np.flatnonzero(new)
    hit = (np.add.reduceat(1 + many[order], begin) > 1) & np.logical_or.reduceat(block[order], begin)
    out = np.zeros(len(low), bool)
    out[order] = np.repeat(hit, np.diff(np.append(begin, len(low))))
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    return [np.uint32(n).tobytes() + _bits(out[lo : lo + n]) for lo, n in zip(cuts, sizes)]


def _extend(table: pa.Table, b: int, got: pa.Table, window: int, n: int) -> pa.Table:
    """Keys of the full windows around hits, each with the smallest id in the bucket and whether a larger one has it too."""
    w = _Words(table, window)
    size = window // 2
    at, order, keys, begin = w.anchors(size)
    hit = np.concatenate([np.zeros(0, bool), *(_flags(p[4:], int(np.frombuffer(p, np.uint32, 1)[0])) for p in buckets.answers(got))])
    on = np.zeros(w.n + size + 2, np.int64)
    if len(at):
        on[at[order]] = np.repeat(hit, np.diff(np.append(begin, len(at))))
    seen = np.concatenate([[0], np.cumsum(on)])
    full = window_starts(w.first, window)
    full = full[seen[full + window - size + 1] > seen[full]]
    if not len(full):
        return buckets.send(b, np.zeros(0, np.uint64), n, lambda s: b"")
    keys, ids = w.rolling.of(full, window), w.ids[w.doc_of(full)]
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(keys)) - 1
    least, more, keys = ids[begin], ids[last] > ids[begin], keys[begin]
    return buckets.send(b, keys, n, lambda s: keys[s].tobytes() + least[s].tobytes() + more[s].tobytes())


def _smallest(payloads: list[bytes]) -> list[bytes]:
    """For each bucket, the keys that a smaller id has than some id of the bucket, with the smallest id of all."""
    sizes = [len(p) // 17 for p in payloads]
    keys = np.concatenate([np.frombuffer(p, np.uint64, n) for p, n in zip(payloads, sizes)])
    least = np.concatenate([np.frombuffer(p, np.int64, n, 8 * n) for p, n in zip(payloads, sizes)])
    more = np.concatenate([np.frombuffer(p, bool, n, 16 * n) for p, n in zip(payloads, sizes)])
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    begin = np.flatnonzero(new)
    smallest = np.empty_like(least)
    smallest[order] = np.repeat(np.minimum.reduceat(least[order], begin), np.diff(np.append(begin, len(keys))))
    tell = more | (smallest < least)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for lo, n in zip(cuts, sizes):
        t = np.flatnonzero(tell[lo : lo + n]) + lo
        out.append(keys[t].tobytes() + smallest[t].tobytes())
    return out


def _removed(table: pa.Table, got: pa.Table, window: int) -> tuple[_Words, np.ndarray]:
    """The bucket's words, and which of them go."""
    w = _Words(table, window)
    pairs = [(np.frombuffer(p, np.uint64, len(p) // 16), np.frombuffer(p, np.int64, len(p) // 16, len(p) // 2)) for p in buckets.answers(got)]
    gone = np.zeros(w.n + 1, np.int64)
    if pairs:
        keys, least = np.concatenate([k for k, _ in pairs]), np.concatenate([i for _, i in pairs])
        at = window_starts(w.first, window)
        if len(keys) and len(at):
            own = w.rolling.of(at, window)
            i = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            bad = at[(keys[i] == own) & (least[i] < w.ids[w.doc_of(at)])]
            np.add.at(gone, bad, 1)
            np.add.at(gone, bad + window, -1)
    return w, np.cumsum(gone)[:-1] > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = True, bucket_bytes: int = buckets.BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and with ``texts`` the kept words as kept_text, for every row of docs."""
    rows, n, _ = buckets.dealt(docs, bucket_bytes)
    hits = buckets.exchange(buckets.each(rows, lambda b, t: _probe(t, b, window, n), buckets.SENT), _hits)
    sent = buckets.each_with(rows, hits, lambda b, t, got: _extend(t, b, got, window, n), buckets.SENT)
    least = buckets.exchange(sent, _smallest)

    def finish(b: int, table: pa.Table, got: pa.Table) -> pa.Table:
        w, gone = _removed(table, got, window)
        lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
        digests, kept_texts = [], []
        for i, text in enumerate(table["text"].to_pylist()):
            kept = text.encode().split()
            if lost[i]:
                kept = [x for x, g in zip(kept, gone[w.first[i] : w.first[i + 1]].tolist()) if not g]
            line = b" ".join(kept)
            digests.append(hashlib.sha256(line).hexdigest())
            if texts:
                kept_texts.append(line.decode())
        out = {"doc_id": table["doc_id"], "n_words": pa.array(np.diff(w.first)), "n_removed": pa.array(lost), "kept_sha256": pa.array(digests)}
        return pa.table(out | ({"kept_text": pa.array(kept_texts, pa.string())} if texts else {}))

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    return buckets.each_with(rows, least, finish, schema)
