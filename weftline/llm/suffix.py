"""Exact removal of repeated byte strings by prefix-free parsing.

A rolling hash of eight bytes makes about one place in 48 a trigger, and
triggers cut a document into phrases that overlap by those eight bytes. Equal
strings have equal triggers, so a repeat consists of equal whole phrases but
for a part of one at each end.

1. Dictionary: the phrases that occur at least twice, compared by their bytes
   and sorted; a phrase's place in that order is its rank. A phrase that occurs
   once ends every repeat, so it needs no rank.
2. Parse: its suffixes, as ranks, each as far as ``window`` bytes behind its
   first phrase or to a phrase that occurs once, are sorted in range partitions.
   That is the corpus order of the text from triggers on, and neighbours in it
   tell how far each suffix recurs in whole phrases. Equal suffixes count once.
3. Ends: the windows of one first and one last trigger have the same whole
   phrases inside. Where those recur with different phrases around them, a
   repeat ends within a phrase, and instead of sorting all suffixes of the
   dictionary, one row a byte, just these windows are compared one by one by
   96-bit hashes, and so are windows with less than two triggers.

A bucket (see buckets.py) sends each phrase, suffix, group and window at most once, so
highly repetitive text costs a rank a phrase, and no key is hot.

Eight bytes of a period up to four are no trigger, so that no run of one
character becomes a phrase a byte.

Nulls: a null text is an empty one. Rows of equal id or without an id are
documents of their own. Positions and lengths are UTF-8 bytes. An empty table
gives none; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches, buckets
from .shared import settle
from .textbuf import Rolling, classes, hash_spans, members, mix, spans_of, spread, text_buffer

WINDOW, TRIGGER, RATE = 400, 8, 48
#: Bytes of a rank, and the partitions that the dictionary is sorted in at most.
RANK, PARTITIONS = 6, 1 << 15
#: Kinds of what comes back to a bucket.
RANKS, SUFFIXES, COUNTS, GROUPS, WINDOWS = range(5)
INSIDE = WINDOW - TRIGGER  # a trigger is in a window that begins at most so many bytes before it
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
SLICE = 1 << 20


def _triggers(buf: np.ndarray, offsets: np.ndarray, rolling: Rolling) -> np.ndarray:
    n = len(buf) - TRIGGER + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    limit = np.uint64((1 << 64) // RATE)
    found = []
    for lo in range(0, n, 1 << 15):  # blocks that stay in the cache
        at = slice(lo, min(lo + (1 << 15), n))
        h = (rolling.sums[at.start + TRIGGER : at.stop + TRIGGER] - rolling.sums[at]) * rolling.back[at]
        found.append(np.flatnonzero(h < limit) + lo)
    t = np.concatenate(found)
    doc = np.searchsorted(offsets, t, side="right") - 1
    t = t[t + TRIGGER <= offsets[doc + 1]]
    eight = buf[t[:, None] + np.arange(TRIGGER)]
    for period in range(1, 5):
        keep = (eight[:, period:] != eight[:, :-period]).any(1)
        t, eight = t[keep], eight[keep]
    return t


class Parse:
    """The phrases of a slice of documents: triggers, starts, ends, documents, and 128-bit names; of last ones, that nothing follows."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets = buf, offsets
        values = _VALUES[buf]
        rolling = Rolling(values)
        self.t = _triggers(buf, offsets, rolling)
        starts = np.sort(np.concatenate([offsets[:-1][np.diff(offsets) > 0], self.t]), kind="stable")
        self.starts = starts[np.append(starts[1:] != starts[:-1], True)[: len(starts)]]
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        new = np.concatenate([[True], self.doc[1:] != self.doc[:-1]]) if len(self.doc) else np.zeros(0, bool)
        self.first, self.last = new, np.append(new[1:], True)[: len(new)]
        self.ends = np.where(self.last, offsets[self.doc + 1], np.append(self.starts[1:], 0)[: len(new)] + TRIGGER)
        size = self.ends - self.starts
        salt = size.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        self.hi = mix(rolling.of(self.starts, size) + salt)
        self.lo = hash_spans(buf, self.starts, self.ends)

    def keys(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each window."""
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        values = _VALUES[self.buf]
        return Rolling(values).of(starts, WINDOW), Rolling(values, 1).of(starts, WINDOW)


def _parsed(table: pa.Table):
    column = table["text"].combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    for lo, hi in batches.slices(batches.byte_sizes(column), SLICE):
        yield Parse(*text_buffer(column.slice(lo, hi - lo)))


def _cat(parts, kind=np.uint64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


class _Phrases:
    """The parse of a bucket, and each slice's phrases as places among the distinct ones."""

    def __init__(self, table: pa.Table):
        self.parses = list(_parsed(table))
        hi = _cat(p.hi for p in self.parses)
        self.order, self.begin = classes(hi, _cat(p.lo for p in self.parses))
        self.n = len(self.begin)
        place = spread(np.arange(self.n), self.order, self.begin)
        self.cuts = np.concatenate([[0], np.cumsum([len(p.hi) for p in self.parses])]).astype(np.int64)
        self.places = [place[a:b] for a, b in zip(self.cuts, self.cuts[1:])]
        self.keys = hi[self.order[self.begin]] if self.n else np.zeros(0, np.uint64)
        self.many = members(self.order, self.begin) > 1

    def word(self, j: int) -> bytes:
        i = int(self.order[self.begin[j]])
        s = int(np.searchsorted(self.cuts, i, side="right")) - 1
        p, i = self.parses[s], i - int(self.cuts[s])
        return p.buf[p.starts[i] : p.ends[i]].tobytes()


def _send_names(table: pa.Table, b: int, n: int) -> pa.Table:
    x = _Phrases(table)
    return buckets.send(b, x.keys, n, lambda s: x.keys[s].tobytes() + x.many[s].tobytes())


def _packed(flags: np.ndarray, sizes: list[int]) -> list[bytes]:
    cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return [np.uint32(n).tobytes() + np.packbits(flags[lo : lo + n]).tobytes() for lo, n in zip(cuts, sizes)]


def _twice(payloads: list[bytes], more: bool = False) -> list[bytes]:
    """Of 64-bit keys, with ``more`` of 96 bits, each with whether its bucket has it twice: which occur twice in all."""
    width = 8 + 4 * more + 1
    sizes = [len(p) // width for p in payloads]
    hi = _cat(np.frombuffer(p, np.uint64, n) for p, n in zip(payloads, sizes))
    lo = _cat((np.frombuffer(p, np.uint32, n, 8 * n) for p, n in zip(payloads, sizes)), np.uint32) if more else hi
    many = _cat((np.frombuffer(p, bool, n, (width - 1) * n) for p, n in zip(payloads, sizes)), bool)
    order, begin = classes(hi, lo)
    twice = spread(np.add.reduceat(1 + many[order], begin) > 1, order, begin) if len(begin) else np.zeros(0, bool)
    return _packed(twice, sizes)


def _flags(got: pa.Table) -> np.ndarray:
    return _cat([np.unpackbits(np.frombuffer(p, np.uint8, -1, 4), count=int(np.frombuffer(p, np.uint32, 1)[0])).astype(bool) for p in buckets.answers(got)], bool)


def _words(table: pa.Table, b: int, got: pa.Table) -> pa.Table:
    """The bucket's phrases that occur twice in the corpus, by their place among its distinct ones."""
    x = _Phrases(table)
    j = np.flatnonzero(_flags(got))
    return pa.table({"b": pa.array(np.full(len(j), b), pa.int32()), "i": pa.array(j, pa.int32()), "word": pa.array([x.word(k) for k in j.tolist()], pa.binary())})


class _Suffixes:
    """The suffixes of a bucket's parse, as ranks; equal ones are one class."""

    def __init__(self, table: pa.Table, marks: pa.Table):
        x = _Phrases(table)
        rank = np.full(x.n, -1, np.int64)
        rank[np.asarray(marks["i"], dtype=np.int64)] = np.asarray(marks["v"], dtype=np.int64)
        self.parses = x.parses
        self.at, self.size, self.ranks, hi, lo = [], [], [], [], []
        for p, place in zip(x.parses, x.places):
            r = rank[place]
            at = np.flatnonzero(r >= 0)
            stops = np.append(np.flatnonzero(r < 0), len(r))
            until = stops[np.searchsorted(stops, at)]
            edges = np.append(np.flatnonzero(p.last) + 1, len(r))
            until = np.minimum(until, edges[np.searchsorted(edges, at, side="right")])
            behind = np.where(p.last, p.ends, p.ends - TRIGGER)[at]
            until = np.minimum(until, np.searchsorted(p.ends, behind + WINDOW) + 1)
            size = until - at
            values = mix(r.astype(np.uint64) + np.uint64(1))
            hi.append(Rolling(values).of(at, size)), lo.append(Rolling(values, 1).of(at, size))
            self.at.append(at), self.size.append(size), self.ranks.append(r)
        self.order, self.begin = classes(_cat(hi), _cat(lo))
        self.cuts = np.concatenate([[0], np.cumsum([len(a) for a in self.at])]).astype(np.int64)

    def rows(self, b: int) -> pa.Table:
        """One row for each class, with the ranks of its first member, written so that bytes sort as ranks do."""
        first = self.order[self.begin]
        which = np.searchsorted(self.cuts, first, side="right") - 1
        ranks, at, size = _cat(self.ranks, np.int64), _cat(self.at, np.int64), _cat(self.size, np.int64)[first]
        skipped = np.concatenate([[0], np.cumsum([len(r) for r in self.ranks])]).astype(np.int64)
        member, step = _ragged(size)
        flat = ranks[(at[first] + skipped[which])[member] + step].astype(">i8").view(np.uint8).reshape(-1, 8)[:, 8 - RANK :].tobytes()
        offsets = np.concatenate([[0], np.cumsum(size * RANK)]).astype(np.int32)
        return pa.table({
            "b": pa.array(np.full(len(first), b), pa.int32()), "i": pa.array(np.arange(len(first)), pa.int32()),
            "ranks": pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat)]),
            "n": pa.array(members(self.order, self.begin), pa.int64()),
        })


def _common(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of each list and the next: the number of equal first values."""
    if len(off) < 3:
        return np.zeros(max(0, len(off) - 2), np.int64)
    size = np.diff(off)
    least = np.minimum(size[:-1], size[1:])
    cut = np.concatenate([[0], np.cumsum(least)])
    step = np.arange(int(cut[-1])) - np.repeat(cut[:-1], least)
    differ = flat[np.repeat(off[:-2], least) + step] != flat[np.repeat(off[1:-1], least) + step]
    first = np.append(np.flatnonzero(differ), len(differ))
    return np.minimum(first[np.searchsorted(first, cut[:-1])] - cut[:-1], least)


def _values(raw: bytes) -> np.ndarray:
    """The ranks written in some bytes."""
    out = np.zeros((len(raw) // RANK, 8), np.uint8)
    out[:, 8 - RANK :] = np.frombuffer(raw, np.uint8).reshape(-1, RANK)
    return out.view(">i8")[:, 0].astype(np.int64)


def recurring(suffixes: DataFrame, partitions: int) -> DataFrame:
    """b, i and v, the number of first phrases that recur, of each suffix: its own length if it occurs twice, else from its neighbours in order.

    Neighbours in other partitions are the last and first suffix of these; two rows a partition come to the driver.
    A suffix has a place (b, i) at most once a bucket.
    """
    counted = suffixes.groupBy("ranks").agg(F.sum("n").alias("n"), F.collect_list(F.struct("b", "i")).alias("at"))
    order = settle(counted.repartitionByRange(partitions, "ranks").sortWithinPartitions("ranks").withColumn("p", F.spark_partition_id()))

    def ends(it):
        first = last = None
        for batch in it:
            if batch.num_rows:
                first = first or batch.slice(0, 1)
                last = batch.slice(batch.num_rows - 1, 1)
        if first is not None:
            yield first
            yield last

    by_part: dict[int, list[bytes]] = {}
    for r in order.select("p", "ranks").mapInArrow(ends, "p int, ranks binary").collect():
        by_part.setdefault(r["p"], []).append(bytes(r["ranks"]))
    parts = sorted(by_part)
    before = {p: max(by_part[q]) for q, p in zip(parts, parts[1:])}
    behind = {p: min(by_part[q]) for p, q in zip(parts, parts[1:])}

    def neighbours(it):
        held: pa.RecordBatch | None = None
        previous = b""

        def done(batch: pa.RecordBatch, nxt: bytes):
            lists = [previous, *batch.column("ranks").to_pylist(), nxt]
            size = np.array([len(x) // RANK for x in lists], dtype=np.int64)
            shared = _common(_values(b"".join(lists)), np.concatenate([[0], np.cumsum(size)]))
            v = np.maximum(shared[:-1], shared[1:])
            v = np.where(np.asarray(batch.column("n")) > 1, size[1:-1], v)
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), batch.column("at")], ["v", "at"]).filter(pa.array(v > 0))

        for batch in it:
            if not batch.num_rows:
                continue
            if held is None:
                previous = before.get(batch.column("p")[0].as_py(), b"")
            else:
                yield done(held, batch.column("ranks")[0].as_py())
                previous = held.column("ranks")[held.num_rows - 1].as_py()
            held = batch
        if held is not None:
            yield done(held, behind.get(held.column("p")[0].as_py(), b""))

    found = order.mapInArrow(neighbours, "v long, at array<struct<b:int,i:int>>")
    return found.select("v", F.explode("at").alias("x")).select("x.b", "x.i", "v")


def _ragged(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, how manieth) of n[i] members each."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


class _Groups:
    """The windows of a slice by first and last trigger: ranges of starts, and names of the phrases inside and with those around.

    Only groups whose inner phrases recur in this order; ``always`` holds the ranges of windows with less than two triggers.
    """

    def __init__(self, p: Parse, n: np.ndarray):
        t, offsets = p.t, p.offsets
        doc = np.searchsorted(offsets, t, side="right") - 1
        last = offsets[doc + 1] - WINDOW
        begins = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(t) else np.zeros(0, bool)
        lo = np.where(begins, offsets[doc], np.append(0, t[:-1] + 1)[: len(t)])
        # without a trigger: before each, and behind the last one of a document
        final = offsets[:-1].copy()
        np.maximum.at(final, doc, t + 1)
        bare = [(lo, np.minimum(t - INSIDE - 1, last)), (final, offsets[1:] - WINDOW)]
        lo, hi = np.maximum(lo, t - INSIDE), np.minimum(t, last)
        i = np.flatnonzero(lo <= hi)
        m_lo = np.searchsorted(t, lo[i] + INSIDE, side="right") - 1
        m_hi = np.searchsorted(t, hi[i] + INSIDE, side="right") - 1
        which, step = _ragged(m_hi - m_lo + 1)
        i, m = i[which], m_lo[which] + step
        after = np.append(t[1:], len(p.buf) + WINDOW)[m]
        lo, hi = np.maximum(lo[i], t[m] - INSIDE), np.minimum(hi[i], after - INSIDE - 1)
        one = i == m
        bare.append((lo[one], hi[one]))
        self.always = tuple(np.concatenate(x) for x in zip(*bare))
        phrase = np.searchsorted(p.starts, t[i])
        ok = ~one & (lo <= hi) & (n[phrase] >= m - i)
        k, size, self.lo, self.hi = phrase[ok], (m - i)[ok], lo[ok], hi[ok]
        rolling = Rolling(p.hi)
        self.inner = mix(rolling.of(k, size) + size.astype(np.uint64))
        before = np.where(p.first[k], 0, 1)
        around = np.where(p.first[k], np.uint64(0x5C5C5C5C5C5C5C5C), np.uint64(0))
        self.outer = mix(rolling.of(k - before, size + 1 + before) ^ around)


def _counts(table: pa.Table, got: pa.Table) -> list[tuple[Parse, np.ndarray]]:
    """Of each slice the parse, and how many phrases recur together from each on, from ranks and recurring suffixes."""
    kind = np.asarray(got["kind"])
    x = _Suffixes(table, got.filter(pa.array(kind == RANKS)))
    told = got.filter(pa.array(kind == SUFFIXES))
    v = np.zeros(len(x.begin), np.int64)
    v[np.asarray(told["i"], dtype=np.int64)] = np.asarray(told["v"], dtype=np.int64)
    v = spread(v, x.order, x.begin)
    out = []
    for p, at, a, b in zip(x.parses, x.at, x.cuts, x.cuts[1:]):
        n = np.zeros(len(p.starts), np.int64)
        n[at] = v[a:b]
        out.append((p, n))
    return out


def _unpacked(table: pa.Table, got: pa.Table) -> list[tuple[Parse, np.ndarray]]:
    """The same, from the packed counts that _send_groups has written."""
    (packed,) = got.filter(pa.array(np.asarray(got["kind"]) == COUNTS))["payload"].to_pylist()
    n, at, out = np.frombuffer(zlib.decompress(packed), np.uint16).astype(np.int64), 0, []
    for p in _parsed(table):
        out.append((p, n[at : at + len(p.starts)]))
        at += len(p.starts)
    return out


class _Marked:
    """The groups of a bucket's windows, and their distinct inner names."""

    def __init__(self, slices: list[tuple[Parse, np.ndarray]]):
        self.slices = slices
        self.groups = [_Groups(p, n) for p, n in self.slices]
        inner = _cat(g.inner for g in self.groups)
        outer = _cat(g.outer for g in self.groups)
        self.cuts = np.concatenate([[0], np.cumsum([len(g.inner) for g in self.groups])]).astype(np.int64)
        self.order, self.begin = classes(inner, inner)
        self.inner = inner[self.order[self.begin]] if len(inner) else inner
        if len(inner):
            self.least = np.minimum.reduceat(outer[self.order], self.begin)
            self.mixed = np.maximum.reduceat(outer[self.order], self.begin) != self.least
        else:
            self.least, self.mixed = inner, np.zeros(0, bool)

    def open(self, mixed: np.ndarray):
        """Of each slice the starts of windows to compare; mixed: of each distinct inner name, whether different phrases are around it."""
        mixed = spread(mixed, self.order, self.begin)
        for (p, _), g, a, b in zip(self.slices, self.groups, self.cuts, self.cuts[1:]):
            on = mixed[a:b]
            lo, hi = np.concatenate([g.lo[on], g.always[0]]), np.concatenate([g.hi[on], g.always[1]])
            which, step = _ragged(np.maximum(hi - lo + 1, 0))
            yield np.unique(lo[which] + step)

    @staticmethod
    def runs(p: Parse, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the recurring runs of whole phrases."""
        k = np.flatnonzero(n)
        return p.starts[k], p.ends[k + n[k] - 1]


def _send_groups(table: pa.Table, b: int, got: pa.Table, n: int) -> pa.Table:
    """Inner names for their owners, and for the bucket itself the counts of its phrases."""
    x = _Marked(_counts(table, got))
    sent = buckets.send(b, x.inner, n, lambda s: x.inner[s].tobytes() + x.least[s].tobytes() + x.mixed[s].tobytes())
    counts = _cat((k for _, k in x.slices), np.int64)
    # a count over 65535 would be of phrases of a byte each; less is told than is so, and such windows are compared
    own = zlib.compress(np.minimum(counts, 65535).astype(np.uint16).tobytes(), 1)
    return pa.concat_tables([sent, buckets.sent_rows(b, np.array([-1]), [own])])


def _mixed(payloads: list[bytes]) -> list[bytes]:
    """Which inner names have different phrases around them."""
    sizes = [len(p) // 17 for p in payloads]
    inner, least = (_cat(np.frombuffer(p, np.uint64, n, 8 * n * w) for p, n in zip(payloads, sizes)) for w in (0, 1))
    mixed = _cat((np.frombuffer(p, bool, n, 16 * n) for p, n in zip(payloads, sizes)), bool)
    order, begin = classes(inner, inner)
    if len(begin):
        u = least[order]
        differ = np.minimum.reduceat(u, begin) != np.maximum.reduceat(u, begin)
        mixed = spread(differ | np.logical_or.reduceat(mixed[order], begin), order, begin)
    return _packed(mixed, sizes)


def _told(got: pa.Table, kind: int) -> np.ndarray:
    """The flags that the owners of keys have sent, in the order of the keys."""
    answers = got.filter(pa.array(np.asarray(got["kind"]) == kind))
    return _flags(pa.table({"part": answers["i"], "payload": answers["payload"]}))


def _send_windows(table: pa.Table, b: int, got: pa.Table, n: int) -> pa.Table:
    x = _Marked(_unpacked(table, got))
    keys = [p.keys(starts) for (p, _), starts in zip(x.slices, x.open(_told(got, GROUPS)))]
    hi, lo = (_cat(k[w] for k in keys) for w in (0, 1))
    order, begin = classes(hi, lo)
    many, first = members(order, begin) > 1, order[begin]
    hi, lo = hi[first], lo[first]
    lo = lo.astype(np.uint32)
    return buckets.send(b, hi, n, lambda s: hi[s].tobytes() + lo[s].tobytes() + many[s].tobytes())


def remove_repeats(docs: DataFrame, texts: bool = True, bucket_bytes: int = buckets.BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, longest_run, and with ``texts`` the kept bytes as kept (binary), for every row of docs.

    longest_run: bytes of the longest run of whole phrases that occurs elsewhere as well, also where it is shorter than a window.
    """
    rows, n, total = buckets.dealt(docs, bucket_bytes)
    partitions = min(PARTITIONS, max(1, -(-total // (64 << 20))))
    send = lambda work, more: buckets.each_with(rows, more, work, buckets.SENT)
    back = lambda df, kind: df.selectExpr("b", f"{kind} AS kind", "part AS i", "CAST(NULL AS LONG) AS v", "payload")
    place = lambda df, kind: df.selectExpr("b", f"{kind} AS kind", "i", "v", "CAST(NULL AS BINARY) AS payload")

    names = buckets.exchange(buckets.each(rows, lambda b, t: _send_names(t, b, n), buckets.SENT), _twice)
    words = buckets.each_with(rows, names, lambda b, t, got: _words(t, b, got), "b int, i int, word binary")
    # a phrase has a place at most once a bucket
    dictionary = words.groupBy("word").agg(F.collect_list(F.struct("b", "i")).alias("at")).repartitionByRange(partitions, "word").sortWithinPartitions("word")
    ranked = dictionary.withColumn("v", F.monotonically_increasing_id())
    ranks = settle(place(ranked.select("v", F.explode("at").alias("x")).select("x.b", "x.i", "v"), RANKS))
    suffixes = buckets.each_with(rows, ranks, lambda b, t, got: _Suffixes(t, got).rows(b), "b int, i int, ranks binary, n long")
    told = ranks.unionByName(place(recurring(suffixes, partitions), SUFFIXES))
    sent = settle(send(lambda b, t, got: _send_groups(t, b, got, n), told))
    counts = back(sent.where("owner = -1").withColumnRenamed("owner", "part"), COUNTS)
    known = counts.unionByName(back(buckets.exchange(sent.where("owner >= 0"), _mixed), GROUPS))
    windows = buckets.exchange(send(lambda b, t, got: _send_windows(t, b, got, n), known), lambda ps: _twice(ps, more=True))
    known = known.unionByName(back(windows, WINDOWS))

    def finish(b: int, table: pa.Table, got: pa.Table) -> pa.Table:
        state = _Marked(_unpacked(table, got))
        starts_of = list(state.open(_told(got, GROUPS)))
        keys = [p.keys(starts) for (p, _), starts in zip(state.slices, starts_of)]
        twice = spread(_told(got, WINDOWS), *classes(_cat(k[0] for k in keys), _cat(k[1] for k in keys)))
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in starts_of])]).astype(np.int64)
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "longest_run": [], "kept": []}
        for (p, count), starts, lo, hi in zip(state.slices, starts_of, cuts, cuts[1:]):
            buf, off = p.buf, p.offsets
            gone = np.zeros(len(buf) + 1, np.int64)
            bad = starts[twice[lo:hi]]
            np.add.at(gone, bad, 1)
            np.add.at(gone, bad + WINDOW, -1)
            s, e = state.runs(p, count)
            long = e - s >= WINDOW
            np.add.at(gone, s[long], 1)
            np.add.at(gone, e[long], -1)
            gone = np.cumsum(gone)[:-1] > 0
            longest = np.zeros(len(off) - 1, np.int64)
            np.maximum.at(longest, np.searchsorted(off, s, side="right") - 1, e - s)
            begins, _ = spans_of(gone, off)
            lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[off])
            for i in range(len(off) - 1):
                own = buf[off[i] : off[i + 1]]
                kept = (own[~gone[off[i] : off[i + 1]]] if lost[i] else own).tobytes()
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if texts:
                    out["kept"].append(kept)
            out["n_bytes"] += np.diff(off).tolist()
            out["n_removed"] += lost.tolist()
            out["n_spans"] += np.diff(np.searchsorted(begins, off)).tolist()
            out["longest_run"] += longest.tolist()
        kinds = {"kept_sha256": pa.string(), "kept": pa.binary()}
        cols = {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items() if texts or k != "kept"}
        return pa.table({"doc_id": table["doc_id"]} | cols)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, longest_run long" + ", kept binary" * texts
    return buckets.each_with(rows, known, finish, schema)
