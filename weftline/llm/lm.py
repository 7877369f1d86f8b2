"""Language-model scoring: a word-unigram base and a causal self-attention model.

Texts are lower-cased (A-Z) and cut into words. The base counts all words of
all training documents and scores a text by add-0.1 smoothing. The model reads
subword ids: each word, with a blank before it, is cut by longest match into
the first ``subwords`` - 1 pieces of a public byte-level vocabulary; the last
id ends, and begins, a text. It learns from the whole of all training documents:
counts of each subword after a context, and for the attention, windows that
cover every text, each once. In each round of training, tasks go on from common
weights over their part of the round's windows, and the weights are averaged.
The parts are the buckets that texts are read in, so another size of buckets
changes scores a little; the tests say how much.

``attention_score`` is the attention model's alone. In ``score`` it stands in
for the part of a distribution over words that absolute discounting takes off
the word counts: a word has (count - DISCOUNT) / tokens and, of the share taken
off, what the attention model gives the word's subwords after all before.

Nulls: a null text is an empty one, whose only token is the end. A null id
hashes as the text ''. Without training documents the counts are zero, and the
model is uniform.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention, batches, buckets
from .shared import settle
from .textbuf import Rolling, hash_spans, mix, sorted_order, text_buffer, word_spans

SUBWORDS, FOLDS, BUCKET_BYTES = 1024, 10, buckets.BUCKET_BYTES
#: What is taken off each word's count and given to the attention model.
DISCOUNT = 0.5
#: Rounds of training; each takes one of so many windows.
ROUNDS = 1
#: Longest piece in bytes.
LONGEST = 6
SPAN = attention.WINDOW + 1
#: What leaves 16 bits of 64.
SLOT = np.uint64(48)


class Pieces:
    """Longest-match cutting of words into the first pieces of a rank file; pieces of more than LONGEST bytes are left out."""

    def __init__(self, path: str, subwords: int = SUBWORDS):
        with open(path, "rb") as f:
            ranks = [(int(r), base64.b64decode(b)) for b, r in map(bytes.split, f)]
        pieces = [b for r, b in sorted(ranks)[: subwords - 1]]
        self.end = subwords - 1
        self.byte = np.zeros(256, np.int16)
        self.by_size: dict[int, tuple] = {}  # a multiplier that gives each code a slot of its own; by slot codes and ids; the first two bytes there are
        for size in range(1, LONGEST + 1):
            own = [(int.from_bytes(b, "little"), i) for i, b in enumerate(pieces) if len(b) == size]
            if size == 1:
                for c, i in own:
                    self.byte[c] = i
            elif own:
                begins = np.zeros(1 << 16, bool)
                begins[[c & 0xFFFF for c, _ in own]] = True
                found, i = np.array([c for c, _ in own], np.uint64), np.array([i for _, i in own], np.int16)
                by = np.uint64(0x9E3779B97F4A7C15)
                while len(np.unique(found * by >> SLOT)) < len(own):
                    by += np.uint64(0x632BE59BD9B4E01A)  # even, so that the sum stays odd
                codes, ids = np.full(1 << 16, ~np.uint64(0)), np.zeros(1 << 16, np.int16)  # no code has all bits
                codes[found * by >> SLOT], ids[found * by >> SLOT] = found, i
                self.by_size[size] = by, codes, ids, begins

    def cut(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the pieces of spans of buf."""
        padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        lanes = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        at, word = starts.copy(), np.arange(len(starts))
        stop, whose, what = ends, [], []
        while len(at):
            lane, left = lanes[at], stop - at
            best, taken = self.byte[buf[at]], np.ones(len(at), np.int64)
            two = lane.astype(np.uint16)
            for size, (by, codes, ids, begins) in self.by_size.items():
                may = np.flatnonzero(begins[two] & (left >= size))
                c = lane[may] & np.uint64((1 << (8 * size)) - 1)
                i = (c * by >> SLOT).view(np.int64)
                hit = codes[i] == c
                may = may[hit]
                best[may], taken[may] = ids[i[hit]], size
            whose.append(word)
            what.append(best)
            at = at + taken
            more = at < stop
            at, stop, word = at[more], stop[more], word[more]
        if not whose:
            return np.zeros(0, np.int16), np.zeros(len(starts) + 1, np.int64)
        at = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(whose), minlength=len(starts)))])
        out = np.empty(int(at[-1]), np.int16)
        for k, (words, ids) in enumerate(zip(whose, what)):
            out[at[words] + k] = ids
        return out, at


@lru_cache(maxsize=1)
def pieces(path: str, subwords: int) -> Pieces:
    return Pieces(path, subwords)


class _Text:
    """The words of a bucket: distinct words with their pieces, and the place of each word among them."""

    def __init__(self, table: pa.Table, cutter: Pieces):
        buf, offsets = text_buffer(table["text"], lower=True)
        starts, ends, self.first = word_spans(buf, offsets)
        words = hash_spans(buf, starts, ends)
        order = sorted_order(words)
        words = words[order]
        new = np.append(True, words[1:] != words[:-1])[: len(order)]
        self.keys, first = words[new], order[new]
        self.word = np.empty(len(order), np.int32)
        self.word[order] = np.cumsum(new, dtype=np.int32) - 1
        # the distinct words once more, each after a blank; what all words took is given back first
        s, size = starts[first], (ends - starts)[first] + 1
        del words, order, new, first, starts, ends
        off = np.concatenate([[0], np.cumsum(size)])
        flat = buf[np.maximum(np.repeat(s - 1 - off[:-1], size) + np.arange(int(off[-1])), 0)] if len(s) else np.zeros(0, np.uint8)
        flat[off[:-1]] = 0x20
        del buf, s
        self.ids, self.at = cutter.cut(flat, off[:-1], off[1:])
        self.size = np.diff(self.at)
        del flat, off, size
        # the context that each piece makes: itself, and a hash of its word up to it
        prefix = Rolling(mix(self.ids.astype(np.uint64) + np.uint64(1)))
        self.context = np.empty(len(self.ids), np.int16)
        for lo in range(0, len(self.size), 1 << 16):
            begin = np.repeat(self.at[:-1][lo : lo + (1 << 16)], self.size[lo : lo + (1 << 16)])
            at = np.arange(int(self.at[lo]), int(self.at[lo]) + len(begin))
            bits = (prefix.of(begin, at + 1 - begin) >> np.uint64(40)).astype(np.int64) % attention.HASHES
            self.context[at] = self.ids[at].astype(np.int64) * attention.HASHES + bits
        self.n = len(table)

    def stream(self, lo: int, hi: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, contexts, offsets) of documents lo..hi-1: end, the pieces of all words, end."""
        w = self.word[self.first[lo] : self.first[hi]]
        size = self.size[w]
        cum = np.concatenate([[0], np.cumsum(size)])
        per_doc = cum[self.first[lo : hi + 1] - self.first[lo]]
        offsets = per_doc + 2 * np.arange(hi - lo + 1)
        context = np.full(int(offsets[-1]), end * attention.HASHES, np.int16)
        inner = np.ones(len(context), bool)
        inner[offsets[:-1]] = inner[offsets[1:] - 1] = False
        piece = np.repeat(self.at[w] - cum[:-1], size)
        piece += np.arange(int(cum[-1]))
        context[inner] = self.context[piece]
        return (context // attention.HASHES).astype(np.int64), context.astype(np.int64), offsets


def _training(table: pa.Table) -> np.ndarray:
    return ~np.asarray(table["held_out"].combine_chunks().to_numpy(zero_copy_only=False), dtype=bool)


def _with_fold(table: pa.Table) -> pa.Table:
    import zlib

    ids = ["" if i is None else str(i) for i in table["doc_id"].to_pylist()]
    return table.append_column("held_out", pa.array([zlib.crc32(i.encode()) % FOLDS == 0 for i in ids], pa.bool_()))


def _windows(t: _Text, chosen: np.ndarray, end: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids [n, SPAN], contexts [n, SPAN - 1]) of the round's windows, in an order by hash.

    Over all rounds, each id after a stream's first is the target of one window; -1 pads the end.
    """
    xs, cs, hs = [np.zeros((0, SPAN), np.int16)], [np.zeros((0, SPAN - 1), np.int16)], [np.zeros(0, np.uint64)]
    for lo, hi in batches.slices(np.diff(t.first) * 6 + 12, batches.SLICE_BYTES):
        ids, context, offsets = t.stream(lo, hi, end)
        begin, stop = offsets[:-1][chosen[lo:hi]], offsets[1:][chosen[lo:hi]]
        count = -(-(stop - begin - 1) // attention.WINDOW)
        doc = np.repeat(np.arange(len(count)), count)
        k = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
        on = (k + begin[doc]) % ROUNDS == turn
        doc, k = doc[on], k[on]
        at, stop = begin[doc] + k * attention.WINDOW, stop[doc]
        beyond = np.flatnonzero(at + SPAN > stop)
        outside = at[beyond, None] + np.arange(SPAN) >= stop[beyond, None]
        for values, size, out in ((ids, SPAN, xs), (context, SPAN - 1, cs)):
            got = sliding_window_view(np.append(values.astype(np.int16), np.zeros(SPAN, np.int16)), size)[at]
            got[beyond] = np.where(outside[:, :size], np.int16(-1), got[beyond])
            out.append(got)
        hs.append(mix(at.astype(np.uint64) + mix(doc.astype(np.uint64) + np.uint64(lo))))
    order = sorted_order(np.concatenate(hs))
    return np.concatenate(xs)[order], np.concatenate(cs)[order]


#: Rows of an owner >= 0 are counts of words; -1: counts of subwords after contexts.
GATHERED = "owner int, b int, payload binary, codes array<int>, counts array<int>, n_docs long, n_words long"


def _gather(b: int, table: pa.Table, cutter: Pieces, n: int) -> pa.Table:
    """Of a bucket's training documents: counts of its words for their owners, and counts of subwords after contexts."""
    t, train = _Text(table, cutter), _training(_with_fold(table))
    n_words = np.diff(t.first)
    counts = np.bincount(t.word[np.repeat(train, n_words)], minlength=len(t.keys)).astype(np.uint32)
    sent = buckets.send(b, t.keys, n, lambda s: t.keys[s].tobytes() + counts[s].tobytes())
    v = cutter.end + 1
    # pairs within words, by distinct word; then those from word to word, and at both ends of a text
    inner = np.ones(len(t.ids), bool)
    inner[t.at[:-1]] = False
    second, often = np.flatnonzero(inner), np.repeat(counts, t.size - 1)
    pairs = np.zeros(v * attention.HASHES * v, np.int64)
    for lo in range(0, len(second), 1 << 16):
        at = second[lo : lo + (1 << 16)]
        np.add.at(pairs, t.context[at - 1].astype(np.int64) * v + t.ids[at], often[lo : lo + (1 << 16)].astype(np.int64))
    head, tail, end = t.ids[t.at[:-1]].astype(np.int64), t.context[t.at[1:] - 1].astype(np.int64), cutter.end * attention.HASHES
    full = np.flatnonzero(train & (n_words > 0))
    nxt = np.repeat(train, n_words)
    nxt[t.first[full]] = False
    nxt = np.flatnonzero(nxt)
    for lo in range(0, len(nxt), 1 << 16):
        at = nxt[lo : lo + (1 << 16)]
        np.add.at(pairs, tail[t.word[at - 1]] * v + head[t.word[at]], 1)
    np.add.at(pairs, end * v + head[t.word[t.first[full]]], 1)
    np.add.at(pairs, tail[t.word[t.first[full + 1] - 1]] * v + cutter.end, 1)
    pairs[end * v + cutter.end] += int((train & (n_words == 0)).sum())
    codes = np.flatnonzero(pairs)
    pairs = pairs[codes]
    k = sent.num_rows
    none = pa.nulls(k, pa.list_(pa.int32()))
    rows = sent.append_column("codes", none).append_column("counts", none)
    rows = rows.append_column("n_docs", pa.array([0] * k, pa.int64())).append_column("n_words", pa.array([0] * k, pa.int64()))
    own = pa.table({
        "owner": pa.array([-1], pa.int32()), "b": pa.array([b], pa.int32()), "payload": pa.nulls(1, pa.binary()),
        "codes": pa.array([codes.astype(np.int32)], pa.list_(pa.int32())), "counts": pa.array([pairs.astype(np.int32)], pa.list_(pa.int32())),
        "n_docs": pa.array([int(train.sum())], pa.int64()), "n_words": pa.array([int(n_words[train].sum())], pa.int64()),
    })
    return pa.concat_tables([rows, own.cast(rows.schema)])


def _totals(payloads: list[bytes]) -> list[bytes]:
    """For each bucket the training counts of its words over all buckets; the first answer begins with how many words count."""
    sizes = [len(p) // 12 for p in payloads]
    keys = np.concatenate([np.frombuffer(p, np.uint64, n) for p, n in zip(payloads, sizes)])
    counts = np.concatenate([np.frombuffer(p, np.uint32, n, 8 * n) for p, n in zip(payloads, sizes)]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    begin = np.flatnonzero(new)
    totals = np.add.reduceat(counts[order], begin)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(totals, np.diff(np.append(begin, len(keys))))
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    heads = [int((totals > 0).sum())] + [0] * len(payloads)
    return [h.to_bytes(8, "big") + out[lo : lo + n].tobytes() for h, lo, n in zip(heads, cuts, sizes)]


def _trained(rows: DataFrame, base, path: str, v: int) -> dict[str, np.ndarray]:
    """Rounds of training: each bucket goes on from the common weights over its windows of the round; the weights are then averaged."""
    params = attention.fresh(v)
    shapes = {k: x.shape for k, x in params.items()}
    chunk = 4096
    for turn in range(ROUNDS):
        def local(b: int, table: pa.Table, now=params, turn=turn) -> pa.Table:
            cutter = pieces(path, v)
            t = _Text(table, cutter)
            x, context = _windows(t, _training(_with_fold(table)), cutter.end, turn)
            p = attention.train(now, base.value, x, context)
            flat = np.concatenate([p[k].ravel() for k in shapes])
            parts = [flat[i : i + chunk].tobytes() for i in range(0, len(flat), chunk)]
            cols = {"part": range(len(parts)), "n": [len(x)] * len(parts), "b": [b] * len(parts)}
            return pa.table({"part": pa.array(cols["part"], pa.int32()), "n": pa.array(cols["n"], pa.int64()), "b": pa.array(cols["b"], pa.int32()), "p": pa.array(parts, pa.binary())})

        def mean(it):
            """Sums over all buckets of a partition, so that no task holds more than one set of weights."""
            total: dict[int, np.ndarray] = {}
            for batch in it:
                for part, n, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "p"))):
                    x = np.append(np.frombuffer(raw, np.float32).astype(np.float64) * n, float(n))
                    total[part] = total[part] + x if part in total else x
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "p"])

        sums = buckets.each(rows, local, "part int, n long, b int, p binary").mapInArrow(mean, "part int, p binary")
        got: dict[int, np.ndarray] = {}
        for r in sums.repartition(8, "part").mapInArrow(_added, "part int, p binary").collect():
            got[r["part"]] = np.frombuffer(r["p"], np.float64)
        if not got or not got[0][-1]:
            break
        flat = np.concatenate([got[i][:-1] / got[i][-1] for i in sorted(got)]).astype(np.float32)
        cuts = np.cumsum([int(np.prod(s)) for s in shapes.values()])[:-1]
        params = {k: x.reshape(shapes[k]).copy() for k, x in zip(shapes, np.split(flat, cuts))}
    return params


def _added(it):
    """The sums of each part of the weights over the rows of a partition."""
    total: dict[int, np.ndarray] = {}
    for batch in it:
        for part, raw in zip(batch.column("part").to_pylist(), batch.column("p").to_pylist()):
            x = np.frombuffer(raw, np.float64)
            total[part] = total[part] + x if part in total else x
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "p"])


def score(docs: DataFrame, path: str, subwords: int = SUBWORDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, attention_score, n_subwords of every row of docs."""
    spark = docs.sparkSession
    rows, n, _ = buckets.dealt(docs, bucket_bytes)
    gathered = settle(buckets.each(rows, lambda b, t: _gather(b, t, pieces(path, subwords), n), GATHERED))
    counts = buckets.exchange(gathered.where("owner >= 0").select("owner", "b", "payload"), _totals)
    head = F.conv(F.hex(F.substring("payload", 1, 8)), 16, 10).cast("long")
    distinct = counts.select(F.sum(head).alias("v")).first()["v"] or 0
    sums = gathered.where("owner = -1").agg(F.sum("n_docs").alias("d"), F.sum("n_words").alias("w")).first()
    n_docs, n_train = sums["d"] or 0, (sums["d"] or 0) + (sums["w"] or 0)
    denominator = n_train + 0.1 * (distinct + (n_docs > 0) + 1)
    # subwords * HASHES * subwords numbers at most
    pairs = (
        gathered.where("owner = -1").select(F.explode(F.arrays_zip("codes", "counts")).alias("x"))
        .groupBy(F.col("x.codes").alias("code")).agg(F.sum("x.counts").cast("float").alias("n")).toArrow()
    )
    table = np.zeros(subwords * attention.HASHES * subwords, np.float32)
    table[np.asarray(pairs["code"], dtype=np.int64)] = np.asarray(pairs["n"])
    base = spark.sparkContext.broadcast(attention.Counts.of(table.reshape(-1, subwords)))  # a size fixed by subwords
    del table, pairs
    params = _trained(rows, base, path, subwords)

    def finish(b: int, t: pa.Table, got: pa.Table) -> pa.Table:
        cutter = pieces(path, subwords)
        x, scorer = _Text(t, cutter), attention.Scorer(params, base.value)
        c = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(p, np.int64, -1, 8) for p in buckets.answers(got))])
        logs = np.log10((c + 0.1) / denominator)
        n_words = np.diff(x.first)
        doc = np.repeat(np.arange(x.n), n_words)
        base_score = np.bincount(doc, logs[x.word], x.n) + np.log10((n_docs + 0.1) / denominator)
        known = np.bincount(doc, (c > 0)[x.word], x.n).astype(np.int64) + (n_docs > 0)
        attention_score, model_score, length = [], [], []
        held = np.maximum(c - DISCOUNT, 0) / max(n_train, 1)
        end_held = max(n_docs - DISCOUNT, 0) / max(n_train, 1)
        left = DISCOUNT * (distinct + (n_docs > 0)) / n_train if n_train else 1.0
        for lo, hi in batches.slices(n_words * 6 + 12, batches.SLICE_BYTES):
            ids, context, offsets = x.stream(lo, hi, cutter.end)
            each = scorer(ids, context, offsets).astype(np.float64)
            # of each token, a word or the end, the pieces' sum
            w = x.word[x.first[lo] : x.first[hi]]
            size = np.ones(len(w) + hi - lo, np.int64)
            end = np.cumsum(n_words[lo:hi] + 1) - 1
            word = np.ones(len(size), bool)
            word[end] = False
            size[word] = x.size[w]
            at = np.delete(np.arange(len(ids)), offsets[:-1])
            token = np.add.reduceat(each[at], np.concatenate([[0], np.cumsum(size)[:-1]]))
            known_part = np.full(len(size), end_held)
            known_part[word] = held[w]
            both = np.log10(known_part + left * np.exp(token))
            begin = end - n_words[lo:hi]
            attention_score.append(np.add.reduceat(token, begin) / np.log(10))
            model_score.append(np.add.reduceat(both, begin))
            length.append(np.diff(offsets) - 1)
        return pa.table({
            "doc_id": t["doc_id"], "held_out": pa.array(~_training(_with_fold(t))), "n_tokens": pa.array(n_words + 1), "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(x.n, n_train, np.int64)), "base_score": pa.array(base_score),
            "score": pa.array(np.concatenate(model_score)), "attention_score": pa.array(np.concatenate(attention_score)), "n_subwords": pa.array(np.concatenate(length)),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, attention_score double, n_subwords long"
    return buckets.each_with(rows, counts, finish, schema)
