"""Byte-level BPE encoding and decoding: speculate and verify.

For each distinct pre-token, greedy longest-match proposes tokens. A proposal
is the BPE encoding if each token is its own encoding and no merge crosses any
boundary between neighbours; whether a pair of tokens is compatible in that
sense is tested for all adjacent pairs of a batch at once. Only pre-tokens that
fail are merged exactly, rank by rank, all of a batch side by side. Results are kept for the distinct
pre-tokens seen last, up to a bound.

The vocabulary file (JSON of a byte-level BPE) is a parameter and must be at
that path on every executor. Nulls: a null text is an empty one, without ids.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import batches, pretokens
from .textbuf import hash_spans, text_buffer

#: Distinct pre-tokens kept in a worker, and bytes of text worked on at once.
KEEP, SLICE = 150_000, 2 << 20
NEVER = 1 << 40


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = _byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.pieces: dict[int, bytes] = {i: b for b, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces |= {i: s.encode() for s, i in self.special.items()}
        self.reach: dict[bytes, int] = {}  # the longest piece that begins with these (up to three) bytes
        for b in self.ids:
            self.reach[b[:3]] = max(self.reach.get(b[:3], 0), len(b))
        size = max(self.pieces) + 1
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        left, right, own = np.full(size, -1), np.full(size, -1), np.full(size, NEVER)
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            key = (self.ids[a], self.ids[b])
            t = self.ids[a + b]
            self.rank.setdefault(key, r)
            self.made.setdefault(key, t)
            if own[t] == NEVER:
                left[t], right[t], own[t] = *key, r
        self.left, self.right, self.own = left, right, own
        codes = np.array([a << 32 | b for a, b in self.rank], dtype=np.int64)
        order = np.argsort(codes)
        self.codes, self.ranks = codes[order], np.array(list(self.rank.values()), dtype=np.int64)[order]
        self._spines: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self._whole: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.byte = np.array([self.ids[bytes([i])] for i in range(256)])
        self.targets = np.array(list(self.made.values()), dtype=np.int64)[order]

    def exact(self, word: bytes) -> list[int]:
        """BPE proper: the lowest rank merges first, and of equal ranks the leftmost."""
        ids = [self.ids[word[i : i + 1]] for i in range(len(word))]
        if len(ids) > 256:
            return self._exact_long(ids)
        rank, made = self.rank, self.made
        ranks = [rank.get(p, NEVER) for p in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            ids[i : i + 2] = [made[ids[i], ids[i + 1]]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank.get((ids[i], ids[i + 1]), NEVER)
        return ids

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of pairs among the merges by code, -1 where there is none."""
        code = a << 32 | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, at, -1)

    def merged(self, words: list[bytes]) -> list[list[int]]:
        """exact() of many words at once.

        In each step every word merges its pair of lowest rank, at all places from the left that do not overlap: pairs
        that a merge makes have higher ranks, so these places would come next anyway.
        """
        out: list[list[int]] = [[]] * len(words)
        long = [i for i, w in enumerate(words) if len(w) > 256]
        for i in long:
            out[i] = self.exact(words[i])
        which = np.array([i for i, w in enumerate(words) if 0 < len(w) <= 256], dtype=np.int64)
        if not len(which):
            return out
        size = np.array([len(words[i]) for i in which.tolist()], dtype=np.int64)
        ids = self.byte[np.frombuffer(b"".join(words[i] for i in which.tolist()), np.uint8)]
        of = np.repeat(np.arange(len(which)), size)
        place = np.append(self._ranks(ids[:-1], ids[1:]), -1)
        place[np.append(np.flatnonzero(of[1:] != of[:-1]), len(of) - 1)] = -1
        while True:
            rank = np.where(place >= 0, self.ranks[place], NEVER)
            begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            least = np.minimum.reduceat(rank, begin)
            done = least == NEVER
            if done.any():  # finished words leave
                ends = np.append(begin[1:], len(of))
                flat = ids.tolist()
                for w, lo, hi in zip(of[begin[done]].tolist(), begin[done].tolist(), ends[done].tolist()):
                    out[int(which[w])] = flat[lo:hi]
                keep = np.repeat(~done, ends - begin)
                ids, of, place, rank = ids[keep], of[keep], place[keep], rank[keep]
                if not len(ids):
                    return out
                least, size = least[~done], (ends - begin)[~done]
            else:
                size = np.diff(np.append(begin, len(of)))
            hit = rank == np.repeat(least, size)
            at = np.flatnonzero(hit)
            # of runs of places that overlap, every other one from the left
            new = np.append(True, np.diff(at) > 1)
            first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            ids[at] = self.targets[place[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep)[at] - 1
            ids, of, place = ids[keep], of[keep], place[keep]
            redo = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            redo = redo[redo < len(ids) - 1]
            fresh = np.where(of[redo] == of[redo + 1], self._ranks(ids[redo], ids[redo + 1]), -1)
            place[redo] = fresh
            place[-1] = -1

    def verified(self, proposals: list[list[int]]) -> np.ndarray:
        """Which proposals are encodings: all their tokens are whole, and all pairs of neighbours are compatible."""
        size = np.array([len(p) for p in proposals], dtype=np.int64)
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(size.sum()))
        of = np.repeat(np.arange(len(proposals)), size)
        inner = np.flatnonzero(of[1:] == of[:-1])
        codes, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        new = np.array([c for c in codes.tolist() if c not in self.pairs], dtype=np.int64)
        if len(new):
            self.pairs.update(zip(new.tolist(), self.compatible(new >> 32, new & 0xFFFFFFFF).tolist()))
        good = np.array([self.pairs[c] for c in codes.tolist()], dtype=bool)
        right = np.ones(len(proposals), bool)
        right[of[inner[~good[back]]]] = False
        tokens, back = np.unique(flat, return_inverse=True)
        whole = np.array([self.whole(t) for t in tokens.tolist()], dtype=bool)
        right[of[~whole[back]]] = False
        if len(self.pairs) > 4 * KEEP:
            self.pairs.clear()
        return right

    def _exact_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and a linked list, for very long words."""
        import heapq

        nxt, prv, alive = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)], [True] * len(ids)
        heap = [(self.rank[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], nxt[i] = self.made[a, b], False, nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y >= 0 and (r := self.rank.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [t for t, ok in zip(ids, alive) if ok]

    def greedy(self, word: bytes) -> list[int]:
        """Tokens by longest match from the left."""
        out, at, n, ids, reach = [], 0, len(word), self.ids, self.reach
        while at < n:
            t, k = None, reach.get(word[at : at + 3], 0)
            while k > 2 and t is None:
                t = ids.get(word[at : at + k])
                k -= 1
            if t is None:
                t = ids.get(word[at : at + 2]) if n - at > 1 else None
                k = 1
                if t is None:
                    t, k = ids[word[at : at + 1]], 0
            out.append(t)
            at += k + 1
        return out

    def whole(self, t: int) -> bool:
        """Whether token t is the encoding of its own bytes."""
        if t not in self._whole:
            self._whole[t] = self.exact(self.pieces[t]) == [t]
        return self._whole[t]

    def spine(self, t: int, right: bool) -> list[tuple[int, int]]:
        """The tokens at one edge of t from t inwards, each with the rank of the merge that absorbs it."""
        key = (t, right)
        if key not in self._spines:
            out, absorbed, x = [], NEVER, t
            while x >= 0:
                out.append((x, absorbed))
                absorbed = int(self.own[x])
                x = int((self.right if right else self.left)[x])
            self._spines[key] = out
        return self._spines[key]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of neighbours: that no merge crosses between them while both edges still exist."""
        of, x, px, y, py = [], [], [], [], []
        for i, (s, t) in enumerate(zip(a.tolist(), b.tolist())):
            for u, pu in self.spine(s, True):
                for v, pv in self.spine(t, False):
                    of.append(i), x.append(u), px.append(pu), y.append(v), py.append(pv)
        code = np.array(x, dtype=np.int64) << 32 | np.array(y, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        r = np.where(self.codes[at] == code, self.ranks[at], NEVER)
        # of equal ranks the left merge comes first: x's own absorption wins a tie, y's loses it
        crossed = (r < NEVER) & (r < np.array(px)) & (r <= np.array(py))
        ok = np.ones(len(a), bool)
        ok[np.array(of, dtype=np.int64)[crossed]] = False
        return ok


class Codec:
    """Encodes slices of texts with a bounded memory of distinct pre-tokens and of tested pairs."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        # hash of a pre-token -> (its bytes, its ids in 32 bits each); what is not met while
        # KEEP others come in is dropped, so that frequent pre-tokens stay
        self.young: dict[int, tuple[bytes, bytes]] = {}
        self.old: dict[int, tuple[bytes, bytes]] = {}
        self.failed = self.proposed = 0

    def learn(self, raw: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens that are not known: proposed, verified, and merged exactly where they fail."""
        v = self.v
        proposals = [v.greedy(w) for w in raw]
        failed = np.flatnonzero(~v.verified(proposals)).tolist()
        for i, p in zip(failed, v.merged([raw[i] for i in failed])):
            proposals[i] = p
        self.proposed += len(raw)
        self.failed += len(failed)
        return [array("i", p).tobytes() for p in proposals]

    def look_up(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """(ids of the distinct pre-tokens, index into them of every pre-token)."""
        h, first, back = np.unique(hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
        whole = buf.tobytes()
        raw = [whole[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]
        keys = h.tolist()
        young, old = self.young, self.old
        found = [young.get(k) or old.get(k) for k in keys]
        # an entry of other bytes shares its hash by chance: it is encoded anew
        new = [i for i, (x, w) in enumerate(zip(found, raw)) if x is None or x[0] != w]
        if new:
            for i, ids in zip(new, self.learn([raw[i] for i in new])):
                found[i] = (raw[i], ids)
        young.update(zip(keys, found))
        if len(young) > KEEP:
            self.young, self.old = {}, young
        return [x[1] for x in found], back

    def segments(self, column) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int] | int]]]:
        """Texts cut at special tokens: (bytes, offsets of the pieces, for each text its pieces and special ids)."""
        buf, offsets = text_buffer(column)
        found = []
        for content, i in self.v.special.items():
            raw, mark = buf.tobytes(), content.encode()
            at = raw.find(mark)
            while at >= 0:
                d = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(mark) <= offsets[d + 1]:
                    found.append((at, at + len(mark), i))
                    at = raw.find(mark, at + len(mark))
                else:
                    at = raw.find(mark, at + 1)
        return buf, offsets, sorted(found)

    def tokens(self, column):
        """(bytes, starts, ends, offsets of each text's pre-tokens, special ids by pre-token)."""
        buf, offsets, found = self.segments(column)
        cuts = np.array(sorted({int(x) for x in offsets} | {x for f in found for x in f[:2]}), dtype=np.int64)
        starts, ends, first = pretokens.spans(buf, cuts if found else offsets)
        if not found:
            return buf, starts, ends, first, {}
        special, drop = {}, np.zeros(len(starts), bool)
        for s, e, i in found:
            lo, hi = np.searchsorted(starts, [s, e])
            drop[lo + 1 : hi] = True
            ends[lo] = e
            special[int(s)] = i
        starts, ends = starts[~drop], ends[~drop]
        return buf, starts, ends, np.searchsorted(starts, offsets), special

    def encoded(self, column):
        """(ids of each distinct pre-token, index into them of every pre-token, offsets of each text's pre-tokens)."""
        buf, starts, ends, first, special = self.tokens(column)
        packed, back = self.look_up(buf, starts, ends)
        flat = np.frombuffer(b"".join(packed), np.int32).tolist()
        ends = np.cumsum([len(p) >> 2 for p in packed], dtype=np.int64).tolist()
        rows = [flat[lo:hi] for lo, hi in zip([0, *ends], ends)]
        if special:
            at = np.searchsorted(starts, np.array(list(special), dtype=np.int64))
            marks = {i: len(rows) + k for k, i in enumerate(dict.fromkeys(special.values()))}
            rows += [[i] for i in marks]
            back[at] = [marks[i] for i in special.values()]
        return rows, back, first

    def encode(self, texts: list[str]) -> list[list[int]]:
        rows, back, first = self.encoded(pa.array(texts, pa.string()))
        back = back.tolist()
        return [[t for i in back[lo:hi] for t in rows[i]] for lo, hi in zip(first[:-1].tolist(), first[1:].tolist())]

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        rows, back, first = self.encoded(pa.array(texts, pa.string()))
        size = np.array([len(r) for r in rows], dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(size[back])]) if len(back) else np.zeros(1, np.int64)
        return np.diff(total[first]).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.v.pieces[t] for t in ids).decode(errors="replace")


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """One codec for each Python worker."""
    return Codec(Vocabulary(path))


def _over_texts(docs: DataFrame, path: str, schema: str, work) -> DataFrame:
    def run(it):
        c = codec(path)
        for batch in it:
            for lo, hi in batches.slices(batches.byte_sizes(batch.column("text")), SLICE):
                part = batch.slice(lo, hi - lo)
                yield work(c, part.column("doc_id"), part.column("text"))
        pa.default_memory_pool().release_unused()  # the worker lives on, idle or with other work

    return batches.id_and_text(docs).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of every row of docs."""

    def work(c: Codec, doc_ids, column):
        rows, back, first = c.encoded(column)
        size = np.array([len(r) for r in rows], dtype=np.int64)
        flat = np.fromiter((t for r in rows for t in r), np.int32, int(size.sum()))
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        n = size[back] if len(back) else np.zeros(0, np.int64)
        out = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(begin[back] - out[:-1], n) + np.arange(int(out[-1]))] if len(back) else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(out[first], pa.int32()), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([doc_ids, lists], ["doc_id", "ids"])

    return _over_texts(docs, path, "doc_id long, ids array<int>", work)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of doc_id and ids; a null array gives a null text."""

    def run(it):
        c = codec(path)
        for batch in it:
            texts = [None if r is None else c.decode(r) for r in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes every text and decodes its ids again, each distinct pre-token once."""

    def work(c: Codec, doc_ids, column):
        rows, back, first = c.encoded(column)
        written = [",".join(map(str, r)) for r in rows]
        pieces = [b"".join(map(c.v.pieces.__getitem__, r)) for r in rows]
        size = np.array([len(r) for r in rows], dtype=np.int64)
        n = np.diff(np.concatenate([[0], np.cumsum(size[back])])[first]) if len(back) else np.zeros(len(first) - 1, np.int64)
        a, b = [], []
        back = back.tolist()
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            part = back[lo:hi]
            a.append(hashlib.sha256(",".join([written[i] for i in part]).encode()).hexdigest())
            text = b"".join([pieces[i] for i in part]).decode(errors="replace")
            b.append(hashlib.sha256(text.encode()).hexdigest())
        cols = [doc_ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _over_texts(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", work)
