"""A small causal self-attention model over subword ids, in numpy.

The softmax over subwords is in two steps, a class of subwords and then one of
the class's 64 subwords. Counts give both steps a distribution after each
context, which is the subword before and a few bits of a hash of the word's
beginning. One head attends over at most ``WINDOW`` earlier subwords with
learned relative positions, and its output bends the logits of the first step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW, STRIDE, DIM, CLASS, HASHES = 12, 8, 8, 64, 8
OVERLAP = WINDOW - STRIDE


@dataclass
class Counts:
    """Log probabilities [context, class] and [context, subword], the latter within its class; context // HASHES is the subword before."""

    of_class: np.ndarray
    within: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, prior: float = 5.0) -> Counts:
        """From counts [context, subword]: each context leans on its subword's sums, and these on all."""
        v = counts.shape[1]
        one = counts.sum(0, dtype=np.float64) + 0.5
        pair = counts.reshape(v, HASHES, v).sum(1) + prior * one / one.sum()
        pair = (pair / pair.sum(1, keepdims=True)).astype(np.float32)
        of_class, within = np.empty((len(counts), v // CLASS), np.float32), np.empty(counts.shape, np.float32)
        for lo in range(0, v, 64):  # blocks bound what is held besides
            p = counts[lo * HASHES : (lo + 64) * HASHES] + np.float32(prior) * np.repeat(pair[lo : lo + 64], HASHES, 0)
            p /= p.sum(1, keepdims=True)
            c = p.reshape(len(p), -1, CLASS).sum(2)
            at = slice(lo * HASHES, lo * HASHES + len(p))
            of_class[at], within[at] = np.log(c), np.log(p / np.repeat(c, CLASS, 1))
        return cls(of_class, within)


def fresh(v: int, seed: int = 11) -> dict[str, np.ndarray]:
    """Query, key, value and own part of each subword, side by side; position weights; the classes' weights, zero at first: nothing is bent."""
    table = np.random.default_rng(seed).normal(0, 0.3, (v, 4 * DIM)).astype(np.float32)
    return {"e": table, "rel": np.zeros(WINDOW, np.float32), "c": np.zeros((v // CLASS, DIM), np.float32)}


def _bend(x: np.ndarray) -> np.ndarray:
    """Softsign: between -1 and 1."""
    return x / (1 + np.abs(x))


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Of rows that are log probabilities plus a bend, cut at 60 both ways, so that no sum overflows or is zero; x is used up."""
    np.clip(x, -60, 60, out=x)
    return np.log(np.exp(x, out=x) @ np.ones(x.shape[1], np.float32))


_BACK = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
_CAUSAL = (_BACK >= 0).astype(np.float32)
_BACK0 = np.maximum(_BACK, 0)
_ONES = np.ones(WINDOW, np.float32)
#: Rows of one subword that are summed side by side.
LANES = 8


def _sums(rows: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    """[n, columns]: for each number below n the sum of its rows; which has the number of each row but the last, which is zero."""
    order = np.argsort(which.astype(np.int16), kind="stable")
    size = np.bincount(which, minlength=n)
    have = np.flatnonzero(size)
    size = size[have]
    lines = -(-size // LANES)
    begin = np.cumsum(lines) - lines
    at = np.full(int(lines.sum()) * LANES, len(which))
    at[np.arange(len(which)) + np.repeat(begin * LANES - (np.cumsum(size) - size), size)] = order
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[have] = np.add.reduceat(np.take(rows, at.reshape(-1, LANES).T, axis=0).sum(0), begin, axis=0)
    return out


def gradient(p: dict, base: Counts, x: np.ndarray, context: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss (nats a subword) and gradient over windows x [n, WINDOW + 1] and their contexts [n, WINDOW]; -1 pads the end."""
    ctx, tgt = np.maximum(x[:, :-1], 0), x[:, 1:]
    live = (tgt >= 0) & (x[:, :-1] >= 0)
    flat, cls = ctx.ravel(), np.maximum(tgt, 0).ravel() // CLASS
    scale = np.float32(DIM**-0.5)
    q, k_, v, u = (np.take(np.ascontiguousarray(part), ctx, axis=0) for part in np.split(p["e"], 4, axis=1))
    # a softmax over the places seen, of logits within 60, so that no sum overflows or is zero
    a = q @ k_.transpose(0, 2, 1)
    a *= scale
    np.clip(a, -30, 30, out=a)
    a += np.clip(p["rel"], -30, 30)[_BACK0]
    np.exp(a, out=a)
    a *= _CAUSAL
    lines = a.reshape(-1, WINDOW)
    lines /= (lines @ _ONES)[:, None]
    f = a @ v
    f += u
    fs = _bend(f).reshape(-1, DIM)
    pc = fs @ p["c"].T
    pc += np.take(base.of_class, np.maximum(context, 0).ravel(), axis=0)
    np.exp(np.clip(pc, -60, 60, out=pc), out=pc)
    total = pc @ np.ones(pc.shape[1], np.float32)
    n = max(int(live.sum()), 1)
    w, hit, of = (live.ravel() / np.float32(n)).astype(np.float32), np.arange(0, pc.size, pc.shape[1]) + cls, pc.ravel()
    loss = -float(np.log(np.maximum(of[hit] / total, 1e-30)) @ w)
    pc *= (w / total)[:, None]
    of[hit] -= w
    g = {"c": pc.T @ fs}
    dh = pc @ p["c"] * (1 - np.abs(fs)) ** 2
    de = np.empty((len(flat) + 1, 4 * DIM), np.float32)
    de[-1], de[:-1, 3 * DIM :] = 0, dh
    each, dh = de[:-1].reshape(*ctx.shape, 4 * DIM), dh.reshape(f.shape)
    ds = dh @ v.transpose(0, 2, 1)
    slopes = ds.reshape(-1, WINDOW)
    slopes -= ((slopes * lines) @ _ONES)[:, None]
    ds *= a
    g["rel"] = np.bincount(_BACK0.ravel(), (ds.sum(0) * _CAUSAL).ravel(), WINDOW).astype(np.float32)
    ds *= scale
    each[..., :DIM] = ds @ k_
    each[..., DIM : 2 * DIM] = ds.transpose(0, 2, 1) @ q
    each[..., 2 * DIM : 3 * DIM] = a.transpose(0, 2, 1) @ dh
    g["e"] = _sums(de, flat, len(p["e"]))
    return loss, g


def train(p: dict, base: Counts, x: np.ndarray, context: np.ndarray, batch: int = 512, rate: float = 0.05) -> dict:
    """Adam over the windows, once each, in their order."""
    p = {k: v.copy() for k, v in p.items()}
    m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    total = -(-len(x) // batch)
    for step in range(1, total + 1):
        at = slice((step - 1) * batch, step * batch)
        _, g = gradient(p, base, x[at].astype(np.int64), context[at].astype(np.int64))
        r = rate * (1 - 0.9 * step / total)
        for name in p:
            (m1, m2), now = m[name], g[name]
            m1 += np.float32(0.1) * (now - m1)
            np.square(now, out=now)
            now -= m2
            now *= np.float32(0.01)
            m2 += now
            by = np.multiply(m2, np.float32(1 / (1 - 0.99**step)), out=now)
            np.sqrt(by, out=by)
            by += np.float32(1e-6)
            np.divide(m1, by, out=by)
            by *= np.float32(r / (1 - 0.9**step))
            p[name] -= by
    return p


class Scorer:
    """Log probabilities of streams: windows overlap, and each subword is scored in one of them."""

    BATCH = 1024

    def __init__(self, p: dict, base: Counts):
        self.p, self.base = p, base
        q, k, self.v, self.u = (np.ascontiguousarray(x) for x in np.split(p["e"], 4, axis=1))
        self.v = np.hstack([self.v, np.ones((len(q), 1), np.float32)])  # the last one sums the weights
        # what a subword sees of another depends on the two only, and on their distance
        self.seen = np.exp(np.clip(q @ k.T * np.float32(DIM**-0.5), -30, 30)).ravel()
        back = (np.arange(STRIDE)[:, None] + OVERLAP) - np.arange(WINDOW)[None, :]
        self.rel = np.where(back >= 0, np.exp(np.clip(p["rel"][np.maximum(back, 0)], -30, 30)), 0).astype(np.float32)
        self.c = np.ascontiguousarray(p["c"].T)

    def __call__(self, ids: np.ndarray, context: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The natural log probability of each id given those before it in its stream, 0 for first ids; context: of each id, that of the id after it."""
        n = len(offsets) - 1
        steps = np.maximum(np.diff(offsets) - 1, 0)
        count = -(-steps // STRIDE)
        first = np.concatenate([[0], np.cumsum(count)])
        doc = np.repeat(np.arange(n), count)
        k = np.arange(int(first[-1])) - first[doc]
        out = np.zeros(len(ids), np.float32)
        for lo in range(0, len(doc), self.BATCH):
            d, w = doc[lo : lo + self.BATCH], k[lo : lo + self.BATCH]
            self._windows(ids, context, offsets[d], offsets[d + 1], w, out)
        return out

    def _windows(self, ids, context, begin, end, w, out) -> None:
        at = (begin + w * STRIDE - OVERLAP)[:, None] + np.arange(WINDOW)
        last = end[:, None] - 1
        ctx = ids[np.clip(at, begin[:, None], last)]
        here = at[:, OVERLAP:]
        live = (here < last).ravel()
        here = np.minimum(here, last - 1)  # what is not live is worked out like the stream's last one, and left
        own, tgt = ctx[:, OVERLAP:], ids[here + 1].ravel()
        s = np.take(self.seen, own[:, :, None] * len(self.u) + ctx[:, None, :])
        s *= self.rel
        s[w == 0, :, :OVERLAP] = 0  # before the stream's beginning
        f = s @ np.take(self.v, ctx, axis=0)
        f = f[..., :-1] / f[..., -1:]
        f += np.take(self.u, own, axis=0)
        before = context[here].ravel()
        x = _bend(f.reshape(-1, DIM)) @ self.c
        x += np.take(self.base.of_class, before, axis=0)
        got = x.ravel()[np.arange(0, x.size, x.shape[1]) + tgt // CLASS]
        got -= _log_sum(x)
        got += np.take(self.base.within, before * len(self.u) + tgt)
        out[here.ravel()[live] + 1] = got[live]
