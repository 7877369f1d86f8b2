"""Personal data: patterns, and a semi-Markov conditional random field over whole spans.

The base spans are exact pattern matches. The text is also cut into tokens, and
a semi-Markov CRF scores every candidate segment of up to ``MAX_TOKENS`` tokens
for every type by features of the whole span; dynamic programming over segments
chooses boundaries and types jointly. Its spans are added where they do not
overlap a base span; base spans always stay. Tokens far from anything that can
raise a segment's score above 0 are passed over: ``bound`` proves of the
trained weights that no segment there could be chosen, so that this changes no
result, and without that proof all tokens are scored.

The CRF is trained in numpy by gradient ascent on generated, labelled lines
(fixed seed), since no labelled spans exist; the training set has a fixed size.

Nulls: a null text is an empty one, without spans. Rows with a repeated id are
treated row by row. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]  # start, end, place in KINDS

# The base patterns, written so that no text makes them scan a run of characters twice.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, done = [], 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            out.append((start, m.end(), 0))
            done = m.end()
    return out


def base_spans(text: str) -> list[Span]:
    """All base spans, ordered by start and then by kind."""
    out: list[Span] = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() <= 40 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), m.end(), 3))
    out.sort(key=lambda s: (s[0], s[2], s[1]))
    return out


# ---- the semi-Markov CRF ----

MAX_TOKENS, CUE_TOKENS = 14, 3
#: Tokens whose features are held at a time; scores do not depend on it.
SLICE_TOKENS = 1024
_TOKEN = re.compile(r"\w+|[^\w\s]")
_CUES = {  # fixed values: words that announce a kind
    0: {"mail", "email", "contact", "write"}, 1: {"ip", "host", "server", "address"}, 2: {"card", "visa", "credit"},
    3: {"phone", "call", "tel", "mobile"}, 4: {"token", "key", "secret", "password", "api"},
}
_HEX = re.compile(r"[0-9a-f]{16,}")
_KEY = re.compile(r"[A-Z]{4}[A-Z0-9]{12,}")
N_FEATURES = 22


def _span_features(toks: list[tuple[int, int]], text: str, i: int, j: int) -> np.ndarray:
    """Features of the segment of tokens i..j-1 as a whole."""
    s, e = toks[i][0], toks[j - 1][1]
    span = text[s:e]
    digits = sum(c.isdigit() for c in span)
    packed = span.replace(" ", "").replace("-", "")
    groups = span.split(".")
    before = {text[a:b].lower() for a, b in toks[max(0, i - CUE_TOKENS) : i]}
    quoted = i > 0 and text[toks[i - 1][0]] in "\"'" and j < len(toks) and text[toks[j][0]] in "\"'"
    joined = (i > 0 and toks[i - 1][1] == s) or (j < len(toks) and toks[j][0] == e and not text[e] in ".,;:!?)\"'%&$*#|")
    at = span.count("@")
    f = [
        1.0,
        at == 1 and span[0] != "@" and span[-1] != "@",
        at == 1 and "." in span.partition("@")[2] and " " not in span and span[-1].isalnum() and span[0].isalnum(),
        len(groups) == 4 and all(g.isdigit() and g.isascii() and len(g) <= 3 and int(g) <= 255 for g in groups),
        packed.isdigit() and packed.isascii() and 14 <= len(packed) <= 19,
        packed.isdigit() and packed.isascii() and 14 <= len(packed) <= 19 and luhn(packed),
        span[0] == "+" and 10 <= digits <= 15 and span[-1].isdigit(),
        span[0] in "+(" and span[-1].isdigit() and 9 <= digits <= 15 and all(c in "+()-. 0123456789" for c in span),
        bool(_HEX.fullmatch(span)),
        bool(_KEY.fullmatch(span)) and digits > 0,
        quoted,
        joined,
        digits == 0,
        digits == len(span),
        span[0].isalnum() and span[-1].isalnum(),
        j - i > 1,
        (j - i) / MAX_TOKENS,
        *(bool(before & _CUES[k]) for k in range(5)),
    ]
    return np.array(f, dtype=np.float64)


def _lattice(text: str, toks) -> np.ndarray:
    """Features [token, length - 1] of all candidate segments; a segment with a line break or a gap over two is none."""
    n = len(toks)
    out = np.full((n, MAX_TOKENS, N_FEATURES), np.nan)
    for i in range(n):
        for k in range(min(MAX_TOKENS, n - i)):
            if k and (toks[i + k][0] - toks[i + k - 1][1] > 2 or "\n" in text[toks[i + k - 1][1] : toks[i + k][0]]):
                break
            out[i, k] = _span_features(toks, text, i, i + k + 1)
    return out


def _scores(feats: np.ndarray, weights: np.ndarray) -> np.ndarray:
    s = feats @ weights
    return np.where(np.isnan(s), -np.inf, s)


def _forward(scores: np.ndarray) -> np.ndarray:
    n = len(scores)
    alpha = np.full(n + 1, -np.inf)
    alpha[0] = 0
    for j in range(1, n + 1):
        terms = [alpha[j - 1]]
        terms += [alpha[j - k - 1] + x for k in range(min(MAX_TOKENS, j)) for x in scores[j - k - 1, k]]
        m = max(terms)
        alpha[j] = m + np.log(np.exp(np.array(terms) - m).sum())
    return alpha


def _backward(scores: np.ndarray) -> np.ndarray:
    n = len(scores)
    beta = np.full(n + 1, -np.inf)
    beta[n] = 0
    for i in range(n - 1, -1, -1):
        terms = [beta[i + 1]]
        terms += [beta[i + k + 1] + x for k in range(min(MAX_TOKENS, n - i)) for x in scores[i, k]]
        m = max(terms)
        beta[i] = m + np.log(np.exp(np.array(terms) - m).sum())
    return beta


def viterbi(scores: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation: (first token, tokens, type) of its entities; other tokens stand alone with score 0."""
    n = len(scores)
    best, back = np.zeros(n + 1), [None] * (n + 1)
    kind, top = scores.argmax(2), scores.max(2)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for k in range(min(MAX_TOKENS, j)):
            x = best[j - k - 1] + top[j - k - 1, k]
            if x > best[j]:
                best[j], back[j] = x, (j - k - 1, k + 1, int(kind[j - k - 1, k]))
    out, j = [], n
    while j:
        if back[j]:
            out.append(back[j])
            j = back[j][0]
        else:
            j -= 1
    return out[::-1]


def _example(rng: random.Random) -> tuple[str, list[Span]]:
    """A generated line: plain words and numbers, with some entities."""
    word = lambda: "".join(rng.choice("aeioustnrhdl") for _ in range(rng.randint(2, 9)))
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = rng.choice("3456") + d(rng.choice([13, 14, 14, 14]))
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(["", "", " ", "-"])
        return sep.join(body[i : i + 4] for i in range(0, len(body), 4)) if sep else body

    entity = [
        lambda: f"{word()}{rng.choice(['.', '_', ''])}{d(rng.randint(0, 3))}{word()}@{word()}.{rng.choice(['com', 'org', 'net'])}",
        lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        card,
        lambda: rng.choice([f"+{rng.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"+{d(11)}", f"({d(3)}) {d(3)}-{d(4)}"]),
        lambda: rng.choice([lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([24, 32, 40])))])(),
    ]
    plain = [
        lambda: d(rng.randint(1, 6)), lambda: f"{d(2)}.{d(2)}", lambda: f"{rng.randint(1900, 2030)}", lambda: f"${d(3)}", lambda: f"{d(2)}:{d(2)}",
        lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/{rng.randint(1990, 2030)}", lambda: d(rng.randint(20, 30)),
        lambda: f"@{word()}", lambda: f"{word()}{d(3)}", lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: word().upper() * 2, lambda: f"{d(3)},{d(3)},{d(3)}",
    ]
    text, spans = "", []
    for _ in range(rng.randint(3, 9)):
        r = rng.random()
        if r < 0.22:
            k = rng.randrange(5)
            x = entity[k]()
            if k == 4 and x[0] != "A" and rng.random() < 0.8:
                text += rng.choice(['token = "', 'key: "', "secret='"])
                spans.append((len(text), len(text) + len(x), k))
                text += x + text[-1]
            else:
                if rng.random() < 0.3:
                    text += rng.choice(sorted(_CUES[k])) + rng.choice([": ", " "])
                spans.append((len(text), len(text) + len(x), k))
                text += x
        else:
            text += rng.choice(plain)() if r < 0.45 else word()
        text += rng.choice([" ", " ", " ", ", ", ". "])
    return text, spans


@functools.lru_cache(maxsize=2)
def train(examples: int = 220, epochs: int = 6, seed: int = 5) -> np.ndarray:
    """Weights [feature, type]: stochastic gradient ascent on the log likelihood of the labelled segmentations."""
    rng = random.Random(seed)
    data = []
    for _ in range(examples):
        text, spans = _example(rng)
        toks = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
        first, last = {a: i for i, (a, _) in enumerate(toks)}, {b: i for i, (_, b) in enumerate(toks)}
        gold = [(first[s], last[e] - first[s], k) for s, e, k in spans if s in first and e in last and last[e] - first[s] < MAX_TOKENS]
        data.append((_lattice(text, toks), gold))
    w = np.zeros((N_FEATURES, len(KINDS)))
    w[0] = -3
    g2 = np.full_like(w, 1e-2)
    for _ in range(epochs):
        for feats, gold in data:
            s = _scores(feats, w)
            alpha, beta = _forward(s), _backward(s)
            n = len(feats)
            grad = -1e-3 * w
            for i, k, y in gold:
                grad[:, y] += feats[i, k]
            inner = alpha[:n, None, None] + s - alpha[n]
            ends = np.minimum(np.arange(n)[:, None] + np.arange(MAX_TOKENS)[None, :] + 1, n)
            p = np.exp(np.where(np.isfinite(s), inner + beta[ends][:, :, None], -np.inf))
            grad -= np.einsum("nkf,nky->fy", np.nan_to_num(feats), p)
            g2 += grad * grad
            w += 0.5 * grad / np.sqrt(g2)
    return w


#: What a segment must hold for one of the features 1 to 9 to be true; and the cue words.
_STRONG = re.compile(r"[@+]|[0-9a-f]{16}|[A-Z]{4}[A-Z0-9]{12}|(?:[0-9][\x20().-]*+){9}|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]")
_CUE = re.compile(r"\b(?:" + "|".join(sorted(set.union(*_CUES.values()))) + r")\b", re.I)


def bound(weights: np.ndarray) -> float:
    """No segment without a strong match and without a cue word before it scores above this."""
    w = weights
    free = w[0] + np.maximum(w[[10, 11, 14, 15]], 0).sum(0) + np.maximum(0, np.maximum(w[12], w[13]))
    return float((free + np.maximum(w[16] / MAX_TOKENS, w[16])).max())


def _regions(text: str, toks: list[tuple[int, int]], weights: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of tokens outside which no segment can score above 0, apart from each other."""
    if not _bounded(weights.tobytes()):
        return [(0, len(toks))]
    starts, ends = [a for a, _ in toks], [b for _, b in toks]
    out: list[list[int]] = []
    for found in sorted([m.span() for m in _STRONG.finditer(text)] + [m.span() for m in _CUE.finditer(text)]):
        lo = max(0, bisect.bisect_right(ends, found[0]) - MAX_TOKENS - CUE_TOKENS)
        hi = min(len(toks), bisect.bisect_left(starts, found[1]) + MAX_TOKENS + CUE_TOKENS + 1)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


@functools.lru_cache(maxsize=4)
def _bounded(raw: bytes) -> bool:
    return bound(np.frombuffer(raw).reshape(N_FEATURES, len(KINDS))) <= 0


def _all_scores(text: str, toks: list[tuple[int, int]], weights: np.ndarray) -> np.ndarray:
    """_scores of the whole lattice, from slices of it with the tokens around them that features look at."""
    out = []
    for a in range(0, len(toks), SLICE_TOKENS):
        b, first = min(a + SLICE_TOKENS, len(toks)), max(0, a - 3)
        out.append(_scores(_lattice(text, toks[first : b + MAX_TOKENS]), weights)[a - first : b - first])
    return np.concatenate(out)


def added_spans(text: str, weights: np.ndarray, base: list[Span]) -> list[Span]:
    toks = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    out = []
    for lo, hi in _regions(text, toks, weights):
        part = toks[lo:hi]
        for i, k, y in viterbi(_all_scores(text, part, weights)) if part else ():
            s, e = part[i][0], part[i + k - 1][1]
            if all(e <= a or s >= b for a, b, _ in base):
                out.append((s, e, y))
    return out


def find(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), both ordered by start and then by kind."""
    base = base_spans(text)
    if _bounded(weights.tobytes()) and not _STRONG.search(text) and not _CUE.search(text):
        return base, base
    return base, sorted([*base, *added_spans(text, weights, base)], key=lambda s: (s[0], s[2], s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def _mapped(docs: DataFrame, schema: str, row: Callable, names: list[str]) -> DataFrame:
    weights = train()

    def run(it):
        for batch in it:
            for lo, hi in batches.slices(batches.byte_sizes(batch.column("text"))):
                part = batch.slice(lo, hi - lo)
                rows = [row(t, *find(t, weights)) for t in part.column("text").to_pylist()]
                cols = [pa.array([r[i] for r in rows]) for i in range(len(names))] if rows else []
                if rows:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], ["doc_id", *names])

    return batches.id_and_text(docs).mapInArrow(run, schema)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and spans of every row of docs."""

    def row(text, base, spans):
        counts = [0] * len(BASE)
        for _, _, k in base:
            counts[k] += 1
        return (*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans))

    names = [*(f"n_{k}" for k in BASE), "base_sha256", "spans"]
    return _mapped(docs, "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string", row, names)


def masked(text: str, spans: list[Span]) -> str:
    """text with each span, or union of overlapping spans, replaced by the kind of its first one."""
    out, done, open_until = [], 0, -1
    for s, e, k in spans:
        if s < open_until:
            open_until = done = max(open_until, e)
            continue
        out += [text[done:s], f"[{KINDS[k].upper()}]"]
        done = open_until = e
    return "".join(out) + text[done:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with the found spans masked in text; n_chars, where there is one, follows. A null text stays null."""
    weights, schema = train(), docs.schema

    def run(it):
        for batch in it:
            at, chars = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_chars")
            for lo, hi in batches.slices(batches.byte_sizes(batch.column(at))):
                part = batch.slice(lo, hi - lo)
                texts = [None if t is None else masked(t, find(t, weights)[1]) for t in part.column(at).to_pylist()]
                part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                if chars >= 0:
                    old = part.column(chars).to_pylist()
                    new = [n if t is None or n is None else len(t) for t, n in zip(texts, old)]
                    part = part.set_column(chars, part.schema.field(chars), pa.array(new, part.schema.field(chars).type))
                yield part

    return docs.mapInArrow(run, schema)
