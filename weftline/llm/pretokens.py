"""Byte-level BPE's pre-tokens of a whole slice of texts, as byte spans.

The pattern splits runs of letters, numbers, other characters and white space,
each with the blank before it, and the English contractions. Here the classes
of all bytes come from a table, and the rules are applied to all runs at once.
Texts with white space outside ASCII, which the rules for runs do not cover,
are left to the pattern itself.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

# The pre-token pattern of byte-level BPE, with white space spelt out as Unicode's White_Space.
_WS = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
OTHER, LETTER, NUMBER, BLANK, WIDE = 0, 1, 2, 3, 4
findall = regex.compile(PATTERN).findall


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WIDE, f"[{_WS}]+")):
        for run in regex.findall(pattern, every):
            out[ord(run[0]) : ord(run[-1]) + 1] = kind
    out[[0x20, *range(9, 14)]] = BLANK
    return out


def _byte_classes(buf: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table = _classes()
    out = table[:256][buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        b = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.uint32)
        x = b[lead]
        cp = np.where(
            x < 0xE0, (x & 0x1F) << 6 | b[lead + 1] & 0x3F,
            np.where(x < 0xF0, (x & 0x0F) << 12 | (b[lead + 1] & 0x3F) << 6 | b[lead + 2] & 0x3F,
                     (x & 0x07) << 18 | (b[lead + 1] & 0x3F) << 12 | (b[lead + 2] & 0x3F) << 6 | b[lead + 3] & 0x3F),
        )
        kind = table[cp]
        out[lead] = kind
        for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            out[lead[x >= least] + k] = kind[x >= least]
    return out


def spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, token offset of each document)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cls = _byte_classes(buf)
    new = np.ones(n + 1, bool)
    np.not_equal(cls[1:], cls[:-1], out=new[1:n])
    new[offsets] = True
    at = np.flatnonzero(new)
    start, end = at[:-1].copy(), at[1:].copy()
    kind = cls[start]
    doc_start = np.zeros(n + 1, bool)
    doc_start[offsets] = True
    followed = ~doc_start[end]  # another run of the same document follows
    blank = kind == BLANK
    loose = np.flatnonzero(blank & followed)
    lends = buf[end[loose] - 1] == 0x20
    # a run of blanks before a token gives it its last blank, or stands without its last character
    taken = loose[lends]
    start[taken + 1] -= 1
    end[taken] -= 1
    split = loose[~lends & (end[loose] - start[loose] > 1)]
    extra_start = end[split] - 1
    extra_end = end[split].copy()
    end[split] -= 1
    # contractions: a lone apostrophe, without a blank, and the letters right behind it
    lone = np.flatnonzero((kind == OTHER) & (end - start == 1) & followed)
    lone = lone[buf[start[lone]] == 0x27]
    lone = lone[kind[lone + 1] == LETTER]
    gone = np.zeros(len(start), bool)
    for i in lone.tolist():
        tail = bytes(buf[start[i + 1] : min(start[i + 1] + 2, end[i + 1])])
        for c in CONTRACTIONS:
            if tail.startswith(c):
                end[i] += len(c)
                start[i + 1] += len(c)
                break
    gone |= start >= end
    start, end = np.concatenate([start[~gone], extra_start]), np.concatenate([end[~gone], extra_end])
    if len(extra_start):
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
    odd = np.flatnonzero(cls == WIDE)
    if len(odd):
        start, end = _by_pattern(buf, offsets, start, end, np.unique(np.searchsorted(offsets, odd, side="right") - 1))
    return start, end, np.searchsorted(start, offsets)


def _by_pattern(buf, offsets, start, end, docs):
    """The spans of these documents replaced by those of the pattern."""
    first = np.searchsorted(start, offsets)
    keep = np.ones(len(start), bool)
    more_s, more_e = [], []
    for d in docs.tolist():
        keep[first[d] : first[d + 1]] = False
        size = np.array([len(w.encode()) for w in findall(bytes(buf[offsets[d] : offsets[d + 1]]).decode())], dtype=np.int64)
        ends = offsets[d] + np.cumsum(size)
        more_s.append(ends - size)
        more_e.append(ends)
    start, end = np.concatenate([start[keep], *more_s]), np.concatenate([end[keep], *more_e])
    order = np.argsort(start, kind="stable")
    return start[order], end[order]
