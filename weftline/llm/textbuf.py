"""Vectorised views of Arrow string columns: bytes, words and rolling hashes.

Every operator of this subpackage that has to look at each word or byte of a
corpus works on these arrays instead of on Python strings. A column of texts
is one uint8 buffer with document offsets; words are (start, end) pairs into
it, found with table look-ups, and are hashed eight bytes at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes that separate words: space and the control characters 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Byte map that lower-cases A-Z and leaves everything else alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)
_LONG = 256
#: Bytes, or spans, that a step works on at once, so that its arrays stay in the processor's cache.
_BLOCK = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that low and high bits are usable alike."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M2
    x = x ^ (x >> np.uint64(27))
    x = x * _M3
    return x ^ (x >> np.uint64(31))


def text_buffer(column, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # several chunks that could not become one
        column = pa.concat_arrays(column.cast(pa.large_string()).chunks)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return (LOWER[raw] if lower else raw), off - off[0]


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside``; runs never cross an offset."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offset of each document) of the white-space words; words never cross an offset."""
    n = len(buf)
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, n, _BLOCK):
        hi = min(lo + _BLOCK, n)
        # the block's bytes and one on either side; places lo..hi that begin a document
        inside = np.zeros(hi - lo + 2, bool)
        inside[int(lo == 0) : len(inside) - int(hi == n)] = ~SPACE[buf[max(lo - 1, 0) : hi + 1]]
        cut = np.zeros(hi - lo + 1, bool)
        cut[offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")] - lo] = True
        own = inside[1:-1]
        starts.append(np.flatnonzero(own & (~inside[:-2] | cut[:-1])) + lo)
        ends.append(np.flatnonzero(own & (~inside[2:] | cut[1:])) + lo + 1)
    first = np.concatenate(starts)
    return first, np.concatenate(ends), np.searchsorted(first, offsets)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes of every span at a time."""
    out = np.empty(len(starts), np.uint64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    lanes = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    for lo in range(0, len(starts), _BLOCK):
        at = slice(lo, lo + _BLOCK)
        out[at] = _hash_block(buf, lanes, starts[at], ends[at])
    return out


_KEEP = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=np.uint64)


def _hash_block(buf: np.ndarray, lanes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    out = size.astype(np.uint64) * _M1 + np.uint64(1)
    active = np.arange(len(starts))
    at, left = starts, size
    long = np.flatnonzero(size > _LONG)
    if len(long):
        out[long] = [xxhash.xxh64_intdigest(buf[s:e].tobytes(), 7) for s, e in zip(starts[long], ends[long])]
        active = np.flatnonzero(size <= _LONG)
        at, left = starts[active], size[active]
    while len(active):
        lane = lanes[at] & _KEEP[np.minimum(left, 8)]
        out[active] = mix(out[active] ^ lane) + _M1
        more = left > 8
        active, at, left = active[more], at[more] + 8, left[more] - 8
    return out


def sorted_order(keys: np.ndarray) -> np.ndarray:
    """An order that sorts 64-bit keys, equal ones by place.

    Each key's first bits are sorted with its place behind them, as plain numbers; keys that only differ in the bits left out are rare,
    and if they come out of order, all are sorted by the whole keys.
    """
    low = np.uint64((1 << max(len(keys) - 1, 1).bit_length()) - 1)
    packed = keys & ~low
    packed |= np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    packed &= low
    order = packed.view(np.int64)
    found = keys[order]
    return order if (found[1:] >= found[:-1]).all() else np.argsort(keys, kind="stable")


def _odd_inverse(q: int) -> int:
    return pow(q, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def powers(q: int, n: int) -> np.ndarray:
    """q**0 .. q**(n-1) modulo 2**64, kept for the next call up to a bounded length."""
    have = _POWERS.get(q)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), q, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 1 << 21:
            _POWERS[q] = have
    return have[:n]


class Rolling:
    """Hashes of runs of values: ``of(starts, n)`` hashes n values from each start.

    Two of them, of both multipliers in QS, give 128 bits.
    """

    QS = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)

    def __init__(self, values: np.ndarray, which: int = 0):
        n, q = len(values), self.QS[which]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(q, n), out=self.sums[1:])
        self.back = powers(_odd_inverse(q), n + 1)

    def of(self, starts: np.ndarray, n) -> np.ndarray:
        return mix((self.sums[starts + n] - self.sums[starts]) * self.back[starts] + np.uint64(1))


def window_starts(offsets: np.ndarray, n: int) -> np.ndarray:
    """Positions that begin n values of one document."""
    size = np.diff(offsets) - (n - 1)
    size = np.maximum(size, 0)
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    return first + np.arange(total)


def classes(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, where each begins in it) of the distinct pairs of a 128-bit key, by hi, then lo; equal keys keep their order."""
    order = np.argsort(hi, kind="stable")
    a, b = hi[order], lo[order]
    same = a[1:] == a[:-1]
    if (b[1:][same] != b[:-1][same]).any():
        order = np.lexsort((lo, hi))
        a, b = hi[order], lo[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return order, np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, np.int64)


def spread(values: np.ndarray, order: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Values of classes given back to all their members."""
    out = np.empty(len(order), values.dtype)
    out[order] = np.repeat(values, np.diff(np.append(begin, len(order))))
    return out


def members(order: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.diff(np.append(begin, len(order)))
