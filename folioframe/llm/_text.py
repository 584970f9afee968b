"""Vectorised text kernels: byte classes, words, range hashes and window anchors, all on numpy arrays.

Range hashes are polynomials modulo 2**64 over random 64-bit unit values, taken from one prefix sum, so the hash
of any stretch costs a subtraction and a multiplication; a finaliser spreads the bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_B = 0x9E3779B97F4A7C1B  # odd; 3 modulo 8, so that powers keep differing in their low bits
_BINV = pow(_B, -1, 1 << 64)
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F], after A-Z have been lowered.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        both = []
        for base in (_B, _BINV):
            p = np.full(n, base, U64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers = (both[0], both[1])
    return _powers


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; works in a copy."""
    x = x ^ U64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0x9FB21C651E98DF25)
    x ^= x >> U64(32)
    return x


def prefix(units: np.ndarray) -> np.ndarray:
    p, _ = powers(len(units) + 1)
    s = np.zeros(len(units) + 1, U64)
    np.cumsum(units * p[: len(units)], out=s[1:])
    return s


def ranges(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of [start, end), the same for equal content wherever it lies; not yet mixed."""
    return (s[end] - s[start]) * powers(len(s))[1][start]


class Texts:
    """Texts as one byte buffer with the offsets of each; null counts as empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary() if pa.types.is_large_binary(column.type) else pa.large_string(), safe=False)
        if column.null_count:
            column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
        first, last = int(offsets[0]), int(offsets[-1])
        body = column.buffers()[2] if n else None
        data = np.frombuffer(body, np.uint8, last - first, first) if body is not None and last > first else np.zeros(0, np.uint8)
        return cls(data, offsets - first)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def slices(self, most: int):
        """(first, last) of consecutive texts with up to ``most`` bytes together; a longer text stands alone."""
        at = 0
        while at < len(self):
            to = int(np.searchsorted(self.offsets, self.offsets[at] + most, "right")) - 1
            to = min(max(to, at + 1), len(self))
            yield at, to
            at = to

    def part(self, a: int, b: int) -> Texts:
        o = self.offsets[a : b + 1]
        return Texts(self.data[o[0] : o[-1]], o - o[0])

    def take(self, which: list[int]) -> Texts:
        lens = np.array([self.offsets[i + 1] - self.offsets[i] for i in which], np.int64)
        data = np.concatenate([self.data[self.offsets[i] : self.offsets[i + 1]] for i in which]) if which else self.data[:0]
        return Texts(data, np.concatenate([[0], np.cumsum(lens)]).astype(np.int64))

    def bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes with ``inside``, and each text's offsets into them."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    m = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = m.copy()
    first[1:] &= ~m[:-1] | edge[1:-1]
    last = m.copy()
    last[:-1] &= ~m[1:] | edge[1:-1]
    ws, we = np.flatnonzero(first), np.flatnonzero(last) + 1
    return ws, we, np.searchsorted(ws, offsets)


#: Bytes hashed at a time, which bounds what hashing the words of a long text holds.
_STEP = 1 << 19


def word_hashes(data: np.ndarray, ws: np.ndarray, we: np.ndarray) -> np.ndarray:
    out = np.empty(len(ws), U64)
    k = 0
    while k < len(ws):
        first = int(ws[k])
        to = max(k + 1, int(np.searchsorted(we, first + _STEP, "right")))
        if we[k] - first > _STEP:  # one very long word, piece by piece
            out[k] = sum(int(prefix(BYTE_VALUES[data[o : min(o + _STEP, we[k])]])[-1]) * pow(_B, o - first, 1 << 64) for o in range(first, int(we[k]), _STEP)) % (1 << 64)
        else:
            s = prefix(BYTE_VALUES[data[first : we[to - 1]]])
            out[k:to] = ranges(s, ws[k:to] - first, we[k:to] - first)
        k = to
    return mix(out + (we - ws).astype(U64) * U64(0xA0761D6478BD642F), 1)


def whole_windows(offsets: np.ndarray, size: int, n: int) -> np.ndarray:
    """Whether [i, i + size) lies in one text, for every unit i."""
    step = np.zeros(n + 1, np.int32)
    lens = np.diff(offsets)
    fit = lens >= size
    np.add.at(step, offsets[:-1][fit], 1)
    np.add.at(step, (offsets[1:] - size + 1)[fit], -1)
    return np.cumsum(step[:n]) > 0


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    width, m = 1, v
    while width * 2 <= w:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: len(v) - w + 1], m[w - width : w - width + len(v) - w + 1]) if width < w else m


_LOW = U64((1 << 30) - 1)


class Runs:
    """Runs of consecutive windows that share their anchor, the least-hashed gram of ``gram`` units in each.

    Equal windows have the same anchor at the same place, so all comparisons between windows can be made among
    the runs of one anchor. doc, start, windows, at (the anchor's place): of each run; anchor, content: hashes of the anchor's gram and of
    all units that the run's windows cover.
    """

    def __init__(self, units: np.ndarray, offsets: np.ndarray, window: int, gram: int):
        self.window, n = window, len(units)
        self.prefix = s = prefix(units)
        whole = whole_windows(offsets, window, n)[: max(0, n - window + 1)]
        if not whole.any():
            self.doc = self.start = self.windows = self.at = np.zeros(0, np.int64)
            self.anchor = self.content = np.zeros(0, U64)
            return
        at = np.arange(n - gram + 1)
        g = mix(ranges(s, at, at + gram), 2)
        best = sliding_min((g & ~_LOW) | at.astype(U64), window - gram + 1)
        best = (best & _LOW).astype(np.int64)[: len(whole)]
        begins = whole.copy()
        begins[1:] &= ~whole[:-1] | (best[1:] != best[:-1])
        ends = whole.copy()
        ends[:-1] &= ~whole[1:] | (best[1:] != best[:-1])
        self.start = np.flatnonzero(begins)
        last = np.flatnonzero(ends)
        self.windows = last - self.start + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.at = a = best[self.start]
        self.anchor = g[a]
        length = (self.windows + window - 1).astype(U64)
        self.content = mix(ranges(s, self.start, last + window) + length * U64(0xE7037ED1A0B428DB) + (a - self.start).astype(U64) * U64(0x8EBC6AF09C88C6E3), 3)

    def window_hashes(self, runs: np.ndarray) -> np.ndarray:
        """Of all windows of these runs, one run after the other."""
        at = spread(self.start[runs], self.windows[runs])
        return mix(ranges(self.prefix, at, at + self.window), 4)


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each, count of them."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.repeat(start - (np.cumsum(count) - count), count)
    return base + np.arange(total)
