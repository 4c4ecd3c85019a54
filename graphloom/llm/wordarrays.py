"""Words of many texts as flat arrays: exact, whole texts, no loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
#: For looser words: ASCII letters, digits and all bytes of longer code points count, all else parts words.
PARTS = np.ones(256, bool)
PARTS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_MIX = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SLAB = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & (2**64 - 1)))
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _SLAB + 1), _powers(pow(_BASE, -1, 1 << 64), _SLAB + 1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls are empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, ends, data = col.buffers()
    offsets = np.frombuffer(ends, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of several texts, joined by single spaces in one buffer.

    buf: the words, each followed by a space. start[i]: where word i starts;
    start[n] is the length. first[d]: the number of the first word of text d.
    """

    def __init__(self, buf: np.ndarray, start: np.ndarray, first: np.ndarray):
        self.buf, self.start, self.first = buf, start, first
        self.n = len(start) - 1

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, lower: bool = False, white: np.ndarray = _WHITE) -> Words:
        inside = ~white[data]
        n = len(data)
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edges = offsets[offsets < n]
        begin[edges] = inside[edges]
        edges = offsets[offsets > 0] - 1
        end[edges] = inside[edges]
        a = np.flatnonzero(begin)
        size = np.flatnonzero(end) + 1 - a
        start = np.zeros(len(a) + 1, np.int64)
        np.cumsum(size + 1, out=start[1:])
        kept = data[inside]
        if lower:
            kept = np.where((kept >= 65) & (kept <= 90), kept + np.uint8(32), kept)
        buf = np.full(int(start[-1]), 32, np.uint8)
        place = np.ones(len(buf), bool)
        place[start[1:] - 1] = False
        buf[place] = kept
        return cls(buf, start, np.searchsorted(a, offsets).astype(np.int64))

    @classmethod
    def packed(cls, buf: np.ndarray, ends: np.ndarray) -> Words:
        """Back from a buffer in which every word is followed by a space; ends: where each text ends."""
        start = np.append(0, np.flatnonzero(buf == 32) + 1)
        return cls(buf, start, np.searchsorted(start, np.append(0, ends)).astype(np.int64))

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words, in slabs of whole words (a longer word is folded)."""
        out = np.empty(self.n, np.uint64)
        at = 0
        while at < self.n:
            to = max(at + 1, int(np.searchsorted(self.start, self.start[at] + _SLAB, side="right")) - 1)
            lo, hi = self.start[at], self.start[to]
            part = self.buf[lo:hi]
            if len(part) > _SLAB:  # one giant word
                h = np.uint64(0)
                for i in range(0, len(part), _SLAB):
                    p = part[i : i + _SLAB]
                    h = mixed(np.array([h + (_MIX[p] * _UP[: len(p)]).sum()]))[0]
                out[at] = h
            else:
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(_MIX[part] * _UP[: len(part)], out=sums[1:])
                s, e = self.start[at:to] - lo, self.start[at + 1 : to + 1] - lo
                out[at:to] = (sums[e] - sums[s]) * _DOWN[s]
            at = to
        return mixed(out)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``width`` consecutive entries."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, width):
        out *= np.uint64(_BASE)
        out += h[j : j + n]
    return mixed(out)


def rolled_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minima of every ``width`` consecutive entries."""
    done, out = 1, h
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether buf[a:a+size] equals buf[b:b+size], pair by pair."""
    out = np.ones(len(a), bool)
    step = 4096
    for i in range(0, len(a), step):
        n = size[i : i + step]
        ends = np.cumsum(n)
        if not len(n) or not ends[-1]:
            continue
        within = np.arange(ends[-1]) - np.repeat(ends - n, n)
        same = buf[np.repeat(a[i : i + step], n) + within] == buf[np.repeat(b[i : i + step], n) + within]
        some = n > 0
        out[i : i + step][some] = np.logical_and.reduceat(same, (ends - n)[some])
    return out
