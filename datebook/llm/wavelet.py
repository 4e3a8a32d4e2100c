"""Bit planes with rank and select, and the wavelet matrix over them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Bits:
    """A bit vector in 64-bit words with the number of ones before each word."""

    def __init__(self, words: np.ndarray, size: int):
        self.words, self.size = words, size
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])
        self.ones = int(self.before[-1])

    @classmethod
    def of(cls, bits: np.ndarray) -> Bits:
        """From booleans; the first bit is the lowest of the first word."""
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        return cls(words, len(bits))

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def all(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.size, bitorder="little").view(bool)

    def select(self, k: np.ndarray, one: bool = True) -> np.ndarray:
        """Place of the k-th one or zero, from 0; ``k`` must be below their number."""
        count = self.before if one else np.arange(len(self.before)) * 64 - self.before
        word = np.searchsorted(count, k, "right") - 1
        rest = k - count[word]
        bits = self.words[word] if one else ~self.words[word]
        lanes = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return word * 64 + (np.cumsum(lanes, axis=1, dtype=np.int8) == (rest + 1)[:, None]).argmax(axis=1)


#: Bits of a frame, the piece of a plane that is read at once.
FRAME = 1 << 16


class FramedBits:
    """A bit vector kept in frames of ``FRAME`` bits, each loaded when it is first asked for.

    ``before`` has the ones before each frame and, last, those of the whole vector.
    """

    def __init__(self, load: Callable[[int], np.ndarray], before: np.ndarray, size: int):
        self.load, self.before, self.size, self.ones = load, before, size, int(before[-1])
        self.loaded: dict[int, Bits] = {}

    def frame(self, k: int) -> Bits:
        if k not in self.loaded:
            self.loaded[k] = Bits(self.load(k), min(FRAME, self.size - k * FRAME))
        return self.loaded[k]

    def _each(self, frames: np.ndarray, kind: type, work: Callable[[Bits, np.ndarray], np.ndarray]) -> np.ndarray:
        """``work`` on each frame and the places that fall to it."""
        out = np.zeros(len(frames), kind)
        for k in np.unique(frames).tolist():
            mine = np.flatnonzero(frames == k)
            out[mine] = work(self.frame(k), mine)
        return out

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self._each(at // FRAME, bool, lambda f, mine: f[at[mine] % FRAME])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        return self.before[at // FRAME] + self._each(at // FRAME, np.int64, lambda f, mine: f.rank(at[mine] % FRAME))

    def select(self, k: np.ndarray, one: bool = True) -> np.ndarray:
        """Place of the k-th one or zero, from 0; ``k`` must be below their number."""
        count = self.before if one else np.minimum(np.arange(len(self.before)) * FRAME, self.size) - self.before
        frames = np.searchsorted(count, k, "right") - 1
        return frames * FRAME + self._each(frames, np.int64, lambda f, mine: f.select(k[mine] - count[frames[mine]], one))

    def all(self) -> np.ndarray:
        """All bits; no frame is kept for it."""
        words = np.concatenate([self.load(k) for k in range(len(self.before) - 1)])
        return np.unpackbits(words.view(np.uint8), count=self.size, bitorder="little").view(bool)


class WaveletMatrix:
    """Symbols of ``levels`` bits as one bit plane a level, highest bit first."""

    def __init__(self, planes: list[Bits | FramedBits], size: int):
        self.planes, self.size = planes, size
        self.zeros = [p.size - p.ones for p in planes]

    @classmethod
    def of(cls, symbols: np.ndarray, levels: int) -> WaveletMatrix:
        planes, now = [], symbols
        for level in range(levels - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            planes.append(Bits.of(bit))
            now = np.concatenate([now[~bit], now[bit]])
        return cls(planes, len(symbols))

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for plane, zeros in zip(self.planes, self.zeros):
            bit, ones = plane[at], plane.rank(at)
            at = np.where(bit, zeros + ones, at - ones)
            out = out << 1 | bit
        return out

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        start = np.zeros(len(at), np.int64)
        for level, (plane, zeros) in zip(range(len(self.planes) - 1, -1, -1), zip(self.planes, self.zeros)):
            bit = (symbol >> level & 1).astype(bool)
            low, high = plane.rank(start), plane.rank(at)
            start, at = np.where(bit, zeros + low, start - low), np.where(bit, zeros + high, at - high)
        return at - start

    def select(self, symbol: int, k: np.ndarray) -> np.ndarray:
        """Places of the k-th occurrences of one symbol, from 0; ``k`` must be below their number."""
        start = np.zeros(1, np.int64)
        for level, (plane, zeros) in zip(range(len(self.planes) - 1, -1, -1), zip(self.planes, self.zeros)):
            ones = plane.rank(start)
            start = zeros + ones if symbol >> level & 1 else start - ones
        at = start[0] + k
        for level, (plane, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1])):
            at = plane.select(at - zeros) if symbol >> level & 1 else plane.select(at, one=False)
        return at

    def symbols(self) -> np.ndarray:
        """All symbols in order."""
        out = np.zeros(self.size, np.uint32 if len(self.planes) > 16 else np.uint16)
        for level, (plane, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1])):
            bit, above = plane.all(), np.empty_like(out)
            above[~bit] = out[:zeros]
            above[bit] = out[zeros:] | out.dtype.type(1 << level)
            out = above
        return out
