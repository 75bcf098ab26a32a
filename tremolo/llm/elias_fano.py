"""Elias-Fano coding of sorted whole numbers, for numpy arrays and memory-mapped files."""

from __future__ import annotations

import numpy as np


class EliasFano:
    """A sorted sequence: the low bits of each number one after the other, the high bits as gaps in a bitmap.

    Numbers are found through a directory of the set bits before each DIRECTORY
    bytes of the bitmap, so a memory-mapped sequence is read where it is asked.
    """

    DIRECTORY = 64
    #: Stretches that are kept decoded, the ones asked last.
    KEPT = 16

    def __init__(self, n: int, low_bytes: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bytes, self.low, self.high = n, low_bytes, low, high
        self._ones: np.ndarray | None = None
        self._heads: dict[int, np.ndarray] = {}
        self._kept: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        """values: sorted uint64. The low part is a whole number of bytes, the one nearest to log2(universe / n) from below."""
        values = np.ascontiguousarray(values, dtype="<u8")
        n = len(values)
        if not n:
            return cls(0, 0, np.empty(0, dtype=np.uint8), np.empty(0, dtype=np.uint8))
        bits = max(0, int(values[-1]).bit_length() - max(1, n).bit_length() + 1)
        low_bytes = min(7, bits // 8)
        if (int(values[-1]) >> 8 * low_bytes) > 8 * n + 64:
            low_bytes += 1
        low = np.empty(n * low_bytes, dtype=np.uint8)
        if low_bytes:
            low.view(f"V{low_bytes}")[:] = np.ndarray(n, f"V{low_bytes}", values, strides=(8,))
        at = (values >> np.uint64(8 * low_bytes)).astype(np.int64) if low_bytes < 8 else np.zeros(n, dtype=np.int64)
        at += np.arange(n)
        bits = np.zeros(int(at[-1]) + 1, dtype=bool)
        bits[at] = True
        return cls(n, low_bytes, low, np.packbits(bits, bitorder="little"))

    def tobytes(self) -> bytes:
        return np.array([self.n, self.low_bytes, len(self.high)], dtype="<i8").tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def frombuffer(cls, data, offset: int = 0) -> EliasFano:
        """data: bytes or an array of bytes, such as a memory map; nothing is copied."""
        data = np.frombuffer(data, dtype=np.uint8) if isinstance(data, (bytes, bytearray, memoryview)) else data
        n, low_bytes, size = (int(x) for x in np.frombuffer(data[offset : offset + 24].tobytes(), dtype="<i8"))
        start = offset + 24 + n * low_bytes
        return cls(n, low_bytes, data[offset + 24 : start], data[start : start + size])

    @property
    def nbytes(self) -> int:
        return 24 + len(self.low) + len(self.high)

    def __len__(self) -> int:
        return self.n

    def _directory(self) -> np.ndarray:
        """Set bits before each group of the bitmap."""
        if self._ones is None:
            counts = np.bitwise_count(self.high).astype(np.int64)
            self._ones = np.concatenate([[0], np.cumsum(np.add.reduceat(counts, np.arange(0, len(counts), self.DIRECTORY)))]) if len(counts) else np.zeros(1, dtype=np.int64)
        return self._ones

    def decode(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Numbers start to stop."""
        stop = self.n if stop is None else min(stop, self.n)
        if start >= stop:
            return np.empty(0, dtype=np.uint64)
        ones = self._directory()
        a = int(np.searchsorted(ones, start, side="right")) - 1
        b = int(np.searchsorted(ones, stop - 1, side="right"))
        lo = a * self.DIRECTORY
        # of truth values, places are found far faster than of numbers
        at = np.flatnonzero(np.unpackbits(self.high[lo : b * self.DIRECTORY], bitorder="little").view(bool))
        at = at[start - int(ones[a]) : stop - int(ones[a])] - np.arange(start - lo * 8, stop - lo * 8)
        out = np.zeros(stop - start, dtype="<u8")
        if self.low_bytes:
            kind = f"V{self.low_bytes}"
            np.ndarray(stop - start, kind, out, strides=(8,))[:] = self.low[start * self.low_bytes : stop * self.low_bytes].view(kind)
        if self.low_bytes < 8:
            out |= at.astype(np.uint64) << np.uint64(8 * self.low_bytes)
        return out

    def successors(self, wanted: np.ndarray, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """For each number (sorted), the place of the first one of the sequence that is not below it (n if there is none), and whether they are equal.

        Only the stretches of the sequence that the numbers fall into are decoded.
        """
        place, equal = np.full(len(wanted), self.n, dtype=np.int64), np.zeros(len(wanted), dtype=bool)
        if not self.n or not len(wanted):
            return place, equal
        group = np.maximum(np.searchsorted(self.heads(step), wanted, side="left") - 1, 0)
        # a number may equal the head of the next stretch, so a stretch is decoded with it
        cut = np.flatnonzero(np.diff(group, prepend=-1))
        for lo, hi in zip(cut, [*cut[1:], len(wanted)]):
            first = int(group[lo]) * step
            own = self._stretch(first, first + step + 1)
            at = np.searchsorted(own, wanted[lo:hi], side="left")
            place[lo:hi] = first + at
            equal[lo:hi] = (at < len(own)) & (own[np.minimum(at, len(own) - 1)] == wanted[lo:hi])
        return place, equal

    def heads(self, step: int) -> np.ndarray:
        """Every step-th number."""
        if step not in self._heads:
            self._heads[step] = np.array([self.decode(i, i + 1)[0] for i in range(0, self.n, step)], dtype=np.uint64)
        return self._heads[step]

    def _stretch(self, start: int, stop: int) -> np.ndarray:
        own = self._kept.pop((start, stop), None)
        if own is None:
            own = self.decode(start, stop)
            if len(self._kept) >= self.KEPT:
                del self._kept[next(iter(self._kept))]
        self._kept[start, stop] = own
        return own
