"""Hashes of stretches of byte arrays, for whole Arrow columns at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64


def _series(seed: int) -> tuple[np.ndarray, int, int]:
    rng = np.random.default_rng(seed)
    base = int(rng.integers(1 << 62)) * 2 + 1
    return rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1), base, pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Rolling:
    """Polynomial hashes, modulo 2**64, of any stretch of a byte array."""

    _powers: dict[tuple[int, bool], np.ndarray] = {}

    def __init__(self, data: np.ndarray, seed: int):
        values, base, inverse = _series(seed)
        n = len(data)
        self.inverse = self._power(inverse, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * self._power(base, n), out=self.sums[1:])

    @classmethod
    def _power(cls, base: int, n: int) -> np.ndarray:
        if len(cls._powers.get(base, ())) < n:
            steps = np.full(max(n, (1 << 19) + (1 << 13)), base, np.uint64)
            steps[0] = 1
            cls._powers[base] = np.multiply.accumulate(steps)
        return cls._powers[base][:n]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def every(self, length: int) -> np.ndarray:
        m = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:m]) * self.inverse[:m]) if m > 0 else np.zeros(0, np.uint64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column's bytes, one after another, and where each value ends."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]
