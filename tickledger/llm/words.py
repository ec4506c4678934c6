"""Words of whole Arrow columns as arrays: where they lie, and a 64-bit hash of each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed together (a longer word is taken whole).
STRIP = 1 << 17
#: Bytes of text in a block (a longer text is a block of its own).
BLOCK = 4 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_ODD = 0x9E3779B97F4A7C15
_LETTER = np.random.default_rng(0x51).integers(1 << 63, size=256, dtype=np.int64).view(np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit (wraps around)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of two hashes, in this order."""
    return scramble(a * np.uint64(0xC2B2AE3D27D4EB4F) + (b ^ np.uint64(salt)))


def windows(h: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hash of every ``length`` consecutive hashes, built by joining two (overlapping) halves at each step."""
    size = 1
    while size < length:
        step = min(size, length - size)
        h = pair(h[: max(0, len(h) - step)], h[step:], salt)
        size += step
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0][0]) < n:
        both = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            p = np.full(max(n, STRIP + 1), np.uint64(base))
            p[0] = 1
            both.append(np.cumprod(p))
        _powers[0] = (both[0], both[1])
    return _powers[0]


class Words:
    """Words of a string column: bytes ``data``, their ``start`` and ``end`` there, and the ``first`` word of each row (one more at the end)."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and len(column) else np.empty(0, np.uint8)
        off = off - off[0]
        ink = np.empty(len(self.data) + 2, bool)
        ink[0] = ink[-1] = False
        np.logical_not(_WHITE[self.data], out=ink[1:-1])
        border = np.zeros(len(self.data) + 1, bool)
        border[off] = True
        self.start = np.flatnonzero(ink[1:-1] & (~ink[:-2] | border[:-1]))
        self.end = np.flatnonzero(ink[1:-1] & (~ink[2:] | border[1:])) + 1
        self.first = np.searchsorted(self.start, off)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word: its bytes as a polynomial, with its length, scrambled."""
        out, a = np.empty(len(self), np.uint64), 0
        while a < len(self):
            b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + STRIP, "right")))
            low, high = self.start[a], self.end[b - 1]
            up, down = powers(int(high - low) + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_LETTER[self.data[low:high]] * up[: high - low], out=sums[1:])
            s, e = self.start[a:b] - low, self.end[a:b] - low
            out[a:b] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
            a = b
        return scramble(out)

    def left(self) -> np.ndarray:
        """For every word, how many words its row has from it on."""
        return np.repeat(self.first[1:], self.counts()) - np.arange(len(self))


def blocks(batch: pa.RecordBatch, column: int, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of rows with at most ``size`` bytes of text, or of one row."""
    n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, a = np.cumsum(n), 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + size, "right")))
        yield batch.slice(a, b - a)
        a = b


def joined(words: list[bytes]) -> str:
    return b" ".join(words).decode()
