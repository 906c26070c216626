"""Words of many texts at once, as numpy arrays over one buffer of UTF-8 bytes.

Texts are never joined or cut: a word belongs to one row, whole. Hashes are 64 bits wide; two
different words or shingles of one comparison share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_STEP = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (xor-shift-multiply rounds)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: A 64-bit number for each byte value.
_BYTE = mix(np.arange(1, 257, dtype=U) * _STEP) | U(1)
_BASE = U(0xD1342543DE82EF95)
_POWERS = np.ones(64, U)
for _i in range(1, 64):  # wraps around, as intended
    _POWERS[_i] = int(_POWERS[_i - 1]) * int(_BASE) % (1 << 64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base (mod 2**64), n a word's length at most."""
    global _POWERS
    while len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate((_POWERS, _POWERS * (_POWERS[-1] * _BASE)))
    return _POWERS


class Words:
    """Words (runs of bytes that aren't separators) of the rows of an Arrow string column."""

    def __init__(self, column: pa.Array, separator: np.ndarray = _SPACE, lower: np.ndarray = LOWER):
        column = pa.compute.fill_null(column.cast(pa.large_binary()), b"")
        self.n_rows = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + self.n_rows + 1]
        raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.raw, self.offsets = raw, offsets - offsets[0]
        self.data = lower[raw]
        inside = np.empty(len(raw) + 1, bool)
        inside[:-1] = ~separator[raw]
        inside[-1] = False
        self.inside = inside[:-1]
        change = np.empty(len(raw) + 1, bool)
        change[0] = inside[0]
        np.not_equal(inside[1:], inside[:-1], out=change[1:])
        edges = np.flatnonzero(change)
        starts, ends = edges[::2], edges[1::2]
        # a word that runs over the border of two rows is cut there
        inner = self.offsets[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < len(raw))])
        if len(inner):
            cut = inner[inside[inner] & inside[inner - 1]]
            if len(cut):
                starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
        self.starts, self.ends = starts, ends
        self.row = np.searchsorted(self.offsets, starts, side="right") - 1
        self.first = np.searchsorted(starts, self.offsets)  # first word of each row, and the end

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's lower-cased bytes."""
        if not len(self):
            return np.zeros(0, U)
        lengths = self.ends - self.starts
        begin = np.cumsum(lengths) - lengths
        letters = self.data[self.inside]  # without separators, so words lie side by side
        place = np.arange(len(letters), dtype=np.int32)
        place -= np.repeat(begin.astype(np.int32), lengths)
        terms = _BYTE[letters]
        terms *= powers(int(lengths.max()))[place]
        return mix(np.add.reduceat(terms, begin) + lengths.astype(U) * _STEP)


#: Powers of an odd base and of its inverse (mod 2**64), as many as were needed so far.
_SHINGLE = [np.ones(1, U), np.ones(1, U)]
_SHINGLE_BASE = 0x9DDFEA08EB382D69


def _shingle_powers(n: int) -> list[np.ndarray]:
    if len(_SHINGLE[0]) < n:
        for i, base in enumerate((_SHINGLE_BASE, pow(_SHINGLE_BASE, -1, 1 << 64))):
            steps = np.full(2 * n, base, U)
            steps[0] = 1
            _SHINGLE[i] = np.cumprod(steps)
    return _SHINGLE


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words, and the first run of each row (rows' ends last).

    A row with fewer words, but any, gives its whole sequence as one run. A run's hash is a
    polynomial in a fixed base over its words' hashes, from differences of prefix sums.
    """
    counts = np.diff(first)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begin = np.concatenate(([0], np.cumsum(runs)))
    at = np.repeat(first[:-1] - begin[:-1], runs) + np.arange(begin[-1])
    length = np.repeat(np.minimum(counts, size), runs)
    power, inverse = _shingle_powers(len(hashes) + 1)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(hashes * power[: len(hashes)])))
    return mix((sums[at + length] - sums[at]) * inverse[at] + length.astype(U)), begin
