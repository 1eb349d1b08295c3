"""Columnar text kernels: whole Arrow batches as flat UTF-8 bytes, no per-row Python.

A block of rows is one byte buffer with row offsets. Words, lines and windows are index
arrays into it, and their hashes come from running polynomial sums over the block, so any slice
is hashed with subtractions and products. One sum is modulo 2**64 and two are modulo the prime
2**31 - 1: modulo a power of two alone, some regular texts (Thue-Morse words) are equal whatever
the base.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Rows are handled in blocks of about so many bytes; a longer text is a block by itself.
BLOCK_BYTES = (1 << 20) - 1024
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside words of [0-9a-z] and everything beyond ASCII, after lower-casing.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = 1 << (n - 1).bit_length()
            self.up, self.down = (self._grow(b, n) for b in (self.base, self.inverse))
        return self.up, self.down

    @staticmethod
    def _grow(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, U)
        out[0] = 1
        return np.multiply.accumulate(out)


_BYTES, _WORDS = _Powers(_BASE), _Powers(_WORD_BASE)
_TABLE = mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F))
PRIME = (1 << 31) - 1
_RESIDUES = [(_TABLE >> U(31 * k)) & U(PRIME) for k in (0, 1)]


def _reduced(x: np.ndarray) -> np.ndarray:
    """x below 2**63 modulo the prime, or the prime itself for 0."""
    x = (x & U(PRIME)) + (x >> U(31))
    return (x & U(PRIME)) + (x >> U(31))


class _PrimePowers(_Powers):
    """The same modulo the prime."""

    def __init__(self, base: int):
        super().__init__(base)
        self.inverse = pow(base, -1, PRIME)

    @staticmethod
    def _grow(base: int, n: int) -> np.ndarray:
        out = np.ones(n, U)
        size, power = 1, base
        while size < n:
            out[size : 2 * size] = out[:size] * U(power) % U(PRIME)
            size, power = 2 * size, power * power % PRIME
        return out


_PRIMES = _PrimePowers(0x2C7A61D3), _PrimePowers(0x5A1F34E9)


class Running:
    """Running sums over a sequence of uint64 values; hash of any [start, end) in O(1).

    residues gives the values modulo the prime, one sequence for each of its bases; without it they are taken from the values.
    """

    def __init__(self, values: np.ndarray, powers: _Powers = _WORDS, residues=None):
        up, self._down = powers.upto(len(values) + 1)
        self._sum = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[: len(values)], out=self._sum[1:])
        self._residues = residues or (lambda k: (values >> U(31 * k)) & U(PRIME))
        self._prime_sums: list[tuple[np.ndarray, np.ndarray]] = []

    def grams(self, width: int) -> np.ndarray:
        """Hash of the width values from each place on; ordered at random by its high bits, not mixed in its low ones."""
        n = len(self._sum) - width
        out = self._sum[width:] - self._sum[:n]
        out *= self._down[:n]
        return out

    def _primes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Both hashes modulo the prime, side by side; their running sums are made when first needed."""
        n = len(self._sum) - 1
        if not self._prime_sums:
            for k, powers in enumerate(_PRIMES):
                up, down = powers.upto(n + 1)
                part = self._residues(k)
                part *= up[:n]
                high = part >> U(31)
                part &= U(PRIME)
                part += high
                total = np.zeros(n + 1, U)
                np.cumsum(part, out=total[1:])
                self._prime_sums.append((total, down))
        out = np.zeros(len(start), U)
        for total, down in self._prime_sums:
            part = _reduced(total[end] - total[start])
            part *= down[start]
            part = _reduced(part)
            part[part == PRIME] = 0
            out <<= U(32)
            out |= part
        return out

    def _wide(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self._sum[end] - self._sum[start]) * self._down[start]
        h += np.asarray(end - start).astype(U) * U(0x9FB21C651E98DF25)
        return h

    def quick(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64 bits modulo 2**64 alone, where equal hashes of different slices do no harm."""
        return mix(self._wide(start, end))

    def pair(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 bits of hash, and 32 more."""
        h = self._wide(start, end)
        primes = mix(self._primes(start, end))
        return mix(h ^ primes), (mix(primes + U(0x2545F4914F6CDD1D)) >> U(32)).astype(np.uint32)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.pair(start, end)[0]


def over_bytes(data: np.ndarray) -> Running:
    return Running(_TABLE[data], _BYTES, lambda k: _RESIDUES[k][data])


class Block:
    """Some rows: data (uint8), offs (row i is data[offs[i]:offs[i+1]]), lo (first row in the batch)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lo: int):
        self.data, self.offs, self.lo, self.n = data, offs, lo, len(offs) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()

    def words(self, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word, and at which word each row begins (n + 1 values)."""
        size = len(self.data)
        if not size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)
        sep = separators[self.data]
        edge = np.zeros(size + 1, bool)
        edge[self.offs] = True
        before = np.empty(size, bool)
        before[0], before[1:] = True, sep[:-1]
        starts = np.flatnonzero(~sep & (before | edge[:-1]))
        after = np.empty(size, bool)
        after[-1], after[:-1] = True, sep[1:]
        ends = np.flatnonzero(~sep & (after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offs)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each line (split at newlines), and the row of each."""
        marks = np.flatnonzero(self.data == 10)
        rows = np.searchsorted(self.offs, marks, side="right") - 1
        starts = np.concatenate([self.offs[:-1], marks + 1])
        ends = np.concatenate([marks, self.offs[1:]])
        row_s, row_e = np.concatenate([np.arange(self.n), rows]), np.concatenate([rows, np.arange(self.n)])
        by_s, by_e = np.lexsort((starts, row_s)), np.lexsort((ends, row_e))
        return starts[by_s], ends[by_e], row_s[by_s]


def row_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def cover(starts: np.ndarray, width: int | np.ndarray, size: int) -> np.ndarray:
    """Which of size positions lie in [s, s + width) for some s."""
    delta = np.zeros(size + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + width, size), -1)
    return np.cumsum(delta[:-1]) > 0


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offs, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column's rows, a block at a time; whole texts, whatever their length."""
    offs, data = strings(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1)
        yield Block(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], lo)
        lo = hi


def ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """doc_id as int64 (null: 0) and which are not null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    known = np.asarray(column.is_valid())
    return np.asarray(pc.fill_null(column, 0)).astype(np.int64), known
