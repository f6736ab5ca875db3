"""Shared vectorised text helpers: Arrow text columns are cut into words and hashed without Python loops over words.

A word's hash is a polynomial over its bytes modulo 2**64, mixed to spread all bits; equal hashes are taken as equal words
(about V*V/2**65 expected clashes among V distinct words).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []

#: Words that end only at white space; A-Z count as a-z.
SPACE_WORDS = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
#: Words of ASCII letters, digits and everything beyond ASCII.
ALNUM_WORDS = np.array([0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for m in (_BASE, _INV):
            row = np.full(size, m, np.uint64)
            row[0] = 1
            _POWERS.append(np.cumprod(row))
        del _POWERS[:-2]
    return _POWERS[0], _POWERS[1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and each row's offsets (n + 1); nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def row_blocks(column: pa.Array, most: int = 1 << 20):
    """Yields (first row, past last row, bytes, offsets) in blocks of about `most` bytes; a longer text is a block of its own."""
    data, offs = text_buffer(column)
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


class Words:
    """Words of a block of texts: start and end bytes, row of each, and the number per row."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, word_bytes: np.ndarray):
        self.n_rows = len(offs) - 1
        inside = word_bytes[data] if len(data) else np.zeros(0, bool)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = offs[:-1][offs[:-1] < offs[1:]]
        first[heads] = inside[heads]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        tails = offs[1:][offs[:-1] < offs[1:]] - 1
        last[tails] = inside[tails]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        at = np.searchsorted(self.starts, offs)
        self.first, self.counts = at[:-1], np.diff(at)
        self.rows = np.repeat(np.arange(self.n_rows), self.counts)
        self._data = data

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """Hash of each word, or of its first `longest` bytes; A-Z count as a-z."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        up, down = _powers(len(self._data) + 1)
        sums = np.zeros(len(self._data) + 1, np.uint64)
        np.cumsum((_LOWER[self._data].astype(np.uint64) + np.uint64(1)) * up[: len(self._data)], out=sums[1:])
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        return mix((sums[ends] - sums[self.starts]) * down[self.starts])


def words_of(text: str, word_bytes: np.ndarray = ALNUM_WORDS) -> np.ndarray:
    """Hashes of one text's words."""
    data = np.frombuffer(text.encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), word_bytes).hashes()


def hash_words(items: list[str]) -> np.ndarray:
    """Hashes of given words, as Words.hashes gives them."""
    data, offs = text_buffer(pa.array(items, pa.string()))
    return Words(data, offs, np.ones(256, bool)).hashes()


def array_of(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List column from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
