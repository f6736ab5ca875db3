"""Ids of whole text columns, piece by piece.

A space before a character other than white space always starts a new pre-token, so what lies between two such spaces can be
encoded apart. A block of texts is cut there, its distinct pieces are found by dictionary encoding, only those are looked up
or encoded, and the ids of all pieces are gathered from theirs. Nulls are empty texts; empty texts have no ids.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textkit import row_blocks

#: Pieces and pre-tokens up to so many bytes are remembered, at most two generations of so many.
KEPT_BYTES, GENERATION = 64, 400_000
PIECES_AT_ONCE = 1 << 20
_PLAIN = np.array([b > 0x20 and b not in (0xC2, 0xE1, 0xE2, 0xE3) for b in range(256)])
#: UTF-8 forms of the white space beyond ASCII (Unicode property White_Space; fixed values).
_WHITE = np.array([int.from_bytes(chr(c).encode().ljust(3, b"\0"), "big") for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])


_ODD, _FEED = 9, 4
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[0x21:0x7F] = 1
_CLASS[0x27] = _ODD
_CLASS[0x30:0x3A] = 2
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:0xC0] = _CLASS[0xC3:0xC6] = 3
_CLASS[0x0A] = _FEED


class Remembered:
    """A function's results by key, in two generations: what a whole generation has not asked for is forgotten."""

    def __init__(self, make: Callable[[bytes], bytes], size: int = GENERATION):
        self.make, self.size = make, size
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def __call__(self, key: bytes) -> bytes:
        got = self.new.get(key)
        if got is None:
            got = self.old.get(key)
            if got is None:
                got = self.make(key)
            if len(key) <= KEPT_BYTES:
                if len(self.new) >= self.size:
                    self.old, self.new = self.new, {}
                self.new[key] = got
        return got

    def all(self, keys: list[bytes]) -> list[bytes]:
        get = self.new.get
        return [get(k) or self(k) for k in keys]


def piece_places(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where pieces start, the end of the data last."""
    at = np.flatnonzero(data[:-1] == 0x20) if len(data) else np.zeros(0, np.int64)
    after = data[at + 1]
    good = _PLAIN[after]
    odd = np.flatnonzero(~good & (after >= 0x80))
    if len(odd):
        # Only a text's last bytes could reach beyond it, and a cut there is taken from the offsets anyhow.
        wide = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int64)
        p = at[odd] + 1
        two = wide[p] << 16 | wide[p + 1] << 8
        good[odd] = ~np.isin(np.where(after[odd] == 0xC2, two, two | wide[p + 2]), _WHITE)
    return _merged(at[good], offs)


def cut_places(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where pieces start, or in pieces of simple characters their pre-tokens; the end of the data last.

    Simple are letters, digits and signs of ASCII but the apostrophe, letters from U+00C0 to U+017F, line feeds, and the space
    that a piece may start with. A pre-token there ends where the class changes; of line feeds before another character the
    last is one of its own."""
    at = piece_places(data, offs)
    if len(at) < 2:
        return at
    kind = _CLASS[data]
    c3 = np.flatnonzero(data[:-1] == 0xC3)
    kind[c3[np.isin(data[c3 + 1], (0x97, 0xB7))]] = _ODD  # the two signs among those letters
    odd = np.zeros(len(at) - 1, bool)
    heads = at[:-1]
    lead = heads[data[heads] == 0x20]
    lead = lead[lead + 1 < len(data)]
    kind[lead] = np.where(kind[lead + 1] == _FEED, _ODD, kind[lead + 1])
    odd[np.searchsorted(at, np.flatnonzero(kind == _ODD), "right") - 1] = True
    change = kind[1:] != kind[:-1]
    feed = np.flatnonzero(data[1:-1] == 0x0A)
    change[feed] |= data[feed + 2] != 0x0A  # taken back where that byte is another piece's
    p = np.flatnonzero(change) + 1
    of = np.searchsorted(at, p, "right") - 1
    last_feed = (data[p] == 0x0A) & (data[p - 1] == 0x0A) & (p + 1 == at[of + 1])
    return _merged(p[~odd[of] & (p != at[of]) & ~last_feed], at)


def _merged(at: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Distinct places of both, in order."""
    both = np.insert(at, np.searchsorted(at, more), more) if len(more) * 8 < len(at) else np.sort(np.concatenate((at, more)), kind="stable")
    return both[np.concatenate(([True], both[1:] != both[:-1]))]


def gathered(parts: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of parts[c] for all codes, one after the other, and the number of each."""
    size = np.fromiter(map(len, parts), np.int64, len(parts)) >> 1
    flat = np.frombuffer(b"".join(parts), "<u2")
    start = np.cumsum(size) - size
    n = size[codes]
    ends = np.cumsum(n)
    at = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    if len(at):
        # Steps of one inside a part, a jump at the start of each that has ids.
        full = np.flatnonzero(n)
        first, last = start[codes[full]], start[codes[full]] + n[full] - 1
        at[0] = first[0]
        at[ends[full[:-1]]] = first[1:] - last[:-1]
        np.cumsum(at, out=at)
    return flat[at], n


def column_ids(column: pa.Array, pieces: Remembered, special: re.Pattern | None, whole: Callable[[str], bytes], most: int = 8 << 20):
    """Yields (ids, number of each row) for blocks of the rows, in order; rows with a special token's text go to `whole`.
    A block has about `most` bytes, or is one longer text."""
    for a, b, data, offs in row_blocks(column, most):
        apart = {}
        if special is not None:
            rows = column.slice(a, b - a)
            apart = {i: np.frombuffer(whole(rows[i].as_py()), "<u2") for i in np.flatnonzero(pc.match_substring_regex(rows, special.pattern).fill_null(False).to_numpy(zero_copy_only=False)).tolist()}
        at = cut_places(data, offs)
        found, sizes = [], []
        for k in range(0, len(at) - 1, PIECES_AT_ONCE):
            ends = at[k : k + PIECES_AT_ONCE + 1]
            own = np.ascontiguousarray(data[ends[0] : ends[-1]])
            keys = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(own)]).dictionary_encode()
            ids, n = gathered(pieces.all(keys.dictionary.to_pylist()), keys.indices.to_numpy())
            found.append(ids)
            sizes.append(n)
        total = np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))))
        ends = total[np.searchsorted(at, offs)]
        ids = np.concatenate(found) if found else np.zeros(0, np.uint16)
        if apart:
            parts = [apart.get(i, ids[x:y]) for i, (x, y) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist()))]
            ids, ends = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        yield ids, np.diff(ends)
