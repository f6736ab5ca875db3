"""Elias-Fano sequences with vectorised access and successor search, and their packed form for shuffles."""

from __future__ import annotations

import struct

import numpy as np


def low_width(n: int, universe: int) -> int:
    return max(0, (max(1, universe) // max(1, n)).bit_length() - 1)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Values of `width` bits one after the other, least significant bit first; eight spare bytes follow."""
    if not width or not len(values):
        return np.zeros(8, np.uint8)
    out = [np.packbits(np.unpackbits(values[a : a + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, count=width, bitorder="little").ravel(), bitorder="little") for a in range(0, len(values), 65536)]
    return np.concatenate([*out, np.zeros(8, np.uint8)])


def read_bits(raw: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """The values at given places; up to 56 bits wide."""
    if not width:
        return np.zeros(len(at), np.uint64)
    bit = at.astype(np.int64) * width
    view = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    return (view[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)


def pack_sorted(values: np.ndarray, bits: int) -> bytes:
    """A sorted array of integers under 2**bits as bytes."""
    n = len(values)
    width = min(56, low_width(n, 1 << bits))
    high = (values >> np.uint64(width)).astype(np.int64)
    at = high + np.arange(n)
    marks = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
    marks[at] = 1
    return struct.pack("<IB", n, width) + pack_bits(values & np.uint64((1 << width) - 1), width).tobytes() + np.packbits(marks, bitorder="little").tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<IB", blob)
    if not n:
        return np.zeros(0, np.uint64)
    size = (n * width + 7) // 8 + 8 if width else 8
    raw = np.frombuffer(blob, np.uint8)
    marks = np.flatnonzero(np.unpackbits(raw[5 + size :], bitorder="little"))[:n]
    high = (marks - np.arange(n)).astype(np.uint64)
    low = read_bits(raw[5 : 5 + size].copy(), width, np.arange(n))
    return (high << np.uint64(width)) | low


class EliasFano:
    """A non-decreasing sequence; arrays() and its constructor arguments let it live in a memory map."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        width = min(56, low_width(n, int(values[-1]) + 1 if n else 1))
        at = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        marks = np.zeros((int(at[-1]) // 64 + 2 if n else 1) * 64, np.uint8)
        marks[at] = 1
        high = np.packbits(marks, bitorder="little").view(np.uint64)
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64))).astype(np.uint32)
        return cls(n, width, pack_bits(values & np.uint64((1 << width) - 1), width), high, ones)

    def _nth(self, word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th one within each word."""
        place = np.zeros(len(word), np.uint64)
        k = k.astype(np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            part = (word >> place) & np.uint64((1 << half) - 1)
            c = np.bitwise_count(part).astype(np.int64)
            go = k >= c
            k = np.where(go, k - c, k)
            place += np.where(go, np.uint64(half), np.uint64(0))
        return place.astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        w = np.searchsorted(self.ones, i, "right") - 1
        bit = w * 64 + self._nth(self.high[w], i - self.ones[w].astype(np.int64))
        return ((bit - i).astype(np.uint64) << np.uint64(self.width)) | read_bits(self.low, self.width, i)

    def _zeros_before(self) -> np.ndarray:
        return np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    def successor(self, x: np.ndarray, zeros: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value >= x (n if none), and whether it equals x."""
        zeros = self._zeros_before() if zeros is None else zeros
        x = x.astype(np.uint64)
        head = (x >> np.uint64(self.width)).astype(np.int64)
        low = x & np.uint64((1 << self.width) - 1)
        last = int(zeros[-1])
        over = head >= last
        head = np.minimum(head, last - 1)

        def nth_zero(k):  # zero number k ends bucket k
            w = np.searchsorted(zeros, k, "right") - 1
            return w * 64 + self._nth(~self.high[w], k - zeros[w])

        end = nth_zero(head) - head
        begin = np.where(head > 0, nth_zero(np.maximum(head - 1, 0)) + 1 - head, 0)
        a, b = begin.copy(), end.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) >> 1
            less = read_bits(self.low, self.width, mid) < low[live]
            a[live] = np.where(less, mid + 1, a[live])
            b[live] = np.where(less, b[live], mid)
            live = live[a[live] < b[live]]
        inside = (a < end) & ~over
        exact = np.zeros(len(x), bool)
        at = np.flatnonzero(inside)
        exact[at] = read_bits(self.low, self.width, a[at]) == low[at]
        return np.where(over, self.n, a), exact
