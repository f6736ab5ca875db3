"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a bounded run of documents inside one task. Words that no test phrase has are cut out of it (no window reaches
over them), the rest becomes a sequence of word numbers whose runs are kept apart. Its Burrows-Wheeler transform lies in a
wavelet matrix; all windows of all test phrases are searched backward at once by ranks, found rows walk to the next sampled
suffix position, and the positions become spans that are merged per document. Nothing is shuffled: the test phrases go to
all tasks in blocks of BLOCK_BYTES, of which the driver and a task hold one at a time: after each block but the last the rows
with what was found so far are stored, so a larger benchmark costs passes, not memory.

Nulls and texts without words have no hits; items without words have no windows. Repeated items count once by id; rows,
repeated or not, are independent of each other. A long text is a shard of its own. Other columns stay as they are, whatever
their names. An empty table gives no rows, an empty benchmark no hits. Words are compared by hashes of 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, fresh, give_back, stored, table, text_bytes
from .textkit import ALNUM_WORDS, Words, row_blocks, text_buffer, words_of

WINDOW = 10
SAMPLE = 8  # every so many positions the suffix array is kept
SHARD = 1 << 20  # symbols of a shard
SHARD_BYTES = 2 << 20  # of text that are cut into words at once
BLOCK_BYTES = 8_000_000


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; zeros are separators, each unlike all others."""
    n = len(symbols)
    apart = symbols == 0
    rank = symbols.astype(np.int64) + int(apart.sum())
    rank[apart] = np.arange(int(apart.sum()))
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        ranked = rank[order]
        rank = rank.copy()
        rank[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        rank = rank * (n + 1) + after
        order = np.argsort(rank, kind="stable")
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, bit by bit from the highest."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.words, self.sums, self.zeros = [], [], []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b) & 1 == 1
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate((packed, np.zeros(16 - len(packed) % 8, np.uint8))).view(np.uint64)
            self.words.append(packed)
            self.sums.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed)))).astype(np.int64))
            self.zeros.append(int(self.n - bit.sum()))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))

    def ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.sums[level][word] + np.bitwise_count(self.words[level][word] & low)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        start = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            bit = (symbol >> (self.bits - 1 - level)) & 1 == 1
            a, b = self.ones(level, start), self.ones(level, at)
            start = np.where(bit, self.zeros[level] + a, start - a)
            at = np.where(bit, self.zeros[level] + b, at - b)
        return at - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at each place, and how often it occurs before."""
        symbol, start = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for level in range(self.bits):
            bit = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            a, b = self.ones(level, start), self.ones(level, at)
            start = np.where(bit, self.zeros[level] + a, start - a)
            at = np.where(bit, self.zeros[level] + b, at - b)
            symbol = symbol * 2 + bit
        return symbol, at - start


class FMIndex:
    """Index of a sequence of numbers from 1 on, zeros between its runs."""

    def __init__(self, symbols: np.ndarray, top: int):
        sa = suffix_array(symbols)
        self.n = len(symbols)
        before = symbols[sa - 1] if self.n else symbols
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top + 1)))).astype(np.int64)
        self.bwt = WaveletMatrix(before.astype(np.int64), max(1, int(top).bit_length()))
        kept = (sa % SAMPLE == 0) | (before == 0)
        self.kept = WaveletMatrix(kept.astype(np.int64), 1)
        self.places = sa[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (first, past last) whose suffixes start with each pattern, all of one length."""
        first, last = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            first[live] = self.counts[c] + self.bwt.rank(c, first[live])
            last[live] = self.counts[c] + self.bwt.rank(c, last[live])
            live = live[first[live] < last[live]]
        return first, np.maximum(first, last)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back until a sampled one."""
        out, steps, todo, at = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(todo):
            hit = (self.kept.words[0][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            out[todo[hit]] = self.places[self.kept.ones(0, at[hit])] + steps
            todo, at = todo[~hit], at[~hit]
            if len(todo):
                symbol, seen = self.bwt.access(at)
                at = self.counts[symbol] + seen
                steps += 1
        return out


class Phrases:
    """Windows of test phrases as word numbers, by length, with the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        words = [(i, words_of(t or "", ALNUM_WORDS)) for i, t in items]
        self.vocab = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w for _, w in words)]))
        self.names = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.names)}
        found: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for i, w in words:
            size = min(window, len(w))
            ids = (np.searchsorted(self.vocab, w) + 1).tolist()
            for k in range(len(ids) - size + 1 if size else 0):
                found.setdefault(size, {}).setdefault(tuple(ids[k : k + size]), set()).add(number[i])
        self.windows = {size: np.array(list(x), np.int64) for size, x in found.items()}
        self.items = {size: list(x.values()) for size, x in found.items()}
        self.least = min(self.windows, default=1)


def shard_hits(data: np.ndarray, offs: np.ndarray, phrases: Phrases):
    """Words of the block, which of them are hit, and (row, item number) pairs."""
    words = Words(data, offs, ALNUM_WORDS)
    hit, pairs = np.zeros(len(words.starts), bool), np.zeros((0, 2), np.int64)
    if not len(phrases.vocab) or not len(hit):
        return words, hit, pairs
    h = words.hashes()
    at = np.minimum(np.searchsorted(phrases.vocab, h), len(phrases.vocab) - 1)
    inside = phrases.vocab[at] == h
    starts_run = inside.copy()
    starts_run[1:] &= ~inside[:-1] | (words.rows[1:] != words.rows[:-1])
    run = np.cumsum(starts_run) - 1
    where = np.flatnonzero(inside)
    if not len(where):
        return words, hit, pairs
    long = np.bincount(run[where]) >= phrases.least
    where = where[long[run[where]]]
    for a in cuts(run[where], SHARD):
        part = where[a]
        runs = run[part]
        gaps = np.concatenate(([0], np.cumsum(runs[1:] != runs[:-1])))
        places = np.arange(len(part)) + gaps + 1
        symbols = np.zeros(len(part) + int(gaps[-1]) + 2, np.int64)
        symbols[places] = at[part] + 1
        back = np.full(len(symbols), -1, np.int64)
        back[places] = part
        index = FMIndex(symbols, len(phrases.vocab))
        for size, patterns in phrases.windows.items():
            first, last = index.search(patterns)
            n = last - first
            which = np.repeat(np.arange(len(patterns)), n)
            if not len(which):
                continue
            rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            begin = back[index.locate(rows)]
            cover = np.zeros(len(hit) + 1, np.int64)
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + size, -1)
            hit |= np.cumsum(cover[:-1]) > 0
            seen = np.unique(np.stack((words.rows[begin], which), 1), axis=0)
            names = [phrases.items[size][w] for w in seen[:, 1].tolist()]
            pairs = np.concatenate((pairs, np.stack((np.repeat(seen[:, 0], [len(x) for x in names]), np.array([y for x in names for y in x], np.int64)), 1)))
    return words, hit, pairs


def cuts(run: np.ndarray, most: int):
    """Slices of about `most` symbols at ends of runs; a longer run is a slice of its own."""
    a = 0
    while a < len(run):
        b = min(len(run), a + most)
        if b < len(run):
            c = int(np.searchsorted(run, run[b]))
            b = c if c > a else int(np.searchsorted(run, run[b], "right"))
        yield slice(a, b)
        a = b


def phrase_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", most: int = BLOCK_BYTES):
    """Number of blocks of about `most` bytes, and the test phrases of each, one after the other."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    n = blocks(text_bytes(rows), most)
    return n, ([(r.item, r.text) for r in (rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)).collect()] for k in range(n))


def _merged(batch: pa.RecordBatch, at: int, kept: int, phrases: Phrases) -> pa.RecordBatch:
    """The batch with the four columns of `mark` brought up to date by one block of phrases."""
    spans, n_words, n_hit, items = [], [], [], []
    old_spans, old_items = batch.column(kept).to_pylist(), batch.column(kept + 3).to_pylist()
    for a, b, data, offs in row_blocks(batch.column(at), SHARD_BYTES):
        words, hit, pairs = shard_hits(data, offs, phrases)
        named: dict[int, set[str]] = {}
        for r, i in pairs.tolist():
            named.setdefault(r, set()).add(phrases.names[i])
        touched = set(words.rows[hit].tolist())
        for r in range(b - a):
            own = slice(words.first[r], words.first[r] + words.counts[r])
            n_words.append(int(words.counts[r]))
            items.append(sorted(set(old_items[a + r]) | named.get(r, set())))
            if r not in touched and not old_spans[a + r]:
                spans.append([])
                n_hit.append(0)
                continue
            flags = hit[own].copy()
            begin, end = words.starts[own] - offs[r], words.ends[own] - offs[r]
            for x, y in zip(old_spans[a + r][::2], old_spans[a + r][1::2]):
                flags |= (begin >= x) & (end <= y)
            k = np.flatnonzero(flags)
            head = np.concatenate(([True], np.diff(k) > 1)) if len(k) else np.zeros(0, bool)
            tail = np.concatenate((head[1:], [True])) if len(k) else head
            spans.append(np.stack((begin[k[head]], end[k[tail]]), 1).reshape(-1).tolist())
            n_hit.append(len(k))
    return pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(spans, pa.list_(pa.int32())), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))], batch.schema.names)


def _cut(batch: pa.RecordBatch, at: int, kept: int) -> pa.RecordBatch:
    """The batch's first `kept` columns without the marked spans of the texts, a line break in place of each."""
    texts = batch.column(at)
    spans = batch.column(kept).to_pylist()
    if any(spans):
        values = []
        for text, cut in zip(texts, spans):
            value = text.as_py()
            if cut:
                raw, parts, last = value.encode(), [], 0
                for x, y in zip(cut[::2], cut[1::2]):
                    parts.append(raw[last:x])
                    last = y
                value = b"\n".join([*parts, raw[last:]]).decode()
            values.append(value)
        texts = pa.array(values, texts.type)
    return pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns[:kept])], batch.schema.names[:kept])


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, cut: bool = False) -> DataFrame:
    """docs with four more columns: spans (hit words as flat byte offsets of the UTF-8 text, merged), numbers of words and of
    hit words, and items; named __spans, __n_words, __n_hit and __items, or so that no column of docs is hidden.

    cut: instead, docs with the merged spans cut out of `text`, by the last block's pass."""
    names = fresh(docs, "__spans", "__n_words", "__n_hit", "__items")
    kinds = ("array<int>", "long", "long", "array<string>")
    out = docs.select("*", *((F.array() if k.startswith("array") else F.lit(0)).cast(k).alias(c) for c, k in zip(names, kinds)))
    at, kept = docs.columns.index(text), len(docs.columns)
    n, blocks_of = phrase_blocks(benchmark)
    for i, block in enumerate(blocks_of):
        last = i == n - 1
        sent = docs.sparkSession.sparkContext.broadcast(Phrases(block, window))

        def run(batches, sent=sent, finish=cut and last):
            for batch in batches:
                found = _merged(batch, at, kept, sent.value)
                yield _cut(found, at, kept) if finish else found
            give_back()

        out = out.mapInArrow(run, docs.schema if cut and last else out.schema)
        if not last:
            out = stored(out, "marked")
            sent.unpersist()
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: numbers of words, of hit words and of items found, their digest, and whether any word is hit."""
    found = mark(docs.select(id_col, text), benchmark, text, window)
    _, words, hit, items = (F.col(c) for c in found.columns[2:])
    return found.select(id_col, words.alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the merged spans cut out of `text`, a line break in place of each."""
    return mark(docs, benchmark, text, window, cut=True)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
