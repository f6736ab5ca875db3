"""Language-model scoring with Elias-Fano n-gram tries.

Counts of words and word pairs are gathered over all training documents: fragments of documents send their distinct n-grams
to buckets of hash ranges, so no task and no broadcast ever holds the whole corpus' counts. Each bucket sums what it got and
builds the trie of its n-grams: words ordered by hash with their counts; contexts ordered by hash; per context the start of
its successors as a monotone Elias-Fano pointer sequence; all successors, each relative to its context, as one strictly
increasing Elias-Fano sequence; the probability of each pair among all, quantised to 1/2048 of a decimal order. The levels
lie in one memory-mapped file. The bucket answers the fragments' requests, held-out ones too, from its trie, by successor
search for the context-relative value within the pointers' range.

Smoothing is Dirichlet: p(w|h) = (c(hw) + MASS * p(w)) / (c(h) + MASS) over the base model p(w) = (c + 0.1) / (N + 0.1 (V + 1));
c(hw) is N times the trie's quantised probability (pairs that occur once in the corpus are not answered). Each text ends in
an end token; its first word's context is a begin mark. Totals N and V are counted first.

Nulls and empty texts are just the end token. Repeated rows count each time and are dealt out like others. Null ids count as
the empty text, so are held out. Very long texts are cut into words whole. Other columns are ignored. An empty table gives no
rows. Word hashes of 60 bits, and pair hashes of 26 bits more than the corpus' logarithm (62 at most), stand for the n-grams:
of V words about V * V / 2**61 pairs are taken for one another.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, remainder, table, text_bytes
from .elias import EliasFano
from .pull import FAN, FRAGMENT_BYTES, Merged, answer_table, answered, exchange, fragmented, kinds_of, request_table, requests
from .textkit import SPACE_WORDS, Words, mix, row_blocks

ADD = 0.1
MASS = 300.0
STEP = 1 / 2048
UNSEEN, SINGLE = 65535, 65534  # codes of pairs that are not there, or there once
WORD_BITS = 60
END = np.uint64(0x5EED0E2D5EED0E2D)
BEGIN = np.uint64(0xB0E1B0E1B0E1B0E1)
_SHIFT = np.uint64(64 - WORD_BITS)


def sequence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word keys of all texts with their end tokens, the key before each, and the number per text."""
    keys, before, sizes = [], [], []
    for a, b, data, offs in row_blocks(texts):
        words = Words(data, offs, SPACE_WORDS)
        n = words.counts + 1
        last = np.cumsum(n) - 1
        tok = np.empty(int(n.sum()), np.uint64)
        inner = np.ones(len(tok), bool)
        inner[last] = False
        tok[inner] = words.hashes() >> _SHIFT
        tok[last] = END >> _SHIFT
        prior = np.empty_like(tok)
        prior[1:] = tok[:-1]
        prior[last - n + 1] = BEGIN >> _SHIFT
        keys.append(tok)
        before.append(prior)
        sizes.append(n)
    return tuple(np.concatenate([np.zeros(0, k), *x]) for x, k in ((keys, np.uint64), (before, np.uint64), (sizes, np.int64)))


CONTEXT_BITS = 24  # of a pair key


def pair_keys(context: np.ndarray, word: np.ndarray, bits: int, log_buckets: int) -> np.ndarray:
    """Keys whose first log_buckets bits spread the successors of any one context over all buckets; then come bits of the
    context, then the rest of the successor's hash, so a bucket's keys lie in order of their contexts."""
    size = bits - CONTEXT_BITS
    rest = np.uint64(size - log_buckets)
    successor = mix(context * np.uint64(0x9E3779B97F4A7C15) + word) >> np.uint64(64 - size)
    inner = (context >> np.uint64(WORD_BITS - CONTEXT_BITS)) << rest | successor & ((np.uint64(1) << rest) - np.uint64(1))
    return successor >> rest << (rest + np.uint64(CONTEXT_BITS)) | inner


class Trie:
    """Pairs of a bucket in a memory-mapped file: contexts, pointers, context-relative successors and quantised log10 values."""

    def __init__(self, keys: np.ndarray, rest: int, log10: np.ndarray):
        """keys: sorted, a context and `rest` bits of a successor each."""
        contexts, starts = np.unique(keys >> np.uint64(rest), return_index=True)
        number = np.searchsorted(contexts, keys >> np.uint64(rest)).astype(np.uint64)
        self.rest = np.uint64(rest)
        levels = {"contexts": contexts, "pointers": np.append(starts, len(keys)), "successors": number << self.rest | keys & ((np.uint64(1) << self.rest) - np.uint64(1))}
        self._file = tempfile.TemporaryFile()  # noqa: SIM115  lives as long as the maps
        for name, values in levels.items():
            level = EliasFano.of(values)
            setattr(self, name, EliasFano(level.n, level.width, *(self._mapped(x) for x in (level.low, level.high, level.ones))))
        self.value = self._mapped(np.clip(np.rint(-log10 / STEP), 0, SINGLE - 1).astype(np.uint16))

    def _mapped(self, x: np.ndarray) -> np.ndarray:
        at = -(-self._file.tell() // 64) * 64
        self._file.seek(at)
        self._file.write(x.tobytes() or b"\0" * 8)
        self._file.flush()
        end = self._file.tell()
        out = np.memmap(self._file, x.dtype, "r", at, (len(x),)) if len(x) else x
        self._file.seek(end)
        return out

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Quantised -log10 of each key's value, UNSEEN for pairs that are not there."""
        out = np.full(len(keys), UNSEEN, np.int64)
        if not self.successors.n or not len(keys):
            return out
        number, known = self.contexts.successor(keys >> self.rest)
        ask = np.flatnonzero(known)
        number = number[ask]
        relative = keys[ask] & ((np.uint64(1) << self.rest) - np.uint64(1))
        at, found = self.successors.successor(number.astype(np.uint64) << self.rest | relative)
        hit = np.flatnonzero(found)
        inside = (self.pointers.access(number[hit]) <= at[hit].astype(np.uint64)) & (at[hit].astype(np.uint64) < self.pointers.access(number[hit] + 1))
        hit = hit[inside]
        out[ask[hit]] = self.value[at[hit]]
        return out


def totals(docs: DataFrame, id_col: str, text: str, held_out_of: int) -> tuple[int, int]:
    """Number of training tokens and of distinct ones. Tasks count their own words; only these counts are shuffled."""

    def count(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held, size = [], 0

        def merged():
            every, back = np.unique(np.concatenate((keys, *held)), return_inverse=True)
            return every, np.bincount(back, np.concatenate((counts, np.ones(size, np.int64))), minlength=len(every)).astype(np.int64)

        for batch in batches:
            held.append(sequence(batch.column(0))[0])
            size += len(held[-1])
            if size > 4_000_000:
                keys, counts = merged()
                held, size = [], 0
                if len(keys) > 2_000_000:  # bounded memory: what is counted so far goes on
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["k", "n"])
                    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["k", "n"])

    rows = docs.where(remainder(F.col(id_col), held_out_of) != 0).select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    words = rows.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    got = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    return got["n"], got["v"]


def score_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", held_out_of: int = 10, mass: float = MASS, fan: int = FAN) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score and score."""
    size = text_bytes(docs, text)
    n, v = totals(docs, id_col, text, held_out_of)
    train, held = blocks(size * (held_out_of - 1) // held_out_of, FRAGMENT_BYTES), blocks(size // held_out_of, FRAGMENT_BYTES)
    log_buckets = max(0, (train + held - 1).bit_length())
    pair_bits = min(62, max(46 + log_buckets, (size // 4).bit_length() + 26))
    bits = {1: WORD_BITS, 2: pair_bits}
    rest = pair_bits - CONTEXT_BITS - log_buckets
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("held", remainder(F.col("id"), held_out_of) == 0)
    parts = fragmented(rows, ["id", "t", "held"], train, of=F.col("held"), more=held)
    begin = BEGIN >> _SHIFT

    def ask(t: pa.Table) -> pa.Table:
        frag, counted = t.column("frag")[0].as_py(), not t.column("held")[0].as_py()
        tok, prior, _ = sequence(t.column("t"))
        out = []
        uni = np.concatenate((tok, prior[prior == begin]))
        for k, keys in ((1, uni), (2, pair_keys(prior, tok, pair_bits, log_buckets))):
            keys, c = np.unique(keys, return_counts=True)
            out += requests(frag, k, int(counted) if k == 1 else SINGLE if counted else UNSEEN, keys, c if counted else None, bits[k], log_buckets, fan)
        return request_table(out)

    def serve(t: pa.Table) -> pa.Table:
        out = []
        for k in kinds_of(t):
            m = Merged(t, k)
            if k == 1:
                seen = np.flatnonzero(m.sums)
                words, found = EliasFano.of(m.keys[seen]), np.zeros(len(m.keys), np.int64)
                at, known = words.successor(m.keys) if len(seen) else (found, np.zeros(len(found), bool))
                found[known] = m.sums[seen][at[known]]
            else:
                seen = np.flatnonzero(m.sums)
                found = Trie(m.keys[seen], rest, np.log10(m.sums[seen] / max(1, n))).lookup(m.keys)
                found[m.sums == 1] = SINGLE  # needs no value of its own
            out += m.answers(found, k)
        return answer_table(out)

    def score(key, t: pa.Table, a: pa.Table) -> pa.Table:
        names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        types = [t.schema.field("id").type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not t.num_rows:
            return pa.table([pa.array([], x) for x in types], names)
        counted = not t.column("held")[0].as_py()
        tok, prior, sizes = sequence(t.column("t"))
        words = np.unique(np.concatenate((tok, [begin])))
        counts = answered(a, 1, words, int(counted), WORD_BITS, log_buckets, fan)
        p1 = (counts + ADD) / (n + ADD * (v + 1))
        w = np.searchsorted(words, tok)
        keys = pair_keys(prior, tok, pair_bits, log_buckets)
        uniq, back = np.unique(keys, return_inverse=True)
        code = answered(a, 2, uniq, SINGLE if counted else UNSEEN, pair_bits, log_buckets, fan)
        pair = np.where(code == UNSEEN, 0.0, np.where(code == SINGLE, 1.0, n * 10.0 ** (-STEP * code)))[back]
        got = np.log10((pair + mass * p1[w]) / (counts[np.searchsorted(words, prior)] + mass))
        ends = np.cumsum(sizes)
        total = lambda x: np.add.reduceat(x, ends - sizes)  # noqa: E731  each text has a token at least
        return pa.table([t.column("id").combine_chunks(), t.column("held").combine_chunks(), pa.array(sizes), pa.array(total((counts > 0)[w].astype(np.int64))), pa.array(np.full(len(sizes), n)), pa.array(total(np.log10(p1)[w])), pa.array(total(got))], names)

    sent = exchange(parts, ask, serve, bits, log_buckets, fan)
    return parts.groupBy("frag").cogroup(sent.groupBy("frag")).applyInArrow(score, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
