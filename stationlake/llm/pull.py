"""Two-way counting: fragments of documents send their distinct keys once to the buckets that own them and get back what they
could not know, in packed blocks instead of a row per key.

Keys are hashes, so buckets are even however common one key is, and a fragment sends a key once. Rows are dealt to fragments
by their place in the table, so repeated rows spread too. No task sends more than 2**FAN blocks: beyond that many buckets,
hubs between fragments and buckets merge the blocks of 2**FAN fragments for one range of keys, ask in their place and share
out what they are told. So the number of blocks grows with the input, not with its square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .elias import pack_sorted, unpack_sorted

FRAGMENT_BYTES = 6_000_000
FAN = 9  # bits


def small(counts: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs; the first byte tells."""
    size = next(s for s in (1, 2, 4, 8) if int(counts.max(initial=0)) < 1 << (8 * s))
    return bytes([size]) + counts.astype(f"<u{size}").tobytes()


def large(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)


def split(keys: np.ndarray, bits: int, log_parts: int):
    """(part, slice) of sorted keys by their leading bits."""
    ends = np.searchsorted(keys, np.arange(1, 1 << log_parts, dtype=np.uint64) << np.uint64(bits - log_parts))
    for b, (x, y) in enumerate(zip(np.concatenate(([0], ends)).tolist(), np.concatenate((ends, [len(keys)])).tolist())):
        if x < y:
            yield b, slice(x, y)


REQUEST = "frag long, bucket int, kind int, known int, keys binary, counts binary"
ANSWER = "frag long, bucket int, kind int, told binary, found binary"


def _table(rows: list, schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return pa.table([pa.array(c, kinds[t]) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], list(names))


def requests(frag: int, kind: int, known: int, keys: np.ndarray, counts: np.ndarray | None, bits: int, log_buckets: int, fan: int = FAN) -> list:
    """Rows to the buckets or hubs. known: what the fragment takes for a key that no answer names."""
    return _split_rows(frag, 0, kind, known, keys, counts, bits, min(fan, log_buckets))


def _split_rows(frag: int, bucket: int, kind: int, known: int, keys: np.ndarray, counts: np.ndarray | None, bits: int, step: int) -> list:
    rest = np.uint64((1 << (bits - step)) - 1)
    return [(frag, bucket << step | b, kind, known, pack_sorted(keys[s] & rest, bits - step), b"" if counts is None else small(counts[s])) for b, s in split(keys, bits, step)]


def request_table(rows: list) -> pa.Table:
    return _table(rows, REQUEST)


class Merged:
    """All blocks of one kind that reached a bucket or hub: their keys, what each holds, and the sums."""

    def __init__(self, t: pa.Table, kind: int):
        own = t.filter(pa.array(t.column("kind").to_numpy() == kind))
        self.frags, self.known, self.buckets = (own.column(c).to_pylist() for c in ("frag", "known", "bucket"))
        lists = [unpack_sorted(k) for k in own.column("keys").to_pylist()]
        counts = [large(c) if c else np.zeros(len(k), np.int64) for k, c in zip(lists, own.column("counts").to_pylist())]
        self.usual = max(sorted(set(self.known)), key=self.known.count)  # what a hub takes for a key that no answer names
        self.ends = np.cumsum([0, *map(len, lists)])
        self.keys, self.back = np.unique(np.concatenate(lists), return_inverse=True)
        self.sums = np.bincount(self.back, np.concatenate(counts), minlength=len(self.keys)).astype(np.int64)

    def answers(self, found: np.ndarray, kind: int) -> list:
        """Rows back to those that asked: for each of its keys whether it is told, and what."""
        out = []
        for i, (frag, known, bucket) in enumerate(zip(self.frags, self.known, self.buckets)):
            mine = found[self.back[self.ends[i] : self.ends[i + 1]]]
            tell = mine != known
            out.append((frag, bucket, kind, np.packbits(tell).tobytes(), small(mine[tell])))
        return out


def kinds_of(t: pa.Table) -> list[int]:
    return np.unique(t.column("kind").to_numpy()).tolist()


def counting(t: pa.Table) -> pa.Table:
    """Kernel of a bucket that answers each key with its summed count."""
    out = []
    for kind in kinds_of(t):
        m = Merged(t, kind)
        out += m.answers(m.sums, kind)
    return _table(out, ANSWER)


def answer_table(rows: list) -> pa.Table:
    return _table(rows, ANSWER)


def _told(rows: dict[int, tuple[bytes, bytes]], keys: np.ndarray, known: int, bits: int, step: int, bucket: int) -> np.ndarray:
    out = np.full(len(keys), known, np.int64)
    for b, s in split(keys, bits, step):
        told, found = rows[bucket << step | b]
        at = np.flatnonzero(np.unpackbits(np.frombuffer(told, np.uint8), count=s.stop - s.start)) + s.start
        out[at] = large(found)
    return out


def _by_bucket(t: pa.Table, kind: int) -> dict[int, tuple[bytes, bytes]]:
    own = t.filter(pa.array(t.column("kind").to_numpy() == kind)) if t.num_rows else t
    return dict(zip(own.column("bucket").to_pylist(), zip(own.column("told").to_pylist(), own.column("found").to_pylist())))


def answered(t: pa.Table, kind: int, keys: np.ndarray, known: int, bits: int, log_buckets: int, fan: int = FAN) -> np.ndarray:
    """What a fragment's sorted keys were answered."""
    return _told(_by_bucket(t, kind), keys, known, bits, min(fan, log_buckets), 0)


def _through(asked: DataFrame, bits: dict[int, int], left: int, kernel, fan: int) -> DataFrame:
    """Answers to blocks whose buckets still have `left` bits to be split by; bits: of the keys as the blocks hold them."""
    if not left:
        return asked.groupBy("bucket").applyInArrow(kernel, ANSWER)
    step = min(fan, left)
    by_hub = asked.withColumnsRenamed({"bucket": "range"}).withColumn("hub", F.expr(f"shiftright(frag, {fan})"))
    kept = [F.col("range").alias("bucket") if c == "bucket" else F.col(c) for c in ("frag", "bucket", "kind", "known", "keys", "counts")]
    asked_by_hub = by_hub.select("range", "hub", *kept)

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        rows = []
        for kind in kinds_of(t):
            m = Merged(t, kind)
            rows += _split_rows(key[1].as_py(), key[0].as_py(), kind, m.usual, m.keys, m.sums, bits[kind], step)
        return request_table(rows)

    def share(key: tuple, t: pa.Table, a: pa.Table) -> pa.Table:
        out = []
        for kind in kinds_of(t) if t.num_rows else []:
            m = Merged(t, kind)
            out += m.answers(_told(_by_bucket(a, kind), m.keys, m.usual, bits[kind], step, key[0].as_py()), kind)
        return answer_table(out)

    merged = asked_by_hub.groupBy("range", "hub").applyInArrow(merge, REQUEST)
    got = _through(merged, {k: b - step for k, b in bits.items()}, left - step, kernel, fan)
    back = got.select(F.expr(f"shiftright(bucket, {step})").alias("range"), F.col("frag").alias("hub"), *(F.col(c) for c in ("frag", "bucket", "kind", "told", "found")))
    return asked_by_hub.groupBy("range", "hub").cogroup(back.groupBy("range", "hub")).applyInArrow(share, ANSWER)


def exchange(fragments: DataFrame, ask, kernel, bits: dict[int, int], log_buckets: int, fan: int = FAN) -> DataFrame:
    """Answers for fragments (grouped by column frag) that `ask` makes requests of. bits: of the keys by kind."""
    first = min(fan, log_buckets)
    sent = fragments.groupBy("frag").applyInArrow(ask, REQUEST)
    if first == log_buckets:
        sent = sent.repartition(1 << log_buckets, "bucket")
    return _through(sent, {k: b - first for k, b in bits.items()}, log_buckets - first, kernel, fan)


def fragmented(docs: DataFrame, columns: list, n: int, first: int = 0, of=None, more: int = 0) -> DataFrame:
    """Columns of docs dealt out to n fragments by each row's place in the table, numbered from `first`; rows for which `of`
    holds go to `more` further ones. Used twice in one plan, the exchange is made once."""
    place = F.xxhash64(F.monotonically_increasing_id())
    frag = F.pmod(place, F.lit(n)) + first
    if of is not None:
        frag = F.when(of, F.pmod(place, F.lit(more)) + first + n).otherwise(frag)
    return docs.select(frag.cast("long").alias("frag"), *columns).repartition(n + more, "frag")
