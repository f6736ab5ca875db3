"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five consecutive words (all words of a shorter text). How many documents hold a shingle is counted over all
documents by two-hop counting. A shingle weighs its count in the text times a damped inverse document frequency from 1 to
1 + DAMP, in steps of 1/64: undamped weights would let the few changed words of a near copy outweigh a passage that
thousands of copies share. BANDS x ROWS consistent samples make band keys; documents that share one are candidates.

Equal texts fall together first. Each bucket compares its members with a leader; verified links
(weighted Jaccard >= 0.8, in integers) are joined to components; then every pair of a bucket that lies in different
components and may reach 0.8 is verified too. What can be 0.8 alike is bounded exactly by the weights of shingles that no
other document holds: two texts have at most the lesser of their shared weights in common, which rules out most pairs of
heavily edited copies unseen. A leader is the member with the least unshared weight. So no link between candidates is lost and a group of n copies
costs about n comparisons per band. A pair of similarity 0.8 is a candidate with probability 0.9994, of 0.9 with 1 - 1e-9.

Null and empty texts are in no group, each its own class; so are single documents. Texts of signs only are alike if equal. Ties
and repeated rows: rows of one id and text are copies of each other; the class id is the smallest doc_id, and of the rows
with it the first in the table stays. Texts are shingled whole, however long. Other columns are ignored, and kept as they
are, whatever their names, by `drop_near_duplicates`. An empty table gives no rows. Joins on texts, buckets and classes meet
hot keys by broadcast (`spread_join`). Shingles are told apart by hashes, of 32 bits in the comparison of two texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, blocks, deleted, fresh, give_back, spread_join, stored, table
from .components import components
from .elias import pack_sorted, unpack_sorted
from .pull import answered, counting, exchange, fragmented, large, request_table, requests, small
from .textkit import ALNUM_WORDS, Words, mix, row_blocks

SIZE = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 4
DAMP = 0.25
GRID = 64
FRAGMENT_BYTES = 4_000_000  # of text that a task sketches at once; all its shingles are held
BROADCAST_BYTES, ROW_BYTES = 32_000_000, 100  # of an id and a key of 32 characters in a broadcast table
_TABLE = 14
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array, size: int = SIZE):
    """Per block of texts: rows, hashes and counts of the distinct shingles, by row and hash; and the number of rows."""
    for a, b, data, offs in row_blocks(texts):
        words = Words(data, offs, ALNUM_WORDS)
        h = words.hashes()
        n = len(h)
        full = np.flatnonzero(words.counts >= size)
        whole = np.maximum(words.counts - size + 1, (words.counts > 0).astype(np.int64))
        rows = np.repeat(np.arange(b - a), whole)
        first = np.repeat(words.first, whole) + (np.arange(len(rows)) - np.repeat(np.cumsum(whole) - whole, whole))
        long = np.isin(rows, full) if len(full) < b - a else np.ones(len(rows), bool)
        size_of = np.where(long, size, words.counts[rows])
        total = np.zeros(len(rows), np.uint64)
        for j in range(size):
            use = size_of > j
            total[use] = (total[use] + h[np.minimum(first[use] + j, n - 1)]) * _ODD
        total = mix(total)
        order = np.lexsort((total, rows))
        rows, total = rows[order], total[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (total[1:] != total[:-1])
        at = np.flatnonzero(new)
        yield b - a, rows[at], total[at], np.diff(np.concatenate((at, [len(rows)])))


class Sampler:
    """Improved consistent weighted sampling; its Gamma and uniform variates come from tables that hashes point into."""

    def __init__(self, k: int = BANDS * ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = 1 << _TABLE
        self.r = rng.gamma(2.0, 1.0, n).astype(np.float32)
        self.c = np.log(rng.gamma(2.0, 1.0, n)).astype(np.float32)
        self.b = rng.random(n).astype(np.float32)
        self.over = np.float32(1) / self.r
        self.rest = self.c + self.r * (self.b - np.float32(1))  # of c - r * (t - b + 1), what does not depend on t
        self.odd = (rng.integers(0, 1 << 63, k, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

    def samples(self, rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_rows: int) -> np.ndarray:
        """(rows, k) sample keys; rows without shingles get 0. Arrays are used again for every sample."""
        out = np.zeros((n_rows, len(self.odd)), np.uint64)
        n = len(rows)
        if not n:
            return out
        heads = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        own = rows[heads]
        of = np.repeat(np.arange(len(heads)), np.diff(np.concatenate((heads, [n]))))
        log_w = np.log(weights).astype(np.float32)
        at, t, a, x = np.empty(n, np.uint64), np.empty(n, np.float32), np.empty(n, np.float32), np.empty(n, np.float32)
        place, low, hit = at.view(np.int64), np.empty(n, np.float32), np.empty(n, bool)
        for k, odd in enumerate(self.odd):
            np.multiply(hashes, odd, out=at)
            at >>= np.uint64(64 - _TABLE)
            np.take(self.over, place, out=t, mode="clip")
            t *= log_w
            t += np.take(self.b, place, out=x, mode="clip")
            np.floor(t, out=t)
            np.take(self.r, place, out=x, mode="clip")
            x *= t
            np.subtract(np.take(self.rest, place, out=a, mode="clip"), x, out=a)
            best = np.minimum.reduceat(a, heads)
            np.equal(a, np.take(best, of, out=low, mode="clip"), out=hit)
            found = np.flatnonzero(hit)
            group = of[found]
            first = found[np.concatenate(([True], group[1:] != group[:-1]))]
            out[own, k] = mix(hashes[first] + t[first].astype(np.int64).astype(np.uint64) * _ODD + np.uint64(k))
        return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """(rows, BANDS) keys, unlike between bands."""
    out = np.zeros((len(samples), BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(len(samples), band + 1, np.uint64)
        for k in range(ROWS):
            h = mix(h * _ODD + samples[:, band * ROWS + k])
        out[:, band] = h
    return out.view(np.int64)


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard of two stored sets."""
    n_a, n_b = np.frombuffer(a, "<u4", 1)[0], np.frombuffer(b, "<u4", 1)[0]
    ka, kb = unpack_sorted(a[4 : 4 + n_a]), unpack_sorted(b[4 : 4 + n_b])
    wa, wb = large(a[4 + n_a :]), large(b[4 + n_b :])
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = int(np.minimum(wa[i], wb[j]).sum())
    return both / max(1, int(wa.sum()) + int(wb.sum()) - both)


def packed_set(hashes: np.ndarray, weights: np.ndarray) -> bytes:
    """32-bit shingle keys and integer weights."""
    keys, back = np.unique(hashes >> np.uint64(32), return_inverse=True)
    total = np.bincount(back, weights, minlength=len(keys)).astype(np.int64)
    head = pack_sorted(keys, 32)
    return np.array([len(head)], "<u4").tobytes() + head + small(total)


def sketches(docs: DataFrame, id_col: str, text: str, kept: list[str]) -> DataFrame:
    """Stored rows (id, key, uid, bands, weight, shared, shingles) of all documents; shared: weight of shingles that other
    documents hold too."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    n = blocks(size["bytes"], FRAGMENT_BYTES)
    log_buckets = n.bit_length() - 1
    bits = min(56, max(40, (size["bytes"] // 4).bit_length() + 16))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    parts = fragmented(rows, ["id", "t", F.md5("t").alias("key")], n)
    short = np.uint64(64 - bits)

    def ask(t: pa.Table) -> pa.Table:
        give_back()
        keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h >> short for _, _, h, _ in shingles(t.column("t")))]), return_counts=True)
        return request_table(requests(t.column("frag")[0].as_py(), 1, 1, keys, counts, bits, log_buckets))

    def sketch(key, t: pa.Table, a: pa.Table) -> pa.Table:
        give_back()
        got = list(shingles(t.column("t")))
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h >> short for _, _, h, _ in got)]))
        held = answered(a, 1, keys, 1, bits, log_buckets)
        rate = np.rint(GRID * (1 + DAMP * np.log1p(size.n / held) / np.log1p(size.n))).astype(np.int64)
        sampler = Sampler()
        bands, weight, shared, sets = [], [], [], []
        for n_rows, rows, h, tf in got:
            at = np.searchsorted(keys, h >> short)
            w = tf * rate[at]
            shared.append(np.bincount(rows, w * (held[at] > 1), minlength=n_rows).astype(np.int64))
            bands.append(band_keys(sampler.samples(rows, h, w, n_rows)))
            weight.append(np.bincount(rows, w, minlength=n_rows).astype(np.int64))
            ends = np.searchsorted(rows, np.arange(n_rows + 1))
            sets += [packed_set(h[x:y], w[x:y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
        flat = np.concatenate([np.zeros((0, BANDS), np.int64), *bands])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * BANDS, pa.int32()), pa.array(flat.ravel()))
        return pa.table([t.column("id"), t.column("key"), pa.chunked_array([lists]), pa.array(np.concatenate([np.zeros(0, np.int64), *weight])), pa.array(np.concatenate([np.zeros(0, np.int64), *shared])), pa.array(sets, pa.binary())], ["id", "key", "bands", "weight", "shared", "shingles"])

    sent = exchange(parts, ask, counting, {1: bits}, log_buckets)
    out = parts.groupBy("frag").cogroup(sent.groupBy("frag")).applyInArrow(sketch, f"id {kind}, key string, bands array<long>, weight long, shared long, shingles binary")
    return stored(out.withColumn("uid", F.monotonically_increasing_id()), "sketches", kept)


def verified(pairs: DataFrame, sets: DataFrame, kept: list[str]) -> DataFrame:
    """Pairs (a, b) of weighted Jaccard THRESHOLD at least, stored."""

    def run(batches):
        for batch in batches:
            good = pa.array([similarity(x, y) >= THRESHOLD for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])

    both = pairs.join(sets.select(F.col("uid").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("uid").alias("b"), F.col("shingles").alias("y")), "b")
    return stored(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links", kept)


def reach(a: str, b: str) -> Column:
    """Can two texts be THRESHOLD alike? They have at most the lesser shared weight in common, and at most the lesser weight."""
    both = F.least(f"{a}shared", f"{b}shared").cast("double")
    return (both >= THRESHOLD * (F.col(f"{a}weight") + F.col(f"{b}weight") - both)) & (F.least(f"{a}weight", f"{b}weight") >= THRESHOLD * F.greatest(f"{a}weight", f"{b}weight"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, key (md5 of the text), class_id, class_size, keep (one document of each class)."""
    kept: list[str] = []  # tables that the result does not need
    s = sketches(docs, id_col, text, kept)
    texts = stored(s.groupBy("key").agg(F.min("uid").alias("uid"), F.first("bands").alias("bands"), F.first("weight").alias("weight"), F.first("shared").alias("shared"), F.count("*").alias("copies")), "texts", kept)
    able = texts.where("weight > 0").where(F.col("shared") >= THRESHOLD * F.col("weight"))  # both <= shared, and both >= 0.8 * (weight + rest of the other)
    lists = able.select("uid", "weight", "shared", "bands", F.explode("bands").alias("bucket"))
    first = F.struct(F.round((F.col("weight") - F.col("shared")) / F.col("weight"), 2), F.xxhash64("uid", "bucket"), "uid", "weight", "shared")
    heads = lists.groupBy("bucket").agg(F.count("*").alias("n"), F.min(first).alias("l")).where("n > 1").select("bucket", "n", "l.uid", "l.weight", "l.shared").toDF("bucket", "n", "leader", "l_weight", "l_shared")
    members = stored(spread_join(lists, stored(heads, "heads", kept), "bucket", "n", texts.count() * BANDS).drop("n"), "members", kept)
    pairs = members.where("uid <> leader").where(reach("", "l_")).select(F.least("uid", "leader").alias("a"), F.greatest("uid", "leader").alias("b")).distinct()
    touched = stored(members.select("uid").distinct(), "touched", kept)
    sets = stored(s.select("uid", "shingles").join(touched, "uid", "left_semi"), "sets", kept)
    links = verified(pairs, sets, kept)
    roots = components(links)
    tagged = members.join(roots.withColumnRenamed("id", "uid"), "uid", "left").select("bucket", "uid", "weight", "shared", "bands", F.coalesce("root", "uid").alias("root"))
    n = members.count()
    mixed = tagged.groupBy("bucket", "root").count().groupBy("bucket").agg(F.count("*").alias("n"), F.sum("count").alias("rows"), F.max_by("root", F.struct("count", "root")).alias("main")).where("n > 1").select("bucket", "rows", "main")
    inside = stored(spread_join(tagged, mixed, "bucket", "rows", n), "mixed", kept)
    salts = F.ceil(F.col("rows") * HOT_SHARE / n).cast("int")  # a hot bucket's members are dealt out, and each part meets all the few
    few = inside.where("root <> main").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).alias("m")
    all_ = inside.withColumn("salt", F.pmod(F.hash("uid"), salts)).alias("x")
    fits = reach("m.", "x.") & (F.col("m.root") != F.col("x.root")) & ((F.col("x.root") == F.col("x.main")) | (F.col("x.uid") > F.col("m.uid")))
    once = F.col("m.bucket") == F.array_min(F.array_intersect("m.bands", "x.bands"))  # in one of the buckets that both are in
    rest = few.join(all_, (F.col("m.bucket") == F.col("x.bucket")) & (F.col("m.salt") == F.col("x.salt")) & fits & once).select(F.least("m.uid", "x.uid").alias("a"), F.greatest("m.uid", "x.uid").alias("b")).distinct()
    more = verified(rest, sets, kept)
    roots = components(links.union(more))
    # Per distinct text its class; a class's figures are summed over texts first, so neither many copies nor a large class is
    # one task's work.
    of_text = stored(texts.join(roots.withColumnRenamed("id", "uid"), "uid", "left").select("key", "copies", F.coalesce("root", "uid").alias("root")), "roots", kept)
    total = s.count()
    rows = s.select("id", "key", F.col("uid").alias("row"))
    empty = F.col("key") == F.md5(F.lit(""))
    alone = rows.where(empty).select("id", "key", "row", F.col("row").alias("root"))
    named = stored(spread_join(rows.where(~empty), of_text, "key", "copies", total).select("id", "key", "row", "root").unionByName(alone), "named")
    for path in kept:
        deleted(docs.sparkSession, path)
    classes = named.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"), F.min_by("row", F.struct(F.col("id").isNull(), "id", "row")).alias("kept"))
    return spread_join(named, classes, "root", "class_size", total).select(F.col("id").alias(id_col), "key", "class_id", "class_size", (F.col("row") == F.col("kept")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class. Which rows go is joined by id and text, since rows have no other name; of rows equal
    in both any one stays. Names of the rows that go are broadcast up to BROADCAST_BYTES, else both sides are shuffled."""
    found = stored(near_duplicates(docs, id_col, text).select(F.col(id_col).alias("__id"), F.col("key").alias("__key"), "keep"), "classes")
    by_row = stored(found.groupBy("__id", "__key").agg(F.max("keep").alias("keep"), F.count("*").alias("n")), "rows")
    gone = by_row.where(~F.col("keep")).select("__id", "__key")
    own_id, own, left, right = fresh(docs, "__own_id", "__own", "__id", "__key")
    src = docs.withColumns({own_id: F.col(f"`{id_col}`"), own: F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))})
    few = gone.count() * ROW_BYTES <= BROADCAST_BYTES
    gone = gone.toDF(left, right)
    rows = src.join(F.broadcast(gone) if few else gone, F.col(own_id).eqNullSafe(F.col(left)) & (F.col(own) == F.col(right)), "left_anti")
    if by_row.where("keep and n > 1").limit(1).count():
        empty = F.md5(F.lit(""))  # empty texts are each their own class
        rows = rows.where(F.col(own) != empty).dropDuplicates([own_id, own]).unionByName(rows.where(F.col(own) == empty))
    return rows.drop(own_id, own)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "keep")
