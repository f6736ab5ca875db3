"""Exact top-k inner products over norm-sorted vectors with SVD-rotated partial sums.

Components become the integers floor(64 * x). Vectors are dealt out by ranges of descending length. The second moments of
all vectors give a rotation; in the rotated frame a product is the sum over the leading HEAD coordinates plus a rest that
Cauchy-Schwarz bounds by the lengths of the two remainders. A query's threshold, its k-th best score so far, starts from
the longest vectors; its length and threshold bound the lengths that can still matter, so it asks for a prefix of the parts.
Queries are dealt out by how far their prefixes reach, so a part is sent only to the few blocks that reach it, and a block
reads no part that none of its queries asks for. Inside a part, pairs whose bound stays under the threshold are not
computed; what survives is computed exactly in integers. Groups (part, query block) have bounded size.

Vectors that are null, or hold null or non-finite components, and null ids take no part; shorter vectors count as if zeros
followed. Components beyond 2**62 / 64 or products that 64 bits can't hold raise an error. Rows of equal id are different
vectors, however many there are: parts and blocks are cut by row too; ties go to the smaller id, then to the row stored
first. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, stored, table

SCALE = 64
HEAD = 16
PART_ROWS = 8192
QUERY_ROWS = 2048
FIRST_ROWS = 2048
STEP = 1024
MERGED = 16  # parts whose results are merged first


def quantised(vectors: DataFrame, id_col: str, column: str) -> DataFrame:
    """Rows (uid, id, v, norm) with integer components, stored."""
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where("id is not null and v is not null")

    def run(batches):
        for batch in batches:
            v = batch.column(1)
            n = np.asarray(v.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(float)
            scaled = np.floor(flat * SCALE)
            fine = np.isfinite(scaled)
            if (np.abs(scaled[fine]) >= 2.0**62).any():
                raise ValueError("components beyond 2**62 / 64")
            row = np.repeat(np.arange(len(n)), n)
            good = np.bincount(row[~fine], minlength=len(n)) == 0
            ints = scaled[fine & good[row]].astype(np.int64)
            norm = np.sqrt(np.bincount(row, np.where(fine, scaled, 0.0) ** 2, minlength=len(n)))[good]
            ends = np.concatenate(([0], np.cumsum(n[good])))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ints)), pa.array(norm)], ["id", "v", "norm"])

    out = src.mapInArrow(run, "id long, v array<long>, norm double").withColumn("uid", F.monotonically_increasing_id())
    return stored(out, "vectors")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, zeros after shorter ones."""
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), dim), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = column.flatten().to_numpy()
    return out


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all rows, by their second moments."""

    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            m = matrix(batch.column(0), dim).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim), pa.int32()), pa.array(total.ravel())], ["i", "s"])

    gram = np.zeros(dim * dim)
    for r in vectors.select("v").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        gram[r.i] = r.s
    return np.linalg.eigh(gram.reshape(dim, dim))[1][:, ::-1].copy()


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where all partial sums are exact there."""
    most = np.sqrt((a.astype(float) ** 2).sum(1).max(initial=0) * (b.astype(float) ** 2).sum(1).max(initial=0))
    if most < 2.0**52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most >= 2.0**63:
        raise ValueError("products beyond 64 bits")
    return a @ b.T


class Best:
    """The k best (score, smaller id, smaller uid) of each query."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.found: list[np.ndarray] = [np.zeros((0, 3), np.int64) for _ in range(n)]

    def add(self, q: int, score: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        both = np.concatenate((self.found[q], np.stack((score, ids, uids), 1)))
        both = both[np.lexsort((both[:, 2], both[:, 1], -both[:, 0]))[: self.k]]
        self.found[q] = both
        if len(both) == self.k:
            self.floor[q] = max(self.floor[q], float(both[-1, 0]))


def scan(queries: np.ndarray, own: np.ndarray, floor: np.ndarray, vectors: np.ndarray, ids: np.ndarray, uids: np.ndarray, turn: np.ndarray, k: int) -> Best:
    """vectors: by descending norm. Blocks of STEP, each bounded by norms, then by partial sums, then computed."""
    best = Best(len(queries), k, floor)
    q_rot, v_rot = queries @ turn, vectors @ turn
    q_norm, v_norm = np.linalg.norm(q_rot, axis=1), np.linalg.norm(v_rot, axis=1)
    q_rest, v_rest = np.linalg.norm(q_rot[:, HEAD:], axis=1), np.linalg.norm(v_rot[:, HEAD:], axis=1)
    for a in range(0, len(vectors), STEP):
        b = min(len(vectors), a + STEP)
        slack = 1e-9 * q_norm * v_norm[a] + 1e-6
        live = np.flatnonzero(q_norm * v_norm[a] + slack >= best.floor)
        if not len(live):
            break  # all later vectors are shorter
        bound = q_rot[live, :HEAD] @ v_rot[a:b, :HEAD].T + np.outer(q_rest[live], v_rest[a:b]) + slack[live, None]
        may = bound >= best.floor[live, None]
        may &= own[live, None] != uids[None, a:b]
        columns, rows = np.flatnonzero(may.any(0)), np.flatnonzero(may.any(1))
        if not len(rows):
            continue
        exact = products(queries[live[rows]], vectors[a + columns])
        may = may[np.ix_(rows, columns)]
        for i, r in enumerate(rows):
            q = live[r]
            at = np.flatnonzero(may[i] & (exact[i] >= best.floor[q]))
            if len(at) > k:  # keep all that tie with the k-th
                at = at[exact[i, at] >= np.partition(exact[i, at], len(at) - k)[len(at) - k]]
            if len(at):
                c = a + columns[at]
                best.add(q, exact[i, at], ids[c], uids[c])
    return best


def top_products(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """For each vector whose id is divisible by `every`: its k largest inner products with all other rows."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score long"
    rows = quantised(vectors, id_col, column)
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()
    dim = max(1, size.d)
    turn = rotation(rows, dim)
    parts = blocks(size.n, PART_ROWS)
    order = [F.col("norm").desc(), F.col("uid")]
    sorted_rows = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "sorted")
    longest = {r.part: r.norm for r in sorted_rows.groupBy("part").agg(F.max("norm").alias("norm")).collect()}  # one row per part
    first = sorted_rows.orderBy(*order).limit(FIRST_ROWS).select("v", "uid").toArrow()
    lead = spark.sparkContext.broadcast((matrix(first.column("v").combine_chunks(), dim) if first.num_rows else np.zeros((0, dim), np.int64), first.column("uid").to_numpy(), turn, longest))

    def reach(batches):
        """Queries with their thresholds and the number of the last part that can hold a better vector."""
        top, top_uid, _, longest = lead.value
        numbers = np.array(sorted(longest), np.int64)
        norms = np.array([longest[p] for p in numbers.tolist()])
        for batch in batches:
            q = matrix(batch.column(1), dim)
            uid = batch.column(2).to_numpy()
            floor = np.full(len(q), -np.inf)
            for a in range(0, len(q), 256):
                s = products(q[a : a + 256], top).astype(float)
                s[uid[a : a + 256, None] == top_uid[None]] = -np.inf
                if s.shape[1] >= k:
                    floor[a : a + 256] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            norm = np.linalg.norm(q.astype(float), axis=1)
            # Lengths fall from part to part, so the parts that may matter are the first ones.
            least = np.where(norm > 0, (floor - 1e-6) / np.maximum(norm, 1e-300) / (1 + 1e-9), np.where(floor > 0, np.inf, -np.inf))
            count = np.searchsorted(-norms, -least, "right")
            keep = count > 0
            last = numbers[np.maximum(count - 1, 0)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:3]] + [pa.array(floor[keep]), pa.array(last[keep], pa.int32())], ["id", "v", "uid", "floor", "last"])

    queries = sorted_rows.where(F.col("id") % every == 0).select("id", "v", "uid").mapInArrow(reach, "id long, v array<long>, uid long, floor double, last int")
    found_reach = stored(queries, "queries")
    # Blocks in order of falling reach, of about QUERY_ROWS queries; many of one reach are dealt over several blocks.
    wide, at = [], 0.0
    for r in found_reach.groupBy("last").agg(F.count("*").alias("n")).orderBy(F.col("last").desc()).collect():  # one row per part at most
        wide.append((r["last"], int(at // QUERY_ROWS), max(1, -(-r.n // QUERY_ROWS))))
        at = at + r.n if r.n < QUERY_ROWS else (at // QUERY_ROWS + wide[-1][2]) * QUERY_ROWS
    dealt = F.broadcast(spark.createDataFrame(wide, "last int, first int, width int"))
    asking = found_reach.join(dealt, "last").withColumn("qb", (F.col("first") + F.pmod(F.xxhash64("uid"), F.col("width"))).cast("int"))
    lasts, ends = np.array([x[0] for x in wide], np.int64), np.maximum.accumulate(np.array([0, *(x[1] + x[2] for x in wide)], np.int64))
    wanted = spark.createDataFrame([(p, int(ends[np.searchsorted(-lasts, -p, "right")])) for p in longest], "part int, n int")
    asked = asking.select("id", "v", "uid", "floor", "qb", F.explode(F.sequence(F.lit(0), "last")).alias("part"))
    given = sorted_rows.join(wanted.where("n > 0"), "part").select("id", "v", "uid", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("qb"), "norm", "part")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        rows: list[np.ndarray] = []
        if a.num_rows and b.num_rows:
            b = b.sort_by([("norm", "descending"), ("uid", "ascending")])
            q, v = matrix(a.column("v").combine_chunks(), dim), matrix(b.column("v").combine_chunks(), dim)
            best = scan(q, a.column("uid").to_numpy(), a.column("floor").to_numpy(), v, b.column("id").to_numpy(), b.column("uid").to_numpy(), lead.value[2], k)
            q_id, q_uid = a.column("id").to_numpy(), a.column("uid").to_numpy()
            rows = [np.column_stack((np.full(len(x), q_id[i]), np.full(len(x), q_uid[i]), x)) for i, x in enumerate(best.found) if len(x)]
        flat = np.concatenate(rows) if rows else np.zeros((0, 5), np.int64)
        near = b.column("part")[0].as_py() // MERGED if b.num_rows else 0
        return pa.table({c: pa.array(flat[:, i], pa.int64()) for i, c in enumerate(("query_id", "query_uid", "score", "vec_id", "uid"))} | {"near": pa.array(np.full(len(flat), near), pa.int32())})

    found = asked.groupBy("part", "qb").cogroup(given.groupBy("part", "qb")).applyInArrow(meet, "query_id long, query_uid long, score long, vec_id long, uid long, near int")
    best = [F.col("score").desc(), F.col("vec_id"), F.col("uid")]
    # A query that reaches very many parts has its best of every MERGED of them chosen first.
    for keys in (["query_uid", "near"], ["query_uid"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= k)
    return found.select(*(c.split()[0] for c in out.split(", ")))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))
