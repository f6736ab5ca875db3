"""Kernels in numpy for what has no plan of expressions: pair correlations by blocks, hulls, permutation tests, rewiring.

Each task's share is bounded by a block size or by one system's inventory; where the latter is checked, the limit is named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import stored

BLOCK, RANK_BLOCK, READINGS = 4096, 4096, 4_000_000  # series in a block (of rank correlations), readings in a block
CHUNK, TILE, MEMBERS = 512, 512, 64  # bins and series multiplied at once, stations that share one copy of their series


def _mean_ranks(x: np.ndarray) -> np.ndarray:
    """Twice the mean ranks of equal values, row by row."""
    order = np.argsort(x, axis=1, kind="stable")
    s = np.take_along_axis(x, order, 1)
    at = np.arange(x.shape[1])
    new = np.concatenate((np.ones((len(x), 1), bool), s[:, 1:] != s[:, :-1]), 1)
    first = np.maximum.accumulate(np.where(new, at, 0), 1)
    ends = np.concatenate((new[:, 1:], np.ones((len(x), 1), bool)), 1)
    last = np.minimum.accumulate(np.where(ends, at, x.shape[1])[:, ::-1], 1)[:, ::-1]
    out = np.empty(x.shape, np.int64)
    np.put_along_axis(out, order, first + last + 2, 1)
    return out


def _rank_correlations(x: np.ndarray, y: np.ndarray, method: str) -> np.ndarray:
    """Of each row of x with that of y; Kendall's is tau-b. NaN for a constant side."""
    n = x.shape[1]
    if method == "kendall":
        s, tx, ty = np.zeros((3, len(x)), np.int64)
        for lag in range(1, n):
            up_x, same_x, up_y, same_y = x[:, lag:] > x[:, :-lag], x[:, lag:] == x[:, :-lag], y[:, lag:] > y[:, :-lag], y[:, lag:] == y[:, :-lag]
            both = ~(same_x | same_y)
            s += 2 * (both & (up_x == up_y)).sum(1) - both.sum(1)
            tx, ty = tx + (n - lag) - same_x.sum(1), ty + (n - lag) - same_y.sum(1)
        xy, xx, yy = s.astype(float), tx.astype(float), ty.astype(float)
    else:
        dx, dy = (_mean_ranks(v).astype(float) - (n + 1) for v in (x, y))
        xy, xx, yy = (dx * dy).sum(1), (dx * dx).sum(1), (dy * dy).sum(1)
    return np.where((xx > 0) & (yy > 0), xy / np.sqrt(np.where((xx > 0) & (yy > 0), xx * yy, 1)), np.nan)


class _Series:
    """Rows of bins (ascending) and values."""

    def __init__(self, size: np.ndarray, at: np.ndarray, x: np.ndarray):
        self.first, self.size, self.at, self.x = np.cumsum(size) - size, size, at, x

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number among rows, bin and value of each reading."""
        n = self.size[rows]
        row = np.repeat(np.arange(len(rows)), n)
        i = np.arange(n.sum()) + np.repeat(self.first[rows] - np.cumsum(n) + n, n)
        return row, self.at[i], self.x[i]

    def pearson(self, a: np.ndarray, b: np.ndarray, least: int):
        """Pairs of rows a and b, their correlations and shared bins."""
        (ra, ta, xa), (rb, tb, xb) = self.of(a), self.of(b)
        bins = np.intersect1d(ta, tb)
        n, sx, sy, xx, yy, xy = np.zeros((6, len(a), len(b)))
        for lo in range(0, len(bins), CHUNK):
            some = bins[lo : lo + CHUNK]
            sides = []
            for row, t, x, k in ((ra, ta, xa, len(a)), (rb, tb, xb, len(b))):
                col = np.minimum(np.searchsorted(some, t), len(some) - 1)
                on = some[col] == t
                m, z = np.zeros((2, k, len(some)))
                m[row[on], col[on]], z[row[on], col[on]] = 1, x[on]
                sides += [m, z]
            m, z, w, v = sides
            n, sx, sy, xx, yy, xy = n + m @ w.T, sx + z @ w.T, sy + m @ v.T, xx + (z * z) @ w.T, yy + m @ (v * v).T, xy + z @ v.T
        vx, vy = n * xx - sx * sx, n * yy - sy * sy
        i, j = np.nonzero((n >= least) & (vx > 1e-12 * n * xx) & (vy > 1e-12 * n * yy))
        corr = (n * xy - sx * sy)[i, j] / np.sqrt(vx[i, j] * vy[i, j])
        yield a[i], b[j], np.clip(corr, -1, 1), n[i, j].astype(np.int64)

    def ranked(self, a: np.ndarray, b: np.ndarray, least: int, method: str):
        """The same by ranks, some pairs at a time; pairs with equally many shared bins are computed together."""
        row, t, x = self.of(b)
        bins, col = np.unique(t, return_inverse=True)
        wide = np.full((len(b), len(bins)), np.nan)
        wide[row, col] = x
        held, n_held = [], 0
        for k, i in enumerate(a):
            own = slice(self.first[i], self.first[i] + self.size[i])
            col = np.minimum(np.searchsorted(bins, self.at[own]), len(bins) - 1)
            on = bins[col] == self.at[own]
            seen = wide[:, col[on]]
            both = ~np.isnan(seen)
            j, at = np.nonzero(both)
            held.append((np.full(len(b), i), b, both.sum(1), self.x[own][on][at], seen[j, at]))
            n_held += len(j)
            if n_held > 1_000_000 or k == len(a) - 1:
                p, q, n, left, right = map(np.concatenate, zip(*held))
                first, held, n_held = np.cumsum(n) - n, [], 0
                for size in np.unique(n[n >= max(least, 2)]):
                    pick = np.flatnonzero(n == size)
                    where = first[pick][:, None] + np.arange(size)
                    corr = _rank_correlations(left[where], right[where], method)
                    ok = ~np.isnan(corr)
                    yield p[pick][ok], q[pick][ok], corr[ok], n[pick][ok]


def pair_correlations(bins: DataFrame, method: str = "pearson", min_overlap: int = 24, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, station_a, station_b, corr, n_overlap) of all pairs station_a < station_b; bins: (by, station_id, b, x).

    Equal series are correlated once, MEMBERS stations at most with each copy, and pairs of stations are made from pairs of
    series as they are read. A task holds two blocks of series; nothing is stored or sent for pairs. Pairs with a constant
    side have no correlation and no row."""
    if method not in ("pearson", "spearman", "kendall"):
        raise ValueError(f"unknown method {method!r}")
    known = bins.where(F.col("station_id").isNotNull() & ~F.isnan(F.col("x").cast("double")))
    series = known.groupBy(*by, F.col("station_id").cast("string").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("b").cast("long").alias("b"), F.col("x").cast("double").alias("x")))).alias("s"))
    series = series.where((F.size("s") >= min_overlap) & (F.array_max("s.x") > F.array_min("s.x"))).groupBy(*by, "s").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / MEMBERS).cast("int")), lambda i: F.slice("ids", i * MEMBERS + 1, MEMBERS))
    parts = stored(series.select(*by, "s", F.explode(parts).alias("ids")))
    n, groups, longest = parts.groupBy(*by).agg(F.count("*").alias("n"), F.max(F.size("s")).alias("m")).agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*"), F.coalesce(F.max("m"), F.lit(1))).first()
    size = max(1, min(BLOCK if method == "pearson" else RANK_BLOCK, READINGS // longest))
    blocks = max(1, -(-n // size), min(12, n // 64))
    tasks = min(1000, max(1, groups * blocks * (blocks + 1)))
    rows = parts.withColumn("blk", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(blocks)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select(*by, F.col("s.b").alias("at"), F.col("s.x").alias("x"), "ids", "blk", F.least("blk", "o").alias("lo"), F.greatest("blk", "o").alias("hi")).repartition(tasks, *by, "lo", "hi")
    kinds = "".join(f"`{c}` {bins.schema[c].dataType.simpleString()}, " for c in by)

    def correlated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        at, x, ids = (t[c].chunk(0) for c in ("at", "x", "ids"))
        length = at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        z = x.flatten().to_numpy(zero_copy_only=False)
        if method == "pearson":  # sums of small numbers keep their digits
            z = z - np.repeat(np.add.reduceat(z, np.cumsum(length) - length) / length, length)
        s = _Series(length, at.flatten().to_numpy(zero_copy_only=False), z)
        block, lo, hi = (t[c].to_numpy() for c in ("blk", "lo", "hi"))
        a, b = np.flatnonzero(block == lo[0]), np.flatnonzero(block == hi[0])
        many = ids.value_lengths().to_numpy(zero_copy_only=False) > 1
        tile = max(1, min(TILE, 2_000_000 // max(1, len(np.unique(s.at)))))
        for i in range(0, len(a), tile):
            for j in range(i if lo[0] == hi[0] else 0, len(b), tile):
                sides = a[i : i + tile], b[j : j + tile]
                for p, q, corr, n in s.pearson(*sides, min_overlap) if method == "pearson" else s.ranked(*sides, min_overlap, method):
                    use = np.flatnonzero((p < q) | ((p == q) & many[p]) if lo[0] == hi[0] else np.ones(len(p), bool))
                    for k in range(0, len(use), 10_000):
                        u = use[k : k + 10_000]
                        yield pa.RecordBatch.from_arrays([*(pa.repeat(t[c][0], len(u)) for c in by), ids.take(pa.array(p[u])), ids.take(pa.array(q[u])), pa.array(p[u] == q[u]), pa.array(corr[u]), pa.array(n[u])], names=[*by, "p", "q", "own", "corr", "n_overlap"])

    found = rows.groupBy(*by, "lo", "hi").applyInArrow(correlated, f"{kinds}p array<string>, q array<string>, own boolean, corr double, n_overlap long")
    pairs = found.withColumn("p", F.explode("p")).withColumn("q", F.explode("q")).where(~F.col("own") | (F.col("p") < F.col("q")))
    return pairs.select(*by, F.least("p", "q").alias("station_a"), F.greatest("p", "q").alias("station_b"), "corr", "n_overlap")


# --- hulls -----------------------------------------------------------------------------------------------------------


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counterclockwise, by two chains over the points in order of x, then y."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(rows) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def polygon_area(corners: np.ndarray) -> float:
    x, y = corners.T - corners.mean(0)[:, None]
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def hull_of_parts(points: DataFrame) -> DataFrame:
    """area_km2 of the hull of (x_m, y_m): partitions send the corners of their own hulls."""

    def own(batches):
        held = np.zeros((0, 2))
        for pdf in batches:
            held = hull(np.concatenate((held, pdf[["x_m", "y_m"]].to_numpy())))
        yield pd.DataFrame(held, columns=["x_m", "y_m"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        corners = hull(pdf[["x_m", "y_m"]].to_numpy())
        area = polygon_area(corners) / 1e6 if len(corners) > 2 else 0.0
        return pd.DataFrame({"area_km2": [area if area > 0 else None]}, dtype="float64")

    return points.mapInPandas(own, "x_m double, y_m double").groupBy().applyInPandas(whole, "area_km2 double")


# --- permutation tests and rewiring ----------------------------------------------------------------------------------


LEAF = 64  # points in a box of the search for neighbours


def _boxes(xyz: np.ndarray) -> list[np.ndarray]:
    """Numbers of the points of each box; halves along the widest side."""
    out, todo = [], [np.arange(len(xyz))]
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            out.append(at)
            continue
        side = int(np.ptp(xyz[at], axis=0).argmax())
        half = np.argpartition(xyz[at, side], len(at) // 2)
        todo += [at[half[: len(at) // 2]], at[half[len(at) // 2 :]]]
    return out


def neighbour_numbers(lat: np.ndarray, lon: np.ndarray, k: int) -> np.ndarray:
    """(n, k) numbers of the nearest others, by chords of the unit sphere; ties go to the smaller number. Of many points at
    one place the first k + 1 do for all; boxes of points meet only the boxes that can hold a neighbour."""
    la, lo = np.radians(lat), np.radians(lon)
    xyz = np.stack((np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)), 1)
    out = np.zeros((len(xyz), k), np.int64)
    if len(xyz) < 2000:
        d = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        out[:] = np.argsort(d, axis=1, kind="stable")[:, :k]
        return out
    _, place = np.unique(xyz, axis=0, return_inverse=True)
    place = place.reshape(-1)
    order = np.argsort(place, kind="stable")
    starts = np.r_[0, np.flatnonzero(np.diff(place[order])) + 1]
    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    late = nth > k
    out[order[late]] = order[(np.repeat(starts, np.diff(np.r_[starts, len(order)])))[late][:, None] + np.arange(k)]
    kept = np.sort(order[~late])
    boxes = [kept[b] for b in _boxes(xyz[kept])]
    low, high = (np.stack([f(xyz[b], axis=0) for b in boxes]) for f in (np.min, np.max))
    for i, own in enumerate(boxes):
        apart = (np.maximum(np.maximum(low - high[i], low[i] - high), 0) ** 2).sum(1)
        near, use = np.argsort(apart, kind="stable"), 0
        reach = np.inf
        while use < len(near) and apart[near[use]] <= reach * (1 + 1e-9) + 1e-24:  # more boxes until none nearer is left
            use = max(use + 1, min(2 * use, int(np.searchsorted(apart[near], reach * (1 + 1e-9) + 1e-24, side="right"))))
            other = np.sort(np.concatenate([boxes[j] for j in near[:use]]))
            d = ((xyz[own][:, None] - xyz[other][None]) ** 2).sum(2)
            d[own[:, None] == other] = np.inf
            if len(other) > k:
                reach = float(np.partition(d, k - 1, axis=1)[:, k - 1].max())
        out[own] = other[np.argsort(d, axis=1, kind="stable")[:, :k]]
    return out


def local_moran_inference(info: DataFrame, value: str, *, k: int = 8, permutations: int = 999, seed: int = 0, fdr: bool = False, by: tuple[str, ...] = ("system_id",)) -> DataFrame:
    """(by, station_id, local_i, z_score, p_value, cluster_type and, with fdr, fdr_p) of each station of an inventory, one
    task each, which holds some 100 bytes a station and neighbour. Values are dealt out anew `permutations` times; p is the share of draws at least as
    far from 0, the real one included. HH, LL, HL or LH at 5 %, else ns. Stations without place or value: NULL and ns."""
    kinds = "".join(f"`{c}` {info.schema[c].dataType.simpleString()}, " for c in by)
    names = ["station_id", "local_i", "z_score", "p_value", "cluster_type", *(["fdr_p"] if fdr else [])]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("station_id", kind="stable").reset_index(drop=True)
        out = pd.DataFrame({"station_id": pdf["station_id"], "local_i": np.nan, "z_score": np.nan, "p_value": np.nan, "cluster_type": "ns", "fdr_p": np.nan})
        x = pdf[["lat", "lon", "v"]].to_numpy(float)
        at = np.flatnonzero(np.isfinite(x).all(1))
        n = len(at)
        z = x[at, 2] - x[at, 2].mean() if n else x[at, 2]
        m2 = z @ z / (n - 1) if n > 1 else 0.0
        if n >= 3 and m2 > 0:
            near = neighbour_numbers(x[at, 0], x[at, 1], min(k, n - 1))
            lag = z[near].mean(1)
            found = z / m2 * lag
            out.loc[at, "local_i"] = found
            if permutations > 0:
                rng, reached, total, square = np.random.default_rng(seed), np.zeros(n), np.zeros(n), np.zeros(n)
                for _ in range(permutations):
                    drawn = z / m2 * rng.permutation(z)[near].mean(1)
                    reached += np.abs(drawn) >= np.abs(found)
                    total += drawn
                    square += drawn * drawn
                mean = total / permutations
                p = (reached + 1) / (permutations + 1)
                out.loc[at, "z_score"] = (found - mean) / np.sqrt(np.maximum(square / permutations - mean * mean, 1e-12))
                out.loc[at, "p_value"] = p
                level = p
                if fdr:
                    order = np.argsort(p, kind="stable")
                    level = np.empty(n)
                    level[order] = np.minimum(np.minimum.accumulate((p[order] * n / np.arange(1, n + 1))[::-1])[::-1], 1)
                    out.loc[at, "fdr_p"] = level
                kind = np.where(z > 0, "H", "L").astype(object) + np.where(lag > 0, "H", "L").astype(object)
                out.loc[at, "cluster_type"] = np.where(level <= 0.05, kind, "ns")
        out = out[names]
        for c, v in zip(by, key):
            out.insert(by.index(c), c, v)
        return out

    rows = info.select(*by, "station_id", "lat", "lon", F.col(value).cast("double").alias("v"))
    return rows.groupBy(*by).applyInPandas(run, f"{kinds}station_id {info.schema['station_id'].dataType.simpleString()}, local_i double, z_score double, p_value double, cluster_type string" + (", fdr_p double" if fdr else ""))


def degree_preserving_rewire(edges: DataFrame, *, n_swaps: int | None = None, seed: int = 42) -> DataFrame:
    """(a_id, b_id) in both directions: the graph after n_swaps tries (10 per edge) to exchange the ends of two edges, so each
    station keeps its degree. Tries that would make a loop or a double edge change nothing. Each round tries all edges in
    random pairs at once; one task holds the graph as numbers."""
    once = edges.where((F.col("weight") > 0) & (F.col("a_id") != F.col("b_id"))).select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).distinct()
    kind = edges.schema["a_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        numbers, names = pd.factorize(pd.concat((pdf["a_id"], pdf["b_id"]), ignore_index=True), sort=True)
        names, many = np.asarray(names, object), max(1, len(names))
        ends = np.stack((numbers[:n], numbers[n:]), 1).astype(np.int64)
        ends = ends[np.lexsort((ends[:, 1], ends[:, 0]))]
        key = lambda e: e.min(1) * many + e.max(1)
        rng = np.random.default_rng(seed)
        tries = (n_swaps if n_swaps is not None else 10 * n) if n > 1 else 0
        while tries > 0:
            m = min(tries, n // 2)
            tries -= m
            at = rng.permutation(n)[: 2 * m].reshape(m, 2)
            one, two = ends[at[:, 0]], ends[at[:, 1]]
            two = np.where((rng.random(m) < 0.5)[:, None], two[:, ::-1], two)
            new = np.stack((one[:, [0]], two[:, [1]], one[:, [1]], two[:, [0]]), 1).reshape(m, 2, 2)
            have = np.sort(key(ends))
            made = np.stack((key(new[:, 0]), key(new[:, 1])), 1)
            found = have[np.minimum(np.searchsorted(have, made), n - 1)] == made
            use = (one[:, 0] != two[:, 0]) & (one[:, 0] != two[:, 1]) & (one[:, 1] != two[:, 0]) & (one[:, 1] != two[:, 1]) & ~found.any(1)
            at, new, made = at[use], new[use], made[use]
            _, back, times = np.unique(made, return_inverse=True, return_counts=True)
            use = (times[back.reshape(made.shape)] == 1).all(1)
            ends[at[use, 0]], ends[at[use, 1]] = new[use, 0], new[use, 1]
        both = np.concatenate((ends, ends[:, ::-1]))
        return pd.DataFrame({"a_id": names[both[:, 0]], "b_id": names[both[:, 1]]})

    return once.groupBy().applyInPandas(run, f"a_id {kind}, b_id {kind}")
