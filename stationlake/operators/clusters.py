"""Density, spectral and profile clusters of stations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans, PowerIterationClustering
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import EARTH_M
from ..plans.components import components, stored
from ..plans.rewrites import range_join
from . import graph
from .kernels import neighbour_numbers

ROWS = 1000  # courses whose tables of steps are filled at once


def cluster_density(info: DataFrame, *, eps_m: float = 300, min_points: int = 3) -> DataFrame:
    """station_id, cluster: DBSCAN. Cores within eps_m of each other share a cluster, named by its smallest core; other
    stations near a core take the nearest core's cluster (ties: the smaller core); the rest, and stations without a place, are
    noise (NULL). Places are joined, not stations, so many stations at one place cost one row."""
    pts = stored(info.where("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.count("*").alias("n"), F.min("station_id").alias("id")))
    pairs = stored(range_join(pts, pts, eps_m).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "b_n", "distance_m"))  # a place goes by its smallest station
    ids = stored(pairs.groupBy(F.col("a").alias("id")).agg(F.sum("b_n").alias("n")).where(F.col("n") >= min_points).select("id"))
    pairs = pairs.join(ids, F.col("b") == F.col("id"), "left_semi")
    found = components(ids, pairs.join(ids, F.col("a") == F.col("id"), "left_semi"))
    near = pairs.groupBy("a").agg(F.min_by("b", F.struct("distance_m", "b")).alias("core"))
    own = near.join(found, F.col("core") == F.col("id")).select("a", F.col("component").alias("cluster"))
    own = pts.join(own, F.col("id") == F.col("a")).select("lat", "lon", "cluster")
    return info.select("station_id", "lat", "lon").join(own, ["lat", "lon"], "left").select("station_id", "cluster")


def cluster_spectral(info: DataFrame, *, k: int, n_neighbors: int = 10, max_iter: int = 40) -> DataFrame:
    """station_id, cluster: power iteration over the nearest-neighbour graph. Stations without a place have no row."""
    edges = graph.knn_adjacency(info, k=n_neighbors)
    ids = info.where("lat is not null and lon is not null").select("station_id").distinct().withColumn("n", F.xxhash64("station_id"))
    e = edges.where("a_id < b_id").select(F.xxhash64("a_id").alias("src"), F.xxhash64("b_id").alias("dst"), "weight")
    got = PowerIterationClustering(k=k, maxIter=max_iter, initMode="degree", srcCol="src", dstCol="dst", weightCol="weight").assignClusters(e)
    return ids.join(got, F.col("n") == F.col("id")).select("station_id", "cluster")


def cluster_profiles(profiles: DataFrame, *, k: int | None = None, method: str = "kmeans", normalize: bool = True, k_range: tuple[int, int] = (2, 8), seed: int = 42) -> DataFrame:
    """profiles (columns h00 and so on, or wd_h00, we_h00) with `cluster`, and `confidence` for "gmm"; "dtw" is k-means by
    dynamic time warping, around means along the ways of steps. Rows are scaled to mean 0 and deviation 1; a flat one becomes
    zeros. Without k the silhouette decides among k_range (for "dtw" that of distances from centres)."""
    if method not in ("kmeans", "gmm", "dtw"):
        raise ValueError(f"unknown method {method!r}")
    hours = [c for c in profiles.columns if c.removeprefix("wd_").removeprefix("we_")[:1] == "h" and c[-2:].isdigit()]
    row = F.array(*hours)
    mean = F.aggregate(row, F.lit(0.0), lambda a, x: a + x) / len(hours)
    src = profiles.withColumn("__m", mean).withColumn("__s", F.sqrt(F.aggregate(row, F.lit(0.0), lambda a, x: a + F.pow(x - F.col("__m"), 2)) / len(hours)))
    cols = {f"__{h}": F.coalesce((F.col(h) - F.col("__m")) / F.nullif("__s", F.lit(0.0)), F.lit(0.0)) if normalize else F.col(h) for h in hours}
    if method == "dtw":
        return warped_clusters(src.withColumns(cols).drop("__m", "__s"), list(cols), k, k_range, seed)
    data = VectorAssembler(inputCols=list(cols), outputCol="__x").transform(src.withColumns(cols)).drop("__m", "__s", *cols).persist()
    try:
        n = data.limit(k_range[1] + 1).count()
        if n < 2:
            out = data.withColumn("cluster", F.lit(0))
            return (out.withColumn("confidence", F.lit(1.0)) if method == "gmm" else out).drop("__x")
        make = (lambda c: GaussianMixture(k=c, seed=seed, featuresCol="__x", predictionCol="cluster", probabilityCol="__p")) if method == "gmm" else (lambda c: KMeans(k=c, seed=seed, featuresCol="__x", predictionCol="cluster"))
        judge = ClusteringEvaluator(featuresCol="__x", predictionCol="cluster")
        best = None
        for c in [min(k, n)] if k else range(k_range[0], min(k_range[1], n - 1) + 1):
            model = make(c).fit(data)
            got = model.transform(data)
            score = 0.0 if k or got.select("cluster").distinct().count() < 2 else judge.evaluate(got)
            if best is None or score > best[0]:
                best = score, model
        out = (best[1] if best else make(2).fit(data)).transform(data)
    finally:
        data.unpersist()
    if method == "gmm":
        out = out.withColumn("confidence", F.array_max(vector_to_array("__p"))).drop("__p")
    return out.drop("__x")


def cluster_sizes(clustered: DataFrame) -> DataFrame:
    """Clusters by size, the largest first in `rank`; ties by name."""
    n = clustered.where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "cluster")))


def warped(x: np.ndarray) -> np.ndarray:
    """All pairs' dynamic-time-warping distances of equally long rows; the table of steps is filled for many pairs at once."""
    n, m = x.shape
    d = np.zeros((n, n))
    size = max(1, 200_000 // max(1, n))
    for lo in range(0, n, size):
        a, b = x[lo : lo + size], x[lo:]
        before = np.full((m + 1, len(a), len(b)), np.inf)
        before[0] = 0
        for i in range(m):
            now = np.full((m + 1, len(a), len(b)), np.inf)
            for j in range(m):
                now[j + 1] = (a[:, i, None] - b[None, :, j]) ** 2 + np.minimum(np.minimum(before[j], before[j + 1]), now[j])
            before = now
        d[lo : lo + size, lo:] = np.sqrt(before[m])
        d[lo:, lo : lo + size] = d[lo : lo + size, lo:].T
    return d


def medoids(d: np.ndarray, k: int, rounds: int = 50, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Labels around k medoids, chosen one by one where they help most and then moved, and the total distance; a row counts
    weight times."""
    weight = np.ones(len(d)) if weight is None else weight
    chosen = [int((weight @ d).argmin())]
    while len(chosen) < k:
        near = d[:, chosen].min(1)
        gain = sum(weight[lo : lo + 500] @ np.maximum(near[lo : lo + 500, None] - d[lo : lo + 500], 0) for lo in range(0, len(d), 500))
        gain[chosen] = -1
        chosen.append(int(gain.argmax()))
    for _ in range(rounds):
        label = d[:, chosen].argmin(1)
        label[chosen] = np.arange(k)
        moved = [int(own[(weight[own] @ d[np.ix_(own, own)]).argmin()]) for own in (np.flatnonzero(label == c) for c in range(k))]
        if moved == chosen:
            break
        chosen = moved
    label = d[:, chosen].argmin(1)
    label[chosen] = np.arange(k)
    return label, float(weight @ d[np.arange(len(d)), np.array(chosen)[label]])


def silhouette(d: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None) -> float:
    weight = np.ones(len(d)) if weight is None else weight
    groups = np.unique(label)
    if len(groups) < 2:
        return -1.0
    total = np.array([weight[label == g].sum() for g in groups])
    mean = np.stack([d[:, label == g] @ weight[label == g] for g in groups], 1) / total
    at = np.searchsorted(groups, label)
    size = total[at]
    own = mean[np.arange(len(d)), at] * size / np.maximum(size - 1, 1)
    mean[np.arange(len(d)), at] = np.inf
    other = mean.min(1)
    return float(np.average(np.where(size > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0), weights=weight))


def _steps(x: np.ndarray, c: np.ndarray, keep: bool = False) -> np.ndarray | list[np.ndarray]:
    """Squared warping distances of the rows of x from one course c, by antidiagonals of the table of steps; keep: all of them,
    each as (position in x + 1, row), for the ways back."""
    m, xt = x.shape[1], np.ascontiguousarray(x.T)
    before, last, held = np.full((m + 1, len(x)), np.inf), np.full((m + 1, len(x)), np.inf), []
    before[0] = 0  # the corner
    for s in range(2 * m - 1):
        lo, hi = max(0, s - m + 1), min(s, m - 1) + 1  # positions in x; those in c fall
        now = np.full((m + 1, len(x)), np.inf)
        cost = xt[lo:hi] - c[s - np.arange(lo, hi)][:, None]
        now[lo + 1 : hi + 1] = cost * cost + np.minimum(np.minimum(last[lo + 1 : hi + 1], last[lo:hi]), before[lo:hi])
        before, last = last, now
        if keep:
            held.append(now)
    return held if keep else last[m]


def _pulled(x: np.ndarray, weight: np.ndarray, c: np.ndarray) -> np.ndarray:
    """What the rows of x, along their ways of steps to c, put at each place of c: sums and weights."""
    m, row = x.shape[1], np.arange(len(x))
    d, i, j, out = _steps(x, c, True), np.full(len(x), m - 1), np.full(len(x), m - 1), np.zeros((2, m))
    d = np.stack([np.full_like(d[0], np.inf), *d])  # at 0 what lies before the first
    while len(row):
        w = weight[row]
        out += np.bincount(j, w * x[row, i], m), np.bincount(j, w, m)
        on = (i > 0) | (j > 0)
        row, i, j = row[on], i[on], j[on]
        s = i + j + 1
        both, own, other = d[s - 2, i, row], d[s - 1, i, row], d[s - 1, i + 1, row]
        both, own, other = np.where((i > 0) & (j > 0), both, np.inf), np.where(i > 0, own, np.inf), np.where(j > 0, other, np.inf)
        slant = (both <= own) & (both <= other)
        up = ~slant & (own <= other)
        i, j = i - (slant | up), j - (slant | ~up)
    return out


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([_steps(x, c) for c in centres], 1)


def _courses(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for lo in range(0, len(pdf), ROWS):
        part = pdf.iloc[lo : lo + ROWS]
        yield np.stack(part["x"].to_numpy()), part["n"].to_numpy(float)


def _seeds(courses: DataFrame, k: int, seed: int) -> np.ndarray:
    """k-means++ with the best of some candidates: a course is drawn by its weight and squared distance from the centres drawn
    so far; the draw hangs on the course and the seed, so not on where a row lies."""
    centres: list[np.ndarray] = []
    some = 2 + int(np.log(k))
    for step in range(k):
        held = np.array(centres)

        def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = pd.DataFrame({"x": pd.Series(dtype=object), "key": pd.Series(dtype=float)})
            for pdf in batches:
                for x, n in _courses(pdf):
                    far = n * (_distances(x, held).min(1) if len(held) else 1)
                    u = (pd.util.hash_array(np.array([r.tobytes() for r in x], object), hash_key=f"{seed % 10**6:06d}{step:010d}", categorize=False) / 2.0**64).clip(1e-300, 1 - 1e-16)
                    on = far > 0
                    best = pd.concat((best, pd.DataFrame({"x": list(x[on]), "key": -np.log(u[on]) / far[on]}))).nsmallest(some, "key")
            yield best

        found = courses.mapInPandas(drawn, "x array<double>, key double").orderBy("key", "x").limit(some).collect()
        if not found:  # all courses lie on centres
            break
        rival = np.array([r.x for r in found])

        def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(rival))
            for pdf in batches:
                for x, n in _courses(pdf):
                    d = _distances(x, rival)
                    total += n @ (np.minimum(d, _distances(x, held).min(1)[:, None]) if len(held) else d)
            yield pd.DataFrame({"t": [total]})

        total = np.sum([r.t for r in courses.mapInPandas(left, "t array<double>").collect()], axis=0)
        centres.append(rival[total.argmin()])
    return np.array(centres)


def _barycentres(courses: DataFrame, k: int, seed: int, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Centres of k clusters, each the mean of its courses along their ways of steps to it, and the silhouette by the distances
    from the own and the next centre. They come in order of their total distance from all courses."""
    centres = _seeds(courses, k, seed)
    before = np.inf
    while True:

        def moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out, inner = np.zeros((len(centres), 2, centres.shape[1])), np.zeros(3 + len(centres))
            for pdf in batches:
                for x, n in _courses(pdf):
                    d = _distances(x, centres)
                    label = d.argmin(1)
                    for c in np.unique(label):
                        out[c] += _pulled(x[label == c], n[label == c], centres[c])
                    a, b = np.sqrt(np.partition(d, 1, axis=1)[:, :2].T) if len(centres) > 1 else (np.zeros(len(x)),) * 2
                    inner += n @ d.min(1), n @ ((b - a) / np.maximum(b, 1e-300)), n.sum(), *(n @ np.sqrt(d))
            yield pd.DataFrame({"s": [np.concatenate((out.ravel(), inner))]})

        s = np.sum([r.s for r in courses.mapInPandas(moved, "s array<double>").collect()], axis=0)
        out, (cost, score, n, *total) = s[: centres.size * 2].reshape(len(centres), 2, -1), s[centres.size * 2 :]
        if cost >= before * (1 - 1e-6) or rounds == 0:
            return centres[np.argsort(total, kind="stable")], score / n
        before, rounds = cost, rounds - 1
        centres = np.where(out[:, 1] > 0, out[:, 0] / np.maximum(out[:, 1], 1e-300), centres)  # one without courses stays


def warped_clusters(scaled: DataFrame, columns: list[str], k: int | None, k_range: tuple[int, int], seed: int) -> DataFrame:
    """k-means under time warping: tasks see each course with the centres only, so neither pairs nor all courses meet in one."""
    out = scaled.drop(*columns)
    names = list(out.columns)
    courses = stored(scaled.groupBy(F.array(*(F.col(c) + F.lit(0.0) for c in columns)).alias("x")).agg(F.count("*").alias("n")))
    most = max(k or k_range[1], k_range[1]) + 1
    n = courses.limit(most).count()
    if n < 2:
        return out.withColumn("cluster", F.lit(0))
    tries = [min(k, n)] if k else range(k_range[0], max(k_range[0], min(k_range[1], n - 1)) + 1)
    centres = max((_barycentres(courses, c, seed) for c in tries if c <= n), key=lambda y: y[1])[0]

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[columns].to_numpy(float) + 0.0
            found = [_distances(x[lo : lo + ROWS], centres).argmin(1) for lo in range(0, len(x), ROWS)]
            yield pdf[names].assign(cluster=np.concatenate(found or [np.zeros(0, int)]).astype("int32"))

    return scaled.mapInPandas(label, T.StructType([*out.schema.fields, T.StructField("cluster", T.IntegerType())]))


def _span(xyz: np.ndarray, core: np.ndarray) -> list[tuple[float, int, int]]:
    """Minimum spanning tree by mutual reachability in metres, a point at a time; nothing is held for pairs."""
    n = len(xyz)
    left, best, link = np.arange(1, n), np.full(n - 1, np.inf), np.zeros(n - 1, int)
    x, c, edges, at = xyz[1:].T.copy(), core[1:].copy(), [], 0
    while len(left):
        dx, dy, dz = x[0] - xyz[at, 0], x[1] - xyz[at, 1], x[2] - xyz[at, 2]
        reach = np.maximum(np.maximum(dx * dx + dy * dy + dz * dz, c), core[at])
        closer = reach < best
        best[closer], link[closer] = reach[closer], at
        i = int(best.argmin())
        at = int(left[i])
        edges.append((float(2 * EARTH_M * np.arcsin(min(1.0, np.sqrt(best[i]) / 2))), int(link[i]), at))
        last = len(left) - 1  # the last takes the place of the one that joined
        if i != last:
            left[i], best[i], link[i], c[i], x[:, i] = left[last], best[last], link[last], c[last], x[:, last]
        left, best, link, c, x = left[:last], best[:last], link[:last], c[:last], x[:, :last]
    return edges


def hierarchy_labels(lat: np.ndarray, lon: np.ndarray, least: int) -> np.ndarray:
    """Density hierarchy clusters of places, -1: noise. Points join in order of mutual reachability (the larger of both
    distances to the `least`-th nearest, oneself counted, and of their own); of the tree of groups with `least` points or
    more, those that last longest are chosen, the whole not among them."""
    n = len(lat)
    if n < max(2, least):
        return np.full(n, -1)
    la, lo = np.radians(lat), np.radians(lon)
    xyz = np.stack((np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)), 1)
    core = np.zeros(n) if least < 2 else ((xyz - xyz[neighbour_numbers(lat, lon, least - 1)[:, -1]]) ** 2).sum(1)
    edges = _span(xyz, core)
    # Tree of joins: node n + i comes from the i-th shortest edge.
    top, kids, high, size = list(range(n)), {}, {}, [1] * n

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for w, a, b in sorted(edges):
        a, b = root(a), root(b)
        new = len(top)
        top.append(new)
        top[a] = top[b] = new
        kids[new], high[new] = (a, b), 1 / max(w, 1e-9)
        size.append(size[a] + size[b])

    def leaves(x: int) -> list[int]:
        out, todo = [], [x]
        while todo:
            y = todo.pop()
            if y < n:
                out.append(y)
            else:
                todo += kids[y]
        return out

    # Groups: born where a parent splits into two that are large enough; points that leave count until they do.
    born, lasting, inner, points = [0.0], [0.0], [[]], [[]]
    todo = [(len(top) - 1, 0)]
    while todo:
        node, group = todo.pop()
        while node >= n:
            a, b = kids[node]
            density = high[node]
            if size[a] >= least and size[b] >= least:
                lasting[group] += (density - born[group]) * size[node]
                for child in (a, b):
                    born.append(density)
                    lasting.append(0.0)
                    inner.append([])
                    points.append([])
                    inner[group].append(len(born) - 1)
                    todo.append((child, len(born) - 1))
                break
            for child in (a, b):
                if size[child] < least:
                    gone = leaves(child)
                    points[group] += gone
                    lasting[group] += (density - born[group]) * len(gone)
            big = [c for c in (a, b) if size[c] >= least]
            if not big:
                break
            node = big[0]
    chosen = [True] * len(born)
    for g in range(len(born) - 1, -1, -1):  # children have larger numbers
        below = sum(lasting[c] for c in inner[g])
        if inner[g] and (below > lasting[g] or g == 0):
            chosen[g] = False
            lasting[g] = below
    chosen[0] = False
    label, number = np.full(n, -1), 0
    todo_groups = [(0, -1)]
    while todo_groups:
        g, own = todo_groups.pop()
        if own < 0 and chosen[g]:
            own, number = number, number + 1
        label[points[g]] = own
        todo_groups += [(c, own) for c in inner[g]]
    return label


def cluster_hierarchy(info: DataFrame, *, min_cluster_size: int = 3, by: tuple[str, ...] = ("system_id",)) -> DataFrame:
    """(by, station_id, cluster): density hierarchy clusters of each inventory, a task each, which holds its places, not their pairs;
    -1: noise, and stations without a place. Numbers follow the stations' order."""
    kinds = "".join(f"`{c}` {info.schema[c].dataType.simpleString()}, " for c in by)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("station_id", ignore_index=True)
        at = np.flatnonzero(pdf[["lat", "lon"]].notna().all(axis=1))
        found = hierarchy_labels(pdf["lat"].to_numpy(float)[at], pdf["lon"].to_numpy(float)[at], min_cluster_size)
        order = {c: i for i, c in enumerate(dict.fromkeys(x for x in found.tolist() if x >= 0))}
        label = np.full(len(pdf), -1)
        label[at] = [order.get(x, -1) for x in found.tolist()]
        return pd.DataFrame({**dict(zip(by, key)), "station_id": pdf["station_id"], "cluster": label})

    return info.select(*by, "station_id", "lat", "lon").groupBy(*by).applyInPandas(run, f"{kinds}station_id string, cluster int")
