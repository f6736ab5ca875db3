"""Station graphs as edge lists, and signals on them. Only the eigenbasis needs one task; its size is checked."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.components import stored
from ..plans.ranks import ranked_whole
from ..plans.rewrites import knn

MAX_NODES = 4000  # of a dense eigenproblem


def knn_adjacency(info: DataFrame, *, k: int = 10, gaussian: bool = True) -> DataFrame:
    """(a_id, b_id, weight) in both directions: Gaussian of the distance, as wide as the median over all neighbour pairs."""
    near = stored(knn(info, info, k, "station_id", "station_id").select("a_id", "b_id", "distance_m"))
    sigma = near.agg(F.percentile("distance_m", F.lit(0.5)).alias("s")).select(F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s"))
    w = F.exp(-F.pow("distance_m", F.lit(2)) / (2 * F.pow("s", F.lit(2)))) if gaussian else F.lit(1.0)
    one = near.join(F.broadcast(sigma)).select("a_id", "b_id", w.alias("weight"))  # sigma is one row
    return one.union(one.select("b_id", "a_id", "weight")).groupBy("a_id", "b_id").agg(F.max("weight").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("a_id").alias("id")).agg(F.sum("weight").alias("degree"))


def normalized_laplacian(edges: DataFrame) -> DataFrame:
    """(a_id, b_id, value): 1 on the diagonal, -w / sqrt(d_a d_b) beside it."""
    d = degrees(edges)
    off = edges.join(d.toDF("a_id", "da"), "a_id").join(d.toDF("b_id", "db"), "b_id")
    scale = F.sqrt(F.greatest("da", F.lit(1e-12)) * F.greatest("db", F.lit(1e-12)))
    return off.select("a_id", "b_id", (-F.col("weight") / scale).alias("value")).union(d.select("id", F.col("id").alias("b"), F.lit(1.0)))


def _basis(laplacian: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids and eigenvectors by rising eigenvalue; the largest component of a vector is positive."""
    ids, at = np.unique(laplacian["a_id"].to_numpy(), return_inverse=True)
    if len(ids) > MAX_NODES:
        raise ValueError(f"{len(ids)} nodes; a dense basis takes {MAX_NODES} at most")
    m = np.zeros((len(ids), len(ids)))
    m[at, np.searchsorted(ids, laplacian["b_id"].to_numpy())] = laplacian["value"]
    v = np.linalg.eigh((m + m.T) / 2)[1]
    return ids, v * np.where(v[np.abs(v).argmax(0), np.arange(len(ids))] < 0, -1.0, 1.0)


def _parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of n nodes reaches; labels of labels halve the way each round."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _smoothest(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The `many` lowest eigenpairs of one large part, without a dense matrix: subspace iteration, each round of which damps
    what lies above the subspace by a Chebyshev polynomial, until residuals fall under 1e-9."""
    order = np.argsort(a, kind="stable")
    a, b, w = a[order], b[order], w[order]
    starts = np.flatnonzero(np.r_[True, np.diff(a) > 0])
    rows = a[starts]

    def times(x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        out[rows] = np.add.reduceat(w[:, None] * x[b], starts, axis=0)
        return out

    x = np.linalg.qr(np.random.default_rng(0).normal(size=(n, many + 8)))[0]
    for _ in range(500):
        y = times(x)
        values, turn = np.linalg.eigh(x.T @ y)
        x, y = x @ turn, y @ turn
        if np.abs(y - x * values).max(axis=0)[:many].max() < 1e-9:
            return values[:many], x[:, :many]
        low = max(float(values[-1]), 1e-7)  # eigenvalues lie within 0 .. 2
        half, mid = (2 - low) / 2, (2 + low) / 2
        before, now = x, (times(x) - mid * x) / half
        for _ in range(60):
            before, now = now, 2 * (times(now) - mid * now) / half - before
            scale = np.abs(now).max(axis=0)
            before, now = before / scale, now / scale
        x = np.linalg.qr(now)[0]
    raise ValueError("the smoothest components of a graph did not settle")


def _low(laplacian: pd.DataFrame, many: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Sorted ids and the `many` lowest eigenvectors, each as numbers of nodes and values. Parts that no edge joins are solved
    for themselves; equal eigenvalues (0 of each part) go by the part's smallest id."""
    at, ids = pd.factorize(pd.concat((laplacian["a_id"], laplacian["b_id"]), ignore_index=True), sort=True)
    a, b, w = at[: len(laplacian)], at[len(laplacian) :], laplacian["value"].to_numpy(float)
    label = _parts(len(ids), a, b)
    nodes, edges = np.argsort(label, kind="stable"), np.argsort(label[a], kind="stable")
    tops, first = np.unique(label[nodes], return_index=True)
    cut_n, cut_e = np.r_[first, len(nodes)], np.searchsorted(label[a][edges], np.r_[tops, len(ids)])
    found: list = []
    for p in range(len(tops)):
        own, e = nodes[cut_n[p] : cut_n[p + 1]], edges[cut_e[p] : cut_e[p + 1]]
        i, j = np.searchsorted(own, a[e]), np.searchsorted(own, b[e])
        if len(own) <= MAX_NODES:
            m = np.zeros((len(own), len(own)))
            np.add.at(m, (i, j), w[e])
            values, v = np.linalg.eigh((m + m.T) / 2)
        else:
            values, v = _smoothest(len(own), i, j, w[e], many)
        found += [(round(float(values[c]), 9) + 0.0, p, c, own, v[:, c]) for c in range(min(many, len(own)))]
        if len(found) > 4096:
            found = sorted(found, key=lambda f: f[:3])[:many]
    out = sorted(found, key=lambda f: f[:3])[:many]
    return np.asarray(ids, object), [(own, v * (-1.0 if v[np.abs(v).argmax()] < 0 else 1.0)) for *_, own, v in out]


def low_freq_basis(laplacian: DataFrame, d: int) -> DataFrame:
    """(id, component, value): the d smoothest eigenvectors but the first, the trivial one, components from 1. Parts of more
    than MAX_NODES nodes are solved without a dense matrix; one task holds the edges."""
    kind = laplacian.schema["a_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, vectors = _low(pdf, d + 1)
        use = np.zeros((len(ids), max(0, len(vectors) - 1)))
        for c, (own, v) in enumerate(vectors[1:]):
            use[own, c] = v
        n = use.shape[1]
        return pd.DataFrame({"id": np.repeat(ids, n), "component": np.tile(np.arange(1, n + 1), len(ids)), "value": use.reshape(-1)})

    return laplacian.groupBy().applyInPandas(run, f"id {kind}, component int, value double")


def spectral_r2(signal: DataFrame, basis: DataFrame, *, id_col: str = "id", value: str = "y") -> DataFrame:
    """r2: share of the centred signal's square that the basis carries; 0 for a flat one. NULL values count as the mean."""
    mean = signal.agg(F.avg(value).alias("__mean"))
    y = signal.join(F.broadcast(mean)).select(F.col(id_col).alias("id"), F.coalesce(F.col(value) - F.col("__mean"), F.lit(0.0)).alias("y"))  # one row
    total = y.agg(F.sum(F.pow("y", F.lit(2))).alias("total"))
    c = basis.join(y, "id").groupBy("component").agg(F.sum(F.col("value") * F.col("y")).alias("c")).agg(F.coalesce(F.sum(F.pow("c", F.lit(2))), F.lit(0.0)).alias("part"))
    return total.join(F.broadcast(c)).select(F.when(F.col("total") < 1e-12, 0.0).otherwise(F.col("part") / F.col("total")).alias("r2"))  # one row each


def permute_signal(signal: DataFrame, *, value: str = "y", seed: int = 42) -> DataFrame:
    """The same values dealt to other rows: ranks by hash meet ranks by another hash. Ranges of hashes are ranked in parallel."""
    hashed = lambda salt: F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(seed + salt))
    numbered = lambda df, salt: ranked_whole(df.withColumns({"__h": hashed(salt), "__one": F.lit(1)}), ["__h", "id"], "__one").drop("__h", "__one", "__n", "__cum", "__sum")
    a, b = numbered(signal.drop(value), 0), numbered(signal.select("id", value), 1).drop("id")
    return a.join(b, "__i").drop("__i")


def band_limited_signal(laplacian: DataFrame, *, r2_target: float = 0.8, n_low: int = 16, seed: int = 42) -> DataFrame:
    """(id, y): a random signal of mean 0 and variance 1 with the given share in the n_low smoothest components."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, v = _basis(pdf)
        rng, cut = np.random.default_rng(seed), min(n_low, len(ids) - 1) + 1
        parts = [x @ rng.normal(size=x.shape[1]) if x.shape[1] else np.zeros(len(ids)) for x in (v[:, 1:cut], v[:, cut:])]
        low, high = (p / (np.linalg.norm(p) + 1e-12) for p in parts)
        r = min(max(r2_target, 0.0), 1.0)
        y = np.sqrt(r) * low + np.sqrt(1 - r) * high
        return pd.DataFrame({"id": ids, "y": (y - y.mean()) / (y.std() + 1e-12)})

    kind = laplacian.schema["a_id"].dataType.simpleString()
    return laplacian.groupBy().applyInPandas(run, f"id {kind}, y double")
