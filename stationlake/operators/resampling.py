"""Series statistics and transport that need a kernel per group; one group's series fits in memory."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import EARTH_M
from ..plans.components import stored

SHARDS, SNAPSHOT_TASKS = 64, 200


def _series(pdf: pd.DataFrame, value: str, order: str) -> np.ndarray:
    x = pd.to_numeric(pdf.sort_values([order, value], kind="stable")[value], errors="coerce").to_numpy("float64")
    return x[np.isfinite(x)]


def sample_size(x: np.ndarray) -> float:
    """n over 1 + 2 x the sum of autocorrelations up to the first that isn't positive, within 1..n."""
    n = len(x)
    d = x - x.mean() if n else x
    power = float(d @ d)
    if n < 2 or power == 0:
        return float(n)
    width = 1 << (2 * n - 1).bit_length()
    acf = np.fft.irfft(np.abs(np.fft.rfft(d, width)) ** 2, width)[1:n] / power
    stop = np.flatnonzero(acf <= 1e-14)
    total = float(acf[: stop[0] if len(stop) else n].sum())
    return min(max(n / (1 + 2 * total), 1.0), float(n))


def effective_sample_size(df: DataFrame, value: str, *, by: tuple[str, ...] = ("system_id", "station_id"), order: str = "fetched_at") -> DataFrame:
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _series(pdf, value, order)
        return pd.DataFrame([[*key, len(x), sample_size(x)]], columns=[*by, "n", "ess"])

    return df.select(*by, order, value).groupBy(*by).applyInPandas(run, f"{kinds}, n long, ess double")


def block_bootstrap(df: DataFrame, value: str, *, statistic: Callable[[np.ndarray], float] = np.mean, block_size: int | None = None, n_boot: int = 2000, alpha: float = 0.05, seed: int = 42, by: tuple[str, ...] = ("system_id", "station_id"), order: str = "fetched_at") -> DataFrame:
    """estimate, ci_lo, ci_hi per group, by moving blocks (cube root of n long unless given); NULL for no values."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _series(pdf, value, order)
        n, row = len(x), [None, None, None]
        if n:
            size = min(block_size or max(1, round(n ** (1 / 3))), n)
            rng, offsets = np.random.default_rng(seed), np.arange(size)
            draws = [float(statistic(x[(rng.integers(0, n - size + 1, size=math.ceil(n / size))[:, None] + offsets).reshape(-1)[:n]])) for _ in range(n_boot)]
            row = [float(statistic(x)), *np.percentile(draws, [50 * alpha, 100 - 50 * alpha]).tolist()]
        return pd.DataFrame([[*key, *row]], columns=[*by, "estimate", "ci_lo", "ci_hi"]).astype({c: "float64" for c in ("estimate", "ci_lo", "ci_hi")})

    return df.select(*by, order, value).groupBy(*by).applyInPandas(run, f"{kinds}, estimate double, ci_lo double, ci_hi double")


def _prices(cost: np.ndarray, supply: np.ndarray, demand: np.ndarray) -> np.ndarray:
    """Prices of the rows at which the cheapest rows come near to their supply: smoothed transport, less and less smooth."""
    u, v = np.zeros(len(supply)), cost.min(0)
    heat = float(cost.mean()) / 4
    for _ in range(10):
        with np.errstate(all="ignore"):
            k = np.exp((u[:, None] + v - cost) / heat)
            w = np.ones(len(demand))
            for _ in range(40):
                z = supply / np.maximum(k @ w, 1e-200)
                w = demand / np.maximum(z @ k, 1e-200)
            more, by = u + heat * np.log(z), v + heat * np.log(w)
        if not (np.isfinite(more).all() and np.isfinite(by).all()):
            break
        u, v, heat = more, by, heat / 2
    return u


def transport_cost(cost: np.ndarray, supply: np.ndarray, demand: np.ndarray) -> float:
    """Least cost of moving supply to demand (equal sums). All of the longer side starts at its cheapest partner; what is
    too much there moves on along shortest paths between partners, to all that lack something before paths are found anew."""
    if len(supply) > len(demand):
        cost, supply, demand = cost.T, demand, supply
    m, n = cost.shape
    if not m:
        return 0.0
    flow, over = np.zeros((m, n)), -supply.astype(float)
    price = _prices(cost, supply, demand)
    real, cost = cost, cost - price[:, None]  # any prices leave the best flow as it is
    near = cost.argmin(0)
    flow[near, np.arange(n)] = demand
    over += flow.sum(1)
    eps, slack = 1e-12 * max(float(supply.sum()), 1e-300), 1e-11 * max(float(np.abs(cost).max()), 1e-300)
    step, item, stale = np.full((m, m), np.inf), np.zeros((m, m), int), set(range(m))
    while over.max() > eps and over.min() < -eps:
        for i in stale:  # what it costs to move the best of i's items to each other partner
            own = np.flatnonzero(flow[i])
            step[i] = np.inf
            if len(own):
                more = cost[:, own] - cost[i, own]
                at = more.argmin(1)
                step[i], item[i] = more[np.arange(m), at], own[at]
                step[i, i] = np.inf
        away, back = np.where(over > eps, 0.0, np.inf), np.full(m, -1)
        moved = np.flatnonzero(over > eps)
        for _ in range(m):
            via = away[moved, None] + step[moved]
            at = via.argmin(0)
            via = via[at, np.arange(m)]
            closer = np.flatnonzero(via < away - slack)
            if not len(closer):
                break
            away[closer], back[closer], moved = via[closer], moved[at[closer]], closer
        lack, stale = np.flatnonzero(over < -eps), set()
        for k in lack[np.argsort(away[lack], kind="stable")]:
            path, at = [], int(k)
            while back[at] >= 0 and len(path) <= m:
                path.append((int(back[at]), at, item[back[at], at]))
                at = int(back[at])
            amount = min([over[at], -over[k], *(flow[i, j] for i, _, j in path)])
            if amount <= 0 or not path:
                continue
            for i, o, j in path:
                flow[i, j] -= amount
                flow[o, j] += amount
                if flow[i, j] < 1e-3 * eps:
                    flow[i, j] = 0
                stale |= {i, o}
            over[at] -= amount
            over[k] += amount
        if not stale:
            break
    return float((flow * real).sum())


def rebalancing_tension(panel: DataFrame, *, target: DataFrame | None = None, value: str = "num_bikes_available", time: str = "fetched_at", by: tuple[str, ...] = ("system_id",)) -> DataFrame:
    """bike_km per snapshot: least bike-kilometres that bring the fleet to the target's proportions (station_id, target; by
    default each station's mean). Stations at one place count as one. NULL without bikes; no rows where no two stations have a place or the target is empty."""
    place = panel.groupBy(*by, "station_id").agg(F.min_by("lat", time).alias("lat"), F.min_by("lon", time).alias("lon"), F.avg(value).alias("target")).where("lat is not null and lon is not null")
    if target is not None:
        place = place.drop("target").join(target.select(*(c for c in by if c in target.columns), "station_id", "target"), [*(c for c in by if c in target.columns), "station_id"], "left")
    w = Window.partitionBy(*by)
    place = place.withColumn("target", F.coalesce("target", F.lit(0.0)))
    place = place.withColumns({"__all": F.sum("target").over(w), "__n": F.count("*").over(w), "__c": F.cos(F.radians(F.avg("lat").over(w)))}).where("__n >= 2 and __all > 0")
    place = stored(place.select(*by, "station_id", "lat", "lon", (F.radians("lon") * EARTH_M * F.col("__c")).alias("x"), (F.radians("lat") * EARTH_M).alias("y"), (F.col("target") / F.col("__all")).alias("target")))
    now = panel.groupBy(*by, time, "station_id").agg(F.sum(value).alias("bikes"))
    spots = place.groupBy(*by, "lat", "lon").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.sum("target").alias("target"))  # moves within a place cost nothing
    held = now.join(place.select(*by, "station_id", "lat", "lon"), [*by, "station_id"]).groupBy(*by, time, "lat", "lon").agg(F.sum("bikes").alias("bikes"))
    shards = F.sequence(F.lit(0), F.lit(SHARDS - 1))  # places of a system meet its snapshots in shards, so no key is hot
    spots = spots.withColumn("__b", F.pmod(F.hash("lat", "lon"), F.lit(SHARDS)))
    grid = now.select(*by, time).distinct().withColumn("__b", F.explode(shards)).join(spots, [*by, "__b"]).drop("__b")
    full = grid.join(held, [*by, time, "lat", "lon"], "left").withColumn("bikes", F.coalesce(F.col("bikes").cast("double"), F.lit(0.0))).select(*by, time, "x", "y", "target", "bikes")
    kinds = ", ".join(f"`{c}` {full.schema[c].dataType.simpleString()}" for c in (*by, time))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total, out = float(pdf["bikes"].sum()), None
        if total > 0:
            gap = pdf["bikes"].to_numpy() / total - pdf["target"].to_numpy()
            x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
            a, b = np.flatnonzero(gap > 1e-15), np.flatnonzero(gap < -1e-15)
            out = transport_cost(np.hypot(x[a][:, None] - x[b], y[a][:, None] - y[b]), gap[a], -gap[b]) * total / 1000
        return pd.DataFrame([[*key, out]], columns=[*by, time, "bike_km"]).astype({"bike_km": "float64"})

    return full.repartition(SNAPSHOT_TASKS, *by, time).groupBy(*by, time).applyInPandas(run, f"{kinds}, bike_km double")
