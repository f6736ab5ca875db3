"""Invented cities: inventories and counts over time, flow simulation that keeps every bike, footprints, calibration, and
writers for archives and learning sets.

Stations of a city without flows don't depend on each other but for a shared shock, which each task draws from the city's
seed; so stations are dealt over tasks. Flows couple all stations at each step, so a city is one task; many cities are many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import EARTH_M, safe_corr
from ..functions.freq import seconds
from ..operators import flow, graph
from ..plans.components import stored

USES = ("residential", "work", "transit", "leisure")
#: Sizes in which docks are built (fixed values).
SIZES = np.array([10, 15, 20, 25, 30, 35, 40, 50, 60, 80])
INFO = "system_id string, station_id string, name string, lat double, lon double, capacity long, station_type string, is_virtual_station boolean, region_id string, land_use string"
STATUS = "system_id string, station_id string, fetched_at timestamp, num_bikes_available long, num_docks_available long, is_renting boolean, is_returning boolean, is_installed boolean, last_reported timestamp, gbfs_version string"


@dataclass(frozen=True)
class City:
    """What shapes a city without flows. lowfreq: share of the demand's spatial energy in the smoothest `modes` waves across
    the city, instead of the mosaic of land uses."""

    system_id: str = "synthetic"
    n_stations: int = 300
    days: int = 14
    freq: str = "1h"
    start: str = "2026-06-01"
    center: tuple[float, float] = (48.86, 2.35)
    spread_km: float = 4.0
    n_clusters: int = 8
    mix: tuple[float, float, float, float] = (0.45, 0.3, 0.1, 0.15)
    capacity_range: tuple[int, int] = (15, 40)
    base_occupancy: float = 0.5
    amplitude: float = 0.45
    activity_tail: float = 0.5
    elevation: float = 0.12
    common_shock: float = 0.03
    lowfreq: float | None = None
    modes: int = 16
    weekend_factor: float = 0.5
    phase_jitter: float = 1.5
    autocorr: float = 0.8
    noise: float = 0.05
    rebalancing_hour: int | None = 4
    rebalancing_strength: float = 0.5
    weather_days: int = 0
    missing_rate: float = 0.0
    n_frozen: int = 0
    seed: int = 42


def _rng(*seed: int) -> np.random.Generator:
    return np.random.default_rng([s & 0xFFFFFFFF for s in seed])


def _day_shape(use: str, hour: np.ndarray) -> np.ndarray:
    """Swing of the bikes at a place over the day, -1 to 1: homes empty by day, work fills, transit does both at the rush hours,
    leisure fills towards the evening."""
    bump = lambda at, width: np.exp(-(((hour - at + 12) % 24 - 12) ** 2) / (2 * width * width))
    return {"residential": 0.5 * bump(2, 5) - bump(12, 4), "work": bump(12, 4) - 0.5 * bump(2, 5), "transit": 0.9 * bump(18, 1.5) - 0.9 * bump(8, 1.5), "leisure": bump(20, 3) - 0.4 * bump(9, 4)}[use]


def _station(c: City, i: int) -> dict:
    """Everything about one station that doesn't change."""
    rng, city = _rng(c.seed, 1, i), _rng(c.seed, 0)
    hubs = city.normal(0, c.spread_km / 111, (c.n_clusters, 2))
    main = city.choice(4, c.n_clusters, p=np.asarray(c.mix) / sum(c.mix))
    k = int(rng.integers(c.n_clusters))
    y, x = hubs[k] + rng.normal(0, 0.25 * c.spread_km / 111, 2)
    use = USES[2] if rng.random() < 0.05 else USES[int(main[k])] if rng.random() < 0.7 else USES[int(rng.choice(4, p=np.asarray(c.mix) / sum(c.mix)))]
    lo, hi = c.capacity_range
    usual = SIZES[(lo <= SIZES) & (hi >= SIZES)]
    usual = usual if len(usual) > 1 else np.array([lo, hi])
    large = SIZES[hi <= SIZES]
    weight = 1 / np.arange(1, len(usual) + 1) ** 1.2
    capacity = int(rng.choice(large) if use == "transit" and len(large) else rng.choice(usual, p=weight / weight.sum()))
    height = rng.normal()
    base = c.base_occupancy + {"residential": 0.1, "work": -0.1}.get(use, 0.0) - c.elevation * height + rng.normal(0, 0.03)
    # The spatial field is a sum of waves over the city: slow ones with the share asked for, quick ones with the rest.
    waves = _rng(c.seed, 2)
    slow, quick = ((waves.normal(size=(c.modes, 2)) * f, waves.uniform(0, 2 * np.pi, c.modes)) for f in (1.0, 12.0))
    at = np.array([y, x]) * 111 / c.spread_km
    field = 0.0 if c.lowfreq is None else sum(math.sqrt(s * 2 / c.modes) * float(np.cos(f @ at + p).sum()) for s, (f, p) in ((c.lowfreq, slow), (1 - c.lowfreq, quick)))
    return {"id": f"S{i:05d}", "use": use, "cluster": k, "lat": c.center[0] + float(y), "lon": c.center[1] + float(x) / math.cos(math.radians(c.center[0])), "capacity": capacity, "base": min(max(base, 0.15), 0.85), "activity": math.exp(rng.normal(0, c.activity_tail) - c.activity_tail**2 / 2), "load": rng.normal(1, 0.3), "shift": rng.uniform(-c.phase_jitter, c.phase_jitter), "field": field}


def _ar1(rng: np.random.Generator, steps: int, a: float, scale: float) -> np.ndarray:
    """First-order autoregression of the given deviation, from 0 on."""
    out, held = np.empty(steps), 0.0
    for t, e in enumerate(rng.normal(0, scale * math.sqrt(max(0.0, 1 - a * a)), steps)):
        held = a * held + e
        out[t] = held
    return out


def _times(start: str, steps: int, step_s: int) -> np.ndarray:
    first = datetime.fromisoformat(start).replace(tzinfo=timezone.utc)
    return np.array([np.datetime64(int((first + timedelta(seconds=i * step_s)).timestamp()), "s") for i in range(steps)])


def _city_numbers(spark: SparkSession, c: City) -> DataFrame:
    return spark.range(c.n_stations).repartition(max(1, c.n_stations // 200), "id")


def city(spark: SparkSession, c: City | None = None, **knobs) -> tuple[DataFrame, DataFrame]:
    """Inventory and panel of an invented city. Equal settings give equal cities, however tasks are dealt."""
    c = replace(c or City(), **knobs)
    step = seconds(c.freq)
    steps = c.days * 86400 // step

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [_station(c, int(i)) for i in pdf["id"]]
            yield pd.DataFrame([(c.system_id, s["id"], f"Station {s['id']} ({s['use']})", s["lat"], s["lon"], s["capacity"], "docked_bike", False, str(s["cluster"]), s["use"]) for s in rows], columns=[x.split()[0] for x in INFO.split(", ")])

    def series(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        times = _times(c.start, steps, step)
        hour = (times.astype("int64") % 86400) / 3600
        weekend = (times.astype("int64") // 86400 + 3) % 7 >= 5
        day = (times.astype("int64") // 86400) - times.astype("int64")[0] // 86400 if steps else hour
        shared = _ar1(_rng(c.seed, 3), steps, c.autocorr, 1.0)
        bad = _rng(c.seed, 4).choice(c.days, min(c.weather_days, c.days), replace=False)
        weather = np.where(np.isin(day, bad), 0.5, 1.0)
        still = set(_rng(c.seed, 5).choice(c.n_stations, min(c.n_frozen, c.n_stations), replace=False).tolist())
        for pdf in batches:
            for i in pdf["id"].astype(int):
                s, rng = _station(c, i), _rng(c.seed, 6, i)
                if c.lowfreq is None:
                    calm = np.where(weekend, 1.0, 0.3) if s["use"] == "leisure" else np.where(weekend, c.weekend_factor, 1.0)
                    swing = s["activity"] * _day_shape(s["use"], hour - s["shift"]) * calm
                else:
                    swing = s["field"] * _day_shape("transit", hour) * np.where(weekend, c.weekend_factor, 1.0)
                o = s["base"] + c.amplitude * swing * weather + _ar1(rng, steps, c.autocorr, c.noise) + c.common_shock * s["load"] * shared
                if c.rebalancing_hour is not None:
                    o = np.where(np.floor(hour) == c.rebalancing_hour, o + c.rebalancing_strength * (0.5 - o), o)
                bikes = np.rint(np.clip(o, 0, 1) * s["capacity"]).astype("int64")
                if i in still and steps:
                    bikes[:] = bikes[0]
                use = rng.random(steps) >= c.missing_rate
                at = times[use]
                yield pd.DataFrame({"system_id": c.system_id, "station_id": s["id"], "fetched_at": at, "num_bikes_available": bikes[use], "num_docks_available": s["capacity"] - bikes[use], "is_renting": True, "is_returning": True, "is_installed": True, "last_reported": at, "gbfs_version": "2.3"})

    numbers = _city_numbers(spark, c)
    return numbers.mapInPandas(places, INFO), numbers.mapInPandas(series, STATUS)


# --- flows -----------------------------------------------------------------------------------------------------------

ROLES = ("residential", "employment", "hub_heavy", "hub_light")


@dataclass(frozen=True)
class Flows:
    """What drives a simulation of flows; times in minutes, distances in kilometres."""

    system_id: str = "synthetic"
    n_stations: int = 200
    days: int = 14
    freq: str = "1h"
    step_min: int = 15
    start: str = "2026-06-01"
    seed: int = 42
    center: tuple[float, float] = (48.86, 2.35)
    spread_km: float = 4.0
    n_clusters: int = 8
    role_mix: tuple[float, float, float, float] = (0.55, 0.27, 0.10, 0.08)
    trip_rate: float = 12.0
    base_demand: float = 0.6
    mass_tail: float = 1.6
    beta_km: float = 1.5
    max_trip_km: float | None = 5.0
    speed_kmh: float = 15.0
    heavy_period: float = 45.0
    heavy_spike: float = 10.0
    light_period: float = 5.0
    light_spike: float = 1.5
    climb_penalty: float = 1.2  # 0: flat
    rebalancing_hour: int | None = 4
    rebalancing_strength: float = 0.6
    ghost_rate: float = 0.0
    cell_loss: float = 0.0
    station_outages: int = 0
    weather_events: int = 0
    weather_drop: float = 0.1
    weather_len: float = 90.0


FLOW_INFO = "system_id string, station_id string, name string, lat double, lon double, capacity long, role string, altitude double, ghost_bikes long, station_type string, is_virtual_station boolean, region_id string"
FLOW_STATUS = "system_id string, station_id string, fetched_at timestamp, num_bikes_available long, num_bikes_disabled long, num_docks_available long"
MAX_FLOW_STATIONS = 5_000  # of a city that one task simulates


def _geometry(c: Flows, given: pd.DataFrame | None) -> pd.DataFrame:
    rng = _rng(c.seed, 10)
    if given is None:
        hubs = rng.normal(0, c.spread_km / 111, (c.n_clusters, 2))
        k = rng.integers(0, c.n_clusters, c.n_stations)
        xy = hubs[k] + rng.normal(0, 0.25 * c.spread_km / 111, (c.n_stations, 2))
        given = pd.DataFrame({"station_id": [f"S{i:04d}" for i in range(c.n_stations)], "lat": c.center[0] + xy[:, 0], "lon": c.center[1] + xy[:, 1], "capacity": rng.choice([15, 20, 25, 30], c.n_stations), "role": rng.choice(4, c.n_stations, p=np.asarray(c.role_mix) / sum(c.role_mix)), "region_id": k.astype(str)})
    out = given.sort_values("station_id", ignore_index=True)
    out["altitude"] = _rng(c.seed, 11).normal(size=len(out))
    out["ghost"] = np.rint(c.ghost_rate * out["capacity"]).astype(int)
    return out


def _pull(c: Flows, g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How strongly each station draws trips from each other one, and trip times in steps."""
    la, lo = np.radians(g["lat"].to_numpy()), np.radians(g["lon"].to_numpy())
    a = np.sin((la[:, None] - la) / 2) ** 2 + np.cos(la)[:, None] * np.cos(la) * np.sin((lo[:, None] - lo) / 2) ** 2
    km = 2 * EARTH_M / 1000 * np.arcsin(np.sqrt(np.clip(a, 0, 1)))
    z = g["altitude"].to_numpy()
    pull = np.exp(-km / c.beta_km - c.climb_penalty * np.maximum(z - z[:, None], 0))
    pull[(km >= c.max_trip_km) if c.max_trip_km is not None else np.zeros_like(km, bool)] = 0
    np.fill_diagonal(pull, 0)
    return pull, np.maximum(1, np.rint(km / c.speed_kmh * 60 / c.step_min)).astype(int)


def _demand(c: Flows, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Departures and attraction by (role, step), and the hour of each step."""
    minute = np.arange(steps) * c.step_min
    hour = minute % 1440 / 60
    morning, evening = (np.exp(-((hour - h) ** 2) / 12.5) for h in (8, 18))
    beat = lambda period, spike: (minute % period < c.step_min) * spike
    heavy, light = beat(c.heavy_period, c.heavy_spike) * (morning + evening), beat(c.light_period, c.light_spike) * (0.4 + morning + evening)
    wet = np.ones(steps)
    rng, long = _rng(c.seed, 12), max(1, round(c.weather_len / c.step_min))
    for at in rng.integers(0, max(1, steps - long), c.weather_events):
        wet[at : at + long] = c.weather_drop
    return np.stack((morning, evening, heavy + 0.3 * evening, light)) * 1.0 + c.base_demand, np.stack((evening, morning, 0.5 + 0.5 * heavy, 0.4 + light)) + c.base_demand, np.stack((hour, wet))


def run_flows(c: Flows, given: pd.DataFrame | None = None) -> tuple[pd.DataFrame, np.ndarray, dict]:
    """Stations, bikes by (step, station) without ghosts, and figures: trips by pair, bikes lost (none but for rounding)."""
    g = _geometry(c, given)
    n, steps = len(g), c.days * 1440 // c.step_min
    if n > MAX_FLOW_STATIONS:
        raise ValueError(f"{n} stations; a simulated city has {MAX_FLOW_STATIONS} at most")
    pull, lag = _pull(c, g)
    leave, draw, (hour, wet) = _demand(c, steps)
    role = g["role"].to_numpy(int)
    mass = np.exp(_rng(c.seed, 13).normal(0, c.mass_tail, n))
    mass /= mass.mean() if n else 1
    docks = np.maximum(g["capacity"].to_numpy(float) - g["ghost"].to_numpy(), 1)
    bikes = docks / 2
    total, rng, rate = bikes.sum(), _rng(c.seed, 14), c.trip_rate * c.step_min / 60
    ring = np.zeros((int(lag.max(initial=1)) + 1, n))  # bikes under way by the step, modulo its length, at which they arrive
    seen, trips = np.empty((steps, n)), np.zeros((n, n))
    slots = [(k, lag == k) for k in np.unique(lag)]
    for t in range(steps):
        weight = pull * (draw[role, t] * mass)
        wanted = rng.poisson((rate * wet[t] * leave[role, t] * mass)[:, None] * weight / np.maximum(weight.sum(1, keepdims=True), 1e-12)).astype(float)
        asked = wanted.sum(1)
        gone = wanted * np.divide(np.minimum(asked, bikes), asked, out=np.zeros(n), where=asked > 0)[:, None]
        bikes = bikes - gone.sum(1)
        trips += gone
        for k, mask in slots:
            ring[(t + k) % len(ring)] += np.where(mask, gone, 0).sum(0)
        come, room = ring[t % len(ring)].copy(), docks - bikes
        ring[t % len(ring)] = 0
        put = np.minimum(come, room)
        bikes, room, rest = bikes + put, room - put, (come - put).sum()
        if rest > 0 and room.sum() > 0:  # who finds no dock goes where there are some
            share = min(1.0, rest / room.sum())
            bikes = bikes + room * share
            rest -= (room * share).sum()
        ring[(t + 1) % len(ring)] += rest / max(n, 1)  # and tries again if there are none at all
        if c.rebalancing_hour is not None and int(hour[t]) == c.rebalancing_hour:
            off = bikes - docks / 2
            more, less = np.maximum(off, 0), np.maximum(-off, 0)
            if more.sum() > 0 and less.sum() > 0:
                moved = c.rebalancing_strength * min(more.sum(), less.sum())
                bikes = bikes - more / more.sum() * moved + less / less.sum() * moved
        seen[t] = bikes
    return g, seen, {"trips": trips, "lost": float(abs(bikes.sum() + ring.sum() - total) / max(total, 1e-12))}


def _panel(c: Flows, g: pd.DataFrame, seen: np.ndarray) -> pd.DataFrame:
    """What a poller would have seen: whole bikes at the reporting step, gaps where it failed."""
    every = max(1, seconds(c.freq) // (60 * c.step_min))
    shown = np.rint(seen[::every])
    cap = g["capacity"].to_numpy()
    ghost = g["ghost"].to_numpy()
    shown = np.clip(shown, 0, cap - ghost)
    rng, (steps, n) = _rng(c.seed, 15), shown.shape
    keep = rng.random(shown.shape) >= c.cell_loss
    for _ in range(c.station_outages if steps and n else 0):
        at = int(rng.integers(0, max(1, steps - 8)))
        keep[at : at + int(rng.integers(2, 8)), int(rng.integers(n))] = False
    t, s = np.nonzero(keep)
    times = _times(c.start, steps, every * 60 * c.step_min)
    return pd.DataFrame({"system_id": c.system_id, "station_id": g["station_id"].to_numpy()[s], "fetched_at": times[t], "num_bikes_available": shown[t, s].astype("int64"), "num_bikes_disabled": ghost[s].astype("int64"), "num_docks_available": (cap[s] - ghost[s] - shown[t, s]).astype("int64")})


def _knobs(c: Flows) -> dict:
    return asdict(c)


def flows(spark: SparkSession, *cities: Flows) -> tuple[DataFrame, DataFrame]:
    """Inventories and panels of simulated cities, a task each."""
    cities = cities or (Flows(),)
    numbers = spark.range(len(cities)).repartition(len(cities), "id")

    def info(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf["id"]:
                c = cities[i]
                g = _geometry(c, None)
                yield pd.DataFrame({"system_id": c.system_id, "station_id": g["station_id"], "name": [f"Station {s} ({ROLES[r]})" for s, r in zip(g["station_id"], g["role"])], "lat": g["lat"], "lon": g["lon"], "capacity": g["capacity"], "role": [ROLES[r] for r in g["role"]], "altitude": g["altitude"], "ghost_bikes": g["ghost"], "station_type": "docked_bike", "is_virtual_station": False, "region_id": g["region_id"]})

    def panel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf["id"]:
                g, seen, _ = run_flows(cities[i])
                yield _panel(cities[i], g, seen)

    return numbers.mapInPandas(info, FLOW_INFO), numbers.mapInPandas(panel, FLOW_STATUS)


# --- footprints and calibration --------------------------------------------------------------------------------------


def land_use_role(capacity: Column, p75: Column, p95: Column) -> Column:
    """0 below the 75 % quantile of capacities, 1 from there, 2 from the 95 % quantile on."""
    return F.when(capacity >= p95, 2).when(capacity >= p75, 1).otherwise(0)


def with_roles(info: DataFrame) -> DataFrame:
    q = info.agg(F.percentile("capacity", F.lit(0.75)).alias("__a"), F.percentile("capacity", F.lit(0.95)).alias("__b"))
    return info.join(F.broadcast(q)).withColumn("role", land_use_role(F.col("capacity"), F.col("__a"), F.col("__b"))).drop("__a", "__b")  # one row


def footprint(panel: DataFrame) -> DataFrame:
    """One row: turnover (half the absolute hourly changes over docks and days), median lag-1 autocorrelation of the stations
    that vary, and share of hours empty or full; hours hold their last poll, hours without polls count as neither."""
    cap = panel.groupBy("station_id").agg(F.max(F.col(flow.BIKES) + F.col(flow.DOCKS)).alias("cap"))
    hour = F.floor(F.unix_seconds(F.col(flow.TIME).cast("timestamp")) / 3600)
    last = panel.where(F.col(flow.BIKES).isNotNull()).groupBy("station_id", hour.alias("h")).agg(F.max_by(F.col(flow.BIKES).cast("double"), flow.TIME).alias("x"))
    w = Window.partitionBy("station_id").orderBy("h")
    steps = last.withColumns({"px": F.lag("x").over(w), "ph": F.lag("h").over(w)})
    moved = steps.agg(F.coalesce(F.sum(F.when(F.col("h") == F.col("ph") + 1, F.abs(F.col("x") - F.col("px")))), F.lit(0.0)).alias("moved"))
    span = last.agg(((F.max("h") - F.min("h") + 1)).alias("hours"), F.greatest((F.max("h") - F.min("h")) / 24, F.lit(1e-9)).alias("days"))
    caps = cap.agg(F.greatest(F.coalesce(F.sum("cap"), F.lit(0)).cast("double"), F.lit(1.0)).alias("caps"), F.count("*").alias("n"))
    one = steps.groupBy("station_id").agg(F.count("*").alias("n"), F.stddev_pop("x").alias("sd"), safe_corr(F.col("px"), F.when(F.col("px").isNotNull(), F.col("x"))).alias("r")).where("n > 2 and sd > 1e-6 and r is not null").agg(F.coalesce(F.median("r"), F.lit(0.0)).alias("acf1"))
    out = last.join(cap, "station_id").agg(F.count_if((F.col("x") <= 1e-9) | (F.col("x") >= F.col("cap") - 1e-9)).alias("edge"))
    row = moved.join(F.broadcast(span)).join(F.broadcast(caps)).join(F.broadcast(one)).join(F.broadcast(out))  # one row each
    return row.select((F.col("moved") / 2 / F.col("caps") / F.col("days")).alias("turnover"), "acf1", (F.col("edge") / (F.col("hours") * F.col("n"))).alias("stockout"))


def _footprint(c: Flows, g: pd.DataFrame, seen: np.ndarray) -> np.ndarray:
    x = _panel(c, g, seen).pivot(index="fetched_at", columns="station_id", values=flow.BIKES).to_numpy(float)
    cap = (g["capacity"] - g["ghost"]).to_numpy(float)
    r = [np.corrcoef(v[:-1], v[1:])[0, 1] for v in x.T if len(v) > 2 and v[:-1].std() > 1e-6 and v[1:].std() > 1e-6]
    return np.array([np.abs(np.diff(x, axis=0)).sum() / 2 / max(cap.sum(), 1) / max((len(x) - 1) / 24, 1e-9), np.median(r) if r else 0.0, ((x <= 1e-9) | (x >= cap - 1e-9)).mean()])


def calibrate(info: DataFrame, target: tuple[float, float, float], *, days: int = 3, weights: tuple[float, float, float] = (1.0, 2.0, 1.0), seed: int = 0, betas=(1.0, 2.0, 3.0), bases=(0.1, 0.4, 0.8), rates=(6.0, 10.0, 14.0)) -> DataFrame:
    """All settings of the grid with their simulated footprint and weighted relative error, a task each; rank 1 fits best.
    The city's stations go to every task, MAX_FLOW_STATIONS at most."""
    spark = info.sparkSession
    g = with_roles(info.where("lat is not null and lon is not null and capacity > 0")).select("station_id", "lat", "lon", "capacity", "role").limit(MAX_FLOW_STATIONS + 1).toPandas().assign(region_id="0")
    if len(g) > MAX_FLOW_STATIONS:
        raise ValueError(f"a simulated city has {MAX_FLOW_STATIONS} stations at most")
    grid = spark.createDataFrame([(float(b), float(d), float(r)) for b in betas for d in bases for r in rates], "beta_km double, base_demand double, trip_rate double")
    goal, scale = np.asarray(target, float), np.maximum(np.abs(np.asarray(target, float)), 1e-6)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b, d, r in pdf.itertuples(index=False):
                c = Flows(days=days, seed=seed, climb_penalty=0.0, beta_km=b, base_demand=d, trip_rate=r)
                fp = _footprint(c, *run_flows(c, g)[:2])
                yield pd.DataFrame([[b, d, r, *fp, float((np.asarray(weights) * ((fp - goal) / scale) ** 2).sum())]], columns=["beta_km", "base_demand", "trip_rate", "turnover", "acf1", "stockout", "mse"])

    done = stored(grid.repartition(grid.count()).mapInPandas(run, "beta_km double, base_demand double, trip_rate double, turnover double, acf1 double, stockout double, mse double"))
    return done.withColumn("rank", F.row_number().over(Window.orderBy("mse", "beta_km", "base_demand", "trip_rate")))  # as many rows as the grid has


# --- archives and learning sets --------------------------------------------------------------------------------------


def write_archive(spark: SparkSession, path: str, *cities: Flows) -> None:
    """`path`/status and `path`/info: simulated archives with small counts, ghosts as disabled bikes and failed polls as gaps."""
    info, status = flows(spark, *cities)
    narrow = status.withColumns({c: F.col(c).cast("short") for c in ("num_bikes_available", "num_bikes_disabled", "num_docks_available")} | {"is_renting": F.lit(True), "is_returning": F.lit(True), "is_installed": F.lit(True), "last_reported": F.col("fetched_at"), "gbfs_version": F.lit("2.3")})
    narrow.write.option("compression", "snappy").partitionBy("system_id").parquet(f"{path}/status")
    info.write.parquet(f"{path}/info")


def temporal_split(panel: DataFrame, *, train: float = 0.66, val: float = 0.17, time: str = "fetched_at") -> DataFrame:
    """panel with `split`: by the place of each row's time among the distinct times, never by rows."""
    from ..plans.ranks import ranked_whole

    times = panel.select(time).distinct().withColumn("__one", F.lit(1))
    ranked = ranked_whole(times, [time], "__one").select(time, (F.col("__i") - 1).alias("__i"), "__n")
    part = F.when(F.col("__i") < F.floor(F.col("__n") * train), "train").when(F.col("__i") < F.floor(F.col("__n") * (train + val)), "val").otherwise("test")
    return panel.join(ranked.select(time, part.alias("split")), time)


def write_learning_set(info: DataFrame, panel: DataFrame, path: str, *, k: int = 10, n_eigen: int = 64, train: float = 0.66, val: float = 0.17) -> None:
    """Long tables instead of wide ones: `panel` (all times by all stations, counts NULL where not observed, with `observed`
    and `split`), `stations`, `graph` (weighted edges) and `basis` (smoothest eigenvectors)."""
    stations = info.select("station_id", "lat", "lon", "capacity")
    times = temporal_split(panel.select(flow.TIME).distinct(), train=train, val=val)
    shards = F.sequence(F.lit(0), F.lit(63))  # stations meet times in shards, so no key is hot
    grid = times.withColumn("__b", F.explode(shards)).join(stations.select("station_id", F.col("capacity").cast("short").alias("capacity"), F.pmod(F.hash("station_id"), F.lit(64)).alias("__b")), "__b").drop("__b")
    seen = panel.groupBy("station_id", flow.TIME).agg(F.max(F.col(flow.BIKES).cast("short")).alias(flow.BIKES))
    full = grid.join(seen, ["station_id", flow.TIME], "left").withColumn("observed", F.col(flow.BIKES).isNotNull())
    full.write.partitionBy("split").parquet(f"{path}/panel")
    stations.write.parquet(f"{path}/stations")
    edges = stored(graph.knn_adjacency(info, k=k))
    edges.write.parquet(f"{path}/graph")
    graph.low_freq_basis(graph.normalized_laplacian(edges), n_eigen).write.parquet(f"{path}/basis")
