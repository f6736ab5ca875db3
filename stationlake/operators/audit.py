"""Semantic audit: static rules A1-A7 over an inventory, dynamic rules D1-D3 over live availability."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import EARTH_M
from ..plans.rewrites import knn

FLAGS = ("A1", "A2", "A3", "A4", "A5", "A6", "A7")
#: Reasons in the order of FLAGS.
NAMES = ("carsharing", "constant_capacity", "free_floating", "spatial_outlier", "oversized_area", "zero_capacity", "missing_capacity")


#: Thresholds in the signatures below are fixed values.


def docked() -> Column:
    return (F.col("station_type") == "docked_bike") & ~F.coalesce(F.col("is_virtual_station"), F.lit(False))


def lon_span(stations: DataFrame) -> DataFrame:
    """Per system: degrees of the smallest arc that covers all longitudes."""
    w = Window.partitionBy("system_id").orderBy("m")
    rows = stations.where("lat is not null and lon is not null").withColumn("m", F.pmod("lon", F.lit(360.0)))
    gaps = rows.withColumn("gap", F.lead("m").over(w) - F.col("m"))
    return gaps.groupBy("system_id").agg((360 - F.greatest(F.coalesce(F.max("gap"), F.lit(0.0)), 360 - (F.max("m") - F.min("m")))).alias("arc"))


def audit_systems(stations: DataFrame, *, a7_scope: str = "docked", a5_area_km2: float = 5e4, a6_tau: float = 0.01, a7_tau: float = 0.5, n_min: int = 20) -> DataFrame:
    """The rules that hold for whole systems: A2, A5, A6, A7."""
    if a7_scope not in ("docked", "all"):
        raise ValueError(f"unknown scope {a7_scope!r}")
    dock, cap = docked(), F.col("capacity")
    scope = dock if a7_scope == "docked" else F.lit(True)
    known = F.when(dock & cap.isNotNull(), cap)
    s = stations.groupBy("system_id").agg(
        (F.coalesce(F.min(known) == F.max(known), F.lit(False)) & F.coalesce(F.min(known) > 0, F.lit(False)) & (F.count(known) >= n_min)).alias("a2"),
        F.coalesce((F.count_if(dock & (cap == 0)) / F.when(F.count_if(dock) >= n_min, F.count_if(dock))) >= a6_tau, F.lit(False)).alias("A6"),
        F.coalesce((F.count_if(scope & cap.isNull()) / F.when(F.count_if(scope) >= n_min, F.count_if(scope))) >= a7_tau, F.lit(False)).alias("A7"),
        F.max("lat").alias("hi"), F.min("lat").alias("lo"), F.avg("lat").alias("mid"), F.count("lat").alias("n"),
    )
    rad = math.pi / 180
    area = (F.col("hi") - F.col("lo")) * rad * EARTH_M * F.col("arc") * rad * EARTH_M * F.cos(F.radians("mid")) / 1e6
    return s.join(lon_span(stations), "system_id", "left").select("system_id", F.col("a2").alias("A2"), F.coalesce((F.col("n") >= 2) & (area > a5_area_km2), F.lit(False)).alias("A5"), "A6", "A7")


def nearest_distances(stations: DataFrame) -> DataFrame:
    """Each station's distance to its nearest in the system, with the system's median, scaled median deviation and number."""
    nn = knn(stations, stations, 1, "station_id", "station_id", partition=("system_id",)).select("system_id", F.col("a_id").alias("station_id"), "distance_m")
    med = nn.groupBy("system_id").agg(F.median("distance_m").alias("med"), F.count("*").alias("n"))
    mad = nn.join(med, "system_id").groupBy("system_id").agg((F.median(F.abs(F.col("distance_m") - F.col("med"))) * 1.4826).alias("mad"))
    return nn.join(med.join(mad, "system_id"), "system_id")


def spatial_outliers(stations: DataFrame, *, a4_sigma: float = 3.0) -> DataFrame:
    """(system_id, station_id) of A4: the nearest neighbour lies beyond the system's threshold."""
    limit = F.greatest(F.when(F.col("mad") > 0, F.col("med") + a4_sigma * F.col("mad")).otherwise(10 * F.col("med")), F.lit(1000.0))
    return nearest_distances(stations).where((F.col("n") >= 5) & (F.col("distance_m") > limit)).select("system_id", "station_id")


def audit_static(stations: DataFrame, *, a4_sigma: float = 3.0, **systems) -> DataFrame:
    """stations with A1..A7, flagged and reason."""
    out = stations.join(audit_systems(stations, **systems), "system_id", "left")
    out = out.join(spatial_outliers(stations, a4_sigma=a4_sigma).withColumn("A4", F.lit(True)), ["system_id", "station_id"], "left")
    dock = F.coalesce(docked(), F.lit(False))
    out = out.withColumns({
        "A1": F.coalesce(F.col("station_type") == "carsharing", F.lit(False)), "A2": F.col("A2") & dock, "A3": F.coalesce(F.col("station_type") == "free_floating", F.lit(False)),
        "A4": F.coalesce("A4", F.lit(False)), "A6": F.col("A6") & dock, "A7": F.col("A7") & (dock if systems.get("a7_scope", "docked") == "docked" else F.lit(True)),
    })
    any_ = F.lit(False)
    for f in FLAGS:
        any_ = any_ | F.col(f)
    return out.withColumns({"flagged": any_, "reason": F.concat_ws(", ", *(F.when(F.col(f), n) for f, n in zip(FLAGS, NAMES)))})


def drop_flagged(stations: DataFrame, **options) -> DataFrame:
    return audit_static(stations, **options).where("not flagged").select(*stations.columns)


def sentinel_coordinates(info: DataFrame, *, tol: float = 1e-6) -> DataFrame:
    return info.withColumn("sentinel", F.coalesce((F.abs("lat") < tol) & (F.abs("lon") < tol), F.lit(False)))


def overcapacity_ratio(info: DataFrame, *, n_min: int = 20) -> DataFrame:
    """Per system: mean positive capacity over the mean with missing ones as 0."""
    c = F.col("capacity")
    pos = F.avg(F.when(c > 0, c))
    mean = F.sum(F.coalesce(c, F.lit(0))) / F.count("*")
    return info.groupBy("system_id").agg(F.when((F.count("*") >= n_min) & (F.sum(F.coalesce(c, F.lit(0))) > 0), pos / mean).alias("overcapacity_ratio"))


def capacity_convention(info: DataFrame, *, nan_tau: float = 0.5, a3_ratio: float = 5, per_vehicle_max: float = 2, n_min: int = 20) -> DataFrame:
    """What a system's capacities mean: null, placeholder, conditional_profile, per_vehicle or physical, the first that fits."""
    c = F.col("capacity")
    s = info.groupBy("system_id").agg(F.avg(c.isNull().cast("double")).alias("nulls"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("n"), F.median(F.when(c > 0, c)).alias("mid"))
    out = s.join(overcapacity_ratio(info, n_min=n_min), "system_id")
    kind = F.when(F.col("nulls") >= nan_tau, "null").when((F.col("n") >= n_min) & (F.col("lo") > 0) & (F.col("lo") == F.col("hi")), "placeholder").when(F.col("overcapacity_ratio") > a3_ratio, "conditional_profile").when(F.col("mid") <= per_vehicle_max, "per_vehicle").otherwise("physical")
    return out.select("system_id", kind.alias("convention"))


def reclassify_overcapacity(info: DataFrame, *, a3_ratio: float = 5, n_min: int = 20) -> DataFrame:
    """Stations of systems whose ratio is above a3_ratio become free_floating."""
    out = info.join(overcapacity_ratio(info, n_min=n_min), "system_id", "left")
    return out.withColumn("station_type", F.when(F.col("overcapacity_ratio") > a3_ratio, "free_floating").otherwise(F.col("station_type"))).drop("overcapacity_ratio")


def classify_virtual(info: DataFrame) -> DataFrame:
    return info.withColumn("station_type", F.when(F.col("is_virtual_station"), "free_floating").otherwise(F.col("station_type")))


def classify_from_vehicle_types(info: DataFrame, types: DataFrame, *, cars=("car",), bikes=("bicycle", "cargo_bicycle")) -> DataFrame:
    """Stations of systems that have cars and no bicycles become carsharing."""
    low = F.lower("form_factor")
    s = types.groupBy("system_id").agg(F.max(low.isin(*cars)).alias("car"), F.max(low.isin(*bikes)).alias("bike"))
    out = info.join(s, "system_id", "left")
    return out.withColumn("station_type", F.when(F.col("car") & ~F.col("bike"), "carsharing").otherwise(F.col("station_type"))).drop("car", "bike")


def audit_dynamic(availability: DataFrame, *, ttl_seconds: float | None = None, stale_after_minutes: float = 60, buffer_seconds: float = 60) -> DataFrame:
    """D1 negative counts, D2 more vehicles and docks than capacity, D3 stale."""
    b, d, c = F.col("num_bikes_available"), F.col("num_docks_available"), F.col("capacity")
    limit = ttl_seconds + buffer_seconds if ttl_seconds is not None else stale_after_minutes * 60
    lag = (F.unix_micros(F.col("fetched_at").cast("timestamp")) - F.unix_micros(F.col("last_reported").cast("timestamp"))) / 1e6
    false = F.lit(False)
    out = availability.withColumns({"D1": F.coalesce(b < 0, false) | F.coalesce(d < 0, false), "D2": F.coalesce((F.coalesce(b, F.lit(0)) + F.coalesce(d, F.lit(0)) > c) & (c > 0), false), "D3": F.coalesce(lag > limit, false)})
    return out.withColumns({"flagged": F.col("D1") | F.col("D2") | F.col("D3"), "reason": F.concat_ws(", ", F.when(F.col("D1"), "negative_count"), F.when(F.col("D2"), "over_capacity"), F.when(F.col("D3"), "stale"))})


def audit_frames(info: DataFrame, status: DataFrame, **dynamic) -> DataFrame:
    """Verdicts of both audits, one under the other."""
    from .frames import join_availability

    cols = ("system_id", "station_id", "flagged", "reason")
    live = audit_dynamic(join_availability(info, status), **dynamic)
    return audit_static(info).select(F.lit("static").alias("layer"), *cols).unionByName(live.select(F.lit("dynamic").alias("layer"), *cols))


#: Thresholds of the static audit that can be moved, and their defaults (fixed values).
THRESHOLDS = {"a4_sigma": 3.0, "a5_area_km2": 5e4, "a6_tau": 0.01, "a7_tau": 0.5, "n_min": 20.0}


def system_statistics(stations: DataFrame, a7_scope: str = "docked") -> DataFrame:
    """Per system: all that the rules compare with thresholds."""
    dock, cap = F.coalesce(docked(), F.lit(False)), F.col("capacity")
    known = F.when(dock, cap)
    scope = dock if a7_scope == "docked" else F.lit(True)
    rad = math.pi / 180
    s = stations.groupBy("system_id").agg(
        F.max(F.col("station_type") == "carsharing").alias("c1"), F.max(F.col("station_type") == "free_floating").alias("c3"),
        F.count(known).alias("nk"), (F.coalesce(F.min(known) == F.max(known), F.lit(False)) & (F.min(known) > 0)).alias("same"),
        F.count_if(dock).alias("n6"), F.avg(F.when(dock, F.coalesce((cap == 0).cast("double"), F.lit(0.0)))).alias("r6"),
        F.count_if(scope).alias("n7"), F.avg(F.when(scope, cap.isNull().cast("double"))).alias("r7"),
        F.max("lat").alias("hi"), F.min("lat").alias("lo"), F.avg("lat").alias("mid"), F.count("lat").alias("n"),
    )
    far = nearest_distances(stations).groupBy("system_id").agg(F.max("distance_m").alias("d4"), F.first("med").alias("med"), F.first("mad").alias("mad"), F.first("n").alias("n4"))
    area = (F.col("hi") - F.col("lo")) * rad * EARTH_M * F.col("arc") * rad * EARTH_M * F.cos(F.radians("mid")) / 1e6
    return s.join(lon_span(stations), "system_id", "left").join(far, "system_id", "left").withColumn("area", F.when(F.col("n") >= 2, area))


def audit_sensitivity(stations: DataFrame, grids: dict[str, tuple] | None = None, *, a7_scope: str = "docked", **baseline) -> DataFrame:
    """Systems that each rule flags as one threshold at a time moves, and the Jaccard similarity with the baseline's (1 if
    both flag none). Statistics are computed once per system; thresholds meet them as an array of a few rows."""
    base = THRESHOLDS | {k: float(v) for k, v in baseline.items()}
    grids = grids or {"a4_sigma": (2, 2.5, 3, 3.5, 4), "a6_tau": (0.005, 0.01, 0.05), "a7_tau": (0.3, 0.5, 0.7)}
    if unknown := (set(grids) | set(base)) - set(THRESHOLDS):
        raise ValueError(f"unknown thresholds {sorted(unknown)}")

    def rules(t: dict[str, Column]) -> list[Column]:
        n = t["n_min"]
        limit = F.greatest(F.when(F.col("mad") > 0, F.col("med") + t["a4_sigma"] * F.col("mad")).otherwise(10 * F.col("med")), F.lit(1000.0))
        found = (F.col("c1"), F.col("same") & (F.col("nk") >= n), F.col("c3"), (F.col("n4") >= 5) & (F.col("d4") > limit), F.col("area") > t["a5_area_km2"], (F.col("n6") >= n) & (F.col("r6") >= t["a6_tau"]), (F.col("n7") >= n) & (F.col("r7") >= t["a7_tau"]))
        return [F.coalesce(c, F.lit(False)) for c in found]

    settings = F.array(*(F.struct(F.lit(p).alias("param"), F.lit(float(v)).alias("value"), *(F.lit(float(v) if k == p else d).alias(k) for k, d in base.items())) for p, vs in grids.items() for v in vs))
    rows = system_statistics(stations, a7_scope).withColumn("g", F.explode(settings))
    now, then = rules({k: F.col(f"g.{k}") for k in base}), rules({k: F.lit(v) for k, v in base.items()})
    cells = rows.select("g.param", "g.value", F.explode(F.array(*(F.struct(F.lit(f).alias("class"), a.alias("a"), b.alias("b")) for f, a, b in zip(FLAGS, now, then)))).alias("c"))
    out = cells.groupBy("param", "value", "c.class").agg(F.count_if("c.a").alias("systems_flagged"), F.count_if(F.col("c.a") & F.col("c.b")).alias("i"), F.count_if(F.col("c.a") | F.col("c.b")).alias("u"))
    return out.select("param", "value", "class", "systems_flagged", F.when(F.col("u") > 0, F.bround(F.col("i") / F.col("u"), 4)).otherwise(1.0).alias("jaccard_vs_baseline"))


def flag_rate_ci(verdict: DataFrame, *, seed: int = 42, n_boot: int = 10_000, alpha: float = 0.05) -> DataFrame:
    """Per rule: systems with a flagged station, their share, and its percentile interval when systems are drawn again. One
    task holds a row of seven flags per system; draws are made a few at a time."""
    systems = verdict.groupBy("system_id").agg(*(F.max(F.col(f).cast("int")).alias(f) for f in FLAGS))

    def draw(pdf):
        flags = pdf.sort_values("system_id")[list(FLAGS)].to_numpy()
        n, rng, means = len(flags), np.random.default_rng(seed), []
        step = max(1, 2_000_000 // max(1, n))
        for a in range(0, n_boot, step):
            means.append(flags[rng.integers(0, n, size=(min(step, n_boot - a), n))].mean(axis=1))
        lo, hi = np.percentile(np.concatenate(means), [100 * alpha / 2, 100 * (1 - alpha / 2)], axis=0)
        return pd.DataFrame({"class": FLAGS, "systems_flagged": flags.sum(axis=0), "rate": flags.mean(axis=0).round(4), "ci_lo": lo.round(4), "ci_hi": hi.round(4)})

    return systems.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(draw, "class string, systems_flagged long, rate double, ci_lo double, ci_hi double")
