"""Joins of inventories, statuses, vehicles and exogenous series; network differences; fleet and catalogue filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import haversine_m
from ..functions.freq import seconds
from ..plans.rewrites import asof_join
from ..schemas import KEYS
from .flow import TIME


def join_availability(info: DataFrame, status: DataFrame, *, keys=KEYS) -> DataFrame:
    """Full outer join; `presence` tells the sides; clashing columns of info get the suffix _info."""
    keys = [k for k in keys if k in info.columns and k in status.columns]
    clash = {c: f"{c}_info" for c in info.columns if c in status.columns and c not in keys}
    left, right = status.withColumn("__s", F.lit(True)), info.withColumnsRenamed(clash).withColumn("__i", F.lit(True))
    presence = F.when(F.col("__s") & F.col("__i"), "both").when(F.col("__i"), "info_only").otherwise("status_only")
    return left.join(right, keys, "full_outer").withColumn("presence", presence).drop("__s", "__i")


def join_vehicle_types(vehicles: DataFrame, types: DataFrame) -> DataFrame:
    return vehicles.join(types.drop("system_id"), "vehicle_type_id", "left")


def join_pricing(vehicles: DataFrame, plans: DataFrame) -> DataFrame:
    renamed = plans.drop("system_id").withColumnsRenamed({c: f"plan_{c}" for c in plans.columns if c not in ("plan_id", "system_id")})
    return vehicles.join(renamed, F.col("pricing_plan_id") == F.col("plan_id"), "left")


def filter_vehicles(vehicles: DataFrame, types: DataFrame, *, form_factor: str | None = None, propulsion: str | None = None) -> DataFrame:
    """form_factor: equal but for case; propulsion: a pattern within, but for case."""
    out = vehicles if "form_factor" in vehicles.columns else join_vehicle_types(vehicles, types)
    if form_factor:
        out = out.where(F.lower("form_factor") == form_factor.lower())
    return out.where(F.col("propulsion_type").rlike(f"(?i){propulsion}")) if propulsion else out


def ebikes(vehicles: DataFrame, types: DataFrame) -> DataFrame:
    return filter_vehicles(vehicles, types, propulsion="electric")


def filter_bbox(df: DataFrame, bounds: tuple[float, float, float, float], *, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """bounds: smallest lon and lat, largest lon and lat, inclusive."""
    x0, y0, x1, y1 = bounds
    return df.where(F.col(lat).between(y0, y1) & F.col(lon).between(x0, x1))


def join_exogenous(panel: DataFrame, exogenous: DataFrame, *, on: str = TIME, exo_time: str = "observed_at", tolerance: str = "1h", direction: str = "nearest", by: tuple[str, ...] = ()) -> DataFrame:
    return asof_join(panel, exogenous, on, exo_time, seconds(tolerance), direction, by)


def network_changes(old: DataFrame, new: DataFrame, *, move_threshold_m: float = 50, keys=KEYS) -> DataFrame:
    """Rows (keys, change, detail): added, removed, recapacitated and moved stations."""
    w = Window.partitionBy(*keys).orderBy("lat", "lon", "capacity")
    one = lambda df: df.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*keys, "lat", "lon", "capacity")
    a, b = one(old).toDF(*keys, "lat0", "lon0", "cap0").withColumn("o", F.lit(True)), one(new).toDF(*keys, "lat1", "lon1", "cap1").withColumn("n", F.lit(True))
    d = F.bround(haversine_m(F.col("lat0"), F.col("lon0"), F.col("lat1"), F.col("lon1")), 1)
    both = F.col("o") & F.col("n")
    kinds = F.array_compact(F.array(
        F.when(F.col("o").isNull(), F.struct(F.lit("added").alias("change"), F.lit(None).cast("double").alias("distance_m"))),
        F.when(F.col("n").isNull(), F.struct(F.lit("removed").alias("change"), F.lit(None).cast("double").alias("distance_m"))),
        F.when(both & ~F.col("cap0").eqNullSafe(F.col("cap1")), F.struct(F.lit("recapacitated").alias("change"), F.lit(None).cast("double").alias("distance_m"))),
        F.when(both & (d > move_threshold_m), F.struct(F.lit("moved").alias("change"), d.alias("distance_m"))),
    ))
    return a.join(b, list(keys), "full_outer").select(*keys, "cap0", "cap1", F.explode(kinds).alias("k")).select(*keys, "k.change", F.col("cap0").alias("old_capacity"), F.col("cap1").alias("new_capacity"), "k.distance_m")


def capacity_utilization(panel: DataFrame, info: DataFrame | None = None) -> DataFrame:
    from .flow import BIKES

    if "capacity" not in panel.columns:
        caps = info.groupBy(*KEYS).agg(F.first("capacity").alias("capacity"))
        panel = panel.join(caps, list(KEYS), "left")
    return panel.withColumn("utilization", F.col(BIKES) / F.when(F.col("capacity") > 0, F.col("capacity")))


def system_profile(availability: DataFrame, *, by: tuple[str, ...] = ("system_id",)) -> DataFrame:
    """One row per system: sizes, mean occupancy, shares of states in %, and median staleness where last_reported is there."""
    from ..functions.exprs import occupancy, station_state

    b, d = F.col("num_bikes_available"), F.col("num_docks_available")
    state = station_state(b, d, F.col("is_renting"), F.col("is_returning"), F.col("is_virtual_station"), F.col("capacity"))
    rows = availability.withColumn("__st", state)
    shares = [F.bround(F.count_if(F.col("__st") == s) / F.count("*") * 100, 2).alias(f"pct_{s}") for s in ("disabled", "virtual", "empty", "full", "normal")]
    age = (F.unix_micros(F.col(TIME).cast("timestamp")) - F.unix_micros(F.col("last_reported").cast("timestamp"))) / 60e6 if {TIME, "last_reported"} <= set(rows.columns) else None
    late = [] if age is None else [F.bround(F.median(age), 1).alias("median_staleness_min")]
    return rows.groupBy(*by).agg(F.count("*").alias("n_stations"), F.coalesce(F.sum(b), F.lit(0)).alias("total_bikes"), F.coalesce(F.sum("capacity"), F.lit(0)).alias("total_capacity"), F.bround(F.avg(occupancy(b, d)), 4).alias("mean_occupancy"), *shares, *late)
