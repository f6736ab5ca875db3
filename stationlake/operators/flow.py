"""Ordered per-station operators: flows, episodes, frozen stations, resampling, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import floor_time
from ..functions.freq import seconds
from ..schemas import KEYS, require_columns

BIKES, DOCKS, TIME = "num_bikes_available", "num_docks_available", "fetched_at"


def by_station(*order: str):
    return Window.partitionBy(*KEYS).orderBy(*(order or (TIME,)))


def net_flow(panel: DataFrame) -> DataFrame:
    """panel with `net_flow`: bikes against the station's poll before; NULL first and where last_reported stands still."""
    require_columns(panel, (*KEYS, TIME, BIKES))
    w = by_station()
    flow = F.col(BIKES) - F.lag(BIKES).over(w)
    if "last_reported" in panel.columns:
        flow = F.when(F.col("last_reported") == F.lag("last_reported").over(w), None).otherwise(flow)
    return panel.withColumn("net_flow", flow)


def turnover(panel: DataFrame, *, freq: str = "1D", normalize: str | None = None) -> DataFrame:
    """Sum of absolute flows per station and period; "capacity" divides by the station's first known capacity."""
    flows = net_flow(panel).where("net_flow is not null")
    out = flows.groupBy(*KEYS, floor_time(F.col(TIME), freq).alias("period")).agg(F.sum(F.abs("net_flow")).alias("turnover"))
    if normalize == "capacity":
        caps = panel.where("capacity is not null").groupBy(*KEYS).agg(F.min_by("capacity", TIME).alias("__cap"))
        out = out.join(caps, list(KEYS), "left").withColumn("turnover", F.col("turnover") / F.when(F.col("__cap") > 0, F.col("__cap"))).drop("__cap")
    return out


def flow_balance(panel: DataFrame) -> DataFrame:
    """Inflow, outflow, net and balance = outflow / inflow (3 digits, NULL without inflow)."""
    nf = F.col("net_flow")
    out = net_flow(panel).groupBy(*KEYS).agg(F.coalesce(F.sum(F.when(nf > 0, nf)), F.lit(0)).alias("inflow"), F.coalesce(F.sum(F.when(nf < 0, -nf)), F.lit(0)).alias("outflow"))
    return out.withColumns({"net": F.col("inflow") - F.col("outflow"), "balance": F.bround(F.col("outflow") / F.when(F.col("inflow") > 0, F.col("inflow")), 3)})


def flow_asymmetry(panel: DataFrame, *, eps: float = 1e-9) -> DataFrame:
    return flow_balance(panel).select(*KEYS, (F.col("inflow") / (F.col("outflow") + F.lit(eps))).alias("flow_asymmetry"))


def cumulative_imbalance(panel: DataFrame, *, reset: str | None = "1D") -> DataFrame:
    """panel with the running sum of flows, from the start of each period anew."""
    keys = [*KEYS, *([] if reset is None else [floor_time(F.col(TIME), reset)])]
    w = Window.partitionBy(*keys).orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    return net_flow(panel).withColumn("cumulative_imbalance", F.sum(F.coalesce("net_flow", F.lit(0))).over(w))


def aliasing_vulnerability(panel: DataFrame) -> DataFrame:
    """Share of sign reversals among consecutive non-zero flows; NULL under two of them."""
    flows = net_flow(panel).where("net_flow is not null")
    n = flows.groupBy(*KEYS).agg(F.count("*").alias("n_intervals"))
    signs = flows.where("net_flow <> 0").withColumn("s", F.signum("net_flow")).withColumn("p", F.lag("s").over(by_station())).where("p is not null")
    return n.join(signs.groupBy(*KEYS).agg(F.avg((F.col("s") != F.col("p")).cast("double")).alias("reversal_share")), list(KEYS), "left")


def fleet_turnover(panel: DataFrame, *, freq: str = "1D") -> DataFrame:
    """Half the absolute flows of a period over the largest fleet of its snapshots."""
    period = floor_time(F.col(TIME), freq).alias("period")
    moved = net_flow(panel).groupBy("system_id", period).agg((F.coalesce(F.sum(F.abs("net_flow")), F.lit(0)) / 2).alias("moved"))
    fleet = panel.groupBy("system_id", TIME).agg(F.sum(BIKES).alias("fleet")).groupBy("system_id", period).agg(F.max("fleet").alias("fleet"))
    return moved.join(fleet, ["system_id", "period"]).select("system_id", "period", (F.col("moved") / F.when(F.col("fleet") > 0, F.col("fleet"))).alias("fleet_turnover"))


def docking_pressure(panel: DataFrame) -> DataFrame:
    """Mean positive flow of the station over the docks free now."""
    mean = F.coalesce(F.avg(F.when(F.col("net_flow") > 0, F.col("net_flow"))).over(Window.partitionBy(*KEYS)), F.lit(0.0))
    return net_flow(panel).withColumn("docking_pressure", mean / F.when(F.col(DOCKS) > 0, F.col(DOCKS)))


def stockout_episodes(panel: DataFrame, *, kinds=("empty", "full")) -> DataFrame:
    """Maximal runs of polls at which a station is empty or full."""
    flags = {"empty": F.coalesce(F.col(BIKES) <= 0, F.lit(False)), "full": F.coalesce(F.col(DOCKS) <= 0, F.lit(False))}
    long = panel.select(*KEYS, TIME, F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), flags[k].alias("flag")) for k in kinds))).alias("e")).select(*KEYS, TIME, "e.kind", "e.flag")
    w = Window.partitionBy(*KEYS, "kind").orderBy(TIME)
    runs = long.withColumn("change", (~F.col("flag").eqNullSafe(F.lag("flag").over(w))).cast("int")).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.where("flag").groupBy(*KEYS, "kind", "run").agg(F.min(TIME).alias("start"), F.max(TIME).alias("end"), F.count("*").alias("n_obs")).drop("run")
    return out.withColumn("duration_minutes", F.bround((F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 60e6, 1))


def outage_survival(episodes: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Per duration: episodes at least as long, share of longer ones; with n, median and 90 % quantile of the group."""
    d = "duration_minutes"
    per = episodes.where(F.col(d).isNotNull()).groupBy(*by, d).agg(F.count("*").alias("here"))
    w = Window.partitionBy(*by).orderBy(F.col(d).desc())
    total = episodes.where(F.col(d).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.percentile(d, F.lit(0.5)).alias("median"), F.percentile(d, F.lit(0.9)).alias("p90"))
    out = per.withColumn("at_risk", F.sum("here").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(total, list(by)) if by else out.join(F.broadcast(total))  # one row without `by`
    return out.withColumn("survival", (F.col("at_risk") - F.col("here")) / F.col("n")).drop("here")


def frozen_stations(panel: DataFrame, *, columns=(BIKES,), min_run_hours: float = 6, active_hours: tuple[int, int] | None = (6, 22), strict: bool = False) -> DataFrame:
    """Longest constant run of each column within the active hours; frozen if all last min_run_hours; strict: all constant."""
    rows = panel if active_hours is None else panel.where(F.hour(TIME).between(*active_hours))
    out = None
    for c in columns:
        w = by_station()
        same = F.coalesce(F.col(c) == F.lag(c).over(w), F.lit(False))
        runs = rows.withColumn("run", F.sum((~same).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        hours = (F.max(F.unix_micros(F.col(TIME).cast("timestamp"))) - F.min(F.unix_micros(F.col(TIME).cast("timestamp")))) / 3.6e9
        runs = runs.groupBy(*KEYS, "run").agg(hours.alias("h"), F.first(c).alias("v"))
        one = runs.groupBy(*KEYS).agg(F.max("h").alias(f"{c}_run_hours"), F.max_by("v", F.struct("h", -F.col("run"))).alias(f"{c}_run_value"), F.count("*").alias(f"{c}_runs"))
        out = one if out is None else out.join(one, list(KEYS))
    good = F.lit(True)
    for c in columns:
        good = good & (F.col(f"{c}_run_hours") >= min_run_hours) & ((F.col(f"{c}_runs") == 1) if strict else F.lit(True))
    return out.withColumn("frozen", good).drop(*(f"{c}_runs" for c in columns))


def dedup_last(panel: DataFrame) -> DataFrame:
    """The last poll of each station and last_reported."""
    w = Window.partitionBy(*KEYS, "last_reported").orderBy(F.col(TIME).desc())
    return panel.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def resample(panel: DataFrame, freq: str = "15min", *, by=KEYS, values=(BIKES, DOCKS), time: str = TIME) -> DataFrame:
    """Each group on a regular grid from its first to its last period; a point holds the last poll up to it, the first may be
    NULL. Of polls at one time the largest values count."""
    step = seconds(freq)
    t = F.unix_micros(F.col(time).cast("timestamp"))
    obs = panel.groupBy(*by, t.alias("t")).agg(F.max(F.struct(*(F.col(v) for v in values))).alias("v"))
    edge = lambda c: (F.floor(c / (step * 1_000_000)) * step * 1_000_000).cast("long")
    grid = obs.groupBy(*by).agg(F.explode(F.sequence(edge(F.min("t")), edge(F.max("t")), F.lit(step * 1_000_000).cast("long"))).alias("t"))
    both = obs.withColumn("g", F.lit(0)).unionByName(grid.withColumn("g", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("t", "g").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("v", F.last("v", ignorenulls=True).over(w)).where("g = 1")
    return held.select(*by, F.timestamp_micros("t").alias(time), *(F.col(f"v.{v}").alias(v) for v in values))


def explicit_gaps(panel: DataFrame, *, tolerance: str = "15min", by=KEYS, time: str = TIME) -> DataFrame:
    """panel with a row of NULLs in the middle of each gap longer than the tolerance."""
    w = Window.partitionBy(*by).orderBy(time)
    us = F.unix_micros(F.col(time).cast("timestamp"))
    gaps = panel.select(*by, us.alias("t"), F.lag(us).over(w).alias("p")).where(F.col("t") - F.col("p") > seconds(tolerance) * 1_000_000)
    kind = panel.schema[time].dataType
    return panel.unionByName(gaps.select(*by, F.timestamp_micros(((F.col("t") + F.col("p")) / 2).cast("long")).cast(kind).alias(time)), allowMissingColumns=True)


def snapshot_asof(panel: DataFrame, target, *, tolerance: str = "10min", by=KEYS, time: str = TIME) -> DataFrame:
    """The latest row of each group in [target - tolerance, target]."""
    end = F.lit(target).cast("timestamp")
    rows = panel.where((F.col(time).cast("timestamp") <= end) & (F.unix_micros(F.col(time).cast("timestamp")) >= F.unix_micros(end) - seconds(tolerance) * 1_000_000))
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(time).desc()))).where("__n = 1").drop("__n")


def wide_matrix(panel: DataFrame, *, value: str = BIKES, time: str = TIME, station: str = "station_id", stations: list | None = None) -> DataFrame:
    """Times by stations, means of duplicates."""
    grouped = panel.groupBy(time)
    return (grouped.pivot(station, stations) if stations else grouped.pivot(station)).agg(F.avg(value))


def coverage_stations(panel: DataFrame, *, expected_freq: str = "5min") -> DataFrame:
    """Per station: polls expected over the system's window, polls made, uptime in %, longest gap in minutes."""
    us = F.unix_micros(F.col(TIME).cast("timestamp"))
    step = seconds(expected_freq) * 1_000_000
    rows = panel.select(*KEYS, us.alias("t")).distinct()
    span = rows.groupBy("system_id").agg((F.floor((F.max("t") - F.min("t")) / step) + 1).alias("expected"))
    own = rows.withColumn("gap", F.col("t") - F.lag("t").over(by_station("t"))).groupBy(*KEYS).agg(F.count("*").alias("actual"), (F.max("gap") / 60e6).alias("longest_gap_min"))
    return own.join(span, "system_id").withColumn("uptime_pct", F.bround(F.least(F.lit(1.0), F.col("actual") / F.col("expected")) * 100, 1))


def coverage_systems(panel: DataFrame, *, expected_freq: str = "5min") -> DataFrame:
    """Per system: snapshots, median cadence and its median absolute deviation in minutes, share of station polls made."""
    us = F.unix_micros(F.col(TIME).cast("timestamp"))
    step = seconds(expected_freq) * 1_000_000
    pairs = panel.select(*KEYS, us.alias("t")).distinct()
    times = pairs.select("system_id", "t").distinct().withColumn("d", (F.col("t") - F.lag("t").over(Window.partitionBy("system_id").orderBy("t"))) / 60e6)
    med = times.groupBy("system_id").agg(F.median("d").alias("cadence_min"), F.count("*").alias("n_snapshots"), (F.floor((F.max("t") - F.min("t")) / step) + 1).alias("expected"))
    jitter = times.join(med, "system_id").groupBy("system_id").agg(F.median(F.abs(F.col("d") - F.col("cadence_min"))).alias("jitter_min"))
    size = pairs.groupBy("system_id").agg(F.count("*").alias("n_pairs"), F.countDistinct("station_id").alias("n_stations"))
    out = med.join(jitter, "system_id").join(size, "system_id")
    return out.withColumn("yield_pct", F.bround(F.least(F.lit(1.0), F.col("n_pairs") / (F.col("expected") * F.col("n_stations"))) * 100, 1)).drop("n_pairs")


def shares(condition: Column) -> Column:
    """Share of the rows where a condition is known that meet it."""
    return F.avg(condition.cast("double"))
