"""Station operators on streams of snapshots.

Stateless operators (occupancy, station_state, audit_dynamic and others that only add columns) run on streams as they are.
State is kept per station: bounded by the number of stations, and dropped after `idle` without polls.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.exprs import EARTH_M
from ..functions.freq import seconds
from ..schemas import KEYS
from ..sources import lake

BIKES, DOCKS, TIME = "num_bikes_available", "num_docks_available", "fetched_at"


def documents(spark: SparkSession, folder: str, *, system_id: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """JSON documents as they arrive in a folder, ready for the normalisers."""
    src = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return src.select(F.lit(system_id).cast("string").alias("system_id"), F.lit(None).cast("string").alias("gbfs_version"), F.col("_metadata.file_modification_time").alias("fetched_at"), F.col("value").alias("body"))


def to_lake(stream: DataFrame, path: str, checkpoint: str, *, once: bool = False):
    """Appends a stream of rows to the lake, each once; the checkpoint folder must be shared."""
    out = lake.dated(stream).writeStream.format("parquet").partitionBy("system_id", "date").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def dedup(stream: DataFrame, *, within: str = "1 day") -> DataFrame:
    """One poll per station and last_reported. A stream can only keep the first; the batch form keeps the last."""
    return stream.withWatermark(TIME, within).dropDuplicatesWithinWatermark([*KEYS, "last_reported"])


def service(stream: DataFrame, *, freq: str = "1h", late: str = "10 minutes", min_bikes: int = 1, min_docks: int = 1) -> DataFrame:
    """Shares of polls with bikes, with docks and with both, per station and period; a period is final once the watermark passes."""
    bikes, docks = F.col(BIKES) >= min_bikes, F.col(DOCKS) >= min_docks
    mean = lambda c: F.avg(c.cast("double"))
    out = stream.withWatermark(TIME, late).groupBy(*KEYS, F.window(TIME, f"{seconds(freq)} seconds").alias("w"))
    return out.agg(mean(bikes).alias("p_bike"), mean(docks).alias("p_dock"), mean(bikes & docks).alias("p_both"), F.count("*").alias("n_obs")).select(*KEYS, F.col("w.start").alias("period"), "p_bike", "p_dock", "p_both", "n_obs")


def turnover(flows: DataFrame, *, freq: str = "1D", late: str = "10 minutes") -> DataFrame:
    """Sum of absolute flows per station and period, of the rows of `net_flow`; final once the watermark passes."""
    out = flows.withWatermark(TIME, late).where("net_flow is not null").groupBy(*KEYS, F.window(TIME, f"{seconds(freq)} seconds").alias("w"))
    return out.agg(F.sum(F.abs("net_flow")).alias("turnover")).select(*KEYS, F.col("w.start").alias("period"), "turnover")


def fleet_totals(stream: DataFrame, *, freq: str = "5min", late: str = "10 minutes") -> DataFrame:
    """Bikes and docks of each system per period, summed over polls and over stations that polled."""
    out = stream.withWatermark(TIME, late).groupBy("system_id", F.window(TIME, f"{seconds(freq)} seconds").alias("w"))
    return out.agg(F.sum(BIKES).alias("bikes"), F.sum(DOCKS).alias("docks"), F.approx_count_distinct("station_id").alias("n_stations"), F.count("*").alias("n_polls")).select("system_id", F.col("w.start").alias("period"), "bikes", "docks", "n_stations", "n_polls")


def exogenous(stream: DataFrame, other: DataFrame, *, exo_time: str = "observed_at", tolerance: str = "1h", late: str = "10 minutes") -> DataFrame:
    """Each poll with the nearest reading of the other stream within the tolerance (a tie goes to the earlier one), once both
    watermarks have passed; polls without one are left out. Polls of one station at one time are one."""
    step = seconds(tolerance)
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / step)  # noqa: E731  streams meet on buckets as wide as the tolerance
    a = stream.withWatermark(TIME, late).withColumn("__a", bucket(TIME))
    b = other.withWatermark(exo_time, late).withColumn("__b", F.explode(F.array(*(bucket(exo_time) + i for i in (-1, 0, 1)))))
    gap = F.expr(f"interval {step} seconds")
    met = a.join(b, (F.col("__a") == F.col("__b")) & (F.col(exo_time) >= F.col(TIME) - gap) & (F.col(exo_time) <= F.col(TIME) + gap)).drop("__a", "__b")
    off = F.unix_micros(F.col(exo_time).cast("timestamp")) - F.unix_micros(F.col(TIME).cast("timestamp"))
    rest = [c for c in met.columns if c not in (*KEYS, TIME)]
    best = met.groupBy(*KEYS, TIME).agg(F.min_by(F.struct(*rest), F.struct(F.abs(off), off)).alias("m"))
    return best.select(*KEYS, TIME, "m.*")


def _keyed(stream: DataFrame, late: str, columns: list[str]) -> DataFrame:
    return stream.withWatermark(TIME, late).select(*KEYS, TIME, *columns)


def _rows(pdfs: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The polls of a station in this batch in order of time; one station's polls of one batch fit in memory."""
    return pd.concat(list(pdfs), ignore_index=True).sort_values(TIME, kind="stable", ignore_index=True)


def _opt(value, kind: Callable):
    return None if pd.isna(value) else kind(value)


def net_flow(stream: DataFrame, *, late: str = "10 minutes", idle: str = "7D") -> DataFrame:
    """system_id, station_id, fetched_at, num_bikes_available, net_flow, is_late. A flow is taken against the poll before it, in
    this batch or the last one seen. A poll older than that has no flow and is marked late; no poll is dropped."""
    stay = seconds(idle) * 1000
    has = "last_reported" in stream.columns
    src = _keyed(stream, late, [BIKES, F.col("last_reported").cast("timestamp") if has else F.lit(None).cast("timestamp").alias("last_reported")])

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        p = _rows(pdfs)
        seen, bikes, reported = state.get if state.exists else (None, None, None)
        flows, lates = [], []
        for at, now, said in zip(p[TIME], p[BIKES], p["last_reported"]):
            us, now, said = at.value // 1000, _opt(now, int), _opt(said, lambda x: x.value // 1000)
            old = seen is not None and us < seen
            lates.append(old)
            still = said is not None and said == reported
            flows.append(None if old or still or now is None or bikes is None else now - bikes)
            if not old:
                seen, bikes, reported = us, now, said
        state.update((seen, bikes, reported))
        state.setTimeoutTimestamp(max(seen // 1000, state.getCurrentWatermarkMs()) + stay)
        yield pd.DataFrame({"system_id": key[0], "station_id": key[1], TIME: p[TIME], BIKES: p[BIKES].astype("Int64"), "net_flow": pd.array(flows, "Int64"), "is_late": lates})

    return src.groupBy(*KEYS).applyInPandasWithState(step, f"system_id string, station_id string, {TIME} timestamp, {BIKES} long, net_flow long, is_late boolean", "seen long, bikes long, reported long", "append", GroupStateTimeout.EventTimeTimeout)


def stockout_episodes(stream: DataFrame, *, late: str = "10 minutes", idle: str = "1D") -> DataFrame:
    """Episodes of empty or full stations, each emitted when a poll ends it, or after `idle` without polls. Polls older than
    the last one seen of a station can't change what has been decided and are passed over."""
    stay = seconds(idle) * 1000
    kinds = (("empty", BIKES), ("full", DOCKS))

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        seen, *runs = state.get if state.exists else (None, None, None, 0, None, None, 0)
        runs = [list(runs[:3]), list(runs[3:])]  # start, end, polls

        def close(i: int) -> None:
            if runs[i][2]:
                done.append((key[0], key[1], kinds[i][0], *runs[i]))
            runs[i] = [None, None, 0]

        if state.hasTimedOut:
            close(0), close(1)
            state.remove()
        else:
            p = _rows(pdfs)
            for at, *counts in zip(p[TIME], p[BIKES], p[DOCKS]):
                us = at.value // 1000
                if seen is not None and us < seen:
                    continue
                seen = us
                for i, n in enumerate(counts):
                    if not pd.isna(n) and n <= 0:
                        start, _, polls = runs[i]
                        runs[i] = [us if start is None else start, us, polls + 1]
                    else:
                        close(i)
            state.update((seen, *runs[0], *runs[1]))
            state.setTimeoutTimestamp(max(seen // 1000, state.getCurrentWatermarkMs()) + stay)
        out = pd.DataFrame(done, columns=["system_id", "station_id", "kind", "start", "end", "n_obs"])
        for c in ("start", "end"):
            out[c] = pd.to_datetime(out[c].astype("int64"), unit="us")
        out["duration_minutes"] = ((out["end"] - out["start"]).dt.total_seconds() / 60).round(1)
        yield out

    return _keyed(stream, late, [BIKES, DOCKS]).groupBy(*KEYS).applyInPandasWithState(step, "system_id string, station_id string, kind string, start timestamp, end timestamp, n_obs long, duration_minutes double", "seen long, s0 long, e0 long, n0 long, s1 long, e1 long, n1 long", "append", GroupStateTimeout.EventTimeTimeout)


def drift(stream: DataFrame, *, reset: str = "1D", late: str = "10 minutes", idle: str = "7D") -> DataFrame:
    """system_id, station_id, fetched_at, cumulative_imbalance: the running sum of flows from the start of each period on. Polls
    older than the last one seen of a station change nothing and have no row."""
    stay, step = seconds(idle) * 1000, seconds(reset) * 1_000_000

    def add(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        p = _rows(pdfs)
        seen, bikes, total = state.get if state.exists else (None, None, 0)
        times, sums = [], []
        for at, now in zip(p[TIME], p[BIKES]):
            us, now = at.value // 1000, _opt(now, int)
            if seen is not None and us < seen:
                continue
            if seen is None or us // step != seen // step:
                total = 0
            if now is not None and bikes is not None:
                total += now - bikes
            times.append(at)
            sums.append(total)
            seen, bikes = us, now
        state.update((seen, bikes, total))
        state.setTimeoutTimestamp(max(seen // 1000, state.getCurrentWatermarkMs()) + stay)
        yield pd.DataFrame({"system_id": key[0], "station_id": key[1], TIME: times, "cumulative_imbalance": pd.array(sums, "Int64")})

    return _keyed(stream, late, [BIKES]).groupBy(*KEYS).applyInPandasWithState(add, f"system_id string, station_id string, {TIME} timestamp, cumulative_imbalance long", "seen long, bikes long, total long", "append", GroupStateTimeout.EventTimeTimeout)


def idle_time(vehicles: DataFrame, *, move_threshold_m: float = 50, late: str = "10 minutes", forget: str = "30D") -> DataFrame:
    """system_id, vehicle_id, fetched_at, idle_hours since the vehicle last moved more than the threshold between two polls."""
    stay = seconds(forget) * 1000

    def watch(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        p = _rows(pdfs)
        seen, since, lat, lon = state.get if state.exists else (None, None, None, None)
        times, hours = [], []
        for at, y, x in zip(p[TIME], p["lat"], p["lon"]):
            us = at.value // 1000
            if seen is not None and us < seen:
                continue
            known = lat is not None and lon is not None and not pd.isna(y) and not pd.isna(x)
            if not known or _metres(lat, lon, y, x) > move_threshold_m:
                since = us
            seen, lat, lon = us, _opt(y, float), _opt(x, float)
            times.append(at)
            hours.append((us - since) / 3.6e9)
        state.update((seen, since, lat, lon))
        state.setTimeoutTimestamp(max(seen // 1000, state.getCurrentWatermarkMs()) + stay)
        yield pd.DataFrame({"system_id": key[0], "vehicle_id": key[1], TIME: times, "idle_hours": pd.array(hours, "Float64")})

    src = vehicles.withWatermark(TIME, late).select("system_id", "vehicle_id", TIME, "lat", "lon")
    return src.groupBy("system_id", "vehicle_id").applyInPandasWithState(watch, f"system_id string, vehicle_id string, {TIME} timestamp, idle_hours double", "seen long, since long, lat double, lon double", "append", GroupStateTimeout.EventTimeTimeout)


def _metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * math.atan2(math.sqrt(a), math.sqrt(1 - a))
