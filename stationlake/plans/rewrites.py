"""Range, nearest-neighbour and as-of joins as equi-joins on buckets with an exact residual condition."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import EARTH_M, haversine_m
from .components import stored


def _cells(lat: Column, lon: Column, radius_m: float, reach: int = 0) -> Column:
    """Grid cells of a point, with neighbours up to `reach` away. Rows are `step` degrees high; each row's cells are as wide
    as the radius at the row's far edge from the equator needs, so any two points within it lie in adjacent cells of a row."""
    step = math.degrees(radius_m / EARTH_M) * 1.0001
    row = F.floor(lat / step)
    rows = F.array(*(row + i for i in range(-reach, reach + 1)))

    def row_cells(r: Column) -> Column:
        edge = F.least(F.greatest(F.abs(r), F.abs(r + 1)) * step + step, F.lit(89.9))
        n = F.greatest(F.floor(F.lit(360.0) * F.cos(F.radians(edge)) / step), F.lit(1))
        cell = F.floor(F.pmod(lon, F.lit(360.0)) / 360 * n)
        return F.transform(F.array(*(F.lit(i) for i in range(-reach, reach + 1))), lambda d: F.struct(r.cast("long").alias("r"), F.pmod(cell + d, n).cast("long").alias("c")))

    return F.array_distinct(F.flatten(F.transform(rows, row_cells)))


def range_join(a: DataFrame, b: DataFrame, radius_m: float, a_lat: str = "lat", a_lon: str = "lon", b_lat: str = "lat", b_lon: str = "lon", a_prefix: str = "a_", b_prefix: str = "b_") -> DataFrame:
    """All pairs within radius_m (inclusive) with their distance_m; columns get the prefixes. Points go to their own cell on
    side a and to the cells around on side b; the great-circle distance decides. NULL coordinates match nothing. A cell with
    very many points is a skewed key, which adaptive execution splits; callers that only count join places instead of points."""
    left = a.select(*(F.col(c).alias(a_prefix + c) for c in a.columns)).withColumn("__cell", F.explode(_cells(F.col(a_prefix + a_lat), F.col(a_prefix + a_lon), radius_m)))
    right = b.select(*(F.col(c).alias(b_prefix + c) for c in b.columns)).withColumn("__cell", F.explode(_cells(F.col(b_prefix + b_lat), F.col(b_prefix + b_lon), radius_m, 1)))
    d = haversine_m(F.col(a_prefix + a_lat), F.col(a_prefix + a_lon), F.col(b_prefix + b_lat), F.col(b_prefix + b_lon))
    return left.join(right, "__cell").drop("__cell").withColumn("distance_m", d).where(F.col("distance_m") <= radius_m)


def first_radius(points: DataFrame, k: int, lat: str, lon: str) -> float:
    """Metres within which about half the points have k others, by how many lie in a typical cell of a hundredth of a degree."""
    cells = points.groupBy(F.floor(F.col(lat) * 100), F.floor(F.col(lon) * 100)).count()
    here = cells.agg(F.percentile_approx("count", 0.5)).first()[0] or 1
    return max(50.0, 1500.0 * math.sqrt(k / (math.pi * here)))


def knn(a: DataFrame, b: DataFrame, k: int, a_id: str, b_id: str, lat: str = "lat", lon: str = "lon", exclude_self: bool = True, start_m: float | None = None, partition: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest rows of b for each row of a: (a_id, b_id, distance_m, rank). Radii grow from start_m, else from what the
    density of b suggests; a point is done once k neighbours lie within the radius, so distances are exact. What a round
    found and the points that it left are stored, so no round is computed twice. Self is left out by id, ties go to the
    smaller id. partition: columns that must be equal on both sides. Points with fewer than k partners get all of them."""
    a = a.select(*partition, F.col(a_id).alias("a_id"), lat, lon).where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    b = b.select(*partition, F.col(b_id).alias("b_id"), lat, lon).where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    here = Window.partitionBy(*partition, lat, lon).orderBy("b_id")  # of many points at one place the first k + 1 do
    b = b.withColumn("__n", F.row_number().over(here)).where(F.col("__n") <= k + 1).drop("__n")
    same = [F.col(f"a_{p}").eqNullSafe(F.col(f"b_{p}")) for p in partition]
    keys = [*(f"a_{p}" for p in partition), "a_a_id"]
    w = Window.partitionBy(*keys).orderBy("distance_m", "b_b_id")
    out, radius = None, start_m or first_radius(b, k, lat, lon)
    left = a
    while True:
        last = radius > math.pi * EARTH_M
        pairs = range_join(left, b, radius, lat, lon, lat, lon)
        for c in same:
            pairs = pairs.where(c)
        if exclude_self:
            pairs = pairs.where("a_a_id <> b_b_id")
        found = stored(pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*keys, "b_b_id", "distance_m", "rank"))
        full = found.where(F.col("rank") == k).select(*keys)
        take = found if last else found.join(full, keys, "left_semi")
        out = take if out is None else out.union(take)
        if last:
            break
        cond = F.col("a_id") == F.col("a_a_id")
        for p in partition:
            cond = cond & F.col(p).eqNullSafe(F.col(f"a_{p}"))
        left = stored(left.join(full, cond, "left_anti"))
        if left.isEmpty():
            break
        radius = radius * 8 if radius < 250_000 else 1.01 * math.pi * EARTH_M
    return out.toDF(*partition, "a_id", "b_id", "distance_m", "rank")


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, tolerance_s: int, direction: str = "nearest", by: tuple[str, ...] = ()) -> DataFrame:
    """left with the right row nearest in time (backward, forward or nearest) within the tolerance, NULLs if none. A tie goes
    backward; of equal right times the largest row counts. Both sides meet in time buckets as wide as the tolerance, so work
    is parallel without `by` too."""
    if direction not in ("nearest", "backward", "forward"):
        raise ValueError(direction)
    step = max(1, tolerance_s)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    names = [c for c in right.columns if c not in by and c != right_time]
    r = right.groupBy(*by, right_time).agg(F.max(F.struct(*(F.col(c) for c in names))).alias("__v")) if names else right.select(*by, right_time).distinct().withColumn("__v", F.struct(F.lit(1).alias("one")))
    r = r.select(*by, F.col("__v"), micros(right_time).alias("__rt"), F.col(right_time).alias("__r_time")).withColumn("__b", F.explode(F.array(*(F.floor(F.col("__rt") / (step * 1_000_000)) + i for i in (-1, 0, 1)))))
    keyed = left.withColumn("__lt", micros(left_time))
    probe = keyed.select("__lt", *by).distinct().withColumn("__b", F.floor(F.col("__lt") / (step * 1_000_000)))  # rows of equal keys have one answer; numbers given to rows would change when a shuffle is read again
    d = F.col("__rt") - F.col("__lt")
    ok = F.abs(d) <= tolerance_s * 1_000_000
    if direction != "nearest":
        ok = ok & (d <= 0 if direction == "backward" else d >= 0)
    best = probe.join(r, [*by, "__b"]).where(ok).groupBy("__lt", *by).agg(F.min_by(F.struct("__v", "__r_time"), F.struct(F.abs(d), d)).alias("__m"))
    out = keyed.join(best, ["__lt", *by], "left")
    cols = [F.col(c) for c in left.columns] + [F.col("__m.__r_time").alias(right_time if right_time not in left.columns else f"{right_time}_right")]
    return out.select(*cols, *(F.col(f"__m.__v.{c}").alias(c if c not in left.columns else f"{c}_right") for c in names))
