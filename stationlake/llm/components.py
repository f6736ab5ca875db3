"""Connected components by alternating large-star and small-star steps; every step is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deleted, spread_join, stored


FEW = 10_000  # edges of which any number at one key is little for a task


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    near = spread_join(both, low, "u", "n", n) if n > FEW else both.join(low.drop("n"), "u")
    if large:
        return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (id, root) for every id in a link; root: the smallest id it is connected with, which has a row too."""
    kept: list[str] = []
    edges = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges", kept)
    mark = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
    now = mark(edges)
    while now[0]:
        before = now
        edges = stored(_star(_star(edges, True, before[0]), False, before[0]), "edges", kept)
        deleted(links.sparkSession, kept.pop(0))
        now = mark(edges)
        if now == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
