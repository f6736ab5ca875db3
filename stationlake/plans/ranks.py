"""Ranks and running sums over a whole table without one task that holds it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import stored


def _ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows in ranges of `order`, stored with the number of each range: ranges must stay as they are when they are read twice."""
    return stored(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))


def ranked_whole(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """rows with their rank __i by `order`, their number __n, and the running and whole sums __cum and __sum of `value`.
    Ranges are ranked in parallel; a row for each range, with what lies before it, is broadcast."""
    kept = _ranged(rows, order)
    sums = kept.groupBy("__part").agg(F.count("*").alias("c"), F.sum(value).alias("s"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    ahead = sums.select("__part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__ci"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("__cs"), F.sum("c").over(Window.partitionBy()).alias("__n"), F.sum("s").over(Window.partitionBy()).alias("__sum"))
    w = Window.partitionBy("__part").orderBy(*order)
    own = kept.withColumn("__r", F.row_number().over(w)).withColumn("__c", F.sum(value).over(Window.partitionBy("__part").orderBy("__r").rowsBetween(Window.unboundedPreceding, 0)))
    return own.join(F.broadcast(ahead), "__part").withColumns({"__i": F.col("__r") + F.col("__ci"), "__cum": F.col("__c") + F.col("__cs")}).drop("__part", "__r", "__c", "__ci", "__cs")


def step_up(rows: DataFrame, p: str, factor: Callable[[Column], Column]) -> DataFrame:
    """rows with p_adjusted: the least of p * n * factor(n) / rank over the ranks from the row's own on, 1 at most."""
    kept = stored(ranked_whole(rows, [p], p).drop("__cum", "__sum").withColumn("__q", F.col(p) * F.col("__n") * factor(F.col("__n")) / F.col("__i")).repartitionByRange(p).withColumn("__part", F.spark_partition_id()))
    least = kept.groupBy("__part").agg(F.min("__q").alias("m"))
    later = least.select("__part", F.min("m").over(Window.orderBy(F.col("__part").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("__later"))
    own = F.min("__q").over(Window.partitionBy("__part").orderBy(F.col(p).desc()).rangeBetween(Window.unboundedPreceding, 0))
    out = kept.withColumn("__own", own).join(F.broadcast(later), "__part")
    return out.withColumn("p_adjusted", F.least(F.lit(1.0), F.col("__own"), F.coalesce("__later", F.lit(1.0)))).drop("__q", "__n", "__i", "__part", "__own", "__later")
