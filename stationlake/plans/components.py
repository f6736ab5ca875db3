"""Connected components by smallest labels, with the labels written to the shared folder between rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession) -> str:
    """A new folder in the one that all executors share, spark.checkpoint.dir; only a local session may do without."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = "/tmp/stationlake-checkpoints"
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a table; its lineage ends there."""
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable. nodes: id; edges: a, b, in any direction, repeats and loops allowed.
    Each round takes the smallest label of the neighbours and then the label's own label, so paths halve."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = stored(nodes.select("id", F.col("id").alias("component")).distinct())
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.id == near.a, "left").select("id", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("component").alias("top"))
        step = stored(step.join(jump, "new", "left").select("id", "old", F.least("new", "top").alias("component")))
        labels = step.select("id", "component")
        if step.where("component <> old").isEmpty():
            return labels
