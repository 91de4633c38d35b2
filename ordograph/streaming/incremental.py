"""Running degree and bandwidth of a growing edge stream; both only grow with insertions, so plain aggregations do."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def running_degree(edges: DataFrame) -> DataFrame:
    ends = edges.select("instance", F.explode(F.array("u", "v")).alias("v"))
    return ends.groupBy("instance", "v").agg(F.count("*").alias("degree"))


def running_bandwidth(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """For a fixed labelling; edges may be a stream, labels are a table."""
    one = edges.join(labels.select("instance", "solution", F.col("v").alias("u"), F.col("label").alias("fu")), ["instance", "u"])
    both = one.join(labels.select("instance", "solution", "v", F.col("label").alias("fv")), ["instance", "solution", "v"])
    return both.groupBy("instance", "solution").agg(F.max(F.abs(F.col("fu") - F.col("fv"))).alias("bandwidth"))
