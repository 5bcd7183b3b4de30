"""An extension beyond batch: scoring of a stream of points with fixed centers, and running statistics of their clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.kmeans import assign


def scored(points: DataFrame, centers) -> DataFrame:
    """id, x, k, d2 of each point of a stream (or table): stateless, so that any output mode will do."""
    return assign(points, centers)


def drift(points: DataFrame, centers, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """For each window of event time and cluster, how many points and their mean squared distance. Points that are later than late don't count; a window is complete when the watermark has passed it."""
    from tessera.functions.vectors import nearest

    found = points.withColumn("_n", nearest(F.col("x"), centers)).select(F.col(time), F.col("_n.k").alias("k"), F.col("_n.d2").alias("d2"))
    return found.withWatermark(time, late).groupBy(F.window(time, window), "k").agg(F.count("*").alias("n"), F.avg("d2").alias("mean_d2"))
