"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): each end of an edge with the smallest id it can reach.

    A round takes the smallest label among a node and its neighbours and then the label of that label, so labels jump
    and rounds grow with the logarithm of a component's width. Each round is written to the shared folder; only the
    count of changed labels comes to the driver. Both sides of each join are plain tables, so Spark can split a label
    or node that many rows share.
    """
    both = written(edges.select(F.col(a).alias("id"), F.col(b).alias("to")).union(edges.select(F.col(b), F.col(a))).filter("id <> to").distinct(), "edges")
    labels = written(both.groupBy("id").agg(F.least("id", F.min("to")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("label").alias("near"))
        step = written(labels.join(near, "id").select("id", "label", F.least("label", "near").alias("next")), "labels")
        if step.filter("next < label").isEmpty():
            return step.select("id", F.col("label").alias("component"))
        heads = step.select(F.col("id").alias("next"), F.col("next").alias("jump"))
        labels = written(step.select("id", "next").join(heads, "next").select("id", F.col("jump").alias("label")), "labels")
