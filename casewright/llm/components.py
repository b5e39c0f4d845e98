"""Connected components of a graph that only Spark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stage


def components(edges: DataFrame) -> DataFrame:
    """id, label (the smallest id of its component) for every end of the edges a, b.

    Each round every node points at its smallest neighbour or itself, takes what that one points at, and the graph shrinks
    to what is pointed at; the rounds' pointers, followed one after the other, are the labels. A round halves the longest
    chain at least. Tables between rounds are written; a hub's edges are reduced before they are shuffled.
    """
    e = stage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels = None
    while True:
        near = e.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(e.select(F.col("b").alias("id"), F.col("a").alias("to")))
        points = stage(near.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("to")), "cc-points")
        jumped = stage(points.alias("x").join(points.alias("y"), F.col("x.to") == F.col("y.id")).select("x.id", F.col("y.to").alias("to")), "cc-points")
        drop(points)
        if labels is None:
            labels = stage(jumped.select("id", F.col("to").alias("label")), "cc-labels")
        else:
            old = labels
            labels = stage(old.join(jumped.withColumnRenamed("id", "at"), F.col("label") == F.col("at"), "left").select("id", F.coalesce("to", "label").alias("label")), "cc-labels")
            drop(old)
        a, b = jumped.select(F.col("id").alias("a"), F.col("to").alias("pa")), jumped.select(F.col("id").alias("b"), F.col("to").alias("pb"))
        rest = stage(e.join(a, "a").join(b, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
        drop(e, jumped)
        e = rest
        if e.isEmpty():
            return labels
