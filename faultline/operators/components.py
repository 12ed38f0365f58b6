"""Connected components in a number of rounds that grows with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def connected(vertices: DataFrame, edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """id, root: the smallest id that each vertex reaches, itself included.

    vertices: id, of any type that can be compared. edges: a, b, either way round, both among the vertices. Each round a vertex, and the one
    that it points to, are pointed to the smallest grandparent among its neighbours, then to their own grandparent, so chains halve.
    Only minima are aggregated, so a vertex with many neighbours is summed up before rows move. rounds: gets the number of rounds.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    now, n = cut(vertices.select("id").distinct().withColumn("root", F.col("id"))), 0
    while True:
        n += 1
        up = now.select(F.col("id").alias("root"), F.col("root").alias("top"))
        known = cut(now.join(up, "root").select("id", "root", "top"))
        near = both.join(known.select(F.col("id").alias("b"), "top"), "b").groupBy("a").agg(F.min("top").alias("best")).withColumnRenamed("a", "id")
        seen = known.join(near, "id", "left").select("id", "root", "top", F.coalesce(F.least("best", "top"), "top").alias("best"))
        hooked = seen.where("best < root").select(F.col("root").alias("id"), F.col("best").alias("root"))
        new = seen.select("id", F.col("best").alias("root")).unionByName(hooked).groupBy("id").agg(F.min("root").alias("root"))
        now = cut(new.join(now.withColumnRenamed("root", "_old"), "id").select("id", "root", (F.col("root") != F.col("_old")).alias("_moved")))
        if now.where("_moved").isEmpty():
            if rounds is not None:
                rounds.append(n)
            return now.select("id", "root")
        now = now.select("id", "root")
