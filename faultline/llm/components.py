"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _state(edges: DataFrame):
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """v and c for every end of an edge (u, v, integers): c is the smallest end that v reaches.

    Stars are contracted in turn: each node is tied to the smallest of its neighbours, first the larger neighbours,
    then the smaller ones, until every node hangs on its smallest. The rounds grow with the logarithm of the longest
    path. Minima are pre-aggregated before the shuffle; each round is written out, so its lineage is one round long.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while (state := _state(now)) != before and state[0]:
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    roots = now.select(F.col("v").alias("c")).distinct().select(F.col("c").alias("v"), "c")
    return now.select(F.col("u").alias("v"), F.col("v").alias("c")).unionByName(roots)
