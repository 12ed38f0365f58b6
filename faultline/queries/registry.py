"""Pairs each query with the SQL that says the same."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import SparkSession

from ..operators.lineage import SWEPT

#: Rows of the largest table for each partition of a shuffle.
ROWS = 250_000


def sized(spark: SparkSession, sf_dir: str) -> SparkSession:
    """A session whose shuffles have partitions by the size of the largest table, so that a task's share does not grow with it; the given one if that has enough.

    The given session's settings are left alone: the other one starts with what is set in it. The count comes from Parquet's footers.
    """
    n = -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // ROWS)
    if n <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return spark
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key) and own.conf.get(key, None) != value:
            own.conf.set(key, value)
    own.conf.set("spark.sql.shuffle.partitions", n)
    own.conf.set(SWEPT, "true")
    own.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionNum", n)  # small ones are still merged, but not into a few large ones
    return own


def registry():
    queries: dict = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = wraps(f)(lambda spark, sf_dir: f(sized(spark, sf_dir), sf_dir))
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return queries, oracle, query
