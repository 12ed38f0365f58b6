"""Process series as rows (fault, run, sample, channels): windows, profiles, contributions, dynamic features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import numbered


def windows(series: DataFrame, size: int, runs: int) -> DataFrame:
    """The first `size` samples of the first `runs` runs of each fault to complete so many, by the row that completes them.

    Runs that never complete are left out. series has a total order in `seq`.
    """
    w = Window.partitionBy("fault", "run").orderBy("sample")
    cut = series.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= size)
    done = cut.groupBy("fault", "run").agg(F.count("*").alias("_c"), F.max("seq").alias("_done")).where(F.col("_c") == size)
    place = F.row_number().over(Window.partitionBy("fault").orderBy("_done", "run"))
    chosen = done.withColumn("place", place).where(F.col("place") <= runs).select("fault", "run", F.col("place").cast("long").alias("place"))
    return cut.drop("_n").join(chosen, ["fault", "run"])


def stride(series: DataFrame, every: int) -> DataFrame:
    """Every so many rows of the fault-free data, from the first, counted over all of it in the order of `seq`."""
    return numbered(series, ["seq"], "_i").where((F.col("_i") - 1) % every == 0).drop("_i")


def long(series: DataFrame, channels: list[str]) -> DataFrame:
    keys = [c for c in series.columns if c not in channels]
    return series.unpivot(keys, channels, "channel", "value").where("value is not null")


def profile(rows: DataFrame) -> DataFrame:
    """channel, mean, scale of long rows; a spread of nothing counts as 1."""
    spread = F.stddev_samp("value")
    return rows.groupBy("channel").agg(F.avg("value").alias("mean"), F.when(spread > 1e-12, spread).otherwise(1.0).alias("scale"), F.count("*").alias("n"))


def covariance(series: DataFrame, channels: list[str]) -> DataFrame:
    """a, b, covariance of each pair of channels."""
    pairs = [(a, b) for i, a in enumerate(channels) for b in channels[i:]]
    flat = series.agg(*[F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("covariance")) for a, b in pairs]))
    return flat.select(rows.alias("r")).select("r.*")


def standardize(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """Adds z; the profile has a row for each channel and is broadcast."""
    return rows.join(F.broadcast(fitted), "channel").withColumn("z", (F.col("value") - F.col("mean")) / F.col("scale"))


def contributions(z: DataFrame, by: list[str]) -> DataFrame:
    """Share of each channel in the mean square of z within each group; of the mean size of z, or equal, where there is none."""
    each = z.groupBy(*by, "channel").agg(F.avg(F.col("z") * F.col("z")).alias("sq"), F.avg(F.abs("z")).alias("abs"), F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    out = each.withColumns({"tsq": F.sum("sq").over(w), "tabs": F.sum("abs").over(w), "channels": F.count("*").over(w)})
    share = F.when(F.col("tsq") > 1e-12, F.col("sq") / F.col("tsq")).when(F.col("tabs") > 1e-12, F.col("abs") / F.col("tabs")).otherwise(1.0 / F.col("channels"))
    energy = F.when(F.col("tsq") > 1e-12, F.col("tsq")).otherwise(F.lit(0.0))
    return out.select(*by, "channel", share.alias("share"), energy.alias("energy"), (energy / (energy + 1)).alias("confidence"))


def principal_axes(series: DataFrame, channels: list[str], count: int) -> np.ndarray:
    """The first axes of the standardized fault-free rows, from their correlation matrix (channels squared, on the driver)."""
    cov = {(r["a"], r["b"]): r["covariance"] or 0.0 for r in covariance(series, channels).collect()}
    m = np.array([[cov.get((a, b), cov.get((b, a), 0.0)) for b in channels] for a in channels])
    scale = np.sqrt(np.where(np.diag(m) > 1e-24, np.diag(m), 1.0))
    values, axes = np.linalg.eigh(m / np.outer(scale, scale))
    return axes[:, np.argsort(-values)[: max(0, min(count, len(channels) - 1))]]


def residual(wide_z: DataFrame, channels: list[str], axes: np.ndarray) -> DataFrame:
    """The z columns less their projection on the axes, as column arithmetic."""
    keep = np.eye(len(channels)) - axes @ axes.T
    out = [sum((F.col(b) * float(keep[i, j]) for j, b in enumerate(channels)), F.lit(0.0)).alias(a) for i, a in enumerate(channels)]
    return wide_z.select(*[c for c in wide_z.columns if c not in channels], *out)


def dynamic_features(z: DataFrame, by: list[str]) -> DataFrame:
    """Mean, slope from first to last, mean absolute step and spread of z for each channel of a group."""
    order = Window.partitionBy(*by, "channel").orderBy("sample")
    stepped = z.withColumn("step", F.abs(F.col("z") - F.lag("z").over(order)))
    out = stepped.groupBy(*by, "channel").agg(
        F.avg("z").alias("mean"),
        ((F.max_by("z", "sample") - F.min_by("z", "sample")) / F.greatest(F.lit(1), F.count("*") - 1)).alias("slope"),
        F.coalesce(F.avg("step"), F.lit(0.0)).alias("osc"),
        F.stddev_pop("z").alias("std"),
    )
    return out.unpivot([*by, "channel"], ["mean", "slope", "osc", "std"], "statistic", "value").withColumn("value", F.round(F.col("value") + 1e-12, 6))


def top_variables(shares: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k channels of each group with the largest share, ties by name: rank."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("share", 9)), "channel")
    return shares.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def top_features(features: DataFrame, by: list[str], limit: int = 6) -> DataFrame:
    """The largest features in size, ties by name; those of no size are left out."""
    named = features.withColumn("feature_id", F.concat_ws("__", "channel", "statistic")).where(F.abs("value") > 1e-9)
    w = Window.partitionBy(*by).orderBy(F.desc(F.abs("value")), "feature_id")
    return named.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit)
