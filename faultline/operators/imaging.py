"""Masks and wafer maps held as rows (grid_id, row, col, value): statistics, descriptors, overlap, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected
from .lineage import cut

#: Wafer patterns in their spellings, and the location and morphology that each implies.
PATTERNS = {"near_full": "nearfull", "edgeloc": "edge_loc", "edgering": "edge_ring", "centre": "center", "local": "loc"}
PATTERN_LOCATION = {"nearfull": "wafer_surface", "center": "center", "edge_loc": "edge", "edge_ring": "edge", "loc": "local"}
PATTERN_MORPHOLOGY = {"nearfull": "dense_particles", "edge_ring": "ring", "donut": "ring", "scratch": "linear", "random": "scattered", "center": "clustered", "loc": "clustered", "edge_loc": "clustered"}


def mask_location(x: Column, y: Column) -> Column:
    """edge within a fifth of the border, else surface; null without a centroid."""
    inner = x.between(0.2, 0.8) & (x != 0.2) & (x != 0.8) & y.between(0.2, 0.8) & (y != 0.2) & (y != 0.8)
    return F.when(x.isNull() | y.isNull(), None).when(inner, "surface").otherwise("edge")


def mask_morphology(eccentricity: Column, aspect: Column, components: Column, ratio: Column) -> Column:
    return (
        F.when((eccentricity >= 0.8) | (aspect >= 3.0), "linear")
        .when(components >= 4, "scattered")
        .when(ratio >= 0.35, "dense")
        .when(ratio > 0, "spot")
    )


def canonical_pattern(c: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(c)), "[- ]", "_")
    out = t
    for spelling, name in PATTERNS.items():
        out = F.when(t == spelling, F.lit(name)).otherwise(out)
    return F.nullif(out, F.lit(""))


def _by(pattern: Column, table: dict[str, str], otherwise: Column) -> Column:
    out = otherwise
    for k, v in table.items():
        out = F.when(pattern == k, F.lit(v)).otherwise(out)
    return out


def radial(x: Column, y: Column) -> Column:
    """Distance from the middle, 1 at the middle of an edge."""
    return F.sqrt((x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5)) / 0.5


def wafer_location(pattern: Column, density: Column, x: Column, y: Column) -> Column:
    r = radial(x, y)
    drawn = F.when(density >= 0.45, "wafer_surface").when(r >= 0.6, "edge").when(r <= 0.25, "center").when(r.isNotNull(), "local")
    return _by(pattern, PATTERN_LOCATION, drawn)


def wafer_morphology(pattern: Column, density: Column, components: Column) -> Column:
    drawn = F.when(density >= 0.45, "dense_particles").when(components >= 4, "scattered").when(components <= 2, "clustered")
    return _by(pattern, PATTERN_MORPHOLOGY, drawn)


def mask_stats(cells: DataFrame) -> DataFrame:
    """Area, ratio, bounding box (ends exclusive), centroid, eccentricity of each grid's positive cells."""
    on = F.col("value") > 0
    x, y = F.when(on, F.col("col").cast("double")), F.when(on, F.col("row").cast("double"))
    shape = cells.groupBy("grid_id").agg(
        F.sum(on.cast("long")).alias("area"),
        F.min(F.when(on, F.col("col"))).alias("x1"),
        (F.max(F.when(on, F.col("col"))) + 1).alias("x2"),
        F.min(F.when(on, F.col("row"))).alias("y1"),
        (F.max(F.when(on, F.col("row"))) + 1).alias("y2"),
        F.avg(x).alias("cx"),
        F.avg(y).alias("cy"),
        F.avg(x * x).alias("xx"),
        F.avg(y * y).alias("yy"),
        F.avg(x * y).alias("xy"),
        ((F.max("row") + 1) * (F.max("col") + 1)).alias("pixels"),
    )
    sxx, syy, sxy = F.col("xx") - F.col("cx") * F.col("cx"), F.col("yy") - F.col("cy") * F.col("cy"), F.col("xy") - F.col("cx") * F.col("cy")
    half = F.sqrt((sxx - syy) * (sxx - syy) / 4 + sxy * sxy)
    large, small = (sxx + syy) / 2 + half, (sxx + syy) / 2 - half
    eccentricity = F.when(F.col("area") > 0, F.when(large > 1e-12, F.sqrt(F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0.0), small) / large))).otherwise(0.0))
    return shape.select("grid_id", "area", (F.col("area") / F.col("pixels")).alias("area_ratio"), "x1", "y1", "x2", "y2", "cx", "cy", eccentricity.alias("eccentricity"))


def wafer_descriptors(cells: DataFrame) -> DataFrame:
    """Dies, failed dies (value above 1 if the map has any such, else above 0), density, centroid, mean radius."""
    top = F.max("value").over(Window.partitionBy("grid_id"))
    failed = F.when(F.col("_top") > 1, F.col("value") > 1).otherwise(F.col("value") > 0)
    rows = cells.withColumn("_top", top).withColumn("failed", failed)
    size = rows.groupBy("grid_id").agg(
        F.sum((F.col("value") > 0).cast("long")).alias("die_count"),
        F.sum(F.col("failed").cast("long")).alias("failed_count"),
        F.avg(F.when(F.col("failed"), F.col("col"))).alias("cx"),
        F.avg(F.when(F.col("failed"), F.col("row"))).alias("cy"),
        F.max("row").alias("h"),
        F.max("col").alias("w"),
    )
    x = F.when(F.col("w") > 0, F.col("cx") / F.col("w")).otherwise(F.lit(0.5))
    y = F.when(F.col("h") > 0, F.col("cy") / F.col("h")).otherwise(F.lit(0.5))
    density = F.when(F.col("die_count") > 0, F.col("failed_count") / F.col("die_count")).otherwise(0.0)
    return size.select("grid_id", "die_count", "failed_count", density.alias("density"), x.alias("x_norm"), y.alias("y_norm"))


def threshold_masks(cells: DataFrame, threshold: float, least_share: float | None = None) -> DataFrame:
    """grid_id, row, col, value 1 from the threshold on and 0 below it; a mask that covers less than least_share of its grid's cells is empty.

    A null value is below any threshold. Shares are counted first and joined, so a grid of any size is never gathered.
    """
    on = cells.withColumn("value", F.coalesce(F.col("value") >= threshold, F.lit(False)).cast("int"))
    if least_share is None:
        return on.select("grid_id", "row", "col", "value")
    share = on.groupBy("grid_id").agg(F.avg("value").alias("_share"))
    return on.join(share, "grid_id").select("grid_id", "row", "col", F.when(F.col("_share") < least_share, 0).otherwise(F.col("value")).alias("value"))


def components(cells: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """grid_id, components: groups of positive cells that touch along an edge.

    Runs of neighbouring cells of a row are vertices, linked where a cell lies below another; grids of any size, spread over the cluster.
    rounds: gets the number of rounds of `connected`.
    """
    nth = F.row_number().over(Window.partitionBy("grid_id", "row").orderBy("col"))
    on = cells.where("value > 0 and grid_id is not null").select("grid_id", "row", "col").distinct()
    own = Window.partitionBy("grid_id", "row", F.col("col") - F.col("_nth"))
    runs = cut(on.withColumn("_nth", nth).select("grid_id", "row", "col", F.struct("grid_id", "row", F.min("col").over(own).alias("col")).alias("run")))
    below = runs.select("grid_id", (F.col("row") - 1).alias("row"), "col", F.col("run").alias("b"))
    links = runs.withColumnRenamed("run", "a").join(below, ["grid_id", "row", "col"]).select("a", "b").distinct()
    reached = connected(runs.select(F.col("run").alias("id")).distinct(), links, rounds)
    return reached.where("id = root").groupBy(F.col("id.grid_id").alias("grid_id")).agg(F.count("*").alias("components"))


def iou(left: DataFrame, right: DataFrame) -> DataFrame:
    """Overlap of the positive cells of two sets of grids; 1 where both are empty."""
    both = left.where("value > 0").select("grid_id", "row", "col", F.lit(1).alias("a")).join(right.where("value > 0").select("grid_id", "row", "col", F.lit(1).alias("b")), ["grid_id", "row", "col"], "full")
    counts = both.groupBy("grid_id").agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("shared"), F.count("*").alias("any"))
    ids = left.select("grid_id").union(right.select("grid_id")).distinct()
    return ids.join(counts, "grid_id", "left").select("grid_id", F.coalesce(F.col("shared") / F.col("any"), F.lit(1.0)).alias("iou"))


def best_thresholds(scored: DataFrame, by: str) -> DataFrame:
    """For each group the score from which F1 of (score, positive) is largest; on ties the larger score.

    Scores are summed up first, so a group is as many rows as it has distinct scores. Groups of one class have none.
    """
    at = scored.groupBy(by, "score").agg(F.sum("positive").alias("p"), F.count("*").alias("n"))
    down = Window.partitionBy(by).orderBy(F.desc("score"))
    whole = Window.partitionBy(by)
    run = at.withColumns({"tp": F.sum("p").over(down), "predicted": F.sum("n").over(down), "all_p": F.sum("p").over(whole), "all_n": F.sum("n").over(whole)})
    f1 = 2 * F.col("tp") / (F.col("predicted") + F.col("all_p"))
    ranked = run.where("all_p > 0 and all_p < all_n").withColumn("f1", F.round(f1, 9))
    return ranked.groupBy(by).agg(F.max_by("score", F.struct("f1", "score")).alias("threshold"), F.max("f1").alias("f1"))


def threshold_maps(cells: DataFrame, threshold: Column, min_area_ratio: float | None = None) -> DataFrame:
    """Cells of anomaly maps with value 1 from the threshold on, else 0; a map whose marked share is below min_area_ratio is cleared."""
    on = (F.col("value") >= threshold).cast("int")
    if min_area_ratio is None:
        return cells.withColumn("value", on)
    marked = cells.withColumn("_on", on)
    share = F.avg("_on").over(Window.partitionBy("grid_id"))
    return marked.withColumn("value", F.when(share < min_area_ratio, 0).otherwise(F.col("_on"))).drop("_on")


def map_quantiles(cells: DataFrame, by: str, count: int = 512) -> DataFrame:
    """by, place, value: `count` evenly spread quantiles of the values of each group, first and last included; exact, from counts of distinct values."""
    steps = [i / (count - 1) for i in range(count)]
    found = cells.groupBy(by).agg(F.percentile("value", F.array(*[F.lit(x) for x in steps])).alias("q"))
    return found.select(by, F.posexplode("q").alias("place", "value"))


def detection_summary(records: DataFrame, by: list[str]) -> DataFrame:
    """Counts by label and prediction, ranges of score and area, and the mean overlap, of records: label, score, anomalous, area, iou.

    The label `good`, in any case, is that of a sound object; a missing label is that of a defect.
    """
    good = F.coalesce(F.lower("label") == "good", F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    said = F.col("anomalous")
    return records.groupBy(*by).agg(
        F.count("*").alias("records"), n(~good).alias("defects"), n(good).alias("good"), n(~good & said).alias("defects_anomalous"), n(~good & ~said).alias("defects_normal"), n(good & said).alias("good_anomalous"), n(good & ~said).alias("good_normal"),
        F.min("score").alias("score_min"), F.max("score").alias("score_max"), F.min("area").alias("area_min"), F.max("area").alias("area_max"), F.round(F.avg("iou") + 1e-12, 6).alias("mean_iou"), F.count("iou").alias("ious"),
    )
