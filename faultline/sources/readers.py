"""Scans: graph CSV, producer records, evidence JSON, wafer tables, process series, images, texts, artifacts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bad_float, bool_cell, float_cell, text_list

#: Columns of graph files; what an edge may have besides, with its type.
NODE_COLUMNS = ("id", "name", "label", "scenario", "aliases", "description")
EDGE_COLUMNS = ("head", "relation", "tail", "scenario", "source", "evidence", "confidence", "weight", "review_status", "feedback_count", "accepted_count", "rejected_count")
EDGE_NUMBERS = ("confidence", "weight", "feedback_count", "accepted_count", "rejected_count")
EDGE_EXTRA = {"rca_score": 0.0, "edge_weight": None, "support_count": 0.0, "attenuation": 1.0}
EDGE_FLAGS = ("propagation_enabled",)
TEXT_SUFFIXES = ("csv", "html", "json", "jsonl", "md", "txt")

OBSERVATION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("obs_id", "facet", "name", "display_name", "value", "value_type", "unit", "direction")]
    + [T.StructField("confidence", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in ("source_ref", "raw_ref", "time_window", "metadata")]
)
EVIDENCE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("case_id", "dataset", "source", "object", "anomaly_type", "location", "morphology", "timestamp")]
    + [T.StructField("severity", T.DoubleType()), T.StructField("confidence", T.DoubleType())]
    + [
        T.StructField(
            "raw_evidence",
            T.StructType(
                [T.StructField("image_region", T.StringType()), T.StructField("heatmap_path", T.StringType()), T.StructField("variables", T.ArrayType(T.StringType())), T.StructField("variable_contributions", T.MapType(T.StringType(), T.DoubleType())), T.StructField("log_events", T.ArrayType(T.StringType())), T.StructField("description", T.StringType()), T.StructField("extra", T.StringType())]
            ),
        ),
        T.StructField("observations", T.ArrayType(OBSERVATION)),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def require(df: DataFrame, columns, name: str) -> DataFrame:
    """The frame; an error that lists the missing columns in order if there are any."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name}: missing columns {', '.join(missing)}")
    return df


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def _many(spark, paths, columns, skip_missing):
    """All files as text cells, each row with its file's place; a file that is absent is an error unless it may be skipped."""
    out = None
    for i, path in enumerate([paths] if isinstance(paths, str) else paths):
        if skip_missing and not _exists(spark, path):
            continue
        one = require(_csv(spark, path), columns, path)
        one = one.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in one.columns], F.lit(i).alias("file_order"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError("no graph file is there")
    return out


def read_nodes(spark: SparkSession, paths, skip_missing: bool = False) -> DataFrame:
    df = _many(spark, paths, NODE_COLUMNS, skip_missing)
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in NODE_COLUMNS if c != "aliases"], text_list(F.col("aliases")).alias("aliases"), "file_order")


def read_edges(spark: SparkSession, paths, skip_missing: bool = False) -> DataFrame:
    """Edges with every optional column, defaults where a file lacks it; bad_cells names cells that should be numbers."""
    df = _many(spark, paths, EDGE_COLUMNS, skip_missing)
    for c in (*EDGE_EXTRA, *EDGE_FLAGS):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    wrong = F.array_compact(F.array(*[F.when(bad_float(F.col(c)), F.lit(c)) for c in (*EDGE_NUMBERS, *EDGE_EXTRA)]))
    numbers = [float_cell(F.col(c)).alias(c) for c in EDGE_NUMBERS] + [float_cell(F.col(c), d).alias(c) for c, d in EDGE_EXTRA.items()]
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in EDGE_COLUMNS if c not in EDGE_NUMBERS]
    out = df.select(*texts, *numbers, *[bool_cell(F.col(c)).alias(c) for c in EDGE_FLAGS], "file_order", wrong.alias("bad_cells"))
    return out.withColumn("edge_id", F.concat_ws("|", "head", "relation", "tail", "scenario"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Producer records: .jsonl, .csv, or .json holding a list or an object with a list under `records`."""
    if path.endswith(".jsonl"):
        return spark.read.json(path)
    if path.endswith(".csv"):
        return _csv(spark, path)
    df = spark.read.option("multiLine", True).json(path)
    return df.select(F.explode("records").alias("r")).select("r.*") if df.columns == ["records"] else df


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Evidence files; valid: parsed, with case and dataset, and confidences within 0 to 1."""
    df = spark.read.schema(EVIDENCE).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    unit = lambda c: F.col(c).isNull() | F.col(c).between(0, 1)
    good = F.col("_corrupt_record").isNull() & F.col("case_id").isNotNull() & F.col("dataset").isin("mvtec", "tep", "wafer") & unit("confidence") & unit("severity")
    return df.withColumn("valid", good)


def read_wafers(spark: SparkSession, path: str) -> DataFrame:
    """A wafer table: csv, json, jsonl or parquet by suffix; a pickle is read on the driver and must be trusted."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("pkl", "pickle"):
        import pandas as pd

        return spark.createDataFrame(pd.read_pickle(path))
    return spark.read.parquet(path) if suffix == "parquet" else read_records(spark, path)


def wafer_cells(df: DataFrame, key: str, column: str) -> DataFrame:
    """grid_id, row, col, value of maps that are arrays of rows; rows may differ in length."""
    rows = df.select(F.col(key).alias("grid_id"), F.posexplode(column).alias("row", "cells"))
    return rows.select("grid_id", "row", F.posexplode("cells").alias("col", "value"))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """faultNumber, simulationRun, sample and the channels, xmeas before xmv, each by number; seq orders the rows as the files have them: by file, block and place in it."""
    df = require(_csv(spark, path), ("faultNumber", "simulationRun", "sample"), path)
    found = sorted((m[1] != "xmeas", int(m[2]), c) for c in df.columns if (m := re.fullmatch(r"(xmeas|xmv)_(\d+)", c)))
    if not found:
        raise ValueError(f"{path}: no channel")
    ids = [F.col(c).cast("int").alias(a) for c, a in (("faultNumber", "fault"), ("simulationRun", "run"), ("sample", "sample"))]
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.select(*ids, *[F.col(c).cast("double") for _, _, c in found], place.alias("seq"))


SPLITS = ("train", "test", "ground_truth")


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """path, object, split, defect, stem of images under object/split/defect/ or object/defect/ (split: test), with the path of the mask of the same stem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,jpg,jpeg,bmp}").load(root).select("path")
    part = lambda i: F.element_at(F.split("path", "/"), i)
    nested = part(-3).isin(*SPLITS)
    named = files.select("path", F.when(nested, part(-4)).otherwise(part(-3)).alias("object"), F.when(nested, part(-3)).otherwise("test").alias("split"), part(-2).alias("defect"), F.regexp_replace(part(-1), r"(_mask)?\.[^.]+$", "").alias("stem"))
    masks = named.where("split = 'ground_truth'").select("object", "defect", "stem", F.col("path").alias("mask_path"))
    return named.where("split <> 'ground_truth'").join(masks, ["object", "defect", "stem"], "left")


def read_texts(spark: SparkSession, roots: str | list[str], limit: int | None = None) -> DataFrame:
    """path and text of source files below folders, whole, each file once; with a limit so many, the first by path."""
    glob = "*.{" + ",".join(TEXT_SUFFIXES) + "}"
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(roots, wholetext=True)
    out = df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).dropDuplicates(["path"])
    return out if limit is None else out.orderBy("path").limit(limit)


def read_artifact(spark: SparkSession, folder: str, names: list[str]) -> DataFrame | None:
    """The first of the files that is there, as records; None if none is."""
    for name in names:
        path = f"{folder.rstrip('/')}/{name}"
        if _exists(spark, path):
            return read_records(spark, path)
    return None


def reference_index(labels: DataFrame) -> DataFrame:
    """case_id with the kinds of its annotations, sorted and joined by +."""
    return labels.groupBy("case_id").agg(F.concat_ws("+", F.array_sort(F.collect_set("annotation_type"))).alias("annotation_types"))
