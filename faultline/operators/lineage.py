"""Cutting the lineage of a plan that grows step by step."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders written by this driver and not yet released, oldest first.
_WRITTEN: list[str] = []


#: The folder of this process where the session names none.
_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; on a cluster a relative path is an error.

    Where the setting is unset a local run gets a folder of its own, kept here and not in the session; on a cluster that would
    be one folder for each machine, so there it is an error.
    """
    root, local = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    if root:
        if not local and not spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).isAbsolute():
            raise ValueError(f"spark.checkpoint.dir must be an absolute path, not {root}")
        return root.rstrip("/")
    if not local:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="faultline-"))
    return _OWN[0]


#: Set to true in a session whose steps leave no shuffle files (see `cut`).
SWEPT = "spark.faultline.swept"


@contextmanager
def _swept(spark: SparkSession):
    """What is run within leaves no shuffle files, which would otherwise stay until the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read back; the folder stays until `release`.

    In a session for large tables (SWEPT) the shuffle files of the step go as soon as it is written: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/steps/{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    with _swept(spark) if spark.conf.get(SWEPT, None) == "true" else nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the number of each row in the order of the columns, from 1, over the whole frame.

    Rows are range-partitioned in their order and each partition is numbered on its own, from where the ones before it
    end, so no task holds all of them.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("_run", F.spark_partition_id()))
    start = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = dealt.groupBy("_run").count().withColumn("_before", F.coalesce(F.sum("count").over(start), F.lit(0))).drop("count")
    nth: Column = F.row_number().over(Window.partitionBy("_run").orderBy(*order))
    return dealt.withColumn("_nth", nth).join(F.broadcast(offsets), "_run").withColumn(name, (F.col("_nth") + F.col("_before")).cast("long")).drop("_nth", "_before", "_run")


def release(spark: SparkSession) -> None:
    """Delete what `cut` has written, once every result that reads it has been written or collected."""
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(hadoop).delete(path, True)
