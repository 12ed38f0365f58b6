"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null key while rows are grouped or joined by it; nulls sort before every other key.
NULL_KEY = -(2**63)
#: Rows of a batch that goes to Python.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folder of this process where the session names none.
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; on a cluster a relative path is an error.

    Where the setting is unset a local run gets a folder of its own, kept here and not in the session; on a cluster that would be
    a folder for each machine, so there it is an error.
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


#: Folders written by this driver and not yet released, oldest first.
_WRITTEN: list[str] = []


def new_folder(spark: SparkSession, name: str = "") -> str:
    path = f"{shared_dir(spark)}/faultline/{name}{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back: the lineage is cut, and a lost executor loses nothing.

    The folder stays until `release`, as results are read from it when they are asked for.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def swept(spark: SparkSession):
    """What is written within leaves no shuffle files, which would otherwise stay until the driver collects garbage: nothing reads them once the rows have been written."""
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


def written(df: DataFrame) -> DataFrame:
    """As `materialize`, for one of many steps: see `swept`."""
    with swept(df.sparkSession):
        return materialize(df)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the folders written since, once every result that reads them has been written or collected."""
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm
    while len(_WRITTEN) > since:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(hadoop).delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    """What is written within is deleted at the end: for work whose result has been written elsewhere by then."""
    since = len(_WRITTEN)
    try:
        yield
    finally:
        release(spark, since)


def key_of(column: str):
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_KEY))


def unkey(column: str):
    return F.when(F.col(column) != F.lit(NULL_KEY), F.col(column))


def bounded(df: DataFrame) -> DataFrame:
    """The frame, after its session's batches to Python have been held to BATCH_ROWS rows, so that long texts fit a worker."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "0") or 0) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))  # read when the plan is made, so it has to stay
    return df


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores after it until no column has it (in whatever case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """fn: an Arrow batch to a dict of columns (or None); run over the batches of each partition."""
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches):
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names)

    return bounded(df).mapInArrow(run, schema)



def byte_slices(batch: pa.RecordBatch, column: str, most: int):
    """The batch in runs of rows whose strings have `most` bytes at most, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to
