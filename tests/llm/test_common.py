"""The shared folder and batches by bytes."""

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.llm import common


def test_local_run_without_the_setting(spark, monkeypatch):
    get = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: default[0] if key == "spark.checkpoint.dir" else get(self, key, *default))
    monkeypatch.setattr(type(spark.conf), "set", lambda self, key, value: pytest.fail(f"sets {key}"))
    df = common.materialize(spark.range(10))
    assert df.count() == 10 and df.inputFiles()[0].startswith("file:///")


def test_slices_by_bytes():
    texts = ["a" * 5, None, "", "b" * 30, "cc", "é" * 4, None]
    batch = pa.RecordBatch.from_pydict({"t": texts})
    parts = [p.column("t").to_pylist() for p in common.byte_slices(batch, "t", 10)]
    assert sum(parts, []) == texts and parts == [["a" * 5, None, ""], ["b" * 30], ["cc", "é" * 4, None]]
    assert list(common.byte_slices(batch.slice(0, 0), "t", 10)) == []


def test_a_written_step_leaves_no_shuffle_files(spark):
    def kept():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(name, None), kept()
    out = common.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    deadline = time.time() + 20
    while kept() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not kept() - before and spark.conf.get(name, None) == was
    assert {r["k"] for r in out.collect()} == set(range(7))
