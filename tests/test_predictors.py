"""The contract of predictors, and the table function of chunks."""

import pyarrow as pa
import pytest

from faultline.operators import compiler, predictors


class Counting:
    """Says how many rows and cells it has been given at once, and how often it has been made in this worker."""

    made = 0

    def __init__(self):
        Counting.made += 1

    def predict(self, batch):
        cells = sum(len(r) for m in batch.column("map").to_pylist() for r in m or [])
        n = batch.num_rows
        return pa.RecordBatch.from_pydict({"rows": pa.array([n] * n, pa.int64()), "cells": pa.array([cells] * n, pa.int64()), "made": pa.array([Counting.made] * n, pa.int64())})


class Short(Counting):
    def predict(self, batch):
        return super().predict(batch.slice(0, 0))


SCHEMA = "rows long, cells long, made long"


def test_batches_by_cells(spark):
    rows = [(i, [[1.0] * 10] * 10) for i in range(20)] + [(100, [[1.0] * 100] * 100), (101, None), (102, []), (103, [[], [2.0]])]
    items = spark.createDataFrame(rows, "id long, map array<array<double>>").coalesce(1)
    got = {r["id"]: r for r in predictors.predict(items, Counting, SCHEMA, keep=("id",), cells=350).collect()}
    assert len(got) == 24 and got[100]["rows"] == 1 and got[100]["cells"] == 10_000  # a large map comes alone
    assert all(r["cells"] <= 350 for k, r in got.items() if k != 100) and got[0]["rows"] == 3
    assert {r["made"] for r in got.values()} == {1}  # one model for all of a worker's batches
    assert predictors.predict(items.where("false"), Counting, SCHEMA).count() == 0
    with pytest.raises(Exception, match="answers"):
        predictors.predict(items, Short, SCHEMA).collect()


def test_maps_there_and_back(spark):
    cells = [("a", 0, 0, 1), ("a", 2, 1, 2), ("b", 1, 0, 5)]
    maps = predictors.nested(spark.createDataFrame(cells, "grid_id string, row int, col int, value int"))
    assert {r["grid_id"]: r["map"] for r in maps.collect()} == {"a": [[1.0, 0.0], [0.0, 0.0], [0.0, 2.0]], "b": [[0.0], [5.0]]}
    back = predictors.cells(maps).where("value > 0").collect()
    assert sorted((r["grid_id"], r["row"], r["col"], int(r["value"])) for r in back) == cells


def test_chunks_in_sql(spark):
    texts = [(1, "line\n" * 5000), (2, None), (3, "   \n"), (4, "short"), (5, "x" * 20_000)]
    docs = spark.createDataFrame(texts, "k long, body string")
    compiler.register_chunks(spark)
    got = spark.sql("SELECT k, c.* FROM {docs} AS d, LATERAL chunks(d.body) AS c", docs=docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, compiler.chunk(docs, "k", "body").collect())) and len(got) > 6
    small = spark.sql("SELECT c.`end` - c.start AS n FROM {docs} AS d, LATERAL chunks(d.body, 2000, 100) AS c WHERE k = 5", docs=docs).collect()
    assert len(small) == 11 and max(r["n"] for r in small) == 2000
