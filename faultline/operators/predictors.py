"""The contract of predictors: a model over batches of maps, loaded once in each worker."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of the maps that a model is given at once, about; a larger map comes alone.
CELLS = 1 << 20


class Predictor(Protocol):
    """What is asked of a model: a batch of rows to a batch with as many, in the same order."""

    def predict(self, batch: pa.RecordBatch) -> pa.RecordBatch: ...


_LOADED: dict[str, Predictor] = {}


def _by_cells(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    maps = batch.column(column)
    rows = np.concatenate([[0], np.cumsum(np.array(maps.flatten().value_lengths().fill_null(0), np.int64))])
    lengths = np.array(maps.value_lengths().fill_null(0), np.int64)
    ends = rows[np.cumsum(lengths)]
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def predict(items: DataFrame, load: Callable[[], Predictor], schema: str, maps: str = "map", keep: tuple[str, ...] = (), cells: int = CELLS) -> DataFrame:
    """The kept columns of items and what the model says of each (schema).

    items have a column `maps`, an array of arrays of numbers. load makes the model; a worker process calls it once, for all
    its tasks. The model gets some `cells` cells at a time, however many rows that are, so large maps do not add up. A model that
    answers with another number of rows is an error. Null maps are empty, an empty table calls no model.
    """
    name = uuid.uuid4().hex

    def run(batches):
        for batch in batches:
            for part in _by_cells(batch, maps, cells) if batch.num_rows else ():
                if name not in _LOADED:
                    _LOADED[name] = load()
                said = _LOADED[name].predict(part)
                if said.num_rows != part.num_rows:
                    raise ValueError(f"the model has {said.num_rows} answers for {part.num_rows} rows")
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *said.columns], [*keep, *said.schema.names])

    kinds = dict(items.dtypes)
    out = "".join(f"`{c}` {kinds[c]}, " for c in keep) + schema
    return items.mapInArrow(run, out)


def nested(cells: DataFrame) -> DataFrame:
    """grid_id, map: the cells (grid_id, row, col, value) of each grid as an array of rows, 0 where there is none; a grid is a row, so it has to fit a task."""
    size = cells.groupBy("grid_id").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"), F.map_from_entries(F.collect_list(F.struct(F.struct("row", "col"), F.col("value").cast("double")))).alias("m"))
    at = lambda r, c: F.coalesce(F.try_element_at("m", F.struct(r.cast("int").alias("row"), c.cast("int").alias("col"))), F.lit(0.0))
    return size.select("grid_id", F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda r: F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda c: at(r, c))).alias("map"))


def cells(maps: DataFrame, column: str = "map", key: str = "grid_id") -> DataFrame:
    """grid_id, row, col, value of an array of arrays: what masks, overlaps and calibration work on."""
    rows = maps.select(F.col(key).alias("grid_id"), F.posexplode(column).alias("row", "_cells"))
    return rows.select("grid_id", "row", F.posexplode("_cells").alias("col", "value"))
