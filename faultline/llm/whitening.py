"""Whitening of embeddings from an exact integer scatter."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded

#: Entries become integers: floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components that are returned.
COMPONENTS = 32
#: Bits of a limb of an entry, and rows of a block: a product of two limbs over a block is below 2**53, so exact in double.
LIMB_BITS, BLOCK_ROWS = 20, 1 << 13
#: Bits of the limbs in which sums travel; sums of 2**22 of them still are longs.
SUM_BITS = 40
#: floor(SCALE * entry) is held to these, so that the long entry exists.
LEAST, MOST = -(2.0**63), 2.0**63 - 2.0**20


def blocks(batch: pa.RecordBatch, column: str = "embedding"):
    """(rows, y) for each dimension in the batch: y the integers floor(SCALE * entry) of the vectors without null or non-finite entries."""
    vectors = batch.column(column)
    sizes = np.array(vectors.value_lengths().fill_null(0), np.int64)
    flat = vectors.flatten()  # without the entries of null vectors
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null entry is a NaN
    starts = np.cumsum(sizes) - sizes
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (sizes > 0) & (bad[starts + sizes] == bad[starts])
    for dim in np.unique(sizes[good]).tolist():
        rows = np.flatnonzero(good & (sizes == dim))
        for at in range(0, len(rows), BLOCK_ROWS):
            some = rows[at : at + BLOCK_ROWS]
            scaled = np.floor(SCALE * values[starts[some, None] + np.arange(dim)])
            yield some, np.clip(scaled, LEAST, MOST).astype(np.int64)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """y as a sum of limb[k] * 2**(LIMB_BITS * k), each below 2**LIMB_BITS in size, as doubles."""
    out = []
    while y.size and max(int(y.max()), -int(y.min())) >= 1 << LIMB_BITS:
        out.append((y & ((1 << LIMB_BITS) - 1)).astype(np.float64))
        y = y >> LIMB_BITS
    return [*out, y.astype(np.float64)]


def exact_sums(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column sums and cross-products of at most BLOCK_ROWS rows, as Python integers."""
    dim, parts = y.shape[1], limbs(y)
    sums, cross = np.zeros(dim, object), np.zeros((dim, dim), object)
    for a, x in enumerate(parts):
        sums = sums + x.sum(0).astype(np.int64).astype(object) * (1 << LIMB_BITS * a)
        for b, z in enumerate(parts):
            cross = cross + (x.T @ z).astype(np.int64).astype(object) * (1 << LIMB_BITS * (a + b))
    return sums, cross


def _travelling(dim: int, n: int, sums: np.ndarray, cross: np.ndarray):
    """Rows (dim, i, j, limb, part): cross-products i <= j, sums with j = -1, the number of rows with i = j = -1."""
    cells = [(-1, -1, n), *((i, -1, sums[i]) for i in range(dim)), *((i, j, cross[i, j]) for i in range(dim) for j in range(i, dim))]
    for i, j, value in cells:
        value, limb = int(value), 0
        while value or not limb:
            last = -(1 << SUM_BITS) < value < 1 << SUM_BITS
            part = value if last else value & ((1 << SUM_BITS) - 1)
            yield dim, i, j, limb, part
            value, limb = (0 if last else value >> SUM_BITS), limb + 1


@dataclass(frozen=True)
class Scatter:
    """The exact sums over n vectors of integers y (entries less SHIFT)."""

    n: int
    sums: np.ndarray
    cross: np.ndarray

    def covariance(self) -> np.ndarray:
        """n * Y'Y - SS' in integers, then divided by n * n, each entry rounded once; a shift of all entries changes nothing."""
        centred = self.n * self.cross - np.outer(self.sums, self.sums)
        return np.array([[int(v) / (self.n * self.n) for v in row] for row in centred])


def scatter(vectors: DataFrame) -> Scatter | None:
    """The sums over the vectors of the most frequent dimension (the smallest on ties); None if there are none.

    Each task adds up its rows in integers of any size; its d * (d + 3) / 2 + 1 sums travel in limbs of 40 bits, which Spark adds.
    The driver gets as many rows as there are sums, however many vectors there are.
    """

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for rows, y in blocks(batch):
                sums, cross = exact_sums(y)
                old = held.setdefault(y.shape[1], [0, 0, 0])
                held[y.shape[1]] = [old[0] + len(rows), old[1] + sums, old[2] + cross]
        for dim, (n, sums, cross) in held.items():
            columns = list(zip(*_travelling(dim, n, sums, cross)))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["dim", "i", "j", "limb", "part"])

    parts = bounded(vectors).select("embedding").mapInArrow(run, "dim int, i int, j int, limb int, part long")
    added = parts.groupBy("dim", "i", "j", "limb").agg(F.sum("part").alias("part")).collect()
    counts = {r["dim"]: r["part"] for r in added if r["i"] == -1}
    if not counts:
        return None
    dim = min(counts, key=lambda d: (-counts[d], d))
    sums, cross = np.zeros(dim, object), np.zeros((dim, dim), object)
    for r in added:
        if r["dim"] == dim and r["i"] >= 0:
            value = r["part"] << SUM_BITS * r["limb"]
            if r["j"] < 0:
                sums[r["i"]] += value
            else:
                cross[r["i"], r["j"]] += value
                if r["i"] != r["j"]:
                    cross[r["j"], r["i"]] += value
    return Scatter(counts[dim], sums, cross)


@dataclass(frozen=True)
class Whitener:
    """components: a unit eigenvector in each column, by falling eigenvalue. usable: eigenvalues above what rounding leaves of 0."""

    fit: Scatter
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def usable(self) -> np.ndarray:
        return self.values > len(self.values) * np.finfo(float).eps * max(float(self.values[0]), 0.0)

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n * y - S, exactly: in longs where they hold it, else in Python integers."""
        n, sums = self.fit.n, self.fit.sums
        most = n * max(int(y.max()), -int(y.min())) + max(abs(int(s)) for s in sums) if y.size else 0
        return y * n - sums.astype(np.int64) if most < 1 << 62 else y.astype(object) * n - sums

    def whiten(self, y: np.ndarray, k: int) -> np.ndarray:
        """The first k components of each row; NaN where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (self.centred(y) / self.fit.n).astype(np.float64) @ self.components[:, :k] / np.sqrt(np.maximum(self.values[:k], 0))
        out[:, ~self.usable[:k]] = np.nan
        return out

    def deviations(self, y: np.ndarray) -> list[int]:
        c = self.centred(y)
        if c.dtype != object and c.size and max(int(c.max()), -int(c.min())) ** 2 * c.shape[1] >= 1 << 63:
            c = c.astype(object)
        return [int(v) for v in (c * c).sum(1)]


def fit(vectors: DataFrame) -> Whitener | None:
    """The eigenvectors of the covariance of all vectors of the usual dimension; each has its largest entry above 0, so that there is one result."""
    got = scatter(vectors)
    if got is None:
        return None
    covariance = got.covariance()
    values, components = np.linalg.eigh(covariance)
    values, components = values[::-1], components[:, ::-1]
    peak = np.abs(components).argmax(0)
    return Whitener(got, values, components * np.sign(components[peak, np.arange(len(values))]), float(np.trace(covariance)))


def _identity_error(vectors: DataFrame, shared, k: int) -> float | None:
    """The largest absolute entry of the covariance of the whitened vectors, less the identity, over the components that have a variance."""

    def run(batches):
        w = shared.value
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            for _, y in blocks(batch):
                if y.shape[1] == len(w.values):
                    z = np.hstack([w.whiten(y, k)[:, w.usable[:k]], np.ones((len(y), 1))])
                    total[: z.shape[1], : z.shape[1]] += z.T @ z
        cells = np.indices(total.shape).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(cells[0]), pa.array(cells[1]), pa.array(total.ravel())], ["i", "j", "v"])

    m = int(shared.value.usable[:k].sum())
    if not m:
        return None
    total = np.zeros((m + 1, m + 1))
    added = bounded(vectors).select("embedding").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    for r in added.where((F.col("i") <= m) & (F.col("j") <= m)).collect():
        total[r["i"], r["j"]] = r["v"]
    moments = total / total[m, m]
    return float(np.abs(moments[:m, :m] - np.outer(moments[m, :m], moments[m, :m]) - np.eye(m)).max())


SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component up to k (or its dimension): vec_id, component, n, deviation, whitened, explained, identity_error.

    Null vectors and those that hold a null or non-finite entry are left out, so are empty ones and those of another
    dimension than most have (of equally frequent ones the smallest). Entries are exact integers, held to the range of
    long; sums and cross-products are exact at any size, and only the finished n * X'X - SS' becomes double. deviation is exact and null
    beyond 38 digits. A component without variance has a null `whitened` and is not part of identity_error; without
    variance at all `explained` is null too. Equal vectors have equal rows, repeated rows count each time, a null vec_id stays null; no vectors, no rows.
    Three passes over the vectors; nothing but sums is shuffled. What is broadcast has the size of the covariance.
    """
    spark: SparkSession = vectors.sparkSession
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fitted = fit(slim)
    if fitted is None:
        return spark.createDataFrame([], SCHEMA)
    k = min(k, len(fitted.values))
    shared = spark.sparkContext.broadcast(fitted)
    error = _identity_error(slim, shared, k)
    explained = fitted.values[:k] / fitted.trace if fitted.trace > 0 else np.full(k, np.nan)

    def run(batches):
        w = shared.value
        for batch in batches:
            ids = batch.column("vec_id")
            for rows, y in blocks(batch):
                if y.shape[1] != len(w.values):
                    continue
                m = len(rows)
                exact = pa.array([str(v) if v < 10**38 else None for v in w.deviations(y)], pa.string()).cast(pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(rows)).take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, w.fit.n, np.int64)),
                        exact.take(each),
                        pa.array(w.whiten(y, k).ravel(), from_pandas=True),
                        pa.array(np.tile(explained, m), from_pandas=True),
                        pa.array(np.full(m * k, np.nan if error is None else error), from_pandas=True),
                    ],
                    [x.split()[0] for x in SCHEMA.split(", ")],
                )

    return bounded(slim).mapInArrow(run, SCHEMA)


def whiten_embeddings(vectors: DataFrame) -> DataFrame:
    """`whiten` with deviation as a long; beyond that range it is null."""
    return whiten(vectors).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
