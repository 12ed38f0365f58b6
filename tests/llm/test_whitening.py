"""Whitening: integers of any size against Python's own, whole results against a plain version, edge cases."""

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from faultline.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def plainly(vectors):
    """(n, covariance as fractions, deviations) of lists of floats."""
    x = [[math.floor(64 * Fraction(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(v[i] for v in x) for i in range(d)]
    cov = [[Fraction(sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in x), n**3) for j in range(d)] for i in range(d)]
    return n, cov, [sum((n * v[i] - s[i]) ** 2 for i in range(d)) for v in x]


def test_exact_sums_of_large_integers():
    rng = np.random.default_rng(0)
    for bits in (4, 19, 20, 21, 40, 62):
        y = rng.integers(-(2**bits), 2**bits, (500, 5))
        y[0, 0], y[1, 1] = -(2**bits), 2**bits - 1
        sums, cross = whitening.exact_sums(y)
        own = [[int(v) for v in row] for row in y]
        assert sums.tolist() == [sum(r[i] for r in own) for i in range(5)]
        assert cross.tolist() == [[sum(r[i] * r[j] for r in own) for j in range(5)] for i in range(5)]
        back = {}
        for dim, i, j, limb, part in whitening._travelling(5, 500, sums, cross):
            assert abs(part) < 1 << whitening.SUM_BITS
            back[i, j] = back.get((i, j), 0) + (part << whitening.SUM_BITS * limb)
        assert back[-1, -1] == 500 and all(back[i, -1] == sums[i] and back[i, i] == cross[i, i] for i in range(5))


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e4, 3e7), (3.7, -2e9)])
def test_against_plain_version(spark, scale, shift):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.3]) * scale + shift
    vectors = [v.tolist() for v in np.vstack([base, base[:7]])]  # repeated rows too
    frame = spark.createDataFrame(list(enumerate(vectors)), SCHEMA).repartition(5)
    rows = whitening.whiten(frame).collect()
    n, cov, deviations = plainly(vectors)
    assert len(rows) == n * 6 and {r["n"] for r in rows} == {n}
    assert all(int(r["deviation"]) == deviations[r["vec_id"]] for r in rows)
    values = np.linalg.eigvalsh(np.array([[float(c) for c in row] for row in cov]))[::-1]
    trace = float(sum(cov[i][i] for i in range(6)))
    w = np.zeros((n, 6))
    for r in rows:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / trace, rel=1e-9)
    error = np.abs(np.cov(w.T, bias=True) - np.eye(6)).max()
    assert error < 1e-9 and {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and abs(rows[0]["identity_error"] - error) < 1e-9
    assert np.allclose(w[:7], w[300:])
    x = np.floor(64 * np.array(vectors))
    projections = (x - x.mean(0)) @ np.linalg.inv(np.cov(x.T, bias=True)) @ (x - x.mean(0)).T
    assert np.allclose(w @ w.T, projections, atol=1e-6)


def test_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = whitening.whiten_embeddings(frame).collect()
    good = frame.collect()
    assert len(rows) == len(good) * whitening.COMPONENTS
    n, _, deviations = plainly([r["embedding"] for r in good])
    want = dict(zip((r["vec_id"] for r in good), deviations))
    assert all(r["deviation"] == want[r["vec_id"]] and r["identity_error"] < 1e-10 for r in rows)


def test_vectors_that_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [3.0, -1.0]), (None, [0.5, 0.25]), (4, None), (5, []), (6, [nan, 1.0]), (7, [1.0, inf]), (8, [None, 1.0]), (9, [1.0]), (10, [1.0, 2.0, 3.0]), (1, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", deviation string")
    got = whitening.whiten(frame).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == sorted((v or 0, c) for v in (1, 2, None, 1) for c in (1, 2))
    assert {r["n"] for r in got} == {4}


def test_no_variance(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], SCHEMA)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], int(r["deviation"])) for r in one] == [(None, None, None, 0)] * 2
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0, 2.0 * i]) for i in range(9)], SCHEMA)).collect()
    assert {r["component"] for r in flat if r["whitened"] is not None} == {1} and flat[0]["identity_error"] < 1e-12


def test_entries_beyond_long(spark):
    rows = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5e16, 2.0])], SCHEMA)).collect()
    assert all(r["identity_error"] is not None for r in rows)
    y = next(whitening.blocks(pa.RecordBatch.from_pydict({"embedding": [[1e300, -1e300]]})))[1]
    assert y.tolist() == [[int(whitening.MOST), int(whitening.LEAST)]]
