import math

import numpy as np
import pytest

from faultline.llm import embeddings
from faultline.llm.components import components


@pytest.mark.parametrize("leaf, block, levels", [(40, 1024, 10), (40, 16, 10), (12, 1024, 2)])
def test_against_all_pairs(spark, monkeypatch, leaf, block, levels):
    """Also where leaves are cut into blocks, and where trees are deeper than their own splits."""
    monkeypatch.setattr(embeddings, "LEAF", leaf)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "LEVELS", levels)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[rng.integers(0, 60, 300)] + 0.12 * rng.standard_normal((300, 16)), rng.standard_normal((100, 16)), base[:5], base[:5], base[:1] * 1e200])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [math.nan] * 16), (903, [1.0, None, *[0.0] * 14]), (904, [math.inf] * 16), (905, [1.0])]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()}
    assert len(got) == len(rows)
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    want = link.sum(axis=1)
    have = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (have <= want).all() and have.sum() >= 0.95 * want.sum()
    for i in range(900, 906):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    for a, b in zip(*np.nonzero(link)):
        if have[a] == want[a]:
            assert got[int(a)]["component_id"] == got[int(b)]["component_id"]


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = embeddings.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 0), (None, None, 3)], schema)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in rows) == [(0, 0), (1, 2), (1, 2), (2, 2)]


def test_ids_and_lengths_that_tie(spark):
    """Vectors that share an id keep their own links; of lengths that are as frequent the smallest is the usual one."""
    schema = "vec_id long, embedding array<double>"
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [1.0, 0.02]), (4, [1.0, 1.0, 1.0]), (5, [1.0, 1.0, 1.0]), (6, [1.0, 1.0, 1.0]), (7, [1.0, 1.0, 1.0])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 0, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7)]


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(50)] + [(100, j) for j in range(101, 160)] + [(int(a), int(b)) for a, b in rng.integers(200, 400, (120, 2))]
    got = {r["v"]: r["c"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {v: v for e in edges for v in e}

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    assert got == {v: top(v) for v in root if any(v in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
