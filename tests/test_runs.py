"""Stored runs: replaced as a whole or not at all, read nested and by pages; the fold of edges; components of grids."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import components, imaging, kg
from faultline.sources import runs
from faultline.sources.runs import Conflict, RunStore


def tables(spark, n, mark, cases=("a", "b", "c")):
    case = [(c, i, "tep", mark) for i, c in enumerate(cases)]
    links = [(c, f, f"{f}_{c}_{i}", mark) for c in cases[:2] for i, f in enumerate(("object", "location")[:n])]
    return {
        "run": spark.createDataFrame([(f"2024-01-0{n}", mark)], "started_at string, label string"),
        "cases": spark.createDataFrame(case, "case_id string, case_order int, dataset string, mark string"),
        "linked_entities": spark.createDataFrame(links, "case_id string, field string, link_id string, mark string"),
        "paths": spark.createDataFrame([("a", 2, "p2"), ("a", 1, "p1"), ("c", 1, "p3")], "case_id string, rank int, path_id string"),
        "artifacts": spark.createDataFrame([(f"s3://x/{mark}/table.csv", 1), (f"s3://x/{mark}/2/table.csv", 2)], "uri string, created_at int"),
    }


@pytest.fixture()
def store(spark, tmp_path):
    return RunStore(spark, f"file://{tmp_path}/runs")


def test_a_run_is_written_again(spark, store):
    store.save("r1", tables(spark, 2, "old"))
    store.save("r2", tables(spark, 1, "other"))
    first = store._commits()[-1]
    store.save("r1", {k: v for k, v in tables(spark, 1, "new", ("a", "d")).items() if k != "paths"})
    assert [(r["run_id"], r["label"]) for r in store.runs().collect()] == [("r1", "new"), ("r2", "other")]
    links = {(r["run_id"], r["link_id"], r["mark"]) for r in store.table("linked_entities").collect()}
    assert links == {("r1", "object_a_0", "new"), ("r1", "object_d_0", "new"), ("r2", "object_a_0", "other"), ("r2", "object_b_0", "other")}
    assert {r["run_id"] for r in store.table("paths").collect()} == {"r2"}
    assert store.table("linked_entities", as_of=first).where("run_id = 'r1'").count() == 4  # as it was
    # each case once, as the last run has it
    assert {(r["case_id"], r["mark"]) for r in store.cases().collect()} == {("a", "new"), ("b", "other"), ("c", "other"), ("d", "new")}
    assert store.artifact("r1", "table.csv") == "s3://x/new/2/table.csv"
    with pytest.raises(ValueError):
        store.artifact("r1", "able.csv")
    assert len(store.vacuum()) == 6 and store.vacuum() == [] and store.table("cases").count() == 5
    store.remove("r2")
    assert [r["run_id"] for r in store.runs().collect()] == ["r1"]
    with pytest.raises(ValueError):
        store.detail("r2")


def test_a_failure_between_the_tables_leaves_the_old_run(spark, store, monkeypatch):
    store.save("r1", tables(spark, 2, "old"))
    before = sorted(map(tuple, store.table("linked_entities").collect()))
    broken = tables(spark, 1, "new")
    broken["paths"] = broken["paths"].withColumn("path_id", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.save("r1", broken)
    monkeypatch.setattr(RunStore, "commit", lambda self, entry, after: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.save("r1", tables(spark, 1, "new"))
    assert sorted(map(tuple, store.table("linked_entities").collect())) == before
    assert store.runs().first()["label"] == "old" and len(store.detail("r1").where("mark = 'old'").collect()) == 3


def test_of_two_writers_one_comes_later(spark, store):
    assert store.commit({"run_id": "x", "attempt": "1", "tables": []}, 0) == 1
    with pytest.raises(Conflict):
        store.commit({"run_id": "x", "attempt": "2", "tables": []}, 0)
    assert store.current().first()["attempt"] == "1"
    assert RunStore(store.spark, store.root + "-none").current().count() == 0


def test_details_and_pages(spark, store):
    store.save("r1", tables(spark, 2, "old"))
    detail = store.detail("r1")
    assert "Exchange" not in detail._jdf.queryExecution().executedPlan().toString()
    got = {r["case_id"]: r for r in detail.collect()}
    assert [x["path_id"] for x in got["a"]["paths"]] == ["p1", "p2"] and got["b"]["paths"] == []
    assert [x["field"] for x in got["b"]["linked_entities"]] == ["location", "object"] and got["c"]["linked_entities"] == []
    one = store.page("r1", 2).collect()
    two = store.page("r1", 2, (one[-1]["case_order"], one[-1]["case_id"])).collect()
    assert [r["case_id"] for r in one + two] == ["a", "b", "c"]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "B", 1), (3, "C", 2), (3, "c", 1), (None, "N", 0)], "k int, v string, w int")
    rows = lambda df: sorted(((r["k"] or 0, r["v"]) for r in df.collect()))
    assert rows(runs.upsert(old, new, ["k"], order=lambda: F.col("w"))) == [(0, "N"), (1, "a"), (2, "B"), (3, "c")]
    assert rows(runs.upsert(old, new, ["k"], update=False, order=lambda: F.desc("w"))) == [(0, "n"), (1, "a"), (2, "b"), (3, "C")]


@pytest.mark.parametrize("leave", [False, True])
def test_edges_one_after_another(spark, leave):
    """Against reading the rows one by one."""
    rnd = random.Random(4)
    rows = [(f"e{rnd.randrange(40)}", f, i, rnd.choice(["reviewed", "auto", "proposed", None]), rnd.choice([0.5, 0.7]), rnd.choice(["s", None])) for f in range(4) for i in range(60)]
    left, refused = {}, set()
    for edge, f, i, *own in sorted(rows, key=lambda r: r[1:3]):
        had = left.get(edge)
        if had is None:
            left[edge] = own
        elif had == own:
            continue
        elif had[0] == "reviewed" and not leave:
            refused.add((edge, f, i, *own, *had))
        elif own[0] == "reviewed" or had[0] != "reviewed":
            left[edge] = own
    got, bad = kg.fold_edges(spark.createDataFrame(rows, "edge_id string, file_order int, line int, review_status string, confidence double, source string").repartition(5), leave)
    assert {r["edge_id"]: [r["review_status"], r["confidence"], r["source"]] for r in got.collect()} == left
    assert {(r["edge_id"], r["file_order"], r["line"], *r["refused"], *r["kept"]) for r in bad.collect()} == refused


def spiral(n):
    """Cells of a path that winds inwards and never touches itself."""
    grid, at, step, turn = set(), (0, 0), (0, 1), 0
    grid.add(at)
    while True:
        nxt, far = ((at[0] + k * step[0], at[1] + k * step[1]) for k in (1, 2))
        if not (0 <= nxt[0] < n and 0 <= nxt[1] < n) or far in grid or nxt in grid:
            step, turn = (step[1], -step[0]), turn + 1
            if turn == 2:
                return grid
            continue
        turn, at = 0, nxt
        grid.add(at)


def test_a_spiral_takes_few_rounds(spark):
    """One path of 10,000 cells, and pieces beside it."""
    cells = spiral(142)
    assert len(cells) > 10_000
    rows = [("spiral", r, c, 1) for r, c in cells] + [("cut", r, c, 1) for i, (r, c) in enumerate(sorted(cells)) if i % 50] + [("empty", 0, 0, 0), ("one", 3, 3, 1), ("one", 3, 3, 1)]
    rounds: list[int] = []
    got = {r["grid_id"]: r["components"] for r in imaging.components(spark.createDataFrame(rows, "grid_id string, row int, col int, value int"), rounds).collect()}
    left, parts = {(r, c) for g, r, c, _ in rows if g == "cut"}, 0
    while left:
        parts, todo = parts + 1, [left.pop()]
        while todo:
            r, c = todo.pop()
            for x in ((r, c + 1), (r, c - 1), (r + 1, c), (r - 1, c)):
                if x in left:
                    left.remove(x)
                    todo.append(x)
    assert got == {"spiral": 1, "cut": parts, "one": 1} and rounds[0] <= 20


def test_components_of_any_graph(spark):
    rnd = random.Random(6)
    n = 600
    edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(350)] + [(0, i) for i in range(500, 560)] + [(5, 5), (None, 3)]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = components.connected(spark.range(n), spark.createDataFrame(edges, "a long, b long"))
    assert {r["id"]: r["root"] for r in got.collect()} == {i: find(i) for i in range(n)}
    assert components.connected(spark.range(0), spark.createDataFrame([], "a long, b long")).count() == 0
