"""The simple reasoner against a plain breadth-first search, case by case."""

import random

import pytest

from faultline.plans.simple_causes import CAUSE_LABELS, DEPTH, VARIABLES, SimpleCauses


def shortest(edges, causes, start, goal):
    queue = [(start, [start], [])]
    while queue:
        at, nodes, path = queue.pop(0)
        if len(path) >= DEPTH:
            continue
        for e in sorted((e for e in edges if at in (e[1], e[3])), key=lambda e: (-e[4], e[0])):
            nxt = e[3] if e[1] == at else e[1]
            if nxt in nodes or nxt != goal and nxt in causes:
                continue
            if nxt == goal:
                return [*path, e]
            queue.append((nxt, [*nodes, nxt], [*path, e]))
    return None


def test_against_a_plain_search(spark):
    rnd = random.Random(2)
    nodes = [(f"n{i}", rnd.choice(["Variable", "Unit", "Variable", CAUSE_LABELS[i % 4] if i % 9 == 0 else "Other"])) for i in range(40)] + [("OddCause", "Other"), ("lone", "RootCause")]
    ids = [n for n, _ in nodes if n != "lone"]
    edges = [(f"e{i:03d}", rnd.choice(ids), rnd.choice(["A", "B"]), rnd.choice(ids), rnd.choice([0.5, 0.7, 0.9])) for i in range(60)]
    causes = {n for n, label in nodes if label in CAUSE_LABELS or n.endswith("Cause")}
    variables = [n for n, label in nodes if label == "Variable"] + ["not in the graph"]
    said = [(f"c{c}", v, round(rnd.random(), 3) if rnd.random() < 0.9 else 0.0) for c in range(6) for v in rnd.sample(variables, 10)] + [("zero", variables[0], 0.0)]
    r = SimpleCauses(
        spark.createDataFrame(said, "case_id string, id string, value double"), spark.createDataFrame(nodes, "id string, label string"),
        spark.createDataFrame(edges, "edge_id string, head string, relation string, tail string, confidence double"), top_k=3,
    )
    want, paths = {}, {}
    for case in {c for c, _, _ in said}:
        own = sorted(((v, -x) for c, v, x in said if c == case), key=lambda t: (t[1], t[0]))[:VARIABLES]
        own = [(v, -x) for v, x in own if v in ids]
        scored = []
        for cause in causes:
            found = [(v, x, p) for v, x in own if (p := shortest(edges, causes, cause, v))]
            if not found:
                continue
            weight, total = sum(x for _, x, _ in found), sum(x for _, x in own)
            mean = lambda f: sum(x * f(p) for _, x, p in found) / weight if weight > 0 else 0.0  # noqa: B023, E731
            graph, length = mean(lambda p: sum(e[4] for e in p) / len(p)), mean(len)
            score = 0.5 * weight / max(total, 1e-9) + 0.3 * graph + 0.25 * len(found) / len(own) - 0.1 * length / 4 - 0.12 * sum(len(p) > 1 for _, _, p in found) / len(found)
            scored.append((-round(max(0.0, score) + 1e-9, 4), cause, found))
        for i, (score, cause, found) in enumerate(sorted(scored, key=lambda t: t[:2])[:3]):
            want[case, i + 1] = (cause, pytest.approx(-score, abs=1e-4))
            for v, _, p in found:
                at, names = cause, []
                for e in p:
                    names.append(e[2] if e[1] == at else "REVERSE_" + e[2])
                    at = e[3] if e[1] == at else e[1]
                paths[case, cause, v] = ([e[0] for e in p], names)
    assert {(x["case_id"], x["rank"]): (x["cause"], x["score"]) for x in r.ranked.collect()} == want and len(want) > 10
    assert {(x["case_id"], x["cause"], x["variable"]): (x["path"], x["relations"]) for x in r.explained().collect()} == paths
    assert {len(p) for p, _ in paths.values()} >= {1, 2, 3}
