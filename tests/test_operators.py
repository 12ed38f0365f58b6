"""Operators against values worked out by hand, and procedures against plain models."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.functions import signals, text
from faultline.functions.text import normalize
from faultline.operators import anchors, compiler, consistency, evidence, imaging, kg, linking, metrics, noise, paths, propagation, review, rules, timeseries
from faultline.plans.compile import Compiled
from faultline.plans.pipeline import Analysis
from faultline.plans.root_causes import RootCauses

NODE = "id string, name string, label string, scenario string, aliases array<string>"
EDGE = "head string, relation string, tail string, scenario string, confidence double"


def nodes(spark, *rows):
    return spark.createDataFrame([(i, n, label, s, list(a)) for i, n, label, s, *a in rows], NODE)


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), EDGE).withColumn("edge_id", F.concat_ws("|", "head", "relation", "tail", "scenario"))


def mentions(spark, *rows):
    return spark.createDataFrame([("c1", "mvtec", f, i, m) for i, (f, m) in enumerate(rows)], "case_id string, dataset string, field string, ord int, mention string").withColumn("mention_key", normalize(F.col("mention")))


def first(df, *columns):
    return tuple(df.select(*columns).first())


def test_text_rules(spark):
    one = spark.createDataFrame([("  Near-Full Map ", " a|b; ,c ", "YES", " 1.5 ", "x")], "a string, b string, c string, d string, e string")
    got = one.select(normalize(F.col("a")), text.token(F.col("a")), text.text_list(F.col("b")), text.bool_cell(F.col("c")), text.float_cell(F.col("d")), text.float_cell(F.col("e")), text.bad_float(F.col("e")), text.pascal(F.lit("9 lives of")), text.label_of(F.lit("MechanicalCause"))).first()
    assert tuple(got) == ("nearfullmap", "near_full_map", ["a", "b", "c"], True, 1.5, 0.0, True, "Entity9LivesOf", "CandidateCause")
    assert [r[0] for r in spark.createDataFrame([("XMEAS(07)",), ("xmv 3",), ("x",)], "c string").select(text.channel_id(F.col("c"))).collect()] == ["xmeas_7", "xmv_3", None]


def test_signals(spark):
    v = spark.createDataFrame([(0.5,)], "v double")
    assert first(v, signals.excess(F.col("v"), 0.0, 1.0), signals.shortfall(F.col("v"), 1.0, 1.0), signals.band(F.col("v"), 0.0, 1.0), signals.calibrated_confidence(F.col("v"), F.lit(0.5)), signals.calibrated_confidence(F.col("v"), F.lit(0.51)), signals.calibrated_confidence(F.col("v") + 1, F.lit(None).cast("double")), signals.calibrated_label(F.col("v"), F.lit(0.6))) == (0.5, 0.5, 1.0, 1.0, 0.0, 1.0, "normal")


def test_field_filter_prefers_allowed_labels(spark):
    n = nodes(spark, ("LocDefect", "Loc", "Pattern", "mvtec", "loc", "local"), ("WaferLocalLocation", "Local", "Location", "mvtec", "local"))
    m = mentions(spark, ("anomaly_type", "loc"), ("location", "local"))
    got = linking.field_filter(m, linking.all_candidates(m, kg.terms(n))).where("rank = 1").select("field", "id").collect()
    assert {tuple(r) for r in got} == {("anomaly_type", "LocDefect"), ("location", "WaferLocalLocation")}


def test_a_shared_alias_is_ambiguous(spark):
    n = nodes(spark, ("ScratchDefect", "Scratch defect", "AnomalyType", "mvtec", "scratch"), ("ScratchFault", "Scratch fault", "AnomalyType", "mvtec", "scratch"))
    m = mentions(spark, ("anomaly_type", "scratch"))
    f = linking.with_ambiguity(linking.field_filter(m, linking.all_candidates(m, kg.terms(n))), ["field", "mention_key", "dataset"]).first()
    assert (f["id"], f["ambiguous"], f["margin"], f["score"]) == ("ScratchDefect", True, 0.0, 0.95)


def test_scope_of_checks_and_corrections(spark):
    n = nodes(spark, ("ScratchDefect", "scratch", "AnomalyType", "mvtec"), ("Surface", "surface", "Morphology", "mvtec"), ("Rim", "rim", "Location", "mvtec"), ("LinearMorphology", "linear", "Morphology", "mvtec"))
    e = edges(spark, ("ScratchDefect", "HAS_MORPHOLOGY", "Surface", "wafer", 0.9), ("ScratchDefect", "OCCURS_ON", "Rim", "mvtec", 0.9), ("ScratchDefect", "HAS_MORPHOLOGY", "LinearMorphology", "mvtec", 0.8))
    a = Analysis(mentions(spark, ("anomaly_type", "scratch"), ("morphology", "surface"), ("location", "rim")), n, e)
    s = a.scores.first()
    assert s["consistency_score"] == 0.7 and s["inconsistent_fields"] == ["anomaly_type", "morphology"]
    c = a.corrections.first()
    assert (c["candidate_id"], c["suggested"], c["edge_id"]) == ("corr_c1_morphology_linearmorphology", "linear", "ScratchDefect|HAS_MORPHOLOGY|LinearMorphology|mvtec")


def test_paths_stay_in_scope_and_score(spark):
    n = nodes(spark, ("Scratch", "scratch", "AnomalyType", "mvtec"), ("MechanicalContact", "m", "RootCause", "wafer"), ("HandlingDamage", "h", "RootCause", "mvtec"), ("O", "obj", "Object", "mvtec"), ("L", "loc", "Location", "mvtec"), ("M", "mor", "Morphology", "mvtec"))
    e = edges(spark, ("Scratch", "HAS_PLAUSIBLE_CAUSE", "MechanicalContact", "wafer", 0.99), ("Scratch", "HAS_PLAUSIBLE_CAUSE", "HandlingDamage", "mvtec", 0.75))
    a = Analysis(mentions(spark, ("object", "obj"), ("anomaly_type", "scratch"), ("location", "loc"), ("morphology", "mor")), n, e)
    top = a.top.collect()
    assert [(r["target_id"], r["score"]) for r in top] == [("HandlingDamage", 0.48)]
    assert top[0]["path_id"].startswith("path_c1_") and a.causes.first()["rank"] == 1


def test_strength_prefers_the_analysis_score(spark):
    e = edges(spark, ("A", "R", "B", "mvtec", 0.9), ("A", "R", "C", "mvtec", 0.7)).withColumn("rca_score", F.when(F.col("tail") == "B", 0.2).otherwise(0.95))
    assert {r["tail"]: r["strength"] for r in kg.edge_strength(e).collect()} == {"B": 0.2, "C": 0.95}


def test_simple_paths_against_a_plain_search(spark):
    rnd = random.Random(3)
    pairs = {(f"n{rnd.randrange(9)}", f"n{rnd.randrange(9)}") for _ in range(26)}
    pairs = [(a, b) for a, b in pairs if a != b]
    best = spark.createDataFrame([("d", a, b, f"{a}{b}", "R", 0.5, 0.5) for a, b in pairs], "dataset string, head string, tail string, edge_id string, relation string, strength double, confidence double").withColumn("parallel", F.lit(1))
    src, goal = spark.createDataFrame([("d", "n0")], "dataset string, id string"), spark.createDataFrame([("d", "n1"), ("d", "n2")], "dataset string, id string")
    found = []

    def walk(path):
        if len(path) > 1 and path[-1] in ("n1", "n2"):
            found.append(tuple(path))
        if len(path) <= 4:
            for a, b in pairs:
                if a == path[-1] and b not in path:
                    walk([*path, b])

    walk(["n0"])
    assert sorted(tuple(r["nodes"]) for r in paths.simple_paths(src, best, goal, 4).collect()) == sorted(found)


def test_totals_and_best_of_scored_paths_are_those_of_all_of_them(spark):
    rnd = random.Random(5)
    pairs = sorted({(f"n{a}", f"n{b}") for a, b in ((rnd.randrange(9), rnd.randrange(9)) for _ in range(30)) if a != b})
    rows = [("d", a, b, f"{a}{b}", "R", rnd.random(), 0.5, rnd.randint(1, 2)) for a, b in pairs]
    best = spark.createDataFrame(rows, "dataset string, head string, tail string, edge_id string, relation string, strength double, confidence double, parallel long")
    fields = ("anomaly_type", "variable", "object", "location")
    picked = [(f"c{i}", "d", f, f"n{rnd.randrange(9)}") for i in range(20) for f in fields[: rnd.randint(1, 4)]]
    selected = spark.createDataFrame(picked, "case_id string, dataset string, field string, entity_id string")
    src = spark.createDataFrame(sorted({("d", e) for _, _, f, e in picked if f in paths.SOURCE_FIELDS}), "dataset string, id string")
    goal = spark.createDataFrame([("d", "n1"), ("d", "n2")], "dataset string, id string")
    ends = paths.endings(src, best, goal, 4)
    for parallel in (True, False):
        every = paths.score_paths(selected, best, ends, 4, parallel=parallel).collect()
        ids = {c: {e for k, _, _, e in picked if k == c} for c in {r["case_id"] for r in every}}
        assert all(abs(r["match"] - len(set(r["nodes"]) & ids[r["case_id"]]) / len(ids[r["case_id"]])) < 1e-12 for r in every)
        for r in paths.score_totals(selected, best, ends, 4, parallel).collect():
            own = [x for x in every if x["target_id"] == r["target_id"]]
            assert (r["n_paths"], r["n_cases"], r["best"]) == (len(own), len({x["case_id"] for x in own}), max(x["score"] for x in own))
            assert abs(r["mean_score"] - sum(x["score"] for x in own) / len(own)) <= 0.5001e-4 and abs(r["mean_match"] - sum(x["match"] for x in own) / len(own)) <= 0.5001e-4
        kept = paths.score_paths(selected, best, ends, 4, 3, parallel).collect()
        for c in ids:
            scores = sorted((x["score"] for x in every if x["case_id"] == c), reverse=True)
            assert sorted((x["score"] for x in kept if x["case_id"] == c), reverse=True) == [s for s in scores if s >= scores[min(3, len(scores)) - 1]]


def test_ways_that_cannot_be_among_the_best_meet_no_endings(spark):
    """An entity that is surely passed by enough paths bounds a case's best; other ways to it, and the plain paths, are left out before endings are joined."""
    rows = [("d", "p", f"s{i}", f"ps{i}", "R", 0.9, 0.5, 1) for i in range(12)] + [("d", f"s{i}", f"t{j}", f"st{i}{j}", "R", 0.5, 0.5, 1) for i in range(12) for j in range(4)]
    best = spark.createDataFrame(rows, "dataset string, head string, tail string, edge_id string, relation string, strength double, confidence double, parallel long")
    picked = [("c1", "d", "anomaly_type", "p"), ("c1", "d", "object", "s3"), ("c2", "d", "variable", "p")]
    starts = paths._starts(spark.createDataFrame(picked, "case_id string, dataset string, field string, entity_id string"))
    goal = spark.createDataFrame([("d", f"t{j}") for j in range(4)], "dataset string, id string")
    src = spark.createDataFrame([("d", "p")], "dataset string, id string")
    ends = paths.endings(src, best, goal, 4)
    kept = paths._kept(starts, paths._first(src, best), ends, 4, 4)
    assert [tuple(r) for r in kept.where("case_id = 'c1'").groupBy("_n").count().selectExpr("_n[0]", "count").distinct().collect()] == [("s3", 1)] and kept.where("case_id = 'c1'").count() == 4
    top = paths.best_of(starts, best, ends, 4, 4).collect()
    assert {(r["case_id"], r["rank"], tuple(r["nodes"])) for r in top} == {(c, j + 1, ("p", s, f"t{j}")) for c, s in (("c1", "s3"), ("c2", "s0")) for j in range(4)}


def test_what_is_said_of_a_case_is_gathered_once(spark):
    n = nodes(spark, ("ScratchDefect", "scratch", "AnomalyType", "mvtec"), ("Rim", "rim", "Location", "mvtec"), *[(f"L{i}", f"l{i}", "Location", "mvtec") for i in range(9)])
    e = edges(spark, *[("ScratchDefect", r, f"L{i}", "mvtec", c) for i in range(9) for r, c in (("OCCURS_ON", 0.5 + i / 100), ("HAS_LOCATION", 0.57 - i / 100))])
    a = Analysis(mentions(spark, ("anomaly_type", "scratch"), ("location", "rim")), n, e)
    got = [(r["suggested"], r["score"], r["edge_id"].split("|")[1]) for r in a.corrections.orderBy("rank").collect()]
    assert got == [("l8", 0.58, "OCCURS_ON"), ("l0", 0.57, "HAS_LOCATION"), ("l7", 0.57, "OCCURS_ON"), ("l1", 0.56, "HAS_LOCATION"), ("l6", 0.56, "OCCURS_ON")]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(a.scores).count("Aggregate [") == 1 and "Aggregate [case_id" not in plan(a.corrections)


def test_overlay_use_counts_an_edge_once_and_needs_no_exchange_by_edge(spark):
    used = spark.createDataFrame([("c1", ["a", "b"], 2), ("c1", ["b", "x"], 2), ("c2", ["b"], 1), ("c3", [], 1)], "case_id string, edge_ids array<string>, paths long")
    overlay = spark.createDataFrame([("a",), ("x",), ("x",), ("z",)], "edge_id string")
    got = {tuple(r) for r in review.overlay_use(used, overlay, "paths").select("case_id", "paths", "path_edges", "overlay_edges", "contributes").collect()}
    assert got == {("c1", 2, 3, 2, True), ("c2", 1, 1, 0, False)}
    plan = review.overlay_use(used, F.broadcast(overlay.distinct()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(edge_id") <= 2 and plan.count("hashpartitioning(case_id") == 1


def test_lines_of_unknown_parts_leave_no_gap(spark, tmp_path):
    """Lines are numbered after those whose part, supplier or nation is not known have gone, as the SQL says."""
    from faultline.plans import domain

    for t in ("lineitem", "supplier", "nation", "part"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").where("p_partkey % 2 = 0" if t == "part" else "true").write.parquet(f"{tmp_path}/{t}.parquet")
    per = domain.case_lines(spark, str(tmp_path)).groupBy("l_orderkey").agg(F.max("nth").alias("last"), F.count("*").alias("n"))
    assert per.count() > 50 and per.where("last <> n").count() == 0
    m = domain.mentions(spark, str(tmp_path)).groupBy("case_id").agg(F.count(F.when(F.col("field") == "object", 1)).alias("n"))
    assert m.where("n <> 1").count() == 0


def test_merge_conflicts(spark):
    e = edges(spark, ("a", "R", "b", "s", 0.5), ("a", "R", "b", "s", 0.5), ("a", "R", "c", "s", 0.4)).withColumns({"review_status": F.lit("auto"), "source": F.lit("x"), "file_order": F.lit(1)})
    got = kg.merge_edges(e).collect()
    assert len(got) == 2 and not any(r["conflict"] for r in got)


def test_adapters(spark):
    row = [("c", "scratch", None, 0.5, 0.45, 0.91, 1.0, 1, 0.16)]
    df = spark.createDataFrame(row, "case_id string, defect_type string, zone string, centroid_x double, centroid_y double, eccentricity double, aspect_ratio double, component_count int, area_ratio double")
    r = evidence.adapt(df, "mvtec").first()
    assert (r["location"], r["morphology"], r["severity"], r["source"], r["valid"]) == ("surface", "linear", 0.16, "image", True)


def test_wafer_map(spark):
    cells = spark.createDataFrame([("m", i, j, 0 if (i, j) == (1, 1) else 2) for i in range(3) for j in range(3)], "grid_id string, row int, col int, value int")
    w = imaging.wafer_descriptors(cells).first()
    assert (w["die_count"], w["failed_count"], w["density"]) == (8, 8, 1.0) and imaging.components(cells).first()["components"] == 1
    p = spark.createDataFrame([("Near-Full",)], "p string").select(imaging.canonical_pattern(F.col("p")).alias("p"))
    assert first(p, imaging.wafer_location(F.col("p"), F.lit(1.0), F.lit(0.5), F.lit(0.5)), imaging.wafer_morphology(F.col("p"), F.lit(1.0), F.lit(1))) == ("wafer_surface", "dense_particles")


def test_threshold(spark):
    df = spark.createDataFrame([("bottle", 0.2, 0), ("bottle", 0.9, 1), ("one", 0.5, 1)], "object string, score double, positive int")
    assert [tuple(r) for r in imaging.best_thresholds(df, "object").collect()] == [("bottle", 0.9, 1.0)]


def test_window_contributions(spark):
    free = spark.createDataFrame([("view", 1, s, float(s), 0.1 * s, 2.0 * s, s) for s in range(1, 21)], "fault string, run int, sample int, a double, b double, c double, seq int")
    bad = spark.createDataFrame([("f", 1, s, float(s), 0.1 * s + 20, 2.0 * s, s) for s in range(1, 7)], free.schema)
    ch = ["a", "b", "c"]
    fitted = timeseries.profile(timeseries.long(free.drop("seq"), ch))
    wins = timeseries.windows(bad, 4, 1)
    assert wins.count() == 4 and timeseries.windows(bad, 7, 1).count() == 0
    z = timeseries.standardize(timeseries.long(wins.drop("seq", "place"), ch), fitted)
    axes = timeseries.principal_axes(free, ch, 1)
    left = timeseries.residual(z.groupBy("fault", "run", "sample").pivot("channel", ch).agg(F.first("z")), ch, axes)
    share = {r["channel"]: r["share"] for r in timeseries.contributions(timeseries.long(left, ch).withColumnRenamed("value", "z"), ["fault", "run"]).collect()}
    assert max(share, key=share.get) == "b" and share["b"] > 0.5


def spread_plainly(edge_rows, families, source, seed):
    """A plain model of the propagation, hop by hop over dictionaries."""
    score, front, got = {source: seed}, {source: seed}, {}
    for hop in range(1, 5):
        new = {}
        for fam in sorted(families, key=lambda f: (-families[f][1], f)):
            for n in sorted(front):
                for h, t, i, f, w in sorted((e for e in edge_rows if e[0] == n and e[3] == fam), key=lambda e: (e[1], e[2])):
                    k = got.get((t, f), 0) + 1
                    d = front[n] * w * math.exp(-families[f][0] * hop) / k
                    room = max(0.0, 1.0 - score.get(t, 0.0) - new.get(t, 0.0))
                    if d <= 1e-6 or room <= 1e-6:
                        continue
                    got[t, f] = k
                    new[t] = new.get(t, 0.0) + min(d, room)
        if sum(new.values()) <= 1e-6:
            break
        for t, d in new.items():
            score[t] = score.get(t, 0.0) + d
        front = new
    return {n: round(s, 8) for n, s in score.items()}


def test_propagation_against_a_plain_model(spark):
    graphs, rows = {}, []
    for seed in range(12):
        rnd = random.Random(seed)
        graphs[seed] = [(f"g{seed}n{rnd.randrange(7)}", f"g{seed}n{rnd.randrange(7)}", f"g{seed}e{i}", rnd.choice(list(signals.FAMILIES)), rnd.choice([0.2, 0.6, 0.95, 1.0])) for i in range(22)]
        rows += graphs[seed]
    src = spark.createDataFrame([(str(s), f"g{s}n0", 0.9) for s in graphs], "case_id string, source string, seed double")
    got: dict = {}
    for r in propagation.propagate(src, spark.createDataFrame(rows, "head string, tail string, edge_id string, family string, weight double")).collect():
        got.setdefault(int(r["case_id"]), {})[r["node"]] = r
    ends = {e[2]: e[:2] for e in rows}
    for seed, edge_rows in graphs.items():
        want = spread_plainly(edge_rows, signals.FAMILIES, f"g{seed}n0", 0.9)
        assert got[seed].keys() == want.keys() and all(np.isclose(got[seed][n]["score"], want[n], atol=2e-8) for n in want)
        for n, r in got[seed].items():
            walk = [ends[e] for e in r["path"].split(">") if e]
            assert not walk or walk[0][0] == f"g{seed}n0" and walk[-1][1] == n and all(a[1] == b[0] for a, b in zip(walk, walk[1:]))


def plant(spark, contributions, profiles=None, dynamics=(), edges=None):
    """Two anchors, three variables and three edges of weight 0.95, with contributions (case, variable, value)."""
    node = "id string, name string, type string, role string, candidate boolean, variable_role string, targets array<string>, provenance array<string>"
    names = [("faultanchor:cooling_fault", "Cooling fault"), ("faultanchor:feed_fault", "Feed fault")]
    nodes = [(i, n, "FaultAnchor", "root_cause_anchor", True, "", [], []) for i, n in names] + [(f"variable:xmeas_{i}", f"XMEAS_{i}", "Variable", "", False, "sensor", [], []) for i in (1, 2, 3)]
    rows = edges or [("edge_cooling_xmeas_1", names[0][0], "variable:xmeas_1"), ("edge_cooling_xmeas_3", names[0][0], "variable:xmeas_3"), ("edge_feed_xmeas_2", names[1][0], "variable:xmeas_2")]
    e = spark.createDataFrame([(*r, "OBSERVATION", 0.95, [f"prov_{r[0]}"]) for r in rows], "edge_id string, head string, tail string, family string, weight double, provenance array<string>")
    c = spark.createDataFrame(contributions, "case_id string, id string, value double")
    return RootCauses(spark.createDataFrame(nodes, node), e, c, spark.createDataFrame(list(dynamics), "case_id string, feature string, value double"), profiles=profiles)


def test_root_causes_follow_the_contributions(spark):
    v = "variable:xmeas_"
    r = plant(spark, [("one", v + "1", 0.9), ("one", v + "2", 0.1), ("two", v + "1", 0.1), ("two", v + "2", 0.9)])
    got = {(x["case_id"], x["rank"]): x["id"] for x in r.ranked.collect()}
    assert [got["one", 1], got["one", 2]] == ["faultanchor:cooling_fault", "faultanchor:feed_fault"]
    assert [got["two", 1], got["two", 2]] == ["faultanchor:feed_fault", "faultanchor:cooling_fault"]
    first = r.support.where("case_id = 'one' and source = 'faultanchor:cooling_fault' and place = 1").first()
    assert first["nodes"] == ["faultanchor:cooling_fault", v + "1"] and first["path"] == ["edge_cooling_xmeas_1"]
    scored = {(x["case_id"], x["id"]): x for x in r.scored.collect()}
    cooling = scored["one", "faultanchor:cooling_fault"]
    # by hand: support 0.9 * 0.95 * 0.92, seed at its cap, two equal variables of which one is observed
    assert cooling["support"] == pytest.approx(0.9 * 0.95 * 0.92) and cooling["seed"] == 0.35 and cooling["adjacent"] == 0.9 and cooling["priority"] == 1
    root = 0.9 / math.sqrt(0.9**2 + 0.1**2) / math.sqrt(2)
    want = root - 0.12 * 0.75 * 0.9 - 0.03 * 0.5 * math.log(2) + 0.06 + 0.10
    assert cooling["root_score"] == pytest.approx(root, abs=1e-7) and cooling["base"] == pytest.approx(want, abs=1e-7)
    nodes = {(x["source"], x["id"]): x for x in r.subgraph_nodes(1).where("case_id = 'one'").collect()}
    assert set(nodes) == {("faultanchor:cooling_fault", i) for i in ("faultanchor:cooling_fault", v + "1", v + "3")}
    assert nodes["faultanchor:cooling_fault", v + "1"]["root_share"] == pytest.approx(0.35 * 0.95 * math.exp(-0.32), abs=1e-7)
    assert r.subgraph_edges(1).where("case_id = 'one'").count() == 2 and r.report().first()["cases"] == 2
    assert r.evidence.where("case_id = 'one' and source = 'faultanchor:feed_fault'").first()["evidence"] == ["prov_edge_feed_xmeas_2"]


def test_a_case_without_contributions_has_all_anchors(spark):
    r = plant(spark, [("one", "variable:xmeas_1", 0.9)])
    r.cases = spark.createDataFrame([("one",), ("none",)], "case_id string")
    got = {(x["case_id"], x["id"]): (x["priority"], x["support"]) for x in r.candidates.collect()}
    assert got["none", "faultanchor:feed_fault"] == (3, 0.0) and got["one", "faultanchor:feed_fault"] == (3, 0.0) and len(got) == 4


def test_memory_prefers_the_anchor_that_had_this_before(spark):
    v = "variable:xmeas_"
    even = [("now", v + "1", 0.5), ("now", v + "2", 0.5)]
    faults = spark.createDataFrame([("old", "faultanchor:feed_fault"), ("older", "faultanchor:cooling_fault")], "case_id string, anchor string")
    past = spark.createDataFrame([("old", v + "1", 0.5), ("old", v + "2", 0.5), ("older", v + "3", 1.0)], "case_id string, feature string, value double")
    still = spark.createDataFrame([("old", "xmeas_2__std", 2.0), ("older", "xmeas_1__std", -1.0)], "case_id string, feature string, value double")
    profiles = anchors.profiles_of(past, still, faults)
    r = plant(spark, even, profiles, [("now", "xmeas_2__std", 1.0)])
    feed = next(x for x in r.ranked.collect() if x["id"] == "faultanchor:feed_fault")
    assert feed["rank"] == 1 and feed["contribution_alignment"] == 1.0 and feed["dynamic_alignment"] == 1.0 and feed["memory_bonus"] == 9.0 and feed["unique_alignment"] == 1.0
    other = next(x for x in r.ranked.collect() if x["id"] == "faultanchor:cooling_fault")
    assert other["memory_bonus"] == 0.0


def test_signature_coverage_needs_the_sign(spark):
    seen = spark.createDataFrame([("c", "a", 0.5), ("c", "b", -0.2), ("c", "d", 9.0)], "case_id string, feature string, value double")
    sig = spark.createDataFrame([("x", "a", 1.0), ("x", "b", 0.5), ("x", "d", 0.5)], "anchor string, feature string, value double")
    assert anchors.signature_coverage(seen, sig, "case_id").first()["coverage"] == pytest.approx((0.5 + 0.5) / 2.0)


def test_propagation_ranks_the_right_source(spark):
    e = spark.createDataFrame([("cooling", "xmeas_1", "e1", "ENERGY_TRANSFER", 0.95), ("cooling", "xmeas_3", "e2", "ENERGY_TRANSFER", 0.95), ("feed", "xmeas_2", "e3", "MATERIAL_FLOW", 0.95)], "head string, tail string, edge_id string, family string, weight double")
    src = spark.createDataFrame([("c", "cooling", 0.35), ("c", "feed", 0.12)], "case_id string, source string, seed double")
    got = {(r["source"], r["node"]): r for r in propagation.propagate(src, e).collect()}
    assert got["cooling", "xmeas_1"]["path"] == "e1" and got["cooling", "xmeas_1"]["score"] > got["feed", "xmeas_2"]["score"]


def rank(rule, *rows, **features):
    ranking = rules.Ranking([{"id": i, "base": b, **more} for i, b, more in rows], features)
    ranking.apply(rule)
    return ranking.by


@pytest.mark.parametrize("gap, bonus", [(0.05, 0.06), (0.12, 0.13), (0.121, 0.0)])
def test_rule_gap(gap, bonus):
    rule = rules.Rule("r", "t", ("v",), 0.12, 0.14, 3, margin=0.01)
    assert rank(rule, ("t", 0.5, {}), ("v", 0.5 + gap, {}))["t"]["score"] == pytest.approx(0.5 + bonus)
    assert rank(rule, ("t", 0.5, {}), ("other", 0.5 + gap, {}))["t"]["score"] == 0.5


def test_adjust_is_each_case_on_its_own_in_many_tasks(spark):
    cold = {"xmeas_18__mean": -2.0, "xmeas_19__mean": 1.0, "xmeas_19__std": 1.6}
    bases = [(f"c{i}", rules.STREAM4, 0.5 + i % 5 / 100, 0.1) for i in range(60)] + [(f"c{i}", rules.STRIPPER, 0.9, None) for i in range(60)]
    said = [(f"c{i}", "dynamic", f, v) for i in range(60) if i % 3 for f, v in cold.items()] + [("c0", "dynamic", f, None) for f in cold] + [("no case", "dynamic", "xmeas_18__mean", 1.0)]
    cands = spark.createDataFrame(bases, "case_id string, id string, base double, memory_bonus double")
    got = rules.adjust(cands, spark.createDataFrame(said, "case_id string, kind string, feature string, value double"), {}).withColumn("task", F.spark_partition_id()).collect()
    want = {}
    for c in {b[0] for b in bases}:
        r = rules.Ranking([{"id": i, "base": b, "memory_bonus": m} for k, i, b, m in bases if k == c], {f: v for k, _, f, v in said if k == c and v is not None})
        for rule in rules.RULES:
            r.apply(rule)
        want |= {(c, x["id"]): (n + 1, x["score"], x["adjustment"], x.get("stream4_cold_response_bonus", 0.0)) for n, x in enumerate(r.ordered())}
    assert {(r["case_id"], r["id"]): (r["rank"], r["score"], r["adjustment"], r["stream4_cold_response_bonus"]) for r in got} == want
    assert want["c0", rules.STREAM4][2] == 0.0 and want["c1", rules.STREAM4][2] > 0.5  # a null reading is none
    assert len({r["task"] for r in got}) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_disabled_rules_change_nothing():
    for r in rules.RULES:
        if not r.enabled:
            by = rank(r, (r.target, 0.5, {}), *[(x, 0.55, {}) for x in r.leaders], **{s.features[0]: 9.0 for s in r.signals})
            assert by[r.target]["adjustment"] == 0.0


def named(name, leader=None):
    return next(r for r in rules.RULES if r.name == name and (leader is None or leader in r.leaders))


def test_cold_response_needs_all_its_signals():
    rows = ((rules.STREAM4, 0.5, {}), (rules.STRIPPER, 0.9, {}))
    full = {"xmeas_18__mean": -2.0, "xmeas_19__mean": 2.0, "xmeas_19__std": 1.6}
    assert rank(named("stream4_cold_response"), *rows, **full)[rules.STREAM4]["adjustment"] == pytest.approx(0.8)
    assert rank(named("stream4_cold_response"), *rows, **full | {"xmeas_19__std": 2.3})[rules.STREAM4]["adjustment"] == 0.0
    assert rank(named("stream4_cold_response"), (rules.STREAM4, 0.5, {}), (rules.STRIPPER, 1.26, {}), **full)[rules.STREAM4]["adjustment"] == 0.0


def test_condenser_bonus_follows_the_family():
    full = {"xmeas_22__std": 12.0, "xmeas_22__mean": -5.0, "xmeas_11__std": 6.5}
    for activation, bonus in ((0.59, 0.0), (0.60, 1.4 * 0.6)):
        by = rank(named("condenser_dynamic"), (rules.CONDENSER, 0.5, {"family_activation": activation}), ("x", 1.0, {}), **full)
        assert by[rules.CONDENSER]["adjustment"] == pytest.approx(bonus) and by[rules.CONDENSER]["condenser_dynamic_signature"] == 1.0


def test_stream2_has_two_triggers():
    one = {"xmeas_30__mean": 1.0}
    by = rank(named("stream2_competition", rules.SEPARATOR), (rules.STREAM2, 0.5, {}), (rules.SEPARATOR, 0.9, {}), **one)
    assert by[rules.STREAM2]["adjustment"] == 0.5
    rows = [(rules.STREAM2, 0.6, {}), (rules.SEPARATOR, 0.8, {"family_activation": 0.5}), (rules.CONDENSER, 0.9, {})]
    assert rank(named("stream2_competition", rules.CONDENSER), *rows, **one)[rules.STREAM2]["adjustment"] == 0.5
    rows[1] = (rules.SEPARATOR, 0.77, {"family_activation": 0.5})  # the two that lead are too far apart
    assert rank(named("stream2_competition", rules.CONDENSER), *rows, **one)[rules.STREAM2]["adjustment"] == 0.0


@pytest.mark.parametrize("memory, unique, raised", [(0.04, 0.10, True), (0.039, 0.10, False), (0.04, 0.099, False)])
def test_stripper_tiebreak(memory, unique, raised):
    by = rank(named("stripper_tiebreak"), (rules.STRIPPER, 0.5, {"memory_bonus": memory, "unique_alignment": unique}), (rules.STREAM4, 0.55, {}))
    assert (by[rules.STRIPPER]["adjustment"] > 0) == raised


def test_anchors_are_preferred_to_what_they_stand_for():
    for gap, bonus in ((0.0, 0.09), (0.05, 0.04), (0.09, 0.0), (0.2, 0.0), (-0.3, 0.09)):
        ranking = rules.Ranking([{"id": "a", "base": 0.5, "role": "root_cause_anchor", "direct_targets": "t"}, {"id": "t", "base": 0.5 + gap, "role": "actuator"}])
        ranking.prefer_anchors()
        assert ranking.by["a"]["adjustment"] == pytest.approx(bonus)


def test_family_shares_a_bonus():
    ranking = rules.Ranking([{"id": i, "base": 0.5} for i in (*rules.FAMILY, "x")])
    ranking.apply_family({"v1": 0.4, "v2": 0.4, "v3": 0.2}, {rules.SEPARATOR_INLET: ["v1"], rules.SEPARATOR: ["v2"], rules.CONDENSER: ["v2", "v9"]})
    got = {i: r["adjustment"] for i, r in ranking.by.items()}
    assert got == pytest.approx({rules.SEPARATOR_INLET: 0.3 * 0.8 * 0.4 + 0.2 * 0.4, rules.SEPARATOR: 0.3 * 0.8 * 0.4, rules.CONDENSER: 0.3 * 0.8 * 0.4, "x": 0.0})


def test_metrics(spark):
    cases = spark.createDataFrame([("1",), ("2",)], "case_id string")
    ranked = spark.createDataFrame([("1", "Wrong", 1), ("1", "CauseA", 2), ("2", "CauseB", 1)], "case_id string, item string, rank int")
    gold = spark.createDataFrame([("1", "CauseA"), ("2", "CauseB")], "case_id string, item string")
    assert first(metrics.mean_reciprocal_rank(cases, ranked, gold), "mrr") == (0.75,)
    assert first(metrics.top_k(cases, ranked, gold.where("case_id = '1'"), [2]), "accuracy_at_2") == (0.5,)
    with pytest.raises(ValueError):
        metrics.top_k(cases, ranked, gold, [0])
    flags = "case_id string, field string"
    more = [("2", "location"), ("3", "object")]
    one = spark.createDataFrame([("1", "anomaly_type"), ("1", "raw_evidence.variables"), ("2", "location")], flags)
    two = spark.createDataFrame([("1", "anomaly_type"), ("1", "variables"), *more[1:], ("2", "morphology")], flags)
    assert first(metrics.precision_recall(one, two), "tp", "fp", "fn") == (2, 2, 1)
    e = spark.createDataFrame([("1", "anomaly_type"), ("1", "raw_evidence.variables"), ("2", "location")], flags)
    p = spark.createDataFrame([("1", "anomaly_type"), ("1", "variable"), ("2", "morphology")], flags)
    assert first(metrics.precision_recall(e, p), "tp", "fp", "fn", "precision", "recall") == (2, 1, 1, 0.666667, 0.666667)
    pairs = spark.createDataFrame([("linear morphology", "Linear_Morphology"), ("surface", "wrong")], "g string, p string")
    assert first(metrics.pair_accuracy(pairs, metrics.value_key(F.col("g")), metrics.value_key(F.col("p"))), "accuracy") == (0.5,)


def noise_case(spark, dataset="mvtec", anomaly="scratch", location="edge", morphology="linear", variables=("XMEAS_1",), shares=None, events=()):
    schema = "case_id string, dataset string, anomaly_type string, location string, morphology string, variables array<string>, variable_contributions map<string,double>, log_events array<string>"
    return spark.createDataFrame([("c", dataset, anomaly, location, morphology, list(variables), shares if shares is not None else {v: 0.5 for v in variables}, list(events))], schema)


def injected(df, kind, level=0.1):
    return noise.inject(df, levels=(level,), kinds=(kind,)).first()


def test_noise_deletes_the_only_variable(spark):
    r = injected(noise_case(spark), "variable_deletion")
    assert r["variables"] == [] and r["variable_contributions"] == {} and r["is_noisy"] and r["corrupted"] == ["raw_evidence.variables", "raw_evidence.variable_contributions"]
    ten = [f"v{i}" for i in range(10)]
    r = injected(noise_case(spark, variables=ten), "variable_deletion", 0.25)
    assert len(r["variables"]) == 7 and r["variables"] == [v for v in ten if v in r["variables"]] and set(r["variable_contributions"]) == set(r["variables"])
    assert not injected(noise_case(spark, variables=()), "variable_deletion")["is_noisy"]


@pytest.mark.parametrize(
    "dataset, kind, field, values",
    [
        ("mvtec", "anomaly_type_replacement", "anomaly_type", {"color", "crack", "contamination", "squeeze"}),
        ("tep", "anomaly_type_replacement", "anomaly_type", {"unknown_process_fault"}),
        ("wafer", "anomaly_type_replacement", "anomaly_type", {"process_fault"}),
        ("wafer", "location_replacement", "location", {"reactor", "surface"}),
        ("mvtec", "morphology_replacement", "morphology", {"dense_particles", "surface"}),
        ("tep", "morphology_replacement", "morphology", {"dense_particles"}),
        ("tep", "contradiction_injection", "location", {"feed disturbance"}),
        ("wafer", "contradiction_injection", "morphology", {"wafer_surface"}),
        ("mvtec", "contradiction_injection", "morphology", {"surface"}),
    ],
)
def test_noise_replaces_by_values_of_the_dataset(spark, dataset, kind, field, values):
    r = injected(noise_case(spark, dataset), kind)
    assert r[field] in values and r["corrupted"] == [field] and r["is_noisy"]


def test_noise_renames(spark):
    r = injected(noise_case(spark), "variable_name_perturbation")
    assert r["variables"] == ["XMEAS1"] and r["variable_contributions"] == {"XMEAS1": 0.5}
    assert injected(noise_case(spark, variables=("flow",)), "variable_name_perturbation")["variables"] == ["flow_perturbed"]
    r = injected(noise_case(spark, anomaly="x", location=None, morphology=None), "synonym_substitution")
    assert r["variables"] == ["xmeas1"] and r["variable_contributions"] == {"xmeas1": 0.5} and r["corrupted"] == ["raw_evidence.variables"]
    r = injected(noise_case(spark, anomaly="x", location=None, morphology=None, variables=(), events=("example_alarm", "other")), "synonym_substitution")
    assert r["log_events"] == ["example alarm", "other"] and r["corrupted"] == ["raw_evidence.log_events"]
    assert injected(noise_case(spark, events=("a",)), "log_event_deletion")["log_events"] == []
    assert not injected(noise_case(spark, anomaly="x", location=None, morphology=None, variables=()), "synonym_substitution")["is_noisy"]
    with pytest.raises(ValueError):
        noise.inject(noise_case(spark), kinds=("other",))


def test_linking_finds_partial_and_fuzzy_matches(spark):
    n = nodes(spark, ("ScratchDefect", "Scratch defect", "Defect", "mvtec"), ("RimLocation", "outer rim", "Location", "mvtec"), ("Rim", "rimm", "Object", "mvtec"))
    a = Analysis(mentions(spark, ("anomaly_type", "scratch"), ("location", "outer rin"), ("object", "zzz")), n, edges(spark, ("ScratchDefect", "OCCURS_ON", "RimLocation", "mvtec", 0.9)))
    got = {r["field"]: (r["entity_id"], r["match_type"], r["score"]) for r in a.links.collect()}
    assert got["anomaly_type"] == ("ScratchDefect", "partial", 0.82) and got["object"] == (None, None, None)
    assert got["location"][:2] == ("RimLocation", "fuzzy") and got["location"][2] == round(2 * 7 / 16, 4)
    assert a.checks.first()["passed"]


def test_reasoners_give_way_to_paths(spark):
    n = nodes(spark, ("Scratch", "scratch", "AnomalyType", "mvtec"), ("HandlingDamage", "h", "RootCause", "mvtec"))
    e = edges(spark, ("Scratch", "HAS_PLAUSIBLE_CAUSE", "HandlingDamage", "mvtec", 0.75))
    none = lambda a: spark.createDataFrame([], "case_id string, cause string, score double, rank int")
    one = lambda a: spark.createDataFrame([("c1", "Own", 0.9, 1), ("c1", "Late", 0.1, 9)], "case_id string, cause string, score double, rank int")
    for reasoner, want in ((none, ("HandlingDamage", "path_ranker", True)), (one, ("Own", "mvtec", False))):
        a = Analysis(mentions(spark, ("anomaly_type", "scratch")), n, e, reasoners={"mvtec": reasoner})
        assert [(r["cause"], r["method"], r["fallback"]) for r in a.causes.collect()] == [want]


def test_parallel_edges_count_for_each_combination(spark):
    n = nodes(spark, ("Scratch", "scratch", "AnomalyType", "mvtec"), ("X", "x", "Object", "mvtec"), ("C", "h", "RootCause", "mvtec"))
    e = edges(spark, ("Scratch", "R1", "X", "mvtec", 0.9), ("Scratch", "R2", "X", "mvtec", 0.8), ("X", "R1", "C", "mvtec", 0.7), ("X", "R2", "C", "mvtec", 0.6), ("X", "R3", "C", "mvtec", 0.5))
    for parallel, n_paths in ((True, 5), (False, 1)):
        a = Analysis(mentions(spark, ("anomaly_type", "scratch")), n, e, parallel=parallel)
        top = a.top.collect()
        assert len(top) == n_paths and {tuple(r["edge_ids"]) for r in top} == {("Scratch|R1|X|mvtec", "X|R1|C|mvtec")} and a.scored.count() == (6 if parallel else 1)


def test_chunks():
    t = ("line of words\n" * 2000).strip()
    spans = compiler.spans(t)
    assert spans[0][0] == 0 and spans[-1][1] == len(t) and all(b - a <= compiler.CHUNK for a, b in spans)
    assert all(c < b and t[b] == "\n" for (_, b), (c, _) in zip(spans, spans[1:]))
    assert compiler.spans("") == [] and compiler.spans("abc") == [(0, 3)]


def test_resolution_priority(spark):
    e = nodes(spark, ("Pump", "other", "Object", "tep"), ("X", "pump", "Object", "shared"), ("Y", "y", "Object", "wafer", "valve")).withColumn("ord", F.col("id"))
    asked = spark.createDataFrame([("pump", "tep"), ("valve", "wafer"), ("valve", "tep")], "name string, scenario string")
    assert {tuple(r) for r in compiler.resolve(asked, e).collect()} == {("pump", "tep", "Pump"), ("valve", "wafer", "Y")}


def test_confidence_is_held_after_each_decision(spark):
    df = spark.createDataFrame([(["accept", "accept", "reject"],)], "d array<string>")
    assert first(df, F.round(review.confidence_fold(F.lit(0.99), F.col("d")), 6)) == (0.95,)


def test_support_paths_avoid_other_causes(spark):
    e = edges(spark, ("c1", "R", "c2", "s", 0.9), ("c2", "R", "v", "s", 0.9), ("c1", "R", "m", "s", 0.5), ("m", "R", "v", "s", 0.5))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = {(r["cause"], r["variable"]): len(r["path"]) for r in propagation.support_paths(ids("c1", "c2"), ids("v"), e).collect()}
    assert got == {("c1", "v"): 2, ("c2", "v"): 1}


def test_checks_need_both_fields(spark):
    s = spark.createDataFrame([("c", "mvtec", "anomaly_type", "a")], "case_id string, dataset string, field string, entity_id string")
    e = kg.visible_edges(nodes(spark, ("a", "a", "X", "mvtec")), edges(spark, ("a", "R", "a", "mvtec", 1.0)), ["mvtec"])
    assert consistency.checks(s, e).count() == 0


def test_forbidden_keys_go_at_every_depth(spark):
    df = spark.createDataFrame([('{"a": [{"root_cause": 1, "b": 2}], "kg_analysis": {}}',), ("not json",), (None,)], "j string")
    assert [r[0] for r in df.select(evidence.scrub_json(F.col("j"))).collect()] == ['{"a": [{"b": 2}]}', None, None]


def test_compile(spark):
    units = spark.createDataFrame([("u1", "mvtec", "Scratch Defect CAUSED_BY Handling Cause.\nnoise\nScratch defect CAUSED_BY Handling Cause"), ("u2", "mvtec", "Handling Cause PART_OF Handling Cause.")], "unit_id string, scenario string, text string")
    c = Compiled(units)
    assert {r["id"]: r["label"] for r in c.entities.collect()} == {"ScratchDefect": "Defect", "HandlingCause": "CandidateCause"}
    assert [r["edge_id"] for r in c.edges.collect()] == ["ScratchDefect|CAUSED_BY|HandlingCause|mvtec"]
    assert c.cards.count() == 2 and c.violations.count() == 0


def test_observations_number_an_orders_lines_once_and_tokens_keep_their_form(spark):
    from faultline.queries import QUERIES

    plan = QUERIES["observation_ids"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2
    said = ["", "_", "__a__", " A  b!", "é_ß", "1", "--x--y--", None]
    c = F.col("s")
    both = spark.createDataFrame([(s,) for s in said], "s string").select(text.token(c).alias("a"), F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), "^_|_$", "").alias("b"))
    assert all(r["a"] == r["b"] for r in both.collect())
