"""Stored rankings meet the cases of their run by their first rows alone."""

from pyspark.sql import functions as F

from faultline.operators import artifacts


def test_only_the_first_rows_of_a_run_meet_its_cases(spark):
    cases = spark.createDataFrame([(f"c{i}", f"s{i}" if i % 4 == 0 else None, i % 2, 0) for i in range(40)], "case_id string, scenario_id string, fault int, run int")
    stored = [(f"s{4 * (i % 5)}" if i % 3 == 0 else None, i % 2 if i % 7 else None, 0 if i % 7 else None, i % 9 if i % 2 else None, f"P{i:03d}", (i * 37 % 101) / 10) for i in range(300)]
    rows = spark.createDataFrame(stored, "scenario_id string, fault int, run int, rank int, candidate_id string, score double")
    order = [F.coalesce(F.nullif(F.col("rank"), F.lit(0)), F.lit(1_000_000)), F.desc("score"), F.col("candidate_id")]
    met = artifacts.match_scenarios(cases, rows, True, order, 3)
    assert met.where("how <> 'global'").groupBy("case_id").count().agg(F.max("count")).first()[0] == 3 and met.where("how = 'global'").count() == 40 * 3
    none = [F.lit(None).cast("double").alias(c) for c in ("ranking_score", "root_score", "structural_ranking_score", "confidence")]
    out = artifacts.bridge(cases, rows.select("*", *none), spark.createDataFrame([], "ord long, scenario_id string, fault int, run int"), 3, True)
    have = {}
    for r in out.collect():
        have.setdefault(r["case_id"], set()).add((r["cause"], r["how"]))
    for case, scenario, fault, run in [tuple(r) for r in cases.collect()]:
        own = [(r, "scenario") for r in stored if scenario and r[0] == scenario] or [(r, "fault_run") for r in stored if r[1] == fault and r[2] == run]
        own += [(r, "global") for r in stored if r[:3] == (None, None, None)]
        first = sorted(own, key=lambda x: (x[0][3] or 1_000_000, -x[0][5], x[0][4]))[:3]
        assert have[case] == {(r[4], how) for r, how in first}
