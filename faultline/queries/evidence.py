"""Queries over records and evidence: adapters, observations, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import evidence, imaging
from ..plans import domain
from .registry import registry
from .sql import scen, sql

QUERIES, ORACLE_SQL, query = registry()


def records(spark, d):
    """Each order's first line as a producer's record, its fields under changing names; dataset: whose it is."""
    l = domain.case_lines(spark, d).where("nth = 1")
    odd = F.col("l_orderkey") % 2 == 1
    return l.select(
        domain.scenario(F.col("l_partkey")).alias("dataset"),
        F.when(F.col("l_orderkey") % 11 != 0, F.concat(F.lit("case_"), F.col("l_orderkey").cast("string"))).alias("sample_id"),
        F.when(~odd, F.col("s_name")).alias("object"),
        F.when(odd, F.col("s_name")).alias("category"),
        F.when(F.col("l_returnflag") != "R", F.col("p_name")).alias("defect_type"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("  "), F.col("p_type"))).alias("failure_pattern"),
        F.col("p_brand").alias("fault"),
        F.when(F.col("l_quantity") >= 25, F.col("n_name")).otherwise(F.lit(" ")).alias("zone"),
        F.when(F.col("l_quantity") < 25, F.col("n_name")).alias("unit"),
        F.when(F.col("l_linestatus") == "O", F.lit("ring")).alias("shape"),
        F.when(F.col("l_discount") > 0.05, F.col("l_discount") * 12).alias("score"),
        (F.col("l_quantity") / 50).alias("centroid_x"),
        (F.col("l_discount") * 10).alias("centroid_y"),
        (F.col("l_tax") * 11).alias("eccentricity"),
        (F.col("l_quantity") / 10).alias("aspect_ratio"),
        F.col("l_linenumber").alias("component_count"),
        (F.col("l_tax") * 5).alias("area_ratio"),
        (F.col("l_tax") * 10).alias("density"),
        (F.col("l_quantity") / 50).alias("x_norm"),
        (F.col("l_discount") * 10).alias("y_norm"),
        F.col("l_linenumber").alias("components"),
        F.array(F.col("p_brand"), F.lit(" "), F.col("p_type"), F.col("p_brand")).alias("sensors"),
        F.create_map("p_brand", "l_tax").alias("contributions"),
        F.when(odd, F.concat(F.lit(" stop, "), F.col("l_returnflag"))).alias("alarms"),
        F.col("l_linenumber").alias("window_start"),
        F.when(odd, F.lit("end")).alias("window_end"),
        F.when(F.col("l_orderkey") % 3 == 0, F.lit("image")).otherwise(F.lit("camera")).alias("source"),
    )


def _adapted(spark, d):
    rows = records(spark, d)
    parts = [evidence.adapt(rows.where(F.col("dataset") == x), x) for x in ("mvtec", "tep", "wafer")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_R = "sqrt((l_quantity / 50 - 0.5) * (l_quantity / 50 - 0.5) + (l_discount * 10 - 0.5) * (l_discount * 10 - 0.5)) / 0.5"
_ADAPTED = f"""
  SELECT case_id, dataset, source, object, anomaly_type, location, morphology, severity, confidence, variables, contribution, log_events, time_window,
    coalesce(severity BETWEEN 0 AND 1, true) AND coalesce(confidence BETWEEN 0 AND 1, true) AS valid FROM (
  SELECT CASE WHEN l_orderkey % 11 <> 0 THEN 'case_' || l_orderkey ELSE dataset || '_unknown' END AS case_id, dataset,
    CASE WHEN l_orderkey % 3 = 0 THEN 'image' ELSE CASE dataset WHEN 'mvtec' THEN 'image' WHEN 'tep' THEN 'time_series' ELSE 'multimodal' END END AS source,
    CASE WHEN l_orderkey % 2 = 0 OR dataset = 'mvtec' THEN s_name WHEN dataset = 'tep' THEN 'process' ELSE 'wafer' END AS object,
    CASE dataset WHEN 'tep' THEN p_brand WHEN 'mvtec' THEN CASE WHEN l_returnflag = 'R' THEN 'unknown' ELSE p_name END ELSE CASE WHEN l_returnflag = 'R' THEN p_type ELSE p_name END END AS anomaly_type,
    CASE dataset WHEN 'tep' THEN CASE WHEN l_quantity < 25 THEN n_name END
      WHEN 'mvtec' THEN CASE WHEN l_quantity / 50 > 0.2 AND l_quantity / 50 < 0.8 AND l_discount * 10 > 0.2 AND l_discount * 10 < 0.8 THEN 'surface' ELSE 'edge' END
      ELSE CASE WHEN l_quantity >= 25 THEN n_name WHEN l_tax * 10 >= 0.45 THEN 'wafer_surface' WHEN {_R} >= 0.6 THEN 'edge' WHEN {_R} <= 0.25 THEN 'center' ELSE 'local' END END AS location,
    CASE WHEN dataset = 'tep' THEN NULL WHEN l_linestatus = 'O' THEN 'ring'
      WHEN dataset = 'mvtec' THEN CASE WHEN l_tax * 11 >= 0.8 OR l_quantity / 10 >= 3 THEN 'linear' WHEN l_linenumber >= 4 THEN 'scattered' WHEN l_tax * 5 >= 0.35 THEN 'dense' WHEN l_tax > 0 THEN 'spot' END
      ELSE CASE WHEN l_tax * 10 >= 0.45 THEN 'dense_particles' WHEN l_linenumber >= 4 THEN 'scattered' WHEN l_linenumber <= 2 THEN 'clustered' END END AS morphology,
    CASE WHEN dataset = 'mvtec' THEN round(greatest(0, least(1, l_tax * 5)), 6) END AS severity, round(CASE WHEN l_discount > 0.05 THEN l_discount * 12 END, 6) AS confidence,
    CASE WHEN dataset = 'mvtec' THEN '' ELSE p_brand || '|' || p_type || '|' || p_brand END AS variables, CASE WHEN dataset <> 'mvtec' THEN l_tax END AS contribution,
    CASE WHEN dataset = 'wafer' AND l_orderkey % 2 = 1 THEN 'stop|' || l_returnflag ELSE '' END AS log_events,
    CASE WHEN dataset = 'tep' THEN '{{"window_start":"' || l_linenumber || '"' || CASE WHEN l_orderkey % 2 = 1 THEN ',"window_end":"end"' ELSE '' END || '}}' END AS time_window
  FROM (SELECT *, {scen('l_partkey')} AS dataset FROM lines WHERE nth = 1))"""


@query(sql("SELECT * FROM adapted", "lines", adapted=_ADAPTED))
def adapter_coalesce(spark, d):
    a = _adapted(spark, d).drop("description")
    values = F.map_values("variable_contributions")
    a = a.withColumns({"severity": F.round("severity", 6), "confidence": F.round("confidence", 6), "contribution": F.when(F.size(values) > 0, values[0])})
    return a.withColumns({"variables": F.array_join("variables", "|"), "log_events": F.array_join("log_events", "|")}).drop("variable_contributions")


@query(
    sql(
        """SELECT case_id, ord::INT AS ord, facet, name, value, rank::INT AS rank, raw_ref, CASE WHEN n > 1 THEN base || '_' || lpad(n::VARCHAR, 2, '0') ELSE base END AS obs_id FROM (
          SELECT *, 'obs_' || case_id || '_' || facet || '_' || trim(regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', '_', 'g'), '_') AS base, row_number() OVER (PARTITION BY case_id, facet, name ORDER BY ord) AS n FROM (
            SELECT case_id, facet, name, value, rank, coalesce(raw_ref, facet) AS raw_ref, row_number() OVER (PARTITION BY case_id ORDER BY place, nth) - 1 AS ord FROM (
              SELECT case_id, 0 AS place, 0 AS nth, 'object' AS facet, object AS name, NULL::DOUBLE AS value, NULL AS rank, NULL AS raw_ref FROM cases UNION ALL SELECT case_id, 1, 0, 'anomaly_type', anomaly_name, NULL, NULL, NULL FROM cases
              UNION ALL SELECT case_id, 2, 0, 'location', location, NULL, NULL, NULL FROM cases UNION ALL SELECT case_id, 9, 0, 'confidence', 'adapter_confidence', confidence, NULL, NULL FROM cases
              UNION ALL SELECT c.case_id, 4, l.nth, 'variable', l.p_name, f.tax, l.nth - 1, 'raw_evidence.variables[' || (l.nth - 2) || ']' FROM lines l JOIN cases c USING (l_orderkey)
                JOIN (SELECT l_orderkey, p_name, arg_min(l_tax, nth) AS tax FROM lines WHERE nth > 1 GROUP BY ALL) f USING (l_orderkey, p_name) WHERE l.nth > 1)))""",
        "cases",
    )
)
def observation_ids(spark, d):
    """Orders' other lines as variables, the tax of the first line of a name its contribution."""
    one = F.struct("nth", "p_name", "l_tax", "s_name", "n_name", "l_discount")
    orders = domain.case_lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("l"))  # an order has a few lines, numbered from 1
    orders = orders.withColumns({"first": F.get("l", F.lit(0)), "rest": F.filter("l", lambda x: x["nth"] > 1)}).where("first.nth = 1")
    names = F.transform("rest", lambda x: x["p_name"])
    some = F.size("rest") > 0
    tax = lambda name: F.get(F.filter("rest", lambda x: x["p_name"] == name), F.lit(0))["l_tax"]
    shares = F.map_from_entries(F.transform(F.array_distinct(names), lambda n: F.struct(n.alias("p_name"), tax(n).alias("tax"))))
    e = orders.select(
        F.concat(F.lit("case_"), F.col("l_orderkey").cast("string")).alias("case_id"), F.col("first.s_name").alias("object"), F.col("first.p_name").alias("anomaly_type"), F.col("first.n_name").alias("location"),
        F.when(some, names).alias("variables"), F.when(some, shares).alias("variable_contributions"), F.round(F.col("first.l_discount") * 10, 4).alias("confidence"),
    )
    return evidence.observations(e).select("case_id", "ord", "facet", "name", "value", "rank", "raw_ref", "obs_id")


@query(sql("SELECT case_id, concat_ws('|', CASE WHEN anomaly_type LIKE 'P%7' THEN 'anomaly_type' END, CASE WHEN location IS NOT NULL THEN 'location' END, CASE WHEN quantity > 40 THEN 'morphology' END) AS missing FROM cases", "cases"))
def missing_facets(spark, d):
    """Observed are objects, and anomaly types but for those that end in 7."""
    e = domain.evidence_cases(spark, d).withColumn("morphology", F.when(F.col("quantity") > 40, F.lit("dense")))
    seen = e.select("case_id", F.lit("object").alias("facet")).union(e.where("anomaly_type not like 'P%7'").select("case_id", F.lit("anomaly_type")))
    return evidence.missing_facets(e.drop("confidence"), seen).select("case_id", F.array_join("missing", "|").alias("missing"))


@query(sql("SELECT o_orderkey, o_orderstatus, o_orderstatus = 'F' OR o_orderpriority = '4-NOT SPECIFIED' AS quiet FROM orders"))
def nonanomalous_filter(spark, d):
    """Orders as records: status F says `Good`, priority 4 says `No-Label`, the rest name their priority."""
    o = domain.table(spark, d, "orders")
    said = F.when(F.col("o_orderstatus") == "F", " Good ").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "No-Label").otherwise(F.col("o_orderpriority"))
    return o.select("o_orderkey", "o_orderstatus", text.is_not_anomalous(said).alias("quiet"))


@query(sql("SELECT case_id, CASE WHEN quantity > 30 THEN 'NATION_0' ELSE location END AS location, anomaly_type, CAST(NULL AS VARCHAR) AS analysis FROM cases", "cases"))
def whatif_patch(spark, d):
    e = domain.evidence_cases(spark, d).withColumn("analysis", F.lit("old"))
    changed = F.when(F.col("quantity") > 30, F.lit("NATION_0")).otherwise(F.col("location"))
    return evidence.what_if(e, {"location": changed}).select("case_id", "location", "anomaly_type", "analysis")


@query(sql("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'consistency_score|label|line|linked_entities' AS keys, l_linestatus AS line FROM lineitem"))
def label_scrub(spark, d):
    """Each line's properties without what only an analysis may set."""
    names = ("root_cause", "root_causes", "candidate_root_cause", "candidate_root_causes", "ranked_causes", "ranked_root_causes", "top_k_paths", "kg_analysis", "label", "linked_entities", "consistency_score")
    m = F.create_map(F.lit("line"), F.col("l_linestatus"), *[x for n in names for x in (F.lit(n), F.col("l_returnflag"))])
    out = domain.table(spark, d, "lineitem").withColumn("m", evidence.scrub(m))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(F.array_sort(F.map_keys("m")), "|").alias("keys"), F.col("m")["line"].alias("line"))


@query(sql("SELECT event_id, CASE WHEN event_type = 'error' THEN 3 ELSE nullif(regexp_extract('run fault_' || (event_id % 21), 'fault[_ -]?(\\d+)', 1), '')::INT END AS fault_number FROM events"))
def fault_numbers(spark, d):
    e = domain.table(spark, d, "events")
    return e.select("event_id", text.fault_number(F.when(F.col("event_type") == "error", 3), F.concat(F.lit("run Fault_"), F.col("event_id") % 21)).alias("fault_number"))


@query(sql("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'wm811k' WHEN o_orderkey % 5 = 0 THEN 'wm811k' ELSE 'wafer' END AS adapter FROM orders"))
def adapter_routing(spark, d):
    o = domain.table(spark, d, "orders")
    adapter = F.when(F.col("o_orderstatus") == "P", "wm811k").otherwise("wafer")
    source = F.when(F.col("o_orderkey") % 5 == 0, "WM-811K").otherwise("other")
    return o.select("o_orderkey", evidence.route(adapter, source, F.lit("wafer")).alias("adapter"))


@query(sql("SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN value >= 0.5 WHEN 3 THEN true WHEN 4 THEN false ELSE value / 100 >= 0.5 END AS anomalous FROM events"))
def anomalous_verdict(spark, d):
    """Verdicts in words, figures and not at all; a value in figures counts as a score."""
    n = F.col("event_id") % 6
    said = F.when(n == 0, "Abnormal").when(n == 1, " normal").when(n == 2, F.col("value").cast("string")).when(n == 3, "TRUE").when(n == 4, "good")
    return domain.table(spark, d, "events").select("event_id", evidence.anomalous(said, F.col("value") / 100).alias("anomalous"))


_ENDINGS = ("Object", "Defect", "Pattern", "Morphology", "Location", "Cause", "Mechanism", "Evidence", "Fault", "ProcessUnit", "Unit", "Variable", "Anomaly", "Thing")
_LABELS = ["Object", "Defect", "Pattern", "Morphology", "Location", "CandidateCause", "Mechanism", "EvidenceSource", "Fault", "ProcessUnit", "ProcessUnit", "Variable", "Anomaly", "Concept"]


@query(sql(f"SELECT p_partkey, string_agg(upper(w[1]) || w[2:], '' ORDER BY i) AS pascal, {_LABELS}[p_partkey % {len(_LABELS)} + 1] AS label FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part) GROUP BY p_partkey"))
def pascal_ids(spark, d):
    """Part names as ids, and the labels that they have with each ending in turn."""
    p = domain.table(spark, d, "part")
    ending = F.element_at(F.array(*[F.lit(e) for e in _ENDINGS]), (F.col("p_partkey") % len(_ENDINGS) + 1).cast("int"))
    return p.select("p_partkey", text.pascal(F.col("p_name")).alias("pascal"), text.label_of(F.concat(text.pascal(F.col("p_name")), ending)).alias("label"))


@query(
    sql(
        """SELECT p_partkey, CASE WHEN pat IN ('nearfull') THEN 'wafer_surface' WHEN pat = 'center' THEN 'center' WHEN pat IN ('edge_loc', 'edge_ring') THEN 'edge' WHEN pat = 'loc' THEN 'local' ELSE 'center' END AS location,
        CASE pat WHEN 'nearfull' THEN 'dense_particles' WHEN 'edge_ring' THEN 'ring' WHEN 'donut' THEN 'ring' WHEN 'scratch' THEN 'linear' WHEN 'random' THEN 'scattered' ELSE 'clustered' END AS morphology
        FROM (SELECT p_partkey, ['nearfull', 'center', 'edge_loc', 'edge_ring', 'loc', 'donut', 'scratch', 'random'][p_size % 8 + 1] AS pat FROM part)"""
    )
)
def wafer_patterns(spark, d):
    """Part sizes as patterns in their many spellings, in the middle of a thin map."""
    spelled = F.element_at(F.array(*[F.lit(x) for x in ("Near-full", "Centre", "EdgeLoc", "edge ring", "Local", "Donut", "Scratch", "Random")]), F.col("p_size") % 8 + 1)
    p = domain.table(spark, d, "part").withColumn("pattern", imaging.canonical_pattern(spelled))
    half = F.lit(0.5)
    return p.select("p_partkey", imaging.wafer_location(F.col("pattern"), F.lit(0.1), half, half).alias("location"), imaging.wafer_morphology(F.col("pattern"), F.lit(0.1), F.lit(1)).alias("morphology"))
