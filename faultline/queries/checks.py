"""Queries over reviews, detections, profiles and overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cases, compiler, evidence, imaging, kg, metrics, review, timeseries
from ..operators.lineage import cut
from ..plans import domain
from ..plans.overlay import OverlayValidation
from . import analysis
from .registry import registry
from .sql import sql

QUERIES, ORACLE_SQL, query = registry()


@query(sql("SELECT edge_id, round(CASE WHEN last IS NOT NULL THEN last ELSE confidence END, 6) AS confidence, round(1 - round(CASE WHEN last IS NOT NULL THEN last ELSE confidence END, 6), 6) AS weight FROM edges LEFT JOIN (SELECT 'S' || (user_id % (SELECT count(*) FROM supplier)) AS s, arg_max(round(value / 1000, 6), event_id) AS last FROM events GROUP BY ALL) ON s = head WHERE relation = 'BELONGS_TO_UNIT'", "edges"))
def confidence_edit(spark, d):
    """Events as edits of the confidence of suppliers' unit edges."""
    n = domain.table(spark, d, "supplier").count()
    e = domain.kg_edges(spark, d).where("relation = 'BELONGS_TO_UNIT'").select("edge_id", "head", "confidence")
    edits = domain.table(spark, d, "events").select(F.concat(F.lit("S"), (F.col("user_id") % n).cast("string")).alias("head"), F.round(F.col("value") / 1000, 6).alias("confidence"), F.col("event_id").alias("ord"))
    return review.edit_confidence(e, edits.join(e.select("head", "edge_id"), "head").drop("head")).drop("head")


@query(
    sql(
        """SELECT p_brand, count(*) AS records, count(*) FILTER (NOT g) AS defects, count(*) FILTER (g) AS good, count(*) FILTER (NOT g AND a) AS defects_anomalous, count(*) FILTER (NOT g AND NOT a) AS defects_normal, count(*) FILTER (g AND a) AS good_anomalous,
        count(*) FILTER (g AND NOT a) AS good_normal, min(score) AS score_min, max(score) AS score_max, min(l_tax) AS area_min, max(l_tax) AS area_max, round(avg(iou) + 1e-12, 6) AS mean_iou, count(iou) AS ious
        FROM (SELECT *, coalesce(l_returnflag = 'A', false) AS g, CASE WHEN l_linestatus = 'F' THEN l_discount >= 0.05 ELSE l_quantity >= 25 END AS a, l_discount AS score, CASE WHEN l_returnflag = 'R' THEN l_tax * 10 END AS iou FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY p_brand"""
    )
)
def detection_summary(spark, d):
    """Lines as records of a detector: flag A is sound, verdicts come in figures or from the score."""
    l = domain.table(spark, d, "lineitem").join(domain.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    said = F.when(F.col("l_linestatus") != "F", F.when(F.col("l_quantity") >= 25, "Abnormal").otherwise("normal"))
    anomalous = evidence.anomalous(said, F.when(F.col("l_discount") >= 0.05, 0.9).otherwise(0.1))
    label = F.when(F.col("l_returnflag") == "A", "Good").when(F.col("l_returnflag") == "R", "scratch")
    rows = l.select("p_brand", label.alias("label"), F.col("l_discount").alias("score"), anomalous.alias("anomalous"), F.col("l_tax").alias("area"), F.when(F.col("l_returnflag") == "R", F.col("l_tax") * 10).alias("iou"))
    return imaging.detection_summary(rows, ["p_brand"])


@query(sql("SELECT grid_id, sum(CASE WHEN share < 0.3 THEN 0 ELSE marked END)::BIGINT AS marked FROM (SELECT *, avg(marked) OVER (PARTITION BY grid_id) AS share FROM (SELECT *, (value >= 2)::INT AS marked FROM grid)) GROUP BY grid_id", grid=analysis._GRID))
def map_masks(spark, d):
    """Maps of suppliers cut at 2; those with less than three tenths marked are cleared."""
    return imaging.threshold_maps(domain.grid(spark, d), F.lit(2), 0.3).groupBy("grid_id").agg(F.sum("value").alias("marked"))


@query(sql(f"SELECT lang, (i - 1)::INT AS place, round(q[i], 4) AS value FROM (SELECT lang, quantile_cont(n_chars::DOUBLE, {[i / 511 for i in range(512)]}) AS q FROM documents GROUP BY lang), (SELECT unnest(range(1, 513)) AS i)"))
def map_quantiles(spark, d):
    """Quantiles of text lengths by language, as of pixels by object."""
    docs = domain.table(spark, d, "documents").select("lang", F.col("n_chars").alias("value"))
    return imaging.map_quantiles(docs, "lang").withColumn("value", F.round("value", 4))


@query(sql("SELECT round(avg((o_totalprice / 400000 BETWEEN 0 AND 1)::INT) + 1e-12, 6) AS validity_rate, count(*) AS rows FROM orders"))
def metric_validity(spark, d):
    """Orders as evidence whose confidence is their price in 400,000s."""
    o = domain.table(spark, d, "orders")
    return metrics.validity(o, (F.col("o_totalprice") / 400000).between(0, 1))


@query(sql("SELECT round(avg(list_contains(c[1:3], o_custkey % 20)::INT) + 1e-12, 6) AS accuracy_at_3, count(*) AS rows FROM orders JOIN (SELECT l_orderkey, list(l_partkey % 20 ORDER BY nth) AS c FROM lines GROUP BY l_orderkey) ON l_orderkey = o_orderkey", "lines"))
def metric_topk_pairs(spark, d):
    """Whether a customer's number is among those of the first three lines of an order."""
    listed = domain.case_lines(spark, d).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", (F.col("l_partkey") % 20).alias("v")))), lambda x: x["v"]).alias("c"))
    both = domain.table(spark, d, "orders").join(listed, F.col("l_orderkey") == F.col("o_orderkey"))
    return metrics.top_k_pairs(both, F.col("o_custkey") % 20, F.col("c"), 3)


@query(sql("SELECT l_orderkey, round(coalesce(avg(l_discount - 0.03) FILTER (l_discount > 0.03), 0.0) + 1e-12, 6) AS score FROM lineitem GROUP BY l_orderkey"))
def path_rca_scores(spark, d):
    """Orders as paths, discounts beyond three hundredths as the scores of their edges."""
    l = domain.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_discount") > 0.03, F.col("l_discount") - 0.03).otherwise(0.0)).alias("s"))
    return l.select("l_orderkey", F.round(kg.path_score(F.col("s")) + 1e-12, 6).alias("score"))


@query(sql("SELECT fault, run, channel, rank FROM (SELECT fault, run, channel, row_number() OVER (PARTITION BY fault, run ORDER BY round(share, 9) DESC, channel) AS rank FROM (SELECT fault, run, channel, sq / sum(sq) OVER (PARTITION BY fault, run) AS share FROM (SELECT fault, run, channel, avg(z * z) AS sq FROM z GROUP BY ALL))) WHERE rank <= 1", **analysis._TS))
def ts_top_variables(spark, d):
    return timeseries.top_variables(timeseries.contributions(analysis._z(spark, d), ["fault", "run"]), ["fault", "run"], 1).select("fault", "run", "channel", "rank")


@query(
    sql(
        """SELECT scenario, first_key, second_key, arg_min(note, (src, ord)) AS note FROM (SELECT p_type AS scenario, p_brand AS first_key, split_part(p_name, ' ', 1) AS second_key, 0 AS src, p_partkey AS ord, 'own ' || p_partkey AS note FROM part WHERE p_size % 2 = 0
        UNION ALL SELECT p_type, p_brand, split_part(p_name, ' ', 1), 1, p_partkey, 'found ' || p_partkey FROM part) GROUP BY ALL"""
    )
)
def profile_merge(spark, d):
    """Parts as rows of profiles: those of even size are known, all are found."""
    p = domain.table(spark, d, "part")
    rows = lambda df, word: df.select(F.col("p_type").alias("scenario"), F.lit("parts").alias("profile"), F.col("p_brand").alias("first_key"), F.split("p_name", " ")[0].alias("second_key"), F.col("p_partkey").alias("ord"), F.concat(F.lit(word), F.col("p_partkey").cast("string")).alias("note"))
    return compiler.merge_profiles(rows(p.where("p_size % 2 = 0"), "own "), rows(p, "found ")).select("scenario", "first_key", "second_key", "note")


@query(
    sql(
        """SELECT event_id, CASE event_type WHEN 'view' THEN 'e_view' WHEN 'error' THEN 'e_err' ELSE CASE WHEN event_id % 2 = 0 THEN 'variable:xmeas_' || (event_id % 41 + 1) END END AS entity FROM events"""
    )
)
def channel_mapping(spark, d):
    """Event types as channels and aliases, other names as channels spelled out or as nothing known."""
    mapping = spark.createDataFrame([("view", ["seen"], "e_view"), ("failure", ["ERROR", "View"], "e_err")], "channel string, aliases array<string>, entity string")
    other = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("XMEAS("), F.col("event_id") % 41 + 1, F.lit(")"))).otherwise(F.lit("level"))
    name = F.when(F.col("event_type") == "view", "V-iew").when(F.col("event_type") == "error", "error").otherwise(other)
    return evidence.mapped(domain.table(spark, d, "events").select("event_id", name.alias("name")), mapping).select("event_id", "entity")


@query(sql("SELECT s_suppkey, concat_ws('|', CASE WHEN s_acctbal < 0 THEN 'overdrawn' END, CASE WHEN s_acctbal > 5000 THEN 'rich' END, CASE WHEN s_nationkey < 5 THEN 'near' END) AS flags FROM supplier"))
def reasonableness_flags(spark, d):
    s = domain.table(spark, d, "supplier")
    named = {"a": (F.col("s_acctbal") < 0, "overdrawn"), "b": (F.col("s_acctbal") > 5000, "rich"), "c": (F.col("s_nationkey") < 5, "near")}
    return s.select("s_suppkey", F.array_join(cases.flags(named), "|").alias("flags"))


def _overlay(spark, d):
    """Even suppliers' unit edges as an overlay, over a graph without them."""
    nodes, edges = domain.kg_nodes(spark, d), domain.kg_edges(spark, d)
    mine = (F.col("relation") == "BELONGS_TO_UNIT") & (F.expr("try_cast(substring(head, 2) as bigint)") % 2 == 0)
    return OverlayValidation(cut(domain.mentions(spark, d)), nodes, edges.where(~mine), nodes.where("false"), edges.where(mine))


@query(
    sql(
        """SELECT (SELECT count(*) FROM edges WHERE relation = 'BELONGS_TO_UNIT' AND head[2:]::BIGINT % 2 = 0) AS overlay_edges, count(*) AS cases, count(*) FILTER (c) AS contributing_cases, true AS contract_validated, true AS runtime_validated, bool_or(c) AS overlay_contributed, bool_or(c) AS validated
        FROM (SELECT DISTINCT case_id FROM links) LEFT JOIN (SELECT case_id, bool_or(e LIKE 'S%|BELONGS_TO_UNIT|%' AND split_part(e, '|', 1)[2:]::BIGINT % 2 = 0) AS c FROM (SELECT case_id, unnest(edge_ids) AS e FROM top) WHERE e LIKE 'S%' GROUP BY case_id) USING (case_id)""",
        "links",
        "top",
        "edges",
    )
)
def overlay_validation(spark, d):
    return _overlay(spark, d).report().drop("errors")
