"""Consistency of linked fields with the relations of the graph, and corrections for what fails."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Source field, target field, relations that would support them, in order.
RULES = (
    ("anomaly_type", "morphology", ("HAS_MORPHOLOGY",)),
    ("anomaly_type", "location", ("OCCURS_ON", "HAS_LOCATION")),
    ("variable", "location", ("MEASURED_IN", "BELONGS_TO_UNIT")),
    ("anomaly_type", "log_event", ("ASSOCIATED_WITH_EVENT",)),
)
ENTITY_SHARE, RELATION_SHARE = 0.4, 0.6


def rules(spark) -> DataFrame:
    rows = [(s, t, r, i) for s, t, names in RULES for i, r in enumerate(names)]
    return spark.createDataFrame(rows, "source_field string, target_field string, relation string, relation_ord int")


def checks(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """As `case_checks`, of rows case_id, dataset, field, entity_id, one for each field of a case."""
    return case_checks(selected.groupBy("case_id", "dataset").agg(F.collect_list(F.struct("field", "entity_id")).alias("selected")), edges)


def case_checks(cases: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each rule of which a case has both fields: whether an edge supports it, and the first relation that does.

    cases: case_id, dataset, selected (field, entity_id), a row each. edges: head, relation, tail, dataset (visible ones). A rule meets the relations
    between its two entities in one row, so nothing is gathered by case again.
    """
    bits = {r: 1 << i for i, r in enumerate(dict.fromkeys(r for _, _, names in RULES for r in names))}
    own = {f: F.get(F.filter("selected", lambda x: x["field"] == f), F.lit(0))["entity_id"] for rule in RULES for f in rule[:2]}
    asked = [F.when(F.col(f"_{s}").isNotNull() & F.col(f"_{t}").isNotNull(), F.struct(F.lit(s).alias("source_field"), F.lit(t).alias("target_field"), F.col(f"_{s}").alias("source_id"), F.col(f"_{t}").alias("target_id"))) for s, t, _ in RULES]
    named = cases.select("case_id", "dataset", *[v.alias(f"_{f}") for f, v in own.items()])
    pairs = named.select("case_id", "dataset", F.inline(F.array_compact(F.array(*asked))))
    bit = F.lit(0)
    for r, b in bits.items():
        bit = F.when(F.col("relation") == r, b).otherwise(bit)
    between = edges.where(F.col("relation").isin(*bits)).groupBy("dataset", F.col("head").alias("source_id"), F.col("tail").alias("target_id")).agg(F.bit_or(bit).alias("bits"))
    found = pairs.join(between, ["dataset", "source_id", "target_id"], "left")
    matched = F.lit(None).cast("string")
    for s, t, names in RULES:
        first = F.coalesce(*[F.when(F.col("bits").bitwiseAND(F.lit(bits[r])) != 0, r) for r in names])
        matched = F.when((F.col("source_field") == s) & (F.col("target_field") == t), first).otherwise(matched)
    out = found.select("case_id", "dataset", "source_field", "target_field", "source_id", "target_id", matched.alias("matched_relation"))
    return out.withColumn("passed", F.col("matched_relation").isNotNull())


def scores(cases: DataFrame, checked: DataFrame) -> DataFrame:
    """consistency_score and the fields of failed checks, for every case with links (linked, found: how many, and how many with an entity)."""
    failed = F.when(~F.col("passed"), F.array("source_field", "target_field"))
    relation = checked.groupBy("case_id").agg(F.avg(F.col("passed").cast("double")).alias("relation"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(failed)))).alias("inconsistent_fields"))
    score = ENTITY_SHARE * (F.col("found").cast("double") / F.col("linked")) + RELATION_SHARE * F.coalesce("relation", F.lit(1.0))
    return cases.join(relation, "case_id", "left").select("case_id", "dataset", F.round(score + 1e-9, 4).alias("consistency_score"), F.coalesce("inconsistent_fields", F.array().cast("array<string>")).alias("inconsistent_fields"))


def _key(suggested):
    return F.regexp_replace(F.lower(suggested), r"[^\p{L}\p{N}]", "_")


def corrections(checked: DataFrame, edges: DataFrame, nodes: DataFrame, top_k: int = 5) -> DataFrame:
    """For each failed check, what the graph has instead of the target: best first, at most top_k for a case.

    What an entity offers under a rule is ranked once, whatever the number of cases: of a case's best none is beyond the top_k of its
    entity and rule.
    """
    table = F.broadcast(rules(checked.sparkSession)).drop("relation_ord")
    failed = checked.where("not passed").select("case_id", "dataset", "source_field", "target_field", "source_id")
    by, score = ["dataset", "source_id", "source_field", "target_field"], F.round("confidence", 4)
    offers = edges.select(F.col("head").alias("source_id"), "relation", F.col("tail").alias("suggested_id"), "dataset", "confidence", "edge_id").join(table, "relation").repartition("dataset", "source_id")
    once = Window.partitionBy(*by, "suggested_id").orderBy(F.desc("confidence"), "edge_id")
    first = Window.partitionBy(*by).orderBy(F.desc(score), _key("suggested_id"))
    offers = offers.withColumn("_n", F.row_number().over(once)).where("_n = 1").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= top_k).drop("_n", "relation")
    names = nodes.groupBy(F.col("id").alias("suggested_id")).agg(F.collect_list(F.struct("name")).alias("_names"))
    offers = offers.join(names, "suggested_id", "left")
    found = failed.join(offers, by).repartition("case_id")
    key = Window.partitionBy("case_id", "target_field", "suggested_id").orderBy(F.desc("confidence"), "edge_id")
    found = found.withColumn("_n", F.row_number().over(key)).where("_n = 1")
    candidate = F.concat_ws("_", F.lit("corr"), "case_id", "target_field", _key("suggested_id"))
    found = found.withColumn("candidate_id", candidate).withColumn("score", score)
    w = Window.partitionBy("case_id").orderBy(F.desc("score"), "candidate_id")
    ranked = found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top_k)
    return ranked.withColumn("suggested", F.explode("_names")).withColumn("suggested", F.col("suggested.name")).drop("_n", "_names")
