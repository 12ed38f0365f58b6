"""Sinks: one folder for each case, JSON lines, tables, graph CSV, keyed merges of run tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .readers import EDGE_COLUMNS, NODE_COLUMNS


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_cases(evidence: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON partitioned by case; two rows for one case are an error before anything is written."""
    if not evidence.groupBy("case_id").count().where("count > 1").isEmpty():
        raise ValueError("several rows for one case")
    evidence.write.mode(_mode(overwrite)).partitionBy("case_id").json(path)


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode(_mode(overwrite)).json(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that a table can hold them."""
    return df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in df.schema.fields])


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    flat(df).write.mode(_mode(overwrite)).option("header", True).csv(path)


#: Columns of the table of a run, what its explanations are, and what it claims.
SUMMARY_COLUMNS = (
    "case_id", "dataset", "adapter_name", "anomaly_type", "location", "morphology", "consistency_score", "linked_entity_count", "correction_candidate_count", "path_count",
    "top_target_entity_id", "top_target_name", "top_target_label", "best_score", "explanation_scope", "claim_boundary",
)
EXPLANATION_SCOPE = "candidate_plausible_explanation_not_verified_rca"


def run_summary(evidence: DataFrame, links: DataFrame, scores: DataFrame, corrections: DataFrame, top: DataFrame, nodes: DataFrame, claim: str = "") -> DataFrame:
    """The table of a run, a row for each case of the evidence: what was linked, corrected and found, and the best target."""
    count = lambda df, name: df.groupBy("case_id").agg(F.count("*").alias(name))
    best = top.where("rank = 1").select("case_id", F.col("target_id").alias("top_target_entity_id"), F.col("score").alias("best_score"))
    named = best.join(nodes.select(F.col("id").alias("top_target_entity_id"), F.col("name").alias("top_target_name"), F.col("label").alias("top_target_label")), "top_target_entity_id", "left")
    rows = evidence.withColumn("adapter_name", F.col("adapter_name") if "adapter_name" in evidence.columns else F.col("dataset"))
    for part in (scores.select("case_id", "consistency_score"), count(links.where("entity_id is not null"), "linked_entity_count"), count(corrections, "correction_candidate_count"), count(top, "path_count"), named):
        rows = rows.join(part, "case_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("linked_entity_count", "correction_candidate_count", "path_count")}
    return rows.withColumns(zero | {"explanation_scope": F.lit(EXPLANATION_SCOPE), "claim_boundary": F.lit(claim)}).select(*SUMMARY_COLUMNS)


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Graph CSV with the columns that the readers ask for."""
    text = lambda df, columns: df.select(*[(F.col(c) if c in df.columns else F.lit("")).cast("string").alias(c) for c in columns])
    joined = nodes.withColumn("aliases", F.array_join("aliases", "|"))
    for name, df in (("nodes", text(joined, NODE_COLUMNS)), ("edges", text(edges, EDGE_COLUMNS))):
        df.write.mode(_mode(overwrite)).option("header", True).option("quoteAll", True).csv(f"{folder.rstrip('/')}/{name}")


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows whose keys are not among the new, and the new; of several new rows with a key the last by `ord`."""
    if "ord" in new.columns:
        w = Window.partitionBy(*keys).orderBy(F.desc("ord"))
        new = new.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n", "ord")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def merge_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What a merge would do, without doing it: rows to insert and to update."""
    known = old.select(*keys).distinct().withColumn("_k", F.lit(1))
    hit = new.select(*keys).distinct().join(known, keys, "left")
    return hit.agg(F.count(F.when(F.col("_k").isNull(), 1)).alias("inserts"), F.count("_k").alias("updates"))


def delete_node(nodes: DataFrame, edges: DataFrame, node_id: str) -> tuple[DataFrame, DataFrame, int]:
    """Nodes and edges without the node and what touches it, and how many edges that were."""
    touching = (F.col("head") == node_id) | (F.col("tail") == node_id)
    return nodes.where(F.col("id") != node_id), edges.where(~touching), edges.where(touching).count()


def replace_run(old: DataFrame, new: DataFrame, run_id: str) -> DataFrame:
    """A run table after one run has been written again: its old rows go."""
    return old.where(F.col("run_id") != run_id).unionByName(new.where(F.col("run_id") == run_id))


def min_max(value: Column, by: list[str]) -> Column:
    """Values of a group from 0 to 1; of a constant group 0."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))
