"""Metrics over ranked lists, links, corrections, flagged fields and noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The prefix that names of raw fields lose, and names under which fields are flagged that mean another field.
RAW_PREFIX = "raw_evidence."
FIELD_SYNONYMS = {"variables": "variable", "log_events": "log_event", "variable_contributions": "variable"}


def value_key(c: Column) -> Column:
    """Values are equal whatever their case, with underscores as spaces and runs of spaces as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "_", " "), r"\s+", " "))


def field_key(c: Column) -> Column:
    bare = F.when(F.startswith(c, F.lit(RAW_PREFIX)), F.substring(c, len(RAW_PREFIX) + 1, 1 << 20)).otherwise(c)
    out = bare
    for k, v in FIELD_SYNONYMS.items():
        out = F.when(bare == k, F.lit(v)).otherwise(out)
    return out


def _first_hits(cases: DataFrame, ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """case_id, first: the best rank at which a gold item of the case stands; null if none does."""
    hit = ranked.join(gold.select("case_id", "item").distinct(), ["case_id", "item"], "left_semi").groupBy("case_id").agg(F.min("rank").alias("first"))
    return cases.select("case_id").distinct().join(hit, "case_id", "left")


def top_k(cases: DataFrame, ranked: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """accuracy_at_k of all cases for each k; a case without gold counts as a miss. ranked: case_id, item, rank."""
    if min(ks) < 1:
        raise ValueError("k must be at least 1")
    first = _first_hits(cases, ranked, gold)
    return first.agg(*[F.round(F.coalesce(F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))), F.lit(0.0)), 6).alias(f"accuracy_at_{k}") for k in ks])


def mean_reciprocal_rank(cases: DataFrame, ranked: DataFrame, gold: DataFrame) -> DataFrame:
    first = _first_hits(cases, ranked, gold)
    return first.agg(F.round(F.coalesce(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), F.lit(0.0)) + 1e-12, 6).alias("mrr"), F.count("*").alias("cases"))


def case_metrics(cases: DataFrame, ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Rank, hits at 1, 3 and k and reciprocal rank of every case."""
    first = _first_hits(cases, ranked, gold)
    hit = lambda n: F.coalesce(F.col("first") <= n, F.lit(False))
    return first.select("case_id", F.col("first").alias("rank"), hit(1).alias("hit_1"), hit(3).alias("hit_3"), hit(k).alias("hit_k"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"))


def pair_accuracy(pairs: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    """The share of rows whose prediction is the gold value; a null gold never is, but counts."""
    return pairs.agg(F.round(F.coalesce(F.avg(F.coalesce(gold == predicted, F.lit(False)).cast("double")), F.lit(0.0)) + 1e-12, 6).alias("accuracy"), F.count("*").alias("rows"))


def precision_recall(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """Counts and P, R, F1 over all (case_id, field), fields under one name."""
    e = expected.select("case_id", field_key(F.col("field")).alias("field")).distinct().withColumn("e", F.lit(1))
    p = predicted.select("case_id", field_key(F.col("field")).alias("field")).distinct().withColumn("p", F.lit(1))
    n = e.join(p, ["case_id", "field"], "full").agg(F.count(F.when(F.col("e").isNotNull() & F.col("p").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("e").isNull(), 1)).alias("fp"), F.count(F.when(F.col("p").isNull(), 1)).alias("fn"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select("tp", "fp", "fn", F.round(over(tp, tp + fp), 6).alias("precision"), F.round(over(tp, tp + fn), 6).alias("recall"), F.round(over(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


def validity(rows: DataFrame, valid: Column) -> DataFrame:
    """The share of rows that are valid evidence; 0 without rows."""
    return rows.agg(F.round(F.coalesce(F.avg(F.coalesce(valid, F.lit(False)).cast("double")), F.lit(0.0)) + 1e-12, 6).alias("validity_rate"), F.count("*").alias("rows"))


def top_k_pairs(pairs: DataFrame, gold: Column, candidates: Column, k: int) -> DataFrame:
    """The share of rows whose gold value is among the first k of the row's candidates; a null gold never is, but counts."""
    if k < 1:
        raise ValueError("k must be at least 1")
    hit = F.array_contains(F.slice(candidates, 1, k), gold)
    return pairs.agg(F.round(F.coalesce(F.avg(F.coalesce(hit, F.lit(False)).cast("double")), F.lit(0.0)) + 1e-12, 6).alias(f"accuracy_at_{k}"), F.count("*").alias("rows"))


def path_signature(path_id: Column | None, nodes: Column, relations: Column) -> Column:
    """What tells a path: its id, else its nodes and relations."""
    drawn = F.concat_ws("|", F.concat(nodes, relations))
    return drawn if path_id is None else F.coalesce(F.nullif(path_id, F.lit("")), drawn)


def rollup(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Means of the metrics by (level, kind) and over all, which has null keys."""
    return rows.rollup("level", "kind").agg(F.count("*").alias("n"), F.grouping_id().alias("g"), *[F.round(F.avg(m) + 1e-12, 4).alias(m) for m in metrics]).where("g in (0, 3)").drop("g")
