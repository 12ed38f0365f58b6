"""Ranked artifacts of other runs: matching them to cases, merging their evidence, choosing paths; overlays; drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the simple score.
MATCH, GRAPH, SUPPORT, LENGTH, BROAD = 0.5, 0.3, 0.25, 0.1, 0.12


def match_scenarios(cases: DataFrame, rows: DataFrame, allow_global: bool = False, order: list[Column] | None = None, k: int | None = None) -> DataFrame:
    """Rows of each case: those with its scenario id; if it has none, those with its fault and run; never by run alone.

    cases: case_id, scenario_id, fault, run. Rows without scenario, fault and run belong to all cases if allowed.
    order, k: only rows that can be among a case's first k are needed; others are left out before cases meet them, as
    all cases of a fault and run would else be met by all its rows.
    """

    def few(some: DataFrame, by: list[str]) -> DataFrame:
        return some if k is None else some.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= k).drop("_k")

    by_id = cases.select("case_id", "scenario_id").join(few(rows.where("scenario_id is not null"), ["scenario_id"]), "scenario_id").withColumn("how", F.lit("scenario"))
    unmatched = cases.join(by_id.select("case_id").distinct(), "case_id", "left_anti")
    by_run = unmatched.select("case_id", F.col("fault").alias("_f"), F.col("run").alias("_r")).join(few(rows.where("fault is not null and run is not null"), ["fault", "run"]), (F.col("_f") == F.col("fault")) & (F.col("_r") == F.col("run"))).drop("_f", "_r").withColumn("how", F.lit("fault_run"))
    out = by_id.unionByName(by_run)
    if allow_global:
        free = rows.where("scenario_id is null and fault is null and run is null")
        free = free if k is None else free.orderBy(*order).limit(k)
        out = out.unionByName(cases.select("case_id").join(F.broadcast(free)).withColumn("how", F.lit("global")))  # a few rows for all cases
    return out


def best_match(pairs: DataFrame, by: str, priorities: list[tuple[str, Column]]) -> DataFrame:
    """Of each group's rows those that fulfil the first condition that any of them fulfils, with its name."""
    place = F.coalesce(*[F.when(c, F.lit(i)) for i, (_, c) in enumerate(priorities)])
    least = F.min("_p").over(Window.partitionBy(by))
    names = F.array(*[F.lit(n) for n, _ in priorities])
    return pairs.withColumn("_p", place).where("_p is not null").withColumn("_l", least).where("_p = _l").withColumn("rule", F.element_at(names, F.col("_p") + 1)).drop("_p", "_l")


def bridge(cases: DataFrame, rankings: DataFrame, contributions: DataFrame, top_k: int = 5, allow_global: bool = False) -> DataFrame:
    """case_id, rank, cause, score, confidence, how, contribution, via of stored rankings brought to the cases that they belong to.

    cases: case_id, scenario_id, fault, run. rankings: scenario_id, fault, run, rank, candidate_id, and the scores ranking_score, score, root_score,
    structural_ranking_score, and confidence, of which any may be null. contributions: ord, scenario_id, fault, run; of several with
    a scenario id the last counts, of those with a fault and run the first. A row's contribution is that of its own scenario id, else
    of its case's, else of the case's fault and run (via says which): three equi-joins, each for what the ones before left open.
    """
    how_good = F.coalesce("ranking_score", "score", "root_score", "structural_ranking_score", F.lit(0.0))
    unit = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    sure = F.coalesce(unit(F.col("confidence")), unit(F.col("root_score")), F.when(F.col("_score").between(0.0, 1.0), F.col("_score")))
    given = rankings.withColumn("_score", how_good).withColumn("_sure", sure)
    by = Window.partitionBy("case_id")
    order = [F.coalesce(F.nullif(F.col("rank"), F.lit(0)), F.lit(1_000_000)), F.desc("_score"), F.col("candidate_id")]
    place = F.row_number().over(by.orderBy(*order))
    rows = match_scenarios(cases, given, allow_global, order, top_k).withColumn("_n", place).where(F.col("_n") <= top_k)
    again = F.row_number().over(by.orderBy(F.coalesce(F.nullif(F.col("rank"), F.lit(0)), F.col("_n")), F.desc("_score"), "candidate_id")).cast("long")
    rows = rows.select("case_id", again.alias("rank"), F.col("candidate_id").alias("cause"), F.round("_score", 4).alias("score"), F.col("_sure").alias("confidence"), "how", F.col("scenario_id").alias("_own"))
    named = contributions.where("scenario_id is not null").groupBy("scenario_id").agg(F.max("ord").alias("c"))
    timed = contributions.where("fault is not null and run is not null").groupBy("fault", "run").agg(F.min("ord").alias("_c3"))
    known = cases.join(named.select("scenario_id", F.col("c").alias("_c2")), "scenario_id", "left").join(timed, ["fault", "run"], "left").select("case_id", "_c2", "_c3")
    out = rows.join(named.select(F.col("scenario_id").alias("_own"), F.col("c").alias("_c1")), "_own", "left").join(known, "case_id", "left")
    via = F.when(F.col("_c1").isNotNull(), "row").when(F.col("_c2").isNotNull(), "case").when(F.col("_c3").isNotNull(), "fault_run")
    return out.select("case_id", "rank", "cause", "score", "confidence", "how", F.coalesce("_c1", "_c2", "_c3").alias("contribution"), via.alias("via"))


def merge_payloads(rows: DataFrame) -> DataFrame:
    """case_id, variable, weight: of each variable's values the last source's that is a number, 1 if none is; shares of the largest.

    rows: case_id, variable, source_ord, value (text). The largest counts as 1 at least.
    """
    v = F.col("value").try_cast("double")
    out = rows.groupBy("case_id", "variable").agg(F.coalesce(F.max_by(v, F.when(v.isNotNull(), F.col("source_ord"))), F.lit(1.0)).alias("v"))
    top = F.max("v").over(Window.partitionBy("case_id"))
    return out.withColumn("_t", top).select("case_id", "variable", F.round(F.col("v") / F.greatest(F.col("_t"), F.lit(1.0)) + 1e-12, 8).alias("weight"))


def entity_maxima(rows: DataFrame) -> DataFrame:
    """case_id, entity, value: the largest positive value over all payloads."""
    return rows.where("value > 0").groupBy("case_id", "entity").agg(F.max("value").alias("value"))


def simple_score(match: Column, graph: Column, support: Column, length: Column, broad: Column) -> Column:
    """Match, graph confidence and support less length (of 4) and breadth (a share, or yes or no); not below 0."""
    return F.greatest(F.lit(0.0), MATCH * match + GRAPH * graph + SUPPORT * support - LENGTH * length / 4 - BROAD * broad.cast("double"))


def causes_of(matched: DataFrame) -> DataFrame:
    """case_id, rank, cause, score of ranked rows (candidate, score): the best row of each candidate, ranked anew."""
    best = matched.groupBy("case_id", "candidate").agg(F.max("score").alias("score"))
    w = Window.partitionBy("case_id").orderBy(F.desc("score"), "candidate")
    return best.select("case_id", F.row_number().over(w).cast("long").alias("rank"), F.col("candidate").alias("cause"), "score")


def choose_paths(paths: DataFrame, k: int) -> DataFrame:
    """k paths of each case: first the best path of every candidate in their order, then the rest in theirs.

    paths: case_id, candidate_rank, path_rank.
    """
    first = F.row_number().over(Window.partitionBy("case_id", "candidate_rank").orderBy("path_rank")) == 1
    w = Window.partitionBy("case_id").orderBy(F.desc("_first"), "candidate_rank", "path_rank")
    return paths.withColumn("_first", first).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k).drop("_first")


def overlay(static: DataFrame, extra: DataFrame, columns: list[str]) -> DataFrame:
    """Edges with what an overlay says of them instead of their own; several overlay rows make several edges."""
    new = extra.select(F.col("external_edge_id").alias("edge_id"), *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("overlaid"))
    out = static.join(new, "edge_id", "left")
    return out.select(*[c for c in static.columns if c not in columns], *[F.coalesce(f"_{c}", c).alias(c) for c in columns], F.coalesce("overlaid", F.lit(False)).alias("overlaid"))


def parse_draft(lines: DataFrame, default_scenario: str = "shared") -> DataFrame:
    """head, relation, tail, scenario, evidence of lines `head,relation,tail[,scenario[,evidence]]`; the evidence may hold commas."""
    part = F.split("line", ",", 5)
    cell = lambda i: F.nullif(F.trim(F.get(part, F.lit(i))), F.lit(""))
    out = lines.select("*", cell(0).alias("head"), cell(1).alias("relation"), cell(2).alias("tail"), F.coalesce(cell(3), F.lit(default_scenario)).alias("scenario"), cell(4).alias("evidence"))
    return out.withColumn("valid", F.col("head").isNotNull() & F.col("relation").isNotNull() & F.col("tail").isNotNull())


def repaired_json(c: Column) -> Column:
    """The JSON in an answer: fences taken off, what stands before the first and after the last brace or bracket too; null if it is none."""
    bare = F.regexp_replace(F.trim(c), r"^```[a-zA-Z]*\s*|\s*```$", "")
    core = F.nullif(F.regexp_extract(bare, r"(?s)([\[{].*[\]}])", 1), F.lit(""))
    return F.when(F.try_parse_json(core).isNotNull(), core)
