"""Root causes of many cases over one graph: candidates, propagation, anchors and rules composed, each over all cases at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_id
from ..operators import anchors, propagation, rules
from ..operators.lineage import cut

#: Affected variables that are reported, those among them that paths lead to, candidates with a subgraph.
AFFECTED, SUPPORTED, TOP_K = 5, 3, 3


@dataclass
class RootCauses:
    """nodes: id, name, type, role, candidate, variable_role, targets (of anchors), provenance. edges: edge_id, head, tail, family, weight, provenance.

    contributions: case_id, id, value, as observed. dynamics: case_id, feature, value. diagnostics: anchor, feature, the
    variables that tell an anchor. profiles: anchor, space, feature, value (`anchors.profiles_of`). cases: case_id; by
    default those with contributions.
    """

    nodes: DataFrame
    edges: DataFrame
    contributions: DataFrame
    dynamics: DataFrame
    diagnostics: DataFrame | None = None
    profiles: DataFrame | None = None
    cases: DataFrame | None = None

    @cached_property
    def every(self) -> DataFrame:
        return (self.contributions if self.cases is None else self.cases).select("case_id").distinct()

    @cached_property
    def weights(self) -> DataFrame:
        """id, weight of the variables."""
        return self.nodes.where("type = 'Variable'").select("id", anchors.contribution_weight(F.col("type"), F.col("variable_role")).alias("weight"))

    @cached_property
    def weighted(self) -> DataFrame:
        """Contributions by the role of what they are of."""
        return cut(self.contributions.join(self.weights, "id", "left").select("case_id", "id", F.round(F.col("value") * F.coalesce("weight", F.lit(1.0)), 8).alias("value")))

    @cached_property
    def candidates(self) -> DataFrame:
        found = propagation.candidates(self.every, self.weighted, self.nodes, self.edges)
        seed = anchors.seed_score(F.col("direct"), F.col("adjacent"), F.col("support"), F.col("role") == propagation.ANCHOR)
        return cut(found.withColumn("seed", F.round(seed, 6)))

    @cached_property
    def reached(self) -> DataFrame:
        return cut(propagation.spread(self.candidates.select("case_id", F.col("id").alias("source"), "seed"), self.edges))

    @cached_property
    def scores(self) -> DataFrame:
        """case_id, source, id, score, weighted: what propagation gives each variable."""
        on = self.reached.join(self.weights.withColumnRenamed("id", "node"), "node")
        return cut(on.select("case_id", "source", F.col("node").alias("id"), "score", (F.col("score") * F.col("weight")).alias("weighted")))

    @cached_property
    def _terms(self) -> DataFrame:
        """Root score, covered mass, entropy and active variables of each candidate."""
        by = Window.partitionBy("case_id", "source")
        own = self.weighted.join(self.weights.select("id"), "id", "left_semi")
        norm = own.groupBy("case_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
        rows = self.scores.join(own, ["case_id", "id"], "left").withColumns({"value": F.coalesce("value", F.lit(0.0)), "most": F.max("weighted").over(by), "total": F.sum(F.when(F.col("weighted") > 1e-9, F.col("weighted"))).over(by)})
        p = F.when(F.col("weighted") > 1e-9, F.col("weighted") / F.col("total"))
        out = rows.groupBy("case_id", "source").agg(
            F.sum(F.col("weighted") * F.col("value")).alias("dot"),
            F.sqrt(F.sum(F.col("weighted") * F.col("weighted"))).alias("size"),
            F.sum(F.when(F.col("weighted") >= F.greatest(F.lit(1e-6), 0.1 * F.col("most")), F.col("value")).otherwise(0.0)).alias("mass"),
            F.coalesce(-F.sum(p * F.log(p)), F.lit(0.0)).alias("entropy"),
            F.count(p).alias("active"),
        )
        both = out.join(norm, "case_id", "left")
        root = F.when((F.col("size") > 0) & (F.col("norm") > 0), F.col("dot") / (F.col("size") * F.col("norm"))).otherwise(0.0)
        return both.select("case_id", F.col("source").alias("id"), root.alias("root"), "mass", "entropy", "active")

    @cached_property
    def scored(self) -> DataFrame:
        """Candidates with every term of their score; base: structure and memory together."""
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        rows = self.candidates.join(self._terms, ["case_id", "id"], "left")
        features = self.weighted.select("case_id", F.col("id").alias("feature"), "value")
        anchor = F.col("role") == propagation.ANCHOR
        names = ("contribution_alignment", "dynamic_alignment", "unique_alignment", "memory_bonus")
        if self.diagnostics is not None:
            told = anchors.discriminator(features, self.diagnostics, "case_id").select("case_id", F.col("anchor").alias("id"), F.round("alignment", 8).alias("told"))
            rows = rows.join(told, ["case_id", "id"], "left")
        else:
            rows = rows.withColumn("told", F.lit(0.0))
        if self.profiles is not None:
            rows = rows.join(anchors.memory(features, self.dynamics, self.profiles).withColumnRenamed("anchor", "id"), ["case_id", "id"], "left")
        else:
            rows = rows.withColumns({n: F.lit(0.0) for n in names})
        rows = rows.withColumns({c: zero(c) for c in ("root", "mass", "entropy")} | {"active": F.coalesce("active", F.lit(0))})
        rows = rows.withColumns({n: F.when(anchor, zero(n)).otherwise(0.0) for n in names} | {"discriminator_alignment": F.when(anchor, zero("told")).otherwise(0.0)})
        structural = anchors.structural_score(F.col("root"), F.col("mass"), F.col("entropy"), F.col("type"), F.col("role"), F.col("discriminator_alignment"))
        rows = rows.withColumn("structural", structural).withColumn("base", F.round(F.col("structural") + F.col("memory_bonus"), 8))
        rounded = {"structural_score": F.round("structural", 8), "root_score": F.round("root", 8), "covered_mass": F.round("mass", 8), "pattern_entropy": F.round("entropy", 8)}
        targets = self.nodes.select("id", F.concat_ws("|", "targets").alias("direct_targets"))
        return cut(rows.withColumns(rounded).join(targets, "id").drop("structural", "root", "mass", "entropy", "told"))

    @cached_property
    def ranked(self) -> DataFrame:
        """The candidates of every case in their final order: rank, score, adjustment, the bonus of each rule, ranking_id, and their terms."""
        features = self.dynamics.select("case_id", F.lit("dynamic").alias("kind"), "feature", "value")
        features = features.unionByName(self.weighted.select("case_id", F.lit("contribution").alias("kind"), F.col("id").alias("feature"), "value"))
        family = {} if self.diagnostics is None else {r["anchor"]: r["f"] for r in self.diagnostics.where(F.col("anchor").isin(*rules.FAMILY)).groupBy("anchor").agg(F.sort_array(F.collect_set("feature")).alias("f")).collect()}
        gates = ("unique_alignment", "discriminator_alignment", "memory_bonus", "root_score", "covered_mass")
        out = rules.adjust(self.scored.select("case_id", "id", "base", "role", "type", "direct_targets", "priority", *gates), features, family)
        kept = self.scored.drop("base", "place", "direct_targets")
        return cut(out.join(kept, ["case_id", "id"]).withColumn("ranking_id", stable_id("root_kgd_rank", [F.col("case_id"), F.col("id"), F.col("rank")])))

    @cached_property
    def affected(self) -> DataFrame:
        """case_id, source, id, place, score, contribution: the variables that a candidate reaches most."""
        w = Window.partitionBy("case_id", "source").orderBy(F.desc("score"), "id")
        best = self.scores.where("score > 0").withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= AFFECTED)
        seen = self.contributions.select("case_id", "id", F.col("value").alias("contribution"))
        return best.join(seen, ["case_id", "id"], "left").select("case_id", "source", "id", "place", "score", F.round(F.coalesce("contribution", F.lit(0.0)), 8).alias("contribution"))

    @cached_property
    def support(self) -> DataFrame:
        """case_id, source, place, id, path (edges), nodes: how a candidate reaches the first of its variables."""
        wanted = self.affected.where(F.col("place") <= SUPPORTED).select("case_id", "source", F.col("id").alias("node"), "place")
        return cut(propagation.traced(self.reached, wanted).where("path is not null").withColumnRenamed("node", "id"))

    @cached_property
    def evidence(self) -> DataFrame:
        """case_id, source, evidence: what the edges of a candidate's paths were taken from."""
        used = self.support.select("case_id", "source", F.explode("path").alias("edge_id")).distinct().join(self.edges.select("edge_id", F.explode("provenance").alias("e")), "edge_id")
        return used.groupBy("case_id", "source").agg(F.array_sort(F.collect_set("e")).alias("evidence"))

    def _best(self, top_k: int) -> DataFrame:
        return self.ranked.where(F.col("rank") <= top_k).select("case_id", F.col("id").alias("source"), "rank", "root_score")

    def subgraph_edges(self, top_k: int = TOP_K) -> DataFrame:
        """The edges of the best candidates' paths, and how many of a candidate's paths use each."""
        used = self.support.join(self._best(top_k), ["case_id", "source"]).select("case_id", "source", "rank", F.explode("path").alias("edge_id"))
        counted = used.groupBy("case_id", "source", "rank", "edge_id").agg(F.count("*").alias("paths"))
        return counted.join(self.edges.select("edge_id", "head", "tail", "family", F.round("weight", 8).alias("weight")), "edge_id")

    def subgraph_nodes(self, top_k: int = TOP_K) -> DataFrame:
        """The best candidates, what their paths pass and the variables they reach most, with what each adds to the root score."""
        best = self._best(top_k)
        keys = ["case_id", "source"]
        ids = best.select(*keys, F.col("source").alias("id"))
        ids = ids.unionByName(self.support.join(best, keys, "left_semi").select(*keys, F.explode("nodes").alias("id"))).unionByName(self.affected.join(best, keys, "left_semi").select(*keys, "id")).distinct()
        rows = ids.join(best, keys).join(self.reached.select(*keys, F.col("node").alias("id"), "score"), [*keys, "id"], "left")
        rows = rows.join(self.contributions.select("case_id", "id", F.col("value").alias("contribution")), ["case_id", "id"], "left").join(self.nodes.select("id", "name", "type", F.size("provenance").alias("evidence_count")), "id")
        score, own = F.coalesce("score", F.lit(0.0)), F.coalesce("contribution", F.lit(0.0))
        share = F.when(F.col("type") == "Variable", F.least(own, score)).otherwise(score * F.col("root_score"))
        return rows.select(*keys, "rank", "id", "name", "type", F.round(share, 8).alias("root_share"), F.round(own, 8).alias("contribution"), F.round(score, 8).alias("score"), "evidence_count")

    def report(self) -> DataFrame:
        """One row: cases, rankings, candidates of a case and the mean scores of the first."""
        first = lambda c: F.avg(F.when(F.col("rank") == 1, F.col(c)))
        return self.ranked.agg(
            F.countDistinct("case_id").alias("cases"), F.count("*").alias("rankings"), F.round(F.count("*") / F.countDistinct("case_id"), 6).alias("mean_candidates"), F.round(first("score"), 8).alias("mean_top1_score"), F.round(first("root_score"), 8).alias("mean_top1_root_score")
        )
