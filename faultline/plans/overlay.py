"""Whether a candidate overlay of the graph holds up: its contract, a run with it, and what it adds to the answers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kg, review
from ..operators.lineage import cut
from .pipeline import Analysis


@dataclass
class OverlayValidation:
    """mentions: the cases that it is tried on. nodes, edges: the graph it is laid over; overlay_nodes, overlay_edges: the candidate."""

    mentions: DataFrame
    nodes: DataFrame
    edges: DataFrame
    overlay_nodes: DataFrame
    overlay_edges: DataFrame
    top_k: int = 5

    @cached_property
    def graph(self) -> tuple[DataFrame, DataFrame]:
        """The graph with the overlay; what both have is the overlay's."""
        nodes = self.nodes.join(self.overlay_nodes.select("id"), "id", "left_anti").unionByName(self.overlay_nodes)
        edges = self.edges.join(self.overlay_edges.select("edge_id"), "edge_id", "left_anti").unionByName(self.overlay_edges)
        return cut(nodes), cut(edges)

    @cached_property
    def analysis(self) -> Analysis:
        return Analysis(self.mentions, *self.graph, self.top_k)

    @cached_property
    def cases(self) -> DataFrame:
        """case_id, dataset, linked, consistency_score, paths, causes, overlay_edges, contributes of every case."""
        a = self.analysis
        # a cause of the paths is a target of one of a case's best; these stay dealt by case
        best = a.best_paths.groupBy("case_id").agg(F.count("*").alias("paths"), F.size(F.collect_set("target_id")).cast("long").alias("causes"), F.collect_list("edge_ids").alias("_edges"))
        used = review.overlay_use(best.withColumn("edge_ids", F.flatten("_edges")), self.overlay_edges, "paths", "causes")
        rows = a.cases.select("case_id", "dataset", "linked").join(a.scores.select("case_id", "consistency_score"), "case_id")
        rows = rows.join(used.drop("path_edges"), "case_id", "left")
        zero = {c: F.coalesce(c, F.lit(0)) for c in ("paths", "causes", "overlay_edges")}
        return cut(rows.withColumns(zero | {"contributes": F.coalesce("contributes", F.lit(False))}))

    def report(self) -> DataFrame:
        """One row: sizes, whether the contract holds, whether cases ran, whether the overlay contributed, and whether all three."""
        errors = kg.violations(*self.graph).where("severity = 'error'").agg(F.count("*").alias("errors"))
        sizes = self.overlay_edges.agg(F.count("*").alias("overlay_edges"))
        ran = self.cases.agg(F.count("*").alias("cases"), F.count(F.when(F.col("contributes"), 1)).alias("contributing_cases"))
        one = errors.crossJoin(sizes).crossJoin(ran)  # a row each
        held, runs, gave = F.col("errors") == 0, F.col("cases") > 0, F.col("contributing_cases") > 0
        return one.withColumns({"contract_validated": held, "runtime_validated": runs, "overlay_contributed": gave, "validated": held & runs & gave})
