"""The simple reasoner: causes by how directly the graph supports a case's variables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import artifacts, propagation
from ..operators.lineage import cut

#: Labels of causes, and how the id of one ends that has another label.
CAUSE_LABELS, CAUSE_ENDING = ("RootCause", "CauseCategory", "FaultType", "FaultAnchor"), "Cause"
#: Edges of a path, variables of a case and the least that one must contribute.
DEPTH, VARIABLES, LEAST = 4, 8, 0.0


@dataclass
class SimpleCauses:
    """Over all cases at once: paths are searched once from every cause to every variable that any case has, then met by the cases.

    contributions: case_id, id, value. nodes: id, label. edges: head, relation, tail, edge_id, confidence; both already of the scope.
    """

    contributions: DataFrame
    nodes: DataFrame
    edges: DataFrame
    top_k: int = 5

    @cached_property
    def variables(self) -> DataFrame:
        """The largest contributions of each case that are nodes, with what they add up to (total) and how many they are (n)."""
        nth = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("value"), "id"))
        best = self.contributions.where(F.col("value") >= LEAST).withColumn("_n", nth).where(F.col("_n") <= VARIABLES).drop("_n")
        whole = Window.partitionBy("case_id")
        known = best.join(self.nodes.select("id"), "id", "left_semi")
        return cut(known.select("case_id", "id", "value", F.sum("value").over(whole).alias("total"), F.count("*").over(whole).alias("n")))

    @cached_property
    def paths(self) -> DataFrame:
        """cause, variable, path, confidence: the shortest path of each pair, the first in the order of its edges' confidence and ids."""
        causes = self.nodes.where(F.col("label").isin(*CAUSE_LABELS) | F.endswith("id", F.lit(CAUSE_ENDING))).select("id")
        return cut(propagation.support_paths(causes, self.variables.select("id").distinct(), self.edges, DEPTH))

    @cached_property
    def support(self) -> DataFrame:
        """case_id, cause, variable, value, path, confidence: what speaks for a cause in a case."""
        return self.variables.withColumnRenamed("id", "variable").join(self.paths, "variable")

    @cached_property
    def ranked(self) -> DataFrame:
        """case_id, rank, cause, score, confidence, evidence_match, support, length, broad: the first top_k causes of each case."""
        v, weighed = F.col("value"), lambda c: F.coalesce(F.try_divide(F.sum(F.col("value") * c), F.sum("value")), F.lit(0.0))
        found = self.support.groupBy("case_id", "cause").agg(
            (F.sum(v) / F.greatest(F.max("total"), F.lit(1e-9))).alias("match"), weighed(F.col("confidence")).alias("graph"), (F.count("*") / F.max("n")).alias("support"),
            weighed(F.size("path")).alias("length"), F.avg((F.size("path") > 1).cast("double")).alias("broad"),
        )
        score = F.round(artifacts.simple_score(F.col("match"), F.col("graph"), F.col("support"), F.col("length"), F.col("broad")) + 1e-9, 4)
        unit = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) + 1e-9, 4)
        rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "cause"))
        out = found.withColumn("score", score).withColumn("rank", rank.cast("long")).where(F.col("rank") <= self.top_k)
        return out.select("case_id", "rank", "cause", "score", unit("graph").alias("confidence"), unit("match").alias("evidence_match"), "support", "length", "broad")

    def explained(self) -> DataFrame:
        """The paths of the ranked causes: case_id, rank, cause, variable, path (edges from the cause), relations (REVERSE_ where one is met against its direction)."""
        own = self.ranked.select("case_id", "rank", "cause").join(self.support.select("case_id", "cause", "variable", "path"), ["case_id", "cause"])
        steps = own.select("cause", "variable", "path").distinct().select("cause", "variable", F.posexplode("path").alias("_i", "edge_id")).join(self.edges.select("edge_id", "head", "relation", "tail").dropDuplicates(["edge_id"]), "edge_id")
        walked = steps.groupBy("cause", "variable").agg(F.array_sort(F.collect_list(F.struct("_i", "head", "relation", "tail"))).alias("_s"))
        # at: the node that a step starts from; the first starts from the cause
        start = F.struct(F.col("cause").alias("at"), F.array().cast("array<string>").alias("r"))
        follow = lambda a, x: F.struct(F.when(x["head"] == a["at"], x["tail"]).otherwise(x["head"]).alias("at"), F.concat(a["r"], F.array(F.when(x["head"] == a["at"], x["relation"]).otherwise(F.concat(F.lit("REVERSE_"), x["relation"])))).alias("r"))
        named = walked.select("cause", "variable", F.aggregate("_s", start, follow)["r"].alias("relations"))
        return own.join(named, ["cause", "variable"]).select("case_id", "rank", "cause", "variable", "path", "relations")
