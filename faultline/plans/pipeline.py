"""The analysis from cases to ranked causes, each stage over all cases at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_not_anomalous, normalize
from ..operators import consistency, kg, linking, paths
from ..operators.lineage import cut
from . import domain

DATASETS = ["mvtec", "tep", "wafer"]
#: The method of causes that come from paths.
GENERIC = "path_ranker"


@dataclass
class Analysis:
    """The stages of one batch; only those that are asked for run, and what several of them read is written out once.

    mentions: case_id, dataset, field, ord, mention, mention_key. nodes, edges: the knowledge graph. measure: how near
    strings are that are not equal. reasoners: for a dataset, what gives the causes (case_id, rank, cause, score) of
    its cases; cases for which it gives none have those of their paths.
    """

    mentions: DataFrame
    nodes: DataFrame
    edges: DataFrame
    top_k: int = 5
    max_depth: int = paths.MAX_DEPTH
    measure: linking.Measure = linking.WEIGHTED
    parallel: bool = True
    reasoners: dict[str, Callable[[Analysis], DataFrame]] = field(default_factory=dict)
    link_top_k: int = 3

    @cached_property
    def visible(self) -> DataFrame:
        return cut(kg.edge_strength(kg.visible_edges(self.nodes, self.edges, DATASETS)))

    @cached_property
    def candidates(self) -> DataFrame:
        """The ranked candidates of each distinct mention of a field."""
        return cut(linking.field_candidates(self.mentions, kg.terms(self.nodes), self.measure, self.link_top_k))

    @cached_property
    def links(self) -> DataFrame:
        """Every mention with its id and the best of its candidates, exact, partial or fuzzy."""
        return linking.link(self.mentions, linking.with_ambiguity(self.candidates, ["field", "mention_key", "dataset"]))

    @cached_property
    def cases(self) -> DataFrame:
        """A row for each case, with what it has selected: see `linking.by_case`."""
        return cut(linking.by_case(self.links))

    @cached_property
    def selected(self) -> DataFrame:
        return linking.selected(self.cases)

    @cached_property
    def checks(self) -> DataFrame:
        return consistency.case_checks(self.cases, self.visible)

    @cached_property
    def _checked(self) -> DataFrame:
        return cut(self.checks)

    @cached_property
    def scores(self) -> DataFrame:
        return consistency.scores(self.cases, self._checked)

    @cached_property
    def corrections(self) -> DataFrame:
        return consistency.corrections(self._checked, self.visible, self.nodes)

    @cached_property
    def _starts(self) -> DataFrame:
        return self.selected.where(F.col("field").isin(*paths.SOURCE_FIELDS)).select("dataset", F.col("entity_id").alias("id")).distinct()

    @cached_property
    def _best(self) -> DataFrame:
        return cut(kg.best_between(self.visible))

    @cached_property
    def _endings(self) -> DataFrame:
        goals = kg.visible_nodes(paths.causes(self.nodes), DATASETS).select("dataset", "id")
        return paths.endings(self._starts, self._best, goals, self.max_depth)

    @cached_property
    def paths(self) -> DataFrame:
        """Paths of every entity that a case starts from; searched once for an entity, not once for a case."""
        return paths.all_paths(self._starts, self._best, self._endings)

    @cached_property
    def _anomalous(self) -> DataFrame:
        """The cases whose type says that there is an anomaly, once for each entity that their paths start from."""
        quiet = F.col("typed") & is_not_anomalous(F.col("type"))
        return paths.case_starts(self.cases.where(~quiet))

    @cached_property
    def scored(self) -> DataFrame:
        return paths.score_starts(self._anomalous, self._best, self._endings, self.max_depth, parallel=self.parallel)

    @cached_property
    def score_totals(self) -> DataFrame:
        """What the scored paths to each cause add up to, without a row for each case and path."""
        return paths.total_starts(self._anomalous, self._best, self._endings, self.max_depth, self.parallel)

    @cached_property
    def best_paths(self) -> DataFrame:
        """The best paths of every case; `top` is the same, written out for those who read it more than once."""
        return paths.best_of(self._anomalous, self._best, self._endings, self.max_depth, self.top_k, self.parallel)

    @cached_property
    def top(self) -> DataFrame:
        return cut(self.best_paths)

    @cached_property
    def path_causes(self) -> DataFrame:
        return paths.rank_causes(self.top if "top" in self.__dict__ else self.best_paths)

    @cached_property
    def causes(self) -> DataFrame:
        """The causes of every case, with the method that found them, and whether another one had been asked for (fallback)."""
        generic = self.path_causes.withColumns({"method": F.lit(GENERIC), "fallback": F.col("dataset").isin(*self.reasoners)})
        if not self.reasoners:
            return generic
        own = None
        for dataset, reason in self.reasoners.items():
            found = reason(self).select("case_id", F.lit(dataset).alias("dataset"), F.col("cause"), "score", F.col("rank").cast("long").alias("rank"), F.lit(dataset).alias("method"), F.lit(False).alias("fallback"))
            found = found.where(F.col("rank") <= self.top_k)
            own = found if own is None else own.unionByName(found)
        own = cut(own)
        return own.unionByName(generic.join(own.select("case_id").distinct(), "case_id", "left_anti"), allowMissingColumns=True)

    def what_if(self, changes: dict[str, Column]) -> Analysis:
        """The analysis of the same cases with what they say in some fields replaced: field to its new mention (null: as it was).

        Everything that follows from the mentions is worked out anew; the graph is the same, and what has been derived from it stays.
        """
        said = F.col("mention")
        for name, new in changes.items():
            said = F.when(F.col("field") == name, F.coalesce(new, F.col("mention"))).otherwise(said)
        mentions = cut(self.mentions.withColumn("mention", said).withColumn("mention_key", normalize(F.col("mention"))))
        again = replace(self, mentions=mentions)
        for name in ("visible", "_best"):
            if name in self.__dict__:
                again.__dict__[name] = self.__dict__[name]
        return again


def analyse(spark: SparkSession, sf_dir: str, **options) -> Analysis:
    return Analysis(cut(domain.mentions(spark, sf_dir)), domain.kg_nodes(spark, sf_dir), domain.kg_edges(spark, sf_dir), **options)
