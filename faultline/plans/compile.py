"""From source texts to a checked graph: units, chunks, statements, cards, entities, edges, profiles, violations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_of, normalize
from ..operators import compiler, kg
from ..operators.lineage import cut


@dataclass
class Compiled:
    """units: unit_id, scenario, text. extractor: chunks to statements (unit_id, scenario, head, relation, tail, confidence).

    Without an extractor, lines of the form `Head RELATION Tail.` are the statements.
    """

    units: DataFrame
    extractor: Callable[[DataFrame], DataFrame] | None = None

    @cached_property
    def chunks(self) -> DataFrame:
        parts = compiler.chunk(self.units, "unit_id")
        return parts.join(self.units.select("unit_id", "scenario"), "unit_id")

    @cached_property
    def statements(self) -> DataFrame:
        if self.extractor:
            return cut(self.extractor(self.chunks))
        lines = self.chunks.select("unit_id", "scenario", F.explode(F.split("text", "\n")).alias("line"))
        found = compiler.relation_lines(lines).select("unit_id", "scenario", "head", "relation", "tail", F.lit(0.5).alias("confidence"))
        return cut(found.distinct())  # chunks overlap

    @cached_property
    def cards(self) -> DataFrame:
        return compiler.dedupe_cards(self.statements.select("scenario", F.concat_ws(" ", "head", "relation", "tail").alias("claim"), "unit_id"))

    @cached_property
    def entities(self) -> DataFrame:
        """id, name, label, scenario, aliases of everything that a statement is about."""
        none = F.array().cast("array<string>").alias("aliases")
        names = self.statements.select(F.col("head").alias("name"), "scenario", F.col("unit_id").alias("card_id"), none).union(self.statements.select("tail", "scenario", "unit_id", none))
        return cut(compiler.upsert_entities(names).withColumn("label", label_of(F.col("id"))))

    @cached_property
    def edges(self) -> DataFrame:
        ids = self.entities.select("scenario", F.col("name_key").alias("key"), "id")
        named = self.statements.withColumns({"hk": normalize(F.col("head")), "tk": normalize(F.col("tail"))}).drop("head", "tail")
        heads = named.join(ids.select("scenario", F.col("key").alias("hk"), F.col("id").alias("head")), ["scenario", "hk"])
        both = heads.join(ids.select("scenario", F.col("key").alias("tk"), F.col("id").alias("tail")), ["scenario", "tk"])
        rows = both.select("head", "relation", "tail", "scenario", "confidence", F.col("unit_id").cast("string").alias("source"), F.col("unit_id").cast("string").alias("evidence"), F.col("unit_id").alias("card_id"))
        return compiler.upsert_edges(rows).withColumn("edge_id", F.concat_ws("|", "head", "relation", "tail", "scenario"))

    @cached_property
    def profiles(self) -> DataFrame:
        return compiler.domain_profiles(self.edges)

    @cached_property
    def violations(self) -> DataFrame:
        return kg.violations(self.entities, self.edges)
