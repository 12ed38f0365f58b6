"""The noise experiment: every case clean and under every kind and level of noise, analysed in one batch and compared."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators import metrics, noise
from ..operators.lineage import cut
from .pipeline import Analysis

#: What is measured of every case, in the order of a summary.
METRICS = (
    "schema_validity_rate", "entity_linking_accuracy", "top_k_linking_accuracy", "inconsistency_precision", "inconsistency_recall", "correction_accuracy",
    "top_k_correction_accuracy", "noise_recovery_rate", "top_k_root_cause_accuracy", "mrr", "path_hit_rate",
)


def mentions_of(cases: DataFrame) -> DataFrame:
    """case_id, dataset, field, ord, mention, mention_key of cases: object, anomaly_type, location, morphology, variables, log events."""
    one = lambda f, v: F.struct(F.lit(f).alias("field"), v.alias("mention"))
    none = F.array().cast("array<struct<field:string,mention:string>>")
    parts = [F.when(F.col(f).isNotNull() & (F.col(f) != ""), F.array(one(f, F.col(f)))).otherwise(none) for f in ("object", "anomaly_type", "location", "morphology")]
    each = lambda column, f: F.coalesce(F.transform(column, lambda v: one(f, v)), none)
    parts += [each("variables", "variable"), each("log_events", "log_event")]
    rows = cases.select("case_id", "dataset", F.posexplode(F.concat(*parts)).alias("ord", "m")).select("case_id", "dataset", "m.field", "ord", "m.mention")
    return rows.withColumn("mention_key", normalize(F.col("mention")))


@dataclass
class NoiseExperiment:
    """cases: what `noise.inject` takes, with object; nodes, edges: the graph. The clean run of a case is the reference of its noisy ones."""

    cases: DataFrame
    nodes: DataFrame
    edges: DataFrame
    seed: int = 42
    levels: tuple[float, ...] = noise.LEVELS
    kinds: tuple[str, ...] = noise.KINDS
    top_k: int = 5

    @cached_property
    def noisy(self) -> DataFrame:
        """The noisy cases with a case_id of their own; base: the case that they come from."""
        found = noise.inject(self.cases, self.seed, self.levels, self.kinds).withColumnRenamed("case_id", "base")
        return cut(found.withColumn("case_id", F.concat_ws("|", "base", F.col("level").cast("string"), "kind")))

    @cached_property
    def analysis(self) -> Analysis:
        """One analysis of all cases, clean and noisy."""
        columns = ["case_id", "dataset", "object", "anomaly_type", "location", "morphology", "variables", "log_events"]
        every = self.cases.select(*columns).unionByName(self.noisy.select(*columns))
        return Analysis(cut(mentions_of(every)), self.nodes, self.edges, self.top_k)

    @cached_property
    def _links(self) -> DataFrame:
        """case_id, field, entity, candidates of the last mention of every field."""
        a = self.analysis
        listed = a.candidates.groupBy("field", "mention_key", "dataset").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("candidates"))
        last = a.links.groupBy("case_id", "dataset", "field").agg(F.max_by(F.struct("mention_key", "entity_id"), "ord").alias("l"))
        return cut(last.select("case_id", "dataset", "field", "l.mention_key", F.col("l.entity_id").alias("entity")).join(listed, ["field", "mention_key", "dataset"], "left").select("case_id", "field", "entity", "candidates"))

    @cached_property
    def records(self) -> DataFrame:
        """case_id (of the noisy case), base, level, kind, is_noisy and every metric."""
        a, share = self.analysis, lambda hit: F.avg(F.coalesce(hit, F.lit(False)).cast("double"))
        runs = self.noisy.select("case_id", "base", "level", "kind", "is_noisy", "corrupted", "object", "anomaly_type")
        clean = self._links.select(F.col("case_id").alias("base"), "field", F.col("entity").alias("gold"))
        pairs = runs.select("case_id", "base").join(clean, "base").join(self._links, ["case_id", "field"], "left")
        linked = pairs.groupBy("case_id").agg(share(F.col("gold") == F.col("entity")).alias("entity_linking_accuracy"), share(F.array_contains(F.slice("candidates", 1, self.top_k), F.col("gold"))).alias("top_k_linking_accuracy"))
        expected = runs.select("case_id", "base", F.explode("corrupted").alias("f")).select("case_id", "base", metrics.field_key(F.col("f")).alias("field")).distinct()
        flagged = a.scores.select("case_id", F.explode("inconsistent_fields").alias("f")).select("case_id", metrics.field_key(F.col("f")).alias("field"), F.lit(1).alias("p")).distinct()
        met = expected.withColumn("e", F.lit(1)).join(flagged.join(runs.select("case_id"), "case_id", "left_semi"), ["case_id", "field"], "full")
        both = F.count(F.when(F.col("e").isNotNull() & F.col("p").isNotNull(), 1))
        over = lambda c: F.when(F.count(c) > 0, both / F.count(c)).otherwise(0.0)
        found = met.groupBy("case_id").agg(over("p").alias("inconsistency_precision"), over("e").alias("inconsistency_recall"))
        first = Window.partitionBy("case_id", "field").orderBy("rank")
        mended = a.corrections.select("case_id", F.col("target_field").alias("field"), "rank", metrics.value_key(F.col("suggested_id")).alias("s")).withColumn("n", F.row_number().over(first))
        mended = mended.groupBy("case_id", "field").agg(F.max(F.when(F.col("n") == 1, F.col("s"))).alias("first"), F.collect_set(F.when(F.col("n") <= self.top_k, F.col("s"))).alias("all"))
        wanted = expected.join(clean.where("gold is not null"), ["base", "field"]).join(mended, ["case_id", "field"], "left").withColumn("gold", metrics.value_key(F.col("gold")))
        mends = wanted.groupBy("case_id").agg(share(F.col("gold") == F.col("first")).alias("correction_accuracy"), share(F.array_contains("all", F.col("gold"))).alias("top_k_correction_accuracy"))
        top = a.top.select("case_id", "rank", "target_id", metrics.path_signature(None, F.col("nodes"), F.col("relations")).alias("sig"))
        was = top.groupBy(F.col("case_id").alias("base")).agg(F.collect_set("target_id").alias("targets"), F.max_by("sig", -F.col("rank")).alias("best"))
        now = runs.select("case_id", "base").join(was, "base").join(top, "case_id")
        ranked = now.groupBy("case_id").agg(F.min(F.when(F.array_contains("targets", F.col("target_id")), F.col("rank"))).alias("hit"), F.max((F.col("sig") == F.col("best")).cast("double")).alias("path_hit_rate"))
        ranked = ranked.select("case_id", F.col("hit").isNotNull().cast("double").alias("top_k_root_cause_accuracy"), F.coalesce(1.0 / F.col("hit"), F.lit(0.0)).alias("mrr"), "path_hit_rate")
        rows = runs.select("case_id", "base", "level", "kind", "is_noisy", (F.col("object").isNotNull() & F.col("anomaly_type").isNotNull()).cast("double").alias("schema_validity_rate"))
        for part in (linked, found, mends, ranked):
            rows = rows.join(part, "case_id", "left")
        rows = rows.withColumn("noise_recovery_rate", F.col("correction_accuracy"))  # by definition the same: a noisy run recovers what its corrections restore
        return rows.select("case_id", "base", "level", "kind", "is_noisy", *[F.coalesce(m, F.lit(0.0)).alias(m) for m in METRICS])

    @cached_property
    def summary(self) -> DataFrame:
        """Means of all metrics by level and kind, and over all (null keys)."""
        return metrics.rollup(self.records, list(METRICS))
