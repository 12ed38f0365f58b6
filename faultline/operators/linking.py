"""Entity linking: candidates for mentions, field filter, ranking, ambiguity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token
from . import similarity
from .lineage import cut
from .similarity import JACCARD, WEIGHTED, Measure

#: Node labels that each field may link to.
FIELD_LABELS = {
    "object": ["Object"],
    "anomaly_type": ["Anomaly", "AnomalyType", "Defect", "DefectType", "Fault", "FaultType", "Pattern"],
    "location": ["Location", "ProcessUnit"],
    "morphology": ["Morphology", "Pattern"],
    "variable": ["Variable"],
    "log_event": ["EvidenceSource", "LogEvent"],
}
#: Scores of the kinds of match, the least score of a candidate, and the margin below which a link is ambiguous.
EXACT_ID, EXACT_NAME, ALIAS = 1.0, 0.98, 0.95
MIN_SCORE, AMBIGUOUS = 0.55, 0.08
#: Nodes of each level and scope that a mention looks into first.
LIKELY = 2


def exact_candidates(mentions: DataFrame, terms: DataFrame) -> DataFrame:
    """mention_key, dataset, id, label, score, match_type for terms with the same key that the dataset sees.

    mentions: mention_key, dataset. An equi-join on the key; of a node's matching terms the best counts.
    """
    distinct = mentions.select("mention_key", "dataset").where("mention_key <> ''").distinct()
    hit = distinct.join(terms.select("id", "label", "scenario", F.col("key").alias("mention_key"), "ord"), "mention_key").where("scenario in (dataset, 'shared')")
    score = F.when(F.col("ord") == 0, EXACT_ID).when(F.col("ord") == 1, EXACT_NAME).otherwise(ALIAS)
    return hit.groupBy("mention_key", "dataset", "id", "label").agg(F.max(score).alias("score")).withColumn("match_type", _exact_type())


def _exact_type():
    return F.when(F.col("score") == EXACT_ID, "exact_id").when(F.col("score") == EXACT_NAME, "exact_name").otherwise("alias")


def near_scores(keys: DataFrame, term_keys: DataFrame, measure: Measure = JACCARD, min_score: float = MIN_SCORE) -> DataFrame:
    """mention_key, key, score, match_type of differing strings where one holds the other, or whose ratio is min_score or more.

    Both sides are distinct strings, so repeated names cost nothing.
    """
    index = similarity.build(term_keys.select(F.lit("").alias("scope"), "key").distinct())
    wanted = keys.select("mention_key").where("mention_key <> ''").distinct().select("mention_key", F.lit("").alias("scope"), F.lit(min_score).alias("least"))
    return similarity.search(wanted, index, measure)


def near_candidates(mentions: DataFrame, terms: DataFrame, measure: Measure = JACCARD, k: int | None = None) -> DataFrame:
    """As exact_candidates, for partial and fuzzy matches; a node keeps its best term, the first on ties.

    k: only candidates that can be among the best k of a mention in a dataset are needed. Mentions that have k nodes within one character, two or
    three, better than anything farther off can be (by the weighted ratio), are done with these, found by equality of what is left without
    them, so a mention does not meet the blocks of the tree, which grow with the terms. Of the others each first looks into a few blocks of terms that are surely like it; what the k-th node there scores is the least that is
    looked for, from the top of the tree on.
    """
    strings = terms.select(F.col("scenario").alias("scope"), "key").distinct()
    seen = mentions.select("mention_key", "dataset").where("mention_key <> ''").distinct()
    by = ["mention_key", "dataset"]

    def nodes(found: DataFrame) -> DataFrame:
        hit = found.join(terms.select("id", "label", "ord", "key", F.col("scenario").alias("scope")), ["scope", "key"])
        best = F.max_by(F.struct("score", "match_type"), F.struct(F.col("score"), -F.col("ord")))
        return hit.groupBy(*by, "id", "label").agg(best.alias("b")).select(*by, "id", "label", "b.score", "b.match_type")

    wanted = seen.select(*by, F.explode(F.array("dataset", F.lit("shared"))).alias("scope"), F.lit(MIN_SCORE).alias("least"))
    done = None
    if k is not None:
        strings, wanted = cut(strings), cut(wanted)
        for apart in range(1, similarity.CLOSE + 1) if measure == WEIGHTED else ():
            length = F.length("mention_key")
            asked = wanted.where(similarity.settles(length, apart)).withColumn("least", F.lit(similarity.PARTIAL))
            if asked.isEmpty():
                continue
            near = cut(nodes(similarity.close(asked, strings, measure, apart)))
            kth = rank(near, by, k, "_rank").where((F.col("_rank") == k) & (F.col("score") > similarity.beyond(length, apart))).select(*by)
            own, wanted = near.join(kth, by, "left_semi"), cut(wanted.join(kth, by, "left_anti"))
            done = own if done is None else done.unionByName(own)
            if wanted.isEmpty():
                return done
    index = similarity.build(strings)
    if k is not None:
        likely = similarity.descend(wanted, index, measure, LIKELY)
        first = rank(nodes(similarity.compare(likely, index, measure)), by, k, "_rank").where(F.col("_rank") == k).select(*by, F.col("score").alias("_least"))
        wanted = wanted.join(cut(first), by, "left").withColumn("least", F.coalesce("_least", "least")).select(*wanted.columns)
    found = nodes(similarity.compare(similarity.descend(wanted, index, measure), index, measure))
    return found if done is None else done.unionByName(found)


def all_candidates(mentions: DataFrame, terms: DataFrame, measure: Measure = JACCARD, k: int | None = None) -> DataFrame:
    """Exact, partial and fuzzy candidates; a node that matches in several ways keeps the best. k: as for near_candidates."""
    both = exact_candidates(mentions, terms).unionByName(near_candidates(mentions, terms, measure, k))
    best = F.max_by(F.struct("score", "match_type"), "score")
    return both.groupBy("mention_key", "dataset", "id", "label").agg(best.alias("b")).select("mention_key", "dataset", "id", "label", "b.score", "b.match_type")


def rank(candidates: DataFrame, by: list[str], k: int, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return candidates.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= k)


def field_filter(fields: DataFrame, candidates: DataFrame, top_k: int = 3) -> DataFrame:
    """Candidates of each (field, mention_key, dataset), cut to max(5 * top_k, 10) first, then to labels the field allows.

    Where no candidate has an allowed label all stay; then the best top_k, ranked.
    """
    wide = rank(candidates, ["mention_key", "dataset"], max(5 * top_k, 10), "_pre")
    joined = fields.select("field", "mention_key", "dataset").distinct().join(wide, ["mention_key", "dataset"])
    ok = F.lit(False)
    for field, labels in FIELD_LABELS.items():
        ok = ok | ((F.col("field") == field) & F.col("label").isin(labels))
    by = ["field", "mention_key", "dataset"]
    some = F.max(ok.cast("int")).over(Window.partitionBy(*by))
    kept = joined.withColumn("_ok", ok).withColumn("_some", some).where("_ok or _some = 0")
    return rank(kept, by, top_k).drop("_pre", "_ok", "_some")


def field_candidates(mentions: DataFrame, terms: DataFrame, measure: Measure = WEIGHTED, top_k: int = 3) -> DataFrame:
    """The ranked candidates of each (field, mention_key, dataset); the first is as if all terms had been looked at, the others are where they can matter.

    Strings that are not equal are searched only for mentions whose first exact match could be outdone: a ratio of
    different keys is 2L / (2L + 1) at most, L being the length of the mention's key.
    """
    fields = cut(mentions.select("field", "mention_key", "dataset").where("mention_key <> ''").distinct())
    terms = cut(terms)
    exact = cut(exact_candidates(fields, terms))
    best = cut(field_filter(fields, exact, top_k))
    length = F.length("mention_key")
    counted = rank(exact, ["mention_key", "dataset"], max(5 * top_k, 10), "_pre").groupBy("mention_key", "dataset").agg(F.count("*").alias("_exact"))
    first = best.where("rank = 1").join(counted, ["mention_key", "dataset"])
    present = {r["label"] for r in terms.select("label").distinct().collect()}  # labels are kinds of things, a few dozen
    allowed = ~F.col("field").isin(*FIELD_LABELS)
    for field, labels in FIELD_LABELS.items():  # where no node has a label that the field allows, any node will do
        allowed = allowed | ((F.col("field") == field) & (F.col("label").isin(labels) | F.lit(not present & set(labels))))
    sure = first.where((F.col("score") > 2.0 * length / (2.0 * length + 1.0)) & (allowed | (F.col("_exact") >= max(5 * top_k, 10)))).select("field", "mention_key", "dataset")
    known = best.join(sure, ["field", "mention_key", "dataset"], "left_semi")
    open_ = cut(fields.join(sure, ["field", "mention_key", "dataset"], "left_anti"))
    if open_.isEmpty():
        return known
    found = field_filter(open_, all_candidates(open_, terms, measure, max(5 * top_k, 10)), top_k)
    return known.unionByName(found)


def with_ambiguity(ranked: DataFrame, by: list[str]) -> DataFrame:
    """The first of each group with its margin over the second; a missing second leaves the margin null."""
    second = F.lead("score").over(Window.partitionBy(*by).orderBy("rank"))
    margin = F.when(F.col("_second") > 0, F.round(F.col("score") - F.col("_second"), 4))
    out = ranked.withColumn("_second", second).where("rank = 1").withColumn("margin", margin)
    return out.withColumn("ambiguous", F.coalesce(F.col("margin") < AMBIGUOUS, F.lit(False))).drop("_second")


def link(mentions: DataFrame, first: DataFrame) -> DataFrame:
    """A link for every mention, with its id; entity and score are null where nothing was found.

    mentions: case_id, dataset, field, ord, mention, mention_key. first: the selected candidates.
    """
    nth = F.row_number().over(Window.partitionBy("case_id", "field", "mention").orderBy("ord"))
    base = F.concat_ws("_", F.lit("link"), "case_id", "field", F.coalesce(F.nullif(token(F.col("mention")), F.lit("")), F.lit("unknown")))
    link_id = F.when(F.col("_nth") > 1, F.concat(base, F.format_string("_%02d", F.col("_nth")))).otherwise(base)
    chosen = first.select("field", "mention_key", "dataset", F.col("id").alias("entity_id"), F.round("score", 4).alias("score"), "match_type", "margin", "ambiguous")
    out = mentions.withColumn("_nth", nth).withColumn("link_id", link_id).drop("_nth")
    return out.join(chosen, ["field", "mention_key", "dataset"], "left")


def by_case(links: DataFrame) -> DataFrame:
    """A row for each case: case_id, dataset, selected (field and entity_id: of the links of a field that found an entity, the last), linked and found (how many links, and how many of them found one), type (its last anomaly_type as said).

    Rows are dealt by case once, so what is worked out for fields and for cases needs no other exchange.
    """
    kind = F.col("field") == "anomaly_type"
    dealt = links.select("case_id", "dataset", "field", "ord", "entity_id", F.when(kind, F.col("mention")).alias("said")).repartition("case_id")
    each = dealt.groupBy("case_id", "dataset", "field").agg(
        F.max_by("entity_id", F.when(F.col("entity_id").isNotNull(), F.col("ord"))).alias("entity_id"), F.max_by("said", "ord").alias("said"), F.count("*").alias("linked"), F.count("entity_id").alias("found")
    )
    entity = F.when(F.col("entity_id").isNotNull(), F.struct("field", "entity_id"))
    return each.groupBy("case_id", "dataset").agg(F.collect_list(entity).alias("selected"), F.sum("linked").alias("linked"), F.sum("found").alias("found"), F.max(F.when(kind, F.struct("said"))).alias("t")).select("case_id", "dataset", "selected", "linked", "found", F.col("t.said").alias("type"), F.col("t").isNotNull().alias("typed"))


def selected(cases: DataFrame) -> DataFrame:
    """case_id, dataset, field, entity_id of what the cases (of `by_case`) have selected."""
    return cases.select("case_id", "dataset", F.inline("selected"))
