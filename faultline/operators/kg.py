"""Knowledge-graph operators: merge, scope, integrity, neighbourhood, subgraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize
from .lineage import cut

NODE_FIELDS = ("name", "label", "scenario", "aliases")
#: Statuses of an edge that a person has confirmed.
REVIEWED = ("reviewed", "accepted")


def terms(nodes: DataFrame) -> DataFrame:
    """id, label, scenario, ord, term, key of each searchable term: id, name, then aliases."""
    every = F.concat(F.array("id", "name"), "aliases")
    return nodes.select("id", "name", "label", "scenario", F.posexplode(every).alias("ord", "term")).withColumn("key", normalize(F.col("term"))).where("key <> ''")


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id; conflict: rows of the id differ (an error for a caller that wants one graph)."""
    same = F.struct(*NODE_FIELDS)
    out = nodes.groupBy("id").agg(F.min(same).alias("n"), (F.min(same) != F.max(same)).alias("conflict"))
    return out.select("id", "n.*", "conflict")


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row per edge_id of rows with file_order: the last file wins, but an unreviewed row never replaces a reviewed one.

    conflict: a reviewed row met a differing later one that was not reviewed too.
    """
    reviewed = F.col("review_status").isin(*REVIEWED)
    payload = F.struct("file_order", "confidence", "review_status", "source")
    merged = edges.groupBy("edge_id", "head", "relation", "tail", "scenario").agg(
        F.max(F.when(reviewed, payload)).alias("r"),
        F.max(payload).alias("p"),
        F.count("*").alias("copies"),
        F.countDistinct("confidence", "review_status", "source").alias("kinds"),
    )
    chosen = F.coalesce("r", "p")
    return merged.select("edge_id", "head", "relation", "tail", "scenario", chosen["confidence"].alias("confidence"), chosen["review_status"].alias("review_status"), chosen["source"].alias("source"), "copies", (F.col("r").isNotNull() & (F.col("kinds") > 1)).alias("conflict"))


def fold_edges(edges: DataFrame, allow_reviewed_overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the edges that reading rows one after another leaves, the rows that this refuses).

    edges: edge_id, review_status, file_order, line and what else an edge has. A later row replaces one that is not reviewed; a reviewed
    row that differs from what is there before replaces it as long as that is not reviewed, or if it may be overwritten. A row that meets a different
    reviewed one without leave is refused: second table, with what was there (kept). Repeated rows change nothing.
    As the state is either the last row or the first (with leave: last) reviewed one, it is a few aggregates that combine, and
    no edge's rows are gathered, however many there are.
    """
    own = [c for c in edges.columns if c not in ("edge_id", "file_order", "line")]
    reviewed, row = F.col("review_status") == "reviewed", F.struct(*own)
    at = F.struct("file_order", "line")
    pick = F.max_by if allow_reviewed_overwrite else F.min_by
    state = edges.groupBy("edge_id").agg(
        pick(F.when(reviewed, row), F.when(reviewed, at)).alias("_kept"), F.min(F.when(reviewed, at)).alias("_since"), F.max_by(row, at).alias("_last")
    )
    left = state.select("edge_id", F.coalesce("_kept", "_last").alias("_row")).select("edge_id", "_row.*")
    if allow_reviewed_overwrite:
        return left, edges.select("edge_id", "file_order", "line", row.alias("refused"), row.alias("kept")).where("false")
    met = edges.join(state.where("_kept is not null").select("edge_id", "_kept", "_since"), "edge_id")
    refused = met.where((at > F.col("_since")) & ~row.eqNullSafe(F.col("_kept")))
    return left, refused.select("edge_id", "file_order", "line", row.alias("refused"), F.col("_kept").alias("kept"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges an end of which is no node."""
    ids = nodes.select("id")
    heads = edges.join(ids, edges["head"] == ids["id"], "left_anti").withColumn("problem", F.lit("head"))
    tails = edges.join(ids, edges["tail"] == ids["id"], "left_anti").withColumn("problem", F.lit("tail"))
    return heads.unionByName(tails)


def visible_nodes(nodes: DataFrame, datasets: list[str]) -> DataFrame:
    """Each node once for every dataset that sees it: its own, or all if it is shared."""
    seen = F.when(F.col("scenario") == "shared", F.array(*[F.lit(x) for x in datasets])).otherwise(F.array("scenario"))
    return nodes.withColumn("dataset", F.explode(seen)).where(F.col("dataset").isin(datasets))


def visible_edges(nodes: DataFrame, edges: DataFrame, datasets: list[str]) -> DataFrame:
    """Each edge once for every dataset that sees it and both its ends."""
    ends = visible_nodes(nodes.select("id", "scenario"), datasets).select("id", "dataset")
    seen = visible_nodes(edges, datasets)
    return seen.join(ends.withColumnRenamed("id", "head"), ["head", "dataset"], "left_semi").join(ends.withColumnRenamed("id", "tail"), ["tail", "dataset"], "left_semi")


def outgoing(edges: DataFrame, heads: DataFrame, relation: str | None = None) -> DataFrame:
    """Edges that leave the ids in heads (column id)."""
    out = edges if relation is None else edges.where(F.col("relation") == relation)
    return out.join(heads.select(F.col("id").alias("head")).distinct(), "head", "left_semi")


def incoming(edges: DataFrame, tails: DataFrame, relation: str | None = None) -> DataFrame:
    out = edges if relation is None else edges.where(F.col("relation") == relation)
    return out.join(tails.select(F.col("id").alias("tail")).distinct(), "tail", "left_semi")


def has_edge(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of pairs (head, relation, tail, dataset) for which there is an edge."""
    return pairs.join(edges.select("head", "relation", "tail", "dataset"), ["head", "relation", "tail", "dataset"], "left_semi")


def best_between(edges: DataFrame) -> DataFrame:
    """For each (dataset, head, tail) its strongest edge; equal ones by confidence, then id. parallel: how many edges there are."""
    best = F.max_by(F.struct("edge_id", "relation", "confidence", "strength"), F.struct("strength", "confidence", "edge_id"))
    return edges.groupBy("dataset", "head", "tail").agg(best.alias("e"), F.count("*").alias("parallel")).select("dataset", "head", "tail", "e.*", "parallel")


def edges_between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """All edges from head to tail of the pairs (dataset, head, tail), strongest first: place."""
    found = edges.join(pairs.select("dataset", "head", "tail").distinct(), ["dataset", "head", "tail"], "left_semi")
    w = Window.partitionBy("dataset", "head", "tail").orderBy(F.desc("strength"), F.desc("confidence"), F.desc("edge_id"))
    return found.withColumn("place", F.row_number().over(w).cast("long"))


def edge_strength(edges: DataFrame) -> DataFrame:
    """Adds strength: rca_score if positive, else one minus the weight of a propagation edge, else the confidence."""
    columns = edges.columns
    strength = F.col("confidence")
    if "edge_weight" in columns:
        on = F.col("edge_weight").isNotNull() & (F.col("propagation_enabled") if "propagation_enabled" in columns else F.lit(True))
        strength = F.when(on, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("edge_weight")))).otherwise(strength)
    if "rca_score" in columns:
        strength = F.when(F.col("rca_score") > 0, F.col("rca_score")).otherwise(strength)
    return edges.withColumn("strength", strength)


def path_score(scores: Column) -> Column:
    """The mean of a path's positive analysis scores; 0 if it has none."""
    own = F.filter(scores, lambda x: x > 0)
    return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / F.size(own)).otherwise(F.lit(0.0))


def k_hop(edges: DataFrame, focus: DataFrame, hops: int) -> DataFrame:
    """id and hop of every node within `hops` undirected steps of the focus ids."""
    both = cut(edges.select(F.col("head").alias("a"), F.col("tail").alias("b")).unionByName(edges.select(F.col("tail").alias("a"), F.col("head").alias("b"))).distinct())
    found = cut(focus.select("id").distinct().withColumn("hop", F.lit(0)))
    front = found
    for hop in range(1, hops + 1):
        step = both.join(front.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        front = cut(step.join(found.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)))
        found = found.unionByName(front)
    return found


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges both ends of which are among the ids."""
    one = ids.select("id").distinct()
    return edges.join(one.withColumnRenamed("id", "head"), "head", "left_semi").join(one.withColumnRenamed("id", "tail"), "tail", "left_semi")


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """check, severity, subject of everything a graph should not have; isolated nodes are warnings."""
    ids = nodes.select("id")
    touched = edges.select(F.col("head").alias("id")).union(edges.select("tail")).distinct()

    def rows(df, check, subject, severity="error"):
        return df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.col(subject).alias("subject"))

    out = rows(nodes.groupBy("id").count().where("count > 1"), "duplicate_node", "id")
    for more in (
        rows(edges.groupBy("edge_id").count().where("count > 1"), "duplicate_edge", "edge_id"),
        rows(nodes.where("coalesce(trim(name), '') = '' or coalesce(trim(label), '') = ''"), "required_field", "id"),
        rows(dangling(nodes, edges).where("problem = 'head'"), "missing_head", "edge_id"),
        rows(dangling(nodes, edges).where("problem = 'tail'"), "missing_tail", "edge_id"),
        rows(edges.where("head = tail"), "self_edge", "edge_id"),
        rows(edges.where("not (confidence between 0 and 1)"), "confidence_range", "edge_id"),
        rows(ids.join(touched, "id", "left_anti"), "isolated_node", "id", "warning"),
    ):
        out = out.unionByName(more)
    return out


def within_fields(edges: DataFrame, by: list[str]) -> DataFrame:
    """Counts and the spread of confidence by the given columns."""
    c = F.col("confidence")
    return edges.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.min(c), 4).alias("min_confidence"), F.round(F.avg(c), 4).alias("mean_confidence"), F.round(F.max(c), 4).alias("max_confidence"))


def rank_edges(edges: DataFrame, by: list[str]) -> DataFrame:
    """Adds place: reviewed edges first, then by falling confidence, then by id."""
    w = Window.partitionBy(*by).orderBy(F.col("review_status").isin(*REVIEWED).cast("int").desc(), F.desc("confidence"), "edge_id")
    return edges.withColumn("place", F.row_number().over(w).cast("long"))
