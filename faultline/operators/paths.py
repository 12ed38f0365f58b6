"""Root-cause paths: bounded simple paths, scores, top-k, causes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Labels of root causes, and fields whose entities paths start from.
CAUSE_LABELS = ("CandidateCause", "CauseCategory", "Fault", "FaultType", "Mechanism", "RootCause")
SOURCE_FIELDS = ("anomaly_type", "variable", "log_event")
MAX_DEPTH, ALPHA, BETA, GAMMA = 5, 0.55, 0.35, 0.10


def causes(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("label").isin(*CAUSE_LABELS) | F.col("id").endswith("Cause"))


def _ahead(sources: DataFrame, edges: DataFrame, steps: int) -> DataFrame:
    """dataset, id, hop: the nodes that some source reaches in 1 to `steps` steps, and in how few."""
    front = sources.select("dataset", F.col("id").alias("head")).distinct()
    found = None
    for hop in range(1, steps + 1):
        step = edges.join(front, ["dataset", "head"], "left_semi").select("dataset", F.col("tail").alias("id")).distinct()
        if found is not None:
            step = step.join(found.select("dataset", "id"), ["dataset", "id"], "left_anti")
        step = cut(step.withColumn("hop", F.lit(hop)))
        if hop > 1 and step.isEmpty():
            break
        found = step if found is None else found.unionByName(step)
        front = step.select("dataset", F.col("id").alias("head"))
    return found


def endings(sources: DataFrame, best: DataFrame, targets: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """How paths can end: dataset, head, ending, target_id, nodes, edge_ids, relations, their sums and length, from every node that follows a source to a target.

    The search goes back from the targets, so what lies beyond a node is found once, however many sources lead there; it
    keeps to nodes that a source is near enough to, and passes through targets too. ending numbers the row.
    """
    hops = cut(_ahead(sources, best, max_depth))
    step = best.select("dataset", "head", F.col("tail").alias("next"), "edge_id", "relation", "strength", "confidence", "parallel").join(hops.select("dataset", F.col("id").alias("head"), "hop"), ["dataset", "head"])
    none = lambda t: F.array().cast(f"array<{t}>")
    goal = targets.select("dataset", "id").distinct().join(hops.select("dataset", "id"), ["dataset", "id"], "left_semi")
    front = goal.select(
        "dataset", F.col("id").alias("head"), F.col("id").alias("target_id"), F.array("id").alias("nodes"), none("string").alias("edge_ids"), none("string").alias("relations"),
        F.lit(0.0).alias("strength"), F.lit(0.0).alias("confidence"), F.lit(0).alias("length"), F.lit(1).cast("long").alias("copies"),
    )
    front = cut(front)
    found = [front]
    step = cut(step)
    for length in range(1, max_depth):
        usable = step.where(F.col("hop") <= max_depth - length)
        old = front.select("dataset", F.col("head").alias("next"), "target_id", "nodes", "edge_ids", "relations", F.col("strength").alias("s"), F.col("confidence").alias("c"), "copies")
        grown = usable.join(old, ["dataset", "next"]).where(~F.array_contains("nodes", F.col("head")))
        before = lambda x, c: F.concat(F.array(x), F.col(c)).alias(c)
        front = cut(
            grown.select(
                "dataset", "head", "target_id", before("head", "nodes"), before("edge_id", "edge_ids"), before("relation", "relations"),
                (F.col("strength") + F.col("s")).alias("strength"), (F.col("confidence") + F.col("c")).alias("confidence"), F.lit(length).alias("length"), (F.col("copies") * F.col("parallel")).alias("copies"),
            )
        )
        if front.isEmpty():
            break
        found.append(front)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return cut(out.withColumn("ending", F.xxhash64("dataset", F.concat("nodes", "edge_ids"))))


def _first(sources: DataFrame, best: DataFrame) -> DataFrame:
    """The edges that leave the sources: dataset, source_id, head (where they lead), edge_id, relation, s, c, parallel."""
    starts = sources.select("dataset", F.col("id").alias("head")).distinct()
    return starts.join(best, ["dataset", "head"]).select("dataset", F.col("head").alias("source_id"), F.col("tail").alias("head"), "edge_id", "relation", F.col("strength").alias("s"), F.col("confidence").alias("c"), "parallel")


def _sums(both: DataFrame, *others: str) -> DataFrame:
    """Rows of a first edge and an ending as paths: dataset, source_id, ending, edge_id, relation, path_strength, path_confidence, length, copies and other columns."""
    n = F.col("length") + 1
    return both.select(
        "dataset", "source_id", "ending", "edge_id", "relation", ((F.col("s") + F.col("strength")) / n).alias("path_strength"), ((F.col("c") + F.col("confidence")) / n).alias("path_confidence"),
        n.alias("length"), (F.col("copies") * F.col("parallel")).alias("copies"), *others,
    )


def _begun(edges: DataFrame, ends: DataFrame, *others: str) -> DataFrame:
    """The simple paths that start with the edges (of `_first`), with other columns of both."""
    return _sums(edges.join(ends, ["dataset", "head"]).where(~F.array_contains("nodes", F.col("source_id"))), *others)


def begun(sources: DataFrame, best: DataFrame, ends: DataFrame) -> DataFrame:
    """dataset, source_id, ending, edge_id, relation, path_strength, path_confidence, length, copies of every simple path from a source: its first edge and how it ends."""
    return _begun(_first(sources, best), ends)


def _named(wide: DataFrame) -> DataFrame:
    """Begun paths with what their endings pass (_n, _e, _r): nodes, edge_ids and relations of the whole."""
    all_of = lambda first, rest: F.concat(F.array(first), rest)
    return wide.withColumns({"nodes": all_of("source_id", F.col("_n")), "edge_ids": all_of("edge_id", F.col("_e")), "relations": all_of("relation", F.col("_r"))}).drop("_n", "_e", "_r", "edge_id", "relation")


def whole(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows of begun paths with target_id, nodes, edge_ids and relations."""
    return _named(rows.join(ends.select("ending", "target_id", F.col("nodes").alias("_n"), F.col("edge_ids").alias("_e"), F.col("relations").alias("_r")), "ending"))


def all_paths(sources: DataFrame, best: DataFrame, ends: DataFrame) -> DataFrame:
    """As `whole` of what is `begun`: one join, of the sources' edges and the endings, from which each path comes whole."""
    wide = ends.withColumns({"_n": F.col("nodes"), "_e": F.col("edge_ids"), "_r": F.col("relations")}).drop("edge_ids", "relations")
    return _named(_begun(_first(sources, best), wide, "target_id", "_n", "_e", "_r"))


def simple_paths(sources: DataFrame, best: DataFrame, targets: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """All simple paths from sources to targets (both: dataset, id), with nodes, edges, means of strength and confidence, length and copies.

    best: one edge for each (dataset, head, tail), with the number of its parallels; copies is the product of these.
    """
    return all_paths(sources, best, endings(sources, best, targets, max_depth))


def case_starts(cases: DataFrame) -> DataFrame:
    """case_id, dataset, source_id, ids: the entities that each case starts from, each with all that the case has selected. cases: a row each, with selected (field, entity_id)."""
    entity = lambda x: x["entity_id"]
    sources = F.array_distinct(F.transform(F.filter("selected", lambda x: x["field"].isin(*SOURCE_FIELDS)), entity))
    return cases.select("case_id", "dataset", F.explode(sources).alias("source_id"), F.array_distinct(F.transform("selected", entity)).alias("ids"))


def _starts(selected: DataFrame) -> DataFrame:
    return cut(case_starts(selected.groupBy("case_id", "dataset").agg(F.collect_list(F.struct("field", "entity_id")).alias("selected"))))


def _entities(starts: DataFrame) -> DataFrame:
    """dataset, entity_id: what the cases have selected."""
    return starts.select("dataset", F.explode("ids").alias("entity_id")).distinct()


def _through(starts: DataFrame, edges: DataFrame, ends: DataFrame, *others: str) -> DataFrame:
    """The cases' paths that hold a selected entity beside their source: begun paths with case_id, size (entities of the case), met (how many others the path holds).

    A case's entities first meet the edges after which they are passed, then the endings of these edges alone.
    """
    passed = ends.select("dataset", "head", F.explode("nodes").alias("entity_id")).distinct().join(_entities(starts), ["dataset", "entity_id"], "left_semi")
    after = edges.join(passed, ["dataset", "head"]).where("entity_id <> source_id")
    held = starts.select("case_id", "dataset", "source_id", F.size("ids").alias("size"), F.explode("ids").alias("entity_id")).where("entity_id <> source_id")
    by = ["case_id", "dataset", "source_id", "head"]
    rest = [c for c in ("size", *edges.columns) if c not in by]
    hit = held.join(after, ["dataset", "source_id", "entity_id"]).groupBy(*by).agg(F.first(F.struct(*rest)).alias("e"), F.collect_list("entity_id").alias("own")).select(*by, "e.*", "own")
    both = hit.join(ends, ["dataset", "head"]).where(~F.array_contains("nodes", F.col("source_id"))).withColumn("met", F.size(F.array_intersect("nodes", "own")))
    return _sums(both.where("met > 0"), "case_id", "size", "met", *others)


def _match(met, size):
    return (1 + met) / F.greatest(F.lit(1), size)


def _score(strength, match, length, max_depth: int):
    return F.round(ALPHA * strength + BETA * match - GAMMA * length / max_depth + 1e-9, 4)


def score_paths(selected: DataFrame, best: DataFrame, ends: DataFrame, max_depth: int = MAX_DEPTH, keep: int | None = None, parallel: bool = True) -> DataFrame:
    """As `score_starts`, of rows case_id, dataset, field, entity_id."""
    return score_starts(_starts(selected), best, ends, max_depth, keep, parallel)


def score_starts(starts: DataFrame, best: DataFrame, ends: DataFrame, max_depth: int = MAX_DEPTH, keep: int | None = None, parallel: bool = True) -> DataFrame:
    """Each case's paths from its selected source entities, scored by strength, matching evidence and length.

    starts: of `case_starts`. best, ends: as for `begun`, so no path ends where it starts. With `keep`, what cannot be among a case's so many best is left
    out before it is joined to cases (`_kept`). A path with parallel edges counts once for each combination of them, unless `parallel` is off.
    """
    by = ["dataset", "source_id"]
    edges = _first(starts.select("dataset", F.col("source_id").alias("id")), best)
    if keep is not None:
        w = Window.partitionBy("case_id").orderBy(F.desc("score"))
        return _best_scored(starts, edges, ends, max_depth, keep, parallel).withColumn("_place", F.rank().over(w)).where(F.col("_place") <= keep).drop("_place")
    met = F.size(F.array_intersect("nodes", "ids"))  # the source is selected, and no ending holds it
    out = starts.join(_begun(edges, ends, "nodes"), by).select("*", F.size("ids").alias("size"), met.alias("met")).drop("ids", "nodes")
    return whole(_scored(out, max_depth, parallel), ends)


def _scored(out: DataFrame, max_depth: int, parallel: bool) -> DataFrame:
    out = out.withColumn("match", _match(F.col("met"), F.col("size")))
    out = out.withColumn("score", _score(F.col("path_strength"), F.col("match"), F.col("length"), max_depth)).drop("met", "size")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy") if parallel else out


def _best_scored(starts: DataFrame, edges: DataFrame, ends: DataFrame, max_depth: int, keep: int, parallel: bool) -> DataFrame:
    return _named(_scored(_kept(starts, edges, ends, max_depth, keep), max_depth, parallel))


def best_of(starts: DataFrame, best: DataFrame, ends: DataFrame, max_depth: int = MAX_DEPTH, top_k: int = 5, parallel: bool = True) -> DataFrame:
    """The `top_paths` of what `score_starts` gives."""
    edges = _first(starts.select("dataset", F.col("source_id").alias("id")), best)
    return top_paths(_best_scored(starts, edges, ends, max_depth, top_k, parallel).repartition("case_id"), top_k)  # dealt first, so that rows are put in order once


#: Scores are rounded to 4 places, so what is less than this behind may tie.
_TIE = 0.0002


def _kept(starts: DataFrame, edges: DataFrame, ends: DataFrame, max_depth: int, keep: int) -> DataFrame:
    """Begun paths of cases, with size, met and what their endings pass (_n, _e, _r): all that can be among a case's best, and few others.

    What a path scores beside its evidence (its base) does not depend on the case. Where an entity can be passed (first edge), the best base of the
    paths behind it, the least of them and their number are known for each source and next node; so of a case's possible ways, some surely give
    so many paths of a score, and the ways whose best paths stay below that are left out before they meet endings. The paths that hold
    no selected entity but their source have the least match there is: the best of a source by base, ranked among its best ways alone.
    """
    by, way = ["dataset", "source_id"], ["dataset", "source_id", "head"]
    base = lambda strength, length: ALPHA * strength - GAMMA * length / max_depth
    n = F.col("length") + 1
    behind = edges.join(ends.select("dataset", "head", "nodes", "strength", "length"), ["dataset", "head"]).where(~F.array_contains("nodes", F.col("source_id"))).withColumn("base", base((F.col("s") + F.col("strength")) / n, n))
    reach = cut(behind.groupBy(*edges.columns).agg(F.max("base").alias("most"), F.min("base").alias("least"), F.count("*").alias("n")))
    enough = F.when(F.col("n") >= keep, F.col("least"))
    # the best of each source by base alone
    ways = reach.withColumn("_floor", F.max(enough).over(Window.partitionBy(*by))).where(F.col("_floor").isNull() | (F.col("most") >= F.col("_floor") - _TIE))
    named = ends.withColumns({"_n": F.col("nodes"), "_e": F.col("edge_ids"), "_r": F.col("relations")}).drop("edge_ids", "relations")
    ranked = _begun(ways.select(*edges.columns), named, "target_id", "nodes", "_n", "_e", "_r").withColumn("base", base(F.col("path_strength"), F.col("length")))
    first = Window.partitionBy(*by).orderBy(F.desc("base"))
    kth = F.min(F.when(F.col("_nth") <= keep, F.col("base"))).over(Window.partitionBy(*by))
    strong = cut(ranked.withColumn("_nth", F.row_number().over(first)).withColumn("_kth", kth).where(F.col("base") >= F.col("_kth") - _TIE).drop("_nth", "_kth"))
    alone = strong.groupBy(*by).agg(F.max("base").alias("most"), F.min("base").alias("least"), F.count("*").alias("n"))
    # which entities are passed after a first edge, and whether by all paths behind it
    behind = ends.groupBy("dataset", "head").agg(F.count("*").alias("_all"))
    passed = ends.select("dataset", "head", F.explode("nodes").alias("entity_id")).join(_entities(starts), ["dataset", "entity_id"], "left_semi").groupBy("dataset", "head", "entity_id").agg(F.count("*").alias("_some"))
    passed = passed.join(behind, ["dataset", "head"]).select("dataset", "head", "entity_id", (F.col("_some") == F.col("_all")).cast("int").alias("sure"))
    edge = [c for c in edges.columns if c not in way]
    after = reach.join(passed, ["dataset", "head"]).where("entity_id <> source_id").select(*way, "entity_id", "sure", "most", "least", "n", F.struct(*edge).alias("e"))
    held = starts.select("case_id", *by, F.size("ids").alias("size"), F.explode("ids").alias("entity_id")).where("entity_id <> source_id")
    none = F.lit(None)
    hits = held.join(after, [*by, "entity_id"]).withColumn("ids", none.cast("array<string>"))
    plain = starts.withColumn("size", F.size("ids")).join(alone, by).withColumns({"head": none.cast("string"), "entity_id": none.cast("string"), "sure": F.lit(0), "e": none.cast(hits.schema["e"].dataType)})
    rows = hits.unionByName(plain).repartition("case_id")
    one = rows.groupBy("case_id", *way).agg(F.first(F.struct("size", "most", "least", "n", "e", "ids")).alias("x"), F.collect_list("entity_id").alias("own"), F.sum("sure").alias("sure")).select("case_id", *way, "x.*", "own", "sure")
    more = lambda met: BETA * met / F.greatest(F.lit(1), F.col("size"))
    floor = F.max(enough + more(F.col("sure"))).over(Window.partitionBy("case_id"))
    left = cut(one.withColumn("_floor", floor).where(F.col("_floor").isNull() | (F.col("most") + more(F.size("own")) >= F.col("_floor") - _TIE)).drop("_floor", "most", "least", "n", "sure"))
    # those of the best by base that hold another selected entity are among the others
    plain = left.where("head is null").select("case_id", *by, "size", "ids").join(strong, by).where(F.size(F.array_intersect("nodes", "ids")) == 0).withColumn("met", F.lit(0))
    through = left.where("head is not null").select("case_id", *way, "size", "own", "e.*").join(named, ["dataset", "head"]).where(~F.array_contains("nodes", F.col("source_id")))
    through = through.withColumn("met", F.size(F.array_intersect("nodes", "own"))).where("met > 0")
    columns = ["case_id", "size", "met", "target_id", "_n", "_e", "_r"]
    through = _sums(through, *columns)
    return through.unionByName(plain.select(*through.columns))


def score_totals(selected: DataFrame, best: DataFrame, ends: DataFrame, max_depth: int = MAX_DEPTH, parallel: bool = True) -> DataFrame:
    """As `total_starts`, of rows case_id, dataset, field, entity_id."""
    return total_starts(_starts(selected), best, ends, max_depth, parallel)


def total_starts(starts: DataFrame, best: DataFrame, ends: DataFrame, max_depth: int = MAX_DEPTH, parallel: bool = True) -> DataFrame:
    """target_id, dataset, n_paths, n_cases, best, mean_score, mean_match over all that `score_starts` gives without `keep`.

    Paths that hold no selected entity but their source score alike in all cases with as many entities, so a source's paths meet the numbers of such
    cases and not the cases. Those that hold more are counted among these first, and then set right one by one. Scores have 4 places: they are added as whole numbers.
    """
    by, goal = ["dataset", "source_id"], ["target_id", "dataset"]
    edges = _first(starts.select("dataset", F.col("source_id").alias("id")), best)
    sizes = starts.groupBy(*by, F.size("ids").alias("size")).agg(F.count("*").alias("cases")).groupBy(*by).agg(F.collect_list(F.struct("size", "cases")).alias("sizes"))
    times = F.col("copies") if parallel else F.lit(1).cast("long")
    scored = lambda met: _score(F.col("path_strength"), _match(met, F.col("size")), F.col("length"), max_depth)
    units = lambda score: F.round(score * 10000).cast("long")
    every = _begun(edges.join(sizes, by), ends, "target_id", "sizes").select("*", F.inline("sizes")).withColumns({"score": scored(F.lit(0)), "times": F.col("cases") * times})
    more = _through(starts, edges, ends, "target_id").withColumns({"score": scored(F.col("met")), "less": scored(F.lit(0)), "times": times})
    sums = lambda rows, n, units_, match: rows.groupBy(*goal).agg(
        F.sum(n).alias("n"), F.max("score").alias("best"), F.sum(units_ * F.col("times")).alias("units"), F.sum(match * F.col("times")).alias("match")
    )
    none = F.lit(0).cast("long")
    both = sums(every, F.col("times"), units(F.col("score")), _match(F.lit(0), F.col("size"))).unionByName(sums(more, none, units(F.col("score")) - units(F.col("less")), F.col("met") / F.greatest(F.lit(1), F.col("size"))))
    total = both.groupBy(*goal).agg(F.sum("n").alias("n_paths"), F.max("best").alias("best"), F.sum("units").alias("units"), F.sum("match").alias("match"))
    led = _begun(edges, ends, "target_id").select(*by, "target_id").distinct()
    cases = starts.join(led, by).select("case_id", *goal).distinct().groupBy(*goal).agg(F.count("*").alias("n_cases"))
    n = F.col("n_paths")
    return total.join(cases, goal).select(*goal, "n_paths", "n_cases", "best", F.round(F.col("units") / n / 10000, 4).alias("mean_score"), F.round(F.col("match") / n, 4).alias("mean_match"))


def top_paths(scored: DataFrame, top_k: int = 5) -> DataFrame:
    """The best paths of each case: by falling score, then by nodes; each with its stable id."""
    w = Window.partitionBy("case_id").orderBy(F.desc("score"), "nodes")
    digest = F.substring(F.sha1(F.concat_ws("|", F.concat("nodes", "relations"))), 1, 10)
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top_k).withColumn("path_id", F.concat_ws("_", F.lit("path"), "case_id", digest))


def rank_causes(top: DataFrame) -> DataFrame:
    """Causes of each case from its top paths: the best path's figures (the first on ties), all its paths, rank."""
    best = F.max_by(F.struct("path_confidence", "match"), F.struct(F.col("score"), -F.col("rank")))
    out = top.groupBy("case_id", "dataset", F.col("target_id").alias("cause")).agg(
        F.max("score").alias("score"), best.alias("b"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "path_id"))), lambda x: x["path_id"]).alias("path_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("edge_ids")))).alias("edge_ids"), F.array_sort(F.collect_set("source_id")).alias("entity_ids"),
    )
    w = Window.partitionBy("case_id").orderBy(F.desc("score"), "cause")
    return out.select("case_id", "dataset", "cause", "score", F.round("b.path_confidence", 4).alias("confidence"), F.round("b.match", 4).alias("evidence_match"), "path_ids", "edge_ids", "entity_ids").withColumn("rank", F.row_number().over(w).cast("long"))
