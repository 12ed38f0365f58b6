"""Candidates and score propagation over a graph of relations, by joins: one for each hop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signals import FAMILIES
from .lineage import cut

#: Hops, least and most signal, longest trace; decay of a downstream signal by hop.
MAX_HOPS, EPSILON, CAP, MAX_TRACE = 4, 1e-6, 1.0, 12
DECAY = 0.92
#: Types of nodes that can be candidates where none is marked as one, the role of anchors, largest contributions looked at.
CANDIDATE_TYPES = ("Component", "Equipment", "FaultAnchor", "Stream", "Variable")
ANCHOR, TOP_VARIABLES = "root_cause_anchor", 8


def reach(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """id, at, strength: the largest product of weights and decays by which a start reaches a node within `depth` steps.

    A walk may come back to its start; only the best strength of a node is kept at each hop, which loses nothing, as a
    hop never makes a strength larger.
    """
    front = starts.select("id").distinct().select("id", F.col("id").alias("at"), F.lit(1.0).alias("strength"))
    step = edges.select(F.col("head").alias("at"), "tail", "weight")
    every = None
    for _ in range(depth):
        grown = front.join(step, "at").select("id", F.col("tail").alias("at"), (F.col("strength") * F.col("weight") * DECAY).alias("strength"))
        front = cut(grown.where(F.col("strength") > EPSILON).groupBy("id", "at").agg(F.max("strength").alias("strength")))
        every = front if every is None else every.unionByName(front)
    return every.groupBy("id", "at").agg(F.max("strength").alias("strength"))


def downstream(starts: DataFrame, edges: DataFrame, signals: DataFrame, depth: int = 3, k: int = 4) -> DataFrame:
    """For each start the k variables that it reaches with the largest product of weights, decays and signal.

    starts: id; edges: head, tail, weight; signals: id, signal.
    """
    hit = reach(starts, edges, depth).join(signals.withColumnRenamed("id", "at"), "at").withColumn("value", F.round(F.col("strength") * F.col("signal") + 1e-12, 8))
    w = Window.partitionBy("id").orderBy(F.desc("value"), "at")
    return hit.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("id", "at", "value", "rank")


def support_signals(reached: DataFrame, contributions: DataFrame, k: int = 4) -> DataFrame:
    """case_id, id, support, variable: the sum of a case's k largest products of contribution and strength, and where the largest is.

    reached: id, at, strength (of variables). contributions: case_id, id, value. Only what is positive counts.
    """
    hit = contributions.where("value > 0").select("case_id", F.col("id").alias("at"), "value").join(reached, "at").withColumn("hit", F.col("value") * F.col("strength"))
    w = Window.partitionBy("case_id", "id").orderBy(F.desc("hit"), "at")
    best = hit.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    return best.groupBy("case_id", "id").agg(F.round(F.sum("hit"), 8).alias("support"), F.min_by("at", "_n").alias("variable"))


def incident(edges: DataFrame) -> DataFrame:
    """id, next, pos: the neighbours of every node; pos orders them: where edges lead first, by priority, tail and edge, then where they come from."""
    priority = family_priority(F.col("family"))
    out = edges.select(F.col("head").alias("id"), F.col("tail").alias("next"), F.struct(F.lit(0).alias("side"), (-priority).alias("p"), F.col("tail").alias("n"), "edge_id").alias("pos"))
    back = edges.select(F.col("tail").alias("id"), F.col("head").alias("next"), F.struct(F.lit(1).alias("side"), F.lit(0).alias("p"), F.lit("").alias("n"), "edge_id").alias("pos"))
    return out.unionByName(back).groupBy("id", "next").agg(F.min("pos").alias("pos"))


def possible_sources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes (id, name, type, role) that are marked as candidates and have an edge that leaves them; where none is marked, those of CANDIDATE_TYPES."""
    heads = edges.select(F.col("head").alias("id")).distinct()
    leaving = nodes.select("id", "name", "type", "role", "candidate").join(heads, "id", "left_semi")
    marked = leaving.where("candidate")
    return (leaving.where(F.col("type").isin(*CANDIDATE_TYPES)) if marked.isEmpty() else marked).drop("candidate")


#: Blocks in which a table is dealt out where each of its rows belongs to each of another.
BLOCKS = 32


def with_each(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row of left with each of right, where that is the result that is asked for: by an equi-join on blocks of the right rows, so neither side has to fit anywhere."""
    dealt = right.withColumn("_block", F.pmod(F.hash(*right.columns), F.lit(BLOCKS)))
    return left.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).join(dealt, "_block").drop("_block")


def candidates(cases: DataFrame, contributions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Possible sources of every case, in their order (place).

    cases: case_id. contributions: case_id, id, value (weighted). nodes: id, name, type, role, candidate. edges: head, tail, edge_id, family, weight.
    First come a case's largest variables and what lies beside them (priority 1), then what lies beside those (2); all
    anchors stand for a case, whether they lie near or not (2 with support, 3 without). direct, adjacent and support
    are the contributions that speak for a candidate, seed_variable the one that it was found by. A case without any
    has all possible sources (3); no number of sources is too large.
    """
    sources = cut(possible_sources(nodes, edges))
    kind = sources.select("id", "type", "role")
    w = Window.partitionBy("case_id").orderBy(F.desc("value"), "id")
    top = contributions.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= TOP_VARIABLES)
    at = lambda own, pos: F.struct("nth", F.lit(own).alias("own"), pos.alias("pos"))
    beside = cut(incident(edges).join(sources.select(F.col("id").alias("next")), "next", "left_semi"))
    none = F.lit(None).cast(beside.schema["pos"].dataType)
    own = top.join(kind.where("type = 'Variable'"), "id", "left_semi").select("case_id", "id", "value", F.lit(True).alias("mine"), F.col("id").alias("variable"), at(0, none).alias("pos"))
    near = top.join(beside, "id").select("case_id", F.col("next").alias("id"), "value", F.lit(False).alias("mine"), F.col("id").alias("variable"), at(1, F.col("pos")).alias("pos"))
    best = F.max_by(F.struct("value", "variable", "mine"), F.struct("mine", "value", -F.col("pos.nth")))
    first = own.unionByName(near).groupBy("case_id", "id").agg(best.alias("b"), F.min("pos").alias("pos"))
    value = F.col("b.value")
    first = cut(first.select("case_id", "id", "pos", F.lit(1).alias("priority"), value.alias("adjacent"), F.when(F.col("b.mine"), value).otherwise(0.0).alias("support"), F.col("b.variable").alias("seed_variable")))
    far = first.join(beside.withColumnRenamed("pos", "p"), "id").join(first.select("case_id", F.col("id").alias("next")), ["case_id", "next"], "left_anti")
    far = far.groupBy("case_id", F.col("next").alias("id")).agg(F.min_by(F.struct((0.7 * F.col("adjacent")).alias("adjacent"), "seed_variable"), F.struct("pos", "p")).alias("b"))
    far = far.select("case_id", "id", F.lit(2).alias("priority"), F.col("b.adjacent").alias("adjacent"), F.lit(0.0).alias("support"), F.col("b.seed_variable").alias("seed_variable"))
    found = first.drop("pos").unionByName(far)
    variables = nodes.where("type = 'Variable'").select(F.col("id").alias("at"))
    anchors = kind.where(F.col("role") == ANCHOR)
    three = cut(reach(anchors, edges, 3).join(variables, "at", "left_semi"))
    two = reach(kind.where(F.coalesce(F.col("role") != ANCHOR, F.lit(True))), edges, 2).join(variables, "at", "left_semi")
    signal = cut(support_signals(three.unionByName(two), contributions))
    every = cases.select("case_id").distinct()
    standing = with_each(every, anchors.select("id"))
    both = found.join(standing.withColumn("standing", F.lit(True)), ["case_id", "id"], "full").join(signal.withColumnRenamed("support", "s"), ["case_id", "id"], "left")
    s, new = F.coalesce("s", F.lit(0.0)), F.col("priority").isNull()
    raised = F.coalesce("standing", F.lit(False)) & (new | (s > F.col("adjacent")))
    both = both.select(
        "case_id", "id", F.when(~new, F.col("priority")).when(s > 0, 2).otherwise(3).alias("priority"), F.when(raised, s).otherwise(F.col("adjacent")).alias("adjacent"),
        F.greatest(F.coalesce("support", F.lit(0.0)), s).alias("support"), F.when(raised & F.col("variable").isNotNull(), F.col("variable")).otherwise(F.coalesce("seed_variable", "variable", F.lit(""))).alias("seed_variable"),
    )
    bare = every.join(both.select("case_id").distinct(), "case_id", "left_anti")
    zero = F.lit(0.0)
    both = both.unionByName(with_each(bare, sources.select("id")).select("case_id", "id", F.lit(3).alias("priority"), zero.alias("adjacent"), zero.alias("support"), F.lit("").alias("seed_variable")))
    direct = contributions.select("case_id", "id", F.col("value").alias("direct"))
    out = both.join(direct, ["case_id", "id"], "left").withColumn("direct", F.coalesce("direct", zero)).join(sources, "id")
    order = Window.partitionBy("case_id").orderBy("priority", F.desc(F.greatest("adjacent", "support")), F.desc("direct"), "type", F.lower("name"), "id")
    return out.withColumn("place", F.row_number().over(order).cast("long"))


def family_priority(family: Column) -> Column:
    out = F.lit(0)
    for name, (_, priority) in FAMILIES.items():
        out = F.when(family == name, F.lit(priority)).otherwise(out)
    return out


_ORDER = sorted(FAMILIES, key=lambda f: (-FAMILIES[f][1], f))


def _received(hop: int):
    """What a node takes in on a hop from its offers in their order, as a fold over them.

    An offer is divided by how often its family has reached the node by then; what the node has no room for is lost.
    """

    def step(acc, o):
        times = F.element_at(acc["counts"], o["f"] + 1) + 1
        amount = o["amount"] / times
        room = F.greatest(F.lit(0.0), F.lit(CAP) - acc["score"] - acc["gained"])
        taken = F.least(amount, room)
        ok = (amount > EPSILON) & (room > EPSILON)
        best = ok & (taken > acc["gain"])
        return F.struct(
            acc["score"].alias("score"),
            F.when(ok, acc["gained"] + taken).otherwise(acc["gained"]).alias("gained"),
            F.when(ok, F.transform(acc["counts"], lambda c, i: F.when(i == o["f"], c + 1).otherwise(c))).otherwise(acc["counts"]).alias("counts"),
            F.when(best, taken).otherwise(acc["gain"]).alias("gain"),
            F.when(best, o["edge_id"]).otherwise(acc["parent"]).alias("parent"),
            F.when(best, o["head"]).otherwise(acc["parent_head"]).alias("parent_head"),
        )

    fresh = F.struct(
        F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(0.0).alias("gained"), F.coalesce("s.counts", F.array(*[F.lit(0) for _ in _ORDER])).alias("counts"),
        F.coalesce("s.gain", F.lit(0.0)).alias("gain"), F.col("s.parent").alias("parent"), F.col("s.parent_head").alias("parent_head"),
    )
    return F.aggregate("offers", fresh, step)


def spread(sources: DataFrame, edges: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """case_id, source, node, score, parent, parent_head of every node that a source reaches; parent: the edge that gave it most at once.

    sources: case_id, source, seed. edges: head, tail, edge_id, family, weight. A hop is one join of the nodes that
    have just gained with the edges that leave them; the offers to a node are met in the order of family priority,
    head and edge. Each hop is written out.
    """
    index = F.lit(-1)
    fade = F.lit(0.0)
    for i, f in enumerate(_ORDER):
        index = F.when(F.col("family") == f, F.lit(i)).otherwise(index)
        fade = F.when(F.col("family") == f, F.lit(FAMILIES[f][0])).otherwise(fade)
    step = cut(edges.where(F.col("family").isin(*FAMILIES)).select(F.col("head").alias("node"), "tail", "edge_id", index.alias("f"), fade.alias("sigma"), F.col("weight").cast("double").alias("weight")))
    keys = ["case_id", "source", "node"]
    state = "struct<counts:array<int>,gain:double,parent:string,parent_head:string>"
    done = sources.select("case_id", "source", F.col("source").alias("node"), F.col("seed").cast("double").alias("gained"), F.lit(0).alias("hop"), F.lit(None).cast(state).alias("s"))
    front = done.select(*keys, "gained")
    for hop in range(1, hops + 1):
        offered = front.join(step, "node").select("case_id", "source", F.col("tail").alias("to"), F.struct("f", F.col("node").alias("head"), "edge_id", (F.col("gained") * F.col("weight") * F.exp(-F.col("sigma") * hop)).alias("amount")).alias("o"))
        offers = offered.groupBy("case_id", "source", F.col("to").alias("node")).agg(F.array_sort(F.collect_list("o")).alias("offers"))
        before = done.groupBy(*keys).agg(F.sum("gained").alias("score"), F.max_by("s", "hop").alias("s"))
        r = offers.join(before, keys, "left").select(*keys, _received(hop).alias("r"))
        gained = cut(r.where("r.gained > 0").select(*keys, "r.gained", F.lit(hop).alias("hop"), F.struct("r.counts", "r.gain", "r.parent", "r.parent_head").cast(state).alias("s")))
        if gained.isEmpty():
            break
        done, front = done.unionByName(gained), gained.select(*keys, "gained")
    out = done.groupBy(*keys).agg(F.round(F.sum("gained"), 8).alias("score"), F.max_by("s", "hop").alias("s"))
    return out.select(*keys, "score", "s.parent", "s.parent_head")


def traced(reached: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (case_id, source, node, ...) with path: the edges from the source, each the one that gave its end most; null if they do not lead there.

    A path has MAX_TRACE edges at most. What one source reaches within its hops is one map.
    """
    link = F.struct("node", F.struct("parent", "parent_head").alias("p"))
    maps = reached.where("parent is not null").groupBy("case_id", "source").agg(F.map_from_entries(F.collect_list(link)).alias("parents"))

    def step(acc, _):
        p = F.try_element_at(F.col("parents"), acc["at"])
        at = p["parent_head"]
        going = ~acc["end"]
        arrived, lost = at == F.col("source"), p.isNull() | F.array_contains(acc["seen"], at)
        return F.struct(
            F.when(going & p.isNotNull(), at).otherwise(acc["at"]).alias("at"),
            F.when(going & p.isNotNull(), F.concat(F.array(p["parent"]), acc["path"])).otherwise(acc["path"]).alias("path"),
            F.when(going & p.isNotNull(), F.concat(F.array(at), acc["nodes"])).otherwise(acc["nodes"]).alias("nodes"),
            F.when(going & p.isNotNull(), F.concat(acc["seen"], F.array(at))).otherwise(acc["seen"]).alias("seen"),
            F.when(going, F.coalesce(arrived, F.lit(False))).otherwise(acc["ok"]).alias("ok"),
            F.when(going, F.coalesce(arrived, F.lit(False)) | lost).otherwise(F.lit(True)).alias("end"),
        )

    none = F.array().cast("array<string>")
    start = F.struct(F.col("node").alias("at"), none.alias("path"), F.array("node").alias("nodes"), F.array("node").alias("seen"), F.lit(False).alias("ok"), (F.col("node") == F.col("source")).alias("end"))
    followed = wanted.join(maps, ["case_id", "source"], "left").withColumn("t", F.aggregate(F.sequence(F.lit(1), F.lit(MAX_TRACE)), start, step)).drop("parents")
    return followed.withColumns({"path": F.when(F.col("t.ok"), F.col("t.path")), "nodes": F.when(F.col("t.ok"), F.col("t.nodes"))}).drop("t")


def propagate(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """case_id, source, node, score, path for every node a source reaches; path: edges from the source, joined by >, empty if there is none."""
    reached = cut(spread(sources, edges))
    return traced(reached, reached.drop("parent", "parent_head")).select("case_id", "source", "node", "score", F.coalesce(F.array_join("path", ">"), F.lit("")).alias("path"))


def support_paths(causes: DataFrame, variables: DataFrame, edges: DataFrame, depth: int = 4) -> DataFrame:
    """case-free shortest undirected paths from causes to variables, not through another cause: cause, variable, path, confidence (the mean of its edges').

    Of shortest paths the first in the order of (falling confidence, edge_id) at each step.
    """
    confident = (1 - F.col("confidence")).alias("c")
    both = edges.select(F.col("head").alias("at"), F.col("tail").alias("next"), confident, "edge_id").unionByName(edges.select(F.col("tail").alias("at"), F.col("head").alias("next"), confident, "edge_id"))
    goal = variables.select(F.col("id").alias("at"))
    blocked = causes.select(F.col("id").alias("next"))
    front = causes.select(F.col("id").alias("cause"), F.col("id").alias("at"), F.array().cast("array<struct<c:double,edge_id:string>>").alias("path"))
    seen, found = front.select("cause", "at"), None
    for _ in range(depth):
        grown = front.join(both, "at").join(blocked, "next", "left_anti").select("cause", F.col("next").alias("at"), F.concat("path", F.array(F.struct("c", "edge_id"))).alias("path"))
        front = cut(grown.groupBy("cause", "at").agg(F.min("path").alias("path")).join(seen, ["cause", "at"], "left_anti"))
        seen = cut(seen.unionByName(front.select("cause", "at")))
        hit = front.join(goal, "at", "left_semi")
        found = hit if found is None else found.unionByName(hit)
    return found.select("cause", F.col("at").alias("variable"), F.transform("path", lambda x: x["edge_id"]).alias("path"), (1 - F.aggregate("path", F.lit(0.0), lambda s, x: s + x["c"]) / F.size("path")).alias("confidence"))
