"""Near-duplicate embeddings: a forest of random-projection trees with spill, comparison within leaves, union."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_of, map_arrow, materialize, unkey
from .components import components

#: Cosine from which two vectors are linked.
LEAST_COSINE = 0.9
#: Trees; vectors of a leaf, about; distance from a split within which a vector goes to both sides; leaves of a vector in a tree.
TREES, LEAF, SPILL, COPIES = 10, 256, 0.06, 4
#: Vectors that the splits are fitted to, about (a sample by a hash of the vector); every vector is indexed.
SAMPLE = 20_000
#: Levels that have a split for each node; deeper ones go by the split of the last node that the sample still tells apart.
LEVELS = 10
#: Rows of one block of a leaf's comparisons; a leaf of more rows is compared in pairs of blocks, each a task's group of its own.
BLOCK = 1024
#: Parts that the copies of one vector are spread over when they are joined to it.
SALT = 16


def directions(trees: int, depth: int, size: int) -> np.ndarray:
    """A random unit vector for each tree and level, always the same ones."""
    d = np.random.default_rng(20_240_229).standard_normal((trees, max(1, depth), size))
    return d / np.linalg.norm(d, axis=2, keepdims=True)


def fit_splits(sample: np.ndarray, trees: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, thresholds by tree and node (root 1, children 2i and 2i + 1) down to LEVELS, and below that by tree, node of the last such level and level.

    A node splits at the median of its part of the sample; one with too few of them splits where its nearest ancestor
    with enough would. So trees can be as deep as the vectors ask for, and their size grows with the depth alone.
    """
    d = directions(trees, depth, sample.shape[1])
    top = min(depth, LEVELS)
    cuts, low = np.zeros((trees, 1 << top)), np.zeros((trees, 1 << top, depth - top))
    for t in range(trees):
        parts = {1: (sample, sample)}
        for level in range(top):
            below = {}
            for node, (own, wide) in parts.items():
                of = own if len(own) >= 8 else wide
                cut = float(np.median(of @ d[t, level])) if len(of) else 0.0
                cuts[t, node] = cut
                right = own @ d[t, level] > cut if len(own) else np.zeros(0, bool)
                below[2 * node], below[2 * node + 1] = (own[~right], of), (own[right], of)
            parts = below
        if depth > top:
            for node, (own, wide) in parts.items():
                of = own if len(own) >= 8 else wide
                low[t, node - (1 << top)] = np.median(of @ d[t, top:].T, axis=0) if len(of) else 0.0
    return d, cuts, low


def leaves(x: np.ndarray, d: np.ndarray, cuts: np.ndarray, low: np.ndarray, depth: int) -> np.ndarray:
    """The leaves of each vector: for each tree COPIES node numbers in a row, -1 where there is none."""
    trees, n, top = len(d), len(x), cuts.shape[1].bit_length() - 1
    out = np.full((n, trees * COPIES), -1, np.int32)
    for t in range(trees):
        node = np.zeros((n, COPIES), np.int64)
        node[:, 0] = 1
        used = np.ones(n, np.int64)
        for level in range(depth):
            side = x @ d[t, level]
            for c in range(COPIES):
                here = (node[:, c] > 0) & (node[:, c] < 2 << level)  # a copy made on this level is on the next one already
                at = np.where(here, node[:, c], 1 << level)
                gap = side - (cuts[t, at] if level < top else low[t, (at >> (level - top)) - (1 << top), level - top])
                right = (gap > 0).astype(np.int64)
                both = np.flatnonzero(here & (np.abs(gap) <= SPILL) & (used < COPIES))
                fresh = 2 * node[both, c] + 1 - right[both]
                node[:, c] = np.where(here, 2 * node[:, c] + right, node[:, c])
                node[both, used[both]] = fresh
                used[both] += 1
        out[:, t * COPIES : (t + 1) * COPIES] = np.where(node > 0, node, -1)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length, in double precision; scaling by the largest component first keeps squares finite."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _shared_before(codes: np.ndarray, i: np.ndarray, j: np.ndarray, tree: int, leaf: int) -> np.ndarray:
    """Whether vectors i and j also meet in a leaf of an earlier tree, or of this one with a smaller number."""
    found = np.zeros(len(i), bool)
    for t in range(tree + 1):
        for x in range(t * COPIES, (t + 1) * COPIES):
            left = codes[i, x]
            ok = (left >= 0) & ((left < leaf) if t == tree else True)
            if ok.any():
                for y in range(t * COPIES, (t + 1) * COPIES):
                    found |= ok & (left == codes[j, y])
    return found


def compare_leaf(tree: int, leaf: int, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, copies: np.ndarray, side: np.ndarray | None = None):
    """Links of each vector that are counted here, and the smallest id it is tied to within the rows given.

    A pair that meets in several leaves counts in the first of them, so counts of all leaves add up. side: 0 and 1 are
    held against each other; without it, or where all rows are 2, every row is held against every other.
    """
    n = len(ids)
    count, root = np.zeros(n, np.int64), np.arange(n)

    def top(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    whole = side is None or (side == 2).all()
    left, right = (np.arange(n), np.arange(n)) if whole else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for a in range(0, len(left), BLOCK):
        for b in range(a if whole else 0, len(right), BLOCK):
            p, q = left[a : a + BLOCK], right[b : b + BLOCK]
            i, j = np.nonzero(x[p] @ x[q].T >= LEAST_COSINE)
            i, j = p[i], q[j]
            if whole:
                keep = i < j
                i, j = i[keep], j[keep]
            new = ~_shared_before(codes, i, j, tree, leaf)
            i, j = i[new], j[new]
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            for r, s in zip(i.tolist(), j.tolist()):
                r, s = top(r), top(s)
                if r != s:
                    root[max(r, s)] = min(r, s)
    least = ids.copy()
    np.minimum.at(least, np.array([top(k) for k in range(n)], np.int64), ids) if n else None
    return count, least[np.array([top(k) for k in range(n)], np.int64)] if n else ids


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors are linked from a cosine of 0.9 (double precision); a null or zero vector, one that holds a null or a
    non-finite number, or is shorter or longer than most (of lengths that are as frequent, the smallest) has no link.
    Equal vectors are folded before anything else and counted as many times as they occur, so copies are never compared;
    a null id counts as the smallest; rows that share an id but not their vector are vectors of their own. An empty
    table gives an empty result; extra columns are ignored. Every vector is in every tree, links that no leaf shows are
    missed. A leaf with more vectors than a block is compared in pairs of blocks, so no task holds it whole.
    """
    single = df.schema[embedding].dataType.elementType.typeName() == "float"
    kind = np.float32 if single else np.float64
    rows = df.select(key_of(vec_id).alias("id"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("e"))
    lengths = rows.where("e is not null").groupBy(F.size("e").alias("s")).agg(F.count("*").alias("n"))
    dim = next((r["s"] for r in lengths.orderBy(F.desc("n"), "s").limit(1).collect()), 0)
    finite = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.coalesce((F.size("e") == dim) & finite & F.exists("e", lambda v: v != 0), F.lit(False)) & F.lit(dim > 0)
    plain = F.transform("e", lambda v: v.cast("double") + F.lit(0.0))  # -0.0 and 0.0 are equal
    keyed = rows.withColumn("good", good).withColumn("h1", F.when(F.col("good"), F.xxhash64(plain))).withColumn("h2", F.when(F.col("good"), F.xxhash64(F.lit("second"), plain)))
    # a vector is known by its first hash from here on
    reps = materialize(keyed.where("good").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("e").alias("e")))
    n = reps.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / LEAF)))
    draw = F.pmod(F.xxhash64(F.lit("fit"), "h1"), F.lit(1 << 30)) / float(1 << 30)
    picked = reps.where(draw < min(1.0, SAMPLE / max(1, n))).select("e").toPandas()["e"]
    sample = _unit(np.stack([np.asarray(v, np.float64) for v in picked])) if len(picked) else np.ones((1, max(1, dim)))
    shared = df.sparkSession.sparkContext.broadcast((*fit_splits(sample, TREES, depth), depth))

    def route(batch):
        e = batch.column("e").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(batch), -1)
        codes = leaves(_unit(e), *shared.value)
        return {"h1": batch.column("h1"), "copies": batch.column("copies"), "v": pa.array([r.tobytes() for r in e], pa.binary()), "codes": pa.array(list(codes), pa.list_(pa.int32()))}

    coded = materialize(map_arrow(reps.select("h1", "copies", "e"), route, "h1 long, copies long, v binary, codes array<int>"))
    placed = coded.select("*", F.posexplode("codes").alias("slot", "leaf")).where("leaf >= 0").withColumn("tree", (F.col("slot") / COPIES).cast("int")).drop("slot")
    large = placed.groupBy("tree", "leaf").agg(F.count("*").alias("rows")).where(F.col("rows") > 2 * BLOCK)
    parts = F.coalesce(F.ceil(F.col("rows") / BLOCK).cast("int"), F.lit(1))
    dealt = placed.join(large, ["tree", "leaf"], "left").withColumn("parts", parts).withColumn("i", F.pmod("h1", F.col("parts")).cast("int"))
    cell = lambda j: F.struct(F.least("i", j).alias("a"), F.greatest("i", j).alias("b"), F.when(F.col("i") == j, 2).when(F.col("i") < j, 0).otherwise(1).alias("side"))
    cells = dealt.select("tree", "leaf", "h1", "copies", "v", "codes", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), cell)).alias("c")).select("tree", "leaf", "c.a", "c.b", "c.side", "h1", "copies", "v", "codes")

    def compare(pdf):
        import pandas as pd

        ids = pdf["h1"].to_numpy()
        x = _unit(np.frombuffer(b"".join(pdf["v"]), kind).reshape(len(pdf), -1))
        count, least = compare_leaf(int(pdf["tree"].iloc[0]), int(pdf["leaf"].iloc[0]), ids, x, np.stack(pdf["codes"].to_numpy()), pdf["copies"].to_numpy(), pdf["side"].to_numpy())
        some = (count > 0) | (least != ids)
        return pd.DataFrame({"h1": ids[some], "links": count[some], "least": least[some]})

    found = materialize(cells.groupBy("tree", "leaf", "a", "b").applyInPandas(compare, "h1 long, links long, least long"))
    tied = components(found.where("least <> h1").select(F.col("h1").alias("u"), F.col("least").alias("v")))
    sums = found.groupBy("h1").agg(F.sum("links").alias("links"))
    classes = reps.select("h1", "h2", "id", "copies").join(sums, "h1", "left").join(tied.select(F.col("v").alias("h1"), "c"), "h1", "left").withColumn("c", F.coalesce("c", "h1"))
    roots = classes.groupBy("c").agg(F.min("id").alias("root"))
    classes = classes.join(roots, "c").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "root")
    salted = classes.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    ends = keyed.select("id", "h1", "h2", F.pmod("id", F.lit(SALT)).cast("int").alias("s")).join(salted, ["h1", "h2", "s"], "left")
    component = F.coalesce("root", "id")
    return ends.select(unkey("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(component != -(2**63), component).alias("component_id"), (component == F.col("id")).alias("kept"))
