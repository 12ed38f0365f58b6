"""Anchor profiles and ranking terms over long rows (id, feature, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Terms of the structural score.
TYPE_BIAS = {"FaultAnchor": 0.06, "Equipment": 0.03, "Variable": 0.0, "Stream": -0.03, "Component": -0.03}
ROLE_BIAS = {"root_cause_anchor": 0.10, "equipment_anchor": 0.03, "stream_anchor": 0.0, "composition_anchor": 0.02, "actuator": -0.03, "observation": -0.08, "support_only": -0.20}
COVERAGE_PENALTY, ENTROPY_PENALTY, DISCRIMINATOR_WEIGHT = 0.12, 0.03, 0.28
CONTRIBUTION_WEIGHT, DYNAMIC_WEIGHT, UNIQUE_WEIGHT = 5.0, 4.0, 0.0
#: How much the two spaces count when anchors are compared; weights of variables by their role.
SIBLING_SHARES = (0.6, 0.4)
ROLE_WEIGHT, OTHER_ROLE = {"actuator": 0.35, "sensor": 1.0}, 0.75
SEED_FLOORS, SEED_CAP, SUPPORT_SHARE = (0.18, 0.12), 0.35, 0.9


def centroids(rows: DataFrame) -> DataFrame:
    """anchor, feature, value: sums of its vectors' values over the number of its vectors (a missing value is 0)."""
    sizes = rows.groupBy("anchor").agg(F.countDistinct("vec_id").alias("n"))
    return rows.groupBy("anchor", "feature").agg(F.sum("value").alias("s")).join(F.broadcast(sizes), "anchor").select("anchor", "feature", (F.col("s") / F.col("n")).alias("value"))


def cosine(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Cosine of every left with every right vector that shares a feature; join and sums on features, no dense pairs.

    left: a, feature, value; right: b, feature, value.
    """
    norm = lambda df, k: df.groupBy(k).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias(f"n_{k}"))
    dot = left.withColumnRenamed("value", "x").join(right.withColumnRenamed("value", "y"), "feature").groupBy(a, b).agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    both = dot.join(norm(left, a), a).join(norm(right, b), b)
    size = F.col(f"n_{a}") * F.col(f"n_{b}")
    return both.select(a, b, F.when(size > 0, F.col("dot") / size).otherwise(F.lit(0.0)).alias("cosine"))


def siblings(profile: DataFrame, k: int = 4, dynamic: DataFrame | None = None) -> DataFrame:
    """The k most similar other anchors of each by the cosine of their profiles; ties by anchor.

    With dynamic profiles both spaces count, by SIBLING_SHARES; ties are then broken by contributions, then dynamics.
    """
    pairs = lambda p: cosine(p, p.withColumnRenamed("anchor", "sibling"), "anchor", "sibling").where("anchor <> sibling")
    near = lambda c: F.desc(F.round(F.col(c) + 1e-12, 9))
    if dynamic is None:
        found, order = pairs(profile), [near("cosine")]
    else:
        ids = profile.select("anchor").union(dynamic.select("anchor")).distinct()
        both = pairs(profile).withColumnRenamed("cosine", "contribution").join(pairs(dynamic).withColumnRenamed("cosine", "dynamic"), ["anchor", "sibling"], "full")
        every = ids.join(F.broadcast(ids.withColumnRenamed("anchor", "sibling")), F.col("anchor") != F.col("sibling"))  # anchors are few: a row for each fault
        zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("contribution", "dynamic")}
        found = every.join(both, ["anchor", "sibling"], "left").withColumns(zero).withColumn("cosine", SIBLING_SHARES[0] * F.col("contribution") + SIBLING_SHARES[1] * F.col("dynamic"))
        order = [near("cosine"), near("contribution"), near("dynamic")]
    w = Window.partitionBy("anchor").orderBy(*order, "sibling")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def unique_features(profile: DataFrame, near: DataFrame, margin: float = 0.01, k: int = 2, targets: DataFrame | None = None) -> DataFrame:
    """The features in which an anchor leads all its siblings by the margin, at most k: its direct targets first, then the widest lead.

    targets: anchor, feature. An anchor without siblings has none.
    """
    best = near.select("anchor", "sibling").join(profile.select(F.col("anchor").alias("sibling"), "feature", F.col("value").alias("v")), "sibling").groupBy("anchor", "feature").agg(F.max("v").alias("rival"))
    alone = near.select("anchor").distinct()
    led = profile.join(alone, "anchor", "left_semi").join(best, ["anchor", "feature"], "left")
    led = led.withColumn("lead", F.round(F.col("value") - F.coalesce("rival", F.lit(0.0)) + 1e-12, 9))
    direct = F.lit(0)
    if targets is not None:
        led = led.join(targets.select("anchor", "feature").distinct().withColumn("_t", F.lit(1)), ["anchor", "feature"], "left")
        direct = F.coalesce("_t", F.lit(0))
    led = led.withColumn("direct", direct)
    w = Window.partitionBy("anchor").orderBy(F.desc("direct"), F.desc("lead"), F.desc(F.round("value", 9)), "feature")
    return led.where(F.col("lead") >= margin).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def contribution_weight(kind: Column, role: Column) -> Column:
    """Variables count by their role, everything else whole."""
    out = F.lit(OTHER_ROLE)
    for name, weight in ROLE_WEIGHT.items():
        out = F.when(F.trim(role) == name, F.lit(weight)).otherwise(out)
    return F.when(kind == "Variable", out).otherwise(F.lit(1.0))


def signature_coverage(observed: DataFrame, signature: DataFrame, by: str) -> DataFrame:
    """by, anchor, coverage: the share of a signature that is observed with the same sign. observed: by, feature, value; signature: anchor, feature, value."""
    size = signature.groupBy("anchor").agg(F.sum(F.abs("value")).alias("size"))
    both = observed.withColumnRenamed("value", "o").join(signature.withColumnRenamed("value", "s"), "feature").where("o * s > 0")
    met = both.groupBy(by, "anchor").agg(F.sum(F.least(F.abs("o"), F.abs("s"))).alias("met"))
    return met.join(size, "anchor").select(by, "anchor", F.when(F.col("size") > 0, F.col("met") / F.col("size")).otherwise(0.0).alias("coverage"))


def memory(contributions: DataFrame, dynamics: DataFrame, profiles: DataFrame) -> DataFrame:
    """case_id, anchor, contribution_alignment, dynamic_alignment, unique_alignment, memory_bonus of every case and profile that have anything in common.

    contributions, dynamics: case_id, feature, value. profiles: anchor, space (contribution, dynamic or unique), feature, value.
    """
    of = lambda space: profiles.where(F.col("space") == space).select("anchor", "feature", "value")
    c = cosine(contributions, of("contribution"), "case_id", "anchor").withColumnRenamed("cosine", "c")
    d = cosine(dynamics, of("dynamic"), "case_id", "anchor").withColumnRenamed("cosine", "d")
    u = signature_coverage(contributions, of("unique"), "case_id").withColumnRenamed("coverage", "u")
    both = c.join(d, ["case_id", "anchor"], "full").join(u, ["case_id", "anchor"], "full").select("case_id", "anchor", *[F.coalesce(x, F.lit(0.0)).alias(x) for x in "cdu"])
    bonus = CONTRIBUTION_WEIGHT * F.col("c") + DYNAMIC_WEIGHT * F.col("d") + UNIQUE_WEIGHT * F.col("u")
    return both.select("case_id", "anchor", *[F.round(x, 8).alias(n) for x, n in (("c", "contribution_alignment"), ("d", "dynamic_alignment"), ("u", "unique_alignment"))], F.round(bonus, 8).alias("memory_bonus"))


def profiles_of(contributions: DataFrame, dynamics: DataFrame, faults: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """anchor, space, feature, value: what cases of each anchor's fault have had on average, and what is the anchor's own.

    contributions, dynamics: case_id, feature, value. faults: case_id, anchor. targets: anchor, feature, its direct variables.
    """
    sizes = faults.groupBy("anchor").agg(F.countDistinct("case_id").alias("n"))
    parts = []
    for space, rows in (("contribution", contributions), ("dynamic", dynamics)):
        sums = rows.join(faults, "case_id").groupBy("anchor", "feature").agg(F.sum("value").alias("s")).where(F.abs("s") > 1e-9).join(sizes, "anchor")
        parts.append(sums.select("anchor", F.lit(space).alias("space"), "feature", F.round(F.col("s") / F.col("n"), 8).alias("value")))
    own = parts[0].select("anchor", "feature", "value")
    unique = unique_features(own, siblings(own, dynamic=parts[1].select("anchor", "feature", "value")), targets=targets)
    return parts[0].unionByName(parts[1]).unionByName(unique.select("anchor", F.lit("unique").alias("space"), "feature", "value"))


def entropy(scores: DataFrame, by: str) -> DataFrame:
    """Entropy of each group's positive scores as shares, and how many there are."""
    p = scores.where("value > 0").withColumn("p", F.col("value") / F.sum("value").over(Window.partitionBy(by)))
    return p.groupBy(by).agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"), F.count("*").alias("active"))


def coverage(scores: DataFrame, weights: DataFrame, by: str) -> DataFrame:
    """The weight of the features whose score is at least a tenth of the group's largest (and not next to nothing)."""
    top = F.max("value").over(Window.partitionBy(by))
    covered = scores.withColumn("top", top).where(F.col("value") >= F.greatest(F.lit(1e-6), 0.1 * F.col("top")))
    return covered.join(weights.select("feature", "weight"), "feature").groupBy(by).agg(F.sum("weight").alias("mass"))


def discriminator(contributions: DataFrame, diagnostic: DataFrame, by: str, k: int = 8) -> DataFrame:
    """An anchor's diagnostic features as a share of the k largest contributions, at most 1. diagnostic: anchor, feature."""
    w = Window.partitionBy(by).orderBy(F.desc("value"), "feature")
    top = contributions.where("value > 0").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    total = top.groupBy(by).agg(F.sum("value").alias("total"))
    own = contributions.join(diagnostic, "feature").groupBy(by, "anchor").agg(F.sum("value").alias("own"))
    return own.join(total, by).select(by, "anchor", F.least(F.lit(1.0), F.col("own") / F.col("total")).alias("alignment"))


def structural_score(root: Column, mass: Column, ent: Column, kind: Column, role: Column, alignment: Column) -> Column:
    """Root score less penalties for the covered mass and the entropy, which shrink for anchors and grow for actuators, plus biases and the discriminator."""
    anchor, actuator = role == "root_cause_anchor", role == "actuator"
    p1 = COVERAGE_PENALTY * F.when(anchor, 0.75).when(actuator, 1.1).otherwise(1.0)
    p2 = ENTROPY_PENALTY * F.when(anchor, 0.5).when(actuator, 1.15).otherwise(1.0)
    bias = lambda c, t: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in t.items() for x in kv]), c), F.lit(0.0))
    return root - p1 * mass - p2 * ent + bias(kind, TYPE_BIAS) + bias(role, ROLE_BIAS) + DISCRIMINATOR_WEIGHT * alignment


def seed_score(direct: Column, adjacent: Column, support: Column, anchor: Column) -> Column:
    """Where propagation from a candidate starts: its best evidence, between a floor and a cap."""
    floor = F.when(anchor, F.lit(SEED_FLOORS[0])).otherwise(F.lit(SEED_FLOORS[1]))
    return F.least(F.lit(SEED_CAP), F.greatest(floor, direct, adjacent, SUPPORT_SHARE * support))
