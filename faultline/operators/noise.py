"""Noise: evidence changed in ways that are fixed by seed, case, kind and level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of noise and levels.
KINDS = ("anomaly_type_replacement", "location_replacement", "morphology_replacement", "variable_deletion", "variable_name_perturbation", "log_event_deletion", "synonym_substitution", "contradiction_injection")
LEVELS = (0.1, 0.2, 0.3)
#: What a field is replaced by, by dataset.
REPLACEMENTS = {
    "anomaly_type": {"mvtec": ("color", "crack", "contamination", "squeeze"), "tep": ("unknown_process_fault",), "wafer": ("scratch", "process_fault")},
    "location": {"mvtec": ("reactor", "wafer_surface"), "tep": ("wafer_surface", "feed disturbance"), "wafer": ("reactor", "surface")},
    "morphology": {"mvtec": ("dense_particles", "surface"), "tep": ("linear", "dense_particles"), "wafer": ("linear", "wafer_surface")},
}
#: Other names for values.
SYNONYMS = {
    "scratch": "scratch defect",
    "surface": "outer surface",
    "linear": "line-shaped",
    "process_fault": "fault",
    "reactor": "reactor unit",
    "XMEAS_1": "xmeas1",
    "nearfull": "dense wafer contamination",
    "dense_particles": "dense particles",
    "wafer_surface": "wafer surface",
    "example_alarm": "example alarm",
}
#: What contradicts the evidence of a dataset (location or morphology), and the morphology that contradicts that of any other.
CONTRADICTIONS = {"tep": ("location", "feed disturbance"), "wafer": ("morphology", "wafer_surface")}
CONTRARY = "surface"
VARIABLE_FIELDS, LOG_FIELDS = ("raw_evidence.variables", "raw_evidence.variable_contributions"), ("raw_evidence.log_events",)


def draw(seed: int, case: Column, kind: Column, level: Column, *more: Column) -> Column:
    """A number from 0 to 1 that seed, case, kind and level decide (and whatever else is given): the first 32 bits of a SHA-256."""
    key = F.concat_ws("|", F.lit(str(seed)), case.cast("string"), kind, F.format_string("%.8f", level), *[m.cast("string") for m in more])
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)


def chosen(options: Column, d: Column) -> Column:
    """One of the array, by a number from 0 to 1; null if there is none."""
    return F.when(F.size(options) > 0, F.element_at(options, (F.floor(d * F.size(options)) + 1).cast("int")))


def level_count(level: Column, size: Column) -> Column:
    """How many of so many a level takes: its share, rounded up, but at least one if there is any."""
    return F.when((size > 0) & (level > 0), F.least(size, F.greatest(F.lit(1), F.ceil(size * level).cast("int")))).otherwise(F.lit(0))


def without(values: Column, count: Column, order) -> Column:
    """The array without `count` of its values, those whose order(place) is smallest; the others keep their order."""
    tagged = F.transform(values, lambda v, i: F.struct(order(i).alias("d"), i.alias("i")))
    gone = F.transform(F.slice(F.array_sort(tagged), F.lit(1), count), lambda t: t["i"])
    return F.filter(values, lambda v, i: ~F.array_contains(gone, i))


def perturbed(name: Column) -> Column:
    """Without its first underscore, or, if it has none, marked."""
    at = F.instr(name, "_")
    return F.when(at > 0, F.concat(F.substring(name, F.lit(1), at - 1), F.substring(name, at + 1, F.length(name)))).otherwise(F.concat(name, F.lit("_perturbed")))


def _renamed(contributions: Column, old: Column, new: Column) -> Column:
    moved = F.transform(F.map_entries(contributions), lambda e: F.struct(F.when(e["key"] == old, new).otherwise(e["key"]).alias("key"), e["value"].alias("value")))
    return F.when(F.map_contains_key(contributions, old) & ~F.map_contains_key(contributions, new), F.map_from_entries(moved)).otherwise(contributions)


def _pool(table: dict[str, tuple[str, ...]]) -> Column:
    out = F.array().cast("array<string>")
    for dataset, values in table.items():
        out = F.when(F.col("dataset") == dataset, F.array(*[F.lit(v) for v in values])).otherwise(out)
    return out


def _others(values: Column, current: Column) -> Column:
    return F.filter(values, lambda v: ~v.eqNullSafe(current))


def inject(cases: DataFrame, seed: int = 42, levels: tuple[float, ...] = LEVELS, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Every case under every level and kind: level, kind, the fields after the change, corrupted (names of fields) and is_noisy.

    cases: case_id, dataset, anomaly_type, location, morphology, variables, variable_contributions, log_events, and
    others that pass through. A field is replaced by another value of its dataset's; variables and events go by the
    level's share; what a case has not, noise leaves as it is.
    """
    if set(kinds) - set(KINDS) or any(not 0 <= x <= 1 for x in levels):
        raise ValueError(f"kinds are {', '.join(sorted(KINDS))}, levels lie in the unit interval")
    grid = [F.struct(F.lit(float(x)).alias("level"), F.lit(k).alias("kind")) for x in levels for k in kinds]
    rows = cases.withColumn("_g", F.explode(F.array(*grid))).select(*cases.columns, "_g.level", "_g.kind")
    kind, level, none = F.col("kind"), F.col("level"), F.array().cast("array<string>")
    of = lambda *more: draw(seed, F.col("case_id"), kind, level, *more)
    is_kind = lambda k: kind == k
    other = {f: chosen(_others(_pool(t), F.col(f)), of()) for f, t in REPLACEMENTS.items()}
    names = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    pair = lambda f, v: F.struct(F.lit(f).alias("field"), v.alias("value"))
    said = F.concat(
        F.array(*[pair(f, F.col(f)) for f in ("anomaly_type", "location", "morphology")]),
        F.transform(F.coalesce("variables", none), lambda v: pair(VARIABLE_FIELDS[0], v)),
        F.transform(F.coalesce("log_events", none), lambda v: pair(LOG_FIELDS[0], v)),
    )
    known = F.filter(said, lambda x: x["value"].isNotNull() & F.map_contains_key(names, F.coalesce(x["value"], F.lit(""))))
    syn = F.when(is_kind("synonym_substitution"), chosen(known, of()))
    rows = rows.withColumns({"_other_" + f: c for f, c in other.items()}).withColumn("_syn", syn).withColumn("_new", F.when(F.col("_syn").isNotNull(), F.element_at(names, F.col("_syn.value"))))
    meant = F.lit(None).cast("string")
    for dataset, (f, _) in CONTRADICTIONS.items():
        needs = F.size("variables") > 0 if dataset == "tep" else F.lit(True)
        meant = F.when((F.col("dataset") == dataset) & needs, F.lit(f)).otherwise(meant)
    contrary = F.when(is_kind("contradiction_injection"), F.coalesce(meant, F.when(F.col("morphology").isNotNull(), "morphology"), F.when(F.col("_other_location").isNotNull(), "location")))
    rows = rows.withColumn("_contrary", contrary)
    against = lambda f, otherwise: F.coalesce(*[F.when((F.col("dataset") == d) & (meant == f), F.lit(v)) for d, (g, v) in CONTRADICTIONS.items() if g == f], otherwise)
    size_v, size_e = F.size(F.coalesce("variables", none)), F.size(F.coalesce("log_events", none))
    at = F.floor(of() * size_v).cast("int")
    old = F.get(F.col("variables"), at)
    changed = {
        "anomaly_type": F.when(is_kind("anomaly_type_replacement"), F.coalesce("_other_anomaly_type", "anomaly_type")).when(F.col("_syn.field") == "anomaly_type", F.col("_new")).otherwise(F.col("anomaly_type")),
        "location": F.when(is_kind("location_replacement"), F.coalesce("_other_location", "location")).when(F.col("_syn.field") == "location", F.col("_new")).when(F.col("_contrary") == "location", against("location", F.col("_other_location"))).otherwise(F.col("location")),
        "morphology": F.when(is_kind("morphology_replacement"), F.coalesce("_other_morphology", "morphology")).when(F.col("_syn.field") == "morphology", F.col("_new")).when(F.col("_contrary") == "morphology", against("morphology", F.lit(CONTRARY))).otherwise(F.col("morphology")),
        "variables": F.when(is_kind("variable_deletion"), without(F.col("variables"), level_count(level, size_v), lambda i: of(i)))
        .when(is_kind("variable_name_perturbation"), F.transform("variables", lambda v, i: F.when(i == at, perturbed(v)).otherwise(v)))
        .when(F.col("_syn.field") == VARIABLE_FIELDS[0], F.transform("variables", lambda v: F.when(v == F.col("_syn.value"), F.col("_new")).otherwise(v)))
        .otherwise(F.col("variables")),
        "log_events": F.when(is_kind("log_event_deletion"), without(F.col("log_events"), level_count(level, size_e), lambda i: of(i)))
        .when(F.col("_syn.field") == LOG_FIELDS[0], F.transform("log_events", lambda v: F.when(v == F.col("_syn.value"), F.col("_new")).otherwise(v)))
        .otherwise(F.col("log_events")),
    }
    listed = lambda *fs: F.array(*[F.lit(f) for f in fs])
    corrupted = F.when(is_kind("variable_deletion") & (size_v > 0) & (level > 0), listed(*VARIABLE_FIELDS)).when(is_kind("variable_name_perturbation") & (size_v > 0), listed(*VARIABLE_FIELDS)).when(is_kind("log_event_deletion") & (size_e > 0), listed(*LOG_FIELDS))
    for f in REPLACEMENTS:
        corrupted = corrupted.when(is_kind(f"{f}_replacement") & F.col(f"_other_{f}").isNotNull(), listed(f))
    corrupted = corrupted.when(F.col("_syn").isNotNull(), F.array(F.col("_syn.field"))).when(F.col("_contrary").isNotNull(), F.array("_contrary")).otherwise(none)
    passed = [c for c in cases.columns if c not in (*changed, "variable_contributions")]
    named = rows.select(*passed, "level", "kind", *[c.alias(f) for f, c in changed.items()], corrupted.alias("corrupted"), F.col("variable_contributions").alias("_share"), F.coalesce(old, F.lit("")).alias("_old"), "_syn", "_new")
    share, renamed = F.col("_share"), F.col("kind") == "variable_name_perturbation"
    left = F.map_filter(share, lambda k, v: F.array_contains("variables", k))
    moved = F.when(F.col("kind") == "variable_deletion", left).when(renamed, _renamed(share, F.col("_old"), perturbed(F.col("_old")))).when(F.col("_syn.field") == VARIABLE_FIELDS[0], _renamed(share, F.col("_syn.value"), F.col("_new"))).otherwise(share)
    return named.withColumn("variable_contributions", moved).drop("_share", "_old", "_syn", "_new").withColumn("is_noisy", F.size("corrupted") > 0)
