"""Adapters from producer records to evidence, canonical observations, and predicates on them."""

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import channel_id, clamp, normalize, text_list, text_or_null, token
from . import imaging

#: The names under which the producers of each dataset give each field, first to last.
ALIASES = {
    "mvtec": {
        "case_id": ("case_id", "sample_id", "image_id", "record_id", "id"),
        "object": ("object", "object_name", "category", "class_name", "product"),
        "anomaly_type": ("anomaly_type", "defect_type", "defect", "label", "class_label"),
        "location": ("location", "region", "surface"),
        "morphology": ("morphology", "shape", "pattern"),
        "severity": ("severity", "anomaly_score"),
        "confidence": ("confidence", "score", "pred_score", "detector_score", "anomaly_score"),
        "description": ("description", "caption"),
    },
    "tep": {
        "case_id": ("case_id", "sample_id", "record_id", "run_id", "id"),
        "object": ("object", "process_object", "process"),
        "anomaly_type": ("anomaly_type", "fault_type", "fault", "label"),
        "location": ("location", "process_unit", "unit", "process_location"),
        "morphology": ("morphology", "trend", "trend_shape", "pattern"),
        "severity": ("severity", "fault_severity", "anomaly_score"),
        "confidence": ("confidence", "score"),
        "variables": ("variables", "variable_names", "abnormal_variables", "tags", "sensors"),
        "contributions": ("variable_contributions", "contributions", "attribution", "variable_scores", "contribution_scores"),
        "description": ("description", "caption"),
    },
    "wafer": {
        "case_id": ("case_id", "sample_id", "record_id", "wafer_id", "id"),
        "object": ("object", "wafer_object", "wafer"),
        "anomaly_type": ("anomaly_type", "defect_type", "defect", "defect_class", "failure_pattern", "label"),
        "location": ("location", "wafer_location", "die_location", "zone"),
        "morphology": ("morphology", "pattern", "defect_pattern", "shape"),
        "severity": ("severity", "defect_severity", "anomaly_score"),
        "confidence": ("confidence", "score"),
        "log_events": ("log_events", "events", "alarms", "alarm_events"),
        "variables": ("variables", "process_variables", "sensors"),
        "contributions": ("variable_contributions", "contributions", "variable_scores"),
        "description": ("description", "caption"),
    },
}
#: What stands for a missing case, object and anomaly type of each dataset, and the source it has by default.
DEFAULTS = {"mvtec": ("mvtec_unknown", "unknown", "unknown", "image"), "tep": ("tep_unknown", "process", "unknown", "time_series"), "wafer": ("wafer_unknown", "wafer", "unknown", "multimodal")}
#: Columns that make up the time window of a case.
WINDOW_FIELDS = ("window", "window_start", "window_end", "sample_index", "timestep")
#: Facets of canonical observations in their order, and sources and keys that evidence may hold.
FACETS = ("object", "anomaly_type", "location", "morphology", "variable", "log_event", "severity", "confidence")
REASONING_FACETS = ("anomaly_type", "location", "log_event", "morphology", "object", "variable")
SOURCES = ("image", "time_series", "log", "multimodal", "unknown")
FORBIDDEN = ("root_cause", "root_causes", "candidate_root_cause", "candidate_root_causes", "ranked_causes", "ranked_root_causes", "top_k_paths", "kg_analysis")


def first_of(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the columns that the records have and that is not null, as text."""
    found = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def first_list(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the list columns that is not null, its blank elements left out; text is divided at commas."""
    found = [F.col(n) if df.schema[n].dataType.typeName() == "array" else text_list(F.col(n), ",") for n in names if n in df.columns]
    first = F.coalesce(*found) if found else F.lit(None).cast("array<string>")
    none = F.array().cast("array<string>")
    return F.coalesce(F.filter(F.transform(first, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), none)


def contributions_of(df: DataFrame, names: tuple[str, ...], variables: Column) -> Column:
    """The first of the map columns that is not null; a list of numbers goes by the variables' order."""
    none = F.create_map().cast("map<string,double>")
    found = []
    for n in names:
        if n in df.columns:
            kind = df.schema[n].dataType.typeName()
            one = F.col(n).cast("map<string,double>") if kind == "map" else F.map_from_entries(F.filter(F.arrays_zip(variables.alias("k"), F.col(n).cast("array<double>").alias("v")), lambda x: x["k"].isNotNull() & x["v"].isNotNull()))
            found.append(F.when(F.col(n).isNotNull(), one))
    return F.coalesce(*found, none) if found else none


def adapt(records: DataFrame, dataset: str) -> DataFrame:
    """Evidence fields of a dataset's records, whatever names its producers use.

    Geometry stands in for a missing location, shape or severity of images, a map's descriptors for those of wafers.
    valid: confidence and severity lie in the unit interval; invalid rows are kept, for quarantine.
    """
    names, has = ALIASES[dataset], set(records.columns)
    case, thing, kind, default = DEFAULTS[dataset]
    named = lambda f, otherwise=None: F.coalesce(text_or_null(first_of(records, names[f])), F.lit(otherwise)) if otherwise else text_or_null(first_of(records, names[f]))
    number = {f: F.nullif(first_of(records, names[f]), F.lit("")).try_cast("double") for f in ("severity", "confidence")}
    location, morphology = named("location"), named("morphology")
    if dataset == "mvtec" and {"centroid_x", "centroid_y"} <= has:
        location = F.coalesce(location, imaging.mask_location(F.col("centroid_x"), F.col("centroid_y")))
    if dataset == "mvtec" and {"eccentricity", "aspect_ratio", "component_count", "area_ratio"} <= has:
        morphology = F.coalesce(morphology, imaging.mask_morphology(*[F.col(c) for c in ("eccentricity", "aspect_ratio", "component_count", "area_ratio")]))
        number["severity"] = F.coalesce(number["severity"], clamp(F.col("area_ratio")))
    if dataset == "wafer" and {"density", "x_norm", "y_norm", "components"} <= has:
        pattern = imaging.canonical_pattern(first_of(records, names["anomaly_type"]))
        location = F.coalesce(location, imaging.wafer_location(pattern, F.col("density"), F.col("x_norm"), F.col("y_norm")))
        morphology = F.coalesce(morphology, imaging.wafer_morphology(pattern, F.col("density"), F.col("components")))
    source = F.trim(F.col("source")) if "source" in has else F.lit(None).cast("string")
    unit = lambda c: c.isNull() | c.between(0, 1)
    variables = first_list(records, names.get("variables", ()))
    window = [F.col(c).cast("string").alias(c) for c in WINDOW_FIELDS if c in has]
    return records.select(
        named("case_id", case).alias("case_id"),
        F.lit(dataset).alias("dataset"),
        F.when(source.isin(*SOURCES), source).otherwise(F.lit(default)).alias("source"),
        named("object", thing).alias("object"),
        named("anomaly_type", kind).alias("anomaly_type"),
        location.alias("location"),
        morphology.alias("morphology"),
        *[c.alias(f) for f, c in number.items()],
        variables.alias("variables"),
        contributions_of(records, names.get("contributions", ()), variables).alias("variable_contributions"),
        first_list(records, names.get("log_events", ())).alias("log_events"),
        named("description").alias("description"),
        (F.when(F.coalesce(*window).isNotNull(), F.to_json(F.struct(*window))) if dataset == "tep" and window else F.lit(None).cast("string")).alias("time_window"),
        (unit(number["severity"]) & unit(number["confidence"])).alias("valid"),
    )


_OBSERVATION = "struct<facet:string,name:string,value:double,value_type:string,rank:int,raw_ref:string,timed:boolean>"


def observations(evidence: DataFrame) -> DataFrame:
    """case_id, ord, facet, name, obs_id, value, value_type, rank, confidence, raw_ref, time_window of every observation.

    evidence: what `adapt` gives, or case_id and some of its fields. A variable's value is its contribution, its rank
    its place; severity and confidence are observed by their values. A repeated (facet, name) gets a numbered id.
    """
    has = set(evidence.columns)
    none = F.array().cast(f"array<{_OBSERVATION}>")

    def one(facet, name, value=None, value_type=None, rank=None, ref=None, timed=False):
        fields = (F.lit(facet), name, value if value is not None else F.lit(None), value_type if value_type is not None else F.lit(None), rank if rank is not None else F.lit(None), ref if ref is not None else F.lit(facet), F.lit(timed))
        return F.struct(*[c.alias(n) for c, n in zip(fields, ("facet", "name", "value", "value_type", "rank", "raw_ref", "timed"))]).cast(_OBSERVATION)

    def listed(column, facet):
        def each(x, i):
            value = F.col("variable_contributions")[x] if facet == "variable" and "variable_contributions" in has else F.lit(None).cast("double")
            return one(facet, x, value, F.when(value.isNotNull(), "contribution"), i + 1, F.concat(F.lit(f"raw_evidence.{column}["), i.cast("string"), F.lit("]")), facet == "variable")

        return F.coalesce(F.transform(F.col(column), each), none)

    parts = [F.when(F.col(f).isNotNull(), F.array(one(f, F.col(f).cast("string")))).otherwise(none) for f in FACETS[:4] if f in has]
    parts += [listed(c, f) for c, f in (("variables", "variable"), ("log_events", "log_event")) if c in has]
    for f, name in (("severity", "severity"), ("confidence", "adapter_confidence")):
        if f in has:
            parts.append(F.when(F.col(f).isNotNull(), F.array(one(f, F.lit(name), F.col(f), F.lit("float"), timed=True))).otherwise(none))
    kept = [F.col(c) if c in has else F.lit(None).cast(t).alias(c) for c, t in (("confidence", "double"), ("time_window", "string"))]
    rows = evidence.select("case_id", *kept, F.posexplode(F.concat(*parts)).alias("ord", "o"))
    rows = rows.select("case_id", "ord", *[f"o.{c}" for c in ("facet", "name", "value", "value_type", "rank", "raw_ref")], "confidence", F.when(F.col("o.timed"), F.col("time_window")).alias("time_window"))
    return with_observation_ids(rows)


def with_observation_ids(rows: DataFrame) -> DataFrame:
    """Adds obs_id: obs, case, facet and name as tokens; from the second of a name on with a number of two digits."""
    part = lambda c, otherwise: F.coalesce(F.nullif(token(F.col(c)), F.lit("")), F.lit(otherwise))
    base = F.concat_ws("_", F.lit("obs"), part("case_id", "case"), part("facet", "facet"), part("name", "unknown"))
    nth = F.row_number().over(Window.partitionBy("case_id", "facet", "name").orderBy("ord"))
    return rows.withColumn("_n", nth).withColumn("obs_id", F.concat(base, F.when(F.col("_n") > 1, F.format_string("_%02d", "_n")).otherwise(""))).drop("_n")


def missing_facets(evidence: DataFrame, observed: DataFrame) -> DataFrame:
    """case_id, missing: facets whose field a case has, but no observation of, in order."""
    needed = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in REASONING_FACETS if f in evidence.columns]))
    seen = observed.groupBy("case_id").agg(F.collect_set("facet").alias("seen"))
    missing = F.array_sort(F.array_except(needed, F.coalesce("seen", F.array().cast("array<string>"))))
    return evidence.withColumn("needed", needed).join(seen, "case_id", "left").select("case_id", missing.alias("missing"))


def mapped(names: DataFrame, mapping: DataFrame) -> DataFrame:
    """names (name) with entity: that of the mapping (channel, aliases, entity) whose channel or alias is the name, however it is written; else `variable:` and the channel that the name spells."""
    ways = F.explode(F.concat(F.array(F.struct(F.lit(0).alias("ord"), normalize(F.col("channel")).alias("key"))), F.transform("aliases", lambda a: F.struct(F.lit(1).alias("ord"), normalize(a).alias("key")))))
    table = mapping.select("entity", ways.alias("w")).groupBy(F.col("w.key").alias("_key")).agg(F.min_by("entity", F.struct("w.ord", "entity")).alias("entity"))
    spelled = F.concat(F.lit("variable:"), channel_id(F.col("name")))
    found = names.withColumn("_key", normalize(F.col("name"))).join(F.broadcast(table), "_key", "left")  # a mapping has a row for each channel of a plant
    return found.withColumn("entity", F.coalesce("entity", spelled)).drop("_key")


def scrub(properties: str, keys: tuple[str, ...] = FORBIDDEN) -> Column:
    """A map without the keys that only an analysis may set."""
    return F.map_filter(properties, lambda k, v: ~k.isin(*keys))


#: What names the fault of a record, and the maps that may hold it too.
FAULT_KEYS, CONTAINERS = ("fault_number", "fault_id"), ("extra", "metadata")


def without_faults(records: DataFrame) -> DataFrame:
    """The records without the columns that name their fault, and without those keys in their maps (maps or structs): what an analysis may see that is to find it."""
    out = records.drop(*FAULT_KEYS)
    for name in CONTAINERS:
        if name in out.columns:
            kind = out.schema[name].dataType.typeName()
            if kind == "map":
                out = out.withColumn(name, scrub(name, FAULT_KEYS))
            elif kind == "struct" and (kept := [f.name for f in out.schema[name].dataType.fields if f.name not in FAULT_KEYS]):
                out = out.withColumn(name, F.when(F.col(name).isNotNull(), F.struct(*[F.col(name)[c].alias(c) for c in kept])))
    return out


def scrub_json(c: Column, keys: tuple[str, ...] = FORBIDDEN) -> Column:
    """JSON text of any shape without those keys, at every depth; what cannot be read is null. A pandas function."""
    gone = set(keys)

    def clean(x):
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if k not in gone}
        return [clean(v) for v in x] if isinstance(x, list) else x

    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else json.dumps(clean(json.loads(t)), ensure_ascii=False, sort_keys=True)
            except ValueError:
                return None

        return texts.map(one)

    return F.pandas_udf(run, "string")(c)


def what_if(evidence: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """The evidence with fields replaced and everything derived from them cleared, to be analysed anew."""
    derived = [c for c in ("observations", "normalized", "analysis") if c in evidence.columns]
    return evidence.withColumns(changes | {c: F.lit(None).cast(evidence.schema[c].dataType) for c in derived})


def route(adapter: Column, source_dataset: Column, dataset: Column) -> Column:
    """The adapter that a record belongs to."""
    wafer_map = (adapter == "wm811k") | F.lower(source_dataset).isin("wm811k", "wm-811k")
    return F.when(wafer_map, F.lit("wm811k")).otherwise(dataset)


def anomalous(said: Column, score: Column) -> Column:
    """A verdict in words or figures, else a score of at least one half; `abnormal` is looked for before `normal`."""
    t = F.lower(F.trim(said))
    yes = t.isin("true", "1", "yes") | t.contains("abnormal") | t.contains("anomal") | t.contains("defect")
    no = t.isin("false", "0", "no") | t.contains("normal") | t.contains("good")
    number = t.try_cast("double")
    return F.when(yes, True).when(no, False).when(number.isNotNull(), number >= 0.5).otherwise(F.coalesce(score >= 0.5, F.lit(False)))
