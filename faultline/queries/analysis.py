"""Queries over series, grids, anchors and propagation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import signals
from ..operators import anchors, imaging, predictors, propagation, rules, timeseries
from ..operators import kg as graph
from ..operators.lineage import cut
from ..plans import domain
from ..plans.root_causes import RootCauses
from ..plans.simple_causes import SimpleCauses
from .registry import registry
from .sql import sql

QUERIES, ORACLE_SQL, query = registry()

CHANNELS = ["value", "k"]
WINDOW, RUNS = 10, 3

_SERIES = """
  SELECT event_type AS fault, user_id AS run, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS sample, value::DOUBLE AS value,
         CAST(json_extract(props, '$.k') AS DOUBLE) AS k, event_id, ts FROM events"""
_WINDOWS = f"""
  SELECT s.*, place FROM series s JOIN (SELECT * FROM (SELECT fault, run, row_number() OVER (PARTITION BY fault ORDER BY done, run) AS place
    FROM (SELECT fault, run, max(event_id) AS done, count(*) AS c FROM series WHERE sample <= {WINDOW} GROUP BY ALL) WHERE c = {WINDOW}) WHERE place <= {RUNS}) USING (fault, run) WHERE sample <= {WINDOW}"""
_LONG = " SELECT fault, run, sample, 'value' AS channel, value AS v FROM series UNION ALL SELECT fault, run, sample, 'k', k FROM series WHERE k IS NOT NULL"
_PROFILE = " SELECT channel, avg(v) AS mean, CASE WHEN stddev_samp(v) > 1e-12 THEN stddev_samp(v) ELSE 1.0 END AS scale FROM long WHERE fault = 'view' GROUP BY channel"
_Z = " SELECT w.fault, w.run, w.sample, l.channel, (l.v - p.mean) / p.scale AS z FROM windows w JOIN long l USING (fault, run, sample) JOIN profile p USING (channel)"
_TS = dict(series=_SERIES, windows=_WINDOWS, long=_LONG, profile=_PROFILE, z=_Z)


def _series(spark, d):
    return domain.series(spark, d).withColumn("seq", F.col("event_id"))


def _z(spark, d):
    s = _series(spark, d)
    fitted = timeseries.profile(timeseries.long(s.where("fault = 'view'").select("fault", "run", "sample", *CHANNELS), CHANNELS))
    wins = timeseries.windows(s, WINDOW, RUNS).select("fault", "run", "sample", *CHANNELS)
    return timeseries.standardize(timeseries.long(wins, CHANNELS), fitted)


@query(sql("SELECT fault, run, sample, event_id, place FROM windows", series=_SERIES, windows=_WINDOWS))
def ts_windows(spark, d):
    return timeseries.windows(_series(spark, d), WINDOW, RUNS).select("fault", "run", F.col("sample").cast("long").alias("sample"), "event_id", "place")


@query(sql("SELECT run, event_id FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS nth FROM series WHERE fault = 'view') WHERE (nth - 1) % 4 = 0", series=_SERIES))
def ts_stride(spark, d):
    return timeseries.stride(_series(spark, d).where("fault = 'view'"), 4).select("run", "event_id")


@query(sql("SELECT channel, round(mean, 6) AS mean, round(scale, 6) AS scale FROM profile", series=_SERIES, long=_LONG, profile=_PROFILE))
def ts_profile(spark, d):
    s = _series(spark, d).where("fault = 'view'").select("fault", "run", "sample", *CHANNELS)
    return timeseries.profile(timeseries.long(s, CHANNELS)).select("channel", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


@query(sql("SELECT 'value' AS a, 'k' AS b, round(covar_samp(value, k), 4) AS covariance FROM series WHERE fault = 'view' UNION ALL SELECT 'value', 'value', round(var_samp(value), 4) FROM series WHERE fault = 'view' UNION ALL SELECT 'k', 'k', round(var_samp(k), 4) FROM series WHERE fault = 'view'", series=_SERIES))
def ts_covariance(spark, d):
    return timeseries.covariance(_series(spark, d).where("fault = 'view'"), CHANNELS).withColumn("covariance", F.round("covariance", 4))


@query(
    sql(
        """SELECT fault, run, channel, round(sq / sum(sq) OVER (PARTITION BY fault, run), 6) AS share, round(sum(sq) OVER (PARTITION BY fault, run), 6) AS energy
        FROM (SELECT fault, run, channel, avg(z * z) AS sq FROM z GROUP BY ALL)""",
        **_TS,
    )
)
def ts_zscore_contribution(spark, d):
    c = timeseries.contributions(_z(spark, d), ["fault", "run"])
    return c.select("fault", "run", "channel", F.round("share", 6).alias("share"), F.round("energy", 6).alias("energy"))


@query(
    sql(
        """SELECT fault, run, unnest(['value', 'k']) AS channel, 0.5::DOUBLE AS share, round(energy, 6) AS energy FROM (
          SELECT a.fault, a.run, 2 * avg((a.z - s * b.z) / 2 * (a.z - s * b.z) / 2) AS energy FROM z a JOIN z b USING (fault, run, sample), (SELECT sign(corr(value, k)) AS s FROM series WHERE fault = 'view') WHERE a.channel = 'value' AND b.channel = 'k' GROUP BY ALL)""",
        **_TS,
    )
)
def ts_pca_contribution(spark, d):
    """Residuals from the first axis, which of two standardized channels is the diagonal on which they go together."""
    s = _series(spark, d)
    axes = timeseries.principal_axes(s.where("fault = 'view'"), CHANNELS, 1)
    z = _z(spark, d).groupBy("fault", "run", "sample").pivot("channel", CHANNELS).agg(F.first("z"))
    left = timeseries.residual(z, CHANNELS, axes)
    c = timeseries.contributions(timeseries.long(left, CHANNELS).withColumnRenamed("value", "z"), ["fault", "run"])
    return c.select("fault", "run", "channel", F.round("share", 6).alias("share"), F.round("energy", 6).alias("energy"))


_FEATURES = """
  SELECT fault, run, channel, unnest(['mean', 'slope', 'osc', 'std']) AS statistic, round(unnest([mean, slope, osc, std]) + 1e-12, 6) AS value FROM (
    SELECT fault, run, channel, avg(z) AS mean, (arg_max(z, sample) - arg_min(z, sample)) / greatest(1, count(*) - 1) AS slope, coalesce(avg(step), 0.0) AS osc, stddev_pop(z) AS std
    FROM (SELECT *, abs(z - lag(z) OVER (PARTITION BY fault, run, channel ORDER BY sample)) AS step FROM z) GROUP BY ALL)"""


@query(sql("SELECT * FROM features", **_TS, features=_FEATURES))
def ts_dynamic_features(spark, d):
    return timeseries.dynamic_features(_z(spark, d), ["fault", "run"])


@query(
    sql(
        """SELECT fault, run, feature_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY fault, run ORDER BY abs(value) DESC, feature_id) AS rank
        FROM (SELECT fault, run, channel || '__' || statistic AS feature_id, value FROM features WHERE abs(value) > 1e-9)) WHERE rank <= 6""",
        **_TS,
        features=_FEATURES,
    )
)
def ts_top_features(spark, d):
    return timeseries.top_features(timeseries.dynamic_features(_z(spark, d), ["fault", "run"]), ["fault", "run"]).select("fault", "run", "feature_id", "value", "rank")


@query(
    sql(
        """SELECT event_id, round(greatest(0, least(1, (value - 20) / 30)), 8) AS high, round(greatest(0, least(1, (20 - value) / 10)), 8) AS low, round(greatest(0, least(1, 1 - abs(value - 30) / 10)), 8) AS middle,
        round(greatest(0, least(1, (abs(value - 50) - 10) / 20)), 8) AS far FROM events"""
    )
)
def bounded_signals(spark, d):
    v = F.col("value").cast("double")
    return domain.table(spark, d, "events").select("event_id", signals.excess(v, 20.0, 30.0).alias("high"), signals.shortfall(v, 20.0, 10.0).alias("low"), signals.band(v, 20.0, 40.0).alias("middle"), signals.abs_excess(v - 50, 10.0, 20.0).alias("far"))


_GRID = " SELECT l_suppkey AS grid_id, l_linenumber AS row, l_quantity::INT % 7 AS col, max(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END) AS value FROM lineitem GROUP BY ALL"


@query(
    sql(
        """SELECT grid_id, area::BIGINT AS area, x1, x2, y1, y2, round(area / pixels, 6) AS area_ratio, round(cx, 6) AS cx, round(cy, 6) AS cy FROM (
        SELECT grid_id, sum((value > 0)::INT) AS area, min(col) FILTER (value > 0) AS x1, max(col) FILTER (value > 0) + 1 AS x2, min(row) FILTER (value > 0) AS y1, max(row) FILTER (value > 0) + 1 AS y2,
        avg(col) FILTER (value > 0) AS cx, avg(row) FILTER (value > 0) AS cy, (max(row) + 1) * (max(col) + 1) AS pixels FROM grid GROUP BY grid_id)""",
        grid=_GRID,
    )
)
def mask_stats(spark, d):
    s = imaging.mask_stats(domain.grid(spark, d))
    return s.select("grid_id", "area", "x1", "x2", "y1", "y2", *[F.round(c, 6).alias(c) for c in ("area_ratio", "cx", "cy")])


@query(
    sql(
        """SELECT grid_id, die_count, failed_count, round(CASE WHEN die_count > 0 THEN failed_count / die_count ELSE 0 END, 6) AS density,
        round(CASE WHEN w > 0 THEN cx / w ELSE 0.5 END, 6) AS x_norm, round(CASE WHEN h > 0 THEN cy / h ELSE 0.5 END, 6) AS y_norm FROM (
        SELECT grid_id, sum((value > 0)::INT)::BIGINT AS die_count, sum(failed::INT)::BIGINT AS failed_count, avg(col) FILTER (failed) AS cx, avg(row) FILTER (failed) AS cy, max(row) AS h, max(col) AS w
        FROM (SELECT *, CASE WHEN max(value) OVER (PARTITION BY grid_id) > 1 THEN value > 1 ELSE value > 0 END AS failed FROM grid) GROUP BY grid_id)""",
        grid=_GRID,
    )
)
def wafer_descriptors(spark, d):
    w = imaging.wafer_descriptors(domain.grid(spark, d))
    return w.select("grid_id", "die_count", "failed_count", *[F.round(c, 6).alias(c) for c in ("density", "x_norm", "y_norm")])


@query(
    sql(
        """SELECT grid_id, round(coalesce(sum((value > 0 AND value > 1)::INT) / nullif(sum((value > 0)::INT), 0), 1.0), 6) AS iou FROM grid GROUP BY grid_id""",
        grid=_GRID,
    )
)
def grid_iou(spark, d):
    g = domain.grid(spark, d)
    return imaging.iou(g, g.withColumn("value", F.col("value") - 1)).select("grid_id", F.round("iou", 6).alias("iou"))


@query(sql("SELECT grid_id, CASE WHEN avg((value >= 2)::INT) < 0.85 THEN 0 ELSE count(*) FILTER (value >= 2) END AS cells FROM grid GROUP BY grid_id", grid=_GRID))
def threshold_masks(spark, d):
    """Masks of maps from a threshold on, without those that cover too little."""
    return imaging.threshold_masks(domain.grid(spark, d), 2, 0.85).groupBy("grid_id").agg(F.sum("value").alias("cells"))


class HalfMap:
    """Stands for a model: half of each cell's value as its anomaly score, the largest as the map's."""

    def predict(self, batch):
        import pyarrow as pa

        maps = [[[x / 2 for x in row] for row in m] for m in batch.column("map").to_pylist()]
        return pa.RecordBatch.from_pydict({"score": pa.array([max((max(r, default=0.0) for r in m), default=0.0) for m in maps], pa.float64()), "map": pa.array(maps, pa.list_(pa.list_(pa.float64())))})


@query(sql("SELECT grid_id, max(value) / 2.0 AS score, count(*) FILTER (value = 2) AS cells, count(*) FILTER (value = 2) > 0 AS found FROM grid GROUP BY grid_id", grid=_GRID))
def predicted_masks(spark, d):
    """Maps through a predictor, and the cells that it marks."""
    said = predictors.predict(predictors.nested(domain.grid(spark, d)), HalfMap, "score double, map array<array<double>>", keep=("grid_id",), cells=500)
    marked = predictors.cells(said).groupBy("grid_id").agg(F.count(F.when(F.col("value") >= 1.0, 1)).alias("cells"))
    return said.select("grid_id", "score").join(marked, "grid_id").withColumn("found", F.col("cells") > 0)


@query(
    sql(
        """SELECT grid_id, count(DISTINCT root) AS components FROM (SELECT grid_id, a, min(b) AS root FROM reach GROUP BY ALL) GROUP BY grid_id""",
        grid=_GRID,
        cell=" SELECT grid_id, row, col, row * 100 + col AS c FROM grid WHERE value > 0",
        reach=""" SELECT grid_id, c AS a, c AS b FROM cell UNION SELECT r.grid_id, r.a, n.c FROM reach r JOIN cell m ON m.grid_id = r.grid_id AND m.c = r.b
          JOIN cell n ON n.grid_id = m.grid_id AND abs(n.row - m.row) + abs(n.col - m.col) = 1""",
    )
)
def grid_components(spark, d):
    return imaging.components(domain.grid(spark, d))


@query(
    sql(
        """SELECT lang, threshold, f1 FROM (SELECT lang, score AS threshold, f1, row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, score DESC) AS rn FROM (
          SELECT lang, score, round(2 * tp / (predicted + all_p), 9) AS f1 FROM (
            SELECT lang, score, sum(p) OVER down AS tp, sum(n) OVER down AS predicted, sum(p) OVER (PARTITION BY lang) AS all_p, sum(n) OVER (PARTITION BY lang) AS all_n
            FROM (SELECT lang, n_chars AS score, sum(quality) AS p, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL) WINDOW down AS (PARTITION BY lang ORDER BY score DESC))
          WHERE all_p > 0 AND all_p < all_n)) WHERE rn = 1"""
    )
)
def calibrate_thresholds(spark, d):
    rows = domain.table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").alias("score")).join(domain.table(spark, d, "labels"), "doc_id")
    return imaging.best_thresholds(rows.select("lang", "score", F.col("quality").alias("positive")), "lang")


_ANCHORS = " SELECT vec_id, label AS anchor, generate_subscripts(embedding, 1) - 1 AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings"
_CENTROIDS = " SELECT anchor, feature, sum(value) / any_value(n) AS value FROM anchors JOIN (SELECT label AS anchor, count(*) AS n FROM embeddings GROUP BY label) USING (anchor) GROUP BY anchor, feature"
_COSINES = """ SELECT a.anchor, b.anchor AS sibling, sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value)) AS cosine FROM centroids a JOIN centroids b USING (feature) WHERE a.anchor <> b.anchor GROUP BY ALL"""
_SIBLINGS = " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY round(cosine + 1e-12, 9) DESC, sibling) AS rank FROM cosines) WHERE rank <= 4"
_ANC = dict(anchors=_ANCHORS, centroids=_CENTROIDS, cosines=_COSINES, siblings=_SIBLINGS)


def _profile(spark, d):
    return anchors.centroids(domain.anchors(spark, d))


@query(sql("SELECT anchor, feature::INT AS feature, round(value + 1e-12, 6) AS value FROM centroids", anchors=_ANCHORS, centroids=_CENTROIDS))
def anchor_centroids(spark, d):
    return _profile(spark, d).withColumn("value", F.round(F.col("value") + 1e-12, 6))


@query(sql("SELECT anchor, sibling, rank, round(cosine + 1e-12, 6) AS cosine FROM siblings", **_ANC))
def anchor_similarity(spark, d):
    s = anchors.siblings(_profile(spark, d))
    return s.select("anchor", "sibling", "rank", F.round(F.col("cosine") + 1e-12, 6).alias("cosine"))


@query(
    sql(
        """SELECT anchor, feature::INT AS feature, round(lead, 6) AS lead, rank FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY lead DESC, round(value, 9) DESC, feature) AS rank FROM (
          SELECT c.anchor, c.feature, c.value, round(c.value - coalesce(rival, 0.0) + 1e-12, 9) AS lead FROM centroids c LEFT JOIN
          (SELECT s.anchor, c2.feature, max(c2.value) AS rival FROM siblings s JOIN centroids c2 ON c2.anchor = s.sibling GROUP BY ALL) USING (anchor, feature)) WHERE lead >= 0.01) WHERE rank <= 2""",
        **_ANC,
    )
)
def anchor_unique(spark, d):
    p = _profile(spark, d)
    return anchors.unique_features(p, anchors.siblings(p)).select("anchor", "feature", F.round("lead", 6).alias("lead"), "rank")


@query(sql("SELECT vec_id, b.anchor, round(sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value)) + 1e-12, 6) AS alignment FROM anchors a JOIN centroids b USING (feature) GROUP BY vec_id, b.anchor", anchors=_ANCHORS, centroids=_CENTROIDS))
def anchor_alignment(spark, d):
    rows = domain.anchors(spark, d)
    c = anchors.cosine(rows.select("vec_id", "feature", "value"), anchors.centroids(rows), "vec_id", "anchor")
    return c.select("vec_id", "anchor", F.round(F.col("cosine") + 1e-12, 6).alias("alignment"))


@query(sql("SELECT vec_id, round(-sum(p * ln(p)) + 1e-12, 6) AS entropy, count(*) AS active FROM (SELECT vec_id, value / sum(value) OVER (PARTITION BY vec_id) AS p FROM anchors WHERE value > 0) GROUP BY vec_id", anchors=_ANCHORS))
def ranking_entropy(spark, d):
    e = anchors.entropy(domain.anchors(spark, d), "vec_id")
    return e.select("vec_id", F.round(F.col("entropy") + 1e-12, 6).alias("entropy"), "active")


@query(sql("SELECT vec_id, sum(1.0 + feature % 3)::DOUBLE AS mass FROM (SELECT *, max(value) OVER (PARTITION BY vec_id) AS top FROM anchors) WHERE value >= greatest(1e-6, 0.1 * top) GROUP BY vec_id", anchors=_ANCHORS))
def coverage_mass(spark, d):
    rows = domain.anchors(spark, d)
    weights = spark.range(64).select(F.col("id").cast("int").alias("feature"), (1.0 + F.col("id") % 3).cast("double").alias("weight"))
    return anchors.coverage(rows, weights, "vec_id")


@query(
    sql(
        """SELECT vec_id, d.anchor, round(least(1.0, sum(value) / any_value(total)) + 1e-12, 6) AS alignment FROM anchors JOIN (SELECT vec_id, sum(value) AS total FROM (
          SELECT vec_id, value, row_number() OVER (PARTITION BY vec_id ORDER BY value DESC, feature) AS n FROM anchors WHERE value > 0) WHERE n <= 8 GROUP BY vec_id) USING (vec_id) JOIN
          (SELECT unnest(range(0, 64)) AS feature, unnest(range(0, 64)) % 10 AS anchor) d USING (feature) GROUP BY vec_id, d.anchor""",
        anchors=_ANCHORS,
    )
)
def discriminator(spark, d):
    diagnostic = spark.range(64).select(F.col("id").cast("int").alias("feature"), (F.col("id") % 10).alias("anchor"))
    out = anchors.discriminator(domain.anchors(spark, d).select("vec_id", "feature", "value"), diagnostic, "vec_id")
    return out.select("vec_id", "anchor", F.round(F.col("alignment") + 1e-12, 6).alias("alignment"))


@query(
    sql(
        """SELECT s_suppkey, round(s_acctbal / 10000 - 0.12 * CASE r WHEN 0 THEN 0.75 WHEN 1 THEN 1.1 ELSE 1.0 END * (s_nationkey / 25) - 0.03 * CASE r WHEN 0 THEN 0.5 WHEN 1 THEN 1.15 ELSE 1.0 END * (s_suppkey % 5)
          + CASE t WHEN 0 THEN 0.06 WHEN 1 THEN -0.03 ELSE 0.0 END + CASE r WHEN 0 THEN 0.10 WHEN 1 THEN -0.03 ELSE -0.20 END + 0.28 * (s_suppkey % 7) / 7 + 1e-12, 6) AS score,
        round(least(0.35, greatest(CASE WHEN r = 0 THEN 0.18 ELSE 0.12 END, s_acctbal / 40000, s_nationkey / 100, 0.9 * (s_suppkey % 4) / 10)) + 1e-12, 6) AS seed
        FROM (SELECT *, s_suppkey % 3 AS r, s_nationkey % 3 AS t FROM supplier)"""
    )
)
def structural_score(spark, d):
    s = domain.table(spark, d, "supplier")
    role = F.when(F.col("s_suppkey") % 3 == 0, "root_cause_anchor").when(F.col("s_suppkey") % 3 == 1, "actuator").otherwise("support_only")
    kind = F.when(F.col("s_nationkey") % 3 == 0, "FaultAnchor").when(F.col("s_nationkey") % 3 == 1, "Stream").otherwise("Variable")
    score = anchors.structural_score(F.col("s_acctbal") / 10000, F.col("s_nationkey") / 25, (F.col("s_suppkey") % 5).cast("double"), kind, role, F.col("s_suppkey") % 7 / 7)
    seed = anchors.seed_score(F.col("s_acctbal") / 40000, F.col("s_nationkey") / 100, F.col("s_suppkey") % 4 / 10, role == "root_cause_anchor")
    return s.select("s_suppkey", F.round(score + 1e-12, 6).alias("score"), F.round(seed + 1e-12, 6).alias("seed"))


_FAMILY_OF = {"OCCURS_ON": "MATERIAL_FLOW", "HAS_LOCATION": "CONTROL", "BELONGS_TO_UNIT": "FAULT_SOURCE", "PART_OF": "OBSERVATION"}


@query(
    sql(
        """SELECT edge_id, round(1 / (1 + exp(-(CASE relation WHEN 'OCCURS_ON' THEN 1.05 WHEN 'HAS_LOCATION' THEN 1.35 WHEN 'BELONGS_TO_UNIT' THEN 1.65 WHEN 'PART_OF' THEN 0.35 ELSE 0.0 END + 1.2 * (confidence - 0.5) + 0.75 * (least(1.0, ln(1 + support) / ln(9)) - 0.5)
        + 0.45 * (CASE WHEN source = 'lineitem' THEN 1.0 WHEN source = 'nation' THEN 0.75 ELSE 0.55 END - 0.5) + 0.3 * (CASE WHEN scenario = 'shared' THEN 1.0 ELSE 0.7 END - 0.5) + 0.45 * ((0.5 + confidence) / 2 - 0.5)))) + 0.0, 6) AS weight FROM edges""",
        "edges",
    )
)
def edge_weight_logit(spark, d):
    """Relations as families; causes are of no family and have no prior."""
    family = F.lit("NONE")
    for relation, name in _FAMILY_OF.items():
        family = F.when(F.col("relation") == relation, F.lit(name)).otherwise(family)
    sources = F.when(F.col("source") == "nation", 2).otherwise(1)
    w = signals.edge_weight(family, F.col("confidence"), F.col("support").cast("double"), F.col("source") == "lineitem", sources, F.col("scenario") == "shared", F.lit(None).cast("double"), F.col("confidence"))
    return domain.kg_edges(spark, d).select("edge_id", w.alias("weight"))


def _plant(spark, d):
    """The shared part of the graph with the suppliers, as a propagation graph."""
    e = domain.kg_edges(spark, d).where("relation in ('BELONGS_TO_UNIT', 'PART_OF', 'HAS_PLAUSIBLE_CAUSE')")
    family = F.when(F.col("relation") == "BELONGS_TO_UNIT", "MATERIAL_FLOW").when(F.col("relation") == "PART_OF", "OBSERVATION").otherwise("ENERGY_TRANSFER")
    return e.select("head", "tail", "edge_id", family.alias("family"), F.col("confidence").alias("weight"))


_PLANT = " SELECT head, tail, edge_id, confidence AS weight FROM edges WHERE relation IN ('BELONGS_TO_UNIT', 'PART_OF', 'HAS_PLAUSIBLE_CAUSE')"
_SIGNAL = " SELECT id, CASE label WHEN 'RootCause' THEN 0.8 ELSE 0.5 END::DOUBLE AS signal FROM nodes WHERE label IN ('RootCause', 'Location')"


@query(
    sql(
        """SELECT id, target, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY value DESC, target) AS rank FROM (
          SELECT w.id, w.node AS target, round(max(strength) * any_value(signal) + 1e-12, 8) AS value FROM walked w JOIN signal s ON s.id = w.node GROUP BY w.id, w.node)) WHERE rank <= 4""",
        "edges",
        "nodes",
        plant=_PLANT,
        signal=_SIGNAL,
        h1=" SELECT s.head AS id, s.tail AS node, s.weight * 0.92 AS strength FROM plant s WHERE s.head LIKE 'S%'",
        h2=" SELECT h.id, p.tail AS node, max(h.strength * p.weight * 0.92) AS strength FROM h1 h JOIN plant p ON p.head = h.node GROUP BY ALL",
        h3=" SELECT h.id, p.tail AS node, max(h.strength * p.weight * 0.92) AS strength FROM h2 h JOIN plant p ON p.head = h.node GROUP BY ALL",
        walked=" SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3",
    )
)
def downstream_signal(spark, d):
    nodes = domain.kg_nodes(spark, d)
    signal = nodes.where("label in ('RootCause', 'Location')").select("id", F.when(F.col("label") == "RootCause", 0.8).otherwise(0.5).alias("signal"))
    starts = nodes.where("label = 'Object'").select("id")
    return propagation.downstream(starts, _plant(spark, d), signal).withColumnRenamed("at", "target")


def _flow(spark, d):
    """Regions give to nations, suppliers to nations and nations to segments: the graph along which scores are spread."""
    e = domain.kg_edges(spark, d)
    back = e.where("relation = 'PART_OF'").select(F.col("tail").alias("head"), F.col("head").alias("tail"), "edge_id", F.lit("FAULT_SOURCE").alias("family"), F.col("confidence").alias("weight"))
    return back.unionByName(_plant(spark, d).where("head not like 'N%' or tail like 'M%'"))


_FLOW = """ SELECT tail AS head, head AS tail, edge_id, confidence AS weight, 0.10 AS sigma FROM edges WHERE relation = 'PART_OF'
  UNION ALL SELECT head, tail, edge_id, confidence, CASE relation WHEN 'BELONGS_TO_UNIT' THEN 0.20 ELSE 0.26 END FROM edges WHERE relation IN ('BELONGS_TO_UNIT', 'HAS_PLAUSIBLE_CAUSE')"""


def _sources(spark, d):
    s = domain.table(spark, d, "supplier")
    seed = F.least(F.lit(0.35), F.greatest(F.lit(0.12), F.col("s_acctbal") / 10000))
    own = s.select(F.concat(F.lit("case_"), F.col("s_suppkey")).alias("case_id"), F.concat(F.lit("S"), F.col("s_suppkey")).alias("source"), seed.alias("seed"))
    return own.union(domain.table(spark, d, "region").select(F.lit("case_r"), F.concat(F.lit("R"), F.col("r_regionkey")), F.lit(0.35)))


@query(
    sql(
        """SELECT case_id, source, node, round(round(score, 8) + 1e-12, 6) AS score, path FROM (
          SELECT case_id, source, source AS node, seed AS score, '' AS path FROM src UNION ALL SELECT case_id, source, node, score, edge_id FROM h1
          UNION ALL SELECT case_id, source, node, sum(amount), arg_max(e1 || '>' || e2, (amount, -rn)) FROM h2 GROUP BY ALL)""",
        "edges",
        flow=_FLOW,
        src=""" SELECT 'case_' || s_suppkey AS case_id, 'S' || s_suppkey AS source, least(0.35, greatest(0.12, s_acctbal / 10000)) AS seed FROM supplier UNION ALL SELECT 'case_r', 'R' || r_regionkey, 0.35 FROM region""",
        h1=" SELECT case_id, source, tail AS node, edge_id, seed * weight * exp(-sigma) AS score FROM src JOIN flow ON head = source",
        h2=""" SELECT case_id, source, f.tail AS node, h.edge_id AS e1, f.edge_id AS e2, h.score * f.weight * exp(-2 * f.sigma) / row_number() OVER w AS amount, row_number() OVER w AS rn
          FROM h1 h JOIN flow f ON f.head = h.node WINDOW w AS (PARTITION BY case_id, source, f.tail ORDER BY h.node, f.edge_id)""",
    )
)
def propagation_scores(spark, d):
    """A segment takes in what all the nations of a region give, each less than the one before; a plain model tests the caps."""
    out = propagation.propagate(_sources(spark, d), _flow(spark, d))
    return out.withColumn("score", F.round(F.col("score") + 1e-12, 6))


def _market(spark, d):
    """Nations as anchors of faults, regions and segments as variables, suppliers' sales by segment and region as contributions."""
    nodes = domain.kg_nodes(spark, d).where("id like 'N%' or id like 'R%' or id like 'M%'")
    nation = F.col("id").startswith("N")
    none = F.array().cast("array<string>")
    nodes = nodes.select(
        "id", "name", F.when(nation, "FaultAnchor").otherwise("Variable").alias("type"), F.when(nation, "root_cause_anchor").otherwise("").alias("role"), nation.alias("candidate"),
        F.when(F.col("id").startswith("R"), "actuator").when(F.col("id") == "MBUILDING", "other").otherwise("sensor").alias("variable_role"), none.alias("targets"), F.array("id").alias("provenance"),
    )
    edges = _plant(spark, d).where("head like 'N%'").withColumn("provenance", F.array(F.col("head")))
    lines = domain.table(spark, d, "lineitem").join(domain.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(domain.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(domain.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    sold = lambda key: lines.groupBy(F.col("l_suppkey").cast("string").alias("case_id"), key.alias("id")).agg(F.sum("l_quantity").alias("q"))
    both = sold(F.concat(F.lit("M"), "c_mktsegment")).unionByName(sold(F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))))
    contributions = cut(both.select("case_id", "id", F.round(F.col("q") / F.sum("q").over(Window.partitionBy("case_id")), 6).alias("value")))
    nodes, edges = cut(nodes), cut(edges)
    dynamics = contributions.select("case_id", F.col("id").alias("feature"), "value").where("false")
    diagnostics = domain.table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("anchor"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("feature"))
    return RootCauses(nodes, edges, contributions, dynamics, diagnostics)


_MARKET = dict(
    var=""" SELECT 'R' || r_regionkey AS id, 0.35 AS wt FROM region UNION ALL SELECT DISTINCT 'M' || c_mktsegment, CASE c_mktsegment WHEN 'BUILDING' THEN 0.75 ELSE 1.0 END FROM customer""",
    sold=""" SELECT l_suppkey::VARCHAR AS case_id, id, sum(l_quantity) AS q FROM (SELECT l_suppkey, l_quantity, unnest(['M' || c_mktsegment, 'R' || n_regionkey]) AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey) GROUP BY ALL""",
    con=" SELECT case_id, id, round(q / sum(q) OVER (PARTITION BY case_id), 6) AS raw FROM sold",
    wc=" SELECT case_id, id, raw, wt, round(raw * wt, 8) AS v, row_number() OVER (PARTITION BY case_id ORDER BY round(raw * wt, 8) DESC, id) AS n FROM con JOIN var USING (id)",
    mk=" SELECT head AS anchor, tail AS id, edge_id, confidence AS w, CASE relation WHEN 'PART_OF' THEN 0.32 ELSE 0.26 END AS sigma FROM edges WHERE relation IN ('PART_OF', 'HAS_PLAUSIBLE_CAUSE')",
    pairs=" SELECT case_id, anchor FROM (SELECT DISTINCT case_id FROM con), (SELECT DISTINCT anchor FROM mk)",
    near=" SELECT case_id, anchor, max(v) AS adjacent, arg_min(id, n) AS variable FROM wc JOIN mk USING (id) WHERE n <= 8 GROUP BY ALL",
    hits=" SELECT case_id, anchor, id, v * (w * 0.92) AS hit, row_number() OVER (PARTITION BY case_id, anchor ORDER BY v * (w * 0.92) DESC, id) AS hn FROM wc JOIN mk USING (id) WHERE v > 0",
    sup=" SELECT case_id, anchor, round(sum(hit), 8) AS support, arg_min(id, hn) AS variable FROM hits WHERE hn <= 4 GROUP BY ALL",
    cand=""" SELECT case_id, anchor, CASE WHEN n.adjacent IS NOT NULL THEN 1 WHEN coalesce(support, 0) > 0 THEN 2 ELSE 3 END AS priority,
      greatest(coalesce(n.adjacent, 0.0), coalesce(support, 0.0)) AS adjacent, coalesce(support, 0.0) AS support,
      CASE WHEN support > coalesce(n.adjacent, 0.0) THEN s.variable ELSE coalesce(n.variable, s.variable, '') END AS seed_variable
      FROM pairs LEFT JOIN near n USING (case_id, anchor) LEFT JOIN sup s USING (case_id, anchor)""",
    seeded=" SELECT *, round(least(0.35, greatest(0.18, adjacent, 0.9 * support)), 6) AS seed FROM cand",
    reached=" SELECT case_id, anchor, id, edge_id, round(seed * w * exp(-sigma), 8) AS score FROM seeded JOIN mk USING (anchor) WHERE seed * w * exp(-sigma) > 1e-6",
    sc=" SELECT r.*, r.score * x.wt AS ws, coalesce(wc.v, 0.0) AS v FROM reached r JOIN var x USING (id) LEFT JOIN wc ON wc.case_id = r.case_id AND wc.id = r.id",
    terms=""" SELECT case_id, anchor, sum(ws * v) AS dot, sqrt(sum(ws * ws)) AS size, sum(CASE WHEN ws >= greatest(1e-6, 0.1 * most) THEN v ELSE 0 END) AS mass, -sum(CASE WHEN ws > 1e-9 THEN ws / total * ln(ws / total) ELSE 0 END) AS entropy
      FROM (SELECT *, max(ws) OVER (PARTITION BY case_id, anchor) AS most, sum(CASE WHEN ws > 1e-9 THEN ws END) OVER (PARTITION BY case_id, anchor) AS total FROM sc) GROUP BY case_id, anchor""",
    norm=" SELECT case_id, sqrt(sum(v * v)) AS norm, sum(v) FILTER (n <= 8 AND v > 0) AS top FROM wc GROUP BY case_id",
    told=" SELECT case_id, 'N' || n_nationkey AS anchor, round(least(1.0, v / top), 8) AS told FROM wc JOIN norm USING (case_id) JOIN nation ON id = 'R' || n_regionkey",
    fin=""" SELECT c.*, round(coalesce(dot / (size * norm), 0.0), 8) AS root, coalesce(dot / (size * norm), 0.0) - 0.09 * coalesce(mass, 0) - 0.015 * coalesce(entropy, 0) + 0.16 + 0.28 * coalesce(told, 0) AS s
      FROM seeded c JOIN norm USING (case_id) LEFT JOIN terms t USING (case_id, anchor) LEFT JOIN told d USING (case_id, anchor)""",
    rkd=" SELECT *, round(s, 8) AS score, row_number() OVER (PARTITION BY case_id ORDER BY round(s, 8) DESC, root DESC, priority, anchor) AS rank FROM fin",
)


@query(sql("SELECT case_id, anchor AS id, priority, round(adjacent + 1e-12, 6) AS adjacent, round(support + 1e-12, 6) AS support, seed_variable, seed FROM seeded", "edges", **_MARKET))
def candidate_enumeration(spark, d):
    c = _market(spark, d).candidates
    return c.select("case_id", "id", "priority", F.round(F.col("adjacent") + 1e-12, 6).alias("adjacent"), F.round(F.col("support") + 1e-12, 6).alias("support"), "seed_variable", "seed")


@query(sql("SELECT case_id, anchor AS id, rank, round(score + 1e-9, 6) AS score, round(root + 1e-9, 6) AS root_score FROM rkd", "edges", **_MARKET))
def root_cause_ranking(spark, d):
    """Suppliers as cases: candidates, propagation, anchors and rules composed."""
    r = _market(spark, d).ranked
    return r.select("case_id", "id", "rank", F.round(F.col("score") + 1e-9, 6).alias("score"), F.round(F.col("root_score") + 1e-9, 6).alias("root_score"))


@query(
    sql(
        """SELECT case_id, anchor AS source, rank, edge_id, 1::BIGINT AS paths FROM (SELECT a.*, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id, anchor ORDER BY score DESC, id) AS place FROM reached WHERE score > 0) a JOIN rkd USING (case_id, anchor) WHERE place <= 3 AND rank <= 3)""",
        "edges",
        **_MARKET,
    )
)
def root_cause_subgraphs(spark, d):
    """The edges by which each case's best candidates reach the variables that they reach most."""
    return _market(spark, d).subgraph_edges().select("case_id", "source", "rank", "edge_id", "paths")


@query(
    sql(
        """SELECT count(DISTINCT case_id) AS cases, count(*) AS rankings, round(count(*) / count(DISTINCT case_id), 6) AS mean_candidates, round(avg(score) FILTER (rank = 1) + 1e-9, 5) AS mean_top1_score, round(avg(root) FILTER (rank = 1) + 1e-9, 5) AS mean_top1_root_score FROM rkd""",
        "edges",
        **_MARKET,
    )
)
def root_cause_report(spark, d):
    r = _market(spark, d).report()
    return r.withColumns({c: F.round(F.col(c) + 1e-9, 5) for c in ("mean_top1_score", "mean_top1_root_score")})


@query()
def rule_adjusted_ranking(spark, d):
    """A fold of rules, each reading what the last one wrote; tests try every gate."""
    names = sorted({r.target for r in rules.RULES} | {x for r in rules.RULES for x in r.leaders} | set(rules.FAMILY))
    at = F.explode(F.array(*[F.struct(F.lit(n).alias("id"), F.lit(i).alias("i")) for i, n in enumerate(names)]))
    runs = domain.series(spark, d).groupBy(F.concat_ws("_", "fault", "run").alias("case_id")).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.avg("k").alias("k"))
    jitter = F.pmod(F.xxhash64("case_id", "a.id"), F.lit(1000)) / 10000
    some = lambda n: F.pmod(F.xxhash64("case_id", "a.id", F.lit(n)), F.lit(100)) / 200
    cands = runs.select("case_id", at.alias("a")).select(
        "case_id", F.col("a.id").alias("id"), (F.lit(0.5) + jitter).alias("base"), F.lit("root_cause_anchor").alias("role"), F.lit("").alias("direct_targets"), *[some(n).alias(n) for n in ("unique_alignment", "discriminator_alignment", "memory_bonus")]
    )
    dynamic = (("xmeas_22__std", F.col("s") / 10), ("xmeas_22__mean", -F.col("m") / 50), ("xmeas_11__std", F.col("s") / 20), ("xmeas_18__mean", -F.col("m") / 30), ("xmeas_19__mean", F.col("k") / 60), ("xmeas_19__std", F.lit(1.5)))
    share = (("v1", F.col("m")), ("v2", F.col("k")), ("v3", F.col("s")), ("v4", F.lit(20.0)))
    rows = [F.struct(F.lit(kind).alias("kind"), F.lit(f).alias("feature"), c.alias("value")) for kind, fs in (("dynamic", dynamic), ("contribution", share)) for f, c in fs]
    features = runs.select("case_id", F.explode(F.array(*rows)).alias("f")).select("case_id", "f.*")
    return rules.adjust(cands, features, {rules.SEPARATOR_INLET: ["v1", "v2"], rules.SEPARATOR: ["v2", "v3"], rules.CONDENSER: ["v3"]})


@query(
    sql(
        """SELECT DISTINCT 'M' || c_mktsegment AS cause, 'R' || r_regionkey AS variable FROM customer, region WHERE r_regionkey IN (SELECT n_regionkey FROM nation JOIN customer c2 ON c2.c_nationkey = n_nationkey WHERE c2.c_mktsegment = customer.c_mktsegment)"""
    )
)
def support_reach(spark, d):
    """Regions that each segment reaches over undirected support edges, not through another segment."""
    nodes, e = domain.kg_nodes(spark, d), domain.kg_edges(spark, d).where("scenario = 'shared'")
    paths = propagation.support_paths(nodes.where("label = 'RootCause'"), nodes.where("label = 'Location'"), e)
    return paths.where(F.size("path") == 2).select("cause", "variable")


@query(sql("SELECT head || '|' || relation AS k, count(*) AS n FROM edges WHERE relation = 'PART_OF' GROUP BY ALL", "edges"))
def graph_snapshot(spark, d):
    """The shared scope of the graph as a snapshot would give it."""
    e = graph.visible_edges(domain.kg_nodes(spark, d), domain.kg_edges(spark, d), ["shared"]).where("relation = 'PART_OF'")
    return e.groupBy(F.concat_ws("|", "head", "relation").alias("k")).agg(F.count("*").alias("n"))


_STEP = lambda n, before: f""" SELECT cause, b AS spot, min(list_append(path, {{'c': c, 'e': edge_id}})) AS path FROM s{n - 1} JOIN und ON a = spot WHERE b NOT IN (SELECT id FROM causes) AND (cause, b) NOT IN (SELECT (cause, spot) FROM ({before})) GROUP BY ALL"""
_UNTIL = lambda n: " UNION ALL ".join(f"SELECT cause, spot FROM s{i}" for i in range(n))
_SIMPLE = dict(
    causes=" SELECT id FROM nodes WHERE label = 'RootCause'",
    scope=" SELECT * FROM vis WHERE dataset = 'tep'",
    und=" SELECT head AS a, tail AS b, 1 - confidence AS c, edge_id FROM scope UNION ALL SELECT tail, head, 1 - confidence, edge_id FROM scope",
    s0=" SELECT id AS cause, id AS spot, CAST([] AS STRUCT(c DOUBLE, e VARCHAR)[]) AS path FROM causes",
    s1=_STEP(1, _UNTIL(1)), s2=_STEP(2, _UNTIL(2)), s3=_STEP(3, _UNTIL(3)), s4=_STEP(4, _UNTIL(4)),
    reached=" SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4",
    shares=" SELECT case_id, id, q / sum(q) OVER (PARTITION BY case_id) AS v FROM (SELECT c.case_id, 'P' || l_partkey AS id, sum(l.l_quantity) AS q FROM lines l JOIN cases c USING (l_orderkey) WHERE c.dataset = 'tep' GROUP BY ALL)",
    chosen=" SELECT *, sum(v) OVER (PARTITION BY case_id) AS total, count(*) OVER (PARTITION BY case_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY v DESC, id) AS nth FROM shares) WHERE nth <= 8 AND id IN (SELECT id FROM vis_nodes WHERE dataset = 'tep')",
    fitted=" SELECT case_id, cause, id, v, total, n, path, list_sum(list_transform(path, lambda x: 1 - x.c)) / len(path) AS conf FROM chosen JOIN reached ON spot = id",
    summed=""" SELECT case_id, cause, sum(v) / greatest(max(total), 1e-9) AS match, sum(v * conf) / sum(v) AS graph, count(*) / max(n) AS support, sum(v * len(path)) / sum(v) AS length, avg((len(path) > 1)::INT) AS broad FROM fitted GROUP BY ALL""",
    simply=" SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, cause) AS rank FROM (SELECT *, round(greatest(0, 0.5 * match + 0.3 * graph + 0.25 * support - 0.1 * length / 4 - 0.12 * broad) + 1e-9, 4) AS score FROM summed)",
)


def _simple(spark, d) -> SimpleCauses:
    """Orders of one scenario as cases, the parts of their lines as variables with their share of the quantity."""
    lines = domain.case_lines(spark, d)
    cases_ = domain.evidence_cases(spark, d).where("dataset = 'tep'").select("l_orderkey", "case_id")
    amounts = lines.join(cases_, "l_orderkey").groupBy("case_id", F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("id")).agg(F.sum("l_quantity").alias("q"))
    share = F.col("q") / F.sum("q").over(Window.partitionBy("case_id"))
    nodes, edges = domain.kg_nodes(spark, d), domain.kg_edges(spark, d)
    return SimpleCauses(amounts.select("case_id", "id", share.cast("double").alias("value")), graph.visible_nodes(nodes, ["tep"]).select("id", "label"), cut(graph.visible_edges(nodes, edges, ["tep"])))


@query(sql("SELECT case_id, rank, cause, score, round(graph + 1e-9, 4) AS confidence, round(match + 1e-9, 4) AS evidence_match, round(length, 6) AS length FROM simply WHERE rank <= 5", "vis", "cases", **_SIMPLE))
def simple_causes(spark, d):
    """The simple reasoner over all cases of a scenario."""
    return _simple(spark, d).ranked.select("case_id", "rank", "cause", "score", "confidence", "evidence_match", F.round("length", 6).alias("length"))


@query(sql("SELECT case_id, rank, cause, id AS variable, array_to_string(list_transform(path, lambda x: x.e), '>') AS path FROM fitted JOIN simply USING (case_id, cause) WHERE rank <= 5", "vis", "cases", **_SIMPLE))
def simple_cause_paths(spark, d):
    """The whole paths, of all lengths, that the simple reasoner gives for its causes."""
    return _simple(spark, d).explained().select("case_id", "rank", "cause", "variable", F.array_join("path", ">").alias("path"))
