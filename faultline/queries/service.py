"""Queries over metrics, noise, source texts, review and runs."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import artifacts, cases, compiler, evidence, metrics, noise, review
from ..operators.lineage import cut, shared_folder
from ..plans import domain
from ..plans.compile import Compiled
from ..plans.noise import NoiseExperiment
from ..plans.pipeline import analyse
from ..sources import runs
from .registry import registry
from .sql import norm, scen, sql

QUERIES, ORACLE_SQL, query = registry()

_RANKED = " SELECT l_orderkey AS case_id, l_partkey % 20 AS item, min(nth) AS rank FROM lines GROUP BY ALL"
_GOLD = " SELECT o_orderkey AS case_id, o_custkey % 20 AS item FROM orders WHERE o_orderstatus <> 'P'"
_MET = dict(ranked=_RANKED, gold=_GOLD, first=" SELECT o_orderkey AS case_id, f.first FROM orders LEFT JOIN (SELECT case_id, min(rank) AS first FROM ranked JOIN gold USING (case_id, item) GROUP BY case_id) f ON f.case_id = o_orderkey")


def _lists(spark, d):
    """Orders as cases: the parts of their lines in order as ranked answers, the customer's number as gold (none for status P)."""
    o = domain.table(spark, d, "orders")
    ranked = domain.case_lines(spark, d).groupBy(F.col("l_orderkey").alias("case_id"), (F.col("l_partkey") % 20).alias("item")).agg(F.min("nth").alias("rank"))
    gold = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 20).alias("item"))
    return o.select(F.col("o_orderkey").alias("case_id")), ranked, gold


@query(sql("SELECT " + ", ".join(f"round(avg(coalesce((first <= {k})::INT, 0)), 6) AS accuracy_at_{k}" for k in (1, 3, 5)) + " FROM first", "lines", **_MET))
def metric_topk(spark, d):
    return metrics.top_k(*_lists(spark, d), [1, 3, 5])


@query(sql("SELECT round(avg(coalesce(1.0 / first, 0.0)) + 1e-12, 6) AS mrr, count(*) AS cases FROM first", "lines", **_MET))
def metric_mrr(spark, d):
    return metrics.mean_reciprocal_rank(*_lists(spark, d))


@query(sql("SELECT case_id, first AS rank, coalesce(first <= 1, false) AS hit_1, coalesce(first <= 3, false) AS hit_3, coalesce(first <= 5, false) AS hit_k, round(coalesce(1.0 / first, 0.0), 6) AS reciprocal_rank FROM first", "lines", **_MET))
def metric_cases(spark, d):
    return metrics.case_metrics(*_lists(spark, d), 5).withColumn("rank", F.col("rank").cast("long"))


@query(
    sql(
        """SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (
        SELECT count(*) FILTER (e.f IS NOT NULL AND p.f IS NOT NULL) AS tp, count(*) FILTER (e.f IS NULL) AS fp, count(*) FILTER (p.f IS NULL) AS fn FROM
        (SELECT DISTINCT l_orderkey AS c, CASE l_returnflag WHEN 'R' THEN 'variable' WHEN 'A' THEN 'location' ELSE 'log_event' END AS f FROM lineitem) e FULL JOIN
        (SELECT DISTINCT l_orderkey AS c, CASE WHEN l_linestatus = 'O' THEN 'variable' WHEN l_quantity > 25 THEN 'log_event' WHEN l_quantity > 10 THEN 'location' ELSE 'defect_type' END AS f FROM lineitem) p USING (c, f))"""
    )
)
def metric_prf(spark, d):
    l = domain.table(spark, d, "lineitem")
    e = l.select(F.col("l_orderkey").alias("case_id"), F.when(F.col("l_returnflag") == "R", "raw_evidence.variables").when(F.col("l_returnflag") == "A", "raw_evidence.location").otherwise("log_events").alias("field"))
    p = l.select(F.col("l_orderkey").alias("case_id"), F.when(F.col("l_linestatus") == "O", "variable_contributions").when(F.col("l_quantity") > 25, "raw_evidence.log_events").when(F.col("l_quantity") > 10, "location").otherwise("defect_type").alias("field"))
    return metrics.precision_recall(e, p)


@query(sql("SELECT round(avg(coalesce((CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 5 END = o_orderkey % 5)::INT, 0)) + 1e-12, 6) AS accuracy, count(*) AS rows FROM orders"))
def metric_linking(spark, d):
    o = domain.table(spark, d, "orders")
    return metrics.pair_accuracy(o, F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 5), F.col("o_orderkey") % 5)


@query(sql("SELECT round(avg((split_part(p_name, ' ', 2) = 'ring')::INT) + 1e-12, 6) AS accuracy, count(*) AS rows FROM part"))
def metric_correction(spark, d):
    """A correction to `<color>_RING` of names that are a color and a thing."""
    p = domain.table(spark, d, "part")
    said = F.concat(F.upper(F.split("p_name", " ")[0]), F.lit("_ RING"))
    return metrics.pair_accuracy(p, metrics.value_key(F.col("p_name")), metrics.value_key(said))


_OPTIONS = lambda table: "CASE dataset " + " ".join(f"WHEN '{d}' THEN {list(v)}" for d, v in table.items()) + " END"
_KEY = "'42|' || case_id || '|' || kind || '|' || printf('%.8f', level)"
_NUMBER = lambda key: f"('0x' || substr(sha256({key}), 1, 8))::BIGINT / 4294967296.0"
_CHOSEN = lambda options: f"CASE WHEN len({options}) > 0 THEN ({options})[floor(d * len({options}))::INT + 1] END"
_SYNONYM = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in noise.SYNONYMS.items()) + " END"
_PERTURBED = lambda v: f"CASE WHEN contains({v}, '_') THEN regexp_replace({v}, '_', '') ELSE {v} || '_perturbed' END"
_LESS = lambda c: f"list_filter({c}, lambda v, i: NOT list_contains(list_transform(list_sort(list_transform(range(0, len({c})), lambda j: struct_pack(x := {_NUMBER(_KEY + chr(32) + chr(124)*2 + chr(32) + chr(39) + chr(124) + chr(39) + chr(32) + chr(124)*2 + ' j')}, j := j)))[1:least(len({c}), greatest(1, ceil(len({c}) * level)))::INT], lambda s: s.j), i - 1))"
_NOISE = dict(
    sl=" SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey",
    nc=f""" SELECT 's' || f.s_suppkey AS case_id, {scen('f.l_partkey')} AS dataset, f.s_name AS object, CASE f.s_suppkey % 5 WHEN 0 THEN 'process_fault' ELSE 'P' || f.l_partkey END AS anomaly_type, f.n_name AS location,
      CASE f.s_suppkey % 3 WHEN 0 THEN 'linear' WHEN 1 THEN 'surface' END AS morphology, coalesce(v.variables, CAST([] AS VARCHAR[])) AS variables,
      CASE f.s_suppkey % 2 WHEN 0 THEN ['example_alarm', 'R' || f.s_nationkey % 5] ELSE CAST([] AS VARCHAR[]) END AS log_events
      FROM sl f LEFT JOIN (SELECT s_suppkey, list('P_' || l_partkey ORDER BY n) AS variables FROM sl WHERE n BETWEEN 2 AND 1 + s_suppkey % 4 GROUP BY s_suppkey) v USING (s_suppkey) WHERE f.n = 1""",
    grid=f" SELECT *, {_NUMBER(_KEY)} AS d FROM nc, (SELECT unnest([0.1::DOUBLE, 0.2, 0.3]) AS level), (SELECT unnest({list(noise.KINDS)}) AS kind)",
    opts=f""" SELECT *, list_filter({_OPTIONS(noise.REPLACEMENTS['anomaly_type'])}, lambda v: v IS DISTINCT FROM anomaly_type) AS oa, list_filter({_OPTIONS(noise.REPLACEMENTS['location'])}, lambda v: v IS DISTINCT FROM location) AS ol,
      list_filter({_OPTIONS(noise.REPLACEMENTS['morphology'])}, lambda v: v IS DISTINCT FROM morphology) AS om,
      list_filter([struct_pack(f := 'anomaly_type', v := anomaly_type), struct_pack(f := 'location', v := location), struct_pack(f := 'morphology', v := morphology)] || list_transform(variables, lambda x: struct_pack(f := 'raw_evidence.variables', v := x))
        || list_transform(log_events, lambda x: struct_pack(f := 'raw_evidence.log_events', v := x)), lambda s: {_SYNONYM.format('s.v')} IS NOT NULL) AS os FROM grid""",
    picked=f""" SELECT *, CASE WHEN kind = 'synonym_substitution' THEN {_CHOSEN('os')} END AS syn, CASE WHEN kind <> 'contradiction_injection' THEN NULL WHEN dataset = 'tep' AND len(variables) > 0 THEN 'location' WHEN dataset = 'wafer' THEN 'morphology'
      WHEN morphology IS NOT NULL THEN 'morphology' WHEN len(ol) > 0 THEN 'location' END AS con FROM opts""",
    noisy=f""" SELECT case_id AS base, case_id || '|' || level || '|' || kind AS case_id, level, kind, dataset, object,
      CASE WHEN kind = 'anomaly_type_replacement' AND len(oa) > 0 THEN {_CHOSEN('oa')} WHEN syn.f = 'anomaly_type' THEN {_SYNONYM.format('syn.v')} ELSE anomaly_type END AS anomaly_type,
      CASE WHEN kind = 'location_replacement' AND len(ol) > 0 THEN {_CHOSEN('ol')} WHEN syn.f = 'location' THEN {_SYNONYM.format('syn.v')} WHEN con = 'location' THEN CASE WHEN dataset = 'tep' AND len(variables) > 0 THEN 'feed disturbance' ELSE {_CHOSEN('ol')} END ELSE location END AS location,
      CASE WHEN kind = 'morphology_replacement' AND len(om) > 0 THEN {_CHOSEN('om')} WHEN syn.f = 'morphology' THEN {_SYNONYM.format('syn.v')} WHEN con = 'morphology' THEN CASE WHEN dataset = 'wafer' THEN 'wafer_surface' ELSE 'surface' END ELSE morphology END AS morphology,
      CASE WHEN kind = 'variable_deletion' AND len(variables) > 0 THEN {_LESS('variables')} WHEN kind = 'variable_name_perturbation' THEN list_transform(variables, lambda v, i: CASE WHEN i - 1 = floor(d * len(variables)) THEN {_PERTURBED('v')} ELSE v END)
        WHEN syn.f = 'raw_evidence.variables' THEN list_transform(variables, lambda v: CASE WHEN v = syn.v THEN {_SYNONYM.format('syn.v')} ELSE v END) ELSE variables END AS variables,
      CASE WHEN kind = 'log_event_deletion' AND len(log_events) > 0 THEN {_LESS('log_events')} WHEN syn.f = 'raw_evidence.log_events' THEN list_transform(log_events, lambda v: CASE WHEN v = syn.v THEN {_SYNONYM.format('syn.v')} ELSE v END) ELSE log_events END AS log_events,
      CASE WHEN kind IN ('variable_deletion', 'variable_name_perturbation') AND len(variables) > 0 THEN ['raw_evidence.variables', 'raw_evidence.variable_contributions'] WHEN kind = 'log_event_deletion' AND len(log_events) > 0 THEN ['raw_evidence.log_events']
        WHEN kind = 'anomaly_type_replacement' AND len(oa) > 0 THEN ['anomaly_type'] WHEN kind = 'location_replacement' AND len(ol) > 0 THEN ['location'] WHEN kind = 'morphology_replacement' AND len(om) > 0 THEN ['morphology']
        WHEN syn IS NOT NULL THEN [syn.f] WHEN con IS NOT NULL THEN [con] ELSE CAST([] AS VARCHAR[]) END AS corrupted FROM picked""",
)


def _noise_cases(spark, d):
    """Suppliers as cases: their first line is the anomaly, the next ones' parts are variables."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    lines = domain.table(spark, d, "lineitem").withColumn("n", F.row_number().over(w)).where("n <= 4").join(domain.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(domain.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    part, key, none = F.concat(F.lit("P_"), F.col("l_partkey").cast("string")), F.col("s_suppkey"), F.array().cast("array<string>")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("v")))), lambda x: x["v"])
    others = lines.where("n between 2 and 1 + s_suppkey % 4").groupBy("s_suppkey").agg(listed.alias("variables"))
    first = lines.where("n = 1").join(others, "s_suppkey", "left")
    variables = F.coalesce("variables", none)
    return first.select(
        F.concat(F.lit("s"), key.cast("string")).alias("case_id"), domain.scenario(F.col("l_partkey")).alias("dataset"), F.col("s_name").alias("object"),
        F.when(key % 5 == 0, "process_fault").otherwise(F.concat(F.lit("P"), F.col("l_partkey").cast("string"))).alias("anomaly_type"), F.col("n_name").alias("location"),
        F.when(key % 3 == 0, "linear").when(key % 3 == 1, "surface").alias("morphology"), variables.alias("variables"),
        F.map_from_entries(F.transform(F.array_distinct(variables), lambda v: F.struct(v, F.lit(0.5)))).alias("variable_contributions"),
        F.when(key % 2 == 0, F.array(F.lit("example_alarm"), F.concat(F.lit("R"), (F.col("s_nationkey") % 5).cast("string")))).otherwise(none).alias("log_events"),
    )


@query(sql("SELECT base, level, kind, anomaly_type, location, morphology, array_to_string(variables, '|') AS variables, array_to_string(log_events, '|') AS log_events, array_to_string(corrupted, '|') AS corrupted FROM noisy", **_NOISE))
def noise_injection(spark, d):
    n = noise.inject(_noise_cases(spark, d))
    return n.select(F.col("case_id").alias("base"), "level", "kind", "anomaly_type", "location", "morphology", *[F.array_join(c, "|").alias(c) for c in ("variables", "log_events", "corrupted")])


_EVERY = """ SELECT case_id, dataset, object, anomaly_type, location, morphology, variables, log_events FROM nc UNION ALL SELECT case_id, dataset, object, anomaly_type, location, morphology, variables, log_events FROM noisy"""
_NOISE_MENTIONS = f""" SELECT *, {norm('mention')} AS mention_key FROM (
  SELECT case_id, dataset, 'object' AS field, 0 AS ord, object AS mention FROM every UNION ALL SELECT case_id, dataset, 'anomaly_type', 1, anomaly_type FROM every
  UNION ALL SELECT case_id, dataset, 'location', 2, location FROM every WHERE location IS NOT NULL UNION ALL SELECT case_id, dataset, 'morphology', 3, morphology FROM every WHERE morphology IS NOT NULL
  UNION ALL SELECT case_id, dataset, 'variable', 10 + generate_subscripts(variables, 1), unnest(variables) FROM every UNION ALL SELECT case_id, dataset, 'log_event', 1000 + generate_subscripts(log_events, 1), unnest(log_events) FROM every)"""
_MEASURED = dict(
    last="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, field ORDER BY ord DESC) AS back FROM links) WHERE back = 1",
    listed=""" SELECT field, mention_key, dataset, list(id ORDER BY rn) AS cands FROM (
      SELECT m.field, e.mention_key, e.dataset, e.id, row_number() OVER (PARTITION BY m.field, e.mention_key, e.dataset ORDER BY score DESC, id) AS rn FROM (SELECT DISTINCT field, mention_key, dataset FROM mentions) m JOIN exact e USING (mention_key, dataset)
      UNION ALL SELECT field, mention_key, dataset, id, row_number() OVER (PARTITION BY field, mention_key, dataset ORDER BY score DESC, id) FROM (SELECT *, bool_or(ok) OVER (PARTITION BY field, mention_key, dataset) AS any_ok FROM near_field) WHERE ok OR NOT any_ok) WHERE rn <= 3 GROUP BY ALL""",
    linked=""" SELECT n.case_id, avg(coalesce(c.entity_id = p.entity_id, false)::INT) AS acc, avg(coalesce(list_contains(x.cands, c.entity_id), false)::INT) AS topk FROM noisy n JOIN last c ON c.case_id = n.base LEFT JOIN last p ON p.case_id = n.case_id AND p.field = c.field
      LEFT JOIN listed x ON x.field = p.field AND x.mention_key = p.mention_key AND x.dataset = p.dataset GROUP BY n.case_id""",
    expected=" SELECT DISTINCT case_id, base, CASE replace(f, 'raw_evidence.', '') WHEN 'variables' THEN 'variable' WHEN 'variable_contributions' THEN 'variable' WHEN 'log_events' THEN 'log_event' ELSE f END AS field FROM (SELECT case_id, base, unnest(corrupted) AS f FROM noisy)",
    flagged=" SELECT DISTINCT case_id, field FROM (SELECT case_id, unnest([source_field, target_field]) AS field FROM checks WHERE matched_relation IS NULL) WHERE case_id IN (SELECT case_id FROM noisy)",
    detected=""" SELECT case_id, coalesce(count(*) FILTER (e IS NOT NULL AND p IS NOT NULL) / nullif(count(p), 0), 0) AS prec, coalesce(count(*) FILTER (e IS NOT NULL AND p IS NOT NULL) / nullif(count(e), 0), 0) AS rec FROM (
      SELECT coalesce(e.case_id, f.case_id) AS case_id, e.case_id AS e, f.case_id AS p FROM expected e FULL JOIN flagged f ON e.case_id = f.case_id AND e.field = f.field) GROUP BY case_id""",
    mended=" SELECT e.case_id, avg(coalesce(c.first = l.entity_id, false)::INT) AS acc, avg(coalesce(list_contains(c.everything, l.entity_id), false)::INT) AS topk FROM expected e JOIN last l ON l.case_id = e.base AND l.field = e.field AND l.entity_id IS NOT NULL LEFT JOIN (SELECT case_id, target_field, arg_min(suggested_id, rank) AS first, list(suggested_id) AS everything FROM corrections GROUP BY ALL) c ON c.case_id = e.case_id AND c.target_field = e.field GROUP BY e.case_id",
    was=" SELECT case_id, list(DISTINCT target_id) AS targets, arg_min(array_to_string(nodes || relations, '|'), rank) AS best FROM top GROUP BY case_id",
    ranked=" SELECT n.case_id, min(CASE WHEN list_contains(w.targets, t.target_id) THEN t.rank END) AS hit, max((array_to_string(t.nodes || t.relations, '|') = w.best)::INT) AS path FROM noisy n JOIN was w ON w.case_id = n.base JOIN top t ON t.case_id = n.case_id GROUP BY n.case_id",
)


@query(
    sql(
        """SELECT level, kind, count(*) AS n, round(avg(1.0) + 1e-12, 4) AS schema_validity_rate, """
        + ", ".join(
            f"round(avg(coalesce({e}, 0)) + 1e-12, 4) AS {m}"
            for m, e in (
                ("entity_linking_accuracy", "linked.acc"), ("top_k_linking_accuracy", "linked.topk"), ("inconsistency_precision", "prec"), ("inconsistency_recall", "rec"), ("correction_accuracy", "mended.acc"), ("top_k_correction_accuracy", "mended.topk"),
                ("noise_recovery_rate", "mended.acc"), ("top_k_root_cause_accuracy", "(hit IS NOT NULL)::INT"), ("mrr", "1.0 / hit"), ("path_hit_rate", "path"),
            )
        )
        + " FROM noisy LEFT JOIN linked USING (case_id) LEFT JOIN detected USING (case_id) LEFT JOIN mended USING (case_id) LEFT JOIN ranked USING (case_id) GROUP BY GROUPING SETS ((level, kind), ())",
        "links",
        "corrections",
        "top",
        instead={
            **{n: (t, list(_NOISE)[i - 1 : i]) for i, (n, t) in enumerate(_NOISE.items())},
            "every": (_EVERY, ["noisy"]),
            "mentions": (_NOISE_MENTIONS, ["every"]),
        },
        **_MEASURED,
    )
)
def noise_grid_rollup(spark, d):
    """Suppliers as cases under every kind and level of noise, analysed anew and compared with their clean run."""
    return NoiseExperiment(_noise_cases(spark, d), domain.kg_nodes(spark, d), domain.kg_edges(spark, d)).summary


_CHUNK_END = lambda at: f"CASE WHEN {at} + 8000 >= len(text) THEN len(text) WHEN instr(reverse(text[{at} + 4001:{at} + 8000]), chr(10)) > 0 THEN {at} + 8000 - instr(reverse(text[{at} + 4001:{at} + 8000]), chr(10)) ELSE {at} + 8000 END"
_LINES_IN = lambda t: f"(len({t}) - len(replace({t}, chr(10), '')))"


_CHUNKS = sql(
    f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS chunk, pos + lead AS start, pos + lead + len(own) AS "end", 1 + {_LINES_IN('text[1:pos + lead]')} AS first_line, 1 + {_LINES_IN('text[1:pos + lead]')} + {_LINES_IN('own')} AS last_line
    FROM (SELECT *, len(part) - len(regexp_replace(part, '^\\s+', '')) AS lead, regexp_replace(regexp_replace(part, '^\\s+', ''), '\\s+$', '') AS own FROM (SELECT *, text[pos + 1:stop] AS part FROM cuts)) WHERE own <> ''""",
    cuts=f""" SELECT doc_id, text, 0::BIGINT AS pos, {_CHUNK_END('0')} AS stop FROM documents WHERE len(text) > 0
      UNION ALL SELECT doc_id, text, pos, {_CHUNK_END('pos')} FROM (SELECT doc_id, text, greatest(stop - 800, pos + 1) AS pos FROM cuts WHERE stop < len(text))""",
)


@query(_CHUNKS)
def chunk_documents(spark, d):
    return compiler.chunk(domain.table(spark, d, "documents"), "doc_id").drop("text")


@query(_CHUNKS)
def chunk_lateral(spark, d):
    """The same chunks by the table function, in SQL."""
    compiler.register_chunks(spark)
    docs = domain.table(spark, d, "documents").select("doc_id", "text")
    return spark.sql("SELECT doc_id, c.chunk, c.start, c.`end`, c.first_line, c.last_line FROM {docs} AS docs, LATERAL chunks(docs.text) AS c", docs=docs)


_STATEMENTS = f""" SELECT o_orderkey AS id, {scen('o_orderkey')} AS scenario, 'Order ' || (o_custkey % 40) AS head, CASE o_orderstatus WHEN 'F' THEN 'OCCURS_ON' ELSE 'HAS_LOCATION' END AS relation, 'Unit ' || (o_orderkey % 7) AS tail,
  o_orderpriority, o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW'"""


def _statements(spark, d):
    o = domain.table(spark, d, "orders")
    relation = F.when(F.col("o_orderstatus") == "F", "OCCURS_ON").otherwise("HAS_LOCATION")
    line = F.concat(F.lit("  Order "), F.col("o_custkey") % 40, F.lit(" "), relation, F.lit(" Unit "), F.col("o_orderkey") % 7, F.lit("."))
    prose = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("nothing is said here")).otherwise(line)
    return o.select(F.col("o_orderkey").alias("id"), domain.scenario(F.col("o_orderkey")).alias("scenario"), "o_totalprice", prose.alias("line"))


@query(sql("SELECT id, scenario, head, relation, tail FROM st", st=_STATEMENTS))
def relation_lines(spark, d):
    return compiler.relation_lines(_statements(spark, d)).select("id", "scenario", "head", "relation", "tail")


@query(
    sql(
        f"""SELECT scenario, claim_key, claim, unit_id, copies, 'card_' || lpad(rn::VARCHAR, 4, '0') AS card_id FROM (SELECT *, row_number() OVER (ORDER BY scenario, claim_key) AS rn FROM (
        SELECT scenario, {norm('head || relation || tail')} AS claim_key, arg_min(head || ' ' || relation || ' ' || tail, id) AS claim, min(id) AS unit_id, count(*) AS copies FROM st GROUP BY ALL))""",
        st=_STATEMENTS,
    )
)
def card_dedupe(spark, d):
    r = compiler.relation_lines(_statements(spark, d))
    return compiler.dedupe_cards(r.select("scenario", F.concat_ws(" ", "head", "relation", "tail").alias("claim"), F.col("id").alias("unit_id")))


@query(
    sql(
        f"""SELECT CASE WHEN n = 1 THEN base ELSE upper(scenario[1]) || scenario[2:] || base END AS id, name_key, scenario, cards FROM (
        SELECT *, row_number() OVER (PARTITION BY base ORDER BY scenario, name_key) AS n FROM (SELECT {norm('head')} AS name_key, scenario, replace(arg_min(head, id), ' ', '') AS base, count(DISTINCT id) AS cards FROM st GROUP BY ALL))""",
        st=_STATEMENTS,
    )
)
def entity_upsert(spark, d):
    r = compiler.relation_lines(_statements(spark, d)).select(F.col("head").alias("name"), "scenario", F.col("id").alias("card_id"), F.array(F.lower("head")).alias("aliases"))
    return compiler.upsert_entities(r).select("id", "name_key", "scenario", F.size("cards").cast("long").alias("cards"))


@query(
    sql(
        """SELECT head, relation, tail, scenario, max(o_totalprice / 1000000) AS confidence, round(1 - max(o_totalprice / 1000000), 6) AS weight, count(DISTINCT o_orderpriority) AS sources, arg_min(id, id) AS evidence, count(*) AS copies FROM st GROUP BY ALL""",
        st=_STATEMENTS,
    )
)
def edge_upsert(spark, d):
    o = domain.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"))
    r = compiler.relation_lines(_statements(spark, d)).join(o, "id")
    rows = r.select("head", "relation", "tail", "scenario", (F.col("o_totalprice") / 1000000).alias("confidence"), "source", F.col("id").alias("evidence"), F.col("id").alias("card_id"))
    return compiler.upsert_edges(rows).withColumn("sources", F.size("sources").cast("long"))


@query(sql("SELECT head, relation, string_agg(DISTINCT tail, '|' ORDER BY tail) AS tails FROM edges GROUP BY ALL", "edges"))
def domain_profiles(spark, d):
    return compiler.domain_profiles(domain.kg_edges(spark, d)).select("head", "relation", F.array_join("tails", "|").alias("tails"))


_TYPED = """ SELECT id, CASE WHEN label = 'RootCause' THEN CASE WHEN id IN ('MMACHINERY', 'MFURNITURE') THEN label ELSE 'CandidateCause' END WHEN id = 'N0' THEN 'Region' ELSE label END AS label FROM nodes WHERE id <> 'N1'"""


@query(
    sql(
        """SELECT edge_id FROM edges LEFT JOIN typed ON id = tail WHERE head = tail OR (relation = 'OCCURS_ON' AND coalesce(label NOT IN ('Location', 'Object', 'ProcessUnit'), true))
        OR (relation = 'BELONGS_TO_UNIT' AND coalesce(label <> 'ProcessUnit', true)) OR (relation = 'HAS_PLAUSIBLE_CAUSE' AND coalesce(label NOT IN ('CandidateCause', 'Fault', 'Mechanism'), true))""",
        "nodes",
        "edges",
        typed=_TYPED,
    )
)
def type_constraints(spark, d):
    """A unit relabelled as a region, one that is gone, and segments that are no candidates break what relations demand of their ends."""
    label = F.when((F.col("label") == "RootCause") & ~F.col("id").isin("MMACHINERY", "MFURNITURE"), "CandidateCause").when(F.col("id") == "N0", "Region").otherwise(F.col("label"))
    n = domain.kg_nodes(spark, d).withColumn("label", label).where("id <> 'N1'")
    return compiler.wrong_types(domain.kg_edges(spark, d), n).select("edge_id")


@query(
    sql(
        f"""SELECT name, scenario, arg_min(id, (p, ord)) AS id FROM (
        SELECT q.name, q.scenario, e.id, e.ord, e.p FROM q JOIN e ON e.scope IN (q.scenario, 'shared') AND ((e.p = 0 AND (e.k = q.name OR e.k = q.pascal)) OR (e.p > 0 AND e.k = q.key))) GROUP BY ALL""",
        "nodes",
        q=f""" SELECT name, scenario, {norm('name')} AS key, pascal FROM (SELECT DISTINCT name, dataset AS scenario, replace(name, ' ', '') AS pascal FROM
          (SELECT p_brand AS name FROM part UNION SELECT n_name FROM nation UNION SELECT 'M' || c_mktsegment FROM customer UNION SELECT DISTINCT lower(c_mktsegment) FROM customer), (SELECT unnest(['mvtec', 'tep', 'wafer']) AS dataset))""",
        e=f""" SELECT id, scenario AS scope, hash_ord AS ord, unnest([0, 2, 3] || list_transform(aliases, lambda a: 4)) AS p, unnest([id, {norm('id')}, {norm('name')}] || list_transform(aliases, lambda a: {norm('a')})) AS k FROM (SELECT *, id AS hash_ord FROM nodes)""",
    )
)
def entity_resolution(spark, d):
    seg = domain.table(spark, d, "customer").select("c_mktsegment").distinct()
    names = domain.table(spark, d, "part").select(F.col("p_brand").alias("name")).union(domain.table(spark, d, "nation").select("n_name")).union(seg.select(F.concat(F.lit("M"), "c_mktsegment"))).union(seg.select(F.lower("c_mktsegment"))).distinct()
    asked = names.withColumn("scenario", F.explode(F.array(F.lit("mvtec"), F.lit("tep"), F.lit("wafer"))))
    return compiler.resolve(asked, domain.kg_nodes(spark, d).withColumn("ord", F.col("id")))


@query(sql("SELECT (SELECT count(*) FROM a) AS \"left\", (SELECT count(*) FROM b) AS \"right\", (SELECT count(*) FROM a JOIN b USING (edge_id)) AS shared, round((SELECT count(*) FROM a JOIN b USING (edge_id)) / (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)), 6) AS jaccard", "edges", a=" SELECT edge_id FROM edges WHERE confidence >= 0.94", b=" SELECT edge_id FROM edges WHERE support > 1"))
def graph_jaccard(spark, d):
    e = domain.kg_edges(spark, d)
    return compiler.graph_overlap(e.where("confidence >= 0.94"), e.where("support > 1"), "edge_id")


@query(sql("SELECT edge_id, confidence FROM edges WHERE relation = 'HAS_LOCATION' AND scenario = 'tep' AND contains(lower(tail), 'n1')", "edges"))
def review_queue(spark, d):
    return review.queue(domain.kg_edges(spark, d), "N1", relation="HAS_LOCATION", scenario="tep").select("edge_id", "confidence")


@query(sql("SELECT 'relation' AS facet, relation AS value, count(*) AS n FROM edges GROUP BY ALL UNION ALL SELECT 'scenario', scenario, count(*) FROM edges GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM edges GROUP BY ALL", "edges"))
def review_facets(spark, d):
    return review.facets(domain.kg_edges(spark, d), ["relation", "scenario", "source"])


_DECISIONS = " SELECT 'S' || (user_id % (SELECT count(*) FROM supplier)) AS s, CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject' ELSE 'defer' END AS decision, event_id FROM events"


def _decisions(spark, d):
    """Events as decisions on the unit edge of a supplier."""
    n = domain.table(spark, d, "supplier").count()
    edge = domain.kg_edges(spark, d).where("relation = 'BELONGS_TO_UNIT'").select(F.col("head").alias("s"), "edge_id")
    said = F.when(F.col("event_type") == "purchase", "accept").when(F.col("event_type") == "error", "reject").otherwise("defer")
    ev = domain.table(spark, d, "events").select(F.concat(F.lit("S"), (F.col("user_id") % n).cast("string")).alias("s"), said.alias("decision"), F.col("event_id").alias("ord"))
    return ev.join(edge, "s")


@query(
    sql(
        """SELECT e.edge_id, coalesce(n, 0) AS feedback_count, coalesce(a, 0) AS accepted_count, coalesce(r, 0) AS rejected_count, CASE last WHEN 'accept' THEN 'reviewed' WHEN 'reject' THEN 'rejected' ELSE 'auto' END AS review_status
        FROM edges e LEFT JOIN (SELECT s, count(*) AS n, count(*) FILTER (decision = 'accept') AS a, count(*) FILTER (decision = 'reject') AS r, arg_max(decision, event_id) AS last FROM dec GROUP BY s) ON s = e.head WHERE e.relation = 'BELONGS_TO_UNIT'""",
        "edges",
        dec=_DECISIONS,
    )
)
def review_update(spark, d):
    e = domain.kg_edges(spark, d).where("relation = 'BELONGS_TO_UNIT'").select("edge_id", F.lit("auto").alias("review_status"))
    return review.decide(e, _decisions(spark, d))


@query(
    sql(
        """SELECT s, round(c, 6) AS confidence FROM (SELECT s, c, row_number() OVER (PARTITION BY s ORDER BY i DESC) AS rn FROM fold) WHERE rn = 1""",
        dec=_DECISIONS,
        seq=" SELECT s, decision, row_number() OVER (PARTITION BY s ORDER BY event_id) AS i FROM dec",
        fold=""" SELECT DISTINCT s, 0.9::DOUBLE AS c, 0 AS i FROM seq UNION ALL
          SELECT f.s, CASE q.decision WHEN 'accept' THEN least(1.0, f.c + 0.03) WHEN 'reject' THEN greatest(0.0, f.c - 0.05) ELSE f.c END, q.i FROM fold f JOIN seq q ON q.s = f.s AND q.i = f.i + 1""",
    )
)
def confidence_fold(spark, d):
    n = domain.table(spark, d, "supplier").count()
    said = F.when(F.col("event_type") == "purchase", "accept").when(F.col("event_type") == "error", "reject").otherwise("defer")
    ev = domain.table(spark, d, "events").select(F.concat(F.lit("S"), (F.col("user_id") % n).cast("string")).alias("s"), F.struct("event_id", said.alias("decision")).alias("x"))
    g = ev.groupBy("s").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["decision"]).alias("ds"))
    return g.select("s", F.round(review.confidence_fold(F.lit(0.9), F.col("ds")), 6).alias("confidence"))


@query(sql("SELECT event_id, user_id, (SELECT count(*) FROM events WHERE event_type = 'error') AS total FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 20"))
def feedback_page(spark, d):
    """The second page of the ledger; the page is what is asked for."""
    return review.ledger(domain.table(spark, d, "events"), [F.desc("ts"), "event_id"], 20, 50, event_type="error", user_id=None).select("event_id", "user_id", "total")


@query(sql("SELECT case_id, count(*) AS path_edges, count(*) FILTER (e LIKE 'P%') AS overlay_edges, count(*) FILTER (e LIKE 'P%') > 0 AS contributes FROM (SELECT DISTINCT case_id, unnest(edge_ids) AS e FROM top) GROUP BY case_id", "top"))
def overlay_contribution(spark, d):
    a = analyse(spark, d)
    return review.overlay_use(a.best_paths, a.visible.where("head like 'P%'"))


@query(sql("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha1(doc_id || '|42'), doc_id) AS n FROM documents) WHERE n <= 20"))
def stratified_sample(spark, d):
    """Twenty documents of each language; the sample is what is asked for."""
    return review.stratified_sample(domain.table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 20)


@query(sql("SELECT lang, source, count(*) AS n, count(DISTINCT quality) AS kinds, count(quality) AS labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL"))
def run_summary(spark, d):
    """Documents as cases of runs (sources), with the feedback there is."""
    both = domain.table(spark, d, "documents").select("doc_id", "lang", "source").join(domain.table(spark, d, "labels"), "doc_id", "left")
    return both.groupBy("lang", "source").agg(F.count("*").alias("n"), F.countDistinct("quality").alias("kinds"), F.count("quality").alias("labelled"))


@query(sql("SELECT doc_id, string_agg(DISTINCT k, '+' ORDER BY k) AS types FROM (SELECT doc_id, 'quality_' || quality AS k FROM labels UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1) GROUP BY doc_id"))
def reference_index(spark, d):
    l = domain.table(spark, d, "labels")
    k = l.select("doc_id", F.concat(F.lit("quality_"), "quality").alias("k")).union(l.where("toxic = 1").select("doc_id", F.lit("toxic")))
    return k.groupBy("doc_id").agg(F.concat_ws("+", F.array_sort(F.collect_set("k"))).alias("types"))


@query(sql("SELECT DISTINCT fault AS missing FROM (SELECT unnest(['view', 'error', 'fault_21', 'fault_22']) AS fault) WHERE fault NOT IN (SELECT event_type FROM events)"))
def fault_coverage(spark, d):
    asked = spark.createDataFrame([(x,) for x in ("view", "error", "fault_21", "fault_22")], "event_type string")
    return asked.join(domain.table(spark, d, "events"), "event_type", "left_anti").select(F.col("event_type").alias("missing"))


@query(
    sql(
        """SELECT p_brand, defects, score, row_number() OVER (ORDER BY score DESC, defects DESC, p_brand) AS place FROM (
        SELECT p_brand, count(*) AS defects, round(0.35 * avg(l_quantity / 50) + 0.2 * coalesce(avg(CASE WHEN l_returnflag = 'R' THEN l_discount * 10 END), 0.0) + 0.2 * avg(1 - l_tax) + 0.25 * avg((l_linestatus = 'F')::INT) + 1e-9, 4) AS score
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand)"""
    )
)
def object_selection(spark, d):
    l = domain.table(spark, d, "lineitem").join(domain.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = l.select("p_brand", (F.col("l_quantity") / 50).alias("visual"), F.when(F.col("l_returnflag") == "R", F.col("l_discount") * 10).alias("localization"), (1 - F.col("l_tax")).alias("kg"), (F.col("l_linestatus") == "F").cast("double").alias("path"))
    return cases.selection_scores(rows, "p_brand")


_TRACED = """ SELECT pattern, coalesce(n, 0) AS cases, round(agreement + 1e-9, 4) AS agreement, round(consistency + 1e-9, 4) AS consistency, round(coverage + 1e-9, 4) AS path_coverage
  FROM (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', 'never']) AS pattern) LEFT JOIN (
  SELECT o_orderpriority AS pattern, count(*) AS n, avg(CASE WHEN o_orderstatus <> 'P' THEN (o_orderstatus = 'F')::INT END) AS agreement, avg(o_totalprice / 1000000) AS consistency, avg((o_custkey % 3 = 0)::INT) AS coverage FROM orders GROUP BY ALL) USING (pattern)"""


def _traced(spark, d):
    o = domain.table(spark, d, "orders")
    said = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).when(F.col("o_orderstatus") == "O", F.lit("other"))
    rows = o.select(F.col("o_orderpriority").alias("pattern"), said.alias("predicted"), (F.col("o_totalprice") / 1000000).alias("consistency"), (F.col("o_custkey") % 3 == 0).alias("has_path"))
    known = spark.createDataFrame([(x,) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "never")], "pattern string")
    return cases.traceability(rows, known)


@query(sql("SELECT * FROM traced", traced=_TRACED))
def pattern_traceability(spark, d):
    return _traced(spark, d)


@query(sql("SELECT count(*) AS patterns, round(avg((cases > 0)::INT), 4) AS seen, round(sum(cases * coalesce(path_coverage, 0)) / sum(cases) + 1e-9, 4) AS path_coverage FROM traced", traced=_TRACED))
def layer_rollup(spark, d):
    return cases.layer_rollup(_traced(spark, d))


@query(sql("SELECT count(*) AS cases, round(avg((a.p = b.p)::INT), 6) AS stability FROM (SELECT l_orderkey, l_partkey AS p FROM lines WHERE nth = 1) a JOIN (SELECT l_orderkey, arg_min(l_partkey, (-l_quantity, l_partkey)) AS p FROM lineitem GROUP BY l_orderkey) b USING (l_orderkey)", "lines"))
def label_ablation(spark, d):
    """Each order's first part, as ranked by line and by quantity."""
    first = domain.case_lines(spark, d).select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("item"), F.col("nth").alias("rank"))
    second = domain.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.min_by("l_partkey", F.struct(-F.col("l_quantity"), "l_partkey")).alias("item")).withColumn("rank", F.lit(1))
    return cases.stability(first, second)


@query(sql("SELECT case_id, bool_or(list_contains(nodes, 'N' || n_nationkey)) AS hit FROM top JOIN cases c USING (case_id) JOIN nation ON n_name = c.location GROUP BY case_id", "top", "cases"))
def path_hits(spark, d):
    """Whether a case's own nation lies on one of its best paths."""
    top = analyse(spark, d).top
    nations = domain.table(spark, d, "nation").select(F.col("n_name").alias("location"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("expected"))
    want = domain.evidence_cases(spark, d).join(nations, "location").select("case_id", "expected").join(top.select("case_id").distinct(), "case_id", "left_semi")
    return cases.path_hit(top, want)


@query(sql("SELECT case_id, count(*) AS paths, len(list_distinct(flatten(list(nodes)))) AS nodes, len(list_distinct(flatten(list(edge_ids)))) AS edges, count(DISTINCT source_id) AS sources, count(DISTINCT target_id) AS targets FROM top GROUP BY case_id", "top"))
def path_graph_summary(spark, d):
    return cases.path_summary(analyse(spark, d).best_paths)


@query(sql("SELECT lang, source, count(*) AS rows, count(DISTINCT doc_id) AS cases FROM documents GROUP BY ALL"))
def manifest_grouping(spark, d):
    return cases.manifest(domain.table(spark, d, "documents").select("lang", "source", F.col("doc_id").alias("case_id")), ["lang", "source"])


@query(
    sql(
        """SELECT o_orderkey AS case_id, how, count(*) AS n FROM (
        SELECT o.o_orderkey, 'scenario' AS how FROM orders o JOIN events e ON e.event_id = o.o_orderkey WHERE e.event_id % 2 = 0
        UNION ALL SELECT o.o_orderkey, 'fault_run' FROM orders o JOIN events e ON e.event_type = CASE o.o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'signup' END AND e.user_id = o.o_custkey
          WHERE o.o_orderkey NOT IN (SELECT event_id FROM events WHERE event_id % 2 = 0)) GROUP BY ALL"""
    )
)
def scenario_matches(spark, d):
    """Orders as cases, events as rows of artifacts; odd events have no scenario id."""
    o = domain.table(spark, d, "orders")
    asked = o.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderkey").alias("scenario_id"), F.when(F.col("o_orderstatus") == "F", "error").when(F.col("o_orderstatus") == "O", "signup").alias("fault"), F.col("o_custkey").alias("run"))
    rows = domain.table(spark, d, "events").select(F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("scenario_id"), F.col("event_type").alias("fault"), F.col("user_id").alias("run"), "value")
    return artifacts.match_scenarios(asked, rows).groupBy("case_id", "how").agg(F.count("*").alias("n"))


@query(
    sql(
        """SELECT case_id, variable, round(v / greatest(max(v) OVER (PARTITION BY case_id), 1.0) + 1e-12, 8) AS weight FROM (
        SELECT user_id AS case_id, event_type AS variable, coalesce(arg_max(value, event_id) FILTER (event_id % 3 <> 0), 1.0) AS v FROM events GROUP BY ALL)"""
    )
)
def payload_merge(spark, d):
    """Events as payloads; every third is no number."""
    e = domain.table(spark, d, "events")
    value = F.when(F.col("event_id") % 3 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return artifacts.merge_payloads(e.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("variable"), F.col("event_id").alias("source_ord"), value.alias("value")))


@query(sql("SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, cause) AS rank, cause, score FROM (SELECT user_id AS case_id, event_type AS cause, max(value) AS score FROM events WHERE value > 0 GROUP BY ALL)"))
def artifact_causes(spark, d):
    e = domain.table(spark, d, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("entity"), "value")
    return artifacts.causes_of(artifacts.entity_maxima(e).select("case_id", F.col("entity").alias("candidate"), F.col("value").alias("score")))


@query(sql("SELECT s_suppkey, round(greatest(0, 0.5 * (s_acctbal / 10000) + 0.3 * (s_nationkey / 25) + 0.25 * (s_suppkey % 2) - 0.1 * (s_suppkey % 5) / 4 - CASE WHEN s_nationkey > 12 THEN 0.12 ELSE 0 END) + 1e-12, 6) AS score FROM supplier"))
def simple_scores(spark, d):
    s = domain.table(spark, d, "supplier")
    score = artifacts.simple_score(F.col("s_acctbal") / 10000, F.col("s_nationkey") / 25, (F.col("s_suppkey") % 2).cast("double"), F.col("s_suppkey") % 5, F.col("s_nationkey") > 12)
    return s.select("s_suppkey", F.round(score + 1e-12, 6).alias("score"))


@query(
    sql(
        """SELECT case_id, l_linenumber, part, place FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY first DESC, l_linenumber, nth) AS place FROM (
        SELECT l_orderkey AS case_id, l_linenumber, l_partkey AS part, nth, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY nth) = 1 AS first FROM lines)) WHERE place <= 4""",
        "lines",
    )
)
def path_selection(spark, d):
    """Lines as paths: the line number is the candidate's rank."""
    l = domain.case_lines(spark, d).select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("candidate_rank"), F.col("nth").alias("path_rank"), F.col("l_partkey").alias("part"))
    return artifacts.choose_paths(l, 4).select("case_id", F.col("candidate_rank").alias("l_linenumber"), "part", "place")


@query(sql("SELECT edge_id, CASE WHEN relation = 'PART_OF' THEN 0.5::DOUBLE ELSE confidence END AS confidence, relation = 'PART_OF' AS overlaid FROM edges UNION ALL SELECT edge_id, 0.25, true FROM edges WHERE relation = 'PART_OF'", "edges"))
def overlay_provenance(spark, d):
    e = domain.kg_edges(spark, d)
    own = e.where("relation = 'PART_OF'").select(F.col("edge_id").alias("external_edge_id"))
    extra = own.withColumn("confidence", F.lit(0.5)).unionByName(own.withColumn("confidence", F.lit(0.25)))
    return artifacts.overlay(e, extra, ["confidence"]).select("edge_id", "confidence", "overlaid")


@query(sql("SELECT o_orderkey, 'C' || o_custkey AS head, CASE WHEN o_orderstatus <> 'P' THEN 'OCCURS_ON' END AS relation, o_orderpriority AS tail, CASE WHEN o_orderkey % 2 = 0 THEN 'tep' ELSE 'shared' END AS scenario, CASE WHEN o_orderkey % 2 = 0 THEN 'said, twice' END AS evidence, o_orderstatus <> 'P' AS valid FROM orders"))
def source_drafts(spark, d):
    o = domain.table(spark, d, "orders")
    relation = F.when(F.col("o_orderstatus") != "P", "OCCURS_ON").otherwise(" ")
    more = F.when(F.col("o_orderkey") % 2 == 0, ", tep , said, twice").otherwise("")
    line = F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit(" , "), relation, F.lit(","), F.col("o_orderpriority"), more)
    return artifacts.parse_draft(o.select("o_orderkey", line.alias("line"))).drop("line")


@query(sql("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE props END AS json FROM events"))
def json_repair(spark, d):
    """Properties in a fence, in prose, and cut off."""
    e = domain.table(spark, d, "events")
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    prose = F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" Done."))
    cut = F.substring("props", F.lit(1), F.length("props") - 1)
    said = F.when(F.col("event_id") % 3 == 0, fenced).when(F.col("event_id") % 3 == 1, prose).otherwise(cut)
    return e.select("event_id", artifacts.repaired_json(said).alias("json"))


@query(
    sql(
        f"""SELECT 'cards' AS kind, count(DISTINCT scenario || '|' || {norm('head || relation || tail')}) AS n FROM st UNION ALL
        SELECT 'entities', count(DISTINCT scenario || '|' || name) FROM (SELECT scenario, head AS name FROM st UNION ALL SELECT scenario, tail FROM st) UNION ALL
        SELECT 'edges', count(DISTINCT scenario || '|' || head || '|' || relation || '|' || tail) FROM st UNION ALL SELECT 'profiles', count(DISTINCT scenario || '|' || head || '|' || relation) FROM st""",
        st=_STATEMENTS,
    )
)
def source_compile(spark, d):
    """Orders as source texts, compiled as a whole: how many rows of each kind come out."""
    c = Compiled(_statements(spark, d).select(F.col("id").alias("unit_id"), "scenario", F.col("line").alias("text")))
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(c.cards, "cards").unionByName(count(c.entities, "entities")).unionByName(count(c.edges, "edges")).unionByName(count(c.profiles, "profiles"))


#: Market segments as runs: their customers' orders are the cases, and the lines of these what has been found.
_STORED = dict(
    kases=" SELECT 'run_' || c_mktsegment AS run_id, 'case_' || o_orderkey AS case_id, o_orderkey AS case_order, o_orderpriority AS dataset, o_orderstatus AS state FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'MACHINERY'",
    linked=" SELECT k.run_id, k.case_id, CASE l_linestatus WHEN 'F' THEN 'object' ELSE 'location' END AS field, 'link_' || l_orderkey || '_' || lpad(nth::VARCHAR, 2, '0') AS link_id, l_quantity AS score FROM lines JOIN kases k ON k.case_order = l_orderkey WHERE NOT (k.run_id = 'run_FURNITURE' AND l_returnflag = 'R')",
    pathed=" SELECT k.run_id, k.case_id, nth::INT AS rank, 'path_' || l_partkey AS path_id FROM lines JOIN kases k ON k.case_order = l_orderkey WHERE nth <= 3 AND k.run_id <> 'run_FURNITURE'",
)


def _stored(spark, d) -> runs.RunStore:
    """All segments stored; FURNITURE a second time, without the lines that were returned and without paths; MACHINERY removed again."""
    store = runs.RunStore(spark, f"{shared_folder(spark)}/runs/{uuid.uuid4().hex}")
    orders = domain.table(spark, d, "orders").join(domain.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    case_id = lambda c: F.concat(F.lit("case_"), F.col(c).cast("string"))
    orders = cut(orders.select("c_mktsegment", "o_orderkey", "o_orderpriority", "o_orderstatus"))
    lines = domain.case_lines(spark, d).join(orders.select("o_orderkey", "c_mktsegment"), F.col("l_orderkey") == F.col("o_orderkey"))
    cases_ = orders.select("c_mktsegment", case_id("o_orderkey").alias("case_id"), F.col("o_orderkey").alias("case_order"), F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("state"))
    field = F.when(F.col("l_linestatus") == "F", "object").otherwise("location")
    link_id = F.concat(F.lit("link_"), F.col("l_orderkey").cast("string"), F.lit("_"), F.lpad(F.col("nth").cast("string"), 2, "0"))
    links = lines.select("c_mktsegment", "l_returnflag", case_id("l_orderkey").alias("case_id"), field.alias("field"), link_id.alias("link_id"), F.col("l_quantity").alias("score"))
    paths_ = lines.where("nth <= 3").select("c_mktsegment", case_id("l_orderkey").alias("case_id"), F.col("nth").cast("int").alias("rank"), F.concat(F.lit("path_"), F.col("l_partkey").cast("string")).alias("path_id"))
    links, paths_ = cut(links), cut(paths_)
    of = lambda df, s: df.where(F.col("c_mktsegment") == s).drop("c_mktsegment", "l_returnflag")
    segments = [r[0] for r in domain.table(spark, d, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]  # market segments are five
    for i, s in enumerate(segments):
        about = spark.range(1).select(F.lit(f"2024-01-{i + 1:02d}").alias("started_at"), F.lit("done").alias("status"))
        store.save(f"run_{s}", {"run": about, "cases": of(cases_, s), "linked_entities": of(links, s), "paths": of(paths_, s)})
    about = spark.range(1).select(F.lit("2024-02-01").alias("started_at"), F.lit("again").alias("status"))
    store.save("run_FURNITURE", {"run": about, "cases": of(cases_, "FURNITURE"), "linked_entities": of(links.where("l_returnflag <> 'R'"), "FURNITURE")})
    store.remove("run_MACHINERY")
    return store


@query(
    sql(
        """SELECT run_id, case_id, case_order, dataset, state, coalesce(n, 0) AS links, first_link, coalesce(p, '') AS paths FROM kases
        LEFT JOIN (SELECT case_id, count(*) AS n, arg_min(link_id, (field, link_id)) AS first_link FROM linked GROUP BY case_id) USING (case_id)
        LEFT JOIN (SELECT case_id, string_agg(path_id, '|' ORDER BY rank) AS p FROM pathed GROUP BY case_id) USING (case_id)""",
        "lines",
        **_STORED,
    )
)
def run_details(spark, d):
    """Every case of every stored run with what was found for it, nested as it is stored."""
    store = _stored(spark, d)
    out = None
    for run in [r["run_id"] for r in store.current().orderBy("run_id").collect()]:  # the runs that this query has stored
        one = store.detail(run)
        paths_ = F.concat_ws("|", F.transform("paths", lambda p: p["path_id"])) if "paths" in one.columns else F.lit("")
        one = one.select("run_id", "case_id", "case_order", "dataset", "state", F.size("linked_entities").cast("long").alias("links"), F.get("linked_entities", F.lit(0))["link_id"].alias("first_link"), paths_.alias("paths"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    sql(
        """SELECT run_id, started_at, status, cases, links FROM (SELECT run_id, count(*) AS cases FROM kases GROUP BY run_id) JOIN (SELECT run_id, count(*) AS links FROM linked GROUP BY run_id) USING (run_id)
        JOIN (SELECT 'run_' || c_mktsegment AS run_id, CASE c_mktsegment WHEN 'FURNITURE' THEN '2024-02-01' ELSE '2024-01-0' || row_number() OVER (ORDER BY c_mktsegment) END AS started_at, CASE c_mktsegment WHEN 'FURNITURE' THEN 'again' ELSE 'done' END AS status FROM (SELECT DISTINCT c_mktsegment FROM customer)) USING (run_id)""",
        "lines",
        **_STORED,
    )
)
def run_list(spark, d):
    """The stored runs, newest first, with the sizes of their tables."""
    store = _stored(spark, d)
    size = lambda t, name: store.table(t).groupBy("run_id").agg(F.count("*").alias(name))
    return store.runs().select("run_id", "started_at", "status").join(size("cases", "cases"), "run_id").join(size("linked_entities", "links"), "run_id")


_UPSERTED = """ SELECT id, name, scenario FROM nodes WHERE label <> 'Location' AND NOT (label = 'Object' AND right(id, 1) = '7')
  UNION ALL SELECT id, lower(name), scenario FROM nodes WHERE label = 'Object' AND right(id, 1) = '7' UNION ALL SELECT id || '_new', name, 'shared' FROM nodes WHERE label = 'Location' UNION ALL SELECT id, name, scenario FROM nodes WHERE label = 'Location'"""


@query(sql("SELECT id, name, scenario FROM merged", "nodes", merged=_UPSERTED))
def graph_upsert(spark, d):
    """Graph nodes after a batch of changed suppliers and new places has been merged by key."""
    n = domain.kg_nodes(spark, d).select("id", "name", "scenario", "label")
    new = n.where("label = 'Object' and right(id, 1) = '7'").withColumn("name", F.lower("name")).unionByName(n.where("label = 'Location'").withColumns({"id": F.concat("id", F.lit("_new")), "scenario": F.lit("shared")}))
    return runs.upsert(n, new, ["id"]).select("id", "name", "scenario")


@query(
    sql(
        """SELECT coalesce(event_type, fault) AS fault, coalesce(n, 0) AS cases, fault IS NOT NULL AS requested, fault IS NOT NULL AND n IS NULL AS missing
        FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) FULL JOIN (SELECT unnest(['view', 'error', 'fault_21', 'fault_22']) AS fault) ON fault = event_type"""
    )
)
def fault_counts(spark, d):
    """Kinds of events as faults: how often each was seen, and which of those asked for never."""
    asked = spark.createDataFrame([(x,) for x in ("view", "error", "fault_21", "fault_22")], "event_type string")
    return cases.fault_coverage(domain.table(spark, d, "events"), asked, "event_type")


@query(sql("SELECT edge_id FROM edges WHERE confidence >= 0.94 AND support > 1 ORDER BY edge_id LIMIT 20", "edges"))
def graph_shared_sample(spark, d):
    """The sample of edges that two graphs share; twenty are what is asked for."""
    e = domain.kg_edges(spark, d)
    return compiler.shared_sample(e.where("confidence >= 0.94"), e.where("support > 1"), "edge_id")


@query(sql("SELECT event_id, 'event_id,extra,metadata|event_type|' || event_type || '|event_type|' || event_type AS kept FROM events"))
def fault_label_scrub(spark, d):
    """Events as records whose fault is named in a column and in two containers."""
    e = domain.table(spark, d, "events").select("event_id", F.col("user_id").alias("fault_number"), F.struct("event_type", F.col("user_id").alias("fault_id")).alias("metadata"), F.create_map(F.lit("fault_number"), F.col("event_type"), F.lit("event_type"), F.col("event_type")).alias("extra"))
    left = evidence.without_faults(e)
    names = [left.columns, left.schema["metadata"].dataType.names]
    return left.select("event_id", F.concat_ws("|", *[F.lit(",".join(sorted(n))) for n in names], "metadata.event_type", F.map_keys("extra"), F.map_values("extra")).alias("kept"))


#: Suppliers as cases; what they sold most as stored rankings, filed under a scenario id or only under fault and run; nations' and suppliers' contributions.
_BRIDGE = dict(
    kases=" SELECT 'case_' || s_suppkey AS case_id, CASE WHEN s_suppkey % 5 <> 0 THEN 'sc' || s_suppkey END AS scenario_id, s_nationkey::INT AS fault, (s_suppkey % 3)::INT AS run FROM supplier",
    stored=""" SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'sc' || l_suppkey END AS scenario_id, CASE WHEN l_suppkey % 2 = 1 THEN s_nationkey::INT END AS fault, CASE WHEN l_suppkey % 2 = 1 THEN (l_suppkey % 3)::INT END AS run, CASE WHEN l_partkey % 4 = 0 THEN (l_partkey % 7)::INT END AS rank,
      'P' || l_partkey AS candidate_id, CASE WHEN l_partkey % 3 = 0 THEN round(max(l_discount) * 12, 4) END AS ranking_score, CASE WHEN l_partkey % 3 = 1 THEN round(max(l_tax) * 10, 4) END AS root_score FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_suppkey, l_partkey, s_nationkey""",
    told=" SELECT s_suppkey AS ord, CASE WHEN s_suppkey % 4 = 0 THEN 'sc' || s_suppkey END AS scenario_id, s_nationkey::INT AS fault, (s_suppkey % 3)::INT AS run FROM supplier WHERE s_suppkey % 7 <> 1",
    rows_=" SELECT *, coalesce(ranking_score, root_score, 0.0) AS s, CASE WHEN root_score IS NOT NULL THEN least(1.0, root_score) WHEN coalesce(ranking_score, 0.0) <= 1 THEN coalesce(ranking_score, 0.0) END AS sure FROM stored",
    byid=" SELECT k.case_id, r.* FROM kases k JOIN rows_ r ON k.scenario_id = r.scenario_id",
    met=""" SELECT *, 'scenario' AS how FROM byid UNION ALL SELECT k.case_id, r.*, 'fault_run' FROM kases k JOIN rows_ r ON k.fault = r.fault AND k.run = r.run WHERE k.case_id NOT IN (SELECT case_id FROM byid)""",
    first=" SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY coalesce(nullif(rank, 0), 1000000), s DESC, candidate_id) AS n FROM met) WHERE n <= 5",
    named=" SELECT scenario_id, max(ord) AS c FROM told WHERE scenario_id IS NOT NULL GROUP BY scenario_id",
    timed=" SELECT fault, run, min(ord) AS c FROM told GROUP BY fault, run",
)


@query(
    sql(
        """SELECT f.case_id, row_number() OVER (PARTITION BY f.case_id ORDER BY coalesce(nullif(f.rank, 0), n), s DESC, candidate_id) AS rank, candidate_id AS cause, round(s, 4)::DOUBLE AS score, sure::DOUBLE AS confidence, how,
        coalesce(a.c, b.c, t.c) AS contribution, CASE WHEN a.c IS NOT NULL THEN 'row' WHEN b.c IS NOT NULL THEN 'case' WHEN t.c IS NOT NULL THEN 'fault_run' END AS via
        FROM first f JOIN kases k USING (case_id) LEFT JOIN named a ON a.scenario_id = f.scenario_id LEFT JOIN named b ON b.scenario_id = k.scenario_id LEFT JOIN timed t ON t.fault = k.fault AND t.run = k.run""",
        **_BRIDGE,
    )
)
def artifact_bridge(spark, d):
    """Stored rankings brought to their cases, with the contributions that go with them."""
    s = domain.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("int").alias("fault"), (F.col("s_suppkey") % 3).cast("int").alias("run"))
    scenario = F.concat(F.lit("sc"), F.col("k").cast("string"))
    cases_ = s.select(F.concat(F.lit("case_"), F.col("k").cast("string")).alias("case_id"), F.when(F.col("k") % 5 != 0, scenario).alias("scenario_id"), "fault", "run")
    sold = domain.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("p")).agg(F.max("l_discount").alias("x"), F.max("l_tax").alias("y")).join(s, "k")
    even, none = F.col("k") % 2 == 0, F.lit(None).cast("double")
    rankings = sold.select(
        F.when(even, scenario).alias("scenario_id"), F.when(~even, F.col("fault")).alias("fault"), F.when(~even, F.col("run")).alias("run"), F.when(F.col("p") % 4 == 0, (F.col("p") % 7).cast("int")).alias("rank"),
        F.concat(F.lit("P"), F.col("p").cast("string")).alias("candidate_id"), F.when(F.col("p") % 3 == 0, F.round(F.col("x") * 12, 4)).alias("ranking_score"), none.alias("score"),
        F.when(F.col("p") % 3 == 1, F.round(F.col("y") * 10, 4)).alias("root_score"), none.alias("structural_ranking_score"), none.alias("confidence"),
    )
    told = s.where("k % 7 <> 1").select(F.col("k").cast("long").alias("ord"), F.when(F.col("k") % 4 == 0, scenario).alias("scenario_id"), "fault", "run")
    return artifacts.bridge(cases_, rankings, told)
