"""Shared parts of the checking SQL: the derivations of faultline.plans.domain as common table expressions."""

from __future__ import annotations


def scen(k: str) -> str:
    return f"CASE {k} % 3 WHEN 0 THEN 'mvtec' WHEN 1 THEN 'tep' ELSE 'wafer' END"


def norm(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')"


PARTS = {
    "nodes": f"""
  SELECT 'R' || r_regionkey AS id, r_name AS name, 'Location' AS label, 'shared' AS scenario, CAST([] AS VARCHAR[]) AS aliases FROM region
  UNION ALL SELECT 'N' || n_nationkey, n_name, 'ProcessUnit', 'shared', CAST([] AS VARCHAR[]) FROM nation
  UNION ALL SELECT 'S' || s_suppkey, s_name, 'Object', {scen('s_suppkey')}, CAST([] AS VARCHAR[]) FROM supplier
  UNION ALL SELECT 'P' || p_partkey, p_name, 'AnomalyType', {scen('p_partkey')}, [p_type, p_brand] FROM part
  UNION ALL SELECT DISTINCT 'M' || c_mktsegment, c_mktsegment, 'RootCause', 'shared', CAST([] AS VARCHAR[]) FROM customer""",
    "raw_edges": f"""
  SELECT 'P' || l_partkey AS head, 'OCCURS_ON' AS relation, 'S' || l_suppkey AS tail, {scen('l_partkey')} AS scenario,
         round(1 - avg(l_discount), 6) AS confidence, count(*) AS support, 'lineitem' AS source
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey, l_suppkey
  UNION ALL SELECT 'P' || l_partkey, 'HAS_LOCATION', 'N' || s_nationkey, {scen('l_partkey')}, round(1 - avg(l_discount), 6), count(*), 'lineitem'
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_suppkey % 2 = 0 GROUP BY l_partkey, s_nationkey
  UNION ALL SELECT 'S' || s_suppkey, 'BELONGS_TO_UNIT', 'N' || s_nationkey, {scen('s_suppkey')}, 0.9, 1, 'supplier' FROM supplier
  UNION ALL SELECT 'N' || n_nationkey, 'PART_OF', 'R' || n_regionkey, 'shared', 0.95, 1, 'nation' FROM nation
  UNION ALL SELECT 'N' || c_nationkey, 'HAS_PLAUSIBLE_CAUSE', 'M' || c_mktsegment, 'shared',
         round(count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey), 6), count(*), 'customer' FROM customer GROUP BY c_nationkey, c_mktsegment""",
    "edges": """
  SELECT *, head || '|' || relation || '|' || tail || '|' || scenario AS edge_id FROM raw_edges""",
    "datasets": " SELECT unnest(['mvtec', 'tep', 'wafer']) AS dataset",
    "vis_nodes": " SELECT n.*, dataset FROM nodes n, datasets WHERE scenario IN (dataset, 'shared')",
    "vis": """
  SELECT e.*, dataset FROM edges e, datasets WHERE e.scenario IN (dataset, 'shared')
  AND (dataset, head) IN (SELECT (dataset, id) FROM vis_nodes) AND (dataset, tail) IN (SELECT (dataset, id) FROM vis_nodes)""",
    "best": """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, head, tail ORDER BY confidence DESC, edge_id DESC) AS rn FROM vis) WHERE rn = 1""",
    "terms": f"""
  SELECT id, name, label, scenario, ord - 1 AS ord, term, {norm('term')} AS key
  FROM (SELECT id, name, label, scenario, unnest([id, name] || aliases) AS term, generate_subscripts([id, name] || aliases, 1) AS ord FROM nodes)
  WHERE {norm('term')} <> ''""",
    "lines": f"""
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS nth
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "cases": f"""
  SELECT 'case_' || l_orderkey AS case_id, l_orderkey, l_suppkey, {scen('l_partkey')} AS dataset, s_name AS object, 'P' || l_partkey AS anomaly_type,
         p_name AS anomaly_name, n_name AS location, round(l_discount * 10, 4) AS confidence, l_quantity AS quantity FROM lines WHERE nth = 1""",
    "mentions": f"""
  SELECT *, {norm('mention')} AS mention_key FROM (
  SELECT case_id, dataset, 'object' AS field, 0 AS ord, CASE WHEN l_suppkey % 25 = 0 THEN object[2:] ELSE object END AS mention FROM cases
  UNION ALL SELECT case_id, dataset, 'anomaly_type', 1, anomaly_type FROM cases
  UNION ALL SELECT case_id, dataset, 'location', 2, CASE l_orderkey % 7 WHEN 0 THEN replace(location, 'TI', 'T') WHEN 1 THEN 'QQ' ELSE location END FROM cases
  UNION ALL SELECT c.case_id, c.dataset, 'variable', l.nth + 1, 'P' || l.l_partkey FROM lines l JOIN cases c USING (l_orderkey) WHERE l.nth > 1 AND {scen('l.l_partkey')} = c.dataset)""",
    "exact": """
  SELECT mention_key, dataset, id, label, max(CASE ord WHEN 0 THEN 1.0 WHEN 1 THEN 0.98 ELSE 0.95 END)::DOUBLE AS score
  FROM (SELECT DISTINCT mention_key, dataset FROM mentions) m JOIN terms ON key = mention_key AND scenario IN (dataset, 'shared')
  GROUP BY ALL""",
    "first_exact": """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention_key, dataset ORDER BY score DESC, id) AS rn FROM exact) WHERE rn = 1""",
    "open_keys": " SELECT DISTINCT field, mention_key, dataset FROM mentions WHERE mention_key <> '' AND (mention_key, dataset) NOT IN (SELECT (mention_key, dataset) FROM exact)",
    "pairs": " SELECT DISTINCT mention_key AS x, key AS y FROM open_keys, (SELECT DISTINCT key FROM terms) WHERE mention_key <> key",
    # the weighted ratio: longest common subsequences of pairs, a character of the shorter key at a time; the largest value so far runs along the other
    "parts": """ SELECT x, y, unnest(list_distinct([long] || CASE WHEN len(long) < 1.5 * len(short) THEN CAST([] AS VARCHAR[]) ELSE
        list_transform(range(0, len(long) - len(short) + 1), lambda i: long[i + 1:i + len(short)]) || list_transform(range(1, len(short)), lambda i: long[1:i]) || list_transform(range(len(long) - len(short) + 1, len(long)), lambda i: long[i + 1:]) END)) AS part, short, long
      FROM (SELECT x, y, CASE WHEN len(x) <= len(y) THEN x ELSE y END AS short, CASE WHEN len(x) <= len(y) THEN y ELSE x END AS long FROM pairs)""",
    "distinct_parts": " SELECT DISTINCT short, part FROM parts",
    "lcs": """ SELECT short, part, 0 AS i, list_transform(range(0, len(part) + 1), lambda j: 0) AS row FROM distinct_parts
      UNION ALL SELECT short, part, i + 1, list_transform(range(0, len(part) + 1), lambda j: list_max(list_transform(range(0, j + 1), lambda k: CASE WHEN k > 0 AND part[k:k] = short[i + 1:i + 1] THEN row[k] + 1 ELSE row[k + 1] END))) FROM lcs WHERE i < len(short)""",
    "ratios": " SELECT short, part, 2.0 * row[len(part) + 1] / (len(short) + len(part)) AS r FROM lcs WHERE i = len(short)",
    "weighted": " SELECT x, y, max(CASE WHEN part = long THEN r WHEN len(long) <= 8 * len(short) THEN r * 0.9 ELSE r * 0.6 END)::DOUBLE AS score FROM parts JOIN ratios USING (short, part) GROUP BY x, y",
    "near_all": " SELECT x, y, CASE WHEN contains(x, y) OR contains(y, x) THEN 0.82 ELSE score END::DOUBLE AS score, CASE WHEN contains(x, y) OR contains(y, x) THEN 'partial' ELSE 'fuzzy' END AS match_type FROM weighted",
    "near_cand": """ SELECT o.mention_key, o.dataset, t.id, t.label, max(n.score) AS score FROM (SELECT DISTINCT mention_key, dataset FROM open_keys) o JOIN near_all n ON n.x = o.mention_key AND n.score >= 0.55
      JOIN terms t ON t.key = n.y AND t.scenario IN (o.dataset, 'shared') GROUP BY ALL""",
    "near_field": """ SELECT o.field, c.*, (field = 'object' AND label = 'Object') OR (field = 'anomaly_type' AND label = 'AnomalyType') OR (field = 'location' AND label IN ('Location', 'ProcessUnit')) AS ok
      FROM open_keys o JOIN (SELECT *, row_number() OVER (PARTITION BY mention_key, dataset ORDER BY score DESC, id) AS pre FROM near_cand) c USING (mention_key, dataset) WHERE pre <= 15""",
    "first_near": """ SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field, mention_key, dataset ORDER BY ok DESC, score DESC, id) AS rn FROM near_field) WHERE rn = 1""",
    "links": """
  SELECT m.*, coalesce(f.id, n.id) AS entity_id, round(coalesce(f.score, n.score), 4) AS score FROM mentions m LEFT JOIN first_exact f USING (mention_key, dataset) LEFT JOIN first_near n USING (field, mention_key, dataset)""",
    "sel": """
  SELECT case_id, dataset, field, arg_max(entity_id, ord) AS entity_id FROM links WHERE entity_id IS NOT NULL GROUP BY ALL""",
    "rules": """
  SELECT * FROM (VALUES ('anomaly_type', 'location', 'OCCURS_ON', 0), ('anomaly_type', 'location', 'HAS_LOCATION', 1),
  ('variable', 'location', 'MEASURED_IN', 0), ('variable', 'location', 'BELONGS_TO_UNIT', 1),
  ('anomaly_type', 'morphology', 'HAS_MORPHOLOGY', 0), ('anomaly_type', 'log_event', 'ASSOCIATED_WITH_EVENT', 0)) t(source_field, target_field, relation, relation_ord)""",
    "checks": """
  SELECT s.case_id, s.dataset, r.source_field, r.target_field, s.entity_id AS source_id, t.entity_id AS target_id,
         arg_min(r.relation, r.relation_ord) FILTER (WHERE v.head IS NOT NULL) AS matched_relation
  FROM sel s JOIN rules r ON s.field = r.source_field JOIN sel t ON t.case_id = s.case_id AND t.field = r.target_field
  LEFT JOIN (SELECT DISTINCT head, relation, tail, dataset FROM vis) v
    ON v.head = s.entity_id AND v.tail = t.entity_id AND v.relation = r.relation AND v.dataset = s.dataset
  GROUP BY ALL""",
    "corrections": """
  SELECT case_id, candidate_id, target_field, suggested_id, score, edge_id, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, candidate_id) AS rank FROM (
      SELECT *, 'corr_' || case_id || '_' || target_field || '_' || lower(suggested_id) AS candidate_id, round(confidence, 4) AS score FROM (
        SELECT c.case_id, c.target_field, v.tail AS suggested_id, v.confidence, v.edge_id, row_number() OVER (PARTITION BY c.case_id, c.target_field, v.tail ORDER BY v.confidence DESC, v.edge_id) AS n
        FROM checks c JOIN rules r USING (source_field, target_field) JOIN vis v ON v.head = c.source_id AND v.relation = r.relation AND v.dataset = c.dataset WHERE c.matched_relation IS NULL) WHERE n = 1)) WHERE rank <= 5""",
    "sources": """
  SELECT DISTINCT dataset, entity_id AS source_id FROM sel WHERE field IN ('anomaly_type', 'variable', 'log_event')""",
    "walk": """
  SELECT dataset, source_id, source_id AS at_id, [source_id] AS nodes, CAST([] AS VARCHAR[]) AS edge_ids, CAST([] AS VARCHAR[]) AS relations, CAST([] AS DOUBLE[]) AS confs FROM sources
  UNION ALL
  SELECT w.dataset, w.source_id, b.tail, list_append(w.nodes, b.tail), list_append(w.edge_ids, b.edge_id), list_append(w.relations, b.relation), list_append(w.confs, b.confidence)
  FROM walk w JOIN best b ON b.dataset = w.dataset AND b.head = w.at_id WHERE len(w.edge_ids) < 5 AND NOT list_contains(w.nodes, b.tail)""",
    "paths": """
  SELECT dataset, source_id, at_id AS target_id, nodes, edge_ids, relations, len(edge_ids) AS length, list_sum(confs) / len(confs) AS strength
  FROM walk WHERE len(edge_ids) > 0 AND at_id IN (SELECT id FROM nodes WHERE label = 'RootCause')""",
    "ids": " SELECT case_id, list(DISTINCT entity_id) AS ids FROM sel GROUP BY case_id",
    "scored": """
  SELECT s.case_id, p.*, len(list_intersect(p.nodes, i.ids)) / greatest(1, len(i.ids)) AS match,
         round(0.55 * strength + 0.35 * (len(list_intersect(p.nodes, i.ids)) / greatest(1, len(i.ids))) - 0.10 * length / 5 + 1e-9, 4) AS score
  FROM (SELECT DISTINCT case_id, dataset, entity_id AS source_id FROM sel WHERE field IN ('anomaly_type', 'variable', 'log_event')) s
  JOIN ids i USING (case_id) JOIN paths p USING (dataset, source_id)""",
    "top": """
  SELECT *, 'path_' || case_id || '_' || substr(sha1(array_to_string(nodes || relations, '|')), 1, 10) AS path_id FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, nodes) AS rank FROM scored) WHERE rank <= 5""",
    "cause": """
  SELECT case_id, dataset, target_id AS cause, max(score) AS score, arg_max(strength, (score, -rank)) AS strength, arg_max(match, (score, -rank)) AS match,
         string_agg(path_id, '|' ORDER BY rank) AS path_ids FROM top GROUP BY ALL""",
}
#: What each part needs before it.
NEEDS = {
    "edges": ["raw_edges"], "vis_nodes": ["nodes", "datasets"], "vis": ["edges", "vis_nodes"], "best": ["vis"], "terms": ["nodes"], "cases": ["lines"], "mentions": ["cases"],
    "exact": ["mentions", "terms"], "first_exact": ["exact"], "open_keys": ["exact"], "pairs": ["open_keys", "terms"], "parts": ["pairs"], "distinct_parts": ["parts"], "lcs": ["distinct_parts"], "ratios": ["lcs"],
    "weighted": ["ratios"], "near_all": ["weighted"], "near_cand": ["near_all"], "near_field": ["near_cand"], "first_near": ["near_field"], "links": ["first_exact", "first_near"], "sel": ["links"], "checks": ["sel", "rules", "vis"], "corrections": ["checks", "rules", "vis"], "sources": ["sel"], "walk": ["sources", "best"],
    "paths": ["walk", "nodes"], "ids": ["sel"], "scored": ["ids", "paths"], "top": ["scored"], "cause": ["top"],
}


def sql(body: str, *parts: str, instead: dict[str, tuple[str, list[str]]] | None = None, **extra: str) -> str:
    """The body after a WITH of the named parts and all they need; extra: further expressions, in order.

    instead: other text for a part, and what that needs.
    """
    order: list[str] = []
    instead = instead or {}

    def add(name: str) -> None:
        for n in instead[name][1] if name in instead else NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for p in parts:
        add(p)
    ctes = [f"{n} AS ({instead[n][0] if n in instead else PARTS[n]})" for n in order] + [f"{n} AS ({t})" for n, t in extra.items()]
    return (f"WITH RECURSIVE {', '.join(ctes)} " if ctes else "") + body
