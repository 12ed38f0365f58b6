"""DuckDB SQL for the training-data operators that SQL can express: it says what they must give, by the plainest way, for checks on small tables."""

from __future__ import annotations

from .sharding import FINAL_1, FINAL_2, JUMP_MULTIPLIER

_WRAP = "18446744073709551616::UHUGEINT"
_MIX = lambda x, shift, factor: f"((xor({x}, {x} // {1 << shift}::UHUGEINT)) * {factor}::UHUGEINT) % {_WRAP}"

#: The jump hash a step at a time, the checksum a byte at a time; slots in the order of doc_id, checksum and size.
SHARDING = f"""
WITH RECURSIVE
crc_table AS (SELECT list(c ORDER BY i) AS tbl FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i))),
texts AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (SELECT row, doc_id, len(h) // 2 + 8 AS size, xor(4294967295, list_reduce([4294967295] || list_transform(range(1, len(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT), lambda c, b: xor(tbl[xor(c, b) % 256 + 1], c // 256))) AS text_crc32 FROM texts, crc_table),
mixed AS (SELECT DISTINCT doc_id, (coalesce(doc_id, -9223372036854775808)::HUGEINT + 18446744073709551616::HUGEINT + 11400714819323198485::HUGEINT)::UHUGEINT % {_WRAP} AS x FROM documents),
spread AS (SELECT doc_id, xor(x, x // 2147483648::UHUGEINT) AS s FROM (SELECT doc_id, {_MIX('x', 27, FINAL_2)} AS x FROM (SELECT doc_id, {_MIX('x', 30, FINAL_1)} AS x FROM mixed))),
jump AS (SELECT doc_id, n, s, 0::BIGINT AS b, 0.0::DOUBLE AS step, true AS going FROM spread, (SELECT unnest([24, 25]) AS n)
  UNION ALL SELECT doc_id, n, t, CASE WHEN u < n THEN floor(u)::BIGINT ELSE b END, u, u < n FROM (
    SELECT doc_id, n, b, t, (b + 1) * (2147483648.0::DOUBLE / ((t // 8589934592::UHUGEINT)::DOUBLE + 1.0)) AS u FROM (SELECT doc_id, n, b, (s * {JUMP_MULTIPLIER}::UHUGEINT + 1::UHUGEINT) % {_WRAP} AS t FROM jump WHERE going))),
ends AS (SELECT doc_id, n, b FROM jump WHERE NOT going)
SELECT s.doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, a.b::INT AS shard, row_number() OVER (PARTITION BY a.b ORDER BY s.doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, g.b::INT AS grown_shard
FROM sums s JOIN ends a ON a.doc_id IS NOT DISTINCT FROM s.doc_id AND a.n = 24 JOIN ends g ON g.doc_id IS NOT DISTINCT FROM s.doc_id AND g.n = 25"""

#: Full sets of shingles, all pairs with one in common, reach over links.
MINHASH = """
WITH RECURSIVE
words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS m FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.m = b.m AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM sets JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON a = doc_id"""

#: Cosines of all pairs in double precision, reach over links.
EMBEDDINGS = """
WITH RECURSIVE
usual AS (SELECT len(embedding) AS dim FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, dim LIMIT 1),
good AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings, usual WHERE len(embedding) = dim AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = vec_id"""

#: Lines by splitting at their ends, parts as stretches of code points, the text rebuilt from where the marks stand.
MIDDLE = """
WITH
split AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS s, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
ends AS (SELECT doc_id, t, h, list_filter(list_transform(s, lambda x, i: length(x) + (i < len(s))::BIGINT), lambda x: x > 0) AS l FROM split),
drawn AS (SELECT doc_id, t, l, len(l) AS n, ('0x' || h[1:8])::BIGINT % (len(l) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(l) + 1) AS b, t = '' OR t LIKE '%<P>%' OR t LIKE '%<S>%' OR t LIKE '%<M>%' AS plain, ('0x' || h[25:32])::BIGINT % 100 < 50 AS spm FROM ends),
places AS (SELECT *, coalesce(list_sum(list_filter(l, lambda x, i: i <= least(a, b))), 0)::BIGINT AS p, coalesce(list_sum(list_filter(l, lambda x, i: i > least(a, b) AND i <= greatest(a, b))), 0)::BIGINT AS m FROM drawn),
made AS (SELECT *, CASE WHEN plain THEN t WHEN spm THEN concat('<S>', substring(t, p + m + 1), '<P>', left(t, p), '<M>', substring(t, p + 1, m)) ELSE concat('<P>', left(t, p), '<S>', substring(t, p + m + 1), '<M>', substring(t, p + 1, m)) END AS o FROM places),
back AS (SELECT *, instr(o, '<P>') AS ip, instr(o, '<S>') AS is_, instr(o, '<M>') AS im FROM made)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN p END AS prefix_chars, CASE WHEN NOT plain THEN m END AS middle_chars, sha256(o) AS output_sha256,
  sha256(CASE WHEN plain THEN o WHEN spm THEN concat(substring(o, ip + 3, im - ip - 3), substring(o, im + 3), substring(o, 4, ip - 4)) ELSE concat(substring(o, 4, is_ - 4), substring(o, im + 3), substring(o, is_ + 3, im - is_ - 3)) END) AS restored_sha256
FROM back"""
