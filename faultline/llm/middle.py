"""Fill-in-the-middle transformation of documents: DuckDB SQL over the Arrow batches of each partition."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, byte_slices

#: Bytes of text that DuckDB is given at once, about; a longer text comes alone.
SLICE_BYTES = 16 << 20


@dataclass(frozen=True)
class Plan:
    """How documents are cut. seed: of the draws. rate: of 100 documents, those that are rearranged; spm: of 100 of these,
    those whose suffix comes first. prefix, suffix, middle: the marks; a text that holds one stays plain."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if any(m[:k] == m[-k:] for m in marks for k in range(1, len(m))) or len(set(marks)) < 3 or not all(marks) or any("\n" in m for m in marks):
            raise ValueError("marks must differ, be of one line, and not begin as they end")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def transform_sql(plan: Plan, source: str = "batch") -> str:
    """doc_id, n, form, prefix_chars, middle_chars, output of a table of doc_id and text."""
    p, s, m = (_quoted(x) for x in (plan.prefix, plan.suffix, plan.middle))
    draw = lambda i: f"('0x' || h[{8 * i + 1}:{8 * i + 8}])::UBIGINT"
    return f"""
WITH keyed AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{plan.seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM {source}),
units AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS u, {draw(0)} AS h1, {draw(1)} AS h2, {draw(2)} AS h3, {draw(3)} AS h4 FROM keyed),
drawn AS (
  SELECT *, len(u) AS n, (least(h1 % (len(u) + 1), h2 % (len(u) + 1)))::BIGINT AS a, (greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)))::BIGINT AS b,
    CASE WHEN t = '' OR contains(t, {p}) OR contains(t, {s}) OR contains(t, {m}) OR h3 % 100 >= {plan.rate} THEN 'plain' WHEN h4 % 100 < {plan.spm} THEN 'spm' ELSE 'psm' END AS form
  FROM units),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(list_slice(u, 1, a), '') AS before, array_to_string(list_slice(u, a + 1, b), '') AS mid, array_to_string(list_slice(u, b + 1, n), '') AS after
  FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(before)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  CASE form WHEN 'plain' THEN t WHEN 'psm' THEN {p} || before || {s} || after || {m} || mid ELSE {s} || after || {p} || before || {m} || mid END AS output
FROM parts"""


def restore_sql(plan: Plan, source: str) -> str:
    """All columns of the source and restored: the text that output and form stand for, found by the marks alone."""
    p, s, m = (_quoted(x) for x in (plan.prefix, plan.suffix, plan.middle))
    first = f"CASE form WHEN 'psm' THEN {p} ELSE {s} END"
    second = f"CASE form WHEN 'psm' THEN {s} ELSE {p} END"
    return f"""
WITH opened AS (SELECT *, substr(output, length({first}) + 1) AS _rest FROM ({source})),
one AS (SELECT *, split_part(_rest, {second}, 1) AS _one FROM opened),
cut AS (SELECT *, substr(_rest, length(_one) + length({second}) + 1) AS _tail FROM one),
two AS (SELECT *, split_part(_tail, {m}, 1) AS _two FROM cut),
all_ AS (SELECT *, substr(_tail, length(_two) + length({m}) + 1) AS _mid FROM two)
SELECT * EXCLUDE (_rest, _one, _tail, _two, _mid), CASE form WHEN 'plain' THEN output WHEN 'psm' THEN _one || _mid || _two ELSE _two || _mid || _one END AS restored FROM all_"""


def digest_sql(source: str) -> str:
    return f"SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM ({source})"


def over_batches(df: DataFrame, sql: str, schema: str, text: str = "text") -> DataFrame:
    """The rows that the SQL makes of each batch of the frame, which it sees as the table `batch`; one DuckDB connection for each task."""

    def run(batches):
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1})
        try:
            for batch in batches:
                for part in byte_slices(batch, text, SLICE_BYTES):
                    con.register("batch", pa.Table.from_batches([part]))
                    made = con.sql(sql).fetch_arrow_table()
                    con.unregister("batch")
                    yield from made.cast(target).to_batches()
        finally:
            con.close()

    kinds = {"long": pa.int64(), "string": pa.string()}
    target = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])
    return bounded(df).mapInArrow(run, schema)


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def transform(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row per document: doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars, output (the rearranged text).

    Lines keep their ends; prefix and middle end after the smaller and the larger of two drawn numbers of lines, the draws
    being 32-bit groups of SHA-256 of seed and doc_id (a null doc_id draws as the empty string). Null and empty texts and
    those that hold a mark stay plain, with null lengths. Documents do not meet, so nothing is shuffled; repeated rows and
    ties in doc_id are rows of their own, an empty table gives none, extra columns are ignored. A worker holds a slice
    of some 16 MB, or one longer text.
    """
    return over_batches(_slim(docs), transform_sql(plan), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(outputs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, form, restored: the exact text again, from doc_id, form and output (null if the output is)."""
    slim = outputs.select(F.col("doc_id").cast("long").alias("doc_id"), "form", "output")
    sql = f"SELECT doc_id, form, restored FROM ({restore_sql(plan, 'SELECT doc_id, form, output FROM batch')})"
    return over_batches(slim, sql, "doc_id long, form string, restored string", "output")


def measure(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """`transform` and `restore` in one pass, with digests in place of the texts."""
    sql = digest_sql(restore_sql(plan, transform_sql(plan)))
    return over_batches(_slim(docs), sql, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
