"""From source texts to graph rows: chunks, relation lines, cards, entities, edges, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, pascal
from .lineage import numbered

#: Size and overlap of a chunk, and labels of a tail that a relation allows.
CHUNK, OVERLAP, LEAST = 8000, 800, 1000
TAIL_LABELS = {
    "HAS_ANOMALY": ("Anomaly", "Defect", "Pattern"),
    "HAS_DEFECT": ("Defect", "Anomaly"),
    "HAS_PATTERN": ("Pattern",),
    "HAS_MORPHOLOGY": ("Morphology",),
    "OCCURS_ON": ("Location", "Object", "ProcessUnit"),
    "HAS_VARIABLE": ("Variable",),
    "AFFECTS_VARIABLE": ("Variable",),
    "BELONGS_TO_UNIT": ("ProcessUnit",),
    "INDICATES": ("Fault", "CandidateCause", "Mechanism", "Anomaly"),
    "POSSIBLY_CAUSES": ("Fault", "CandidateCause", "Mechanism", "Anomaly", "Defect", "Pattern"),
    "HAS_PLAUSIBLE_CAUSE": ("CandidateCause", "Fault", "Mechanism"),
    "SUGGESTS_MECHANISM": ("Mechanism",),
    "REQUIRES_EVIDENCE": ("EvidenceSource", "Variable"),
}


def spans(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Where chunks begin and end: at the last newline beyond max(LEAST, size / 2), else at the full size, with overlap."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            newline = text.rfind("\n", at + max(LEAST, size // 2), end)
            end = newline if newline > at else end
        out.append((at, end))
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def chunk_rows(text: str | None, size: int = CHUNK, overlap: int = OVERLAP):
    """chunk, start, end, first_line, last_line, text of every chunk of a text, trimmed; blank chunks are left out."""
    n, t = 0, text or ""
    for a, b in spans(t, size, overlap):
        part = t[a:b]
        if part.strip():
            lead = len(part) - len(part.lstrip())
            own = part.strip()
            first = t.count("\n", 0, a + lead) + 1
            yield n, a + lead, a + lead + len(own), first, first + own.count("\n"), own
            n += 1


CHUNK_SCHEMA = "chunk int, start long, end long, first_line long, last_line long, text string"


def chunk(docs: DataFrame, key: str, text: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key and, for every chunk of its text, what `chunk_rows` gives."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([(k, *row) for k, t in zip(pdf[key], pdf[text]) for row in chunk_rows(t, size, overlap)], columns=[key, *[c.split()[0] for c in CHUNK_SCHEMA.split(", ")]])

    return docs.select(key, text).mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, {CHUNK_SCHEMA}")


def register_chunks(spark: SparkSession, name: str = "chunks") -> None:
    """The table function name(text [, size [, overlap]]) for SQL: SELECT ... FROM docs, LATERAL chunks(docs.text)."""

    class Chunks:
        def eval(self, text: str, size: int = CHUNK, overlap: int = OVERLAP):
            yield from chunk_rows(text, size, overlap)

    schema = CHUNK_SCHEMA.replace(" end ", " `end` ")
    spark.udtf.register(name, F.udtf(Chunks, returnType=schema, useArrow=True))


def relation_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """head, relation, tail of lines of the form `Head RELATION Tail.`"""
    pattern = r"^\s*([A-Za-z][A-Za-z0-9 ]*?)\s+([A-Z][A-Z]+(?:_[A-Z]+)*)\s+([A-Za-z][A-Za-z0-9 ]*?)\s*\.?\s*$"
    part = lambda i, n: F.regexp_extract(column, pattern, i).alias(n)
    return lines.select("*", part(1, "head"), part(2, "relation"), part(3, "tail")).where("relation <> ''")


def dedupe_cards(cards: DataFrame) -> DataFrame:
    """One card for each (scenario, claim), numbered in their order over all scenarios; the first unit stands for it."""
    key = normalize(F.col("claim"))
    one = cards.withColumn("claim_key", key).where("claim_key <> ''").groupBy("scenario", "claim_key").agg(F.min_by("claim", "unit_id").alias("claim"), F.min("unit_id").alias("unit_id"), F.count("*").alias("copies"))
    return numbered(one, ["scenario", "claim_key"], "_n").withColumn("card_id", F.format_string("card_%04d", F.col("_n"))).drop("_n")


def upsert_entities(rows: DataFrame) -> DataFrame:
    """One entity for each (name, scenario): the first spelling, all aliases and cards; its id in Pascal case.

    Where two scenarios have the same id, all but the first take their scenario as a prefix; where that is taken too, all
    but the first take six digits of the hash of their name and scenario as well.
    """
    key = normalize(F.col("name"))
    out = rows.withColumn("name_key", key).where("name_key <> ''").groupBy("name_key", "scenario").agg(
        F.min_by("name", "card_id").alias("name"), F.array_sort(F.collect_set("card_id")).alias("cards"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases")
    )
    nth = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("scenario", "name_key"))
    prefix = F.when(F.col("scenario") == "shared", "Shared").otherwise(pascal(F.col("scenario")))
    out = out.withColumn("_id", pascal(F.col("name"))).withColumn("_n", nth("_id")).withColumn("_id", F.when(F.col("_n") == 1, F.col("_id")).otherwise(F.concat(prefix, "_id")))
    digest = F.substring(F.sha1(F.concat_ws("|", "name_key", "scenario")), 1, 6)
    return out.withColumn("_n", nth("_id")).withColumn("id", F.when(F.col("_n") == 1, F.col("_id")).otherwise(F.concat("_id", digest))).drop("_id", "_n")


def upsert_edges(rows: DataFrame) -> DataFrame:
    """One edge for each (head, relation, tail, scenario): the largest confidence, its weight, all sources, the first evidence."""
    out = rows.where("head <> tail").groupBy("head", "relation", "tail", "scenario").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("source")).alias("sources"), F.min_by("evidence", "card_id").alias("evidence"), F.count("*").alias("copies"))
    return out.withColumn("weight", F.round(1 - F.col("confidence"), 6))


def wrong_types(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose tail has a label that the relation does not allow, or is no node at all, and self edges."""
    labels = nodes.select(F.col("id").alias("tail"), F.col("label").alias("tail_label"))
    bad = F.lit(False)
    for relation, allowed in TAIL_LABELS.items():
        bad = bad | ((F.col("relation") == relation) & ~F.coalesce(F.col("tail_label").isin(*allowed), F.lit(False)))
    return edges.join(labels, "tail", "left").where(bad | (F.col("head") == F.col("tail")))


def resolve(names: DataFrame, entities: DataFrame) -> DataFrame:
    """name, scenario, id of the entity that a name means: by id, Pascal id, id or name as a key, then alias.

    entities: id, name, scenario, aliases, ord. Of the entities in scope the first kind of match counts, then the first entity.
    """
    way = lambda p, k: F.struct(F.lit(p).alias("p"), k.alias("k"))
    ways = F.concat(F.array(way(0, F.col("id")), way(2, normalize(F.col("id"))), way(3, normalize(F.col("name")))), F.transform("aliases", lambda a: way(4, normalize(a))))
    e = entities.select("id", F.col("scenario").alias("scope"), "ord", F.explode(ways).alias("m")).select("id", "scope", "ord", "m.p", "m.k")
    name, key = F.col("name"), normalize(F.col("name"))
    wanted = F.array(way(0, name), way(0, pascal(name)), way(2, key), way(3, key), way(4, key))
    asked = names.select("name", "scenario").distinct().select("name", "scenario", F.explode(wanted).alias("m")).select("name", "scenario", "m.p", "m.k").distinct()
    hit = asked.join(e, ["p", "k"]).where("scope in (scenario, 'shared')")
    return hit.groupBy("name", "scenario").agg(F.min_by("id", F.struct("p", "ord")).alias("id"))


def domain_profiles(edges: DataFrame, by: str = "head") -> DataFrame:
    """For each node the sorted set of tails by relation."""
    return edges.groupBy(by, "relation").agg(F.array_sort(F.collect_set("tail")).alias("tails"))


def merge_profiles(*sources: DataFrame) -> DataFrame:
    """Profile rows (scenario, profile, first_key, second_key, ...) of several sources as one; of rows with equal keys that of the earliest source, and of its first ord, stays."""
    every = None
    for i, s in enumerate(sources):
        s = s.withColumn("_source", F.lit(i))
        every = s if every is None else every.unionByName(s)
    w = Window.partitionBy("scenario", "profile", "first_key", "second_key").orderBy("_source", "ord")
    return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_source")


def graph_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sizes, shared and Jaccard of two sets of keys; two empty sets are the same."""
    both = left.select(key).distinct().withColumn("a", F.lit(1)).join(right.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    n = both.agg(F.count("a").alias("left"), F.count("b").alias("right"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("shared"), F.count("*").alias("total"))
    return n.select("left", "right", "shared", F.round(F.when(F.col("total") > 0, F.col("shared") / F.col("total")).otherwise(F.lit(1.0)), 6).alias("jaccard"))


def shared_sample(left: DataFrame, right: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The first n keys, in order, that both graphs have: the sample of a comparison."""
    return left.select(key).intersect(right.select(key)).orderBy(key).limit(n)
