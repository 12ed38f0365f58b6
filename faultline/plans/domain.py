"""The knowledge graph, the cases and the series that the driver's tables stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import normalize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scenario(key: Column) -> Column:
    return F.when(key % 3 == 0, "mvtec").when(key % 3 == 1, "tep").otherwise("wafer")


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def kg_nodes(spark: SparkSession, d: str) -> DataFrame:
    """id, name, label, scenario, aliases: regions, nations, suppliers, parts and market segments."""
    none = F.array().cast("array<string>")

    def of(name, node_id, title, label, scope, aliases=none):
        return table(spark, d, name).select(node_id.alias("id"), F.col(title).alias("name"), F.lit(label).alias("label"), scope.alias("scenario"), aliases.alias("aliases"))

    shared = F.lit("shared")
    parts = (
        of("region", _id("R", "r_regionkey"), "r_name", "Location", shared),
        of("nation", _id("N", "n_nationkey"), "n_name", "ProcessUnit", shared),
        of("supplier", _id("S", "s_suppkey"), "s_name", "Object", scenario(F.col("s_suppkey"))),
        of("part", _id("P", "p_partkey"), "p_name", "AnomalyType", scenario(F.col("p_partkey")), F.array("p_type", "p_brand")),
        of("customer", _id("M", "c_mktsegment"), "c_mktsegment", "RootCause", shared).distinct(),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def kg_edges(spark: SparkSession, d: str) -> DataFrame:
    """head, relation, tail, scenario, confidence, support, source, edge_id."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    kept = F.round(1 - F.avg("l_discount"), 6).alias("confidence")

    def shape(df, head, relation, tail, scope, source):
        return df.select(head.alias("head"), F.lit(relation).alias("relation"), tail.alias("tail"), scope.alias("scenario"), "confidence", F.col("support").cast("long").alias("support"), F.lit(source).alias("source"))

    pairs = lines.groupBy("l_partkey", "l_suppkey").agg(kept, F.count("*").alias("support"))
    places = lines.where("l_suppkey % 2 = 0").groupBy("l_partkey", "s_nationkey").agg(kept, F.count("*").alias("support"))
    customers = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("support"))
    share = customers.withColumn("confidence", F.round(F.col("support") / F.sum("support").over(Window.partitionBy("c_nationkey")), 6))
    fixed = lambda df, x: df.withColumns({"confidence": F.lit(x), "support": F.lit(1)})
    shared = F.lit("shared")
    edges = (
        shape(pairs, _id("P", "l_partkey"), "OCCURS_ON", _id("S", "l_suppkey"), scenario(F.col("l_partkey")), "lineitem"),
        shape(places, _id("P", "l_partkey"), "HAS_LOCATION", _id("N", "s_nationkey"), scenario(F.col("l_partkey")), "lineitem"),
        shape(fixed(table(spark, d, "supplier"), 0.9), _id("S", "s_suppkey"), "BELONGS_TO_UNIT", _id("N", "s_nationkey"), scenario(F.col("s_suppkey")), "supplier"),
        shape(fixed(table(spark, d, "nation"), 0.95), _id("N", "n_nationkey"), "PART_OF", _id("R", "n_regionkey"), shared, "nation"),
        shape(share, _id("N", "c_nationkey"), "HAS_PLAUSIBLE_CAUSE", _id("M", "c_mktsegment"), shared, "customer"),
    )
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out.withColumn("edge_id", F.concat_ws("|", "head", "relation", "tail", "scenario"))


def _in_order():
    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")


def case_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of every order whose part, supplier and nation are known, in a total order: case_id, nth, part, supplier and nation of each."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    lines = lines.join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # a nation table has a row for each country
    return lines.withColumn("nth", F.row_number().over(_in_order()))


def evidence_cases(spark: SparkSession, d: str) -> DataFrame:
    """One case for each order with lines: its first line is the anomaly, the others' parts are variables."""
    lines = case_lines(spark, d)
    first = lines.where("nth = 1").select(
        F.concat(F.lit("case_"), F.col("l_orderkey").cast("string")).alias("case_id"),
        "l_orderkey",
        scenario(F.col("l_partkey")).alias("dataset"),
        F.col("s_name").alias("object"),
        _id("P", "l_partkey").alias("anomaly_type"),
        F.col("p_name").alias("anomaly_name"),
        F.col("n_name").alias("location"),
        F.round(F.col("l_discount") * 10, 4).alias("confidence"),
        F.col("l_quantity").alias("quantity"),
    )
    return first


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """case_id, dataset, field, ord, mention: object, anomaly_type and location, then a variable for each other line whose part the case's dataset knows.

    Every seventh order's location lacks a letter, and so do the objects that are suppliers whose numbers 25 divides;
    the location of the order after every seventh is nothing that is known.
    """
    lines = case_lines(spark, d).withColumn("first_part", F.first("l_partkey").over(_in_order()))
    one = lambda field, ord_, mention: F.struct(F.lit(field).alias("field"), ord_.cast("int").alias("ord"), mention.alias("mention"))
    place = F.when(F.col("l_orderkey") % 7 == 0, F.regexp_replace("n_name", "TI", "T")).when(F.col("l_orderkey") % 7 == 1, "QQ").otherwise(F.col("n_name"))
    thing = F.when(F.col("l_suppkey") % 25 == 0, F.substring("s_name", 2, 100)).otherwise(F.col("s_name"))
    part = _id("P", "l_partkey")
    fixed = F.array(one("object", F.lit(0), thing), one("anomaly_type", F.lit(1), part), one("location", F.lit(2), place))
    said = F.when(F.col("nth") == 1, fixed).otherwise(F.array(one("variable", F.col("nth") + 1, part)))
    lines = lines.where((F.col("nth") == 1) | (scenario(F.col("l_partkey")) == scenario(F.col("first_part"))))
    rows = lines.select(_id("case_", "l_orderkey").alias("case_id"), scenario(F.col("first_part")).alias("dataset"), F.explode(said).alias("m"))
    return rows.select("case_id", "dataset", "m.*").withColumn("mention_key", normalize(F.col("mention")))


def series(spark: SparkSession, d: str) -> DataFrame:
    """events as runs: fault (event_type), run (user_id), sample (from 1 in time order), value, k."""
    w = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    events = table(spark, d, "events")
    return events.select(
        F.col("event_type").alias("fault"),
        F.col("user_id").alias("run"),
        F.row_number().over(w).alias("sample"),
        F.col("value").cast("double").alias("value"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        "event_id",
        "ts",
    )


def grid(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as maps: supplier is the map, (line number, quantity mod 7) the cell, the return flag its value."""
    flag = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("grid_id"), F.col("l_linenumber").cast("int").alias("row"), (F.col("l_quantity").cast("int") % 7).alias("col")).agg(F.max(flag).alias("value"))


def anchors(spark: SparkSession, d: str) -> DataFrame:
    """embeddings in long form: vec_id, anchor (label), feature, value."""
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("anchor"), F.posexplode("embedding").alias("feature", "value")).withColumn("value", F.col("value").cast("double"))
