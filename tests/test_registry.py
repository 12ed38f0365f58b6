"""Shuffles have partitions by the size of the tables, in a session of their own."""

from faultline.queries import registry


def test_partitions_grow_with_the_largest_table(spark, monkeypatch, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert registry.sized(spark, str(tmp_path)) is spark
    monkeypatch.setattr(registry, "ROWS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "123456")
    try:
        queries, _, query = registry.registry()
        query("SELECT 1")(_asked)
        own = queries["_asked"](spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert own.conf.get("spark.sql.shuffle.partitions") == "100" and own.conf.get("spark.sql.autoBroadcastJoinThreshold") == "123456"
    assert own.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def _asked(spark, d):
    return spark


def test_root_causes_read_what_is_sold_once(spark):
    from faultline.queries import analysis

    market = analysis._market(spark, "/root/testdata/sf0.001")
    read = [f for df in (market.contributions, market.nodes, market.edges) for f in df.inputFiles()]
    assert read and not any(t in f for f in read for t in ("lineitem", "customer"))
