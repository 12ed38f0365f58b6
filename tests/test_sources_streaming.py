import json

import pytest
from pyspark.sql import functions as F

from faultline.sources import readers, writers
from faultline.streaming import windows


def test_graph_files_round_trip(spark, tmp_path):
    (tmp_path / "nodes.csv").write_text("id,name,label,scenario,aliases,description\nA, Anode ,Object,mvtec,a1|a2; a3,x\nB,Bnode,RootCause,shared,,\n")
    (tmp_path / "edges.csv").write_text("head,relation,tail,scenario,source,evidence,confidence,weight,review_status,feedback_count,accepted_count,rejected_count,propagation_enabled,rca_score\nA,R,B,mvtec,s,e,0.5,,auto,0,0,0,Yes,bad\n")
    nodes = readers.read_nodes(spark, [str(tmp_path / "nodes.csv"), str(tmp_path / "none.csv")], skip_missing=True)
    edges = readers.read_edges(spark, str(tmp_path / "edges.csv"))
    assert [(r["name"], r["aliases"]) for r in nodes.orderBy("id").collect()] == [("Anode", ["a1", "a2", "a3"]), ("Bnode", [])]
    e = edges.first()
    assert (e["edge_id"], e["weight"], e["propagation_enabled"], e["edge_weight"], e["attenuation"], e["bad_cells"]) == ("A|R|B|mvtec", 0.0, True, None, 1.0, ["rca_score"])
    writers.write_graph(nodes, edges, str(tmp_path / "out"))
    again = readers.read_nodes(spark, str(tmp_path / "out/nodes"))
    assert again.count() == 2 and readers.read_edges(spark, str(tmp_path / "out/edges")).first()["confidence"] == 0.5
    with pytest.raises(ValueError, match="missing columns accepted_count"):
        readers.read_edges(spark, str(tmp_path / "nodes.csv"))


def test_records_and_evidence(spark, tmp_path):
    rows = [{"case_id": "a", "dataset": "mvtec", "confidence": 0.4}, {"case_id": "b", "dataset": "tep", "confidence": 1.4}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "r.json").write_text(json.dumps({"records": rows}))
    (tmp_path / "l.json").write_text(json.dumps(rows))
    assert [readers.read_records(spark, str(tmp_path / n)).count() for n in ("r.jsonl", "r.json", "l.json")] == [2, 2, 2]
    assert {r["case_id"]: r["valid"] for r in readers.read_evidence(spark, str(tmp_path / "l.json")).collect()} == {"a": True, "b": False}
    assert readers.read_artifact(spark, str(tmp_path), ["no.json", "l.json"]).count() == 2 and readers.read_artifact(spark, str(tmp_path), ["no"]) is None


def test_series_and_texts(spark, tmp_path):
    (tmp_path / "s.csv").write_text("faultNumber,simulationRun,sample,xmv_1,xmeas_10,xmeas_2\n1,1,1,1.0,2.0,3.0\n")
    assert readers.read_series(spark, str(tmp_path / "s.csv")).columns == ["fault", "run", "sample", "xmeas_2", "xmeas_10", "xmv_1", "seq"]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/a.md").write_text("one\ntwo")
    (tmp_path / "deep/b.bin").write_text("no")
    assert [r["text"] for r in readers.read_texts(spark, str(tmp_path / "deep")).collect()] == ["one\ntwo"]
    cells = readers.wafer_cells(spark.createDataFrame([("w", [[1, 2], [3]])], "id string, m array<array<int>>"), "id", "m")
    assert cells.count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", [1]), ("b", [2])], "case_id string, v array<int>")
    writers.write_cases(df, str(tmp_path / "c"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        writers.write_cases(df, str(tmp_path / "c"))
    with pytest.raises(ValueError):
        writers.write_cases(df.union(df), str(tmp_path / "d"))
    writers.write_table(df, str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).where("v = '[1]'").count() == 1
    new = spark.createDataFrame([("b", [3], 1), ("b", [4], 2), ("c", [5], 1)], "case_id string, v array<int>, ord int")
    assert {(r["case_id"], r["v"][0]) for r in writers.merge(df, new, ["case_id"]).collect()} == {("a", 1), ("b", 4), ("c", 5)}
    assert tuple(writers.merge_counts(df, new, ["case_id"]).first()) == (1, 1)
    scaled = spark.createDataFrame([("g", 1.0), ("g", 3.0), ("h", 2.0)], "g string, v double").withColumn("m", writers.min_max(F.col("v"), ["g"]))
    assert sorted(r["m"] for r in scaled.collect()) == [0.0, 0.0, 1.0]


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    full = run(windows.tumbling(stream()), "tumbling", "complete")
    assert full.agg(F.sum("n")).first()[0] == events.count()
    got = run(windows.first_windows(stream(), 3), "firsts")
    want = events.groupBy("event_type", "user_id").count().where("count >= 3").count()
    assert got.count() == want and all(len(r["values"]) == 3 for r in got.collect())


def test_flat_and_nested_images(spark, tmp_path):
    for name in ("bottle/test/scratch/1.png", "bottle/ground_truth/scratch/1_mask.png", "cable/bent/7.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = {(r["object"], r["split"], r["defect"], r["stem"], r["mask_path"] is not None) for r in readers.read_images(spark, str(tmp_path)).collect()}
    assert got == {("bottle", "test", "scratch", "1", True), ("cable", "test", "bent", "7", False)}


def test_texts_come_once_and_up_to_a_limit(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"t{i}.txt").write_text(f"text {i}")
    root = str(tmp_path)
    assert readers.read_texts(spark, [root, f"{root}/t1.txt"]).count() == 4
    assert [r["text"] for r in readers.read_texts(spark, root, 2).orderBy("path").collect()] == ["text 0", "text 1"]


def test_summary_of_a_run(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    table = writers.run_summary(
        one([("c", "mvtec", "scratch", "rim", "linear"), ("d", "tep", "f", None, None)], "case_id string, dataset string, anomaly_type string, location string, morphology string"),
        one([("c", "X"), ("c", None)], "case_id string, entity_id string"),
        one([("c", 0.7), ("d", 1.0)], "case_id string, consistency_score double"),
        one([("c", 1)], "case_id string, rank int"),
        one([("c", 1, "K", 0.5), ("c", 2, "L", 0.4)], "case_id string, rank int, target_id string, score double"),
        one([("K", "cause", "RootCause")], "id string, name string, label string"),
    )
    assert table.columns == list(writers.SUMMARY_COLUMNS) and len(table.columns) == 16
    got = {r["case_id"]: r for r in table.collect()}
    assert (got["c"]["linked_entity_count"], got["c"]["correction_candidate_count"], got["c"]["path_count"], got["c"]["top_target_name"], got["c"]["best_score"]) == (1, 1, 2, "cause", 0.5)
    assert got["d"]["path_count"] == 0 and got["d"]["top_target_entity_id"] is None and got["d"]["consistency_score"] == 1.0
