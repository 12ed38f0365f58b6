"""Where intermediate tables go, with and without a shared folder named by the session."""

import time

import pytest

from faultline.operators import lineage


class Session:
    """A session as far as the choice of a folder looks at it."""

    def __init__(self, spark, folder, master):
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default: folder)})
        self.sparkContext = type("Context", (), {"master": master, "_jvm": spark.sparkContext._jvm})


def test_folder_of_the_session(spark):
    assert lineage.shared_folder(Session(spark, "hdfs://a/b/", "yarn")) == "hdfs://a/b"
    assert lineage.shared_folder(Session(spark, "/mnt/shared", "spark://x:7077")) == "/mnt/shared"
    for folder, master in ((None, "yarn"), ("", "local-cluster[2,1,1024]"), ("some/where", "spark://x:7077")):
        with pytest.raises(ValueError):
            lineage.shared_folder(Session(spark, folder, master))


def test_local_run_without_the_setting(spark, monkeypatch):
    own = lineage.shared_folder(Session(spark, None, "local[4]"))
    assert own.startswith("file:///") and own == lineage.shared_folder(Session(spark, None, "local"))
    # a session whose configuration has no folder at all: the setting of the machine is hidden
    get = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: default[0] if key == "spark.checkpoint.dir" else get(self, key, *default))
    monkeypatch.setattr(type(spark.conf), "set", lambda self, key, value: pytest.fail(f"sets {key}"))
    df = lineage.cut(spark.range(10))
    assert df.count() == 10 and df.inputFiles()[0].startswith(own)


def test_steps_of_a_session_for_large_tables_leave_no_shuffle_files(spark):
    def files():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    def grown(session):
        before = files()
        df = lineage.cut(session.range(1000).selectExpr("id % 7 as k").groupBy("k").count())
        for _ in range(100):
            if files() <= before:
                break
            time.sleep(0.1)
        left = files() > before
        assert df.count() == 7
        return left

    own = spark.newSession()
    own.conf.set(lineage.SWEPT, "true")
    own.conf.set("spark.sql.adaptive.enabled", spark.conf.get("spark.sql.adaptive.enabled"))
    assert not grown(own)
    assert own.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
