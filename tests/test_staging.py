import pytest

from marginalia.sources import staging


class Session:
    def __init__(self, master, folder):
        self.sparkContext = type("C", (), {"master": master})
        self.conf = type("D", (), {"get": staticmethod(lambda k, default=None: folder if k == "spark.checkpoint.dir" else default)})


def test_the_session_names_the_folder():
    assert staging.shared_dir(Session("spark://host:1", "hdfs://x/y/")) == "hdfs://x/y"
    assert staging.shared_dir(Session("local[2]", None)).startswith("file://")
    for master in ("spark://host:1", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            staging.shared_dir(Session(master, None))


def test_staged_rows_stay(spark):
    from pyspark.sql import functions as F

    d = staging.staged(spark.range(20).withColumn("x", F.rand()))
    assert d.collect() == d.collect()
