"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where it may be unset, a temporary folder of this machine."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="marginalia-"))
    return _local[0]


def staged(df: DataFrame) -> DataFrame:
    """df as it is now, by a reliable checkpoint: later reads see the same rows in the same partitions, whatever executors are lost."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


_kept: list[tuple] = []


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder, which is deleted when Python ends. Made in one job, and with file statistics by which later joins are planned."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marginalia-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _kept.append((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for jvm, conf, path in _kept:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # noqa: BLE001  the JVM may have ended before
            pass
