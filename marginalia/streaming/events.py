"""Annotation events as a stream: latest state, compaction, windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_state(events: DataFrame, key: Sequence[str], order: Sequence[str], *, deleted: str | None = None) -> DataFrame:
    """The last event of each key; with `deleted`, keys whose last event is a deletion are gone. Batch or complete-mode stream."""
    rest = [c for c in events.columns if c not in key]
    out = events.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_e")).select(*key, "_e.*")
    return out.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else out


def changes(before: DataFrame, after: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key, old, new) where the value differs: edits that were taken back leave nothing."""
    a, b = before.select(*key, F.col(value).alias("old")), after.select(*key, F.col(value).alias("new"))
    return a.join(b, list(key), "full").where(~F.col("old").eqNullSafe(F.col("new")))


def compacted(events: DataFrame, key: Sequence[str], order: str, op: str) -> DataFrame:
    """One event (insert, update or delete) for each key that does what all of its did: an insert with later updates is an insert of the last values, one with a delete nothing. The others keep their last event."""
    rest = [c for c in events.columns if c not in key]
    out = events.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_e"), F.min_by(op, order).alias("_first")).select(*key, "_e.*", "_first")
    born = F.col("_first") == "insert"
    out = out.where(~(born & (F.col(op) == "delete")))
    return out.withColumn(op, F.when(born, "insert").otherwise(F.col(op))).drop("_first").select(*events.columns)


def upsert_stream(events: DataFrame, path: str, checkpoint: str, key: Sequence[str], order: Sequence[str], *, buckets: int = 64) -> StreamingQuery:
    """Keeps the latest state of a stream of events under path, in buckets by the key's hash; read_state() reads it.

    A batch merges only the buckets that its keys fall into: each of them gets a new version, the others' files stay as they are.
    A small file tells each bucket's version after batch N; it is written when the versions are whole, and a batch that is run
    again starts from the one before, so each event counts once. Versions that only older batches name are deleted, but for the last one's.
    """
    from pyspark.sql.functions import pmod, xxhash64

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        versions = _versions(spark, path, before=n)
        rows = batch.withColumn("_b", pmod(xxhash64(*key), F.lit(buckets)).cast("int"))
        hit = sorted(r["_b"] for r in rows.select("_b").distinct().collect())  # `buckets` at most
        if not hit and n:
            return
        old = [f"{path}/v={versions[b]}/_b={b}" for b in hit if b in versions]
        both = rows.drop("_b")
        if old:
            both = spark.read.schema(batch.schema).parquet(*old).unionByName(both)
        now = latest_state(both, key, order).select(*batch.columns).withColumn("_b", pmod(xxhash64(*key), F.lit(buckets)).cast("int"))
        now.repartition("_b").write.mode("overwrite").partitionBy("_b").parquet(f"{path}/v={n}")
        new = versions | dict.fromkeys(hit, n)
        spark.createDataFrame([(b, v) for b, v in new.items()], "b int, v long").coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/n={n}")
        keep = set(versions.values()) | set(new.values())
        fs, p = _fs(spark, path)
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if name.startswith("v=") and int(name[2:]) not in keep and int(name[2:]) < n:
                fs.delete(s.getPath(), True)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _fs(spark, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _versions(spark, path: str, before: int | None = None) -> dict[int, int]:
    """Each bucket's version after the last batch, or after the last one before `before`."""
    fs, p = _fs(spark, f"{path}/versions")
    done = [int(s.getPath().getName()[2:]) for s in fs.listStatus(p)] if fs.exists(p) else []
    done = [n for n in done if before is None or n < before]
    return {r.b: r.v for r in spark.read.parquet(f"{path}/versions/n={max(done)}").collect()} if done else {}


def state_files(spark, path: str) -> list[str]:
    """The folders that hold the present state, one for each bucket."""
    return [f"{path}/v={v}/_b={b}" for b, v in sorted(_versions(spark, path).items())]


def read_state(spark, path: str) -> DataFrame:
    """The state that upsert_stream() left at path."""
    return spark.read.parquet(*state_files(spark, path))


def windowed_counts(events: DataFrame, *, ts: str = "ts", kind: str = "event_type", length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window start, kind, n): events by tumbling windows; in a stream those later than the watermark are dropped."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, length).start.alias("start"), kind).agg(F.count("*").alias("n"))
