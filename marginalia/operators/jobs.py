"""Resumable batch jobs, their checks and their statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def batches(units: DataFrame, size: int = 128, *, unit: str = "unit_id") -> DataFrame:
    """units with batch_id, counted from 0 in the order of unit.

    Ranks come from sorted ranges: each range is ranked by itself and starts after the rows of those before, so no task sorts all units.
    """
    ranged = units.select(unit).repartitionByRange(F.col(unit)).sortWithinPartitions(unit).withColumn("_part", F.spark_partition_id())
    ranged = staged(ranged)  # the ranges are sampled: both uses below have to see the same ones
    ranked = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(unit)))
    sizes = ranked.groupBy("_part").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranked.join(before, "_part").select(unit, F.floor((F.col("_n") + F.col("_b") - 1) / size).cast("long").alias("batch_id"))


def pending(jobs: DataFrame, done: DataFrame, key: str = "batch_id") -> DataFrame:
    """Batches that aren't done yet."""
    return jobs.join(done.select(key).distinct(), key, "left_anti")


def run_batches(inputs: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], *, key: str = "batch_id") -> DataFrame:
    """work over the batches that the folder at path doesn't hold yet, each added in one job; the result is all that the folder holds.

    A batch whose job failed left nothing behind (Spark commits whole jobs), so a second call does it again and no other.
    """
    spark = inputs.sparkSession
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
    todo = pending(inputs, spark.read.parquet(path), key) if there else inputs
    work(todo).write.mode("append").partitionBy(key).parquet(path)
    return spark.read.parquet(path)


def parity(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """One row (n_a, n_b, n_both, n_differ) for two results that should be equal."""
    both = a.select(*key, F.col(value).alias("_a"), F.lit(1).alias("_ia")).join(b.select(*key, F.col(value).alias("_b"), F.lit(1).alias("_ib")), key, "full")
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    ia, ib = F.col("_ia").isNotNull(), F.col("_ib").isNotNull()
    return both.agg(one(ia).alias("n_a"), one(ib).alias("n_b"), one(ia & ib).alias("n_both"), one(~(ia & ib) | ~F.col("_a").eqNullSafe(F.col("_b"))).alias("n_differ"))


def runtime_summary(rows: DataFrame, unit: str, order: str, seconds: str) -> DataFrame:
    """One row (n, mean, median, p95, least, most) over the first runtime of each unit."""
    first = rows.groupBy(unit).agg(F.min(F.struct(order, seconds)).alias("x")).select(F.col(f"x.{seconds}").alias("s"))
    return first.agg(F.count("s").alias("n"), F.avg("s").alias("mean"), F.median("s").alias("median"), F.percentile("s", 0.95).alias("p95"), F.min("s").alias("least"), F.max("s").alias("most"))


def sweep(frames: dict[str, DataFrame]) -> DataFrame:
    """All runs' rows as one tall frame with the run's name first; columns that a run lacks are null."""
    out = None
    for name, d in frames.items():
        one = d.select(F.lit(name).alias("run"), *d.columns)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def batch_manifest(jobs: DataFrame, outputs: DataFrame, *, key: str = "batch_id", unit: str = "unit_id") -> DataFrame:
    """(batch_id, n_units, n_done, status): completed where every unit of a batch has an output, partial where some have, else pending. Batches that come later join the same way."""
    out = jobs.join(outputs.select(key, unit).distinct().withColumn("_d", F.lit(1)), [key, unit], "left").groupBy(key).agg(F.count("*").alias("n_units"), F.count("_d").alias("n_done"))
    return out.withColumn("status", F.when(F.col("n_done") == F.col("n_units"), "completed").when(F.col("n_done") > 0, "partial").otherwise("pending"))


def prompt_counts(prompts: DataFrame, by: str, done) -> DataFrame:
    """(by, n_total, n_completed)."""
    return prompts.groupBy(by).agg(F.count("*").alias("n_total"), F.sum(F.when(done, 1).otherwise(0)).alias("n_completed"))


def limited(rows: DataFrame, work: Callable, schema: str, *, per_minute: float, workers: int = 1) -> DataFrame:
    """work(pandas frame) -> pandas frame over rows by `workers` tasks, which together begin at most per_minute calls a minute: calls of a task are spaced evenly. A call is one batch of at most spark.sql.execution.arrow.maxRecordsPerBatch rows."""
    gap = 60.0 * workers / per_minute

    def run(batches):
        import time

        free = 0.0
        for p in batches:
            now = time.monotonic()
            if now < free:
                time.sleep(free - now)
            free = max(now, free) + gap
            yield work(p)

    return rows.coalesce(workers).mapInPandas(run, schema)


class Cancellable:
    """Spark jobs under a tag of their own: `with Cancellable(spark, "run 3") as c: ...`, and c.cancel() from any thread ends those that run."""

    def __init__(self, spark, tag: str):
        self.spark, self.tag, self.cancelled = spark, "".join(c if c.isalnum() else "_" for c in tag), False

    def __enter__(self):
        self.spark.addTag(self.tag)
        return self

    def __exit__(self, *_):
        self.spark.removeTag(self.tag)

    def cancel(self) -> None:
        self.cancelled = True
        self.spark.interruptTag(self.tag)
