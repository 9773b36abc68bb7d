"""Commands over tables: python -m marginalia.cli COMMAND --help."""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import agreement, consensus, export, ingest, jobs, labeling, prompts, sampling
from .sources import projects, tables
from .streaming import events


def _import_corpus(spark: SparkSession, a: argparse.Namespace) -> None:
    """Documents of a file are upserted into the corpus: a document that it has already is replaced."""
    new = tables.read_documents(spark, a.documents)
    if "doc_id" not in new.columns:
        new = new.withColumn("doc_id", F.lit(None).cast("string"))
    if "date_note" not in new.columns:
        new = new.withColumn("date_note", F.lit(None).cast("string"))
    new = ingest.auto_doc_ids(new.withColumn("position", F.monotonically_increasing_id()), position="position")
    new = new.select("patient_icn", "doc_id", "date_note", "text", F.to_json("metadata").alias("metadata_json"), F.lit(1).alias("_age"))
    old = spark.read.parquet(a.corpus).withColumn("_age", F.lit(0)) if os.path.exists(a.corpus) else new.limit(0)
    out = ingest.keep_last(old.unionByName(new), ["doc_id"], "_age").drop("_age")
    out.write.mode("overwrite").parquet(f"{a.corpus}.part")
    _replace(spark, f"{a.corpus}.part", a.corpus)


def _replace(spark: SparkSession, part: str, path: str) -> None:
    jvm = spark.sparkContext._jvm
    src, dst = jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(path)
    fs = src.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(dst, True)
    fs.rename(src, dst)


def _generate_round(spark: SparkSession, a: argparse.Namespace) -> None:
    """A stratified sample of the corpus, shared out among reviewers, as bundles and a manifest."""
    docs = projects.read_corpus(spark, a.corpus)
    units = docs.select(F.col("doc_id").alias("unit_id"), "patient_icn", "doc_id", *[F.get_json_object("metadata_json", f"$.{f}").alias(f) for f in a.stratify], F.col("doc_id").alias("position"))
    sample = sampling.stratified_sample(units, a.stratify, a.total, a.seed)
    given = sampling.allocate(sample, a.reviewers, a.overlap, a.seed)
    notes = sample.select("unit_id", "doc_id").withColumn("order_index", F.lit(0))
    export.write_bundles(given, notes, docs, a.labels, a.out)
    listed = given.join(sample.select("unit_id", "patient_icn", "doc_id", F.col("stratum").alias("strata")), "unit_id")
    tables.write_table(export.manifest(listed), f"{a.out}/manifest.csv", mode="overwrite")


def _annotations(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    out = None
    for p in paths:
        d = tables.read_table(spark, p)
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def _iaa(spark: SparkSession, a: argparse.Namespace) -> None:
    agreement.iaa(_annotations(spark, a.annotations)).orderBy("label_id").show(1000, truncate=False)


def _aggregate(spark: SparkSession, a: argparse.Namespace) -> None:
    ann = _annotations(spark, a.annotations)
    tables.write_table(ann, f"{a.out}/unit_annotations.parquet", mode="overwrite")
    for c, kind in (("label_value_num", "double"), ("label_value_date", "date"), ("na", "boolean")):
        if c not in ann.columns:
            ann = ann.withColumn(c, F.lit(None).cast(kind))
    export.write_gold(consensus.gold_labels(ann), a.out)


def _label(spark: SparkSession, a: argparse.Namespace) -> None:
    """Labels of a corpus by keyword rules (JSON: {label: {value: [keywords]}}), in batches; those of an earlier run that are whole aren't made again."""
    with open(a.rules, encoding="utf-8") as f:
        rules = json.load(f)
    docs = projects.read_corpus(spark, a.corpus).select(F.col("doc_id").alias("unit_id"), "text")
    todo = docs.join(jobs.batches(docs, a.batch_size), "unit_id")

    def work(d: DataFrame) -> DataFrame:
        return labeling.keyword_labels(d, rules, doc="unit_id").join(d.select("unit_id", "batch_id"), "unit_id")

    jobs.run_batches(todo, a.out, work)


def _precompute(spark: SparkSession, a: argparse.Namespace) -> None:
    with open(a.labels, encoding="utf-8") as f:
        labels = json.load(f)
    docs = projects.read_corpus(spark, a.corpus).select(F.col("doc_id").alias("unit_id"), F.substring("text", 1, a.max_chars).alias("context"))
    tables.write_table(prompts.single_prompts(docs, labels), a.out, mode="overwrite")


def _annotate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Adds one annotation event to a folder of JSON lines; `state` reads what holds."""
    row = [(a.unit, a.label, a.reviewer, a.value, a.na, a.at)]
    d = spark.createDataFrame(row, "unit_id string, label_id string, reviewer_id string, value string, na boolean, at double")
    d.coalesce(1).write.mode("append").json(a.events)


def _state(spark: SparkSession, a: argparse.Namespace) -> None:
    d = spark.read.schema("unit_id string, label_id string, reviewer_id string, value string, na boolean, at double").json(a.events)
    tables.write_table(events.latest_state(d, ["unit_id", "label_id", "reviewer_id"], ["at"]), a.out, mode="overwrite")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="marginalia", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, f, *args: tuple[str, dict]) -> None:
        p = sub.add_parser(name, help=(f.__doc__ or name).strip().split("\n")[0])
        for flag, how in args:
            p.add_argument(flag, **how)
        p.set_defaults(run=f)

    need, many = {"required": True}, {"nargs": "+", "required": True}
    command("import-corpus", _import_corpus, ("--documents", need), ("--corpus", need))
    command("generate-round", _generate_round, ("--corpus", need), ("--total", {"type": int, **need}), ("--reviewers", many), ("--labels", many), ("--overlap", {"type": int, "default": 0}), ("--seed", {"default": "1"}), ("--stratify", {"nargs": "*", "default": []}), ("--out", need))
    command("iaa", _iaa, ("--annotations", many))
    command("aggregate", _aggregate, ("--annotations", many), ("--out", need))
    command("precompute", _precompute, ("--corpus", need), ("--labels", need), ("--max-chars", {"type": int, "default": 12_000}), ("--out", need))
    command("infer", _label, ("--corpus", need), ("--rules", need), ("--batch-size", {"type": int, "default": 128}), ("--out", need))
    command("annotate", _annotate, ("--events", need), ("--unit", need), ("--label", need), ("--reviewer", need), ("--value", {}), ("--na", {"action": "store_true"}), ("--at", {"type": float, **need}))
    command("state", _state, ("--events", need), ("--out", need))
    return top


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    a.run(spark or SparkSession.builder.appName("marginalia").getOrCreate(), a)


if __name__ == "__main__":
    main()
