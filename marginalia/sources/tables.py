"""Readers and writers of tables by extension, and of annotation databases."""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest


def extension(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """csv and tsv (with a header, all columns text without a schema), jsonl, json, parquet, pq, orc, feather. Another extension raises."""
    kind = extension(path)
    r = spark.read.schema(schema) if schema else spark.read
    if kind in ("csv", "tsv"):
        return r.csv(path, header=True, sep="\t" if kind == "tsv" else ",", multiLine=True, escape='"', encoding="UTF-8", enforceSchema=False)
    if kind in ("jsonl", "json"):
        return r.json(path)
    if kind in ("parquet", "pq"):
        return r.parquet(path)
    if kind == "orc":
        return r.orc(path)
    if kind == "feather":
        import pyarrow.feather

        t = pyarrow.feather.read_table(path, memory_map=True)
        if t.nbytes > 1 << 30:
            raise ValueError("a feather file is read by the driver; convert one beyond 1 GB to parquet")
        return spark.createDataFrame(t.to_pandas())
    raise ValueError(f"unknown table format: {path}")


def write_table(df: DataFrame, path: str, *, mode: str = "error", partition_by: Sequence[str] = ()) -> None:
    """csv, tsv, jsonl, json, parquet, pq, orc by extension, as a folder that appears whole or not at all. Nested columns become JSON text in csv and tsv."""
    kind = extension(path)
    w = lambda d: d.write.mode(mode).partitionBy(*partition_by)
    if kind in ("csv", "tsv"):
        flat = [F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c) for c in df.columns]
        w(df.select(*flat)).csv(path, header=True, sep="\t" if kind == "tsv" else ",", escape='"')
    elif kind in ("jsonl", "json"):
        w(df).json(path)
    elif kind in ("parquet", "pq"):
        w(df).parquet(path)
    elif kind == "orc":
        w(df).orc(path)
    else:
        raise ValueError(f"unknown table format: {path}")


def read_documents(spark: SparkSession, path: str, required: Sequence[str] = ("patient_icn", "text")) -> DataFrame:
    """A corpus file with its columns renamed, other columns in a map `metadata`; a byte-order mark and rows without a patient are dropped."""
    d = read_table(spark, path)
    d = d.toDF(*[c.lstrip("﻿") for c in d.columns])
    out = ingest.split_metadata(d, required)
    return out.where(F.coalesce(F.trim("patient_icn") != "", F.lit(False))) if "patient_icn" in out.columns else out


def read_sqlite(spark: SparkSession, paths: Sequence[str], query: str, schema: str) -> DataFrame:
    """The rows of one query over many SQLite files on shared storage, with `path`; a file for each task, opened read-only."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches):
        for p in batches:
            for path in p["path"]:
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
                    cur = c.execute(query)
                    while rows := cur.fetchmany(10_000):
                        yield pd.DataFrame(rows, columns=names).assign(path=path)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInPandas(run, f"{schema}, path string")


def nested_by_unit(pred: DataFrame) -> DataFrame:
    """(unit_id, predictions): each unit's rows as one JSON array."""
    rest = [c for c in pred.columns if c != "unit_id"]
    return pred.groupBy("unit_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rest)))).alias("predictions"))


def write_manifest(path: str, content: dict) -> None:
    """A JSON file of the driver that is replaced in one step."""
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        json.dump(content, f, sort_keys=True, indent=1)
    os.replace(f"{path}.part", path)
