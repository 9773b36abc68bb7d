"""What lies in a project's folders: assignment databases, corpora, external tables, patients and model answers."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Mapping, Sequence
from glob import glob

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import tables

ASSIGNMENTS = ("imports/*_assignment.db", "assignments/*/assignment.db", "*_assignment.db")
CORPUS_COLUMNS = {"patient_icn": ("patient_icn", "patienticn"), "doc_id": ("doc_id", "note_id"), "text": ("text", "document_text", "note_text"), "date_note": ("date_note", "note_date"), "metadata_json": ("metadata_json", "metadata")}


def assignment_files(round_dir: str) -> list[str]:
    """Assignment databases of a round's folder, each once, sorted."""
    found = {os.path.realpath(p): p for pattern in reversed(ASSIGNMENTS) for p in glob(os.path.join(round_dir, pattern))}
    return sorted(found.values())


def corpus_path(project: str, hints: Sequence[str] = (), names: Sequence[str] = ("corpus.db", "corpus/corpus.db", "corpus.parquet")) -> str | None:
    """The first corpus that exists: the hints (of round configurations), absolute or within the project, then the usual names; None without one."""
    for p in [*hints, *names]:
        at = p if os.path.isabs(p) else os.path.join(project, p)
        if p and os.path.exists(at):
            return at
    return None


def read_corpus(spark: SparkSession, path: str, table: str = "documents") -> DataFrame:
    """Documents of a SQLite corpus or of a table file under their usual names, whatever older names their columns have; columns that are missing are null."""
    if tables.extension(path) in ("db", "sqlite", "sqlite3"):
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
            have = [r[1] for r in c.execute(f'PRAGMA table_info("{table}")')]
        cols = [f'CAST("{x}" AS TEXT)' if (x := next((n for n in names if n in have), None)) else "NULL" for names in CORPUS_COLUMNS.values()]
        return tables.read_sqlite(spark, [path], f'SELECT {", ".join(cols)} FROM "{table}"', ", ".join(f"{k} string" for k in CORPUS_COLUMNS)).drop("path")
    d = tables.read_table(spark, path)
    pick = lambda names: F.coalesce(*[F.col(n).cast("string") for n in names if n in d.columns]) if any(n in d.columns for n in names) else F.lit(None).cast("string")
    return d.select(*[pick(names).alias(k) for k, names in CORPUS_COLUMNS.items()])


def read_patients(spark: SparkSession, path: str) -> DataFrame:
    """A patients file with its byte-order mark gone; rows without a patient_icn are left out."""
    d = tables.read_table(spark, path)
    d = d.toDF(*[c.lstrip("﻿").strip() for c in d.columns])
    return d.where(T.nonblank(F.col("patient_icn")).isNotNull())


def external_notes(data: DataFrame, level: str, columns: Mapping[str, str] | None = None) -> DataFrame:
    """A caller's table as notes (unit_id, patient_icn, doc_id, text, ...): columns renamed by the map; a missing doc_id is a hash of the row, a missing patient the document's, and the unit follows from the level. A table without text raises."""
    d = data.withColumnsRenamed({v: k for k, v in (columns or {}).items()})
    if "text" not in d.columns:
        raise ValueError("no text column")
    row = F.sha2(F.to_json(F.struct(*sorted(d.columns))), 256)
    have = lambda c: T.nonblank(F.col(c)) if c in d.columns else F.lit(None).cast("string")
    doc = F.coalesce(have("doc_id"), row)
    patient = F.coalesce(have("patient_icn"), doc)
    unit = F.coalesce(have("unit_id"), patient if level == "multi_doc" else doc)
    rest = [c for c in d.columns if c not in ("unit_id", "patient_icn", "doc_id")]
    return d.select(unit.alias("unit_id"), patient.alias("patient_icn"), doc.alias("doc_id"), *rest)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(unit_id, label_id, prediction_value) of JSON or JSON-lines files whose objects have a unit_id and {label}_llm fields; nested values become JSON text, nulls are left out."""
    raw = spark.read.option("multiLine", not path.rstrip("/").endswith("l")).json(path)
    llm = [c for c in raw.columns if c.endswith("_llm")]
    if not llm:
        return raw.select(F.col("unit_id").cast("string"), F.lit("").alias("label_id"), F.lit("").alias("prediction_value")).where(F.lit(False))
    value = lambda c: F.to_json(c) if raw.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(c).cast("string")
    each = F.explode(F.array(*[F.struct(F.lit(c[:-4]).alias("label_id"), value(c).alias("prediction_value")) for c in llm]))
    return raw.select(F.col("unit_id").cast("string").alias("unit_id"), each.alias("x")).select("unit_id", "x.*").where("prediction_value is not null")


def copy_database(source: str, target: str) -> None:
    """A SQLite database as it is now, with what its write-ahead log holds, under another name in one step."""
    with sqlite3.connect(f"file:{source}?mode=ro", uri=True) as a, sqlite3.connect(f"{target}.part") as b:
        a.backup(b)
    b.close()
    os.replace(f"{target}.part", target)
