"""Corpus ingestion: ids, upserts, units and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALIASES = {
    "patienticn": "patient_icn",
    "patientid": "patient_icn",
    "icn": "patient_icn",
    "docid": "doc_id",
    "documentid": "doc_id",
    "noteid": "doc_id",
    "documenttext": "text",
    "notetext": "text",
    "text": "text",
    "datenote": "date_note",
    "notedate": "date_note",
}
CORE = ("patient_icn", "doc_id", "text", "date_note")


def canonical_columns(rows: DataFrame) -> DataFrame:
    """Columns renamed by ALIASES, matched without case and punctuation; the first of two that match one name has it."""
    taken: set[str] = set()
    out = []
    for c in rows.columns:
        name = ALIASES.get("".join(x for x in c.lower() if x.isalnum()), c)
        name = c if name in taken else name
        taken.add(name)
        out.append(F.col(f"`{c}`").alias(name))
    return rows.select(*out)


def split_metadata(rows: DataFrame, required: Sequence[str] = ("patient_icn", "text")) -> DataFrame:
    """Core columns, and a map `metadata` of all others that have a value; a missing required column raises."""
    r = canonical_columns(rows)
    if gone := [c for c in required if c not in r.columns]:
        raise ValueError(f"missing columns: {gone}")
    rest = [c for c in r.columns if c not in CORE]
    meta = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]), lambda k, v: v.isNotNull() & (F.trim(v) != "")) if rest else F.create_map().cast("map<string,string>")
    return r.select(*[c for c in CORE if c in r.columns], meta.alias("metadata"))


def auto_doc_ids(rows: DataFrame, *, patient: str = "patient_icn", doc: str = "doc_id", position: str = "position") -> DataFrame:
    """rows whose missing doc_id is {patient}_{number from 1 in order of position among the patient's rows without one}."""
    blank = F.coalesce(F.trim(doc) == "", F.lit(True))
    n = F.sum(blank.cast("int")).over(Window.partitionBy(patient).orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(doc, F.when(blank, F.format_string("%s_%05d", F.col(patient), n)).otherwise(F.col(doc)))


def keep_last(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The last row of each key, as upserts in that order leave it. Combined before the shuffle, so a hot key costs no more than another."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("_r")).select(*key, "_r.*").select(*rows.columns)


def keep_first(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The first row of each key, as insert-if-absent in that order leaves it."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("_r")).select(*key, "_r.*").select(*rows.columns)


def multi_doc_units(notes: DataFrame, *, patient: str = "patient_icn", doc: str = "doc_id", day: str = "date_note") -> DataFrame:
    """(unit_id, doc_ids, note_count): a unit per patient with its documents by date and id."""
    docs = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(day).cast("string"), F.lit("")).alias("d"), F.col(doc).alias("i")))), lambda x: x.i)
    return notes.groupBy(F.col(patient).alias("unit_id")).agg(docs.alias("doc_ids"), F.count("*").alias("note_count"))


def blank_annotations(units: DataFrame, labels: Sequence[str]) -> DataFrame:
    """A row for each unit and label, without values."""
    return units.select("unit_id", F.explode(F.array(*[F.lit(x) for x in labels])).alias("label_id")).withColumns({"value": F.lit(None).cast("string"), "value_num": F.lit(None).cast("double"), "na": F.lit(False)})


def corpus_fingerprint(docs: DataFrame, *, doc: str = "doc_id", content: str = "hash", buckets: int = 4096) -> DataFrame:
    """One row (n, fingerprint): the same for the same documents in any order or partitioning.

    A sum of row hashes for each of a fixed number of buckets, then a hash of the buckets: nothing that grows with the corpus meets in one task.
    """
    h = F.sha2(F.concat_ws(":", F.col(doc).cast("string"), F.col(content)), 256)
    part = lambda at: F.conv(F.substring(h, at, 12), 16, 10).cast("decimal(38,0)")
    per = docs.groupBy(F.pmod(F.xxhash64(doc), F.lit(buckets)).alias("b")).agg(F.count("*").alias("n"), F.sum(part(1)).alias("x"), F.sum(part(13)).alias("y"))
    every = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "n", "x", "y"))), lambda r: F.concat_ws(":", r.b, r.n, r.x, r.y)), "|")
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(every, 256).alias("fingerprint"))


def completion_times(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, completed_at) of all rows of old after changes (key, complete, at): completed rows take their new time, ones that were opened again keep the old one. One change for each key."""
    both = old.join(new, list(key), "left")
    return both.select(*key, F.when(F.coalesce("complete", F.lit(False)), F.col("at")).otherwise(F.col("completed_at")).alias("completed_at"))
