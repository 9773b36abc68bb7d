"""Annotation exports: typed values, joins of annotations with what belongs to them, bundles for reviewers and outputs of runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..sources import tables
from . import ingest


def typed_value(value: Column, kind: Column, na_allowed: Column) -> Column:
    """struct(value, value_num, value_date, na) of a raw value by its label's type.

    Numbers (integer, float) keep their text and, where it is one, their number; dates go to value_date; the parts of
    a multiple choice are trimmed and joined by commas. Nothing, or nothing but blanks, is na where that is
    allowed; a blank text where it isn't stays an empty text.
    """
    t = F.trim(value)
    number, day, multi = kind.isin("integer", "float"), kind == "date", kind == "categorical_multi"
    parts = F.array_join(F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != ""), ",")
    blank = F.coalesce(F.when(multi, parts == "").otherwise(t == ""), F.lit(True))
    plain = F.when(multi, parts).when(~day, t)
    return F.struct(
        F.when(~blank, plain).when(value.isNotNull() & ~na_allowed & ~number & ~day & ~multi, F.lit("")).alias("value"),
        F.when(~blank & number, t.try_cast("double")).alias("value_num"),
        F.when(~blank & day, t).alias("value_date"),
        (blank & na_allowed).cast("int").alias("na"),
    )


def with_text(ann: DataFrame, notes: DataFrame, *, doc: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ann with its documents' texts; a document that is listed twice gives its smallest text, one that is missing null."""
    one = notes.groupBy(doc).agg(F.min(text_col).alias("document_text"))
    return ann.join(one, doc, "left")


def enriched(ann: DataFrame, units: DataFrame, rationales: DataFrame, rules: DataFrame, history: DataFrame) -> DataFrame:
    """ann with its unit's columns, its rationales (JSON, by doc, start, end), its label's rules and its changes; each side has one row for each key before it is joined.

    rationales: unit_id, label_id, reviewer_id, doc_id, start, end, snippet. rules: label_id, rules. history: unit_id, label_id, reviewer_id, changes.
    """
    who = ["unit_id", "label_id", "reviewer_id"]
    spans = F.to_json(F.array_sort(F.collect_list(F.struct("doc_id", "start", "end", "snippet"))))
    out = ann.join(units.dropDuplicates(["unit_id"]), "unit_id", "left")
    out = out.join(rationales.groupBy(*who).agg(spans.alias("rationales_json")), who, "left")
    out = out.join(rules.dropDuplicates(["label_id"]), "label_id", "left")
    return out.join(history.dropDuplicates(who), who, "left")


def label_rules(rows: DataFrame, position: str) -> DataFrame:
    """(label_id, rules): the last rule of each label that isn't blank."""
    ok = rows.where(F.trim("rules") != "")
    return ok.groupBy("label_id").agg(F.max_by("rules", F.struct(position, "rules")).alias("rules"))


def round_labelsets(rows: DataFrame, position: str) -> DataFrame:
    """(round_id, labelset_id): the last labelset of each round that isn't blank."""
    ok = rows.where(F.trim("labelset_id") != "")
    return ok.groupBy("round_id").agg(F.max_by("labelset_id", F.struct(position, "labelset_id")).alias("labelset_id"))


def change_history(events: DataFrame, key: Sequence[str], order: str, value: str) -> DataFrame:
    """(key, n_changes, changes): the values an entry went through, without repeats that follow one another, as text in order. One entry's events are what people did to it."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("v")))), lambda x: x.v)
    kept = F.filter(steps, lambda x, i: (i == 0) | (F.get(steps, i - 1) != x))
    per = events.groupBy(*key).agg(kept.alias("_c"))
    return per.select(*key, (F.size("_c") - 1).cast("long").alias("n_changes"), F.array_join("_c", " -> ").alias("changes"))


def with_unit_metadata(selection: DataFrame, units: DataFrame, key: str = "unit_id") -> DataFrame:
    """selection with its units' columns that it lacks; of a unit listed twice the first row in order of all columns."""
    new = [c for c in units.columns if c != key and c not in selection.columns]
    one = units.groupBy(key).agg(F.min(F.struct(*new)).alias("_u")) if new else units.select(key).distinct()
    return selection.join(one, key, "left").select(*selection.columns, *[F.col(f"_u.{c}").alias(c) for c in new])


def wide(pred: DataFrame, labels: Sequence[str], *, value: str = "prediction_value", reasoning: str | None = "reasoning") -> DataFrame:
    """(unit_id, {label}_llm..., {label}_reasoning...): one row for each unit, predictions and reasonings side by side, in one aggregation."""
    cols = [F.min(F.when(F.col("label_id") == x, F.col(value))).alias(f"{x}_llm") for x in labels]
    if reasoning:
        cols += [F.min(F.when(F.col("label_id") == x, F.col(reasoning))).alias(f"{x}_reasoning") for x in labels]
    return pred.groupBy("unit_id").agg(*cols)


def documents_by_id(docs: DataFrame, ids: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """The rows of docs that ids names; one that docs lacks raises."""
    want = ids.select(doc).distinct()
    gone = want.join(docs, doc, "left_anti").limit(5).collect()
    if gone:
        raise KeyError(f"no such documents: {[r[0] for r in gone]}")
    return docs.join(want, doc, "left_semi")


def is_model(reviewer: Column) -> Column:
    """Whether a reviewer's id says that it is a model."""
    return F.coalesce(F.lower(F.trim(reviewer)).rlike(r"(^|[^a-z])llm([^a-z]|$)"), F.lit(False))


def normal_predictions(pred: DataFrame) -> DataFrame:
    """pred under the names llm_prediction, llm_consistency and llm_runs; dates and times as ISO days."""
    out = pred.withColumnsRenamed({k: v for k, v in (("prediction", "llm_prediction"), ("prediction_value", "llm_prediction"), ("consistency", "llm_consistency"), ("runs", "llm_runs")) if k in pred.columns})
    days = [f.name for f in out.schema if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz")]
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in days})


def reasoning(runs: Column) -> Column:
    """The reasoning of the first run, or of its raw answer: runs is JSON text of a list."""
    first = F.coalesce(F.get_json_object(runs, "$[0].reasoning"), F.get_json_object(runs, "$[0].raw.reasoning"))
    return F.when(F.trim(first) != "", first)


def unit_id_of(level: str) -> Column:
    """unit_id, or without one what it is at the level: the patient's (multi_doc) or the document's id."""
    return F.coalesce(text.nonblank(F.col("unit_id")), F.col("patient_icn" if level == "multi_doc" else "doc_id").cast("string"))


def normal_gold(gold: DataFrame) -> DataFrame:
    """(unit_id, label_id, gold_value) with a date's day where there is one."""
    return gold.select("unit_id", "label_id", F.coalesce(F.date_format("label_value_date", "yyyy-MM-dd"), dates.normal_date(F.col("label_value"))).alias("gold_value"))


# --- outputs ---------------------------------------------------------------------------------


def manifest(assigned: DataFrame) -> DataFrame:
    """A row for each unit of a round: its patient, document, strata, reviewers and whether they share it."""
    return assigned.groupBy("unit_id").agg(F.min("patient_icn").alias("patient_icn"), F.min("doc_id").alias("doc_id"), F.min("strata").alias("strata"), F.array_join(F.array_sort(F.collect_set("reviewer_id")), ";").alias("assigned_to"), F.max("is_overlap").alias("is_overlap"))


def write_bundles(assigned: DataFrame, unit_notes: DataFrame, docs: DataFrame, labels: Sequence[str], path: str) -> None:
    """What each reviewer gets, by folders reviewer_id=...: units with their rank, their notes, those notes' documents once, and blank annotations of every label."""
    mine = assigned.select("reviewer_id", "unit_id", "display_rank", "is_overlap")
    notes = mine.select("reviewer_id", "unit_id").join(unit_notes, "unit_id")
    own_docs = notes.select("reviewer_id", "doc_id").distinct().join(docs, "doc_id")
    blank = ingest.blank_annotations(mine.select("unit_id").distinct(), labels).join(mine.select("reviewer_id", "unit_id"), "unit_id")
    for name, d in (("units", mine), ("unit_notes", notes), ("documents", own_docs), ("annotations", blank)):
        tables.write_table(d, f"{path}/{name}.parquet", mode="overwrite", partition_by=["reviewer_id"])


def write_aggregate(ann: DataFrame, units: DataFrame, path: str) -> None:
    """All reviewers' annotations of a round and a summary of its units; written again whole each time."""
    tables.write_table(ann, f"{path}/unit_annotations.parquet", mode="overwrite")
    tables.write_table(ingest.keep_first(units, ["round_id", "unit_id"], "doc_id"), f"{path}/unit_summary.parquet", mode="overwrite")


def write_gold(gold: DataFrame, path: str) -> None:
    """Gold labels as CSV and as JSON lines."""
    tables.write_table(gold, f"{path}/gold.csv", mode="overwrite")
    tables.write_table(gold, f"{path}/gold.jsonl", mode="overwrite")


def write_selection(buckets: Mapping[str, DataFrame], final: DataFrame, path: str) -> None:
    """Each bucket of an active-learning run (bucket_{name}.parquet), the selection, and the next batch's units as CSV."""
    for name, d in buckets.items():
        tables.write_table(d, f"{path}/bucket_{name}.parquet", mode="overwrite")
    tables.write_table(final, f"{path}/final_selection.parquet", mode="overwrite")
    tables.write_table(final, f"{path}/ai_next_batch.csv", mode="overwrite")


def write_predictions(pred: DataFrame, labels: Sequence[str], path: str) -> None:
    """Predictions tall, wide, and nested by unit; calls with their runs as a trace where there are any."""
    tables.write_table(pred, f"{path}/predictions_tall.parquet", mode="overwrite")
    tables.write_table(wide(pred, labels, reasoning="reasoning" if "reasoning" in pred.columns else None), f"{path}/predictions_wide.parquet", mode="overwrite")
    tables.write_table(tables.nested_by_unit(pred), f"{path}/predictions_by_unit.jsonl", mode="overwrite")
    if "runs" in pred.columns:
        tables.write_table(pred.where("runs is not null").select("unit_id", "label_id", "runs"), f"{path}/calls.jsonl", mode="append")


def write_experiment(path: str, gold: DataFrame, pred: DataFrame, metrics: DataFrame, settings: Mapping) -> None:
    """An experiment's settings, gold labels, predictions and metrics (a row for each label, few)."""
    tables.write_table(gold, f"{path}/gold_labels.parquet", mode="overwrite")
    tables.write_table(pred, f"{path}/experiments_predictions.parquet", mode="overwrite")
    tables.write_table(metrics, f"{path}/experiments_metrics.json", mode="overwrite")
    if "://" not in path:
        tables.write_manifest(f"{path}/experiments.json", dict(settings))
