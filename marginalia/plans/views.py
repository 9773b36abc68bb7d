"""Views of the driver tables as notes, annotations, gold labels and predictions, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def notes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("patient_icn"), F.date_add(F.lit("2020-01-01").cast("date"), F.pmod("doc_id", F.lit(1500)).cast("int")).alias("date_note"), F.col("lang").alias("notetype"), "text", "n_chars", F.col("doc_id").alias("n"))


NOTES = """v_notes AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS patient_icn, DATE '2020-01-01' + CAST(doc_id % 1500 AS INTEGER) AS date_note,
  lang AS notetype, text, n_chars, doc_id AS n FROM documents)"""


def annotations(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    x = x.withColumn("r", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)]))).withColumn("label_id", F.explode(F.array(*[F.lit(i) for i in ("quality", "toxic", "length", "seen")])))
    flip = ((F.col("r") == 2) & (F.col("doc_id") % 7 == 0)) | ((F.col("r") == 3) & (F.col("doc_id") % 5 == 0))
    base = F.when(F.col("label_id") == "quality", F.col("quality") == 1).otherwise(F.col("toxic") == 1)
    yes = F.when(flip, ~base).otherwise(base)
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1500 + (F.col("r") - 1) * (F.col("doc_id") % 4)).cast("int"))
    return x.select(
        (1 + F.col("doc_id") % 3).cast("long").alias("round_id"),
        F.col("doc_id").cast("string").alias("unit_id"),
        F.col("source").alias("patient_icn"),
        F.concat(F.lit("r"), F.col("r").cast("string")).alias("reviewer_id"),
        "label_id",
        F.when(F.col("label_id").isin("quality", "toxic"), F.when(yes, "yes").otherwise("no")).alias("label_value"),
        F.when(F.col("label_id") == "length", (F.col("n_chars") + (F.col("r") - 1) * (F.col("doc_id") % 11)).cast("double")).alias("label_value_num"),
        F.when(F.col("label_id") == "seen", day).alias("label_value_date"),
        (F.col("doc_id") % 13 == 0).alias("na"),
    )


ANN = """v_ann AS (SELECT CAST(1 + d.doc_id % 3 AS BIGINT) AS round_id, CAST(d.doc_id AS VARCHAR) AS unit_id, d.source AS patient_icn, 'r' || r AS reviewer_id, label_id,
  CASE WHEN label_id IN ('quality', 'toxic') THEN CASE WHEN (((r = 2 AND d.doc_id % 7 = 0) OR (r = 3 AND d.doc_id % 5 = 0)) <> ((CASE WHEN label_id = 'quality' THEN quality ELSE toxic END) = 1)) THEN 'yes' ELSE 'no' END END AS label_value,
  CASE WHEN label_id = 'length' THEN CAST(n_chars + (r - 1) * (d.doc_id % 11) AS DOUBLE) END AS label_value_num,
  CASE WHEN label_id = 'seen' THEN DATE '2020-01-01' + CAST(d.doc_id % 1500 + (r - 1) * (d.doc_id % 4) AS INTEGER) END AS label_value_date,
  d.doc_id % 13 = 0 AS na
  FROM labels JOIN documents d ON labels.doc_id = d.doc_id, (SELECT unnest([1, 2, 3]) AS r), (SELECT unnest(['quality', 'toxic', 'length', 'seen']) AS label_id))"""


def gold(spark: SparkSession, d: str) -> DataFrame:
    """The first reviewer's values as text, but for na ones."""
    a = annotations(spark, d).where("reviewer_id = 'r1' and not na")
    return a.select("unit_id", "label_id", F.coalesce("label_value", F.date_format("label_value_date", "yyyy-MM-dd"), F.col("label_value_num").cast("long").cast("string")).alias("gold_value"))


GOLD = """v_gold AS (SELECT unit_id, label_id, coalesce(label_value, strftime(label_value_date, '%Y-%m-%d'), CAST(CAST(label_value_num AS BIGINT) AS VARCHAR)) AS gold_value
  FROM v_ann WHERE reviewer_id = 'r1' AND NOT na)"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """The second reviewer's values, with a consistency and an entropy that some rows lack."""
    a = annotations(spark, d).where("reviewer_id = 'r2'")
    n = F.col("unit_id").cast("long")
    return a.select("unit_id", "label_id", F.coalesce("label_value", F.date_format("label_value_date", "yyyy-MM-dd"), F.col("label_value_num").cast("long").cast("string")).alias("prediction_value"), F.when(n % 5 != 0, (n % 17) / 17.0).alias("consistency"), F.when(n % 3 == 0, (n % 23) / 23.0).alias("entropy"))


PRED = """v_pred AS (SELECT unit_id, label_id, coalesce(label_value, strftime(label_value_date, '%Y-%m-%d'), CAST(CAST(label_value_num AS BIGINT) AS VARCHAR)) AS prediction_value,
  CASE WHEN CAST(unit_id AS BIGINT) % 5 <> 0 THEN (CAST(unit_id AS BIGINT) % 17) / 17.0::DOUBLE END AS consistency,
  CASE WHEN CAST(unit_id AS BIGINT) % 3 = 0 THEN (CAST(unit_id AS BIGINT) % 23) / 23.0::DOUBLE END AS entropy
  FROM v_ann WHERE reviewer_id = 'r2')"""


def with_(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
