"""Label types, reviewer disagreement, consensus of the last round, and gold labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text

KEY = ["unit_id", "label_id"]
BINARY = (*text.YES, *text.NO, "unknown")


def typed_values(ann: DataFrame) -> DataFrame:
    """ann with v_num, v_date and v_text: of a row its number, date or text, none where na is set or the value is blank."""
    ok = ~F.coalesce(F.col("na"), F.lit(False))
    return ann.withColumns({"v_num": F.when(ok, F.col("label_value_num")), "v_date": F.when(ok, F.col("label_value_date")), "v_text": F.when(ok, text.nonblank(F.col("label_value")))})


def label_types(ann: DataFrame) -> DataFrame:
    """(label_id, label_type): numeric if any value is a number, else date if any is, else binary if all are yes/no words, else categorical."""
    t = typed_values(ann)
    token = F.lower(F.col("v_text"))
    per = t.groupBy("label_id").agg(F.max(F.col("v_num").isNotNull()).alias("num"), F.max(F.col("v_date").isNotNull()).alias("day"), F.min(F.when(token.isNotNull(), token.isin(*BINARY))).alias("bin"))
    return per.select("label_id", F.when(F.col("num"), "numeric").when(F.col("day"), "date").when(F.col("bin"), "binary").otherwise("categorical").alias("label_type"))


def categorical_disagreement(ann: DataFrame) -> DataFrame:
    """(unit_id, label_id, n_reviewers, score): the entropy of a unit's values, scaled by that of as many values in equal parts."""
    t = typed_values(ann).where("v_text is not null")
    cells = t.groupBy(*KEY, "v_text").agg(F.count("*").alias("c"))
    n = F.sum("c").over(Window.partitionBy(*KEY))
    p = F.col("c") / n
    h = cells.withColumn("h", -p * F.log2(p)).groupBy(*KEY).agg(F.sum("h").alias("h"), F.count("*").alias("k"))
    who = t.groupBy(*KEY).agg(F.count_distinct("reviewer_id").alias("n_reviewers"))
    return h.join(who, KEY).select(*KEY, "n_reviewers", (F.col("h") / F.log2(F.greatest(F.col("k"), F.lit(2)).cast("double"))).alias("score"))


def spread_disagreement(ann: DataFrame, value: str = "v_num") -> DataFrame:
    """(unit_id, label_id, n_reviewers, score): a unit's range against four interquartile ranges of its label, at most 1; 1 for a label without spread or a single value.

    value: v_num, or v_date for days.
    """
    v = F.col(value) if value != "v_date" else dates.epoch_day(F.col("v_date")).cast("double")
    t = typed_values(ann).withColumn("_v", v).where("_v is not null")
    q = t.groupBy("label_id").agg(F.percentile("_v", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count("*").alias("n"))
    q = q.select("label_id", (F.col("q")[1] - F.col("q")[0]).alias("iqr"), "n")
    per = t.groupBy(*KEY).agg(F.count_distinct("reviewer_id").alias("n_reviewers"), (F.max("_v") - F.min("_v")).alias("span"))
    flat = (F.col("iqr") <= 0) | (F.col("n") < 2)
    return per.join(F.broadcast(q), "label_id").select(*KEY, "n_reviewers", F.when(flat, 1.0).otherwise(F.least(F.lit(1.0), F.col("span") / (4 * F.greatest(F.lit(1e-6), F.col("iqr"))))).alias("score"))


def round_ordinal(round_id):
    """Rounds in their natural order: by the number at the end of the id."""
    return F.regexp_extract(round_id.cast("string"), r"(\d+)$", 1).try_cast("long")


def round_weights(ann: DataFrame, half_life: float = 1.0) -> DataFrame:
    """(unit_id, label_id, round_id, weight): 0.5 ** (rounds since the unit's last one / half_life)."""
    r = ann.select(*KEY, "round_id").distinct().withColumn("o", round_ordinal(F.col("round_id")))
    last = F.max("o").over(Window.partitionBy(*KEY))
    return r.select(*KEY, "round_id", F.pow(F.lit(0.5), (last - F.col("o")) / half_life).alias("weight"))


def hard_disagreement(ann: DataFrame, abs_tol: float = 1.0, rel_tol: float = 0.05, days: int = 1) -> DataFrame:
    """(unit_id, label_id, hard): two different texts, numbers further apart than the tolerance, or dates further than `days`."""
    t = typed_values(ann).withColumn("d", dates.epoch_day(F.col("v_date")))
    per = t.groupBy(*KEY).agg(F.count_distinct(F.lower("v_text")).alias("k"), (F.max("v_num") - F.min("v_num")).alias("span"), F.max(F.abs("v_num")).alias("big"), (F.max("d") - F.min("d")).alias("dd"))
    hard = (F.col("k") >= 2) | F.coalesce(F.col("span") > F.greatest(F.lit(abs_tol), rel_tol * F.greatest(F.lit(1.0), F.col("big"))), F.lit(False)) | F.coalesce(F.col("dd") > days, F.lit(False))
    return per.select(*KEY, hard.alias("hard"))


def last_round_consensus(ann: DataFrame) -> DataFrame:
    """(unit_id, label_id, round_id, num, day, value): of each unit's last round the median number, the median day (down to a whole one) and the commonest text (ties: the smallest)."""
    t = typed_values(ann).withColumn("o", round_ordinal(F.col("round_id")))
    last = t.groupBy(*KEY).agg(F.max("o").alias("o"))
    cur = t.join(last, [*KEY, "o"]).withColumn("d", dates.epoch_day(F.col("v_date")))
    epoch = F.lit("1970-01-01").cast("date")
    out = cur.groupBy(*KEY).agg(F.max("round_id").alias("round_id"), F.median("v_num").alias("num"), F.floor(F.median("d")).cast("int").alias("d"), F.mode("v_text", True).alias("value"))
    return out.select(*KEY, "round_id", "num", F.date_add(epoch, F.col("d")).alias("day"), "value")


def gold_labels(ann: DataFrame, min_reviewers: int = 2) -> DataFrame:
    """(unit_id, label_id, n, gold_value): the commonest value of units with at least min_reviewers values (ties: the smallest); a date label's value is its date."""
    t = typed_values(ann)
    v = F.coalesce(F.date_format("v_date", "yyyy-MM-dd"), F.col("v_text"), F.col("v_num").cast("string"))
    return t.withColumn("_v", v).where("_v is not null").groupBy(*KEY).agg(F.count("*").alias("n"), F.mode("_v", True).alias("gold_value")).where(F.col("n") >= min_reviewers)
