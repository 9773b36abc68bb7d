"""Type-aware metrics of predictions against gold: (unit_id, label_id, gold_value) with (unit_id, label_id, prediction_value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text

KEY = ["unit_id", "label_id"]


def paired(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Rows of both by unit and label; repeated rows multiply."""
    return gold.select(*KEY, "gold_value").join(pred.select(*KEY, "prediction_value"), KEY)


def prf(tp, fp, fn) -> dict:
    p, r = F.try_divide(tp.cast("double"), tp + fp), F.try_divide(tp.cast("double"), tp + fn)
    return {"precision": F.coalesce(p, F.lit(0.0)), "recall": F.coalesce(r, F.lit(0.0)), "f1": F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))}


def _counts(g, p):
    hit = lambda c: F.sum(c.cast("long"))
    return {"tp": hit(g & p), "fp": hit(~g & p), "fn": hit(g & ~p), "tn": hit(~g & ~p)}


def binary_metrics(pairs: DataFrame) -> DataFrame:
    """By label: n, tp, fp, fn, tn, accuracy, precision, recall, f1 of the canonical yes."""
    g, p = (F.coalesce(text.yes_no(F.col(c)) == "yes", F.lit(False)) for c in ("gold_value", "prediction_value"))
    per = pairs.groupBy("label_id").agg(F.count("*").alias("n"), *[c.alias(k) for k, c in _counts(g, p).items()])
    return per.withColumns({"accuracy": (F.col("tp") + F.col("tn")) / F.col("n"), **prf(F.col("tp"), F.col("fp"), F.col("fn"))})


def multiclass_metrics(pairs: DataFrame) -> DataFrame:
    """By label: n, accuracy, and macro_f1, the mean f1 of the classes that gold has."""
    v = pairs.select("label_id", F.lower(F.trim("gold_value")).alias("g"), F.lower(F.trim("prediction_value")).alias("p"))
    cells = v.groupBy("label_id", "g", "p").agg(F.count("*").alias("c"))
    one = cells.where("g is not null").groupBy("label_id", F.col("g").alias("v")).agg(F.sum("c").alias("gold"), F.sum(F.when(F.col("g") == F.col("p"), F.col("c")).otherwise(0)).alias("tp"))
    got = cells.groupBy("label_id", F.col("p").alias("v")).agg(F.sum("c").alias("pred"))
    f1 = one.join(got, ["label_id", "v"], "left").withColumn("f1", F.coalesce(2.0 * F.col("tp") / (F.col("gold") + F.coalesce("pred", F.lit(0))), F.lit(0.0)))
    macro = f1.groupBy("label_id").agg(F.avg("f1").alias("macro_f1"))
    acc = cells.groupBy("label_id").agg(F.sum("c").alias("n"), (F.sum(F.when(F.col("g") == F.col("p"), F.col("c")).otherwise(0)) / F.sum("c")).alias("accuracy"))
    return acc.join(macro, "label_id", "left")


def _sets(pairs: DataFrame) -> DataFrame:
    return pairs.select("label_id", text.multi_set(F.col("gold_value")).alias("g"), text.multi_set(F.col("prediction_value")).alias("p"))


def multiselect_metrics(pairs: DataFrame) -> DataFrame:
    """By label: n, exact (equal sets), jaccard (two empty sets: 1), over (something too many) and under (something missing)."""
    s = _sets(pairs)
    union = F.size(F.array_union("g", "p"))
    jac = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("g", "p")) / union)
    mean = lambda c: F.avg(c.cast("double"))
    return s.groupBy("label_id").agg(F.count("*").alias("n"), mean(F.col("g") == F.col("p")).alias("exact"), F.avg(jac).alias("jaccard"), mean(F.size(F.array_except("p", "g")) > 0).alias("over"), mean(F.size(F.array_except("g", "p")) > 0).alias("under"))


def multiselect_items(pairs: DataFrame) -> DataFrame:
    """By label and option: support, precision, recall, f1."""
    item = _sets(pairs).select("label_id", "g", "p", F.explode(F.array_union("g", "p")).alias("item"))
    g, p = F.array_contains("g", F.col("item")), F.array_contains("p", F.col("item"))
    per = item.groupBy("label_id", "item").agg(*[c.alias(k) for k, c in _counts(g, p).items()])
    return per.select("label_id", "item", (F.col("tp") + F.col("fn")).alias("support"), *[c.alias(k) for k, c in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def date_metrics(pairs: DataFrame) -> DataFrame:
    """By label, over pairs that are both dates: n, exact, within_3d, within_7d, within_30d, mae_days, p90_days."""
    err = F.abs(F.datediff(dates.parse_model_date(F.col("prediction_value")), dates.parse_model_date(F.col("gold_value"))))
    e = pairs.withColumn("e", err).where("e is not null")
    share = lambda d: F.avg((F.col("e") <= d).cast("double"))
    return e.groupBy("label_id").agg(F.count("*").alias("n"), share(0).alias("exact"), share(3).alias("within_3d"), share(7).alias("within_7d"), share(30).alias("within_30d"), F.avg("e").alias("mae_days"), F.percentile("e", 0.9).alias("p90_days"))


def numeric_metrics(pairs: DataFrame) -> DataFrame:
    """By label, over pairs that are both numbers: n, mae, rmse, within_10pct."""
    e = pairs.select("label_id", dates.parse_number(F.col("gold_value")).alias("g"), dates.parse_number(F.col("prediction_value")).alias("p")).where("g is not null and p is not null")
    d = F.abs(F.col("p") - F.col("g"))
    return e.groupBy("label_id").agg(F.count("*").alias("n"), F.avg(d).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg((d <= 0.1 * F.abs("g")).cast("double")).alias("within_10pct"))


def global_metrics(pairs: DataFrame) -> DataFrame:
    """n, raw accuracy of equal texts, and micro precision, recall, f1 of the canonical yes, over all labels."""
    g, p = (F.coalesce(text.yes_no(F.col(c)) == "yes", F.lit(False)) for c in ("gold_value", "prediction_value"))
    per = pairs.agg(F.count("*").alias("n"), F.avg(F.coalesce(F.lower(F.trim("gold_value")) == F.lower(F.trim("prediction_value")), F.lit(False)).cast("double")).alias("accuracy"), *[F.coalesce(c, F.lit(0)).alias(k) for k, c in _counts(g, p).items()])
    return per.select("n", "accuracy", *[c.alias(k) for k, c in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def family_metrics(pairs: DataFrame, parent: str, children: list[str]) -> DataFrame:
    """One row for a parent label: its confusion, child accuracy among units whose parent is truly found, units lost with a missed parent, spurious families, and end-to-end recall.

    end_to_end_recall: of the units whose parent is yes in gold, the share with the parent and all rated children right.
    """
    yes = lambda c: F.coalesce(text.yes_no(F.col(c)) == "yes", F.lit(False))
    first = pairs.groupBy(*KEY).agg(F.min(F.struct("gold_value", "prediction_value")).alias("x")).select(*KEY, "x.*")
    own = F.col("label_id") == parent
    right = F.coalesce(F.lower(F.trim("gold_value")) == F.lower(F.trim("prediction_value")), F.lit(False))
    kid = F.col("label_id").isin(*children)
    unit = first.groupBy("unit_id").agg(F.max(own & yes("gold_value")).alias("g"), F.max(own & yes("prediction_value")).alias("p"), F.min(F.when(kid, right)).alias("all_right"), F.sum(F.when(kid, right.cast("long"))).alias("right"), F.sum(F.when(kid, F.lit(1))).alias("kids"))
    tp = F.col("g") & F.col("p")
    per = unit.agg(*[c.alias(f"parent_{k}") for k, c in _counts(F.col("g"), F.col("p")).items()], F.sum(F.when(tp, F.coalesce("right", F.lit(0)))).alias("r"), F.sum(F.when(tp, F.coalesce("kids", F.lit(0)))).alias("k"), F.sum((tp & F.coalesce("all_right", F.lit(True))).cast("long")).alias("e2e"))
    return per.select(F.lit(parent).alias("parent"), "parent_tp", "parent_fp", "parent_fn", "parent_tn", F.try_divide(F.col("r").cast("double"), "k").alias("child_accuracy"), F.col("parent_fn").alias("lost_due_to_parent_fn"), F.col("parent_fp").alias("spurious_families"), F.try_divide(F.col("e2e").cast("double"), F.col("parent_tp") + F.col("parent_fn")).alias("end_to_end_recall"))


def pivot_wide(pred: DataFrame, labels: list[str]) -> DataFrame:
    """One row per unit, one column per label: its first prediction by value."""
    return pred.groupBy("unit_id").pivot("label_id", labels).agg(F.min("prediction_value"))


def value_types(pairs: DataFrame) -> DataFrame:
    """(label_id, label_type) of (gold_value, prediction_value) pairs by their values: a list or one of ; , makes it categorical_multi; else dates where there are some, and no fewer than numbers; else numeric where there are numbers."""
    both = pairs.select("label_id", F.explode(F.array(F.col("gold_value").cast("string"), F.col("prediction_value").cast("string"))).alias("v"))
    per = both.groupBy("label_id").agg(F.coalesce(F.max(F.col("v").rlike("[;,]")), F.lit(False)).alias("multi"), F.count(dates.parse_model_date(F.col("v"))).alias("days"), F.count(dates.parse_number(F.col("v"))).alias("numbers"))
    kind = F.when(F.col("multi"), "categorical_multi").when((F.col("days") > 0) & (F.col("days") >= F.col("numbers")), "date").when(F.col("numbers") > 0, "numeric").otherwise("categorical")
    return per.select("label_id", kind.alias("label_type"))


def scoped(rows: DataFrame, units: DataFrame) -> DataFrame:
    """rows of the units that an experiment is evaluated on."""
    return rows.join(units.select("unit_id").distinct(), "unit_id", "left_semi")
