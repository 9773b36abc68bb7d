"""Inter-annotator agreement over tall annotations (unit, label, reviewer, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def percent_agreement(ann: DataFrame, *, strict: bool = False, unit: str = "unit_id", label: str = "label_id", value: str = "label_value") -> DataFrame:
    """(label, n_units, agreement): the share of units whose raters all agree.

    Lenient: missing values are left out, units without any value don't count, and one rater alone
    agrees. Strict: a missing value is a value. Combined on the map side by unit.
    """
    v = F.coalesce(F.col(value), F.lit("\u0000")) if strict else F.col(value)
    per = ann.groupBy(label, unit).agg(F.min(v).alias("lo"), F.max(v).alias("hi")).where("lo is not null")
    return per.groupBy(label).agg(F.count("*").alias("n_units"), F.avg((F.col("lo") == F.col("hi")).cast("double")).alias("agreement"))


def reviewer_pairs(ann: DataFrame, *, unit: str = "unit_id", label: str = "label_id", reviewer: str = "reviewer_id", value: str = "label_value") -> DataFrame:
    """(label, r1, r2, a, b): both values of each unit that two reviewers rated, r1 < r2."""
    x = ann.where(F.col(value).isNotNull()).select(unit, label, F.col(reviewer).alias("r"), F.col(value).alias("v"))
    a, b = x.select(unit, label, F.col("r").alias("r1"), F.col("v").alias("a")), x.select(unit, label, F.col("r").alias("r2"), F.col("v").alias("b"))
    return a.join(b, [unit, label]).where("r1 < r2")


def cohens_kappa(ann: DataFrame, *, label: str = "label_id", **names) -> DataFrame:
    """(label, r1, r2, n, kappa): observed against chance agreement of each pair of reviewers; 1 where chance agreement is 1."""
    cells = reviewer_pairs(ann, label=label, **names).groupBy(label, "r1", "r2", "a", "b").agg(F.count("*").alias("c"))
    key = [label, "r1", "r2"]
    total = cells.groupBy(*key).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    left = cells.groupBy(*key, F.col("a").alias("v")).agg(F.sum("c").alias("x"))
    right = cells.groupBy(*key, F.col("b").alias("v")).agg(F.sum("c").alias("y"))
    chance = left.join(right, [*key, "v"]).groupBy(*key).agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("xy"))
    out = total.join(chance, key, "left")
    po = F.col("same") / F.col("n")
    pe = F.coalesce(F.col("xy"), F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return out.select(*key, "n", F.when(pe >= 1, 1.0).otherwise(F.try_divide(po - pe, 1 - pe)).alias("kappa"))


def fleiss_kappa(ann: DataFrame, *, unit: str = "unit_id", label: str = "label_id", value: str = "label_value") -> DataFrame:
    """(label, n_units, kappa) over units with at least two ratings; null where there are none, 1 where chance agreement is 1."""
    cells = ann.where(F.col(value).isNotNull()).groupBy(label, unit, value).agg(F.count("*").alias("c"))
    per = cells.groupBy(label, unit).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("agree"))
    rated = per.where("n >= 2")
    shares = cells.join(rated.select(label, unit), [label, unit]).groupBy(label, value).agg(F.sum("c").alias("c"))
    sums = shares.groupBy(label).agg(F.sum("c").alias("all"), F.sum(F.col("c").cast("double") * F.col("c")).alias("sq"))
    mean = rated.groupBy(label).agg(F.count("*").alias("n_units"), F.avg(F.col("agree") / (F.col("n") * (F.col("n") - 1))).alias("p"))
    pe = F.col("sq") / (F.col("all").cast("double") * F.col("all"))
    return mean.join(sums, label).select(label, "n_units", F.when(pe >= 1, 1.0).otherwise(F.try_divide(F.col("p") - pe, 1 - pe)).alias("kappa"))


def fleiss_kappa_of_all(ann: DataFrame, *, unit: str = "unit_id", label: str = "label_id", value: str = "label_value") -> DataFrame:
    """(label, n_units, kappa) with every unit of ann counted: one with fewer than two ratings agrees in nothing."""
    cells = ann.where(F.col(value).isNotNull()).groupBy(label, unit, value).agg(F.count("*").alias("c"))
    per = cells.groupBy(label, unit).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("agree"))
    p = F.sum(F.when(F.col("n") >= 2, F.col("agree") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0))
    every = ann.groupBy(label).agg(F.count_distinct(unit).alias("n_units"))
    sums = cells.groupBy(label, value).agg(F.sum("c").alias("c")).groupBy(label).agg(F.sum("c").alias("all"), F.sum(F.col("c").cast("double") * F.col("c")).alias("sq"))
    pe = F.col("sq") / (F.col("all").cast("double") * F.col("all"))
    mean = every.join(per.groupBy(label).agg(p.alias("p")), label)
    return mean.join(sums, label).select(label, "n_units", F.when(pe >= 1, 1.0).otherwise(F.try_divide(F.col("p") / F.col("n_units") - pe, 1 - pe)).alias("kappa"))


def iaa(ann: DataFrame, *, unit: str = "unit_id", label: str = "label_id", reviewer: str = "reviewer_id", value: str = "label_value") -> DataFrame:
    """(label, n_reviewers, statistic, kappa, agreement): Cohen's kappa on the units that both rated where a label has two reviewers, Fleiss' where it has more or one, and the percent agreement."""
    names = {"unit": unit, "label": label, "value": value}
    who = ann.where(F.col(value).isNotNull()).groupBy(label).agg(F.count_distinct(reviewer).alias("n_reviewers"))
    cohen = cohens_kappa(ann, reviewer=reviewer, **names).groupBy(label).agg(F.first("kappa").alias("_c"))  # one pair where it is used
    out = who.join(cohen, label, "left").join(fleiss_kappa(ann, **names).select(label, F.col("kappa").alias("_f")), label, "left")
    out = out.join(percent_agreement(ann, **names).select(label, "agreement"), label, "left")
    two = F.col("n_reviewers") == 2
    return out.select(label, "n_reviewers", F.when(two, "cohen").otherwise("fleiss").alias("statistic"), F.when(two, F.col("_c")).otherwise(F.col("_f")).alias("kappa"), "agreement")


def discordant_units(ann: DataFrame, *, unit: str = "unit_id", label: str = "label_id", value: str = "label_value") -> DataFrame:
    """(label, unit, n_ratings, n_values): units that at least two reviewers rated, and not alike."""
    per = ann.where(F.col(value).isNotNull()).groupBy(label, unit).agg(F.count("*").alias("n_ratings"), F.count_distinct(value).alias("n_values"))
    return per.where("n_ratings >= 2 and n_values >= 2")
