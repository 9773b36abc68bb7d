"""Labelers, votes and option scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import UNKNOWN


class Labeler(Protocol):
    """What label_with() runs: a function of texts that gives a value for each; it may call a model that the caller provides."""

    def __call__(self, texts: list[str]) -> list[str | None]: ...


def label_with(docs: DataFrame, labelers: Mapping[str, Labeler], *, doc: str = "doc_id", text: str = "text", retries: int = 1) -> DataFrame:
    """(doc, label_id, prediction_value): each labeler over all texts, in Arrow batches; a batch that fails is tried again, then gives nulls."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches):
        for p in batches:
            texts = p["t"].fillna("").tolist()
            for name, f in labelers.items():
                for attempt in range(retries + 1):
                    try:
                        got = f(texts)
                        break
                    except Exception:  # noqa: BLE001  a model's failure is data here
                        got = [None] * len(texts) if attempt == retries else None
                yield pd.DataFrame({"d": p["d"], "label_id": name, "prediction_value": got})

    return docs.select(F.col(doc).alias("d"), F.col(text).alias("t")).mapInPandas(run, f"d {kind}, label_id string, prediction_value string").withColumnRenamed("d", doc)


def keyword_labels(docs: DataFrame, rules: Mapping[str, Mapping[str, Sequence[str]]], *, doc: str = "doc_id", text: str = "text", default: str = "unknown") -> DataFrame:
    """(doc, label_id, prediction_value): for each label the first value one of whose keywords the lower-cased text contains. JVM only."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = []
    for label, values in rules.items():
        out = F.lit(default)
        for value, words in reversed(list(values.items())):
            hit = F.lit(False)
            for w in words:
                hit = hit | F.contains(F.col("_low"), F.lit(w.lower()))
            out = F.when(hit, value).otherwise(out)
        rows.append(F.struct(F.lit(label).alias("label_id"), out.alias("prediction_value")))
    return docs.select(doc, low.alias("_low")).select(doc, F.explode(F.array(*rows)).alias("x")).select(doc, "x.*")


def majority(votes: DataFrame, by: Sequence[str], *, value: str = "vote", order: str = "n") -> DataFrame:
    """(by, value, n_votes, consistency): the commonest vote (ties: the first cast) and its share."""
    c = votes.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"), F.min(order).alias("_o"))
    best = c.groupBy(*by).agg(F.max(F.struct("_c", (-F.col("_o")).alias("_o"), value)).alias("x"), F.sum("_c").alias("n_votes"))
    return best.select(*by, F.col(f"x.{value}").alias(value), "n_votes", (F.col("x._c") / F.col("n_votes")).alias("consistency"))


def numeric_consistency(votes: DataFrame, by: Sequence[str], value: str = "vote") -> DataFrame:
    """(by, median, n_votes, consistency): consistency is the mean of exp(-|a - b| / tau) over pairs of votes, tau = max(1, 5 % of the median); 1 for one vote. A group is the votes on one question."""
    return _pairwise(votes, by, value, lambda m: F.greatest(F.lit(1.0), 0.05 * F.abs(m)))


def _pairwise(votes: DataFrame, by: Sequence[str], value: str, tau) -> DataFrame:
    """(by, median, n_votes, consistency) with the mean of exp(-|a - b| / tau(median)) over pairs.

    Distinct values are counted before the shuffle and met in order: with r = sum of n exp(-(b - v) / tau) over
    the values v below b, the next value's r follows from the last one's, so n votes take one pass and not n * n.
    """
    v = F.col(value).cast("double")
    counts = votes.where(v.isNotNull()).groupBy(*by, v.alias("_x")).agg(F.count("*").cast("double").alias("_n"))
    per = counts.groupBy(*by).agg(F.percentile("_x", 0.5, F.col("_n").cast("long")).alias("median"), F.sum("_n").alias("n"), F.array_sort(F.collect_list(F.struct("_x", "_n"))).alias("_v"))
    per = per.withColumn("_t", tau(F.col("median")))
    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("r"), F.lit(0.0).alias("s"))

    def step(a, b):
        r = a.r * F.exp(-(b["_x"] - a.x) / F.col("_t"))  # r is 0 before the first value
        r = F.when(a.r == 0, 0.0).otherwise(r)
        return F.struct(b["_x"].alias("x"), (r + b["_n"]).alias("r"), (a.s + b["_n"] * r + b["_n"] * (b["_n"] - 1) / 2).alias("s"))

    total = F.aggregate("_v", start, step).s
    n = F.col("n")
    return per.select(*by, "median", n.cast("long").alias("n_votes"), F.when(n > 1, total / (n * (n - 1) / 2)).otherwise(1.0).alias("consistency"))


def date_consistency(votes: DataFrame, by: Sequence[str], value: str = "vote", tau: float = 14.0) -> DataFrame:
    """(by, median, n_votes, consistency): numeric_consistency of dates, in days and with a fixed tau; the median is a day (of two middle ones the earlier half)."""
    day = F.datediff(F.col(value), F.lit("1970-01-01").cast("date")).cast("double")
    got = _pairwise(votes.withColumn("_day", day), by, "_day", lambda m: F.lit(tau))
    return got.withColumn("median", F.date_add(F.lit("1970-01-01").cast("date"), F.floor("median").cast("int")))


def word_consistency(votes: DataFrame, by: Sequence[str], value: str = "vote", both_unknown: float = 0.5, one_unknown: float = 0.1) -> DataFrame:
    """(by, n_votes, consistency): the mean over pairs of votes of 1 for equal ones, 0 for others; two unknown ones agree by both_unknown, one and another by one_unknown. From counts of each vote, so a group of any size is one row for each distinct vote."""
    v = F.lower(F.trim(value))
    c = votes.where(F.col(value).isNotNull()).groupBy(*by, v.alias("_v")).agg(F.count("*").cast("double").alias("_n")).withColumn("_u", F.col("_v").isin(*UNKNOWN))
    same = F.col("_n") * (F.col("_n") - 1) / 2
    known, unknown = F.sum(F.when(~F.col("_u"), F.col("_n")).otherwise(0.0)), F.sum(F.when(F.col("_u"), F.col("_n")).otherwise(0.0))
    per = c.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(F.when(~F.col("_u"), same).otherwise(0.0)).alias("s"), known.alias("k"), unknown.alias("u"))
    total = F.col("s") + both_unknown * F.col("u") * (F.col("u") - 1) / 2 + one_unknown * F.col("u") * F.col("k")
    return per.select(*by, F.col("n").cast("long").alias("n_votes"), F.when(F.col("n") > 1, total / (F.col("n") * (F.col("n") - 1) / 2)).otherwise(1.0).alias("consistency"))


def option_scores(rows: DataFrame, options: Mapping[str, str], key: str) -> DataFrame:
    """(key, prediction, probability, entropy): the softmax of the options' log-probability columns, the likeliest (ties: the first), and the entropy in nats."""
    cols = list(options.values())
    top = F.greatest(*[F.col(c).cast("double") for c in cols]) if len(cols) > 1 else F.col(cols[0]).cast("double")
    e = rows.select(key, *[F.exp(F.col(c).cast("double") - top).alias(f"_e{i}") for i, c in enumerate(cols)])
    z = sum((F.col(f"_e{i}") for i in range(1, len(cols))), F.col("_e0"))
    p = e.select(key, *[(F.col(f"_e{i}") / z).alias(f"_p{i}") for i in range(len(cols))])
    best = F.greatest(*[F.col(f"_p{i}") for i in range(len(cols))]) if len(cols) > 1 else F.col("_p0")
    name = F.lit(None).cast("string")
    for i, o in reversed(list(enumerate(options))):
        name = F.when(F.col(f"_p{i}") == best, o).otherwise(name)
    h = -sum((F.when(F.col(f"_p{i}") > 0, F.col(f"_p{i}") * F.ln(f"_p{i}")).otherwise(0.0) for i in range(1, len(cols))), F.when(F.col("_p0") > 0, F.col("_p0") * F.ln("_p0")).otherwise(0.0))
    return p.select(key, name.alias("prediction"), best.alias("probability"), h.alias("entropy"))


def malformed_streaks(rows: DataFrame, by: str, order: str, bad: str, least: int) -> DataFrame:
    """(by, start, n): runs of at least `least` bad rows in order, by numbering rows against bad rows."""
    a = F.row_number().over(Window.partitionBy(by).orderBy(order))
    b = F.row_number().over(Window.partitionBy(by, bad).orderBy(order))
    return rows.withColumn("_g", a - b).where(F.col(bad)).groupBy(by, "_g").agg(F.min(order).alias("start"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_g")
