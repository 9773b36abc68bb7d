"""Deterministic stratified samples, reviewer allocation with overlap, and quotas."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_STRATA = 100_000


def stratum(cols: Sequence[str]):
    """One key of several columns, null as empty; default without columns."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]) if cols else F.lit("default")


def shuffle_key(seed, salt: str, unit="unit_id"):
    """A keyed hash whose order is a shuffle that any engine can repeat."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), F.col(unit).cast("string")), 256)


def strata_counts(units: DataFrame, cols: Sequence[str]) -> DataFrame:
    return units.groupBy(stratum(cols).alias("stratum")).agg(F.count("*").alias("n"))


def water_fill(counts: Mapping[str, int], total: int) -> dict[str, int]:
    """Quotas of strata in the mapping's order: again and again each that has units left gets an equal share, at least one, until the total is given out."""
    quota, left = dict.fromkeys(counts, 0), total
    while left > 0:
        active = [s for s in counts if quota[s] < counts[s]]
        if not active:
            break
        share = max(1, left // len(active))
        for s in active:
            take = min(share, counts[s] - quota[s], left)
            quota[s] += take
            left -= take
    return quota


def quotas_for(units: DataFrame, cols: Sequence[str], total: int, position: str) -> dict[str, int]:
    """water_fill over strata in the order of their first unit by position. Only (stratum, count) rows reach the driver, at most MAX_STRATA."""
    rows = units.groupBy(stratum(cols).alias("s")).agg(F.count("*").alias("n"), F.min(position).alias("p")).orderBy("p", "s").limit(MAX_STRATA + 1).collect()
    if len(rows) > MAX_STRATA:
        raise ValueError("too many strata")
    if len(rows) > total:
        raise ValueError("more strata than units to draw")
    return water_fill({r.s: r.n for r in rows}, total)


def stratified_sample(units: DataFrame, cols: Sequence[str], total: int, seed, *, unit: str = "unit_id", position: str = "position") -> DataFrame:
    """units drawn by quota: the first of each stratum in shuffled order, with stratum and rank (from 1)."""
    quota = quotas_for(units, cols, total, position)
    table = F.broadcast(units.sparkSession.createDataFrame(list(quota.items()), "stratum string, quota long"))  # MAX_STRATA rows at most
    w = Window.partitionBy("stratum").orderBy("_k", unit)
    ranked = units.withColumn("stratum", stratum(cols)).withColumn("_k", shuffle_key(seed, "sample", unit)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max([0, *quota.values()]))
    return ranked.join(table, "stratum").where(F.col("rank") <= F.col("quota")).drop("_k", "quota")


def allocate(sample: DataFrame, reviewers: Sequence[str], overlap: int, seed, *, unit: str = "unit_id", keep_order: str | None = None) -> DataFrame:
    """(unit, reviewer_id, is_overlap, display_rank): the first `overlap` units in shuffled order (or by keep_order) go to all reviewers, the others in turn.

    display_rank numbers a reviewer's units from 0 in an order of the reviewer's own, or by keep_order. A sample is what people can read, so one window orders it.
    """
    order = [F.col(keep_order)] if keep_order else [shuffle_key(seed, "assign", unit)]
    n = sample.select(F.col(unit), *([keep_order] if keep_order else [])).withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order, unit)) - 1)
    who = F.array(*[F.lit(r) for r in reviewers])
    shared = F.col("_n") < overlap
    turn = F.element_at(who, (F.pmod(F.col("_n") - overlap, F.lit(len(reviewers))) + 1).cast("int"))
    out = n.withColumn("is_overlap", shared).withColumn("reviewer_id", F.explode(F.when(shared, who).otherwise(F.array(turn))))
    rank = [F.col("_n")] if keep_order else [F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit("display"), F.col("reviewer_id"), F.col(unit).cast("string")), 256), F.col(unit)]
    return out.withColumn("display_rank", F.row_number().over(Window.partitionBy("reviewer_id").orderBy(*rank)) - 1).select(unit, "reviewer_id", "is_overlap", "display_rank")


def twister_shuffle(units: DataFrame, seed: str, *, by: str = "stratum", unit: str = "unit_id") -> DataFrame:
    """(stratum, unit, rank): the shuffle of Python's random.Random, seeded by the sha256 of seed and stratum, for byte parity with lists shuffled elsewhere."""
    kind = units.schema[unit].dataType.simpleString()

    def run(p):
        s = str(p[by].iloc[0])
        inner = hashlib.sha256((str(seed) + s).encode()).hexdigest()
        ids = sorted(p[unit].tolist())
        random.Random(int(hashlib.sha256(inner.encode()).hexdigest(), 16) % 2**32).shuffle(ids)
        import pandas as pd

        return pd.DataFrame({by: s, unit: ids, "rank": range(1, len(ids) + 1)})

    return units.select(F.col(by).cast("string").alias(by), unit).groupBy(by).applyInPandas(run, f"{by} string, {unit} {kind}, rank long")


def apportion(counts: Mapping[str, float], total: int) -> dict[str, int]:
    """Whole parts of total by largest remainder; at least one each if total allows."""
    names = sorted(counts)
    base = 1 if total >= len(names) else 0
    left, weight = total - base * len(names), sum(counts.values()) or 1
    exact = {k: left * counts[k] / weight for k in names}
    out = {k: base + int(exact[k]) for k in names}
    for k in sorted(names, key=lambda k: (int(exact[k]) - exact[k], k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def equal_quota(capacity: Mapping[str, int], total: int) -> dict[str, int]:
    """Equal parts of total, none beyond its capacity; what one can't take goes to the others."""
    return water_fill({k: capacity[k] for k in sorted(capacity)}, total)


def preselected(rows: DataFrame) -> DataFrame:
    """(unit_id, position, doc_ids, reason): units in the order of their first row, with their documents in order. rows: unit_id, doc_id, position, selection_reason."""
    docs = F.transform(F.array_sort(F.collect_list(F.struct("position", "doc_id"))), lambda x: x.doc_id)
    return rows.groupBy("unit_id").agg(F.min("position").alias("position"), docs.alias("doc_ids"), F.min_by("selection_reason", "position").alias("reason"))


def hash_order_pool(units: DataFrame, n: int, seed, salt: str = "pool", *, unit: str = "unit_id") -> DataFrame:
    """n units by keyed hash: a random top-off that repeats."""
    return units.orderBy(shuffle_key(seed, salt, unit), unit).limit(n)
