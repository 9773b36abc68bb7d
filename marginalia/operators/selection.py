"""Active-learning selection: uncertainty, round-robin, diversity, batches and label-first quotas."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def uncertainty(pred: DataFrame) -> DataFrame:
    """pred with u: its entropy where there is one, else 1 - consistency (null: 0)."""
    return pred.withColumn("u", F.coalesce("entropy", 1.0 - F.coalesce(F.col("consistency").cast("double"), F.lit(0.0))))


def round_robin(pred: DataFrame, n: int, *, certain: bool = False, label: str = "label_id", unit: str = "unit_id") -> DataFrame:
    """The n rows that turns among the labels give, most uncertain (or certain) first, with label_rank and global_rank; missing scores last."""
    s = F.asc_nulls_last("u") if certain else F.desc_nulls_last("u")
    r = pred.withColumn("label_rank", F.row_number().over(Window.partitionBy(label).orderBy(s, unit))).where(F.col("label_rank") <= n)
    top = r.orderBy("label_rank", label).limit(n)
    return top.withColumn("global_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("label_rank", label)))  # n rows


def quantile_gate(rows: DataFrame, q: float, *, label: str = "label", score: str = "rel") -> DataFrame:
    """Rows at or above their label's q-quantile (linear). Quantiles are aggregated, one row for each label, and met by a join."""
    cut = rows.groupBy(label).agg(F.percentile(score, q).alias("_cut"))
    return rows.join(cut, label).where(F.col(score) >= F.col("_cut")).drop("_cut")


def k_center(rows: DataFrame, by: str, k: int, *, item: str = "vec_id", vector: str = "embedding", start: DataFrame | None = None) -> DataFrame:
    """(by, item, rank): farthest-first points of each group, the first the one farthest from the mean; ties by item.

    start: (by, item, vector) that are chosen before; a group that has any begins with the row farthest from them. They aren't in the result.

    The greedy choice takes k rounds over all rows. In a round every task holds its rows against their group's chosen
    points and hands on its farthest row of each group, of which the group's farthest is chosen; so a group of any size
    is spread over tasks. What is chosen, k points for each group, is on the driver and sent to tasks: groups are
    labels. A chosen item isn't chosen again. Rows with a null item or vector take no part.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (by, item)}
    real = rows.where(F.col(item).isNotNull() & F.col(vector).isNotNull()).select(F.col(by).alias("g"), F.col(item).alias("i"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    per = real.select("g", F.posexplode("v").alias("dim", "x")).groupBy("g", "dim").agg(F.avg("x").alias("x"))
    mean = per.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s.x).alias("v"))
    marks = {r.g: np.array([r.v], float) for r in mean.collect()}
    chosen: dict = {g: [] for g in marks}
    given: dict = {g: [] for g in marks}
    if start is not None:  # a selection so far: of the size of a batch
        for r in start.select(F.col(by).alias("g"), F.col(item).alias("i"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where("v is not null").collect():
            if r.g in given:
                marks[r.g] = np.vstack([marks[r.g], r.v]) if given[r.g] else np.array([r.v], float)
                given[r.g].append(r.i)
    named = {g: g for g in marks}  # pandas may hold labels as other numbers

    def farthest(marks: dict, taken: dict):
        def run(batches):
            best: dict = {}
            for p in batches:
                for g, own in p.groupby("g", dropna=False, sort=False):
                    g = named.get(None if pd.isna(g) else g)
                    if g not in marks:
                        continue
                    own = own[~own["i"].isin(taken[g])]
                    if not len(own):
                        continue
                    x = np.stack(own["v"])
                    far = np.full(len(x), np.inf)
                    for m in marks[g]:
                        far = np.minimum(far, np.linalg.norm(x - m, axis=1))
                    top = own[far == far.max()].sort_values("i").iloc[0]
                    if g not in best or (-far.max(), top["i"]) < best[g][:2]:
                        best[g] = (-far.max(), top["i"], top["v"])
            if best:
                yield pd.DataFrame({"g": pd.Series(list(best), dtype=object), "less": [b[0] for b in best.values()], "i": [b[1] for b in best.values()], "v": [b[2] for b in best.values()]})

        return run

    for _ in range(k):
        ends = real.mapInPandas(farthest(marks, {g: given[g] + chosen[g] for g in marks}), f"g {kinds[by]}, less double, i {kinds[item]}, v array<double>")
        got = ends.groupBy("g").agg(F.min(F.struct("less", "i", "v")).alias("b")).collect()
        for r in got:
            first = not chosen[r.g] and not given[r.g]
            chosen[r.g].append(r.b.i)
            marks[r.g] = np.array([r.b.v]) if first else np.vstack([marks[r.g], r.b.v])
        marks = {r.g: marks[r.g] for r in got}  # the others have no row left
    out = [(g, i, n) for g, items in chosen.items() for n, i in enumerate(items, 1)]
    return rows.sparkSession.createDataFrame(out, f"{by} {kinds[by]}, {item} {kinds[item]}, rank long")


def prototypes(rows: DataFrame, label: str, labels: Sequence, k: int = 8, *, item: str = "vec_id", vector: str = "embedding", seed: int = 5) -> DataFrame:
    """(label, prototype, item, distance): the members nearest to the k-means centres of each label (MLlib, one fit for each label)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    out = None
    x = rows.select(F.col(label), F.col(item), array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("features"))
    for v in labels:
        own = x.where(F.col(label).eqNullSafe(F.lit(v)))
        if own.isEmpty():
            continue
        m = KMeans(k=k, seed=seed, maxIter=10).fit(own)
        centres = F.array(*[F.array(*[F.lit(float(c)) for c in row]) for row in m.clusterCenters()])
        got = m.transform(own).withColumn("_c", F.element_at(centres, F.col("prediction") + 1)).withColumn("_v", vector_to_array("features"))
        d = F.sqrt(F.aggregate(F.zip_with("_c", "_v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
        best = got.withColumn("d", d).groupBy(label, F.col("prediction").alias("prototype")).agg(F.min(F.struct("d", item)).alias("b")).select(label, "prototype", f"b.{item}", F.col("b.d").alias("distance"))
        out = best if out is None else out.union(best)
    return out


def pooled_vectors(rows: DataFrame, unit: str, *, weight: str = "w", vector: str = "embedding", beta: float = 5.0) -> DataFrame:
    """(unit, pooled): each unit's vectors weighted by the softmax of beta times their weight, dimension by dimension, in the JVM."""
    top = rows.groupBy(unit).agg(F.max(weight).alias("_top"))
    e = rows.join(top, unit).select(unit, F.exp(beta * (F.col(weight) - F.col("_top"))).alias("_e"), F.posexplode(vector).alias("dim", "x"))
    per = e.groupBy(unit, "dim").agg((F.sum(F.col("_e") * F.col("x")) / F.sum("_e")).alias("x"))
    return per.groupBy(unit).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s.x).alias("pooled"))


def assemble_batch(buckets: Sequence[tuple[str, DataFrame, int]], total: int, *, unit: str = "unit_id", rank: str = "rank") -> DataFrame:
    """(unit, bucket, position): buckets in order, each up to its quota of units that no bucket before took, then what is left of them up to the total.

    Buckets are ranked candidate lists of batch size.
    """
    both = None
    for i, (name, d, quota) in enumerate(buckets):
        one = d.select(F.col(unit), F.lit(name).alias("bucket"), F.lit(i).alias("_p"), F.lit(quota).alias("_quota"), F.col(rank).alias("_r"))
        both = one if both is None else both.union(one)
    first = both.groupBy(unit).agg(F.min(F.struct("_p", "_r", "bucket", "_quota")).alias("x")).select(unit, "x.*")
    n = F.row_number().over(Window.partitionBy("_p").orderBy("_r", unit))
    own = first.withColumn("_n", n).where(F.col("_n") <= total).withColumn("_over", (F.col("_n") > F.col("_quota")).cast("int"))
    order = Window.partitionBy(F.lit(0)).orderBy("_over", "_p", "_n", unit)
    return own.withColumn("position", F.row_number().over(order)).where(F.col("position") <= total).select(unit, "bucket", "position")


def label_first(pred: DataFrame, targets: Sequence[dict], *, unit: str = "unit_id", position: str = "position") -> DataFrame:
    """(unit, label_id, target, rank): for each target (label_id, values, quota) the first `quota` units by position whose value is one of its values (any non-empty one without values)."""
    hits = None
    v = F.lower(F.trim("prediction_value"))
    for i, t in enumerate(targets):
        ok = v.isin(*[x.lower() for x in t["values"]]) if t.get("values") else F.coalesce(v != "", F.lit(False))
        one = pred.where((F.col("label_id") == t["label_id"]) & ok).select(unit, "label_id", F.lit(i).alias("target"), F.col(position).alias("_pos"), F.lit(t["quota"]).alias("_q"))
        hits = one if hits is None else hits.union(one)
    w = Window.partitionBy("target").orderBy("_pos", unit)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("_q")).select(unit, "label_id", "target", "rank")


def min_max(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """rows with `scaled`: 0 to 1 between the least and the greatest of its group, 0 where they are equal."""
    ends = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    if by:
        both = rows.join(ends, list(by))
    else:
        one = ends.first()
        both = rows.withColumns({"_lo": F.lit(one[0]), "_hi": F.lit(one[1])})
    return both.withColumn("scaled", F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))).drop("_lo", "_hi")


def unseen_pairs(units: DataFrame, labels: Sequence[str], seen: DataFrame) -> DataFrame:
    """(unit_id, label_id) of units and labels that `seen` doesn't hold."""
    every = units.select("unit_id", F.explode(F.array(*[F.lit(x) for x in labels])).alias("label_id"))
    return every.join(seen.select("unit_id", "label_id").distinct(), ["unit_id", "label_id"], "left_anti")


def relaxed_gate(rows: DataFrame, n: int, steps: Sequence[float] = (0.3, 0.2, 0.1, 0.05), *, label: str = "label", score: str = "rel") -> DataFrame:
    """quantile_gate at the first of the steps that leaves a label at least n rows, at the last one where none does; each label by itself, in one aggregation."""
    q = rows.groupBy(label).agg(F.percentile(score, F.array(*[F.lit(s) for s in steps])).alias("_q"), F.count(score).alias("_all"))
    met = rows.join(q, label)
    over = met.groupBy(label).agg(*[F.count(F.when(F.col(score) >= F.col("_q")[i], 1)).alias(f"_n{i}") for i in range(len(steps))])
    cut = F.col("_q")[len(steps) - 1]
    for i in reversed(range(len(steps) - 1)):
        cut = F.when(F.col(f"_n{i}") >= n, F.col("_q")[i]).otherwise(cut)
    return met.join(over, label).where(F.col(score) >= cut).select(*rows.columns)
