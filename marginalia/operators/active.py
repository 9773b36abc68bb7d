"""Active learning: seeds of disagreement, buckets, enriched pools, probes, and label-first sampling by rounds."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import gating, retrieval, sampling, selection

KEY = ["unit_id", "label_id"]


def seeds(scores: DataFrame, hard: DataFrame, consensus: DataFrame, gates: Mapping, kinds: Mapping[str, str], *, threshold: float = 0.5, per_label: int = 10) -> DataFrame:
    """(unit_id, label_id, score, rank): pairs of high disagreement, or of hard one (hard), the per_label highest of each label.

    A gated label's pair counts only where the consensus (unit_id, label_id, value) of its parents lets the label
    apply. Pairs are taken once; ties by unit.
    """
    both = scores.join(hard.where("hard").select(*KEY, F.lit(True).alias("_h")).distinct(), KEY, "left").where((F.col("score") >= threshold) | F.col("_h"))
    one = both.groupBy(*KEY).agg(F.max("score").alias("score"))
    if gates:
        ok = gating.eligibility(consensus.select("unit_id", "label_id", F.col("value").alias("prediction_value")), dict(gates), dict(kinds)).withColumnRenamed("child", "label_id")
        gated = F.col("label_id").isin(*gates)
        one = one.join(ok, KEY, "left").where(~gated | F.coalesce("eligible", F.lit(False)))
    w = Window.partitionBy("label_id").orderBy(F.desc("score"), "unit_id")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_label).select(*KEY, "score", "rank")


def seed_snippets(pairs: DataFrame, rationales: DataFrame, found: DataFrame) -> DataFrame:
    """(unit_id, label_id, snippets): the rationales that reviewers marked for a pair, or what retrieval found where there are none. rationales, found: (unit_id, label_id, position, snippet)."""
    listed = lambda d: d.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "snippet"))), lambda x: x.snippet).alias("s"))
    out = pairs.select(*KEY).join(listed(rationales).withColumnRenamed("s", "_a"), KEY, "left").join(listed(found).withColumnRenamed("s", "_b"), KEY, "left")
    return out.select(*KEY, F.coalesce("_a", "_b", F.array().cast("array<string>")).alias("snippets"))


def disagreement_bucket(rows: DataFrame, total: int, roots: Sequence[str], *, weight: Mapping[str, float] | None = None) -> DataFrame:
    """(unit_id, label_id, selection_reason): `total` pairs of rows (unit_id, label_id, embedding) by the labels' mix.

    Labels share the total by their rows, or by weight, each at least one if it suffices (apportion), and none more than it has.
    Each label's are chosen by k-center, roots (disagreement_parent) and then the others (disagreement_child). What is
    missing then is filled by k-center over all labels, farthest from what is chosen: children before parents (.._topup).
    """
    have = {r.label_id: r.n for r in rows.groupBy("label_id").agg(F.count("*").alias("n")).collect()}  # labels are few
    if not have or total <= 0:
        return rows.select(*KEY, F.lit("").alias("selection_reason")).limit(0)
    mix = {k: (weight or have).get(k, 0) for k in have}
    quota = {k: min(n, have[k]) for k, n in sampling.apportion({k: v for k, v in mix.items() if v > 0} or have, total).items()}
    spark = rows.sparkSession
    pick = selection.k_center(rows, "label_id", max(quota.values()), item="unit_id")
    table = spark.createDataFrame([(k, n, k in roots) for k, n in quota.items()], "label_id string, quota long, root boolean")
    chosen = pick.join(table, "label_id").where(F.col("rank") <= F.col("quota"))
    chosen = chosen.select(*KEY, F.when(F.col("root"), "disagreement_parent").otherwise("disagreement_child").alias("selection_reason"))
    n = sum(quota.values())
    for parents, name in ((False, "disagreement_child_topup"), (True, "disagreement_parent_topup")):
        if n >= total:
            break
        rest = rows.where(F.col("label_id").isin(*roots) if parents else ~F.col("label_id").isin(*roots)) if roots else rows.where(F.lit(not parents))
        pair = F.concat_ws("\u0001", "label_id", "unit_id")
        left = rest.join(chosen.select(*KEY), KEY, "left_anti").select(F.lit("all").alias("g"), pair.alias("p"), "embedding")
        start = rows.join(chosen.select(*KEY), KEY).select(F.lit("all").alias("g"), pair.alias("p"), "embedding")
        more = selection.k_center(left, "g", total - n, item="p", start=start)
        got = more.select(F.substring_index("p", "\u0001", -1).alias("unit_id"), F.substring_index("p", "\u0001", 1).alias("label_id"), F.lit(name).alias("selection_reason"))
        chosen = chosen.unionByName(got)
        n += more.count()
    return chosen


def label_pooled(snippets: DataFrame, prototypes: DataFrame, chunks: DataFrame, units: DataFrame, *, beta: float = 5.0, size: int = 64) -> DataFrame:
    """(unit_id, label_id, pooled, how): a vector of each pair of units.

    snippets (unit_id, label_id, embedding) weighted by the softmax of beta times their largest cosine with the label's
    prototypes (label_id, embedding); without a prototype the largest number of each dimension; without snippets the mean of the
    unit's chunks (unit_id, embedding); without these a vector that follows from a hash of the unit.
    """
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)) + 1e-12
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    d = lambda c: F.transform(c, lambda x: x.cast("double"))
    marks = prototypes.groupBy("label_id").agg(F.collect_list(d("embedding")).alias("_marks"))  # eight or so for each label
    s = snippets.select(*KEY, d("embedding").alias("v")).join(marks, "label_id", "left")
    near = F.array_max(F.transform("_marks", lambda m: dot(m, F.col("v")) / (norm(m) * norm(F.col("v")))))
    s = s.withColumn("w", near)
    top = s.groupBy(*KEY).agg(F.max("w").alias("_top"))
    dims = s.join(top, KEY).select(*KEY, "w", F.exp(beta * (F.col("w") - F.col("_top"))).alias("_e"), F.posexplode("v").alias("dim", "x"))
    per = dims.groupBy(*KEY, "dim").agg(F.when(F.max("w").isNotNull(), F.sum(F.col("_e") * F.col("x")) / F.sum("_e")).otherwise(F.max("x")).alias("x"), F.max("w").isNotNull().alias("p"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda r: r.x)
    mine = per.groupBy(*KEY).agg(listed.alias("_a"), F.max("p").alias("_p"))
    mean = chunks.select("unit_id", F.posexplode(d("embedding")).alias("dim", "x")).groupBy("unit_id", "dim").agg(F.avg("x").alias("x")).groupBy("unit_id").agg(listed.alias("_b"))
    made = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.pmod(F.xxhash64("unit_id", i), F.lit(2001)) / 1000.0 - 1.0)
    out = units.select(*KEY).join(mine, KEY, "left").join(mean, "unit_id", "left")
    how = F.when(F.col("_a").isNotNull(), F.when(F.col("_p"), "attention").otherwise("max")).when(F.col("_b").isNotNull(), "mean").otherwise("hash")
    return out.select(*KEY, F.coalesce("_a", "_b", made).alias("pooled"), how.alias("how"))


def diversity_bucket(rows: DataFrame, anchors: DataFrame, total: int, seed, *, cap: int | None = None, steps: Sequence[float] = (0.3, 0.2, 0.1, 0.05), trade: float = 0.5, chosen: DataFrame | None = None) -> DataFrame:
    """(unit_id, rank): `total` units that are relevant to labels and unlike one another and those chosen before.

    rows (unit_id, label_id, embedding): relevance is the cosine with the label's anchor (label_id, embedding). With cap, a
    keyed shuffle leaves that many candidates of each label, as the reference's option does. Each label's rows
    below a quantile are left out (relaxed_gate), labels get equal quotas (equal_quota), which MMR fills; the units' mean vectors then go
    through k-center, begun by `chosen` (unit_id, embedding).
    """
    d = lambda c: F.transform(c, lambda x: x.cast("double"))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)) + 1e-12
    both = rows.select(*KEY, d("embedding").alias("v")).join(anchors.select("label_id", d("embedding").alias("a")), "label_id")
    rel = F.aggregate(F.zip_with("v", "a", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / (norm(F.col("v")) * norm(F.col("a")))
    pool = both.select(*KEY, F.col("v").alias("embedding"), rel.alias("rel"))
    if cap is not None:
        w = Window.partitionBy("label_id").orderBy(sampling.shuffle_key(seed, "diversity"), "unit_id")
        pool = pool.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")
    sizes = {r.label_id: r.n for r in pool.groupBy("label_id").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return rows.select("unit_id", F.lit(0).cast("long").alias("rank")).limit(0)
    quota = sampling.equal_quota(sizes, 2 * total)
    gated = selection.relaxed_gate(pool, max(quota.values()), steps, label="label_id")
    picks = retrieval.mmr(gated, "label_id", max(quota.values()), item="unit_id", score="rel", trade=trade)
    table = rows.sparkSession.createDataFrame(list(quota.items()), "label_id string, quota long")
    kept = gated.join(picks.join(table, "label_id").where(F.col("rank") <= F.col("quota")).select(*KEY), KEY)
    per = kept.select("unit_id", F.posexplode("embedding").alias("dim", "x")).groupBy("unit_id", "dim").agg(F.avg("x").alias("x"))
    mean = per.groupBy("unit_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda r: r.x).alias("embedding"))
    start = chosen.select(F.lit("all").alias("g"), "unit_id", "embedding") if chosen is not None else None
    return selection.k_center(mean.select(F.lit("all").alias("g"), "unit_id", "embedding"), "g", total, item="unit_id", start=start).select("unit_id", "rank")


def enriched_pool(units: DataFrame, scores: DataFrame, n: int, seed) -> DataFrame:
    """(unit_id, position, score): the n best units by their highest score (unit_id, score), filled from the others in shuffled order. Two top-n, no sort of all units."""
    best = units.select("unit_id").distinct().join(scores.groupBy("unit_id").agg(F.max("score").alias("score")), "unit_id", "left")
    k = sampling.shuffle_key(seed, "pool")
    top = best.orderBy(F.desc_nulls_last("score"), k, "unit_id").limit(n)
    return top.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("score"), k, "unit_id"))).select("unit_id", "position", "score")  # n rows


def probe_sample(units: DataFrame, scores: DataFrame | None, parents: Sequence[str], n: int, seed) -> DataFrame:
    """(unit_id, parent, score): n units to try labels on: without scores by shuffled order, else equal shares of the parents, a unit going to the parent (label_id) that scores it highest (ties: the first), the best first, filled with the best of the rest."""
    if scores is None:
        return sampling.hash_order_pool(units.select("unit_id").distinct(), n, seed, "probe").select("unit_id", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("double").alias("score"))
    own = scores.where(F.col("label_id").isin(*parents)).join(units.select("unit_id").distinct(), "unit_id", "left_semi")
    best = own.groupBy("unit_id").agg(F.max(F.struct("score", (-F.array_position(F.array(*[F.lit(p) for p in parents]), F.col("label_id"))).alias("o"), F.col("label_id").alias("parent"))).alias("b")).select("unit_id", "b.parent", "b.score")
    sizes = {r.parent: r.n for r in best.groupBy("parent").agg(F.count("*").alias("n")).collect()}
    quota = sampling.equal_quota({p: sizes.get(p, 0) for p in parents}, n)
    table = units.sparkSession.createDataFrame(list(quota.items()), "parent string, quota long")
    w = Window.partitionBy("parent").orderBy(F.desc("score"), "unit_id")
    return best.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max([1, *quota.values()])).join(table, "parent").where(F.col("_r") <= F.col("quota")).select("unit_id", "parent", "score")


def label_first_rounds(pool: DataFrame, label: Callable[[DataFrame], DataFrame], targets: Sequence[dict], total: int, seed, *, start: int = 200, step: int = 100, most: int = 2000, shuffled: DataFrame | None = None) -> DataFrame:
    """(unit_id, label_id, target, rank, reason): units whose predicted values meet targets, found by labelling a growing part of a pool.

    pool (unit_id, position): the first `start` units are labelled, then `step` more as long as a target lacks units and
    fewer than `most` are labelled; when the pool runs out, units of `shuffled` (unit_id, position) follow. Each unit is labelled once. Targets
    admit units by position (label_first); what is missing to `total` then comes from the labelled units that no target took, in shuffled order (reason random).
    """
    order = pool.select("unit_id", "position")
    if shuffled is not None:
        after = pool.agg(F.max("position")).first()[0] or 0
        order = order.unionByName(shuffled.join(pool, "unit_id", "left_anti").select("unit_id", (F.col("position") + after).alias("position")))
    cut = Window.partitionBy(F.lit(0)).orderBy("position", "unit_id")
    head = order.orderBy("position", "unit_id").limit(most).withColumn("position", F.row_number().over(cut)).cache()  # at most `most` units
    n, done, seen = min(start, most), None, 0
    try:
        while True:
            new = label(head.where((F.col("position") > seen) & (F.col("position") <= n)).select("unit_id")).select("unit_id", "label_id", "prediction_value")
            rows = [tuple(r) for r in new.collect()]
            done = (done or []) + rows
            pred = pool.sparkSession.createDataFrame(done, new.schema).join(head, "unit_id")
            admitted = selection.label_first(pred, targets)
            counts = {r.target: r.n for r in admitted.groupBy("target").agg(F.count("*").alias("n")).collect()}
            open_ = [i for i, t in enumerate(targets) if counts.get(i, 0) < t["quota"]]
            if not open_ or n >= most or n >= head.count():
                break
            seen, n = n, min(n + step, most)
        taken = admitted.withColumn("reason", F.lit("label_first"))
        units = taken.select("unit_id").distinct()
        lack = total - units.count()
        if lack > 0:
            left = pred.select("unit_id").distinct().join(units, "unit_id", "left_anti")
            more = sampling.hash_order_pool(left, lack, seed, "topoff")
            taken = taken.unionByName(more.select("unit_id", F.lit(None).cast("string").alias("label_id"), F.lit(None).cast("int").alias("target"), F.lit(None).cast("int").alias("rank"), F.lit("random").alias("reason")))
        out = [tuple(r) for r in taken.collect()]
        return pool.sparkSession.createDataFrame(out, taken.schema)
    finally:
        head.unpersist()


def unresolved(admitted: DataFrame, targets: Sequence[dict]) -> list[tuple[int, int]]:
    """(target, units it lacks) of targets that aren't filled."""
    got = {r.target: r.n for r in admitted.where("target is not null").groupBy("target").agg(F.count("*").alias("n")).collect()}
    return [(i, t["quota"] - got.get(i, 0)) for i, t in enumerate(targets) if got.get(i, 0) < t["quota"]]


def without_units(selected: DataFrame, excluded: DataFrame, reasons: Sequence[str] = ("llm_", "diversity")) -> DataFrame:
    """selected without rows of excluded units whose selection_reason begins with one of reasons."""
    hit = F.lit(False)
    for r in reasons:
        hit = hit | F.col("selection_reason").startswith(r)
    both = selected.join(excluded.select("unit_id").distinct().withColumn("_x", F.lit(True)), "unit_id", "left")
    return both.where(~(F.coalesce("_x", F.lit(False)) & F.coalesce(hit, F.lit(False)))).drop("_x")
