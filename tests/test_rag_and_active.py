import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import active, export, ingest, jobs, labeling, prompts, rag, retrieval, selection
from marginalia.sources import tables


def vectors(n, dim=6, seed=1):
    r = np.random.default_rng(seed)
    return [[float(x) for x in v] for v in r.standard_normal((n, dim))]


def chunks(spark, units=3, each=12):
    v = vectors(units * each)
    words = ["fever", "cough", "rash", "knee", "pain", "clear"]
    rows = [(f"u{i % units}", f"d{i // 4}", i % 4, f"{words[i % 6]} and {words[(i // 2) % 6]} seen {i}", v[i]) for i in range(units * each)]
    return rows, spark.createDataFrame(rows, "unit_id string, doc_id string, chunk_id long, text string, embedding array<double>")


def test_retrieve_pads_small_pools_and_tops_off(spark):
    rows = [("u1", "d1", i, f"fever {i}" if i == 2 else f"other {i}", [1.0, 0.0] if i == 2 else None) for i in range(6)]
    rows += [("u2", "d2", 0, "nothing of it", None)]
    d = spark.createDataFrame(rows, "unit_id string, doc_id string, chunk_id long, text string, embedding array<double>")
    got = rag.retrieve(d, [rag.LabelQuery("l", [[1.0, 0.0]], ["fever"], "fever")], 4, min_k=3)
    assert [(r.unit_id, r.chunk_id, r.source) for r in got.orderBy("rank").collect()] == [("u1", 2, "pool"), ("u1", 1, "neighbor"), ("u1", 3, "neighbor")]
    assert rag.retrieve(d.limit(0), [rag.LabelQuery("l", [[1.0, 0.0]], ["fever"], "fever")], 4).count() == 0


def test_diverse_retrieval_is_the_greedy_choice(spark):
    rows, d = chunks(spark)
    q = rag.LabelQuery("l", [[1.0, 0, 0, 0, 0, 0]], [], "fever pain")
    got = {}
    for r in rag.retrieve(d, [q], 4, mmr=0.6).orderBy("unit_id", "rank").collect():
        got.setdefault(r.unit_id, []).append((r.doc_id, r.chunk_id))
    for u in ("u0", "u1", "u2"):
        own = [r for r in rows if r[0] == u]
        sem = sorted(own, key=lambda r: (-round(r[4][0] / (np.linalg.norm(r[4]) + 1e-12), 9), r[1], r[2]))[:12]
        pool = [(len({"fever", "pain"} & set(r[3].split())) / 2, r) for r in sem]
        pool.sort(key=lambda x: (-round(x[0], 9), -round(x[1][4][0] / np.linalg.norm(x[1][4]), 9), x[1][1], x[1][2]))
        x = np.array([r[4] for _, r in pool])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        chosen = []
        while len(chosen) < 4:
            value = [0.6 * s - 0.4 * (max(x[i] @ x[j] for j in chosen) if chosen else 0) if i not in chosen else -9 for i, (s, _) in enumerate(pool)]
            chosen.append(int(np.argmax(value)))
        assert got[u] == [(pool[i][1][1], pool[i][1][2]) for i in chosen]


def test_retrieval_makes_the_chunks_and_scores_the_pools_once(spark):
    _, d = chunks(spark)
    made, scored = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def run(batches):
        for p in batches:
            made.add(len(p))
            yield p

    def score(query, texts):
        scored.add(len(texts))
        return [float(len(t)) for t in texts]

    got = rag.retrieve(d.mapInPandas(run, d.schema), [rag.LabelQuery("l", [[1.0, 0, 0, 0, 0, 0]], ["fever"], "fever")], 3, mmr=0.6, score=score)
    assert got.count() == 9 and len(got.collect()) == 9
    assert made.value == 36 and scored.value <= 36


def test_rerank_scores_each_pair_once_with_the_best_query(spark):
    d = spark.createDataFrame([("l", "fever b"), ("l", "fever b"), ("m", None), ("x", "b")], "label_id string, text string")
    got = rag.rerank(d, {"l": ["fever", "zz"], "m": ["fever"]}).collect()
    assert sorted((r.label_id, r.ce) for r in got) == [("l", 1.0), ("l", 1.0), ("m", 0.0), ("x", 0.0)]


def test_chunk_index_is_read_again_for_the_same_documents(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "h1", "some text " * 30), ("d2", "h2", "")], "doc_id string, hash string, text string")
    calls = []

    def embed(d):
        calls.append(1)
        return retrieval.hashed_embedding(d, size=8)

    a = rag.chunk_index(docs, embed, str(tmp_path), size=64, overlap=8)
    b = rag.chunk_index(docs.orderBy("doc_id", ascending=False), embed, str(tmp_path), size=64, overlap=8)
    assert len(calls) == 1 and a.count() == b.count() > 4 and set(a.columns) == {"doc_id", "chunk_id", "start", "text", "embedding"}
    rag.chunk_index(docs, embed, str(tmp_path), size=64, overlap=8, settings={"model": "x"})
    a = rag.chunk_index(docs, embed, str(tmp_path), size=64, overlap=8, rebuild=True)
    assert len(calls) == 3
    units = spark.createDataFrame([("u", "d1"), ("u", "d1"), ("v", "d1")], "unit_id string, doc_id string")
    assert rag.with_units(a, units).where("doc_id = 'd1'").count() == 2 * a.where("doc_id = 'd1'").count()


def farthest(points, k, start=()):
    marks = [p for _, p in start] or [np.mean([p for _, p in points], axis=0)]
    left, out = sorted(points, key=lambda x: x[0]), []
    while left and len(out) < k:
        dist = [min(np.linalg.norm(np.array(p) - m) for m in map(np.array, marks)) for _, p in left]
        i = int(np.argmax(dist))
        marks = [*([] if not out and not start else marks), left[i][1]]
        out.append(left.pop(i)[0])
    return out


def test_k_center_with_a_start(spark):
    v = vectors(40, 4)
    rows = [("g", i, v[i]) for i in range(40)]
    d = spark.createDataFrame(rows, "g string, i long, v array<double>")
    start = d.where("i < 3")
    got = [r.i for r in selection.k_center(d, "g", 5, item="i", vector="v", start=start).orderBy("rank").collect()]
    assert got == farthest([(i, v[i]) for i in range(3, 40)], 5, [(i, v[i]) for i in range(3)])


def test_disagreement_bucket_has_quotas_and_topups(spark):
    v = vectors(30, 4, 3)
    rows = [(f"u{i:02}", "root" if i < 6 else "child" if i < 28 else "rare", v[i]) for i in range(30)]
    d = spark.createDataFrame(rows, "unit_id string, label_id string, embedding array<double>")
    got = active.disagreement_bucket(d, 12, ["root"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.selection_reason, set()).add(r.unit_id)
    quota = {"child": 8, "rare": 2, "root": 3}  # one each, and nine by 22 : 2 : 6, largest remainders first
    from marginalia.operators.sampling import apportion

    quota = apportion({"root": 6, "child": 22, "rare": 2}, 12)
    pick = lambda k: set(farthest([(r[0], r[2]) for r in rows if r[1] == k], min(quota[k], sum(x[1] == k for x in rows))))
    assert by["disagreement_parent"] == pick("root") and by["disagreement_child"] == pick("child") | pick("rare") and len(got) == 12
    few = active.disagreement_bucket(d.where("label_id <> 'child'"), 8, ["root"], weight={"root": 1, "rare": 7}).collect()
    assert len(few) == 8 and sum(r.selection_reason == "disagreement_parent_topup" for r in few) == 8 - 2 - min(6, apportion({"root": 1, "rare": 7}, 8)["root"])
    assert active.disagreement_bucket(d.limit(0), 5, []).count() == 0


def test_diversity_bucket(spark):
    v = vectors(60, 4, 5)
    rows = [(f"u{i:02}", "ab"[i % 2], v[i]) for i in range(60)]
    d = spark.createDataFrame(rows, "unit_id string, label_id string, embedding array<double>")
    anchors = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0, 0.0])], "label_id string, embedding array<double>")
    got = [r.unit_id for r in active.diversity_bucket(d, anchors, 6, 1, steps=(0.5,), chosen=d.where("unit_id in ('u00', 'u01')")).orderBy("rank").collect()]
    rel = {r[0]: (r[2][0] if r[1] == "a" else r[2][1]) / np.linalg.norm(r[2]) for r in rows}
    cut = {k: np.quantile([rel[r[0]] for r in rows if r[1] == k], 0.5) for k in "ab"}
    assert len(got) == len(set(got)) == 6 and all(rel[u] >= cut["ab"[int(u[1:]) % 2]] - 1e-12 for u in got)


def test_pooled_vectors_of_pairs_without_anything(spark):
    none = spark.createDataFrame([], "unit_id string, label_id string, embedding array<double>")
    units = spark.createDataFrame([("u", "l"), ("v", "l")], "unit_id string, label_id string")
    got = active.label_pooled(none, none.select("label_id", "embedding"), none.select("unit_id", "embedding"), units, size=5).collect()
    assert {r.how for r in got} == {"hash"} and all(len(r.pooled) == 5 and all(-1 <= x <= 1 for x in r.pooled) for r in got) and got[0].pooled != got[1].pooled


def test_label_first_grows_tops_off_and_reports(spark):
    pool = spark.createDataFrame([(f"u{i:03}", i) for i in range(1, 41)], "unit_id string, position long")
    asked = []

    def label(units):
        ids = [r.unit_id for r in units.collect()]
        asked.append(len(ids))
        return spark.createDataFrame([(u, "l", "yes" if int(u[1:]) % 10 == 0 else "no") for u in ids], "unit_id string, label_id string, prediction_value string")

    targets = [{"label_id": "l", "values": ["yes"], "quota": 3}]
    got = active.label_first_rounds(pool, label, targets, 5, 1, start=12, step=10, most=100).collect()
    assert asked == [12, 10, 10] and [r.unit_id for r in got if r.reason == "label_first"] == ["u010", "u020", "u030"] and sum(r.reason == "random" for r in got) == 2
    asked.clear()
    more = spark.createDataFrame([(f"u{i:03}", i - 40) for i in range(41, 71)], "unit_id string, position long")
    got = active.label_first_rounds(pool, label, [{"label_id": "l", "values": ["yes"], "quota": 9}], 0, 1, start=40, step=20, most=60, shuffled=more)
    assert asked == [40, 20] and active.unresolved(got, [{"quota": 9}]) == [(0, 3)]


def test_votes_repeat_and_stay_in_range(spark):
    d = spark.createDataFrame([("u", "l", f"d{i}", i, i) for i in range(20)], "unit_id string, label_id string, doc_id string, chunk_id long, rank long")
    plan = lambda seed: [tuple(r) for r in prompts.vote_snippets(d, 50, top=(3, 6), dropout=0.3, temperatures=(0.2, 0.9), seed=seed).orderBy("vote", "place").collect()]
    a = plan(1)
    assert a == plan(1) != plan(2)
    by = {}
    for r in a:
        by.setdefault(r[2], []).append(r)
    assert len(by) == 50 and all(1 <= len(v) <= 6 and any(r[5] == 0 for r in v) and all(r[5] < 6 for r in v) and len({r[6] for r in v}) == 1 and 0.2 <= v[0][6] <= 0.9 for v in by.values())
    assert len({len(v) for v in by.values()}) > 2 and len({tuple(r[5] for r in v) for v in by.values()}) > 20


def test_calls_are_asked_again_and_units_routed(spark):
    d = spark.createDataFrame([("u1", "l", "p1"), ("u2", "l", "p2")], "unit_id string, label_id string, prompt string")

    def ask(texts):
        return ['{"a": 1}' if t == "p1" or len(texts) == 1 else "no" for t in texts]

    got = prompts.call_json(d.coalesce(1), ask).collect()
    assert {r.answer for r in got} == {'{"a": 1}'}
    labels = {"l": {"type": "binary"}, "n": {"type": "numeric"}}
    rows = spark.createDataFrame([("u", "l"), ("u", "n")], "unit_id string, label_id string")
    out = prompts.label_units(rows, labels, lambda x: x.withColumn("prediction_value", F.lit("yes")).withColumn("entropy", F.lit(0.3)), lambda x: x.withColumn("prediction_value", F.lit("3")).withColumn("consistency", F.lit(0.75)))
    assert {(r.label_id, r.prediction_value, r.u) for r in out.collect()} == {("l", "yes", 0.3), ("n", "3", 0.25)}


def test_multi_prompts_are_cut_in_parts(spark):
    d = spark.createDataFrame([("u", "x" * 50)], "unit_id string, context string")
    labels = {k: {"rules": k} for k in ("c", "a", "b")}
    labels["b"]["gating_expr"] = "c == 'yes'"
    got = prompts.multi_prompts(d, labels, max_labels=2, max_chars=10).orderBy("part").collect()
    assert [r.labels for r in got] == [["a", "c"], ["b"]] and all(r.prompt.endswith("Notes:\n" + "x" * 10) for r in got)


def test_pairwise_votes_of_any_number(spark):
    r = random.Random(3)
    v = [round(r.gauss(50, 9), 1) for _ in range(400)]
    d = spark.createDataFrame([("q", x) for x in v] + [("one", 3.0), ("none", None)], "k string, vote double")
    got = {x.k: x for x in labeling.numeric_consistency(d, ["k"]).collect()}
    m = float(np.median(v))
    want = np.mean([math.exp(-abs(a - b) / max(1, 0.05 * abs(m))) for i, a in enumerate(v) for b in v[i + 1 :]])
    assert abs(got["q"].consistency - want) < 1e-9 and got["q"].median == m and got["one"].consistency == 1.0 and "none" not in got


def test_outputs(spark, tmp_path):
    p = str(tmp_path)
    docs = spark.createDataFrame([("d1", "one"), ("d2", "two")], "doc_id string, text string")
    notes = spark.createDataFrame([("u1", "d1", 0), ("u2", "d2", 0)], "unit_id string, doc_id string, order_index int")
    given = spark.createDataFrame([("r1", "u1", 0, True), ("r2", "u1", 0, True), ("r2", "u2", 1, False)], "reviewer_id string, unit_id string, display_rank int, is_overlap boolean")
    export.write_bundles(given, notes, docs, ["a", "b"], p)
    ann = spark.read.parquet(f"{p}/annotations.parquet")
    assert ann.where("reviewer_id = 'r2'").count() == 4 and ann.where("reviewer_id = 'r1'").count() == 2 and spark.read.parquet(f"{p}/documents.parquet").where("reviewer_id = 'r1'").count() == 1
    gold = spark.createDataFrame([("u1", "a", "yes")], "unit_id string, label_id string, gold_value string")
    export.write_gold(gold, p)
    assert tables.read_table(spark, f"{p}/gold.csv").first() == gold.first() and tables.read_table(spark, f"{p}/gold.jsonl").count() == 1
    pred = spark.createDataFrame([("u1", "a", "yes", "since", '[{"x":1}]'), ("u1", "b", "no", None, None)], "unit_id string, label_id string, prediction_value string, reasoning string, runs string")
    export.write_predictions(pred, ["a", "b"], p)
    assert spark.read.parquet(f"{p}/predictions_wide.parquet").first().asDict() == {"unit_id": "u1", "a_llm": "yes", "b_llm": "no", "a_reasoning": "since", "b_reasoning": None}
    assert tables.read_table(spark, f"{p}/calls.jsonl").count() == 1
    export.write_selection({"certain": gold, "diversity": gold}, gold, p)
    assert spark.read.parquet(f"{p}/bucket_certain.parquet").count() == tables.read_table(spark, f"{p}/ai_next_batch.csv").count() == 1
    export.write_experiment(p, gold, pred, gold, {"name": "x"})
    assert (tmp_path / "experiments.json").read_text().strip().startswith("{")
    export.write_aggregate(ann, spark.createDataFrame([(1, "u", "d2"), (1, "u", "d1")], "round_id int, unit_id string, doc_id string"), p)
    assert spark.read.parquet(f"{p}/unit_summary.parquet").first().doc_id == "d1"
    with pytest.raises(KeyError):
        export.documents_by_id(docs, spark.createDataFrame([("d9",)], "doc_id string"))


def test_limits_and_cancellation(spark):
    import time

    d = spark.range(6).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        t = time.monotonic()
        assert jobs.limited(d, lambda p: p, "id long", per_minute=120).count() == 6
        assert time.monotonic() - t >= 1.0  # three calls, half a second apart
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with jobs.Cancellable(spark, "run 1") as c:
        assert "run_1" in spark.getTags()
        c.cancel()
    assert c.cancelled and "run_1" not in spark.getTags()


def test_label_graph():
    from marginalia.operators import gating as G

    labels = {"a": {"name": "A b"}, "c": {"gating_expr": "A b == 'yes'"}, "d": {"gating_expr": "c == 'x' and a == 'y'"}, "e": {"gating_expr": "zz == 1"}}
    children, parents, roots = G.label_graph(labels)
    assert children == {"a": ["c", "d"], "c": ["d"]} and parents == {"c": ["a"], "d": ["a", "c"]} and roots == ["a", "e"]
    assert G.ancestors(parents, "d") == ["a", "c"] and G.ancestors({"x": ["y"], "y": ["x"]}, "x") == ["y"] and G.prompt_order(labels) == ["a", "e", "c", "d"]
    assert G.dependency_tree({"x": ["y"], "y": ["x"]}, ["x"]) == [{"label": "x", "children": [{"label": "y", "children": [{"label": "x", "cycle": True, "children": []}]}]}]
    assert G.dependency_tree(children, ["a"])[0]["children"][0]["children"][0]["label"] == "d"


def test_completion_keeps_the_old_time_when_opened_again(spark):
    old = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "k int, completed_at int")
    new = spark.createDataFrame([(1, False, 99), (3, True, 33)], "k int, complete boolean, at int")
    assert {r.k: r.completed_at for r in ingest.completion_times(old, new, ["k"]).collect()} == {1: 10, 2: 20, 3: 33}
