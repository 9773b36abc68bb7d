import random
from collections import defaultdict

from pyspark.sql import functions as F

from marginalia.llm import lines

from .helpers import odd_docs


def brute(docs, min_chars=20, min_docs=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= min_chars:
                held[key(x)].add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    return sorted(((i, len((t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if not (i is not None and key(x) in gone and i < gone[key(x)]))) for i, t in docs), key=str)


def corpus():
    r = random.Random(4)
    pool = ["A line that many documents share " + str(i) for i in range(6)] + ["éèê" * 5, "ü" * 20, "short", "  \t", "", "Ein Satz mit genau zwan", "x" * 19, "y" * 20]
    docs = [(i, "\n".join(r.choice([str.upper, str, lambda x: "  " + x + "\r"])(r.choice(pool)) if r.random() < 0.7 else f"a line of document {i} alone {r.random()}" for _ in range(r.randint(0, 12)))) for i in range(60)]
    return docs + [(60, None), (61, ""), (7, docs[7][1]), (None, pool[0] + "\n" + pool[1])]


def test_against_brute_force_in_one_and_in_many_batches(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for parts in (None, [docs.where(F.coalesce(F.col("doc_id") % 5, F.lit(0)) == k) for k in range(5)]):
        got = lines.line_dedup(docs, batches=parts).collect()
        assert sorted(((r.doc_id, r.n_lines, r.text) for r in got), key=str) == want
        assert all(r.n_dropped == r.n_lines - len(r.text.split("\n")) or r.text == "" for r in got)


def test_runs_are_levelled_and_merged(spark):
    runs = lines.LineRuns(spark, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(k % 2, 1, 9), (k, 2, k)], "h1 long, h2 long, doc long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert runs.merged().count() == 2 + 5
    for k in range(5, 8):  # goes on after merging
        runs.add(spark.createDataFrame([(0, 1, k), (k, 2, k)], "h1 long, h2 long, doc long"))
    assert {(r.h1, r.h2): list(r.docs) for r in runs.merged().collect()} == {(0, 1): [9, 7, 6], (1, 1): [9], **{(k, 2): [k] for k in range(8)}}
    assert [tuple(r) for r in runs.doomed().collect()] == [(0, 1, 9)]
    runs.close()


def test_batches_add_only_what_the_runs_do_not_know(spark):
    runs = lines.LineRuns(spark)
    runs.add(spark.createDataFrame([(1, 1, d) for d in (5, 6, 7, 8)] + [(2, 1, 8), (3, 1, 1), (3, 1, 2), (3, 1, 3)], "h1 long, h2 long, doc long"))
    batch = spark.createDataFrame([(1, 1, 4), (1, 1, 8), (2, 1, 4), (2, 1, 4), (3, 1, 9), (4, 1, 4)], "h1 long, h2 long, doc long")
    fresh = runs.fresh(batch)
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in plan
    assert {(r.h1, tuple(r.docs)) for r in fresh.collect()} == {(2, (4,)), (3, (9,)), (4, (4,))}
    runs.close()


def test_odd(spark):
    d = odd_docs(spark)
    got = lines.line_dedup(d)
    assert got.count() == 12 and set(d.columns) <= set(got.columns) and dict(got.dtypes)["n_lines"] == "bigint"
    assert lines.line_dedup(d.limit(0), digest=True).count() == 0
