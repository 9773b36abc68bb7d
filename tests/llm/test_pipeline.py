import hashlib
import re

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import bpe, mixing

from .helpers import odd_docs
from .test_lines import brute as line_brute
from .test_ngrams import brute as near_brute

SF = "/root/testdata/sf0.001"


def check(spark, docs, sf):
    """Each stage against brute force on what the one before kept."""
    cols = docs.columns
    rows = [r.asDict() for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        got = [r.asDict() for r in out.collect()]
        if name != "encode":
            assert out.columns == cols
        if name == "language":
            want = [(r["doc_id"], r["text"]) for r in rows if r["text"] and re.search(r"[^\W\d_]", r["text"])]
            assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)
        elif name == "line_dedup":
            want = line_brute([(r["doc_id"], r["text"]) for r in rows])
            given = {(r["doc_id"], r["text"]) for r in rows}
            stays = lambda i, t: (i, t) in given or re.search(r"[^\W_]", t)  # noqa: E731, B023
            assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(((i, t) for i, _, t in want if stays(i, t)), key=str)
        elif name == "near_dups":
            ids = [r for r in rows if r["doc_id"] is not None]
            comp = near_brute([(r["doc_id"], r["text"]) for r in ids])
            assert sorted(str(r["doc_id"]) for r in got) == sorted([str(r["doc_id"]) for r in ids if comp[r["doc_id"]][1] == r["doc_id"]] + ["None" for r in rows if r["doc_id"] is None])
        elif name == "mix":
            assert sorted(map(str, got)) == sorted(map(str, rows))
            order = [r.doc_id for r in mixing.mix_sources(docs).orderBy("position").collect()]
            out.write.mode("overwrite").parquet(f"{mixing.written.__globals__['shared_dir'](spark)}/mixed")
            back = spark.read.parquet(f"{mixing.written.__globals__['shared_dir'](spark)}/mixed")
            files = sorted(back.inputFiles())
            assert [r.doc_id for f in files for r in spark.read.parquet(f).collect()] == order
        else:
            with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
                e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.Ranks(f.read()).ids, special_tokens={})
            want = sorted(str((r["doc_id"], hashlib.sha256(np.array(e.encode_ordinary(r["text"]), "<u4").tobytes()).hexdigest())) for r in rows)
            assert sorted(str((r["doc_id"], r["ids_sha256"])) for r in got) == want
        if name != "encode":
            assert all(r["n_lines"] == "x" and r["position"] == "x" for r in got if "position" in r)
        docs = spark.createDataFrame(got, out.schema) if got else out.limit(0)
        rows = got
    return rows


def test_stages_on_a_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = check(spark, docs, SF)
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in got) == sorted((r["doc_id"], r["ids_sha256"]) for r in rows)


def test_stages_on_odd_and_empty_tables(spark):
    docs = odd_docs(spark)
    assert len(check(spark, docs, SF)) >= 4
    assert check(spark, docs.limit(0), SF) == []


def test_an_unlabelled_corpus_goes_through(spark):
    docs = odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "2", "5", "6", "6", "None", "9", "10", "11"]) and {r.lang for r in kept} == {None}


def test_documents_of_nothing_but_repeats_go(spark):
    line = ["a line of text that is repeated in documents", "another one that they all hold as well"]
    rows = [(i, "\n".join(line) + ("\n--" if i == 2 else ""), "en", "a", 80) for i in range(5)] + [(9, None, "en", "a", 0), (10, "", "en", "a", 0), (11, line[0] + "\nown words", "en", "a", 60)]
    got = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()
    assert {r.doc_id: r.text for r in got} == {4: line[1], 9: "", 10: "", 11: line[0] + "\nown words"}


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_dups", "mix", "encode"]
