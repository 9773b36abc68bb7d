import zlib

from pyspark.sql import functions as F

from marginalia.llm import langid

from .helpers import odd_docs

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_lang_source_and_id_are_no_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()))
    a = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    b = {r.doc_id - 5: r for r in langid.predict(docs.withColumns({"doc_id": F.col("doc_id") + 5, "lang": F.lit("zz"), "source": F.lit("q")}), model).collect()}
    assert all((a[k].lang_pred, a[k].score) == (b[k].lang_pred, b[k].score) for k in a)


def test_odd(spark):
    docs = odd_docs(spark)
    got = langid.language_id(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 12 and all(by[i].lang_pred == "und" and by[i].score == 0 for i in (3, 4, 8)) and by[9].lang_pred in ("en", "de", "fr")
    assert langid.language_id(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    bare = langid.labelled(docs.withColumn("lang", F.lit(None).cast("string")), None)
    assert {r.doc_id: r.lang for r in bare.collect()} == {i: "und" if i in (3, 4, 8) else None for i in by}
    whole = langid.labelled(docs, langid.train(docs))
    assert whole.columns == docs.columns and whole.count() == 12


def test_presence_ignores_repeats():
    import numpy as np

    texts = [b"abcd abcd", b"abcd abcd abcd abcd"]
    off = np.array([0, len(texts[0]), sum(map(len, texts))])
    rows = np.zeros((2, langid.WIDTH), np.uint8)
    langid.presence(off, np.frombuffer(b"".join(texts), np.uint8), rows)
    assert (rows[0] == rows[1]).all() and rows.max() == 1


def test_rare_languages_are_learned(spark):
    rows = [(i, f"the and of {i} with english words", "en") for i in range(3000)] + [(5000 + i, f"кошка и собака {i} гуляют", "ru") for i in range(5)] + [(6000 + i, "123 456", "ru") for i in range(3000)]
    rows += [(10_000 + k, chr(0x4E00 + k) * 12, f"l{k}") for k in range(230)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.train(d)
    assert len(m.langs) == 232
    got = {r.doc_id: r.lang_pred for r in langid.predict(d.where("doc_id >= 5000 and doc_id < 6000 or doc_id = 10100"), m).collect()}
    assert got == {**{5000 + i: "ru" for i in range(5)}, 10_100: "l100"}
