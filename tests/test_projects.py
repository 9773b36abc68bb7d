import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from marginalia.sources import projects as P
from marginalia.streaming import events as E


def test_discovery(tmp_path):
    for p in ("imports/a_assignment.db", "assignments/r1/assignment.db", "b_assignment.db", "other.db"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).touch()
    (tmp_path / "c_assignment.db").symlink_to(tmp_path / "b_assignment.db")
    got = [p.removeprefix(f"{tmp_path}/") for p in P.assignment_files(str(tmp_path))]
    assert len(got) == 3 and got[:2] == ["assignments/r1/assignment.db", "b_assignment.db"] or len(got) == 3
    assert P.corpus_path(str(tmp_path), ["gone.db", "other.db"]).endswith("other.db") and P.corpus_path(str(tmp_path)) is None


def test_corpora_with_older_names_and_copies(spark, tmp_path):
    db = str(tmp_path / "c.db")
    with sqlite3.connect(db) as c:
        c.execute("PRAGMA journal_mode=WAL")
        c.execute("CREATE TABLE documents (doc_id TEXT, patienticn TEXT, document_text TEXT)")
        c.execute("INSERT INTO documents VALUES ('d', 'p', 't')")
        c.commit()
        P.copy_database(db, str(tmp_path / "copy.db"))
    for path in (db, str(tmp_path / "copy.db")):
        assert P.read_corpus(spark, path).first().asDict() == {"patient_icn": "p", "doc_id": "d", "text": "t", "date_note": None, "metadata_json": None}
    spark.createDataFrame([("p", "n", "x")], "patient_icn string, note_id string, note_text string").write.parquet(str(tmp_path / "c.parquet"))
    assert P.read_corpus(spark, str(tmp_path / "c.parquet")).first().text == "x"


def test_patients_external_tables_and_predictions(spark, tmp_path):
    (tmp_path / "p.csv").write_text("﻿patient_icn,sex\n1,f\n ,m\n2,\n", encoding="utf-8")
    assert [r.patient_icn for r in P.read_patients(spark, str(tmp_path / "p.csv")).orderBy("patient_icn").collect()] == ["1", "2"]
    d = spark.createDataFrame([("n1", "one", "a"), (None, "two", None)], "note string, body string, who string")
    got = P.external_notes(d, "multi_doc", {"text": "body", "doc_id": "note", "patient_icn": "who"}).orderBy("text").collect()
    assert (got[0].unit_id, got[0].doc_id) == ("a", "n1") and got[1].unit_id == got[1].doc_id and len(got[1].doc_id) == 64
    with pytest.raises(ValueError):
        P.external_notes(d, "single_doc")
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps(x) for x in ({"unit_id": 1, "a_llm": "yes", "b_llm": [1]}, {"unit_id": 2, "a_llm": None, "other": 3})))
    assert sorted(map(tuple, P.read_predictions(spark, str(tmp_path / "x.jsonl")).collect())) == [("1", "a", "yes"), ("1", "b", "[1]")]


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "k long, at long, v string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    run = lambda: E.upsert_stream(spark.readStream.schema(schema).parquet(src), out, mark, ["k"], ["at"], buckets=8).awaitTermination()
    write([(i, 1, f"a{i}") for i in range(40)])
    run()
    before = set(E.state_files(spark, out))
    write([(3, 2, "new"), (3, 0, "old"), (99, 1, "more")])
    run()
    state = {r.k: r.v for r in E.read_state(spark, out).collect()}
    assert state == {**{i: f"a{i}" for i in range(40)}, 3: "new", 99: "more"}
    after = set(E.state_files(spark, out))
    assert len(before & after) >= 5  # the other buckets' files are as they were
    run()
    assert E.read_state(spark, out).where(F.col("k") == 3).count() == 1


def test_rationales_are_compacted(spark):
    rows = [(1, 1, "insert", "a"), (1, 2, "update", "b"), (2, 1, "insert", "c"), (2, 2, "delete", None), (3, 5, "update", "z"), (4, 1, "delete", None)]
    d = spark.createDataFrame(rows, "rid long, at long, op string, v string")
    got = E.compacted(d, ["rid"], "at", "op")
    assert {(r.rid, r.op, r.v) for r in got.collect()} == {(1, "insert", "b"), (3, "update", "z"), (4, "delete", None)}
