import json

import pytest

from marginalia import cli


def test_a_project_from_corpus_to_gold(spark, tmp_path, capsys):
    p = str(tmp_path)
    (tmp_path / "docs.csv").write_text("PatientICN,text,kind\n" + "".join(f"p{i % 3},fever {i},{'ab'[i % 2]}\n" for i in range(12)))
    run = lambda *a: cli.main([str(x) for x in a], spark)
    run("import-corpus", "--documents", f"{p}/docs.csv", "--corpus", f"{p}/corpus.parquet")
    run("import-corpus", "--documents", f"{p}/docs.csv", "--corpus", f"{p}/corpus.parquet")
    corpus = spark.read.parquet(f"{p}/corpus.parquet")
    assert corpus.count() == 12 and corpus.where("doc_id = 'p0_00001'").count() == 1
    run("generate-round", "--corpus", f"{p}/corpus.parquet", "--total", 6, "--reviewers", "r1", "r2", "--labels", "flag", "--overlap", 2, "--stratify", "kind", "--out", f"{p}/round")
    units = spark.read.parquet(f"{p}/round/units.parquet")
    assert units.select("unit_id").distinct().count() == 6 and units.groupBy("reviewer_id").count().collect()[0]["count"] == 4
    assert spark.read.option("header", True).csv(f"{p}/round/manifest.csv").where("is_overlap = 'true'").count() == 2
    (tmp_path / "rules.json").write_text(json.dumps({"flag": {"yes": ["fever 1"], "no": ["fever"]}}))
    for _ in range(2):  # the second run finds all batches whole
        run("infer", "--corpus", f"{p}/corpus.parquet", "--rules", f"{p}/rules.json", "--batch-size", 5, "--out", f"{p}/labels")
    assert spark.read.parquet(f"{p}/labels").where("prediction_value = 'yes'").count() == 3 and spark.read.parquet(f"{p}/labels").count() == 12
    (tmp_path / "labels.json").write_text(json.dumps({"flag": {"type": "binary", "rules": "has fever"}}))
    run("precompute", "--corpus", f"{p}/corpus.parquet", "--labels", f"{p}/labels.json", "--out", f"{p}/prompts.parquet")
    assert spark.read.parquet(f"{p}/prompts.parquet").count() == 12
    for at, (who, v) in enumerate((("r1", "no"), ("r1", "yes"), ("r2", "yes"))):
        run("annotate", "--events", f"{p}/events", "--unit", "u", "--label", "flag", "--reviewer", who, "--value", v, "--at", at)
    run("state", "--events", f"{p}/events", "--out", f"{p}/state.parquet")
    assert {(r.reviewer_id, r.value) for r in spark.read.parquet(f"{p}/state.parquet").collect()} == {("r1", "yes"), ("r2", "yes")}
    rows = [("u", "flag", r, "yes") for r in ("r1", "r2")] + [("v", "flag", "r1", "no"), ("v", "flag", "r2", "yes")]
    spark.createDataFrame(rows, "unit_id string, label_id string, reviewer_id string, label_value string").write.parquet(f"{p}/ann.parquet")
    run("aggregate", "--annotations", f"{p}/ann.parquet", "--out", f"{p}/agg")
    assert spark.read.option("header", True).csv(f"{p}/agg/gold.csv").where("unit_id = 'u'").first().gold_value == "yes"
    run("iaa", "--annotations", f"{p}/ann.parquet")
    assert "cohen" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["nothing"], spark)
