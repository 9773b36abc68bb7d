"""Queries of exports, typed values, agreement and jobs over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import agreement, evaluation, export, gating, ingest, jobs, labeling, metadata, sampling
from . import views
from .catalogue import _CAT, _PRE, _cat, _pairs, _PAIR, query, r6
from .views import ANN, GOLD, NOTES, PRED, table, with_


@query(with_(NOTES) + """SELECT doc_id, CASE WHEN n % 8 IN (5, 7) THEN r ELSE strftime(date_note, '%Y-%m-%d') END AS day FROM (SELECT *, CASE WHEN n % 8 = 5 THEN strftime(date_note, '%b %-d %Y') ELSE strftime(date_note, '%m/%d/%Y') || ' 99:30' END AS r FROM v_notes)""")
def date_normalize_times(spark, d):
    """Days with times of day in each format; month names and impossible times stay text."""
    v = views.notes(spark, d)
    n = F.col("n") % 8
    forms = ["MM/dd/yyyy' 10:30'", "yyyy/MM/dd' 10:30:00'", "MM-dd-yyyy' 1:05'", "yyyy-MM-dd'T10:30:00.250Z'", "yyyyMMdd", "MMM d yyyy", "yyyy-MM-dd' 23:59'", "MM/dd/yyyy' 99:30'"]
    raw = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        raw = F.when(n == i, F.date_format("date_note", f)).otherwise(raw)
    return v.select("doc_id", dates.normal_date(raw).alias("day"))


@query(with_(NOTES) + "SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN n % 3 = 0 THEN '' ELSE strftime(date_note, '%Y-%m-%d') END, CASE WHEN n % 3 = 0 THEN '' ELSE strftime(date_note, '%m/%d/%Y') END, doc_id) AS place FROM v_notes WHERE patient_icn = 'src1'")
def date_sort_keys(spark, d):
    """The notes of a patient in the order of dates that are written month first, missing ones first."""
    v = views.notes(spark, d).where("patient_icn = 'src1'")
    raw = F.when(F.col("n") % 3 != 0, F.date_format("date_note", "MM/dd/yyyy"))
    return v.select("doc_id", F.row_number().over(Window.partitionBy("patient_icn").orderBy(dates.date_sort_key(raw), "doc_id")).cast("long").alias("place"))


@query("SELECT event_id, CASE WHEN extract('isodow' FROM l) IN (6, 7) OR hour(l) >= 22 OR hour(l) < 6 THEN 0 ELSE 22 * 3600 - (hour(l) * 3600 + minute(l) * 60 + CAST(floor(second(l)) AS BIGINT)) END AS wait_s FROM (SELECT event_id, ts::TIMESTAMP - INTERVAL 5 HOUR AS l FROM events)")
def off_hours_waits(spark, d):
    """In January New York is five hours behind UTC."""
    return table(spark, d, "events").select("event_id", dates.off_hours_wait(F.col("ts")).cast("long").alias("wait_s"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'mri,finding,1' WHEN 1 THEN 'café' WHEN 2 THEN 'x2,h2o' ELSE 'plain,text' END AS tokens FROM nation""".replace("'café'", "'caf'"))
def nfkc_tokens(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("ＭＲＩ the ﬁnding ①", "café", "x² and H₂O", "Plain TEXT")]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(text.search_tokens(raw), ",").alias("tokens"))


_KINDS = ["integer", "date", "categorical_multi", "categorical", "text"]
_RAWS = [" 12 ", "2024-01-02", " a, ,b ", "yes ", "  "]


@query("""WITH x AS (SELECT event_id, event_id % 5 AS k, (event_id // 5) % 6 AS r, event_id % 2 = 0 AS ok FROM events),
v AS (SELECT event_id, ok, ['integer', 'date', 'categorical_multi', 'categorical', 'text'][k + 1] AS kind, CASE WHEN r < 5 THEN [' 12 ', '2024-01-02', ' a, ,b ', 'yes ', '  '][r + 1] END AS raw FROM x),
b AS (SELECT *, coalesce(CASE WHEN kind = 'categorical_multi' THEN array_to_string(list_filter(list_transform(string_split(raw, ','), lambda y: trim(y)), lambda y: y <> ''), ',') ELSE trim(raw) END, '') AS t FROM v)
SELECT event_id, CASE WHEN t <> '' AND kind <> 'date' THEN t WHEN t = '' AND raw IS NOT NULL AND NOT ok AND kind IN ('categorical', 'text') THEN '' END AS value,
  CASE WHEN t <> '' AND kind = 'integer' THEN TRY_CAST(t AS DOUBLE) END AS value_num, CASE WHEN t <> '' AND kind = 'date' THEN t END AS value_date, CAST(t = '' AND ok AS INTEGER) AS na FROM b""")
def typed_label_values(spark, d):
    e = table(spark, d, "events")
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i + 1).cast("int"))
    r = F.floor(F.col("event_id") / 5) % 6
    raw = F.when(r < 5, pick([*_RAWS, "never"], r))
    return e.select("event_id", export.typed_value(raw, pick(_KINDS, F.col("event_id") % 5), F.col("event_id") % 2 == 0).alias("v")).select("event_id", "v.*")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || ',' || source WHEN 1 THEN lang ELSE CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END END AS items FROM documents""")
def multi_select_of_maps_and_lists(spark, d):
    t = table(spark, d, "documents")
    flags = F.create_map("source", F.col("doc_id") % 2 == 0, F.lit("other"), F.lit(False))
    of = F.when(F.col("doc_id") % 3 == 0, text.chosen(F.array("lang", F.lit(" "), "source", "lang"), "array")).when(F.col("doc_id") % 3 == 1, text.chosen(F.concat(F.lit(" "), "lang", F.lit("; "), "lang"), "string")).otherwise(text.chosen(flags, "map"))
    return t.select("doc_id", of.alias("items"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value, strftime(ts::TIMESTAMP, '%Y-%m-%dT%H:%M:%S') AS ts, '[\"' || event_type || '\",null]' AS parts FROM events")
def json_safe_values(spark, d):
    e = table(spark, d, "events")
    odd = F.when(F.col("event_id") % 8 == 0, F.lit(float("nan"))).when(F.col("event_id") % 8 == 4, F.lit(float("inf"))).otherwise(F.col("value"))
    return text.json_safe(e.select("event_id", odd.alias("value"), "ts", F.array("event_type", F.lit(None).cast("string")).alias("parts")))


@query("SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN event_type END AS kind, CASE WHEN event_id % 4 < 2 THEN user_id END AS who FROM events")
def json_like_columns(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.concat(F.lit('{"kind": "'), "event_type", F.lit('", "who": '), "user_id", F.lit("}"))).when(k == 1, F.concat(F.lit("{'kind': '"), "event_type", F.lit("', 'who': "), "user_id", F.lit("}"))).when(k == 2, F.concat(F.lit(" {'kind': '"), "event_type", F.lit("', 'who': None}"))).otherwise(F.lit("not json"))
    return e.select("event_id", text.json_like(raw, "kind string, who long").alias("j")).select("event_id", "j.kind", "j.who")


@query(with_(ANN, NOTES) + "SELECT a.unit_id, reviewer_id, label_id, CAST(length(text) AS INTEGER) AS n, sha256(text) AS hash FROM v_ann a LEFT JOIN v_notes n ON a.unit_id = n.doc_id AND n.n % 5 <> 0")
def annotations_with_text(spark, d):
    a = views.annotations(spark, d).select(F.col("unit_id").alias("doc_id"), "reviewer_id", "label_id")
    notes = views.notes(spark, d).where("n % 5 <> 0").select("doc_id", "text")
    got = export.with_text(a, notes.union(notes))
    return got.select(F.col("doc_id").alias("unit_id"), "reviewer_id", "label_id", F.char_length("document_text").alias("n"), F.sha2("document_text", 256).alias("hash"))


_RULES = "rule AS (SELECT n_nationkey AS position, 'l' || n_regionkey AS label_id, CASE WHEN n_nationkey % 3 = 0 THEN ' ' ELSE 'rule ' || n_name END AS rules FROM nation)"


def _rules(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("position"), F.concat(F.lit("l"), "n_regionkey").alias("label_id"), F.when(F.col("n_nationkey") % 3 == 0, " ").otherwise(F.concat(F.lit("rule "), "n_name")).alias("rules"))


@query(with_(_RULES) + "SELECT label_id, max_by(rules, position) AS rules FROM rule WHERE trim(rules) <> '' GROUP BY label_id")
def label_rules_last(spark, d):
    return export.label_rules(_rules(spark, d), "position")


@query("SELECT c_mktsegment AS round_id, max_by(CAST(c_nationkey AS VARCHAR), c_custkey) AS labelset_id FROM customer WHERE c_custkey % 7 <> 0 GROUP BY c_mktsegment")
def round_labelset_map(spark, d):
    c = table(spark, d, "customer")
    return export.round_labelsets(c.select(F.col("c_mktsegment").alias("round_id"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_nationkey").cast("string")).alias("labelset_id"), "c_custkey"), "c_custkey")


_HIST = """h AS (SELECT user_id, event_type, event_id, CAST(event_id % 3 AS VARCHAR) AS v FROM events),
s AS (SELECT *, lag(v) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS p FROM h),
hist AS (SELECT user_id, event_type, count(*) - 1 AS n_changes, string_agg(v, ' -> ' ORDER BY event_id) AS changes FROM s WHERE p IS NULL OR p <> v GROUP BY ALL)"""


def _history(spark, d):
    e = table(spark, d, "events").withColumn("v", (F.col("event_id") % 3).cast("string"))
    return export.change_history(e, ["user_id", "event_type"], "event_id", "v")


@query(with_(_HIST) + "SELECT * FROM hist")
def change_history(spark, d):
    return _history(spark, d)


@query(with_(ANN, _HIST, "rats AS (SELECT * FROM v_ann WHERE label_id IN ('quality', 'toxic') AND label_value = 'yes')") + """SELECT a.unit_id, a.label_id, a.reviewer_id, u.note_count, CASE WHEN r.unit_id IS NOT NULL THEN '[{"doc_id":"' || a.unit_id || '","start":0,"end":4,"snippet":"' || a.patient_icn || '"},{"doc_id":"' || a.unit_id || '","start":5,"end":9}]' END AS rationales_json,
  CASE a.label_id WHEN 'quality' THEN 'good' WHEN 'toxic' THEN 'bad' END AS rules, h.changes
FROM v_ann a LEFT JOIN (SELECT CAST(doc_id AS VARCHAR) AS unit_id, n_chars AS note_count FROM documents WHERE doc_id % 2 = 0) u ON a.unit_id = u.unit_id
LEFT JOIN rats r ON a.unit_id = r.unit_id AND a.label_id = r.label_id AND a.reviewer_id = r.reviewer_id
LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS unit_id, changes FROM hist WHERE event_type = 'click') h ON h.unit_id = a.unit_id AND a.label_id = 'quality' AND a.reviewer_id = 'r1'""")
def annotation_export(spark, d):
    """Annotations with units, rationales (two spans for each yes, told in reverse), rules and changes."""
    a = views.annotations(spark, d)
    units = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("unit_id"), F.col("n_chars").alias("note_count"))
    yes = a.where(F.col("label_id").isin("quality", "toxic") & (F.col("label_value") == "yes"))
    spans = F.array(F.struct(F.lit(5).alias("start"), F.lit(9).alias("end"), F.lit(None).cast("string").alias("snippet")), F.struct(F.lit(0).alias("start"), F.lit(4).alias("end"), F.col("patient_icn").alias("snippet")))
    rats = yes.select("unit_id", "label_id", "reviewer_id", F.col("unit_id").alias("doc_id"), F.explode(spans).alias("s")).select("unit_id", "label_id", "reviewer_id", "doc_id", "s.*")
    rules = spark.createDataFrame([("quality", "good"), ("toxic", "bad")], "label_id string, rules string")
    hist = _history(spark, d).where("event_type = 'click'").select(F.col("user_id").cast("string").alias("unit_id"), F.lit("quality").alias("label_id"), F.lit("r1").alias("reviewer_id"), "changes")
    return export.enriched(a.select("unit_id", "label_id", "reviewer_id"), units.union(units), rats, rules, hist)


@query("SELECT o_orderkey AS unit_id, o_orderstatus AS status, min(l_shipmode) AS mode FROM orders LEFT JOIN (SELECT l_orderkey, l_returnflag AS l_shipmode FROM lineitem) ON l_orderkey = o_orderkey WHERE o_orderkey % 10 = 0 GROUP BY ALL")
def selection_unit_metadata(spark, d):
    sel = table(spark, d, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("unit_id"), F.col("o_orderstatus").alias("status"))
    meta = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_returnflag").alias("mode"), F.lit("other").alias("status"))
    return export.with_unit_metadata(sel, meta)


@query(with_(ANN, PRED) + "SELECT unit_id, min(prediction_value) FILTER (label_id = 'quality') AS quality_llm, min(prediction_value) FILTER (label_id = 'toxic') AS toxic_llm, min('since ' || prediction_value) FILTER (label_id = 'quality') AS quality_reasoning, min('since ' || prediction_value) FILTER (label_id = 'toxic') AS toxic_reasoning FROM v_pred GROUP BY unit_id")
def wide_predictions_reasoning(spark, d):
    p = views.predictions(spark, d).withColumn("reasoning", F.concat(F.lit("since "), "prediction_value"))
    return export.wide(p, ["quality", "toxic"])


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def documents_by_id(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return export.documents_by_id(docs, table(spark, d, "labels").where("toxic = 1"))


@query(with_(NOTES) + ", n AS (SELECT *, row_number() OVER (PARTITION BY patient_icn ORDER BY date_note, doc_id) AS place FROM v_notes) SELECT patient_icn, doc_id, place FROM n")
def patient_documents_by_date(spark, d):
    v = views.notes(spark, d)
    return v.select("patient_icn", "doc_id", F.row_number().over(Window.partitionBy("patient_icn").orderBy("date_note", "doc_id")).cast("long").alias("place"))


@query("SELECT user_id, CASE WHEN user_id % 3 = 0 THEN true ELSE false END AS is_model FROM (SELECT DISTINCT user_id FROM events)")
def model_reviewers(spark, d):
    u = table(spark, d, "events").select("user_id").distinct()
    name = F.when(F.col("user_id") % 6 == 0, F.concat(F.lit("LLM_"), "user_id")).when(F.col("user_id") % 6 == 3, F.lit("gpt-llm")).otherwise(F.concat(F.lit("willmann"), "user_id"))
    return u.select("user_id", export.is_model(name).alias("is_model"))


@query(with_(ANN, PRED) + "SELECT unit_id, label_id, prediction_value AS llm_prediction, round(consistency, 6) AS llm_consistency, CASE WHEN CAST(unit_id AS BIGINT) % 3 = 0 THEN 'r' || unit_id WHEN CAST(unit_id AS BIGINT) % 3 = 1 THEN 'w' || unit_id END AS reasoning, strftime(DATE '2024-01-01' + CAST(CAST(unit_id AS BIGINT) % 9 AS INTEGER), '%Y-%m-%d') AS day FROM v_pred")
def prediction_frames(spark, d):
    """Predictions under their output names, dates as text, with the reasoning of the first run or of its raw answer."""
    n = F.col("unit_id").cast("long")
    runs = F.when(n % 3 == 0, F.concat(F.lit('[{"reasoning": "r'), "unit_id", F.lit('"}, {"reasoning": "second"}]'))).when(n % 3 == 1, F.concat(F.lit('[{"raw": {"reasoning": "w'), "unit_id", F.lit('"}}]'))).otherwise(F.lit("[]"))
    p = views.predictions(spark, d).select("unit_id", "label_id", "prediction_value", r6("consistency").alias("consistency"), runs.alias("runs"), F.date_add(F.lit("2024-01-01").cast("date"), (n % 9).cast("int")).alias("day"))
    out = export.normal_predictions(p)
    return out.withColumn("reasoning", export.reasoning(F.col("llm_runs"))).drop("llm_runs")


@query(with_(ANN) + _CAT + """, u AS (SELECT label_id, unit_id, count(*) AS n, count(*) FILTER (label_value = 'yes') AS y FROM c GROUP BY ALL), e AS (SELECT label_id, count(DISTINCT unit_id) AS n_units FROM v_ann WHERE label_id IN ('quality', 'toxic') GROUP BY label_id),
s AS (SELECT label_id, sum(CASE WHEN n >= 2 THEN (y * (y - 1) + (n - y) * (n - y - 1)) / (n * (n - 1.0::DOUBLE)) ELSE 0 END) AS p, sum(y) / sum(n)::DOUBLE AS q FROM u GROUP BY label_id)
SELECT s.label_id, n_units, round((p / n_units - q * q - (1 - q) * (1 - q)) / (1 - q * q - (1 - q) * (1 - q)), 6) AS kappa FROM s JOIN e ON s.label_id = e.label_id""")
def fleiss_kappa_of_all_units(spark, d):
    a = views.annotations(spark, d).where(F.col("label_id").isin("quality", "toxic"))
    return agreement.fleiss_kappa_of_all(a.withColumn("label_value", F.when(~F.col("na"), F.col("label_value")))).withColumn("kappa", r6("kappa"))


@query(with_(ANN) + _CAT + """, x AS (SELECT * FROM c WHERE label_id = 'toxic' OR reviewer_id <> 'r3'),
w AS (SELECT label_id, count(DISTINCT reviewer_id) AS n_reviewers FROM x GROUP BY label_id),
u AS (SELECT label_id, unit_id, count(*) AS n, count(*) FILTER (label_value = 'yes') AS y, count(*) FILTER (label_value = 'yes' AND reviewer_id = 'r1') AS a, count(*) FILTER (label_value = 'yes' AND reviewer_id = 'r2') AS b FROM x GROUP BY ALL),
g AS (SELECT label_id, avg(CASE WHEN y IN (0, n) THEN 1.0 ELSE 0.0 END) AS agreement, avg((y * (y - 1) + (n - y) * (n - y - 1)) / (n * (n - 1.0::DOUBLE))) AS p, sum(y) / sum(n)::DOUBLE AS q, avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0.0 END) AS po, avg(a::DOUBLE) AS pa, avg(b::DOUBLE) AS pb FROM u GROUP BY label_id)
SELECT g.label_id, n_reviewers, CASE WHEN n_reviewers = 2 THEN 'cohen' ELSE 'fleiss' END AS statistic, round(agreement, 6) AS agreement,
  round(CASE WHEN n_reviewers = 2 THEN (po - pa * pb - (1 - pa) * (1 - pb)) / (1 - pa * pb - (1 - pa) * (1 - pb)) ELSE (p - q * q - (1 - q) * (1 - q)) / (1 - q * q - (1 - q) * (1 - q)) END, 6) AS kappa FROM g JOIN w ON g.label_id = w.label_id""")
def iaa_by_label(spark, d):
    """Two reviewers rate quality, three toxic."""
    a = _cat(spark, d).where("label_id = 'toxic' or reviewer_id <> 'r3'")
    return agreement.iaa(a).withColumns({"kappa": r6("kappa"), "agreement": r6("agreement")})


@query("SELECT * FROM (VALUES ('kinds', 'categorical'), ('many', 'categorical_multi'), ('size', 'numeric'), ('when', 'date')) t(label_id, label_type)")
def value_type_inference(spark, d):
    o = table(spark, d, "orders")
    day, price = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_totalprice").cast("string")
    one = lambda name, g, p: o.select(F.lit(name).alias("label_id"), g.alias("gold_value"), p.alias("prediction_value"))
    some = F.col("o_orderkey") % 100 == 1
    rows = one("kinds", F.col("o_orderstatus"), F.col("o_orderpriority")).union(one("many", F.col("o_orderstatus"), F.when(some, "a;b").otherwise("a"))).union(one("size", price, F.when(some, "x").otherwise(price))).union(one("when", day, F.when(some, "12").otherwise(day)))
    return evaluation.value_types(rows)


@query(with_(ANN, GOLD, PRED) + _PAIR + "SELECT label_id, count(*) AS n FROM p WHERE unit_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1) GROUP BY label_id")
def experiment_scope(spark, d):
    units = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("unit_id"))
    return evaluation.scoped(_pairs(spark, d), units.union(units)).groupBy("label_id").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT DISTINCT conv_id, length(text)::DOUBLE AS x, count(*) OVER (PARTITION BY conv_id, length(text)) AS c FROM conversations),
m AS (SELECT conv_id, median(length(text)::DOUBLE) AS median, count(*) AS n_votes FROM conversations GROUP BY conv_id),
p AS (SELECT a.conv_id, sum(exp(-abs(length(a.text) - length(b.text)) / greatest(1.0, 0.05 * abs(median)))) - any_value(n_votes) AS s FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id JOIN m ON m.conv_id = a.conv_id GROUP BY a.conv_id)
SELECT m.conv_id, median, n_votes, round(CASE WHEN n_votes > 1 THEN s / (n_votes * (n_votes - 1)) ELSE 1.0 END, 6) AS consistency FROM m JOIN p ON m.conv_id = p.conv_id""")
def vote_numeric_pairs(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.char_length("text").cast("double").alias("vote"))
    return labeling.numeric_consistency(c, ["conv_id"]).withColumn("consistency", r6("consistency"))


@query(with_(ANN) + """, v AS (SELECT unit_id, CAST(label_value_date - DATE '1970-01-01' AS DOUBLE) AS x FROM v_ann WHERE label_id = 'seen'), m AS (SELECT unit_id, median(x) AS m, count(*) AS n_votes FROM v GROUP BY unit_id),
p AS (SELECT a.unit_id, sum(exp(-abs(a.x - b.x) / 14)) AS s FROM v a JOIN v b ON a.unit_id = b.unit_id GROUP BY a.unit_id)
SELECT m.unit_id, strftime(DATE '1970-01-01' + CAST(floor(m) AS INTEGER), '%Y-%m-%d') AS median, n_votes, round((s - n_votes) / (n_votes * (n_votes - 1)), 6) AS consistency FROM m JOIN p ON m.unit_id = p.unit_id""")
def vote_date_consistency(spark, d):
    v = views.annotations(spark, d).where("label_id = 'seen'").select("unit_id", F.col("label_value_date").alias("vote"))
    return labeling.date_consistency(v, ["unit_id"]).withColumns({"consistency": r6("consistency"), "median": F.date_format("median", "yyyy-MM-dd")})


_WORDS = "w AS (SELECT unit_id, label_id, reviewer_id, CASE WHEN CAST(unit_id AS BIGINT) % 5 = 0 AND reviewer_id <> 'r1' THEN 'Unknown' ELSE label_value END AS v FROM v_ann WHERE label_id IN ('quality', 'toxic'))"


@query(with_(ANN, _WORDS) + ", p AS (SELECT a.unit_id, a.label_id, avg(CASE WHEN lower(a.v) = 'unknown' AND lower(b.v) = 'unknown' THEN 0.5 WHEN lower(a.v) = 'unknown' OR lower(b.v) = 'unknown' THEN 0.1 WHEN a.v = b.v THEN 1.0 ELSE 0.0 END) AS c FROM w a JOIN w b ON a.unit_id = b.unit_id AND a.label_id = b.label_id AND a.reviewer_id < b.reviewer_id GROUP BY ALL) SELECT unit_id, label_id, CAST(3 AS BIGINT) AS n_votes, round(c, 6) AS consistency FROM p")
def vote_word_consistency(spark, d):
    v = views.annotations(spark, d).where(F.col("label_id").isin("quality", "toxic"))
    v = v.withColumn("vote", F.when((F.col("unit_id").cast("long") % 5 == 0) & (F.col("reviewer_id") != "r1"), "Unknown").otherwise(F.col("label_value")))
    return labeling.word_consistency(v, ["unit_id", "label_id"]).withColumn("consistency", r6("consistency"))


@query(with_(ANN) + _CAT + "SELECT label_id, label_value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label_id), 6) AS prevalence FROM c GROUP BY label_id, label_value")
def random_prevalence(spark, d):
    """Shares of each value among what has been labelled so far."""
    n = _cat(spark, d).groupBy("label_id", "label_value").agg(F.count("*").alias("n"))
    return n.withColumn("prevalence", r6(F.col("n") / F.sum("n").over(Window.partitionBy("label_id"))))


@query("SELECT conv_id, count(*) AS n_total, count(*) FILTER (role = 'assistant') AS n_completed FROM conversations GROUP BY conv_id")
def prompt_counts(spark, d):
    return jobs.prompt_counts(table(spark, d, "conversations"), "conv_id", F.col("role") == "assistant")


@query("SELECT doc_id // 128 AS batch_id, count(*) AS n_units, count(*) FILTER (doc_id % 640 < 192) AS n_done, CASE WHEN count(*) FILTER (doc_id % 640 < 192) = count(*) THEN 'completed' WHEN count(*) FILTER (doc_id % 640 < 192) > 0 THEN 'partial' ELSE 'pending' END AS status FROM documents GROUP BY 1")
def batch_manifest(spark, d):
    """Batches of 128 units, of which every fifth is done and the next one half done; outputs come twice."""
    u = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 128).cast("long").alias("batch_id"), F.col("doc_id").alias("unit_id"))
    done = u.where("unit_id % 640 < 192")
    return jobs.batch_manifest(u, done.union(done))


@query("WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, o_clerk FROM (SELECT *, 'rev' || CAST(o_orderkey % 3 AS VARCHAR) AS o_clerk FROM orders)) SELECT CAST(o_custkey AS VARCHAR) AS unit_id, min('p' || CAST(o_custkey AS VARCHAR)) AS patient_icn, min(CAST(o_orderkey AS VARCHAR)) AS doc_id, min(o_orderpriority) AS strata, string_agg(DISTINCT o_clerk, ';' ORDER BY o_clerk) AS assigned_to, max(o_orderkey % 2 = 0) AS is_overlap FROM o GROUP BY o_custkey")
def round_manifest(spark, d):
    o = table(spark, d, "orders")
    u = F.col("o_custkey").cast("string")
    return export.manifest(o.select(u.alias("unit_id"), F.concat(F.lit("p"), u).alias("patient_icn"), F.col("o_orderkey").cast("string").alias("doc_id"), F.col("o_orderpriority").alias("strata"), F.concat(F.lit("rev"), (F.col("o_orderkey") % 3).cast("string")).alias("reviewer_id"), (F.col("o_orderkey") % 2 == 0).alias("is_overlap")))


@query(with_(NOTES) + "SELECT doc_id FROM v_notes WHERE notetype = 'es' OR (date_note >= DATE '2022-01-01' AND date_note <= DATE '2022-12-31')")
def filter_config_logic(spark, d):
    v = views.notes(spark, d)
    config = {"logic": "OR", "conditions": [{"field": "notetype", "values": ["es"]}, {"field": "date_note", "type": "date", "min_value": "01/01/2022", "max": "2022-12-31"}]}
    found, any_ = metadata.conditions_of(config, v.columns)
    again = [metadata.Condition.of(c.to_dict()) for c in found]
    return metadata.metadata_filter(v, again, match_any=any_).select("doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'u' || CAST(doc_id AS VARCHAR) WHEN doc_id % 2 = 0 THEN source ELSE CAST(doc_id AS VARCHAR) END AS unit_id FROM documents")
def unit_id_inference(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.col("source").alias("patient_icn"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("u"), "doc_id")).when(F.col("doc_id") % 3 == 1, " ").alias("unit_id"))
    even = F.col("doc_id") % 2 == 0
    return t.select("doc_id", F.when(even, export.unit_id_of("multi_doc")).otherwise(export.unit_id_of("single_doc")).alias("unit_id"))


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE conv_id * 10 + turn % 4 END AS completed_at FROM conversations")
def completion_times(spark, d):
    """A unit that is completed takes the new time; one that is opened again keeps its old one."""
    c = table(spark, d, "conversations").select("conv_id", "turn")
    old = c.select("conv_id", "turn", F.when(F.col("turn") % 4 == 2, F.col("conv_id") * 10 + 2).alias("completed_at"))
    new = c.where("turn % 4 <> 3").select("conv_id", "turn", F.col("turn") % 4 != 2, (F.col("conv_id") * 10 + F.col("turn") % 4 + F.when(F.col("turn") % 4 == 2, 5).otherwise(0)).alias("at")).toDF("conv_id", "turn", "complete", "at")
    return ingest.completion_times(old, new, ["conv_id", "turn"])
