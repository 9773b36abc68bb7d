"""Queries over the driver tables, one or more for each operator, by name, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import agreement, consensus, evaluation, gating, ingest, jobs, labeling, metadata, retrieval, sampling, selection
from ..sources import tables
from ..streaming import events as event_ops
from . import views
from .views import ANN, GOLD, NOTES, PRED, table, with_

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _all() -> None:
    from . import annotation_queries, selection_queries  # noqa: F401  they register themselves


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)


def r6(c):
    return F.round(c, 6)


# --- text, dates, metadata -------------------------------------------------------------------


@query("""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '\r\n?', '\n', 'g'), '[^\\S\\n]+(\\n|$)', '\\1', 'g')) AS hash FROM documents""".replace("\r", "\\r").replace("'\n'", "chr(10)"))
def note_canonical_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query("""SELECT doc_id, CAST(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS INTEGER) AS n FROM documents""")
def ws_collapse_length(spark, d):
    return table(spark, d, "documents").select("doc_id", F.char_length(text.collapsed(F.col("text"))).alias("n"))


@query(with_(NOTES) + "SELECT doc_id, CAST(year(date_note) AS INTEGER) AS note_year FROM v_notes")
def note_year(spark, d):
    return views.notes(spark, d).select("doc_id", text.note_year(F.col("date_note")).alias("note_year"))


@query("""SELECT doc_id AS n, CASE WHEN doc_id % 3 = 0 THEN source || '_' || lpad(CAST(sum(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id) AS VARCHAR), 5, '0') ELSE CAST(doc_id AS VARCHAR) END AS doc_id FROM documents""")
def auto_doc_ids(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("n"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("string")).alias("doc_id"), F.col("source").alias("patient_icn"))
    return ingest.auto_doc_ids(rows, position="n").select("n", "doc_id")


@query("""SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS field FROM events, (SELECT unnest(json_keys(props)) AS k, event_id AS e FROM events) WHERE e = event_id""")
def metadata_json_extract(spark, d):
    m = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", F.explode(m).alias("field", "value"))


_DISCOVER = """SELECT field, CASE WHEN bool_and(TRY_CAST(replace(v, ',', '') AS DOUBLE) IS NOT NULL) THEN 'number' WHEN bool_and(TRY_CAST(v AS DATE) IS NOT NULL) THEN 'date' ELSE 'text' END AS type,
  count(*) AS n_values, count(DISTINCT v) AS n_distinct FROM m WHERE v IS NOT NULL AND trim(v) <> '' GROUP BY field"""


@query("WITH m AS (SELECT 'status' AS field, o_orderstatus AS v FROM orders UNION ALL SELECT 'price', CAST(o_totalprice AS VARCHAR) FROM orders UNION ALL SELECT 'day', strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT 'priority', o_orderpriority FROM orders) " + _DISCOVER)
def metadata_discovery_types(spark, d):
    o = table(spark, d, "orders")
    m = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("price"), F.col("o_totalprice").cast("string"), F.lit("day"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("priority"), F.col("o_orderpriority"), F.lit("blank"), F.lit(" "))
    return metadata.discover(o.select(m.alias("meta")), "meta")


@query(with_(NOTES) + """, w AS (SELECT patient_icn, count(DISTINCT notetype) <= 1 AND count(notetype) IN (0, count(*)) AS a, count(DISTINCT patient_icn) <= 1 AS b FROM v_notes GROUP BY patient_icn)
SELECT 'notetype' AS field, bool_and(a) AS constant FROM w UNION ALL SELECT 'source', bool_and(b) FROM w""")
def constant_per_patient(spark, d):
    return metadata.constant_within(views.notes(spark, d).withColumn("source", F.col("patient_icn")), "patient_icn", ["notetype", "source"])


@query(with_(NOTES) + "SELECT doc_id FROM v_notes WHERE notetype IN ('en', 'de') AND n_chars BETWEEN 100 AND 5000")
def filter_and(spark, d):
    return metadata.metadata_filter(views.notes(spark, d), [metadata.Condition("notetype", values=["en", "de"]), metadata.Condition("n_chars", "number", min="100", max="5000")]).select("doc_id")


@query(with_(NOTES) + "SELECT doc_id FROM v_notes WHERE notetype = 'es' OR n_chars >= 5000")
def filter_any(spark, d):
    return metadata.metadata_filter(views.notes(spark, d), [metadata.Condition("notetype", values=["es"]), metadata.Condition.of({"field": "n_chars", "type": "number", "min_value": 5000})], match_any=True).select("doc_id")


@query(with_(NOTES) + "SELECT doc_id, strftime(date_note, '%Y-%m-%d') AS day FROM v_notes WHERE date_note BETWEEN DATE '2020-03-01' AND DATE '2021-06-30'")
def filter_date_range(spark, d):
    return metadata.metadata_filter(views.notes(spark, d), [metadata.Condition("date_note", "date", min="03/01/2020", max="2021-06-30")]).select("doc_id", F.date_format("date_note", "yyyy-MM-dd").alias("day"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)[a-z]+[0-9]{2,}')")
def regex_note_filter(spark, d):
    return metadata.regex_filter(table(spark, d, "documents"), "[a-z]+[0-9]{2,}").select("doc_id")


@query(with_(NOTES) + "SELECT doc_id, CASE WHEN n % 5 = 4 THEN 'about ' || CAST(n AS VARCHAR) ELSE strftime(date_note, '%Y-%m-%d') END AS day FROM v_notes")
def date_normalize_mixed(spark, d):
    v = views.notes(spark, d)
    raw = F.when(F.col("n") % 5 == 0, F.date_format("date_note", "yyyy-MM-dd")).when(F.col("n") % 5 == 1, F.date_format("date_note", "M/d/yyyy")).when(F.col("n") % 5 == 2, F.concat(F.date_format("date_note", "yyyy-MM-dd"), F.lit("T10:30:00Z"))).when(F.col("n") % 5 == 3, F.date_format("date_note", "MMM d, yyyy")).otherwise(F.concat(F.lit("about "), F.col("n").cast("string")))
    return v.select("doc_id", dates.normal_date(raw, dates.parse_model_date).alias("day"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price FROM lineitem")
def numeric_parse(spark, d):
    x = table(spark, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", F.round(dates.parse_number(F.format_number("l_extendedprice", 2)), 2).alias("price"))


@query(with_(ANN) + "SELECT unit_id, label_id, reviewer_id, label_value AS value FROM v_ann WHERE label_id IN ('quality', 'toxic')")
def yes_no_canonical(spark, d):
    a = views.annotations(spark, d).where(F.col("label_id").isin("quality", "toxic"))
    odd = F.when(F.col("label_value") == "yes", F.element_at(F.array(*[F.lit(x) for x in (" Yes ", "TRUE", "1", "present")]), (F.col("round_id") + 1).cast("int"))).otherwise(F.element_at(F.array(*[F.lit(x) for x in ("No", "false ", "0", "Absent")]), (F.col("round_id") + 1).cast("int")))
    return a.select("unit_id", "label_id", "reviewer_id", text.yes_no(odd).alias("value"))


_MULTI = "v_multi AS (SELECT doc_id, lang || '; ' || source || ',' || lang AS v, source || ',' || CASE WHEN doc_id % 4 = 0 THEN 'xx' ELSE lang END AS w FROM documents)"


def _multi(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.concat("lang", F.lit("; "), "source", F.lit(","), "lang").alias("v"), F.concat("source", F.lit(","), F.when(F.col("doc_id") % 4 == 0, "xx").otherwise(F.col("lang"))).alias("w"))


@query(with_(_MULTI) + "SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(string_split(replace(v, ';', ','), ','), lambda x: trim(x)))), ',') AS items FROM v_multi")
def multi_select_tokens(spark, d):
    return _multi(spark, d).select("doc_id", F.array_join(text.multi_set(F.col("v")), ",").alias("items"))


@query(with_(_MULTI) + "SELECT doc_id, array_to_string(list_filter(['es', 'en', 'src1', 'src0'], lambda o: list_contains(list_transform(string_split(replace(v, ';', ','), ','), lambda x: trim(x)), o)), ',') AS items FROM v_multi")
def multi_select_canonical(spark, d):
    return _multi(spark, d).select("doc_id", text.in_option_order(F.col("v"), ["es", "en", "src1", "src0"]).alias("items"))


_TOK = "tok AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9_+\\-/]+'), lambda x: x NOT IN ('the', 'a', 'an', 'and', 'or', 'of', 'to', 'in', 'for', 'with')) AS k FROM documents)"


@query(with_(_TOK) + "SELECT doc_id, CAST(len(k) AS BIGINT) AS n, sha256(array_to_string(k, ' ')) AS hash FROM tok")
def bm25_tokens(spark, d):
    k = text.search_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", k.alias("k")).select("doc_id", F.size("k").cast("long").alias("n"), F.sha2(F.array_join("k", " "), 256).alias("hash"))


@query("SELECT event_id, sha256(CAST(user_id AS VARCHAR) || event_type) AS hash FROM events")
def stable_hashes(spark, d):
    return table(spark, d, "events").select("event_id", text.stable_hash(F.col("user_id"), F.col("event_type")).alias("hash"))


@query("""WITH m AS (SELECT doc_id, lang, source FROM documents)
SELECT doc_id, '{"lang":"' || lang || '","size":"' || CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'given' END || '","source":"' || source || '"}' AS meta FROM m""")
def metadata_merge(spark, d):
    t = table(spark, d, "documents")
    first = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("size"), F.lit("even"))).otherwise(F.create_map(F.lit("blank"), F.lit(" ")))
    second = F.create_map(F.lit("size"), F.lit("given"), F.lit("lang"), F.col("lang"))
    third = F.create_map(F.lit("lang"), F.lit("zz"), F.lit("source"), F.col("source"))
    return t.select("doc_id", metadata.sorted_json(metadata.cleaned(metadata.merged(first, second, third))).alias("meta"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 5 IN (0, 1) THEN 'binary' WHEN n_nationkey % 5 = 2 THEN 'categorical_multi' WHEN n_nationkey % 5 = 3 THEN 'numeric' ELSE 'categorical' END AS kind FROM nation""")
def label_type_aliases(spark, d):
    names = F.array(*[F.lit(x) for x in ("Boolean", "yes-no", "multi_select ", "INTEGER", "free_text")])
    return table(spark, d, "nation").select("n_nationkey", text.label_type(F.element_at(names, (F.col("n_nationkey") % 5 + 1).cast("int"))).alias("kind"))


# --- sampling and allocation -----------------------------------------------------------------


@query(with_(NOTES) + "SELECT notetype || '|' || CAST(year(date_note) AS VARCHAR) AS stratum, count(*) AS n FROM v_notes GROUP BY 1")
def strata_counts(spark, d):
    return sampling.strata_counts(views.notes(spark, d).withColumn("y", F.year("date_note")), ["notetype", "y"])


# four strata of hundreds of units: a total below four times the smallest is filled evenly
_SAMPLE = """, k AS (SELECT doc_id AS unit_id, notetype AS stratum, sha256('7|sample|' || doc_id) AS k FROM v_notes),
rk AS (SELECT unit_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY k, unit_id) AS rank FROM k),
sample AS (SELECT unit_id, stratum, rank FROM rk WHERE rank <= 10)
"""


def _sample(spark, d):
    v = views.notes(spark, d).select(F.col("doc_id").alias("unit_id"), "notetype", F.col("n").alias("position"))
    return sampling.stratified_sample(v, ["notetype"], 40, 7).select("unit_id", "stratum", F.col("rank").cast("long").alias("rank"))


@query(with_(NOTES) + _SAMPLE + "SELECT * FROM sample")
def stratified_sample(spark, d):
    return _sample(spark, d)


@query(with_(NOTES) + _SAMPLE + """, o AS (SELECT unit_id, row_number() OVER (ORDER BY sha256('7|assign|' || unit_id), unit_id) - 1 AS n FROM sample),
a AS (SELECT unit_id, n < 4 AS is_overlap, r FROM o, (SELECT unnest(['r1', 'r2', 'r3']) AS r) WHERE n < 4 OR r = 'r' || CAST((n - 4) % 3 + 1 AS VARCHAR))
SELECT unit_id, r AS reviewer_id, is_overlap, row_number() OVER (PARTITION BY r ORDER BY sha256('7|display|' || r || '|' || unit_id), unit_id) - 1 AS display_rank FROM a""")
def allocate_overlap_roundrobin(spark, d):
    return sampling.allocate(_sample(spark, d), ["r1", "r2", "r3"], 4, 7).withColumn("display_rank", F.col("display_rank").cast("long"))


@query()
def twister_shuffle(spark, d):
    """The Mersenne Twister isn't SQL; tests hold it against random.Random."""
    v = views.notes(spark, d).select(F.col("doc_id").alias("unit_id"), F.col("notetype").alias("stratum"))
    return sampling.twister_shuffle(v, "7")


_PRE = """p AS (SELECT source AS unit_id, CAST(doc_id AS VARCHAR) AS doc_id, (doc_id * 7919) % 1000003 AS position, 'reason ' || lang AS selection_reason FROM documents)"""


@query(with_(_PRE) + "SELECT unit_id, min(position) AS position, string_agg(doc_id, ',' ORDER BY position, doc_id) AS doc_ids, min_by(selection_reason, position) AS reason FROM p GROUP BY unit_id")
def preselected_order(spark, d):
    t = table(spark, d, "documents")
    rows = t.select(F.col("source").alias("unit_id"), F.col("doc_id").cast("string").alias("doc_id"), (F.col("doc_id") * 7919 % 1000003).alias("position"), F.concat(F.lit("reason "), "lang").alias("selection_reason"))
    return sampling.preselected(rows).withColumn("doc_ids", F.array_join("doc_ids", ","))


@query("SELECT CAST(conv_id AS VARCHAR) AS unit_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS doc_ids, count(*) AS note_count FROM conversations GROUP BY conv_id")
def multi_doc_units(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("patient_icn"), F.col("turn").alias("doc_id"), F.lpad(F.col("turn").cast("string"), 9, "0").alias("date_note"))
    return ingest.multi_doc_units(c).withColumn("doc_ids", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ","))


@query(with_(NOTES) + "SELECT doc_id AS unit_id, l AS label_id, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS DOUBLE) AS value_num, false AS na FROM v_notes, (SELECT unnest(['quality', 'toxic']) AS l)")
def blank_annotations(spark, d):
    return ingest.blank_annotations(views.notes(spark, d).select(F.col("doc_id").alias("unit_id")), ["quality", "toxic"])


@query("""WITH u AS (SELECT DISTINCT conv_id FROM conversations)
SELECT u.conv_id, c.turn, c.role, CAST(length(c.text) AS INTEGER) AS n FROM u LEFT JOIN conversations c ON u.conv_id = c.conv_id""")
def assignment_notes_join(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id").distinct().join(c, "conv_id", "left").select("conv_id", "turn", "role", F.char_length("text").alias("n"))


@query("SELECT c_custkey, n_name, r_name, lower(n_name) AS sort_key FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def assignments_round_join(spark, d):
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name", F.lower("n_name").alias("sort_key"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, d):
    return ingest.keep_last(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1")
def insert_ignore(spark, d):
    return ingest.keep_first(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY conv_id, role")
def unit_summary_dedupe(spark, d):
    return ingest.keep_first(table(spark, d, "conversations").select("conv_id", "role", "turn"), ["conv_id", "role"], "turn")


@query(with_(ANN) + """SELECT round_id, unit_id, label_id, count(*) AS n, count(label_value) AS n_text, count(label_value_num) AS n_num, count(label_value_date) AS n_date,
  string_agg(reviewer_id, ',' ORDER BY reviewer_id) AS reviewers FROM v_ann GROUP BY ALL""")
def aggregate_unit_annotations(spark, d):
    a = views.annotations(spark, d)
    parts = [a.where(F.col("reviewer_id") == r) for r in ("r1", "r2", "r3")]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("round_id", "unit_id", "label_id").agg(F.count("*").alias("n"), F.count("label_value").alias("n_text"), F.count("label_value_num").alias("n_num"), F.count("label_value_date").alias("n_date"), F.array_join(F.array_sort(F.collect_list("reviewer_id")), ",").alias("reviewers"))


# --- agreement and consensus -----------------------------------------------------------------

_CAT = ", c AS (SELECT * FROM v_ann WHERE label_id IN ('quality', 'toxic') AND NOT na)\n"


def _cat(spark, d):
    return views.annotations(spark, d).where(F.col("label_id").isin("quality", "toxic") & ~F.col("na"))


@query(with_(ANN) + _CAT + ", u AS (SELECT label_id, unit_id, count(DISTINCT label_value) AS k FROM c GROUP BY ALL) SELECT label_id, count(*) AS n_units, round(avg(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM u WHERE k > 0 GROUP BY label_id")
def percent_agreement_lenient(spark, d):
    return agreement.percent_agreement(_cat(spark, d)).withColumn("agreement", r6("agreement"))


@query(with_(ANN) + """, x AS (SELECT label_id, unit_id, CASE WHEN na AND reviewer_id = 'r3' THEN '-' ELSE label_value END AS v FROM v_ann WHERE label_id IN ('quality', 'toxic')),
u AS (SELECT label_id, unit_id, count(DISTINCT v) AS k FROM x GROUP BY ALL) SELECT label_id, count(*) AS n_units, round(avg(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM u GROUP BY label_id""")
def percent_agreement_strict(spark, d):
    a = views.annotations(spark, d).where(F.col("label_id").isin("quality", "toxic"))
    return agreement.percent_agreement(a.withColumn("label_value", F.when(~(F.col("na") & (F.col("reviewer_id") == "r3")), F.col("label_value"))), strict=True).withColumn("agreement", r6("agreement"))


@query(with_(ANN) + _CAT + """, p AS (SELECT a.label_id, a.reviewer_id AS r1, b.reviewer_id AS r2, a.label_value AS x, b.label_value AS y FROM c a JOIN c b ON a.unit_id = b.unit_id AND a.label_id = b.label_id AND a.reviewer_id < b.reviewer_id),
k AS (SELECT label_id, r1, r2, count(*) AS n, avg(CASE WHEN x = y THEN 1.0 ELSE 0.0 END) AS po, avg(CASE WHEN x = 'yes' THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN y = 'yes' THEN 1.0 ELSE 0.0 END) AS b FROM p GROUP BY ALL)
SELECT label_id, r1, r2, n, round(CASE WHEN a * b + (1 - a) * (1 - b) >= 1 THEN 1.0 ELSE (po - a * b - (1 - a) * (1 - b)) / (1 - a * b - (1 - a) * (1 - b)) END, 6) AS kappa FROM k""")
def cohens_kappa_by_label(spark, d):
    return agreement.cohens_kappa(_cat(spark, d)).withColumn("kappa", r6("kappa"))


@query(with_(ANN) + _CAT + """, u AS (SELECT label_id, unit_id, count(*) AS n, count(*) FILTER (label_value = 'yes') AS y FROM c GROUP BY ALL HAVING count(*) >= 2),
s AS (SELECT label_id, count(*) AS n_units, avg((y * (y - 1) + (n - y) * (n - y - 1)) / (n * (n - 1.0::DOUBLE))) AS p, sum(y) / sum(n)::DOUBLE AS q FROM u GROUP BY label_id)
SELECT label_id, n_units, round((p - q * q - (1 - q) * (1 - q)) / (1 - q * q - (1 - q) * (1 - q)), 6) AS kappa FROM s""")
def fleiss_kappa_by_label(spark, d):
    return agreement.fleiss_kappa(_cat(spark, d)).withColumn("kappa", r6("kappa"))


@query(with_(ANN) + _CAT + "SELECT label_id, unit_id, count(*) AS n_ratings, count(DISTINCT label_value) AS n_values FROM c GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT label_value) >= 2")
def iaa_discordant_units(spark, d):
    return agreement.discordant_units(_cat(spark, d))


@query(with_(ANN) + """SELECT label_id, CASE WHEN count(label_value_num) FILTER (NOT na) > 0 THEN 'numeric' WHEN count(label_value_date) FILTER (NOT na) > 0 THEN 'date'
  WHEN bool_and(label_value IN ('yes', 'no')) FILTER (NOT na AND label_value IS NOT NULL) THEN 'binary' ELSE 'categorical' END AS label_type FROM v_ann GROUP BY label_id""")
def label_types(spark, d):
    return consensus.label_types(views.annotations(spark, d))


@query(with_(ANN) + _CAT + """, n AS (SELECT unit_id, label_id, label_value, count(*) AS c FROM c GROUP BY ALL),
p AS (SELECT unit_id, label_id, c / sum(c) OVER (PARTITION BY unit_id, label_id) AS p, c FROM n)
SELECT unit_id, label_id, CAST(sum(c) AS BIGINT) AS n_reviewers, round(abs(sum(-p * log2(p)) / log2(greatest(count(*), 2))), 6) AS score FROM p GROUP BY ALL""")
def disagreement_categorical(spark, d):
    return consensus.categorical_disagreement(_cat(spark, d)).withColumn("score", F.abs(r6("score")))


_SPREAD = """, v AS (SELECT unit_id, label_id, reviewer_id, {v} AS v FROM v_ann WHERE NOT na AND {v} IS NOT NULL),
q AS (SELECT label_id, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM v GROUP BY label_id)
SELECT v.unit_id, v.label_id, count(DISTINCT reviewer_id) AS n_reviewers, round(CASE WHEN any_value(iqr) <= 0 THEN 1.0 ELSE least(1.0, (max(v) - min(v)) / (4 * greatest(1e-6, any_value(iqr)))) END, 6) AS score FROM v JOIN q ON v.label_id = q.label_id GROUP BY ALL"""


@query(with_(ANN) + _SPREAD.format(v="label_value_num"))
def disagreement_numeric(spark, d):
    return consensus.spread_disagreement(views.annotations(spark, d)).withColumn("score", r6("score"))


@query(with_(ANN) + _SPREAD.format(v="CAST(label_value_date - DATE '1970-01-01' AS DOUBLE)"))
def disagreement_date(spark, d):
    return consensus.spread_disagreement(views.annotations(spark, d), "v_date").withColumn("score", r6("score"))


_ROUNDS = ", rr AS (SELECT unit_id, label_id, reviewer_id, 'round' || CAST((CAST(unit_id AS BIGINT) + CAST(substr(reviewer_id, 2) AS BIGINT)) % 12 + 1 AS VARCHAR) AS round_id, label_value, label_value_num, label_value_date, na FROM v_ann)\n"


def _rounds(spark, d):
    a = views.annotations(spark, d)
    return a.withColumn("round_id", F.concat(F.lit("round"), ((F.col("unit_id").cast("long") + F.substring("reviewer_id", 2, 9).cast("long")) % 12 + 1).cast("string")))


@query(with_(ANN) + _ROUNDS + """, o AS (SELECT DISTINCT unit_id, label_id, round_id, CAST(substr(round_id, 6) AS BIGINT) AS o FROM rr)
SELECT unit_id, label_id, round_id, round(pow(0.5, max(o) OVER (PARTITION BY unit_id, label_id) - o), 6) AS weight FROM o""")
def disagreement_decay(spark, d):
    return consensus.round_weights(_rounds(spark, d)).withColumn("weight", r6("weight"))


@query(with_(ANN) + """SELECT unit_id, label_id, (count(DISTINCT label_value) FILTER (NOT na) >= 2)
  OR coalesce(max(label_value_num) FILTER (NOT na) - min(label_value_num) FILTER (NOT na) > greatest(1.0, 0.05 * greatest(1.0, max(abs(label_value_num)) FILTER (NOT na))), false)
  OR coalesce(max(label_value_date) FILTER (NOT na) - min(label_value_date) FILTER (NOT na) > 1, false) AS hard FROM v_ann GROUP BY unit_id, label_id""")
def hard_disagree(spark, d):
    return consensus.hard_disagreement(views.annotations(spark, d))


@query(with_(ANN) + _ROUNDS + """, m AS (SELECT *, CAST(substr(round_id, 6) AS BIGINT) AS o, max(CAST(substr(round_id, 6) AS BIGINT)) OVER (PARTITION BY unit_id, label_id) AS top FROM rr),
c AS (SELECT * FROM m WHERE o = top), t AS (SELECT unit_id, label_id, label_value, count(*) AS k FROM c WHERE NOT na AND label_value IS NOT NULL GROUP BY ALL),
w AS (SELECT unit_id, label_id, label_value FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, label_id ORDER BY k DESC, label_value) AS r FROM t) WHERE r = 1)
SELECT c.unit_id, c.label_id, any_value(round_id) AS round_id, median(label_value_num) FILTER (NOT na) AS num,
  strftime(DATE '1970-01-01' + CAST(floor(median(CAST(label_value_date - DATE '1970-01-01' AS DOUBLE)) FILTER (NOT na)) AS INTEGER), '%Y-%m-%d') AS day, any_value(w.label_value) AS value
FROM c LEFT JOIN w ON c.unit_id = w.unit_id AND c.label_id = w.label_id GROUP BY c.unit_id, c.label_id""")
def last_round_consensus(spark, d):
    return consensus.last_round_consensus(_rounds(spark, d)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(with_(ANN) + """, v AS (SELECT unit_id, label_id, coalesce(strftime(label_value_date, '%Y-%m-%d'), label_value) AS v FROM v_ann WHERE NOT na AND label_id <> 'length'),
n AS (SELECT unit_id, label_id, v, count(*) AS c FROM v WHERE v IS NOT NULL GROUP BY ALL)
SELECT unit_id, label_id, CAST(sum(c) AS BIGINT) AS n, max_by(v, c * 1000 - rk) AS gold_value FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, label_id ORDER BY v) AS rk FROM n) GROUP BY ALL HAVING sum(c) >= 2""")
def gold_from_annotations(spark, d):
    return consensus.gold_labels(views.annotations(spark, d).where("label_id <> 'length'"))


# --- gating and evaluation -------------------------------------------------------------------

GATES = {"toxic": gating.parse_gate("quality == 'yes'"), "seen": gating.parse_gate("length > 500 or quality in ('no', 'never')")}
KINDS = {"quality": "categorical", "length": "numeric"}
_ELIG = """, w AS (SELECT unit_id, min(prediction_value) FILTER (label_id = 'quality') AS q, min(prediction_value) FILTER (label_id = 'length') AS l FROM v_pred GROUP BY unit_id),
e AS (SELECT unit_id, 'toxic' AS child, coalesce(q, '') = 'yes' AS eligible FROM w UNION ALL SELECT unit_id, 'seen', coalesce(TRY_CAST(l AS DOUBLE) > 500, false) OR coalesce(q, '') IN ('no', 'never') FROM w)\n"""


@query(with_(ANN, PRED) + _ELIG + "SELECT * FROM e")
def gating_eligibility(spark, d):
    return gating.eligibility(views.predictions(spark, d), GATES, KINDS)


@query(with_(ANN, PRED) + _ELIG + "SELECT p.unit_id, p.label_id, CASE WHEN coalesce(eligible, true) THEN prediction_value END AS prediction_value FROM v_pred p LEFT JOIN e ON p.unit_id = e.unit_id AND p.label_id = e.child")
def gated_predictions(spark, d):
    return gating.gated_predictions(views.predictions(spark, d).select("unit_id", "label_id", "prediction_value"), GATES, KINDS)


@query(with_(ANN) + """, b AS (SELECT unit_id, reviewer_id, label_id, label_value, label_value_num, label_value_date, na FROM v_ann WHERE NOT (CAST(unit_id AS BIGINT) % 4 = 1 AND label_id = 'toxic')),
k AS (SELECT unit_id, reviewer_id, min(label_value) FILTER (label_id = 'quality') AS q, bool_or(label_id = 'toxic') AS t FROM b GROUP BY ALL)
SELECT unit_id, reviewer_id, coalesce(t, false) OR coalesce(q, '') <> 'yes' AS complete FROM k""")
def completion_flags(spark, d):
    a = views.annotations(spark, d).where(~((F.col("unit_id").cast("long") % 4 == 1) & (F.col("label_id") == "toxic")))
    return gating.completion(a, ["quality", "toxic"], {"toxic": GATES["toxic"]}, KINDS)


_PAIR = ", p AS (SELECT g.unit_id, g.label_id, gold_value AS g, prediction_value AS p FROM v_gold g JOIN v_pred q ON g.unit_id = q.unit_id AND g.label_id = q.label_id)\n"


def _pairs(spark, d):
    return evaluation.paired(views.gold(spark, d), views.predictions(spark, d))


def _rounded(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


@query(with_(ANN, GOLD, PRED) + _PAIR + """, c AS (SELECT label_id, count(*) AS n, count(*) FILTER (g = 'yes' AND p = 'yes') AS tp, count(*) FILTER (g <> 'yes' AND p = 'yes') AS fp, count(*) FILTER (g = 'yes' AND p <> 'yes') AS fn, count(*) FILTER (g <> 'yes' AND p <> 'yes') AS tn FROM p WHERE label_id IN ('quality', 'toxic') GROUP BY label_id)
SELECT *, round((tp + tn) / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def metrics_binary(spark, d):
    return _rounded(evaluation.binary_metrics(_pairs(spark, d).where(F.col("label_id").isin("quality", "toxic"))), "accuracy", "precision", "recall", "f1")


@query("""WITH p AS (SELECT 'lang' AS label_id, lang AS g, CASE WHEN doc_id % 6 = 0 THEN 'en' WHEN doc_id % 11 = 0 THEN 'xx' ELSE lang END AS p FROM documents),
k AS (SELECT DISTINCT g AS v FROM p), f AS (SELECT v, 2.0::DOUBLE * (SELECT count(*) FROM p WHERE g = v AND p = v) / ((SELECT count(*) FROM p WHERE g = v) + (SELECT count(*) FROM p WHERE p = v)) AS f1 FROM k)
SELECT 'lang' AS label_id, (SELECT count(*) FROM p) AS n, (SELECT round(avg(CASE WHEN g = p THEN 1.0 ELSE 0.0 END), 6) FROM p) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM f""")
def metrics_multiclass_macro_f1(spark, d):
    t = table(spark, d, "documents")
    p = t.select(F.lit("lang").alias("label_id"), F.col("lang").alias("gold_value"), F.when(F.col("doc_id") % 6 == 0, "en").when(F.col("doc_id") % 11 == 0, "xx").otherwise(F.col("lang")).alias("prediction_value"))
    return _rounded(evaluation.multiclass_metrics(p), "accuracy", "macro_f1")


_SETS = ", s AS (SELECT list_sort(list_distinct(list_transform(string_split(replace(v, ';', ','), ','), lambda x: trim(x)))) AS g, list_sort(list_distinct(string_split(w, ','))) AS p FROM v_multi)\n"


def _multi_pairs(spark, d):
    return _multi(spark, d).select(F.lit("tags").alias("label_id"), F.col("v").alias("gold_value"), F.col("w").alias("prediction_value"))


@query(with_(_MULTI) + _SETS + """SELECT 'tags' AS label_id, count(*) AS n, round(avg(CASE WHEN g = p THEN 1.0 ELSE 0.0 END), 6) AS exact, round(avg(len(list_intersect(g, p)) / len(list_distinct(list_concat(g, p)))), 6) AS jaccard,
  round(avg(CASE WHEN len(list_intersect(g, p)) < len(p) THEN 1.0 ELSE 0.0 END), 6) AS over, round(avg(CASE WHEN len(list_intersect(g, p)) < len(g) THEN 1.0 ELSE 0.0 END), 6) AS under FROM s""")
def metrics_multiselect(spark, d):
    return _rounded(evaluation.multiselect_metrics(_multi_pairs(spark, d)), "exact", "jaccard", "over", "under")


@query(with_(_MULTI) + _SETS + """, i AS (SELECT unnest(list_distinct(list_concat(g, p))) AS item, g, p FROM s),
c AS (SELECT item, count(*) FILTER (list_contains(g, item) AND list_contains(p, item)) AS tp, count(*) FILTER (NOT list_contains(g, item)) AS fp, count(*) FILTER (NOT list_contains(p, item)) AS fn FROM i GROUP BY item)
SELECT 'tags' AS label_id, item, tp + fn AS support, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def metrics_multiselect_items(spark, d):
    return _rounded(evaluation.multiselect_items(_multi_pairs(spark, d)), "precision", "recall", "f1")


@query(with_(ANN, GOLD, PRED) + _PAIR + """, e AS (SELECT label_id, abs(CAST(p AS DATE) - CAST(g AS DATE)) AS e FROM p WHERE label_id = 'seen')
SELECT label_id, count(*) AS n, round(avg(CASE WHEN e <= 0 THEN 1.0 ELSE 0.0 END), 6) AS exact, round(avg(CASE WHEN e <= 3 THEN 1.0 ELSE 0.0 END), 6) AS within_3d, round(avg(CASE WHEN e <= 7 THEN 1.0 ELSE 0.0 END), 6) AS within_7d, round(avg(CASE WHEN e <= 30 THEN 1.0 ELSE 0.0 END), 6) AS within_30d,
  round(avg(e), 6) AS mae_days, round(quantile_cont(CAST(e AS DOUBLE), 0.9), 6) AS p90_days FROM e GROUP BY label_id""")
def metrics_date_windows(spark, d):
    return _rounded(evaluation.date_metrics(_pairs(spark, d).where("label_id = 'seen'")), "exact", "within_3d", "within_7d", "within_30d", "mae_days", "p90_days")


@query(with_(ANN, GOLD, PRED) + _PAIR + """, e AS (SELECT label_id, CAST(g AS DOUBLE) AS g, abs(CAST(p AS DOUBLE) - CAST(g AS DOUBLE)) AS e FROM p WHERE label_id = 'length')
SELECT label_id, count(*) AS n, round(avg(e), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(CASE WHEN e <= 0.1 * abs(g) THEN 1.0 ELSE 0.0 END), 6) AS within_10pct FROM e GROUP BY label_id""")
def metrics_numeric(spark, d):
    return _rounded(evaluation.numeric_metrics(_pairs(spark, d).where("label_id = 'length'")), "mae", "rmse", "within_10pct")


@query(with_(ANN, GOLD, PRED) + _PAIR + """, c AS (SELECT count(*) AS n, avg(CASE WHEN g = p THEN 1.0 ELSE 0.0 END) AS a, count(*) FILTER (g = 'yes' AND p = 'yes') AS tp, count(*) FILTER (g <> 'yes' AND p = 'yes') AS fp, count(*) FILTER (g = 'yes' AND p <> 'yes') AS fn FROM p)
SELECT n, round(a, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def metrics_global(spark, d):
    return _rounded(evaluation.global_metrics(_pairs(spark, d)), "accuracy", "precision", "recall", "f1")


@query(with_(ANN, GOLD, PRED) + _PAIR + """, u AS (SELECT unit_id, bool_or(label_id = 'quality' AND g = 'yes') AS g, bool_or(label_id = 'quality' AND p = 'yes') AS p, bool_and(g = p) FILTER (label_id IN ('toxic', 'seen')) AS ok, count(*) FILTER (label_id IN ('toxic', 'seen') AND g = p) AS r, count(*) FILTER (label_id IN ('toxic', 'seen')) AS k FROM p GROUP BY unit_id),
c AS (SELECT count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn, sum(r) FILTER (g AND p) AS r, sum(k) FILTER (g AND p) AS k, count(*) FILTER (g AND p AND coalesce(ok, true)) AS e FROM u)
SELECT 'quality' AS parent, tp AS parent_tp, fp AS parent_fp, fn AS parent_fn, tn AS parent_tn, round(r / k, 6) AS child_accuracy, fn AS lost_due_to_parent_fn, fp AS spurious_families, round(e / (tp + fn), 6) AS end_to_end_recall FROM c""")
def metrics_family(spark, d):
    return _rounded(evaluation.family_metrics(_pairs(spark, d), "quality", ["toxic", "seen"]), "child_accuracy", "end_to_end_recall")


@query(with_(ANN, PRED) + "SELECT unit_id, min(prediction_value) FILTER (label_id = 'quality') AS quality, min(prediction_value) FILTER (label_id = 'toxic') AS toxic, min(prediction_value) FILTER (label_id = 'length') AS length, min(prediction_value) FILTER (label_id = 'seen') AS seen FROM v_pred GROUP BY unit_id")
def pivot_predictions_wide(spark, d):
    return evaluation.pivot_wide(views.predictions(spark, d), ["quality", "toxic", "length", "seen"])


@query(with_(ANN, PRED) + "SELECT unit_id, label_id, prediction_value FROM v_pred WHERE label_id IN ('quality', 'toxic') AND prediction_value IS NOT NULL")
def unpivot_predictions(spark, d):
    wide = evaluation.pivot_wide(views.predictions(spark, d), ["quality", "toxic"]).select("unit_id", F.col("quality").alias("quality_llm"), F.col("toxic").alias("toxic_llm"))
    tall = wide.unpivot("unit_id", ["quality_llm", "toxic_llm"], "label_id", "prediction_value").where("prediction_value is not null")
    return tall.withColumn("label_id", F.regexp_replace("label_id", "_llm$", ""))


@query(with_(ANN, PRED) + """SELECT unit_id, '[' || string_agg('{"label_id":"' || label_id || '","prediction_value":"' || prediction_value || '"}', ',' ORDER BY label_id) || ']' AS predictions FROM v_pred GROUP BY unit_id""")
def nested_predictions(spark, d):
    return tables.nested_by_unit(views.predictions(spark, d).select("unit_id", "label_id", "prediction_value"))


# --- retrieval -------------------------------------------------------------------------------

SEARCHES = {"gain": ["that", "this", "ndst"], "lieu": ["que", "les", "les"], "ort": ["und", "der", "stand"]}
_BM25 = with_(_TOK) + """, t AS (SELECT unnest(['that', 'this', 'ndst', 'que', 'les', 'und', 'der', 'stand']) AS term),
s AS (SELECT count(*) AS n, avg(len(k)) AS avgdl FROM tok), f AS (SELECT doc_id, len(k) AS dl, term, len(list_filter(k, lambda x: x = term)) AS tf FROM tok, t),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM f GROUP BY term), q(query, term, times) AS (VALUES ('gain', 'that', 1), ('gain', 'this', 1), ('gain', 'ndst', 1), ('lieu', 'que', 1), ('lieu', 'les', 2), ('ort', 'und', 1), ('ort', 'der', 1), ('ort', 'stand', 1)),
b AS (SELECT query, doc_id, sum(times * (ln((n - df + 0.5) / (df + 0.5)) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN f ON q.term = f.term JOIN df ON df.term = q.term, s GROUP BY ALL)
"""


@query(with_(_TOK) + """, d AS (SELECT unnest(list_distinct(k)) AS term FROM tok), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(*) AS df, round(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) + 1, 6) AS idf FROM d, n GROUP BY term""")
def idf_table(spark, d):
    return retrieval.idf_table(table(spark, d, "documents")).withColumn("idf", r6("idf"))


@query(_BM25 + "SELECT query, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b WHERE score > 0) WHERE rank <= 20")
def bm25_topk(spark, d):
    s = retrieval.bm25_scores(table(spark, d, "documents"), SEARCHES).withColumn("score", F.round("score", 9))
    return retrieval.top_k(s, 20, ["query"], "score", ["doc_id"]).select("query", "doc_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


_COS = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE len(embedding) > 0),
s AS (SELECT a.vec_id AS query, b.vec_id, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
c AS (SELECT query, vec_id, s, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS rank FROM s)
"""


@query(_COS + "SELECT query, vec_id, round(s, 4) AS similarity, rank FROM c WHERE rank <= 10")
def cosine_topk(spark, d):
    got = retrieval.cosine_top_k(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0, 10)
    return got.select("query", "vec_id", F.round("similarity", 4).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query()
def ivf_search(spark, d):
    """Approximate; tests measure its recall against cosine_top_k."""
    return retrieval.ivf_search(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0, 10)


@query(with_(NOTES) + """, a AS (SELECT notetype AS query, doc_id, CAST(n_chars AS DOUBLE) AS score FROM v_notes WHERE n % 2 = 0), b AS (SELECT notetype AS query, doc_id, CAST(n % 1009 AS DOUBLE) AS score FROM v_notes WHERE n % 3 = 0),
r AS (SELECT *, 0 AS ch, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS r FROM a UNION ALL SELECT *, 1, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) FROM b),
o AS (SELECT query, doc_id, max(CASE WHEN r <= CASE WHEN ch = 0 THEN 21 ELSE 9 END THEN 1 ELSE 0 END) AS f, max(score) AS score FROM r GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY f DESC, score DESC, doc_id) AS n FROM o)
SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM k WHERE n <= 30""")
def candidate_pool(spark, d):
    v = views.notes(spark, d)
    a = v.where("n % 2 = 0").select(F.col("notetype").alias("query"), "doc_id", F.col("n_chars").cast("double").alias("score"))
    b = v.where("n % 3 = 0").select(F.col("notetype").alias("query"), "doc_id", (F.col("n") % 1009).cast("double").alias("score"))
    return retrieval.candidate_pool(a, b, 10).withColumn("rank", F.col("rank").cast("long"))


_CHUNKS = "v_chunks AS (SELECT doc_id, CAST(i AS INTEGER) AS chunk_id, substr(text, i * 500 + 1, 500) AS text FROM (SELECT doc_id, coalesce(text, '') AS text, unnest(range(greatest(1, CAST(ceil(length(coalesce(text, '')) / 500) AS BIGINT)))) AS i FROM documents))"


def _chunks(spark, d):
    return retrieval.fixed_chunks(table(spark, d, "documents"))


@query(with_(_CHUNKS) + "SELECT doc_id, chunk_id, sha256(text) AS hash FROM v_chunks")
def fixed_chunks(spark, d):
    return _chunks(spark, d).select("doc_id", "chunk_id", F.sha2("text", 256).alias("hash"))


@query()
def recursive_chunks(spark, d):
    """The splitter looks back for separators step by step; tests hold it against its rules."""
    return retrieval.recursive_chunks(table(spark, d, "documents")).select("doc_id", "chunk_id", "start", F.char_length("text").alias("n"))


@query(with_(_CHUNKS) + """, h AS (SELECT doc_id, chunk_id FROM v_chunks WHERE (doc_id + chunk_id) % 5 = 0)
SELECT c.doc_id, c.chunk_id, bool_or(c.chunk_id = h.chunk_id) AS is_hit FROM v_chunks c JOIN h ON c.doc_id = h.doc_id AND abs(c.chunk_id - h.chunk_id) <= 1 GROUP BY ALL""")
def neighbor_padding(spark, d):
    c = _chunks(spark, d)
    return retrieval.neighbours(c.where((F.col("doc_id") + F.col("chunk_id")) % 5 == 0), c)


@query(with_(_CHUNKS) + """, f AS (SELECT doc_id, '[doc_id=' || CAST(doc_id AS VARCHAR) || ', chunk_id=' || CAST(chunk_id AS VARCHAR) || '] ' || text AS f, chunk_id FROM v_chunks),
u AS (SELECT *, sum(length(f)) OVER (PARTITION BY doc_id ORDER BY chunk_id ROWS UNBOUNDED PRECEDING) AS used FROM f)
SELECT doc_id, sha256(string_agg(f, chr(10) || chr(10) ORDER BY chunk_id)) AS hash, count(*) AS n_chunks FROM u WHERE used <= 3000 GROUP BY doc_id""")
def context_char_budget(spark, d):
    return retrieval.context(_chunks(spark, d).withColumn("doc", F.col("doc_id")), "doc", ["chunk_id"], 3000).select(F.col("doc").alias("doc_id"), F.sha2("context", 256).alias("hash"), "n_chunks")


@query(with_(_CHUNKS) + """, r AS (SELECT doc_id, chunk_id, text, CAST((doc_id * 31 + chunk_id * 17) % 97 AS DOUBLE) AS a, CAST((doc_id * 13 + chunk_id * 29) % 89 AS DOUBLE) AS b, doc_id % 50 AS family FROM v_chunks),
o AS (SELECT family, doc_id, chunk_id, text, greatest(a, b) AS score FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score DESC, doc_id, chunk_id) AS rank FROM o),
u AS (SELECT *, sum(length(text)) OVER (PARTITION BY family ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM k WHERE rank <= 12)
SELECT family, doc_id, chunk_id, score, rank, CAST(used AS BIGINT) AS used FROM u WHERE used <= 4000""")
def family_context(spark, d):
    c = _chunks(spark, d).withColumn("family", F.col("doc_id") % 50)
    a = c.withColumn("score", ((F.col("doc_id") * 31 + F.col("chunk_id") * 17) % 97).cast("double"))
    b = c.withColumn("score", ((F.col("doc_id") * 13 + F.col("chunk_id") * 29) % 89).cast("double"))
    return retrieval.family_context(a.union(b), "family", 12, 4000).select("family", "doc_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"), F.col("used").cast("long").alias("used"))


@query(with_(NOTES) + """, a AS (SELECT notetype, doc_id, row_number() OVER (PARTITION BY notetype ORDER BY n_chars DESC, doc_id) AS rank FROM v_notes), b AS (SELECT notetype, doc_id, row_number() OVER (PARTITION BY notetype ORDER BY n % 1009, doc_id) AS rank FROM v_notes)
SELECT notetype, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def rrf_fusion(spark, d):
    v = views.notes(spark, d)
    rank = lambda *o: F.row_number().over(Window.partitionBy("notetype").orderBy(*o))
    a, b = v.withColumn("rank", rank(F.desc("n_chars"), "doc_id")), v.withColumn("rank", rank(F.col("n") % 1009, "doc_id"))
    return retrieval.rrf([a, b], "notetype", "doc_id").withColumn("score", F.round("score", 9))


@query()
def mmr_select(spark, d):
    """Greedy; tests hold it against a plain loop."""
    e = table(spark, d, "embeddings")
    w = Window.partitionBy("label").orderBy(F.desc("score"), "vec_id")
    pool = e.withColumn("score", F.element_at("embedding", 1).cast("double")).withColumn("_n", F.row_number().over(w)).where("_n <= 50")
    return retrieval.mmr(pool, "label", 10)


# --- selection -------------------------------------------------------------------------------


@query()
def kcenter_select(spark, d):
    """Greedy over all rows; tests hold it against a plain loop."""
    return selection.k_center(table(spark, d, "embeddings"), "label", 10)


@query()
def label_prototypes_kmeans(spark, d):
    """k-means starts at random points of a seed."""
    e = table(spark, d, "embeddings")
    labels = [r.label for r in e.select("label").distinct().orderBy("label").collect()]  # labels are few
    return selection.prototypes(e, "label", labels, 4)


@query("""WITH w AS (SELECT label, embedding, embedding[1]::DOUBLE AS w FROM embeddings), t AS (SELECT label, max(w) AS m FROM w GROUP BY label),
x AS (SELECT w.label, exp(5 * (w.w - t.m)) AS e, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM w JOIN t ON w.label = t.label)
SELECT label, CAST(dim AS INTEGER) AS dim, round(sum(e * x) / sum(e), 6) AS x FROM x GROUP BY label, dim""")
def pooled_vectors(spark, d):
    e = table(spark, d, "embeddings").withColumn("w", F.element_at("embedding", 1).cast("double"))
    got = selection.pooled_vectors(e, "label")
    return got.select("label", F.posexplode("pooled").alias("dim", "x")).withColumn("x", r6("x"))


@query("""WITH r AS (SELECT vec_id, label, embedding[2]::DOUBLE AS rel FROM embeddings), q AS (SELECT label, quantile_cont(rel, 0.8) AS c FROM r GROUP BY label) SELECT r.vec_id, r.label FROM r JOIN q ON r.label = q.label WHERE rel >= c""")
def quantile_gate(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.element_at("embedding", 2).cast("double").alias("rel"))
    return selection.quantile_gate(e, 0.8).select("vec_id", "label")


@query("SELECT lang, least(n, 60) AS quota FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def equal_quota(spark, d):
    """Sixty for each language, or fewer where there are fewer."""
    counts = {r.lang: r.n for r in table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    total = sum(min(n, 60) for n in counts.values())
    got = sampling.equal_quota(counts, total)
    return spark.createDataFrame([(k, v) for k, v in got.items()], "lang string, quota long")


@query("""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), e AS (SELECT lang, 96 * n::DOUBLE / sum(n) OVER () AS x FROM c), f AS (SELECT lang, floor(x) AS b, row_number() OVER (ORDER BY floor(x) - x, lang) AS r FROM e)
SELECT lang, CAST(1 + b + CASE WHEN r <= 96 - sum(b) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f""")
def apportion_mix(spark, d):
    counts = {r.lang: r.n for r in table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    return spark.createDataFrame([(k, v) for k, v in sampling.apportion(counts, 96 + len(counts)).items()], "lang string, quota long")


_U = with_(ANN, PRED) + ", u AS (SELECT unit_id, label_id, coalesce(entropy, 1 - coalesce(consistency, 0)) AS u FROM v_pred)\n"


@query(_U + "SELECT unit_id, label_id, round(u, 6) AS u FROM u")
def uncertainty_scores(spark, d):
    return selection.uncertainty(views.predictions(spark, d)).select("unit_id", "label_id", r6("u").alias("u"))


_RR = _U + """, r AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY u {o}, unit_id) AS label_rank FROM u), t AS (SELECT *, row_number() OVER (ORDER BY label_rank, label_id) AS global_rank FROM r)
SELECT unit_id, label_id, label_rank, global_rank FROM t WHERE global_rank <= 30"""


def _robin(spark, d, certain):
    got = selection.round_robin(selection.uncertainty(views.predictions(spark, d)), 30, certain=certain)
    return got.select("unit_id", "label_id", F.col("label_rank").cast("long").alias("label_rank"), F.col("global_rank").cast("long").alias("global_rank"))


@query(_RR.format(o="DESC"))
def round_robin_uncertain(spark, d):
    return _robin(spark, d, False)


@query(_RR.format(o="ASC"))
def round_robin_certain(spark, d):
    return _robin(spark, d, True)


@query(with_(NOTES) + """, a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM v_notes), b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS r FROM v_notes), c AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('3|pool|' || doc_id), doc_id) AS r FROM v_notes),
u AS (SELECT doc_id AS unit_id, 'long' AS bucket, 0 AS p, 6 AS q, r FROM a WHERE r <= 20 UNION ALL SELECT doc_id, 'short', 1, 6, r FROM b WHERE r <= 20 UNION ALL SELECT doc_id, 'random', 2, 8, r FROM c WHERE r <= 20),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY p, r) AS k FROM u) WHERE k = 1), n AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY r, unit_id) AS n FROM f),
o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN n > q THEN 1 ELSE 0 END, p, n, unit_id) AS position FROM n) SELECT unit_id, bucket, position FROM o WHERE position <= 25""")
def batch_assembly(spark, d):
    v = views.notes(spark, d).select(F.col("doc_id").alias("unit_id"), "n_chars")
    w = lambda *o: Window.partitionBy(F.lit(0)).orderBy(*o)
    a = v.orderBy(F.desc("n_chars"), "unit_id").limit(20).withColumn("rank", F.row_number().over(w(F.desc("n_chars"), "unit_id")))
    b = v.orderBy("n_chars", "unit_id").limit(20).withColumn("rank", F.row_number().over(w("n_chars", "unit_id")))
    c = sampling.hash_order_pool(v, 20, 3).withColumn("rank", F.row_number().over(w(sampling.shuffle_key(3, "pool"), "unit_id")))
    return selection.assemble_batch([("long", a, 6), ("short", b, 6), ("random", c, 8)], 25).withColumn("position", F.col("position").cast("long"))


@query(with_(ANN, PRED) + """, h AS (SELECT unit_id, label_id, 0 AS target, 12 AS q FROM v_pred WHERE label_id = 'toxic' AND prediction_value IN ('yes') UNION ALL SELECT unit_id, label_id, 1, 7 FROM v_pred WHERE label_id = 'quality' AND prediction_value <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY CAST(unit_id AS BIGINT), unit_id) AS rank FROM h) SELECT unit_id, label_id, target, rank FROM r WHERE rank <= q""")
def label_first_selection(spark, d):
    p = views.predictions(spark, d).withColumn("position", F.col("unit_id").cast("long"))
    return selection.label_first(p, [{"label_id": "toxic", "values": ["Yes"], "quota": 12}, {"label_id": "quality", "values": [], "quota": 7}]).withColumn("rank", F.col("rank").cast("long"))


@query(with_(NOTES) + "SELECT doc_id FROM v_notes WHERE doc_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)")
def unit_exclusion(spark, d):
    seen = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))
    return views.notes(spark, d).join(seen, "doc_id", "left_anti").select("doc_id")


@query(with_(NOTES, ANN) + "SELECT doc_id AS unit_id, l AS label_id FROM v_notes, (SELECT unnest(['quality', 'seen', 'new']) AS l) WHERE NOT EXISTS (SELECT 1 FROM v_ann a WHERE a.unit_id = doc_id AND a.label_id = l)")
def unseen_pairs(spark, d):
    return selection.unseen_pairs(views.notes(spark, d).select(F.col("doc_id").alias("unit_id")), ["quality", "seen", "new"], views.annotations(spark, d))


@query("SELECT event_id, event_type, round(coalesce((value - min(value) OVER (PARTITION BY event_type)) / nullif(max(value) OVER (PARTITION BY event_type) - min(value) OVER (PARTITION BY event_type), 0), 0), 6) AS scaled FROM events")
def min_max_scaled(spark, d):
    return selection.min_max(table(spark, d, "events"), "value", ["event_type"]).select("event_id", "event_type", r6("scaled").alias("scaled"))


# --- labelling and jobs ----------------------------------------------------------------------

RULES = {"licence": {"apache": ["apache license"], "mit": ["mit license"], "gpl": ["general public license"]}, "secret": {"yes": ["password=", "token ="]}}


@query("""WITH l AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
SELECT doc_id, 'licence' AS label_id, CASE WHEN contains(t, 'apache license') THEN 'apache' WHEN contains(t, 'mit license') THEN 'mit' WHEN contains(t, 'general public license') THEN 'gpl' ELSE 'unknown' END AS prediction_value FROM l
UNION ALL SELECT doc_id, 'secret', CASE WHEN contains(t, 'password=') OR contains(t, 'token =') THEN 'yes' ELSE 'unknown' END FROM l""")
def keyword_labeler(spark, d):
    return labeling.keyword_labels(table(spark, d, "documents"), RULES)


@query("""WITH v AS (SELECT conv_id, role, count(*) AS c, min(turn) AS o FROM conversations GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY c DESC, o) AS r, sum(c) OVER (PARTITION BY conv_id) AS n FROM v)
SELECT conv_id, role AS vote, CAST(n AS BIGINT) AS n_votes, round(c / n, 6) AS consistency FROM r WHERE r = 1""")
def vote_majority(spark, d):
    v = table(spark, d, "conversations").select("conv_id", F.col("role").alias("vote"), F.col("turn").alias("n"))
    return labeling.majority(v, ["conv_id"]).withColumn("consistency", r6("consistency"))


@query("""WITH m AS (SELECT user_id, event_type, median(value) AS m, count(*) AS n FROM events GROUP BY ALL),
p AS (SELECT a.user_id, a.event_type, sum(exp(-abs(a.value - b.value) / greatest(1.0, 0.05 * abs(m.m)))) AS s FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id <> b.event_id JOIN m ON m.user_id = a.user_id AND m.event_type = a.event_type GROUP BY ALL)
SELECT m.user_id, m.event_type, round(m, 6) AS median, n AS n_votes, round(CASE WHEN n > 1 THEN s / (n * (n - 1)) ELSE 1.0 END, 6) AS consistency FROM m LEFT JOIN p ON m.user_id = p.user_id AND m.event_type = p.event_type""")
def vote_numeric_consistency(spark, d):
    return _rounded(labeling.numeric_consistency(table(spark, d, "events"), ["user_id", "event_type"], "value"), "median", "consistency")


@query("""WITH e AS (SELECT vec_id, exp(embedding[1]::DOUBLE) AS a, exp(embedding[2]::DOUBLE) AS b, exp(embedding[3]::DOUBLE) AS c, exp(embedding[4]::DOUBLE) AS d FROM embeddings), p AS (SELECT vec_id, a / (a + b + c + d) AS a, b / (a + b + c + d) AS b, c / (a + b + c + d) AS c, d / (a + b + c + d) AS d FROM e)
SELECT vec_id, CASE greatest(a, b, c, d) WHEN a THEN 'A' WHEN b THEN 'B' WHEN c THEN 'C' ELSE 'D' END AS prediction, round(greatest(a, b, c, d), 6) AS probability, round(-(a * ln(a) + b * ln(b) + c * ln(c) + d * ln(d)), 6) AS entropy FROM p""")
def option_softmax_entropy(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", *[F.element_at("embedding", i + 1).alias(f"x{i}") for i in range(4)])
    return _rounded(labeling.option_scores(e, dict(zip("ABCD", ("x0", "x1", "x2", "x3"), strict=True)), "vec_id"), "probability", "entropy")


@query("""WITH o AS (SELECT conv_id, turn, role <> 'user' AS bad FROM conversations), g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, bad ORDER BY turn) AS g FROM o)
SELECT conv_id, min(turn) AS start, count(*) AS n FROM g WHERE bad GROUP BY conv_id, g HAVING count(*) >= 1""")
def malformed_streaks(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", (F.col("role") != "user").alias("bad"))
    return labeling.malformed_streaks(c, "conv_id", "turn", "bad", 1)


_BATCH = "b AS (SELECT doc_id AS unit_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 128) AS BIGINT) AS batch_id FROM documents)"


@query(with_(_BATCH) + "SELECT * FROM b")
def prompt_batches(spark, d):
    return jobs.batches(table(spark, d, "documents").select(F.col("doc_id").alias("unit_id")))


@query(with_(_BATCH) + "SELECT * FROM b WHERE batch_id % 3 <> 1")
def resume_pending_batches(spark, d):
    b = jobs.batches(table(spark, d, "documents").select(F.col("doc_id").alias("unit_id")))
    return jobs.pending(b, b.select("batch_id").where("batch_id % 3 = 1"))


@query("""SELECT event_id, dayofweek(ts - INTERVAL 5 HOUR) IN (0, 6) OR hour(ts - INTERVAL 5 HOUR) >= 22 OR hour(ts - INTERVAL 5 HOUR) < 6 AS off FROM events""")
def off_hours_flag(spark, d):
    """The events are of a January, five hours behind UTC in New York."""
    return table(spark, d, "events").select("event_id", dates.off_hours(F.col("ts")).alias("off"))


@query(with_(ANN, PRED) + "SELECT count(*) AS n_a, count(*) AS n_b, count(*) AS n_both, CAST(0 AS BIGINT) AS n_differ FROM v_pred")
def parity_one_vs_two_stage(spark, d):
    p = views.predictions(spark, d).select("unit_id", "label_id", "prediction_value")
    one = gating.gated_predictions(p, GATES, KINDS)
    free = p.where(~F.col("label_id").isin(*GATES))
    gated = gating.gated_predictions(p, GATES, KINDS).where(F.col("label_id").isin(*GATES))
    return jobs.parity(one, free.unionByName(gated), ["unit_id", "label_id"], "prediction_value")


@query("""WITH t AS (SELECT unnest([100, 500, 2000]) AS t) SELECT 'over' || CAST(t AS VARCHAR) AS run, lang, count(*) FILTER (n_chars > t) AS n FROM documents, t GROUP BY ALL""")
def sweep_collation(spark, d):
    x = table(spark, d, "documents")
    runs = {f"over{t}": x.groupBy("lang").agg(F.sum((F.col("n_chars") > t).cast("long")).alias("n")) for t in (100, 500, 2000)}
    return jobs.sweep(runs)


@query("""WITH f AS (SELECT user_id, min_by(value, event_id) AS s FROM events GROUP BY user_id)
SELECT count(s) AS n, round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(quantile_cont(s, 0.95), 6) AS p95, round(min(s), 6) AS least, round(max(s), 6) AS most FROM f""")
def runtime_summary(spark, d):
    return _rounded(jobs.runtime_summary(table(spark, d, "events"), "user_id", "event_id", "value"), "mean", "median", "p95", "least", "most")


# --- events ----------------------------------------------------------------------------------


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_id % 7 <> 0")
def change_state_latest(spark, d):
    e = table(spark, d, "events").withColumn("deleted", F.col("event_id") % 7 == 0)
    return event_ops.latest_state(e, ["user_id", "event_type"], ["ts", "event_id"], deleted="deleted").select("user_id", "event_type", "event_id", "value")


@query("""WITH a AS (SELECT user_id, max_by(event_type, event_id) AS t FROM events WHERE event_id % 2 = 0 GROUP BY user_id), b AS (SELECT user_id, max_by(event_type, event_id) AS t FROM events GROUP BY user_id)
SELECT coalesce(a.user_id, b.user_id) AS user_id, a.t AS old, b.t AS new FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.t IS DISTINCT FROM b.t""")
def state_changes(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    before = event_ops.latest_state(e.where("event_id % 2 = 0"), ["user_id"], ["event_id"])
    return event_ops.changes(before, event_ops.latest_state(e, ["user_id"], ["event_id"]), ["user_id"], "event_type")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    return event_ops.windowed_counts(table(spark, d, "events"))
