"""Queries of retrieval for units and of active learning over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import active, labeling, prompts, rag, selection
from . import views
from .catalogue import GATES, KINDS, query, r6
from .views import ANN, NOTES, PRED, table, with_

#: Documents with an embedding as chunks of five: 20 units; the query vectors are axes.
_CH = """ch AS (SELECT 'u' || CAST(doc_id // 5 % 20 AS VARCHAR) AS unit_id, doc_id // 5 AS doc_id, doc_id % 5 AS chunk_id, text, embedding::DOUBLE[] AS e FROM documents JOIN embeddings ON doc_id = vec_id)"""


def _axis(i: int) -> list[float]:
    return [float(k == i) for k in range(64)]


ASKED = [rag.LabelQuery("gain", [_axis(0), _axis(1)], ["that THIS", "the ndst"], "that this ndst"), rag.LabelQuery("ort", [_axis(2)], ["und der stand"], "und der"), rag.LabelQuery("none", [_axis(3)], [], "")]


def _chunks(spark, d):
    # the vectors are hashed, so that texts needn't be sorted
    t = table(spark, d, "documents").join(table(spark, d, "embeddings").hint("shuffle_hash"), F.col("doc_id") == F.col("vec_id"))
    own = F.floor(F.col("doc_id") / 5).cast("long")
    return t.select(F.concat(F.lit("u"), (own % 20).cast("string")).alias("unit_id"), own.alias("doc_id"), (F.col("doc_id") % 5).cast("long").alias("chunk_id"), "text", "embedding")


_SEM = """, nrm AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) + 1e-12 AS z FROM ch),
sc AS (SELECT unit_id, 'gain' AS label_id, doc_id, chunk_id, greatest(e[1], e[2]) / z AS score FROM nrm UNION ALL SELECT unit_id, 'ort', doc_id, chunk_id, e[3] / z FROM nrm UNION ALL SELECT unit_id, 'none', doc_id, chunk_id, e[4] / z FROM nrm),
sem AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, label_id ORDER BY round(score, 9) DESC, doc_id, chunk_id) AS r FROM sc) WHERE r <= 50)
"""
_KW = """, tk AS (SELECT unit_id, doc_id, chunk_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9_+\\-/]+'), lambda x: x NOT IN ('the', 'a', 'an', 'and', 'or', 'of', 'to', 'in', 'for', 'with')) AS k FROM ch),
q(label_id, term) AS (VALUES ('gain', 'that'), ('gain', 'this'), ('gain', 'ndst'), ('ort', 'und'), ('ort', 'der'), ('ort', 'stand')),
st AS (SELECT count(*) AS n FROM tk), av AS (SELECT unit_id, avg(len(k)) AS avgdl FROM tk GROUP BY unit_id),
tf AS (SELECT unit_id, doc_id, chunk_id, len(k) AS dl, term, len(list_filter(k, lambda x: x = term)) AS tf FROM tk, (SELECT DISTINCT term FROM q)),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
bm AS (SELECT tf.unit_id, label_id, doc_id, chunk_id, sum((ln((n - df + 0.5) / (df + 0.5)) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN tf ON q.term = tf.term JOIN df ON df.term = q.term JOIN av ON av.unit_id = tf.unit_id, st GROUP BY ALL),
kw AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, label_id ORDER BY round(score, 9) DESC, doc_id, chunk_id) AS r FROM bm WHERE score > 0) WHERE r <= 20)
"""


@query(with_(_CH) + _SEM + "SELECT unit_id, label_id, doc_id, chunk_id, round(score, 5) AS score FROM sem")
def unit_semantic_rank(spark, d):
    return rag.unit_semantic(_chunks(spark, d), ASKED, 15).withColumn("score", F.round("score", 5))


@query(with_(_CH) + _KW + "SELECT unit_id, label_id, doc_id, chunk_id, round(score, 6) AS score FROM kw")
def unit_keyword_rank(spark, d):
    return rag.unit_keyword(_chunks(spark, d), ASKED).withColumn("score", r6("score"))


# k = 5: a pool of 15, of which round(4.5) = 4 by keywords
_RET = (
    _SEM
    + _KW
    + """, b AS (SELECT *, 0 AS c FROM sem UNION ALL SELECT *, 1 FROM kw), r AS (SELECT *, row_number() OVER (PARTITION BY unit_id, label_id, c ORDER BY score DESC, doc_id, chunk_id) AS r FROM b),
o AS (SELECT unit_id, label_id, doc_id, chunk_id, max(CASE WHEN r <= CASE WHEN c = 0 THEN 11 ELSE 4 END THEN 1 ELSE 0 END) AS f, max(score) AS score FROM r GROUP BY ALL),
pl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, label_id ORDER BY f DESC, score DESC, doc_id, chunk_id) AS n FROM o) WHERE n <= 15),
qq(label_id, ws) AS (VALUES ('gain', ['that', 'this', 'ndst']), ('ort', ['und', 'der']), ('none', [])),
ce AS (SELECT pl.*, ch.text, coalesce(len(list_filter(ws, lambda w: list_contains(regexp_extract_all(lower(ch.text), '[a-z0-9_+\\-/]+'), w))) / nullif(len(ws), 0), 0)::DOUBLE AS ce FROM pl JOIN ch ON pl.unit_id = ch.unit_id AND pl.doc_id = ch.doc_id AND pl.chunk_id = ch.chunk_id JOIN qq ON qq.label_id = pl.label_id),
ret AS (SELECT unit_id, label_id, doc_id, chunk_id, text, ce, row_number() OVER (PARTITION BY unit_id, label_id ORDER BY round(ce, 9) DESC, round(score, 9) DESC, doc_id, chunk_id) AS rank FROM ce)
"""
)


@query(with_(_CH) + _RET + "SELECT unit_id, label_id, doc_id, chunk_id, rank, round(ce, 6) AS score, 'pool' AS source, sha256(text) AS hash FROM ret WHERE rank <= 5")
def retrieve_for_units(spark, d):
    """End to end: both channels, a pool of three times five, lexical rerank."""
    got = rag.retrieve(_chunks(spark, d), ASKED, 5)
    return got.select("unit_id", "label_id", "doc_id", "chunk_id", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"), "source", F.sha2("text", 256).alias("hash"))


@query(with_(_CH) + """, one AS (SELECT * FROM ch WHERE chunk_id = doc_id % 5 AND doc_id < 40), z AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) + 1e-12 AS z FROM one),
s AS (SELECT a.doc_id AS seed, c.unit_id, a.label_id, CASE WHEN TRUE THEN list_cosine_similarity(a.e, c.e) END AS s, c.doc_id, c.chunk_id FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS label_id FROM one) a, ch c),
k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(s, 9) DESC, 'c#' || CAST(doc_id AS VARCHAR) || '#' || CAST(chunk_id AS VARCHAR)) AS r FROM s),
u AS (SELECT unit_id, label_id, greatest(0.0, max(s)) AS s FROM k WHERE r <= 30 AND NOT (unit_id IN ('u1', 'u2') AND label_id = 'odd') GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY round(s, 9) DESC, unit_id) AS rank FROM u)
SELECT unit_id, label_id, rank, round(coalesce((s - min(s) OVER (PARTITION BY label_id)) / nullif(max(s) OVER (PARTITION BY label_id) - min(s) OVER (PARTITION BY label_id), 0), 0), 4) AS score FROM t WHERE rank <= 12""")
def expand_to_similar_units(spark, d):
    """Units near to seed snippets in all units, without pairs that were seen, the twelve best of each label."""
    c = _chunks(spark, d)
    seeds = c.where("chunk_id = doc_id % 5 and doc_id < 40").select(F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("label_id"), "embedding")
    seen = spark.createDataFrame([("u1", "odd"), ("u2", "odd"), ("u1", "other")], "unit_id string, label_id string")
    got = rag.expand(c, seeds, seen, 30, 12)
    return got.select("unit_id", "label_id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@query(with_(_CH) + _SEM + ", t AS (SELECT unit_id, label_id, score, row_number() OVER (PARTITION BY unit_id, label_id ORDER BY score DESC) AS r FROM sem) SELECT unit_id, label_id, round(avg(score), 5) AS score FROM t WHERE r <= 3 GROUP BY ALL")
def top_m_scores(spark, d):
    return rag.top_m_scores(rag.unit_semantic(_chunks(spark, d), ASKED, 15), 3).withColumn("score", F.round("score", 5))


@query(with_(_CH) + _SEM + "SELECT unit_id, label_id, round(greatest(0.0, max(score)), 5) AS score FROM sem GROUP BY ALL")
def best_unit_scores(spark, d):
    return rag.best_of_units(rag.unit_semantic(_chunks(spark, d), ASKED, 15)).withColumn("score", F.round("score", 5))


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'm' || CAST(doc_id // 30 AS VARCHAR) ELSE 'u' || CAST(doc_id AS VARCHAR) END AS unit_id, min(doc_id) AS doc_id, sha256(left(min_by(text, doc_id), 12000)) AS hash FROM documents GROUP BY 1 HAVING count(*) = 1")
def whole_document_context(spark, d):
    """Every third document shares its unit with others."""
    t = table(spark, d, "documents")
    shared = F.concat(F.lit("m"), F.floor(F.col("doc_id") / 30).cast("string"))
    units = t.select(F.when(F.col("doc_id") % 3 == 0, shared).otherwise(F.concat(F.lit("u"), "doc_id")).alias("unit_id"), "doc_id")
    return rag.whole_documents(units.union(units), t).select("unit_id", "doc_id", F.sha2("text", 256).alias("hash"))


@query(with_(NOTES) + "SELECT doc_id, strftime(date_note, '%Y-%m-%d') AS date, notetype AS note_type, 'patient_icn: ' || patient_icn || CASE WHEN n % 2 = 0 THEN '; odd: ' || CAST(n AS VARCHAR) ELSE '' END AS other_meta FROM v_notes")
def chunk_metadata_header(spark, d):
    v = views.notes(spark, d).withColumn("odd", F.when(F.col("n") % 2 == 0, F.col("n").cast("string")).otherwise(" "))
    return v.select("doc_id", rag.chunk_metadata(v, other=["patient_icn", "odd"]).alias("m")).select("doc_id", "m.*")


@query(with_(_CH) + _RET + ", p AS (SELECT *, row_number() OVER (PARTITION BY unit_id, label_id ORDER BY lpad(CAST(doc_id * 7 % 30 AS VARCHAR), 2, '0'), rank) AS place FROM ret WHERE rank <= 5) SELECT unit_id, label_id, doc_id, chunk_id, place FROM p")
def snippets_in_date_order(spark, d):
    from pyspark.sql import Window

    got = rag.retrieve(_chunks(spark, d), ASKED, 5).withColumn("date", F.lpad((F.col("doc_id") * 7 % 30).cast("string"), 2, "0"))
    return got.select("unit_id", "label_id", "doc_id", "chunk_id", F.row_number().over(Window.partitionBy("unit_id", "label_id").orderBy(*rag.snippet_order("chronological"))).cast("long").alias("place"))


@query()
def retrieve_diverse(spark, d):
    """MMR over the pool; tests hold it against a plain loop."""
    return rag.retrieve(_chunks(spark, d), ASKED, 5, mmr=0.7).drop("text")


@query(with_(_CH) + _RET + """, f AS (SELECT label_id, unit_id, rank, '{"doc_id":' || doc_id || ',"chunk_id":' || chunk_id || ',"n":' || length(text) || '}' AS j FROM ret WHERE rank <= 2) SELECT unit_id, count(*) AS n, sha256(string_agg(label_id || j, ',' ORDER BY label_id, rank)) AS hash FROM f GROUP BY unit_id""")
def assisted_review_snippets(spark, d):
    """The two best snippets of each label; the JSON is read again for the comparison."""
    got = rag.assisted(rag.retrieve(_chunks(spark, d), ASKED, 5), 2)
    kind = "map<string,array<struct<doc_id:long,chunk_id:long,score:double,text:string>>>"
    labels = [q.label_id for q in sorted(ASKED, key=lambda q: q.label_id)]
    m = F.from_json("snippets", kind)
    said = lambda k: F.transform(m[k], lambda x: F.concat(F.lit(k), F.lit('{"doc_id":'), x.doc_id, F.lit(',"chunk_id":'), x.chunk_id, F.lit(',"n":'), F.char_length(x.text), F.lit("}")))
    every = F.flatten(F.array(*[said(k) for k in labels]))
    return got.select("unit_id", F.size(every).cast("long").alias("n"), F.sha2(F.array_join(every, ","), 256).alias("hash"))


# --- active learning -------------------------------------------------------------------------

_DIS = "dis AS (SELECT unit_id, label_id, (CAST(unit_id AS BIGINT) * 37 % 101) / 100.0::DOUBLE AS score, CAST(unit_id AS BIGINT) % 17 = 3 AS hard FROM v_ann WHERE label_id IN ('quality', 'toxic') GROUP BY unit_id, label_id)"


def _disagree(spark, d):
    a = views.annotations(spark, d).where(F.col("label_id").isin("quality", "toxic")).select("unit_id", "label_id").distinct()
    n = F.col("unit_id").cast("long")
    return a.withColumns({"score": (n * 37 % 101) / 100.0, "hard": n % 17 == 3})


@query(with_(ANN, _DIS) + """, q AS (SELECT unit_id, min(label_value) AS v FROM v_ann WHERE label_id = 'quality' AND reviewer_id = 'r1' GROUP BY unit_id),
o AS (SELECT dis.* FROM dis LEFT JOIN q ON dis.unit_id = q.unit_id WHERE (score >= 0.8 OR hard) AND (label_id = 'quality' OR coalesce(v = 'yes', false)))
SELECT unit_id, label_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY score DESC, unit_id) AS rank FROM o) WHERE rank <= 40""")
def high_entropy_seeds(spark, d):
    """toxic applies where the consensus of quality is yes."""
    dis = _disagree(spark, d)
    agreed = views.annotations(spark, d).where("label_id = 'quality' and reviewer_id = 'r1'").select("unit_id", "label_id", F.col("label_value").alias("value"))
    got = active.seeds(dis.select("unit_id", "label_id", "score"), dis, agreed, {"toxic": GATES["toxic"]}, KINDS, threshold=0.8, per_label=40)
    return got.withColumns({"score": r6("score"), "rank": F.col("rank").cast("long")})


@query(with_(ANN, _DIS) + ", p AS (SELECT * FROM dis WHERE score >= 0.9) SELECT unit_id, label_id, CASE CAST(unit_id AS BIGINT) % 3 WHEN 0 THEN 'a1|a2' WHEN 1 THEN 'b1|b2' ELSE '' END AS snippets FROM p")
def seed_snippets(spark, d):
    p = _disagree(spark, d).where("score >= 0.9")
    n = F.col("unit_id").cast("long") % 3
    two = lambda k: F.explode(F.array(F.struct(F.lit(2).alias("position"), F.lit(f"{k}2").alias("snippet")), F.struct(F.lit(1).alias("position"), F.lit(f"{k}1").alias("snippet"))))
    rat = p.where(n == 0).select("unit_id", "label_id", two("a").alias("x")).select("unit_id", "label_id", "x.*")
    ret = p.where(n < 2).select("unit_id", "label_id", two("b").alias("x")).select("unit_id", "label_id", "x.*")
    return active.seed_snippets(p, rat, ret).withColumn("snippets", F.array_join("snippets", "|"))


@query(with_("pool AS (SELECT CAST(doc_id AS VARCHAR) AS unit_id, CASE WHEN doc_id % 3 = 0 THEN (doc_id * 7919 % 1009) / 1009.0::DOUBLE END AS score FROM documents)") + "SELECT unit_id, position, round(score, 6) AS score FROM (SELECT unit_id, score, row_number() OVER (ORDER BY score DESC NULLS LAST, sha256('5|pool|' || unit_id), unit_id) AS position FROM pool) WHERE position <= 150")
def enriched_pool(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("unit_id"), F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") * 7919 % 1009) / 1009.0).alias("score"))
    low = t.where("score is not null").withColumn("score", F.col("score") - 0.5)
    got = active.enriched_pool(t, t.where("score is not null").union(low), 150, 5)
    return got.withColumns({"score": r6("score"), "position": F.col("position").cast("long")})


@query("""WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS unit_id, (doc_id * 31 % 97) / 97.0::DOUBLE AS a, (doc_id * 57 % 97) / 97.0::DOUBLE AS b FROM documents),
o AS (SELECT unit_id, CASE WHEN a >= b THEN 'pa' ELSE 'pb' END AS parent, greatest(a, b) AS score FROM s)
SELECT unit_id, parent, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY score DESC, unit_id) AS r FROM o) WHERE r <= 20""")
def probe_sample_by_parents(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("unit_id"), "doc_id")
    s = t.select("unit_id", F.lit("pa").alias("label_id"), (F.col("doc_id") * 31 % 97 / 97.0).alias("score")).union(t.select("unit_id", F.lit("pb"), F.col("doc_id") * 57 % 97 / 97.0))
    return active.probe_sample(t, s.union(s.where("label_id = 'pb'").withColumn("label_id", F.lit("other"))), ["pa", "pb"], 40, 3).withColumn("score", r6("score"))


@query("SELECT CAST(doc_id AS VARCHAR) AS unit_id FROM documents ORDER BY sha256('3|probe|' || CAST(doc_id AS VARCHAR)), 1 LIMIT 40")
def probe_sample_uniform(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("unit_id"))
    return active.probe_sample(t.union(t), None, [], 40, 3).select("unit_id")


@query("""WITH r AS (SELECT vec_id, label, embedding[2]::DOUBLE AS rel FROM embeddings), q AS (SELECT label, quantile_cont(rel, 0.9) AS a, quantile_cont(rel, 0.5) AS b, quantile_cont(rel, 0.1) AS c FROM r GROUP BY label),
n AS (SELECT r.label, count(*) FILTER (rel >= a) AS na, count(*) FILTER (rel >= b) AS nb FROM r JOIN q ON r.label = q.label GROUP BY r.label)
SELECT vec_id, r.label FROM r JOIN q ON r.label = q.label JOIN n ON n.label = r.label WHERE rel >= CASE WHEN na >= 25 THEN a WHEN nb >= 25 THEN b ELSE c END""")
def relaxed_quantile_gate(spark, d):
    """A label's strictest quantile of three that leaves 25 rows."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.element_at("embedding", 2).cast("double").alias("rel"))
    return selection.relaxed_gate(e, 25, (0.9, 0.5, 0.1)).select("vec_id", "label")


@query("""WITH s AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 4 < 2), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) + 1e-12 AS z FROM s),
w AS (SELECT vec_id // 4 % 10 AS u, label, e, CASE WHEN label % 2 = 0 THEN greatest(e[1], e[2]) / (z * (1 + 1e-12)) END AS w FROM n), t AS (SELECT u, label, max(w) AS m FROM w GROUP BY ALL),
x AS (SELECT w.u, w.label, w.w, exp(5 * (w.w - m)) AS g, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS dim FROM w JOIN t ON w.u = t.u AND w.label = t.label),
a AS (SELECT u, label, dim, CASE WHEN label % 2 = 0 THEN sum(g * x) / sum(g) ELSE max(x) END AS x FROM x GROUP BY u, label, dim),
c AS (SELECT u, dim, avg(x) AS x FROM (SELECT vec_id // 4 % 10 AS u, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings WHERE vec_id // 4 % 10 < 8) GROUP BY ALL),
p AS (SELECT u, l AS label FROM (SELECT unnest(range(10)) AS u), (SELECT unnest(range(12)) AS l))
SELECT CAST(p.u AS VARCHAR) AS unit_id, CAST(p.label AS VARCHAR) AS label_id, CASE WHEN a.u IS NOT NULL THEN CASE WHEN p.label % 2 = 0 THEN 'attention' ELSE 'max' END WHEN c.u IS NOT NULL THEN 'mean' END AS how, CAST(coalesce(a.dim, c.dim) AS INTEGER) AS dim, round(coalesce(a.x, c.x), 5) AS x
FROM p LEFT JOIN a ON a.u = p.u AND a.label = p.label LEFT JOIN c ON c.u = p.u AND a.u IS NULL WHERE a.u IS NOT NULL OR c.u IS NOT NULL""")
def label_pooled_vectors(spark, d):
    """Even labels have two prototypes, odd ones none; labels 10 and 11 no snippets; units without chunks are left to the test."""
    e = table(spark, d, "embeddings")
    u = (F.floor(F.col("vec_id") / 4) % 10).cast("string")
    snippets = e.where("vec_id % 4 < 2").select(u.alias("unit_id"), F.col("label").cast("string").alias("label_id"), "embedding")
    marks = spark.createDataFrame([(str(k), _axis(i)) for k in range(0, 12, 2) for i in (0, 1)], "label_id string, embedding array<double>")
    chunks = e.select(u.alias("unit_id"), "embedding").where("cast(unit_id as int) < 8")
    units = spark.range(10).select(F.col("id").cast("string").alias("unit_id"), F.explode(F.array(*[F.lit(str(k)) for k in range(12)])).alias("label_id"))
    got = active.label_pooled(snippets, marks, chunks, units)
    return got.where("how <> 'hash'").select("unit_id", "label_id", "how", F.posexplode("pooled").alias("dim", "x")).withColumn("x", F.round("x", 5))


_FIRST = "lf AS (SELECT CAST(doc_id AS VARCHAR) AS unit_id, row_number() OVER (ORDER BY sha256('9|pool|' || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) AS position, lang, source FROM documents)"


@query(with_(_FIRST) + """, h AS (SELECT unit_id, 'lang' AS label_id, 0 AS target, position, 30 AS q FROM lf WHERE lang IN ('de', 'fr') UNION ALL SELECT unit_id, 'source', 1, position, 4 FROM lf WHERE source = 'src3'),
t AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY position) AS rank FROM h)
SELECT unit_id, label_id, CAST(target AS INTEGER) AS target, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= q""")
def label_first_rounds(spark, d):
    """Units are labelled 100 and then 50 at a time until both targets are filled, which the first 2,000 of the pool do."""
    t = table(spark, d, "documents")
    ids = t.select(F.col("doc_id").cast("string").alias("unit_id"))
    pool = active.enriched_pool(ids, spark.createDataFrame([], "unit_id string, score double"), 2000, 9)

    def label(units):
        own = t.join(units, F.col("doc_id") == F.col("unit_id").cast("long")).select("unit_id", F.explode(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")).alias("label_id", "prediction_value"))
        return own

    got = active.label_first_rounds(pool, label, [{"label_id": "lang", "values": ["DE", "fr"], "quota": 30}, {"label_id": "source", "values": ["src3"], "quota": 4}], 34, 9, start=100, step=50)
    return got.where("reason = 'label_first'").select("unit_id", "label_id", "target", "rank")


@query()
def disagreement_bucket(spark, d):
    """Quotas, k-center and top-ups; tests hold it against a plain loop."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("unit_id"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("label_id"), "embedding")
    return active.disagreement_bucket(e, 40, ["l0", "l1"])


@query()
def diversity_bucket(spark, d):
    """Relevance gate, equal quotas, MMR and k-center over whole groups; tests hold the parts against plain loops."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("unit_id"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("label_id"), "embedding")
    anchors = spark.createDataFrame([(f"l{k}", _axis(k)) for k in range(10)], "label_id string, embedding array<double>")
    return active.diversity_bucket(e, anchors, 20, 4)


@query(with_(ANN, PRED) + "SELECT unit_id, label_id, 'r' || CAST(CAST(unit_id AS BIGINT) % 3 AS VARCHAR) AS reason FROM (SELECT *, CASE CAST(unit_id AS BIGINT) % 3 WHEN 0 THEN 'llm_uncertain' WHEN 1 THEN 'diversity' ELSE 'disagreement' END AS s FROM v_pred) WHERE NOT (CAST(unit_id AS BIGINT) % 2 = 0 AND s <> 'disagreement')")
def selection_exclusion(spark, d):
    n = F.col("unit_id").cast("long")
    p = views.predictions(spark, d).withColumn("selection_reason", F.when(n % 3 == 0, "llm_uncertain").when(n % 3 == 1, "diversity").otherwise("disagreement"))
    out = active.without_units(p, p.where(n % 2 == 0))
    return out.select("unit_id", "label_id", F.concat(F.lit("r"), (n % 3).cast("string")).alias("reason"))


# --- prompts ---------------------------------------------------------------------------------


@query(with_(NOTES) + """SELECT doc_id AS unit_id, l AS label_id, sha256('Label: ' || l || chr(10) || 'Rules: rule of ' || l || chr(10) || 'Options: ' || CASE l WHEN 'quality' THEN 'yes, no' ELSE 'a, b' END || chr(10) || chr(10) || 'Notes:' || chr(10) || left(text, 400)) AS hash FROM v_notes, (SELECT unnest(['quality', 'kind']) AS l)""")
def single_label_prompts(spark, d):
    n = views.notes(spark, d).select(F.col("doc_id").alias("unit_id"), F.substring("text", 1, 400).alias("context"))
    labels = {k: {"rules": f"rule of {k}", "type": t, "options": o} for k, t, o in (("quality", "binary", []), ("kind", "categorical", ["a", "b"]))}
    return prompts.single_prompts(n, labels).select("unit_id", "label_id", F.sha2("prompt", 256).alias("hash"))


@query(with_(NOTES) + """SELECT doc_id AS unit_id, sha256('kind: rule of kind Options: a, b' || chr(10) || 'quality: rule of quality Options: yes, no' || chr(10) || chr(10) || 'Notes:' || chr(10) || left(text, 400)) AS hash FROM v_notes""")
def multi_label_prompts(spark, d):
    n = views.notes(spark, d).select(F.col("doc_id").alias("unit_id"), F.substring("text", 1, 400).alias("context"))
    labels = {k: {"rules": f"rule of {k}", "type": t, "options": o} for k, t, o in (("quality", "binary", []), ("kind", "categorical", ["a", "b"]))}
    return prompts.multi_prompts(n, labels, max_chars=16_000).select("unit_id", F.sha2("prompt", 256).alias("hash"))


@query("SELECT CAST(event_id AS VARCHAR) AS unit_id, k AS label_id, CASE WHEN k = 'kind' THEN event_type ELSE CAST(user_id AS VARCHAR) END AS prediction_value FROM events, (SELECT unnest(['kind', 'who']) AS k) WHERE event_id % 4 <> 3")
def multi_label_answers(spark, d):
    """JSON answers: clean, in a code fence, with single quotes and cut off; every fourth has none."""
    e = table(spark, d, "events")
    body = F.concat(F.lit('{"kind": "'), "event_type", F.lit('", "who": '), "user_id")
    k = F.col("event_id") % 4
    said = F.when(k == 0, F.concat(body, F.lit("}"))).when(k == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit(",}\n```"))).when(k == 2, F.translate(body, '"', "'")).otherwise("I can't say")
    return prompts.split_answers(e.select(F.col("event_id").cast("string").alias("unit_id"), said.alias("answer")), ["kind", "who"])


@query(with_(ANN, PRED) + ", w AS (SELECT unit_id, min(prediction_value) FILTER (label_id = 'quality') AS q FROM v_pred GROUP BY unit_id) SELECT p.unit_id, label_id FROM v_pred p JOIN w ON p.unit_id = w.unit_id WHERE label_id = 'quality' OR (label_id = 'toxic' AND coalesce(q, '') = 'yes')")
def family_batch_rows(spark, d):
    """Precomputed prompts of roots and of children that apply; the others are left out."""
    p = views.predictions(spark, d)
    asked = p.where(F.col("label_id").isin("quality", "toxic")).select("unit_id", "label_id")
    return prompts.family_batch(asked, p, {"toxic": GATES["toxic"]}, KINDS)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS label_id, CASE WHEN n_nationkey % 3 = 0 THEN 'forced_choice' ELSE 'json' END AS route FROM nation")
def label_routes(spark, d):
    """Categorical and binary labels of 2 to 26 options are chosen by letter, all others answered in JSON."""
    names = [str(r.n_nationkey) for r in table(spark, d, "nation").select("n_nationkey").collect()]
    labels = {k: {"type": "binary"} if int(k) % 6 == 0 else {"type": "categorical", "options": list("abc")} if int(k) % 6 == 3 else {"type": "numeric"} if int(k) % 3 == 1 else {"type": "categorical", "options": [str(i) for i in range(27)]} for k in names}
    return spark.createDataFrame([(k, prompts.route_of(v)) for k, v in labels.items()], "label_id string, route string")


@query()
def self_consistency_plan(spark, d):
    """Votes with other snippets, orders and temperatures by keyed hashes; tests hold the ranges and the repeatability."""
    c = _chunks(spark, d).select("unit_id", F.lit("gain").alias("label_id"), "doc_id", "chunk_id", F.col("chunk_id").alias("rank"))
    return prompts.vote_snippets(c, 3, top=(2, 4), dropout=0.2, temperatures=(0.2, 0.9), seed=1)


@query(with_(NOTES) + "SELECT doc_id AS unit_id, 'quality' AS label_id, sha256(text) AS hash FROM v_notes")
def prompt_task_round_trip(spark, d):
    t = views.notes(spark, d).select(F.col("doc_id").alias("unit_id"), F.lit("quality").alias("label_id"), F.col("text").alias("prompt"), F.array(F.struct(F.lit("user").alias("role"), F.lit("x").alias("content"))).alias("messages"))
    return prompts.tasks_of(prompts.task_lines(t), t.schema).select("unit_id", "label_id", F.sha2("prompt", 256).alias("hash"))


@query(with_(ANN, "vt AS (SELECT unit_id, CAST(label_value_date - DATE '1970-01-01' AS DOUBLE) AS x FROM v_ann WHERE label_id = 'seen')") + "SELECT unit_id, strftime(DATE '1970-01-01' + CAST(floor(median(x)) AS INTEGER), '%Y-%m-%d') AS value, count(*) AS n_votes FROM vt GROUP BY unit_id")
def vote_date_median(spark, d):
    v = views.annotations(spark, d).where("label_id = 'seen'").select("unit_id", F.col("label_value_date").alias("vote"))
    return labeling.date_consistency(v, ["unit_id"]).select("unit_id", F.date_format("median", "yyyy-MM-dd").alias("value"), "n_votes")
