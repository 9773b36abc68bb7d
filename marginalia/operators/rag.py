"""Retrieval for units and labels: a chunk index, unit-local ranks, pools, reranking, diversity, top-off, and discovery across units."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as T
from ..sources.staging import kept
from . import ingest, retrieval
from .config import config_hash

KEY = ["unit_id", "label_id"]
CHUNK = ["doc_id", "chunk_id"]


@dataclass
class LabelQuery:
    """What is searched for a label: vectors of its queries, keywords, and the text that a reranker compares with."""

    label_id: str
    vectors: Sequence[Sequence[float]] = ()
    keywords: Sequence[str] = ()
    text: str = ""
    terms: list[str] = field(init=False)

    def __post_init__(self):
        import re

        words = re.findall(r"[a-z0-9_+\-/]+", " ".join(self.keywords).lower())
        self.terms = [w for w in words if w not in T.STOP_WORDS]


def chunk_index(docs: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str, *, settings: Mapping | None = None, size: int = 1500, overlap: int = 150, rebuild: bool = False) -> DataFrame:
    """(doc_id, chunk_id, start, text, embedding) of docs (doc_id, hash, text), kept in the folder path/{fingerprint of documents and settings}.

    The same documents and settings are read from there; others, or rebuild, are cut and embedded anew. Units aren't part of
    it: they are joined when it is read (with_units), so one index serves single- and multi-document units. embed: (doc_id,
    text) frame to (doc_id, embedding).
    """
    spark = docs.sparkSession
    mark = ingest.corpus_fingerprint(docs.select("doc_id", "hash")).first().fingerprint
    at = f"{path}/{config_hash([mark, size, overlap, dict(settings or {})])[:32]}"
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    there = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files)
    if rebuild or not there:
        chunks = retrieval.recursive_chunks(docs, size=size, overlap=overlap)
        name = F.concat_ws("#", F.col("doc_id").cast("string"), "chunk_id")
        vectors = embed(chunks.select(name.alias("doc_id"), "text")).withColumnRenamed("doc_id", "_n")
        chunks.withColumn("_n", name).join(vectors, "_n").drop("_n").write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def with_units(index: DataFrame, unit_notes: DataFrame) -> DataFrame:
    """Chunks of the index with the units (unit_id, doc_id) that their documents belong to."""
    return index.join(unit_notes.select("unit_id", "doc_id").distinct(), "doc_id")


def chunk_metadata(rows: DataFrame, *, core: Sequence[str] = ("date_note", "notetype"), other: Sequence[str] = ()) -> Column:
    """struct(date, note_type, other_meta): what is said of a chunk above its text; other columns as name: value, without empty ones."""
    rest = [F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), F.trim(F.col(c).cast("string")))) for c in other]
    day, kind = core
    return F.struct(dates.normal_date(F.col(day).cast("string")).alias("date"), F.col(kind).alias("note_type"), F.concat_ws("; ", *rest).alias("other_meta"))


def snippet_order(order: str) -> list[Column]:
    """How a context's snippets follow one another: "relevance" (best first) or "chronological" (by date as text, then as ranked)."""
    if order == "chronological":
        return [F.coalesce(F.col("date").cast("string"), F.lit("")), F.col("rank")]
    return [F.col("rank")]


def unit_semantic(chunks: DataFrame, queries: Sequence[LabelQuery], need: int) -> DataFrame:
    """(unit_id, label_id, doc_id, chunk_id, score): each unit's max(need, 50) best chunks by their largest cosine with a label's query vectors. Queries are few and go to the chunks, which aren't moved but for the ranks."""
    names = [q.label_id for q in queries if len(q.vectors)]
    spark = chunks.sparkSession
    if not names:
        return spark.createDataFrame([], "unit_id string, label_id string, doc_id string, chunk_id long, score double").select(*[F.lit(None).cast(chunks.schema[c].dataType).alias(c) if c in chunks.columns else c for c in (*KEY, *CHUNK, "score")]).limit(0)
    mats = [np.array(q.vectors, float) for q in queries if len(q.vectors)]
    mats = [m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12) for m in mats]

    @F.pandas_udf("array<double>")
    def best(v: pd.Series) -> pd.Series:
        ok = v.notna().to_numpy()
        out = np.full((len(v), len(mats)), np.nan)
        if ok.any():
            x = np.stack(v[ok]).astype(float)
            x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-12
            out[ok] = np.stack([(x @ m.T).max(1) for m in mats], axis=1)
        return pd.Series(list(out))

    each = chunks.where(F.col("embedding").isNotNull()).select("unit_id", *CHUNK, F.posexplode(best("embedding")).alias("_i", "score"))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_i") + 1)
    w = Window.partitionBy(*KEY).orderBy(F.desc(F.round("score", 9)), *CHUNK)
    ranked = each.select("unit_id", label.alias("label_id"), *CHUNK, "score").withColumn("_r", F.row_number().over(w))
    return ranked.where(F.col("_r") <= max(need, 50)).drop("_r")


def unit_keyword(chunks: DataFrame, queries: Sequence[LabelQuery], top: int = 20) -> DataFrame:
    """(unit_id, label_id, doc_id, chunk_id, score): each unit's best chunks by BM25 with the unit's mean length and all chunks' document frequencies; a label without keywords has none."""
    asked = {q.label_id: q.terms for q in queries if q.terms}
    scores = retrieval.bm25_scores(chunks, asked, doc=CHUNK, unit="unit_id").withColumnRenamed("query", "label_id")
    w = Window.partitionBy(*KEY).orderBy(F.desc(F.round("score", 9)), *CHUNK)
    return scores.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).select(*KEY, *CHUNK, "score")


def lexical_overlap(query: str, texts: list[str]) -> list[float]:
    """The share of a query's distinct words that each text holds: the reranker used where none is plugged in."""
    import re

    want = {w for w in re.findall(r"[a-z0-9_+\-/]+", query.lower()) if w not in T.STOP_WORDS}
    return [len(want & set(re.findall(r"[a-z0-9_+\-/]+", t.lower()))) / len(want) if want else 0.0 for t in texts]


def rerank(pairs: DataFrame, queries: Mapping[str, Sequence[str]], score: Callable[[str, list[str]], list[float]] = lexical_overlap) -> DataFrame:
    """pairs (label_id, text, ...) with ce: the largest of score(query, texts) over a label's queries. Equal pairs are scored once, in Arrow batches."""
    one = pairs.select("label_id", "text").distinct()

    def run(batches):
        for p in batches:
            for label, own in p.groupby("label_id", sort=False):
                texts = own["text"].fillna("").tolist()
                got = [score(q, texts) for q in queries.get(label, ()) if q]
                yield pd.DataFrame({"label_id": label, "text": own["text"], "ce": np.max(got, axis=0) if got else np.zeros(len(texts))})

    scored = one.mapInPandas(run, "label_id string, text string, ce double")
    return pairs.join(scored, (pairs.label_id == scored.label_id) & pairs.text.eqNullSafe(scored.text)).drop(scored.label_id, scored.text)


def retrieve(chunks: DataFrame, queries: Sequence[LabelQuery], k: int, *, min_k: int = 0, factor: float = 3.0, oversample: float = 1.0, keyword_fraction: float = 0.3, keyword_topk: int = 20, hops: int = 1, mmr: float | None = None, score: Callable[[str, list[str]], list[float]] = lexical_overlap) -> DataFrame:
    """(unit_id, label_id, rank, doc_id, chunk_id, text, score, source): the k chunks of each unit for each label.

    chunks: unit_id, doc_id, chunk_id, text, embedding. Ranks by vectors and by keywords form a pool; one of fewer
    than max(min_k, k) chunks is padded with the neighbours of its chunks (source neighbor, score 0 in the
    pool); the pool is scored again (rerank) and ordered by that, or with mmr (0 to 1) chosen for relevance and
    diversity; what is chosen is topped off to min_k from the rest of the pool, and cut to k. Ties: by the pool's score, document and chunk.

    A chunk without an embedding is found by keywords only. Units without any hit have no rows. All work is
    per unit: the largest group is a pool, k factor oversample chunks and their neighbours. Chunks are written once, since
    all steps read them and making them may move all texts; after that only the pools' texts and vectors are moved.
    """
    chunks = kept(chunks.select("unit_id", *CHUNK, "text", "embedding"), "chunks")
    target = int(np.ceil(k * factor * oversample))
    item = F.struct(*CHUNK).alias("item")
    key = F.struct(*KEY).alias("key")
    sem = unit_semantic(chunks, queries, target).select(key, item, "score")
    kw = unit_keyword(chunks, queries, keyword_topk).select(key, item, "score")
    pool = retrieval.candidate_pool(sem, kw, k, by="key", item="item", factor=factor, oversample=oversample, keyword_fraction=keyword_fraction)
    size = F.count("*").over(Window.partitionBy("key"))
    pool = kept(pool.withColumn("_n", size).select("key.*", "item.*", "score", "_n"), "pool")
    near = pool.where(F.col("_n") < max(min_k, k)).select(*KEY, "doc_id", F.explode(F.sequence(F.col("chunk_id") - hops, F.col("chunk_id") + hops)).alias("chunk_id")).distinct()
    near = near.join(pool.select(*KEY, *CHUNK), [*KEY, *CHUNK], "left_anti")
    texts = chunks.select("unit_id", *CHUNK, "text", *(["embedding"] if mmr is not None else []))
    both = pool.select(*KEY, *CHUNK, "score", F.lit("pool").alias("source")).unionByName(near.select(*KEY, *CHUNK, F.lit(0.0).alias("score"), F.lit("neighbor").alias("source")))
    both = kept(both, "pool")
    full = kept(both.join(texts.join(both.select("unit_id", *CHUNK).distinct(), ["unit_id", *CHUNK], "left_semi"), ["unit_id", *CHUNK]), "texts")
    full = rerank(full, {q.label_id: [q.text or " ".join(q.keywords)] for q in queries}, score)
    order = Window.partitionBy(*KEY).orderBy(F.desc(F.round("ce", 9)), F.desc(F.round("score", 9)), *CHUNK)
    full = full.withColumn("rank", F.row_number().over(order))
    if mmr is not None:
        full = kept(full, "ranked")
        key = F.concat_ws("\u0001", *KEY).alias("key")
        picks = retrieval.mmr(full.where(F.col("embedding").isNotNull()).select(key, F.col("rank").alias("item"), "ce", "embedding"), "key", k, item="item", score="ce", vector="embedding", trade=mmr)
        full = full.drop("embedding").withColumn("key", key).join(picks.toDF("key", "rank", "_m"), ["key", "rank"], "left")
        again = Window.partitionBy(*KEY).orderBy(F.asc_nulls_last("_m"), "rank")
        full = full.withColumn("rank", F.row_number().over(again))
    return full.where(F.col("rank") <= k).select(*KEY, "rank", *CHUNK, "text", F.col("ce").alias("score"), "source")


def diverse(scored: DataFrame, k: int, *, trade: float = 0.7) -> DataFrame:
    """(unit_id, label_id, doc_id, chunk_id, rank): chunks (.., score, embedding), each once with its best score, by maximal marginal relevance to the query."""
    best = scored.groupBy(*KEY, *CHUNK).agg(F.max("score").alias("score"), F.first("embedding").alias("embedding"))
    named = best.select(*KEY, *CHUNK, "score", "embedding", F.concat_ws("\u0001", *KEY).alias("key"), F.row_number().over(Window.partitionBy(*KEY).orderBy(*CHUNK)).alias("item"))
    got = retrieval.mmr(named.select("key", "item", "score", "embedding"), "key", k, item="item", trade=trade)
    return named.drop("score", "embedding").join(got, ["key", "item"]).select(*KEY, *CHUNK, "rank")


def whole_documents(units: DataFrame, docs: DataFrame, limit: int = 12_000) -> DataFrame:
    """(unit_id, doc_id, text): the documents of units that have one document, cut to `limit` characters."""
    one = units.groupBy("unit_id").agg(F.count_distinct("doc_id").alias("_n"), F.min("doc_id").alias("doc_id")).where("_n = 1")
    return one.join(docs.select("doc_id", "text"), "doc_id").select("unit_id", "doc_id", F.substring("text", 1, limit).alias("text"))


def best_of_units(snippets: DataFrame) -> DataFrame:
    """(unit_id, label_id, score): each unit's best snippet for a label, 0 at least."""
    return snippets.groupBy(*KEY).agg(F.greatest(F.lit(0.0), F.max("score")).alias("score"))


def top_m_scores(snippets: DataFrame, m: int, how: str = "mean") -> DataFrame:
    """(unit_id, label_id, score): the largest or the mean of each unit's m best scores."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("score"))
    top = snippets.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= m)
    return top.groupBy(*KEY).agg((F.max if how == "max" else F.avg)("score").alias("score"))


def expand(chunks: DataFrame, seeds: DataFrame, seen: DataFrame, k: int, top_units: int) -> DataFrame:
    """(unit_id, label_id, score, rank): units whose chunks are near to snippets of seeds (label_id, embedding), in all units.

    The k nearest chunks of each seed snippet are found among all (cosine_top_k), pairs that were seen are left
    out, a unit counts with its best chunk, 0 at least, and the top_units of each label stay, scaled from 0 to 1 within the label.
    """
    named = seeds.withColumn("_q", F.monotonically_increasing_id().cast("string"))
    labels = {r["_q"]: (r.label_id, r.embedding) for r in named.select("_q", "label_id", "embedding").collect()}  # seeds of a batch
    spark: SparkSession = chunks.sparkSession
    rows = chunks.select(F.concat(F.lit("c#"), F.col("doc_id").cast("string"), F.lit("#"), "chunk_id").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    asked = spark.createDataFrame([(f"q#{q}", [float(x) for x in v]) for q, (_, v) in labels.items()], "vec_id string, embedding array<double>")
    hits = retrieval.cosine_top_k(rows.union(asked), F.col("vec_id").startswith("q#"), k + len(labels)).where(~F.col("vec_id").startswith("q#"))
    hits = hits.withColumn("_o", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).where(F.col("_o") <= k)
    label = spark.createDataFrame([(f"q#{q}", x) for q, (x, _) in labels.items()], "query string, label_id string")
    found = hits.join(label, "query").join(chunks.select(F.concat(F.lit("c#"), F.col("doc_id").cast("string"), F.lit("#"), "chunk_id").alias("vec_id"), "unit_id"), "vec_id")
    new = found.select("unit_id", "label_id", F.col("similarity").alias("score")).join(seen.select(*KEY).distinct(), KEY, "left_anti")
    return top_units_of(best_of_units(new), top_units)


def top_units_of(scores: DataFrame, n: int) -> DataFrame:
    """(unit_id, label_id, score, rank): the n best units of each label, their scores scaled from 0 to 1 within it (0 where all are equal)."""
    w = Window.partitionBy("label_id").orderBy(F.desc(F.round("score", 9)), "unit_id")
    top = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    own = Window.partitionBy("label_id")
    lo, hi = F.min("score").over(own), F.max("score").over(own)
    return top.withColumn("score", F.coalesce(F.try_divide(F.col("score") - lo, hi - lo), F.lit(0.0))).select(*KEY, "score", "rank")


def assisted(snippets: DataFrame, n: int) -> DataFrame:
    """(unit_id, snippets): for reviewers, the n best snippets of each label as JSON: {label: [{doc_id, chunk_id, score, text}]}, labels in order."""
    w = Window.partitionBy(*KEY).orderBy("rank")
    top = snippets.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    per = top.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "doc_id", "chunk_id", F.round("score", 4).alias("score"), "text"))), lambda x: x.dropFields("_r")).alias("s"))
    return per.groupBy("unit_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label_id", "s"))))).alias("snippets"))
