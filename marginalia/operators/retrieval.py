"""Hybrid retrieval over document chunks: keyword and vector ranks, pools, context windows, MMR and approximate search."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.staging import kept

K1, B = 1.5, 0.75


def split_text(s: str, size: int = 1500, overlap: int = 150, separators: Sequence[str] = ("\n\n", "\n", " ", "")) -> list[tuple[int, str]]:
    """(start, chunk): chunks of at most `size` characters that end at the coarsest separator that fits, each starting `overlap` characters or fewer before the last one's end."""
    out, at, n = [], 0, len(s)
    while at < n:
        end = min(n, at + size)
        if end < n:
            for sep in separators:
                cut = s.rfind(sep, at + 1, end) if sep else end
                if cut > at:
                    end = cut + len(sep) if cut + len(sep) <= at + size else cut
                    break
        out.append((at, s[at:end]))
        if end >= n:
            break
        back = max(end - overlap, at + 1)
        space = s.find(" ", back, end)
        at = space + 1 if 0 <= space < end - 1 else max(back, at + 1)
    return out or [(0, "")]


def recursive_chunks(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", size: int = 1500, overlap: int = 150) -> DataFrame:
    """(doc, chunk_id, start, text): split_text of whole texts; an empty or null one has one empty chunk."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches):
        for p in batches:
            rows = [(d, i, a, c) for d, s in zip(p["d"], p["t"], strict=True) for i, (a, c) in enumerate(split_text(s, size, overlap))]
            yield pd.DataFrame(rows, columns=["d", "chunk_id", "start", "text"])

    got = docs.select(F.col(doc).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInPandas(run, f"d {kind}, chunk_id long, start long, text string")
    return got.withColumnRenamed("d", doc)


def fixed_chunks(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", size: int = 500) -> DataFrame:
    """(doc, chunk_id, text): whole texts in pieces of `size` characters; an empty one has one empty piece."""
    t = F.coalesce(F.col(text), F.lit(""))
    ids = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.char_length(t) / size).cast("int") - 1))
    e = docs.select(F.col(doc), t.alias("_t"), F.explode(ids).alias("chunk_id"))
    return e.select(doc, "chunk_id", F.substring("_t", F.col("chunk_id") * size + 1, F.lit(size)).alias("text"))


def idf_table(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, df, idf) with idf = ln((N - df + 0.5) / (df + 0.5)) + 1. Terms are combined before the shuffle."""
    n = F.lit(docs.count())
    df = docs.select(F.explode(F.array_distinct(T.search_tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", "df", (F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5)) + 1).alias("idf"))


def term_counts(docs: DataFrame, terms: Sequence[str], keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, dl, t0, t1, ...): each text's number of tokens and how often it has each term, as a written table. Texts are tokenised once: the generator keeps filters and later columns from repeating it."""
    base = docs.select(*keys, F.coalesce(T.search_tokens(F.col(text)), F.array().cast("array<string>")).alias("_k"))
    row = F.struct(F.size("_k").alias("dl"), *[(F.size("_k") - F.size(F.array_remove("_k", t))).alias(f"t{i}") for i, t in enumerate(terms)])
    return kept(base.select(*keys, F.inline(F.array(row))), "counts")


def bm25_scores(docs: DataFrame, queries: dict[str, Sequence[str]], *, doc: str | Sequence[str] = "doc_id", text: str = "text", unit: str | None = None) -> DataFrame:
    """(query, doc, score) of scores above 0. Query tokens count as often as they stand.

    Only the queries' terms leave the scan, as counts per document; document frequencies come from one pass over these, and so does the
    mean length: of all, or with `unit`, a column of docs that then is in the result, of each unit's documents.
    """
    terms = sorted({t for q in queries.values() for t in q})
    keys = [*([unit] if unit else []), *([doc] if isinstance(doc, str) else doc)]
    if not terms:
        return docs.select(F.lit("").alias("query"), *keys, F.lit(0.0).alias("score")).where(F.lit(False))
    counts = term_counts(docs, terms, keys, text)
    stats = counts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"t{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(terms))]).first()  # one row
    both = counts.where(" or ".join(f"t{i} > 0" for i in range(len(terms))) or "false")
    mean = F.lit(stats["avgdl"] or 1.0)
    if unit:
        both = both.join(counts.groupBy(unit).agg(F.avg("dl").alias("_mean")), unit)
        mean = F.col("_mean")
    part = []
    for i in range(len(terms)):
        d = stats[f"d{i}"] or 0
        idf = F.lit(math.log((stats["n"] - d + 0.5) / (d + 0.5)) + 1)
        x = F.col(f"t{i}").cast("double")
        part.append(idf * x * (K1 + 1) / (x + K1 * (1 - B + B * F.col("dl") / mean)))
    scored = []
    for name, q in sorted(queries.items()):
        total = F.lit(0.0)
        for t in q:
            total = total + part[terms.index(t)]
        scored.append(F.struct(F.lit(name).alias("query"), total.alias("score")))
    return both.select(*keys, F.explode(F.array(*scored)).alias("x")).select("x.query", *keys, "x.score").where("score > 0")


def top_k(scores: DataFrame, k: int, by: Sequence[str], score: str, ties: Sequence[str]) -> DataFrame:
    """The k best rows of each group with their rank; ranks are limited before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _side(dim: int) -> int:
    """Rows on a side of a block of vectors: 16 MB in double precision at most."""
    return max(256, min(16_384, (1 << 21) // max(1, dim)))


def _hashed(seed: int, parts: int):
    return F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(parts)).cast("int")


def _matrix(col) -> np.ndarray:
    """A list column as a matrix in double precision, nulls as NaN; lists of different lengths raise."""
    c = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if len(np.unique(np.diff(c.offsets.to_numpy()))) > 1:
        raise ValueError("vectors of different lengths")
    return np.array(c.flatten().to_numpy(zero_copy_only=False), float).reshape(len(c), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


def _k_best(x: np.ndarray, y: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, cells) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity): the k rows of y most similar to each row of x, by nine digits and then by ids, of those it meets in cells (rows of x, rows of y). Rows of one id don't meet.

    Products are made in tiles; only what reaches the k-th best so far is looked at, so memory is that of a tile.
    """
    best, at, least = np.zeros((len(x), k)), np.full((len(x), k), -1), np.full(len(x), -np.inf)
    spare = k + int(np.unique(ids, return_counts=True)[1].max())  # as many hold the k best, whatever of them is the row itself
    for rows, cols in cells:
        for c in range(0, len(cols), 4096):
            col = cols[c : c + 4096]
            w = y[col].T
            for r in range(0, len(rows), 512):
                row = rows[r : r + 512]
                s = x[row] @ w
                floor = least[row]
                new = np.flatnonzero(np.isneginf(floor))
                if len(new) and len(col) > spare:
                    floor[new] = np.partition(s[new], len(col) - spare, axis=1)[:, len(col) - spare]
                i, j = np.divmod(np.flatnonzero(~(s < (floor - 1e-9)[:, None])), len(col))
                ok = own[row[i]] != ids[col[j]]
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                hi, hj = np.nonzero(at[row] >= 0)
                v = np.concatenate([best[row[hi], hj], s[i, j]])
                i, j = np.concatenate([hi, i]), np.concatenate([at[row[hi], hj], col[j]])
                o = np.lexsort((j, ids[j], -np.round(v, 9), i))
                i, j, v = i[o], j[o], v[o]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                top = place < k
                at[row[i[top]], place[top]], best[row[i[top]], place[top]] = j[top], v[top]
                full = at[row, -1] >= 0
                least[row[full]] = np.round(best[row[full], -1], 9)
    i, p = np.nonzero(at >= 0)
    return i, at[i, p], best[i, p]


def _met(rows: DataFrame, k: int, cells, parts: int, kind: str, key: str) -> DataFrame:
    """(query, key, similarity, rank) of rows (id, v, is_q, b, p): in each of the `parts` blocks (b, p), queries meet the others by cells(table, is_q, others), the pairs of row numbers among the two."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        q = t.column("is_q").to_numpy()
        names = t.column("id").to_numpy()
        if q.all() or not q.any():
            i = j = s = np.empty(0, np.int64)
        else:
            x, code = _unit(_matrix(t.column("v"))), np.unique(names, return_inverse=True)[1]
            i, j, s = _k_best(x[q], x[~q], code[q], code[~q], k, cells(t, q, ~q))
        i, j = np.flatnonzero(q)[i], np.flatnonzero(~q)[j]
        return pa.Table.from_arrays([t.column("id").take(pa.array(i)), t.column("id").take(pa.array(j)), pa.array(s, pa.float64())], names=["query", "id", "similarity"])

    got = rows.repartition(min(2000, 2 * parts), "b", "p").groupBy("b", "p").applyInArrow(run, f"query {kind}, id {kind}, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), "id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("id", key)


def cosine_top_k(vectors: DataFrame, is_query, k: int, *, key: str = "vec_id", vector: str = "embedding", block: int = 16_384) -> DataFrame:
    """(query, key, similarity, rank): the k rows most similar to each query row, itself left out; ties by key.

    Query rows and all rows are cut in blocks of `block` rows at most, of fewer where vectors are long or rows are few; each block of
    queries meets each block of rows in one task, as products of tiles of which only what reaches its k best is kept. Null
    vectors, those of no length and those of a null key match nothing.
    """
    ok = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    n = ok.agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("m"), F.max(F.size("v")).alias("d")).first()
    side = min(block, _side(n.d or 1))
    nb, nv = max(1, -(-(n.m or 0) // side)), max(1, -(-n.n // min(side, max(2048, -(-n.n // 24)))))
    a = ok.where("q").select("id", "v", F.lit(True).alias("is_q"), _hashed(1, nb).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("p"))
    b = ok.select("id", "v", F.lit(False).alias("is_q"), F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("b"), _hashed(2, nv).alias("p"))
    every = lambda t, q, r: [(np.arange(int(q.sum())), np.arange(int(r.sum())))]
    return _met(a.unionByName(b), k, every, nb * nv, vectors.schema[key].dataType.simpleString(), key)


def rrf(ranks: Sequence[DataFrame], by: str, item: str, c: int = 60) -> DataFrame:
    """(by, item, score): reciprocal rank fusion of ranked lists (by, item, rank from 1)."""
    both = ranks[0].select(by, item, "rank")
    for r in ranks[1:]:
        both = both.union(r.select(by, item, "rank"))
    return both.groupBy(by, item).agg(F.sum(1.0 / (c + F.col("rank"))).alias("score"))


def candidate_pool(semantic: DataFrame, keyword: DataFrame, k: int, *, by: str = "query", item: str = "doc_id", factor: float = 3.0, oversample: float = 1.0, keyword_fraction: float = 0.3) -> DataFrame:
    """(by, item, score, rank): ceil(k factor oversample) items of two channels, each with its share by its own best scores, filled from what is left of both.

    Scores of the channels are compared as they are. Inputs: (by, item, score).
    """
    target = math.ceil(k * factor * oversample)
    n_key = int(round(target * keyword_fraction))
    best = lambda d: d.groupBy(by, item).agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(by, "channel").orderBy(F.desc("score"), item))
    both = best(semantic).withColumn("channel", F.lit(0)).union(best(keyword).withColumn("channel", F.lit(1))).withColumn("r", rank)
    first = (F.col("r") <= F.when(F.col("channel") == 0, target - n_key).otherwise(n_key)).cast("int")
    one = both.withColumn("first", first).groupBy(by, item).agg(F.max("first").alias("first"), F.max("score").alias("score"))
    w = Window.partitionBy(by).orderBy(F.desc("first"), F.desc("score"), item)
    kept = one.withColumn("n", F.row_number().over(w)).where(F.col("n") <= target)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), item))).select(by, item, "score", "rank")


def neighbours(hits: DataFrame, chunks: DataFrame, hops: int = 1) -> DataFrame:
    """(doc_id, chunk_id, is_hit): hits and the chunks up to `hops` before and after them. The hits' neighbours are listed and joined by equality."""
    near = hits.select("doc_id", F.explode(F.sequence(F.col("chunk_id") - hops, F.col("chunk_id") + hops)).alias("chunk_id"), F.col("chunk_id").alias("_of"))
    per = near.groupBy("doc_id", "chunk_id").agg(F.max(F.col("_of") == F.col("chunk_id")).alias("is_hit"))
    return chunks.select("doc_id", "chunk_id").join(per, ["doc_id", "chunk_id"])


def within_budget(rows: DataFrame, by: str, order: Sequence[str], length, budget: int) -> DataFrame:
    """Rows of each group in order, up to the first that doesn't fit the budget any more, with `used`."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(length).over(w)).where(F.col("used") <= budget)


def context(rows: DataFrame, by: str, order: Sequence[str], budget: int = 12_000) -> DataFrame:
    """(by, context): the fragments [doc_id=, chunk_id=] text that fit, by a blank line. Where rows have date and note_type, fragments name those that aren't null."""
    more = [F.coalesce(F.concat(F.lit(f", {name}="), F.col(c).cast("string")), F.lit("")) for c, name in (("date", "date"), ("note_type", "type")) if c in rows.columns]
    frag = F.concat(F.lit("[doc_id="), F.col("doc_id").cast("string"), F.lit(", chunk_id="), F.col("chunk_id").cast("string"), *more, F.lit("] "), F.col("text"))
    fit = within_budget(rows.withColumn("_f", frag), by, order, F.char_length("_f"), budget)
    return fit.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("used", "_f"))), lambda x: x["_f"]), "\n\n").alias("context"), F.count("*").alias("n_chunks"))


def family_context(rows: DataFrame, by: str, cap: int, budget: int) -> DataFrame:
    """rows (by, doc_id, chunk_id, score, text) each chunk once with its best score, the `cap` best that fit the budget."""
    one = rows.groupBy(by, "doc_id", "chunk_id").agg(F.max("score").alias("score"), F.min("text").alias("text"))
    w = Window.partitionBy(by).orderBy(F.desc("score"), "doc_id", "chunk_id")
    return within_budget(one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap), by, ["rank"], F.char_length("text"), budget)


def mmr(rows: DataFrame, by: str, k: int, *, item: str = "vec_id", score: str = "score", vector: str = "embedding", trade: float = 0.7) -> DataFrame:
    """(by, item, rank): maximal marginal relevance over bounded pools; ties by item."""
    ki, kb = rows.schema[item].dataType.simpleString(), rows.schema[by].dataType.simpleString()

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values([score, item], ascending=[False, True])
        x = np.stack(p[vector]).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-12
        rel, chosen = p[score].to_numpy(float), []
        far = np.full(len(p), -np.inf)
        left = np.ones(len(p), bool)
        while len(chosen) < min(k, len(p)):
            value = trade * rel - (1 - trade) * np.where(np.isfinite(far), far, 0)
            j = int(np.argmax(np.where(left, value, -np.inf)))
            chosen.append(j)
            left[j] = False
            far = np.maximum(far, x @ x[j])
        return pd.DataFrame({by: p[by].iloc[0], item: p[item].to_numpy()[chosen], "rank": range(1, len(chosen) + 1)})

    return rows.select(by, item, score, vector).groupBy(by).applyInPandas(run, f"{by} {kb}, {item} {ki}, rank long")


def ivf_search(vectors: DataFrame, is_query, k: int, *, key: str = "vec_id", vector: str = "embedding", lists: int | None = None, probes: int | None = None, recall: float = 0.95, trials: int = 200, sample: int = 10_000, seed: int = 3) -> DataFrame:
    """(query, key, similarity, rank): approximate cosine_top_k through an inverted file; ties by key.

    Centroids, the square root of the rows as many but 16 to 2048, come from MLlib k-means on a bounded sample of unit vectors; every row is filed under its nearest
    centroid, and a query meets the rows of the `probes` nearest lists. Lists are packed in parts of bounded size, larger ones split;
    a query goes once to each part that holds a list of its own, and each list is one matrix product there.
    Without probes, they are as many as the recall needs, measured on all rows: the exact neighbours of
    `trials` queries (all queries, if they are fewer) are looked up in the lists.
    Vectors of length 0, and those with null or non-finite components, match nothing.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = F.transform(vector, lambda x: x.cast("double"))
    fine = (F.size(vector) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    ok = vectors.where(F.col(key).isNotNull() & fine).select(F.col(key).alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    norm = F.sqrt(F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x))
    some = ok.orderBy(F.xxhash64(F.lit(seed), "id")).limit(sample).select(F.transform("v", lambda x: x.cast("double")).alias("w")).withColumn("n", norm).where("n > 0")
    some = some.select(array_to_vector(F.transform("w", lambda x: x / F.col("n"))).alias("features"))
    n = some.count()
    if not n:
        return ok.select(F.col("id").alias("query"), F.col("id").alias(key), F.lit(0.0).alias("similarity"), F.lit(1).alias("rank")).limit(0)
    lists = lists or min(2048, max(16, math.isqrt(ok.count())))
    centers = np.stack(KMeans(k=min(lists, n), seed=seed, maxIter=15).fit(some).clusterCenters())  # lists x dimensions
    half = (centers**2).sum(1) / 2

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        x = _unit(np.stack(v).astype(float))
        return pd.Series(np.concatenate([np.argmax(x[i : i + 1024] @ centers.T - half, 1) for i in range(0, len(x), 1024)]).astype(np.int32))

    filed = kept(ok.withColumn("list", nearest("v")), "filed")
    counts = np.zeros(len(centers), np.int64)
    for r in filed.groupBy("list").count().collect():  # a row for each list
        counts[r["list"]] = r["count"]
    if probes is None:
        probes = _probes(filed, centers, k, recall, trials, seed)
    side = _side(centers.shape[1])
    first, split, n_parts = _packed(counts, min(side, max(2048, -(-int(counts.sum()) // 24))))
    nb = max(1, -(-filed.where("q").count() // side))

    @F.pandas_udf("int")
    def part(at: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series((first[at] + h % split[at]).astype(np.int32))

    def ask(batches):
        for t in batches:
            if not t.num_rows:
                continue
            x = _unit(_matrix(t.column("v")))
            near = np.concatenate([np.argsort(half - x[i : i + 1024] @ centers.T, 1, kind="stable")[:, :probes] for i in range(0, len(x), 1024)])
            q, at = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
            times = split[at]
            p = np.repeat(first[at], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            q, at = np.repeat(q, times), np.repeat(at, times)
            o = np.lexsort((at, p, q))
            q, at, p = q[o], at[o], p[o]
            cut = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (p[1:] != p[:-1])])
            own = pa.array(q[cut])
            each = pa.ListArray.from_arrays(pa.array(np.r_[cut, len(q)], pa.int32()), pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([t.column("id").take(own), t.column("v").take(own), pa.array(p[cut], pa.int32()), each], names=["id", "v", "p", "lists"])

    kinds = {c: filed.schema[c].dataType.simpleString() for c in ("id", "v")}
    a = filed.where("q").select("id", "v").mapInArrow(ask, f"id {kinds['id']}, v {kinds['v']}, p int, lists array<int>")
    a = a.select("id", "v", F.lit(True).alias("is_q"), _hashed(1, nb).alias("b"), "p", "lists")
    b = filed.select("id", "v", F.lit(False).alias("is_q"), F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("b"), part("list", F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(1 << 40))).alias("p"), F.array("list").alias("lists"))

    def cells(t: pa.Table, q: np.ndarray, r: np.ndarray):
        of = t.column("lists").combine_chunks()
        size, at = np.diff(of.offsets.to_numpy()), of.flatten().to_numpy()
        asked = q[np.repeat(np.arange(t.num_rows), size)]
        x, mine = np.repeat(np.cumsum(q) - 1, size)[asked], at[asked]
        own = at[~asked]
        x, y = x[np.argsort(mine, kind="stable")], np.argsort(own, kind="stable")
        mine, own = np.sort(mine), own[y]
        for c in np.intersect1d(mine, own):
            yield x[slice(*np.searchsorted(mine, [c, c + 1]))], y[slice(*np.searchsorted(own, [c, c + 1]))]

    return _met(a.unionByName(b), k, cells, n_parts * nb, kinds["id"], key)


def _packed(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first, split, n): n parts of about `most` rows that lists of these counts are packed in; each list's first part, and over how many that follow it its rows are spread."""
    first, split = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // most))
    n, room = 0, 0
    for i, c in enumerate(counts.tolist()):
        if split[i] > 1 or c > room:
            first[i] = n
            n += int(split[i])
            room = most - c if split[i] == 1 else 0
        else:
            first[i] = max(0, n - 1)
            room -= c
    return first, split, max(1, n)


def _probes(filed: DataFrame, centers: np.ndarray, k: int, recall: float, trials: int, seed: int) -> int:
    """How many nearest lists hold the given share of the exact neighbours of a hash sample of the queries."""
    asked = {r.id: r.v for r in filed.where("q").orderBy(F.xxhash64(F.lit(seed + 1), "id")).limit(trials).select("id", "v").collect()}
    if not asked:
        return 1
    exact = cosine_top_k(filed.select("id", "v", "q"), F.col("q") & F.col("id").isin(list(asked)), k, key="id", vector="v").select("query", "id")  # trials * k rows
    found = exact.join(filed.select("id", "list"), "id").groupBy("query", "list").count().collect()
    if not found:
        return 1
    x = _unit(np.array([asked[r.query] for r in found], float))
    s = x @ centers.T - (centers**2).sum(1) / 2
    at = (s > s[np.arange(len(s)), [r["list"] for r in found]][:, None]).sum(1) + 1
    order = np.argsort(at, kind="stable")
    seen = np.cumsum(np.array([r["count"] for r in found])[order])
    return int(at[order][np.searchsorted(seen, recall * seen[-1])])


def hashed_embedding(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", size: int = 256) -> DataFrame:
    """(doc, embedding): a unit vector of hashed token counts, the embedder used where none is plugged in."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches):
        import zlib

        for p in batches:
            x = np.zeros((len(p), size), np.float32)
            for i, toks in enumerate(p["k"]):
                for t in toks if toks is not None else ():
                    x[i, zlib.crc32(t.encode()) % size] += 1
            x /= np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))
            yield pd.DataFrame({"d": p["d"], "embedding": list(x)})

    return docs.select(F.col(doc).alias("d"), T.search_tokens(F.col(text)).alias("k")).mapInPandas(run, f"d {kind}, embedding array<float>").withColumnRenamed("d", doc)
