"""Embedding near-dedup: all pairs on byte copies, or collision counting over sorted one-dimensional projections."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocked_units, find_forest, forget, links_within, offsets_of, scan_units, written

#: Outermost lines of a vector that may be looked at, and sample vectors of a calibration.
MOST, TRIALS = 48, 2000
#: Rows of a block of the comparison of all pairs, the fewest and the most, and of a tile in it. Each row goes to a unit for each block.
BLOCKS, TILE = (8192, 250_000), 512


@lru_cache(4)
def directions(dim: int, count: int) -> np.ndarray:
    r = np.random.default_rng(19950901).standard_normal((dim, count)).astype(np.float32)
    return r / np.linalg.norm(r, axis=0) * np.float32(math.sqrt(dim))


def window(min_cos: float) -> float:
    """Half a query-centred window: twice the standard deviation of the projected difference of two unit vectors at min_cos."""
    return 2 * math.sqrt(2 - 2 * min_cos)


@dataclass(frozen=True)
class Plan:
    """Pairs meet on `joint` lines, of the `top` on which each vector lies furthest out, and pass with `passing` collisions."""

    top: int
    joint: int
    passing: int


def partners(x: np.ndarray, min_cos: float, seed: int = 5) -> np.ndarray:
    """For each unit vector another at exactly that cosine, in a random direction."""
    u = np.random.default_rng(seed).standard_normal(x.shape)
    if x.shape[1] > 1:
        u -= (u * x).sum(1, keepdims=True) * x
        u /= np.maximum(1e-12, np.linalg.norm(u, axis=1, keepdims=True))
    y = min_cos * x + math.sqrt(max(0.0, 1 - min_cos**2)) * u
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def outermost(v: np.ndarray, mean: np.ndarray, count: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The lines where v - mean lies furthest out, furthest first, and its places on them."""
    p = (v - mean).astype(np.float32) @ directions(v.shape[1], count)
    far = np.argpartition(-p, top - 1, axis=1)[:, :top] if top < count else np.broadcast_to(np.arange(count), p.shape)
    at = np.take_along_axis(p, far, 1)
    order = np.argsort(-at, axis=1, kind="stable")
    return np.take_along_axis(far, order, 1), np.take_along_axis(at, order, 1)


def calibrate(sample: np.ndarray, mean: np.ndarray, rows: int, min_cos: float, recall: float, count: int) -> Plan | None:
    """The cheapest plan that finds pairs at min_cos with the recall, measured on sample vectors and made-up partners at exactly min_cos; None if none does.

    Meeting on g lines and passing with g + 1 collisions, a vector sends C(top, g) rows, and of all pairs
    some C(top, g)^2 / C(count, g) meet by chance: with more rows, more joint lines pay.
    """
    most = min(MOST, count)
    x = np.repeat(sample, -(-TRIALS // len(sample)), axis=0)[:TRIALS]
    (a, p), (b, q) = outermost(x, mean, count, most), outermost(partners(x, min_cos), mean, count, most)
    same = (a[:, :, None] == b[:, None, :]) & (np.abs(p[:, :, None] - q[:, None, :]) <= window(min_cos))
    best, least = None, math.inf
    for joint in (1, 2, 3):
        for top in range(joint + 1, most + 1):
            if (same[:, :top, :top].sum((1, 2)) >= joint + 1).mean() >= recall:
                sent = math.comb(top, joint)
                cost = rows * sent * 20 + rows * rows / 2 * sent * sent / math.comb(count, joint)
                if cost < least:
                    best, least = Plan(top, joint, joint + 1), cost
                break
    return best


def packed(v: np.ndarray) -> np.ndarray:
    """Rows of bytes: the scale and the rounding error's norm as floats, then the unit vector as whole numbers up to 127 of that scale."""
    scale = (127 / np.abs(v).max(1)).astype(np.float32)
    x = v * scale[:, None].astype(np.float64)
    small = np.clip(np.round(x), -127, 127)
    off = (np.linalg.norm(x - small, axis=1) * 1.00001).astype(np.float32)
    return np.concatenate([scale[:, None].view(np.uint8), off[:, None].view(np.uint8), small.astype(np.int8).view(np.uint8)], axis=1)


def may_link(c: np.ndarray, i: np.ndarray, j: np.ndarray, min_cos: float) -> np.ndarray:
    """Whether rows i and j of packed vectors can have the cosine: by Cauchy-Schwarz, rounding takes no more from their product than the errors' norms allow."""
    head = c[:, :8].copy().view(np.float32).astype(np.float64)
    x = c[:, 8:].view(np.int8)
    s, e = head[:, 0], head[:, 1]
    dot = np.einsum("ij,ij->i", x[i].astype(np.float32), x[j].astype(np.float32))
    slack = x.shape[1] * 1.2e-7 + 1e-6  # of sums in single precision
    return dot >= s[i] * s[j] * (min_cos - slack) - s[i] * e[j] - s[j] * e[i] - e[i] * e[j]


def collisions(lines: np.ndarray, places: np.ndarray, i: np.ndarray, j: np.ndarray, wide: float) -> np.ndarray:
    """On how many lines each pair collides: both lie there, and one in the window centred on the other."""
    n = np.zeros(len(i), np.int16)
    for k in range(lines.shape[1]):
        n += ((lines[i] == lines[j, k][:, None]) & (np.abs(places[i] - places[j, k][:, None]) <= wide)).any(1)
    return n


def _binary(body: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes."""
    cuts = np.arange(len(body) + 1, dtype=np.int32) * body.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(body), [None, pa.py_buffer(cuts), pa.py_buffer(body.tobytes())])


def _rows(dim: int, count: int, plan: Plan, mean: np.ndarray):
    """Rows for each set of `joint` of a vector's outermost lines: its key, the place on the first of them, and what counts and bounds a pair."""
    sets = np.array(list(combinations(range(plan.top), plan.joint)))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            x = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(node), dim)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for lo in range(0, len(node), 1000):
                v = x[lo : lo + 1000]
                lines, places = outermost(v, mean, count, plan.top)
                order = np.argsort(lines, axis=1)
                lines, places = np.take_along_axis(lines, order, 1), np.take_along_axis(places, order, 1)
                spot = np.zeros((len(v), len(sets)), np.int64)
                for g in range(plan.joint):
                    spot = spot * count + lines[:, sets[:, g]]
                body = np.concatenate([packed(v), np.ascontiguousarray(lines.astype(np.uint32)).view(np.uint8).reshape(len(v), -1), np.ascontiguousarray(places.astype(np.float32)).view(np.uint8).reshape(len(v), -1)], axis=1)
                copy = _binary(body)
                each = np.repeat(np.arange(len(v)), len(sets))
                yield pa.RecordBatch.from_arrays([pa.array(spot.ravel()), pa.array(node[lo : lo + 1000][each]), pa.array(places[:, sets[:, 0]].ravel()), copy.take(pa.array(each))], names=["spot", "node", "place", "copy"])

    return run


def window_pairs(unit: np.ndarray, place: np.ndarray, wide: float, room: int = 100_000):
    """Index pairs (i, j), i before j, of rows of one unit that are sorted by place and less than `wide` apart, in arrays of bounded size."""
    apart = 2 * float(np.abs(place).max(initial=0)) + 2 * wide + 1
    at = unit * apart + place
    end = np.searchsorted(at, at + wide, "right")
    n = end - np.arange(len(at)) - 1
    upto = np.concatenate([[0], np.cumsum(n)])
    for lo in range(0, int(upto[-1]), room):
        k = np.arange(lo, min(lo + room, int(upto[-1])))
        i = np.searchsorted(upto, k, "right") - 1
        yield i, i + 1 + k - upto[i]


def _candidates(dim: int, plan: Plan, min_cos: float):
    wide = window(min_cos)

    def run(t: pa.Table, unit: np.ndarray) -> pa.RecordBatch | None:
        node = t.column("node").to_numpy()
        side, one = t.column("side").to_numpy(), t.column("bi").to_numpy() == t.column("bj").to_numpy()
        body = np.frombuffer(b"".join(t.column("copy").to_pylist()), np.uint8).reshape(len(node), -1)
        x, rest = body[:, : dim + 8], np.ascontiguousarray(body[:, dim + 8 :])
        lines, places = rest[:, : 4 * plan.top].copy().view(np.uint32), rest[:, 4 * plan.top :].copy().view(np.float32)
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        for i, j in window_pairs(unit, t.column("place").to_numpy().astype(np.float64), wide):
            ok = (one[i] | (side[i] != side[j])) & (node[i] != node[j])
            i, j = i[ok], j[ok]
            for test in sorted(((dim, lambda i, j: may_link(x, i, j, min_cos)), (4 * plan.top**2, lambda i, j: collisions(lines, places, i, j, wide) >= plan.passing)), key=lambda c: c[0]):  # the cheaper first
                ok = test[1](i, j)
                i, j = i[ok], j[ok]
            if len(i):
                a, b = find_forest(np.concatenate([a, node[i]]), np.concatenate([b, node[j]]))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["src", "dst"]) if len(a) else None

    return run


def _copies(dim: int):
    """(node, copy): packed unit vectors."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, dim)
                yield pa.RecordBatch.from_arrays([batch.column(0), _binary(packed(x / np.linalg.norm(x, axis=1, keepdims=True)))], names=["node", "copy"])

    return run


def _near(min_cos: float):
    """A spanning forest of the pairs of a unit that may_link: all are compared, as products of tiles."""

    def run(t: pa.Table, unit: np.ndarray) -> pa.RecordBatch | None:
        node, side = t.column("node").to_numpy(), t.column("side").to_numpy()
        one = t.column("bi").to_numpy() == t.column("bj").to_numpy()
        off, data = offsets_of(t.column("copy").combine_chunks() if t.column("copy").num_chunks != 1 else t.column("copy").chunk(0))
        body = data[off[0] : off[-1]].reshape(t.num_rows, -1)
        head = body[:, :8].copy().view(np.float32)
        # with e as an error's norm over its scale, u.v >= min_cos - e_i - e_j - e_i e_j is u.v + (1 + e_i)(1 + e_j) >= min_cos + 1
        x = np.empty((t.num_rows, body.shape[1] - 7), np.float32)
        np.divide(body[:, 8:].view(np.int8), head[:, :1], out=x[:, :-1])
        x[:, -1] = 1 + head[:, 1].astype(np.float64) / head[:, 0]
        least = np.float32(min_cos + 1 - x.shape[1] * 2.4e-7 - 4e-6)  # less what single precision takes from sums
        product, hit = np.empty((TILE, TILE), np.float32), np.zeros((TILE, TILE), bool)
        a, b, held, n = np.empty(0, np.int64), np.empty(0, np.int64), [], 0
        cuts = np.flatnonzero(np.diff(unit, prepend=unit[0] - 1, append=unit[-1] + 1))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows = np.arange(lo, hi)
            left, right = (rows, rows) if one[lo] else (rows[side[lo:hi] == side[lo]], rows[side[lo:hi] != side[lo]])
            for p in range(0, len(left), TILE):
                v = x[left[p : p + TILE]]
                for q in range(p if one[lo] else 0, len(right), TILE):
                    w = x[right[q : q + TILE]]
                    if len(v) < TILE or len(w) < TILE:
                        hit[:] = False
                    part = np.matmul(v, w.T, out=product[: len(v), : len(w)])
                    np.greater_equal(part, least, out=hit[: len(v), : len(w)])
                    k = np.flatnonzero(hit.view(np.uint64))  # eight at a time, since few are hits
                    k = (8 * k[:, None] + np.arange(8)).ravel()
                    k = k[hit.ravel()[k]]
                    i, j = node[left[p + k // TILE]], node[right[q + k % TILE]]
                    ok = i != j
                    if ok.any():
                        held.append((i[ok], j[ok]))
                        n += len(held[-1][0])
                    if n > 200_000:
                        a, b = find_forest(np.concatenate([a, *[h[0] for h in held]]), np.concatenate([b, *[h[1] for h in held]]))
                        held, n = [], 0
        if held:
            a, b = find_forest(np.concatenate([a, *[h[0] for h in held]]), np.concatenate([b, *[h[1] for h in held]]))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["src", "dst"]) if len(a) else None

    return run


def near_edges(rows: DataFrame, dim: int, n: int, min_cos: float) -> DataFrame:
    """(src, dst): edges that connect all of the n rows (node, vec) with the cosine or more; every pair is compared."""
    least, most = BLOCKS
    block = min(most, max(least, -(-n // 8)))
    blocks = -(-n // block)
    units = blocked_units(rows.select("node", "vec").mapInArrow(_copies(dim), "node long, copy binary").withColumn("spot", F.lit(0)), ["spot"], "node", block, sizing=rows.select(F.lit(0).alias("spot")))
    return scan_units(units, ["spot"], _near(min_cos), "src long, dst long", tasks=max(1, 2 * blocks * (blocks + 1)))


def _mean(rows: DataFrame, dim: int) -> np.ndarray:
    """The mean of all unit vectors: sums of each task are added up before they come to the driver."""

    def run(batches):
        total = np.zeros(dim)
        n = 0
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, dim)
                total += (x / np.linalg.norm(x, axis=1, keepdims=True)).sum(0)
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(total), pa.array(np.full(dim, n))], names=["i", "s", "n"])

    got = rows.select("vec").mapInArrow(run, "i long, s double, n long").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("m")).collect()
    return np.array([r.m for r in sorted(got, key=lambda r: r.i)])


def _cosines(min_cos: float):
    def pairs(t: pa.Table, sides: np.ndarray | None):
        col = t.column("vec").combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = col.chunk(0)
        x = np.array(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(t.num_rows, -1)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        yield np.nonzero(np.triu(x @ x.T >= min_cos, 1))

    return pairs


def _counted(same: DataFrame, dim: int, n: int, min_cos: float, recall: float, projections: int) -> DataFrame | None:
    """(src, dst) by collision counting, calibrated on a sample for the recall; None if no plan has it."""
    mean = _mean(same, dim)
    sample = np.array([x.vec for x in same.orderBy(F.xxhash64(F.lit(23), "node"), "node").limit(min(TRIALS, 4_000_000 // dim + 1)).select("vec").collect()], np.float64)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    plan = calibrate(sample, mean, n, min_cos, recall, projections)
    if plan is None:
        return None
    rows = same.select("node", "vec").mapInArrow(_rows(dim, projections, plan, mean), "spot long, node long, place float, copy binary")
    spots = blocked_units(rows, ["spot"], "node", 4096)
    return scan_units(spots, ["spot"], _candidates(dim, plan, min_cos), "src long, dst long", order=["place"])


def embedding_dedup(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", min_cos: float = 0.95, recall: float | None = None, projections: int = 4096, block: int = 512) -> DataFrame:
    """(key, n_links, component_id, kept): near-duplicates by cosine in double precision.

    All pairs are compared, so no link is lost: first on byte copies of the vectors, in blocks, as products of tiles,
    by a bound that drops none that can reach min_cos. What passes forms parts, in which all pairs are verified in
    double precision. The comparisons take n^2/2 products for n vectors, in single precision.

    For a table too large for that, a caller may give a recall below 1 instead, at the price of some links; the rest of
    this paragraph is about that only. Each vector is projected on `projections` fixed random lines, less the mean of all vectors, without which
    vectors with a common part would crowd on the same lines. On a sorted line only its ends tell near
    vectors from far ones, so a vector counts only on the lines where it lies furthest out. Vectors collide on a line
    if both lie there and one is in the window centred on the other. A line's rows are sorted by place, windows are
    ranges of them, and pairs in a window whose collisions reach the passing count are candidates. How many lines count, on how many
    of them pairs have to meet and which count passes is calibrated on TRIALS pairs: vectors with the smallest
    hashes and partners at exactly min_cos; if no plan has the recall, all pairs are compared. Counting goes by rows that
    carry their vector's lines and places: no pair is sent anywhere to be counted, and a crowded line is split in
    blocks. A byte copy of the vectors drops most false candidates, none that can reach min_cos; what is left forms parts,
    in which all pairs are verified exactly.

    Equal vectors form one class first, of any size. n_links counts the other rows at min_cos or
    more, component_id is the smallest key that links reach, kept is key = component_id. Vectors
    that are null, empty, zero, or hold null or non-finite components link with nothing; nor does
    a row with a null key, which is kept with a null component. Vectors of different lengths are
    handled by length and never link. Rows that repeat a key with another vector are one point.
    Empty tables give no rows; other columns aren't read.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    base = vectors.select(F.col(key), F.when(fine, F.col(vector)).alias("_vec"))
    hashes = [F.xxhash64(F.lit(s), "_vec").alias(c) for s, c in ((3, "h1"), (4, "h2"))]
    real = base.where(F.col("_vec").isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), "_vec", *hashes)
    # the largest component first, so that neither tiny nor huge vectors lose their lengths' precision
    classes = real.groupBy("h1", "h2").agg(F.min("key").alias("node"), F.count("*").alias("weight"), F.first("_vec").alias("vec"))
    wide = F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))
    classes = written(classes.withColumn("_m", wide).withColumn("vec", F.transform("vec", lambda x: x.cast("double") / F.col("_m"))).drop("_m"), "vectors")
    out = None
    for r in classes.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).where("n > 1").orderBy("d").collect():  # a row for each length
        same = classes.where(F.size("vec") == r.d)
        edges = None
        if recall is not None:
            edges = _counted(same, r.d, r.n, min_cos, recall, projections)
        if edges is None:
            edges = near_edges(same, r.d, r.n, min_cos)
        edges = written(edges, "edges")
        linked = links_within(same.select("node", "weight", "vec"), edges, _cosines(min_cos), block)
        forget(edges)
        out = linked if out is None else out.union(linked)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "node long, n_links long, component long")
    per_class = classes.select("h1", "h2", "node", "weight").join(out, "node", "left")
    got = base.select(F.col(key), *hashes, F.col("_vec").isNotNull().alias("_ok")).join(per_class, ["h1", "h2"], "left")
    ok = F.col("_ok") & F.col(key).isNotNull()
    comp = F.when(ok, F.coalesce("component", "node")).otherwise(F.col(key).cast("long"))
    return got.select(key, F.when(ok, F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).otherwise(F.lit(0)).alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col(key), F.lit(True)).alias("kept"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
ok AS (
  SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM ok),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
cnt AS (SELECT a, count(*) AS c FROM links GROUP BY a)
SELECT vec_id, coalesce(cnt.c, 0) AS n_links, least(vec_id, coalesce(low.m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low.m, vec_id)) AS kept
FROM embeddings LEFT JOIN cnt ON cnt.a = vec_id LEFT JOIN low ON low.a = vec_id
"""
