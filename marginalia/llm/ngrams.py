"""N-gram Jaccard join: a MinHash LSH forest finds candidates, shingle sets verify them exactly."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, blocked_units, find_forest, forget, links_within, mix64, scan_units, span_hash, stream, unit_pairs, written
from .licenses import LOWER, WORD

DEPTH = 4  # labels of 16 bits in a tree's 64-bit path
_STEPS = [0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93, 0x94D049BB133111EB]


def words_of(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z lower-cased, start and end of each word, offsets of words by text)."""
    low = LOWER[data]
    word = np.zeros(len(data) + 1, bool)
    word[:-1] = WORD[low]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | first))
    end = np.flatnonzero(before & (~word | first))
    return low, start, end, np.searchsorted(start, off)


def shingles(off: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hashes of word n-grams, their offsets by text, two hashes of each text's words).

    A text of fewer than n words has one n-gram of all of them, one without words none.
    """
    low, start, end, at = words_of(off, data)
    w = mix64(span_hash(low, start, end, BASES[0]))
    size = np.diff(at)
    total = len(w)
    pad = np.concatenate([w, np.zeros(n, np.uint64)])
    left = np.repeat(at[1:], size) - np.arange(total)  # words from here to the text's end
    g = np.zeros(total, np.uint64)
    for k in range(n):
        g += np.where(left > k, pad[k : k + total], np.uint64(0)) * np.uint64(_STEPS[k % len(_STEPS)] + 2 * (k // len(_STEPS)))
    g = mix64(g, 7)
    keep = left >= n
    short = np.flatnonzero((size > 0) & (size < n))
    keep[at[short]] = True
    upto = np.concatenate([[0], np.cumsum(keep)])
    w2 = mix64(w, 3)
    classes = np.stack([mix64(span_hash(x, at[:-1], at[1:], base) + size.astype(np.uint64)) for x, base in ((w, BASES[0]), (w2, BASES[1]))])
    return g[keep], upto[at], classes


def multipliers(trees: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, 3 * trees, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhashes(g: np.ndarray, start: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """(functions, sets): mixed minima of each function over each set, which begins at start."""
    least = np.zeros((len(mult), len(start)), np.uint64)
    if len(start):
        for f in range(len(mult)):
            least[f] = np.minimum.reduceat(g * mult[f], start)
    return mix64(least.ravel()).reshape(least.shape)


def paths_of(mixed: np.ndarray, trees: int) -> np.ndarray:
    """(sets, trees): DEPTH labels of 16 bits in a tree's path, the first one highest."""
    out = np.zeros((mixed.shape[1], trees), np.uint64)
    for t in range(trees):
        for d in range(DEPTH):
            out[:, t] |= (mixed[(3 * t + d) % len(mixed)] & np.uint64(0xFFFF)) << np.uint64(16 * (DEPTH - 1 - d))
    return out


@lru_cache(16)
def prefix_depth(threshold: float, trees: int, recall: float, pairs: int = 2000, size: int = 120) -> int:
    """The matched prefix: from the whole path it is shortened label by label until pairs at the threshold share it in some tree with the recall.

    The recall is measured at each length, on pairs of random sets that are exactly as similar as the threshold (the next
    lower similarity that their size allows), through the same hash functions.
    """
    shared = int(2 * size * threshold / (1 + threshold))
    g = np.random.default_rng(77).integers(0, 2**63, (pairs, 2 * size - shared), dtype=np.uint64)
    both = np.stack([g[:, :size], g[:, size - shared :]], axis=1).reshape(-1)
    paths = paths_of(minhashes(both, np.arange(0, len(both), size), multipliers(trees)), trees)
    for k in range(DEPTH, 0, -1):
        cut = paths >> np.uint64(64 - 16 * k)
        if (cut[::2] == cut[1::2]).any(1).mean() >= recall:
            return k
    raise ValueError("more trees are needed for that recall")


def signatures(docs: DataFrame, key: str, text: str, n: int, trees: int) -> DataFrame:
    """(doc, c1, c2, size, s1, s2, paths): classes of equal words, n-gram counts, 128-bit sketches and the tree paths."""
    mult = multipliers(trees)

    def run(r: pa.RecordBatch, off: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        g, at, c = shingles(off, data, n)
        size = np.diff(at)
        has = np.flatnonzero(size)
        mixed = minhashes(g, at[has], mult)
        bits = ((mixed >> np.uint64(20)) & np.uint64(1))[:128]
        sketch = np.zeros((2, len(size)), np.uint64)
        for f in range(len(bits)):
            sketch[f // 64, has] |= bits[f] << np.uint64(f % 64)
        paths = np.zeros((len(size), trees), np.uint64)
        paths[has] = paths_of(mixed, trees)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * trees), pa.array(paths.view(np.int64).ravel()))
        return pa.RecordBatch.from_arrays([r.column(0), *[pa.array(x.view(np.int64)) for x in c], pa.array(size), *[pa.array(x.view(np.int64)) for x in sketch], lists], names=["doc", "c1", "c2", "size", "s1", "s2", "paths"])

    return stream(docs, [F.col(key).cast("long"), F.coalesce(F.col(text), F.lit("")).alias("_text")], run, "doc long, c1 long, c2 long, size long, s1 long, s2 long, paths array<long>", limit=1_000_000)


def _sketch_floor(bits: int, threshold: float) -> int:
    """Equal sketch bits that a pair at the threshold has but for 3.5 standard deviations."""
    p = (1 + threshold) / 2
    return int(bits * p - 3.5 * (bits * p * (1 - p)) ** 0.5)


def candidate_edges(classes: DataFrame, threshold: float, trees: int, recall: float, block: int) -> DataFrame:
    """(src, dst): a spanning forest of the pairs that share a path's prefix in some tree and whose sketches agree.

    Each tree is a sorted trie: its paths lie together by the prefix and are sorted by the labels below it. Pairs
    that share the whole path are tried first; with the prefix shortened, only pairs that those haven't connected yet.
    """
    depth = prefix_depth(threshold, trees, recall)
    rows = classes.where("size > 0").select("node", "s1", "s2", F.posexplode("paths").alias("tree", "path"))
    if depth < DEPTH:
        prefix = F.col("tree").cast("long") * F.lit(1 << 48) + F.shiftrightunsigned("path", 64 - 16 * depth)
        tail = F.col("path").bitwiseAND((1 << 64 - 16 * depth) - 1)
    else:
        prefix, tail = F.xxhash64("tree", "path"), F.lit(0).cast("long")
    units = blocked_units(rows.select(prefix.alias("prefix"), tail.alias("tail"), "node", "s1", "s2"), ["prefix"], "node", block)
    bits = min(128, 3 * trees)
    floor = _sketch_floor(bits, threshold)

    def run(t: pa.Table, unit: np.ndarray) -> pa.RecordBatch | None:
        node, tail = t.column("node").to_numpy(), t.column("tail").to_numpy()
        s1, s2 = t.column("s1").to_numpy().view(np.uint64), t.column("s2").to_numpy().view(np.uint64)
        side, one = t.column("side").to_numpy(), t.column("bi").to_numpy() == t.column("bj").to_numpy()
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        root = node.copy()
        whole = np.cumsum(np.append(False, (tail[1:] != tail[:-1]) | (unit[1:] != unit[:-1])))
        for group in (whole, unit):
            for i, j in unit_pairs(group, side, one):
                ok = root[i] != root[j]
                i, j = i[ok], j[ok]
                differ = np.bitwise_count(s1[i] ^ s1[j]).astype(np.int64) + np.bitwise_count(s2[i] ^ s2[j])
                ok = differ <= bits - floor
                if ok.any():
                    a, b = find_forest(np.concatenate([a, node[i[ok]]]), np.concatenate([b, node[j[ok]]]))
                    at = np.minimum(np.searchsorted(a, node), len(a) - 1)
                    root = np.where(a[at] == node, b[at], node)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["src", "dst"]) if len(a) else None

    return scan_units(units, ["prefix"], run, "src long, dst long", order=["tail"])


def overlaps(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The matrix of common n-grams of sets that lie end to end, by products of blocks of the n-grams that two or more have."""
    m = len(size)
    if m == 2:
        shared = len(np.intersect1d(flat[: size[0]], flat[size[0] :], assume_unique=True))
        return np.array([[0, shared], [shared, 0]])
    row = np.repeat(np.arange(m), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.diff(flat, prepend=flat[:1] - 1) != 0
    start = np.flatnonzero(new)
    many = np.diff(np.append(start, len(flat))) > 1  # a gram of one text is shared with none
    col_of = (np.cumsum(many) - 1)[np.cumsum(new) - 1]
    use = many[np.cumsum(new) - 1]
    row, col_of = row[use], col_of[use]
    both = np.zeros((m, m))
    step = 16384
    cuts = np.searchsorted(col_of, np.arange(0, (int(col_of[-1]) if len(col_of) else -1) + step + 1, step))
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        hit = np.zeros((m, step), np.float32)
        hit[row[lo:hi], col_of[lo:hi] - k * step] = 1
        both += hit @ hit.T
    return both


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices of the ranges start:start + size, end to end."""
    upto = np.cumsum(size)
    return np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(start - upto + size, size)


#: Sets that are compared as a matrix at once; fewer are always.
TILE = 512


def similar(flat: np.ndarray, at: np.ndarray, sides: np.ndarray | None, threshold: float, room: int = 500_000):
    """Index pairs (i, j) of all sets flat[at[i]:at[i + 1]] at the threshold or more, each once, in arrays of bounded size.

    Sets at the threshold have one of their rarest n-grams in common: each can lack no more than its size allows, so the
    rarest of their common ones lies among the first of both (prefix filtering). Pairs that meet on such an n-gram are
    counted one by one; sets of many copies that meet on many of them are compared as matrices, whichever costs less.
    With sides, pairs of one side may be left out.
    """
    size = np.diff(at)
    m = len(size)

    def reached(both: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return both >= threshold * (size[i] + size[j] - both) - 1e-9

    def tiles(rows: np.ndarray):
        cut = [rows[k : k + TILE] for k in range(0, len(rows), TILE)]
        for p in range(len(cut)):
            for q in range(p, len(cut)):
                use = cut[p] if p == q else np.concatenate([cut[p], cut[q]])
                if sides is not None and (sides[use] == sides[use[0]]).all():
                    continue
                both = overlaps(flat[spread(at[use], size[use])], size[use])
                link = np.triu(reached(both, use[:, None], use[None, :]), 1)
                if p != q:
                    link = link[: len(cut[p])]
                    link[:, : len(cut[p])] = False
                i, j = np.nonzero(link)
                yield use[i], use[j]

    if m <= TILE:
        yield from tiles(np.arange(m))
        return
    gid, df = np.unique(flat, return_inverse=True, return_counts=True)[1:]
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    row = np.repeat(np.arange(m), size)
    key = np.sort(row * len(df) + rank[gid])  # a set's n-grams, the rarest first
    gram, place = key % len(df), np.arange(len(key)) - at[row]
    first = np.flatnonzero((place <= size[row] - np.maximum(1, np.ceil(threshold * size[row] - 1e-6))) & (np.sort(df)[gram] > 1))
    first = first[np.argsort(gram[first], kind="stable")]
    g, r, place = gram[first], row[first], place[first]
    head = np.flatnonzero(np.diff(g, prepend=-1))
    count = np.diff(np.append(head, len(g)))
    group = np.repeat(np.arange(len(head)), count)
    dense = np.zeros(m, np.int64) - 1  # the lot of sets compared as matrices that a set belongs to
    hot = count > 32
    if hot.any():
        ends, lots = find_forest(r[hot[group]], r[head][group][hot[group]])
        lot = np.arange(m)
        lot[ends] = lots
        of = lot[r[head]]
        cost, members = np.bincount(of[hot], count[hot].astype(float) ** 2, m), np.bincount(lot, minlength=m).astype(float)
        chosen = cost > 4 * members**2
        hot &= chosen[of]
        dense = np.where(chosen[lot], lot, -1)
        for k in np.flatnonzero(chosen):
            yield from tiles(np.flatnonzero(lot == k))
    after = np.where(hot[group], 0, np.repeat(head + count, count) - np.arange(len(g)) - 1)
    upto = np.concatenate([[0], np.cumsum(after)])
    found = [np.empty(0, np.int64)]
    for lo in range(0, int(upto[-1]), room):
        k = np.arange(lo, min(lo + room, int(upto[-1])))
        x = np.searchsorted(upto, k, "right") - 1
        y = x + 1 + k - upto[x]
        i, j = r[x], r[y]
        # where this is their rarest common n-gram, as many follow as the shorter rest allows; else they met before
        ok = np.minimum(size[i] - place[x], size[j] - place[y]) * (1 + threshold) >= threshold * (size[i] + size[j]) - 1e-6
        ok &= (dense[i] < 0) | (dense[i] != dense[j])
        if sides is not None:
            ok &= sides[i] != sides[j]
        code = np.unique(i[ok] * m + j[ok])
        for part in np.array_split(code, max(1, int((size[code // m].sum()) // 4_000_000))):
            i, j = part // m, part % m
            i, j = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)
            want = np.repeat(j * len(df), size[i]) + gram[spread(at[i], size[i])]
            hit = key[np.minimum(np.searchsorted(key, want), len(key) - 1)] == want
            both = np.diff(np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], np.cumsum(size[i])])])
            found.append(part[reached(both, i, j)])
    found = np.unique(np.concatenate(found))
    for lo in range(0, len(found), room):
        yield found[lo : lo + room] // m, found[lo : lo + room] % m


def _jaccard(threshold: float):
    def pairs(t: pa.Table, sides: np.ndarray | None):
        col = t.column("grams").combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = col.chunk(0)
        at = col.offsets.to_numpy().astype(np.int64)
        return similar(col.values.to_numpy()[at[0] : at[-1]], at - at[0], sides, threshold)

    return pairs


def ngram_join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 3, threshold: float = 0.5, trees: int = 36, recall: float = 0.99, block: int = 512) -> DataFrame:
    """(key, class_id, n_links, copy_id, kept): near-duplicates by the Jaccard similarity of word n-grams.

    Words are runs of digits, a-z (A-Z lower-cased) and all beyond ASCII. Rows with the same words
    are copies (copy_id, the smallest key of them); they link with others where the Jaccard similarity
    of their n-gram sets is at least the threshold. n_links counts the other rows that a row links
    with, its copies too; class_id is the smallest key that links reach; kept is key = class_id.

    A signature's trees are sorted by paths of DEPTH labels; prefixes are shortened from the full path until pairs at the
    threshold share one in some tree with the wanted recall, as measured (prefix_depth). Pairs under one prefix
    whose sketches agree join parts; within a part all pairs are decided on their whole n-gram
    sets, so a part's pairs are found even if no tree had them. In large tables sketches that agree by chance make
    large parts with few links; prefix filtering finds them without comparing all pairs (similar). Texts are shuffled once, and
    only those in parts go on; a group of any size is split in blocks.

    Nulls: a null or empty text, or one without words, links with nothing; neither does a row with a
    null key, which is returned as kept with a null class. Rows that repeat a key and text link like any copies; keys are
    taken as 64-bit integers. Empty tables give no rows; other columns are not read.
    """
    sig = written(signatures(docs, key, text, n, trees), "signatures")
    real = sig.where("size > 0 and doc is not null")
    classes = written(real.groupBy("c1", "c2").agg(F.min("doc").alias("node"), F.count("*").alias("weight"), *[F.first(c).alias(c) for c in ("size", "s1", "s2", "paths")]), "classes")
    edges = candidate_edges(classes, threshold, trees, recall, 4096)

    def sets(r: pa.RecordBatch, off: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        g, at, _ = shingles(off, data, n)
        parts = [np.unique(g[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([r.column(0), r.column(1), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))], names=["node", "weight", "grams"])

    edges = written(edges, "edges")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    heads = classes.join(ends, "node", "left_semi").select("node", "weight")
    texts = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("_text")).where("_text is not null").join(heads, "node")
    rows = stream(texts, ["node", "weight", "_text"], sets, "node long, weight long, grams array<long>")
    # a block is `block` times a thousand n-grams: a part of many short texts is moved and cut up no more than one of few long texts
    linked = links_within(rows, edges, _jaccard(threshold), block, classes.select("node", (F.greatest("size", F.lit(32)) / 1024).alias("size")))
    forget(edges)
    per_class = classes.select("c1", "c2", F.col("node").alias("head"), "weight").join(linked.withColumnRenamed("node", "head"), "head", "left")
    out = sig.select("doc", "c1", "c2", (F.col("size") > 0).alias("_real")).join(per_class, ["c1", "c2"], "left")
    ok = F.col("_real") & F.col("doc").isNotNull()
    comp = F.when(ok, F.coalesce("component", "head")).otherwise(F.col("doc"))
    return out.select(
        F.col("doc").cast(docs.schema[key].dataType).alias(key),
        comp.alias("class_id"),
        F.when(ok, F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).otherwise(F.lit(0)).alias("n_links"),
        F.when(ok, F.col("head")).otherwise(F.col("doc")).alias("copy_id"),
        F.coalesce(comp == F.col("doc"), F.lit(True)).alias("kept"),
    )
