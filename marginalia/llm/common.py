"""Shared pieces: written tables, two-word hashes, bucketed pair scans and connected components."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_dir

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"

_written: list[tuple[tuple, str]] = []  # (JVM, Hadoop configuration) that outlive a stopped session, path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and outlives lost executors.

    Spark's checkpoint() runs its last stage twice when eager and keeps no file statistics, so
    that later joins can't choose a broadcast by size; a written table has neither fault.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marginalia-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((_files(spark), path))
    return spark.read.parquet(path)


def _files(spark: SparkSession) -> tuple:
    return spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()


def path_of(df: DataFrame) -> str | None:
    """The path of a table that written() returned, while it is kept."""
    files = df.inputFiles()[:1]
    return next((p for _, p in _written if files and p.rsplit("/", 1)[1] in files[0]), None)


def delete(spark: SparkSession, path: str) -> None:
    _delete(_files(spark), path)


def _delete(files: tuple, path: str) -> None:
    jvm, conf = files
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def forget(df: DataFrame | None) -> None:
    """Deletes a table of written() that nothing will read again."""
    if df is not None and (p := path_of(df)):
        delete(df.sparkSession, p)
        _written[:] = [x for x in _written if x[1] != p]


@atexit.register
def _clean() -> None:
    for files, path in _written:
        try:
            _delete(files, path)
        except Exception:  # noqa: BLE001  the JVM may have ended before
            pass


def ascii_lower(col):
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def hash2(*cols) -> list:
    """Two independent 64-bit hashes, together 128 bits, computed in the JVM."""
    return [F.xxhash64(F.lit(0x51ED27), *cols).alias("h1"), F.xxhash64(F.lit(0x2C1B3C6D), *cols).alias("h2")]


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer over an array."""
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def find_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its part) for the graph of edges a-b, roots left out."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while True:  # hooking to the smaller root and pointer jumping, whole arrays at a time
        rx, ry = root[x], root[y]
        lo, hi = np.minimum(rx, ry), np.maximum(rx, ry)
        open_ = lo != hi
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        np.minimum.at(root, hi[open_], lo[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition replaced by a spanning forest, a bounded number at a time."""
    a, b, limit = np.empty(0, np.int64), np.empty(0, np.int64), 400_000
    for r in batches:
        a = np.concatenate([a, r.column(0).to_numpy()])
        b = np.concatenate([b, r.column(1).to_numpy()])
        if len(a) > limit:
            a, b = find_forest(a, b)
            if len(a) > limit // 2:  # already a forest: pass it on
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["src", "dst"])
                a, b = a[:0], b[:0]
    if len(a):
        a, b = find_forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["src", "dst"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node that an edge (first two columns, longs) touches; component is the smallest node reachable.

    Alternating large-star and small-star steps over written tables. Each step first reduces
    every partition to a spanning forest, so a hub that touches a third of all nodes reaches the
    shuffle as one edge per node; minima are combined before their shuffle, and the joins have
    the one-row-per-node minima on one side, so that adaptive execution can split a hub's rows.
    Null ends are dropped; loops and repeated edges do no harm; no edges give no rows.
    """
    src, dst = edges.columns[:2]
    e = edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).where("src is not null and dst is not null and src <> dst")
    e = written(e.mapInArrow(_shrink, "src long, dst long"), "edges")
    seen = None
    for _ in range(max_rounds):
        # small-star: the parents of a node link to its smallest parent
        low = e.groupBy("src").agg(F.min("dst").alias("lo"))
        small = e.join(low, "src").select(F.explode(F.array(F.struct("src", F.col("lo").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("lo").alias("dst")))).alias("x")).select("x.*").where("src <> dst")
        small = small.distinct()
        # large-star: the larger neighbours of a node link to its smallest neighbour or itself
        both = small.union(small.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("lo"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("lo").alias("dst")).where("src <> dst").distinct()
        old, e = e, written(large, "edges")
        forget(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.count_distinct("src")).first()
        if tuple(now) == seen:
            break
        if now[0] == now[2] and e.join(e.select(F.col("src").alias("s")).distinct(), F.col("dst") == F.col("s"), "left_semi").isEmpty():
            break  # each node has one parent and no parent has one: stars
        seen = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())


def blocked_units(rows: DataFrame, keys: list[str], id_col: str, block: int, sizing: DataFrame | None = None, size: str = "1") -> DataFrame:
    """rows with bi, bj and side: pairs of rows with equal keys meet in a unit (keys, bi, bj).

    A key with at most `block` rows is one unit. A larger one is split by a hash of id_col into
    blocks of about that size, and each pair of blocks is a unit, so no task holds a hot key whole
    and a pair of rows meets exactly once. sizing: a cheaper table to count the keys' rows in; size: what
    a row of it counts.
    """
    hot = written((rows if sizing is None else sizing).groupBy(*keys).agg(F.expr(f"sum({size})").alias("_n")).where(F.col("_n") > block), "hot")
    nb = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    out = rows.join(hot, keys, "left").withColumn("_nb", F.coalesce(nb, F.lit(1)))
    out = out.withColumn("side", F.pmod(F.xxhash64(F.lit(77), F.col(id_col)), F.col("_nb").cast("long")).cast("int"))
    out = out.withColumn("_j", F.explode(F.when(F.col("_nb") > 1, F.sequence(F.lit(0), F.col("_nb") - 1)).otherwise(F.array(F.lit(0)))))
    return out.withColumn("bi", F.least("side", "_j")).withColumn("bj", F.greatest("side", "_j")).drop("_n", "_nb", "_j")


def scan_units(units: DataFrame, keys: list[str], func: Callable, schema: str, order: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """func(pa.Table of whole units in order, unit ids) -> pa.RecordBatch or None, over all units.

    Units are co-located and sorted, then streamed: thousands of small ones are handled by one call. order: columns by which a unit's rows are sorted.
    tasks: for units that take long for their bytes, so that they aren't put together by size.
    """
    by = [*keys, "bi", "bj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = size = 0

        def ids(t: pa.Table) -> np.ndarray:
            new = np.zeros(t.num_rows, bool)
            for c in by:
                v = t.column(c).to_numpy()
                new[1:] |= v[1:] != v[:-1]
            return np.cumsum(new)

        for r in batches:
            held.append(r)
            rows += r.num_rows
            size += r.nbytes
            if rows < 20_000 and size < 32_000_000:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            u = ids(t)
            cut = int(np.searchsorted(u, u[-1]))
            if cut:
                if (out := func(t.slice(0, cut), u[:cut])) is not None:
                    yield out
                held, rows = t.slice(cut).to_batches(), t.num_rows - cut
            else:
                held = t.to_batches()
            size = sum(b.nbytes for b in held)
        if rows:
            t = pa.Table.from_batches(held).combine_chunks()
            if (out := func(t, ids(t))) is not None:
                yield out

    return units.repartition(*([tasks] if tasks else []), *by).sortWithinPartitions(*by, *(order or [])).mapInArrow(run, schema)


def unit_pairs(unit: np.ndarray, side: np.ndarray, one_block: np.ndarray, room: int = 300_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows that share a unit, in arrays of bounded size: all pairs of a unit of one block, else those across its two blocks."""
    i, d, got = np.arange(len(unit)), 1, []
    size = 0
    while True:
        i = i[i + d < len(unit)]
        i = i[unit[i] == unit[i + d]]
        if not len(i):
            break
        j = i + d
        ok = one_block[i] | (side[i] != side[j])
        for s in range(0, len(i), room):
            o = ok[s : s + room]
            got.append((i[s : s + room][o], j[s : s + room][o]))
            size += len(got[-1][0])
            if size >= room:
                yield np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
                got, size = [], 0
        d += 1
    if size:
        yield np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def offsets_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) and bytes of a string or binary array, nulls as empty."""
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        width = np.int64
    else:
        width = np.int32
    b = col.buffers()
    off = np.frombuffer(b[1], width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(b[2], np.uint8) if b[2] is not None and len(b[2]) else np.empty(0, np.uint8)
    return off, data


_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    size = 1 << max(16, int(n).bit_length())
    if (base, size) not in _powers:
        p = np.full(size, base, np.uint64)
        p[0] = 1
        for k in [k for k in _powers if k[0] == base]:
            del _powers[k]
        _powers[base, size] = np.multiply.accumulate(p)
    return _powers[base, size]


BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int, step: int = 1 << 18) -> np.ndarray:
    """A 64-bit polynomial hash of each data[start:end], from running sums. Spans are in order; some `step` elements are handled at a time."""
    out = np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):
        lo = int(start[a])
        b = max(a + 1, int(np.searchsorted(end, lo + step, "right")))
        n = int(end[b - 1]) - lo
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data[lo : lo + n].astype(np.uint64) + np.uint64(1)) * _power(base, n + 1)[:n], out=sums[1:])
        out[a:b] = (sums[end[a:b] - lo] - sums[start[a:b] - lo]) * _power(pow(base, -1, 1 << 64), n + 1)[start[a:b] - lo]
        a = b
    return out


def links_within(rows: DataFrame, candidates: DataFrame, pairs: Callable, block: int, sizes: DataFrame | None = None) -> DataFrame:
    """(node, component, n_links): exact links among rows (node, weight, payload...) that candidate edges connect.

    The parts that candidate edges form are co-located in blocks (blocked_units); in each, pairs(table, sides)
    yields the indices of all rows that link, each pair once, so every pair of a part is decided exactly
    once; sides, where a unit has two blocks, tell them apart, and only pairs across count. sizes: (node, size) if a block
    isn't `block` rows but that much in all. Per row the weights of its links and per block a spanning forest of
    them leave the task, never the pairs. Rows without a link are left out.
    """
    parts = written(connected_components(candidates), "parts")
    members = rows.join(parts, "node")
    units = blocked_units(members, ["component"], "node", block, sizing=parts if sizes is None else parts.join(sizes, "node"), size="1" if sizes is None else "size")

    def run(t: pa.Table, unit: np.ndarray) -> pa.RecordBatch | None:
        node, weight = t.column("node").to_numpy(), t.column("weight").to_numpy()
        side, one = t.column("side").to_numpy(), t.column("bi").to_numpy() == t.column("bj").to_numpy()
        cuts = np.flatnonzero(np.diff(unit, prepend=unit[0] - 1, append=unit[-1] + 1))
        a, b, n = [], [], []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            sides = None if one[lo] else side[lo:hi]
            if hi - lo < 2 or sides is not None and (sides == sides[0]).all():
                continue
            count, x, y = np.zeros(hi - lo, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
            for i, j in pairs(t.slice(lo, hi - lo), sides):
                ok = node[lo + i] != node[lo + j]
                if sides is not None:
                    ok &= sides[i] != sides[j]
                i, j = i[ok], j[ok]
                if len(i):
                    for u, v in ((i, j), (j, i)):
                        count += np.bincount(u, weight[lo + v], hi - lo).astype(np.int64)
                    x, y = find_forest(np.concatenate([x, node[lo + i]]), np.concatenate([y, node[lo + j]]))
            has = np.flatnonzero(count)
            if not len(has):
                continue
            a += [node[lo:hi][has], x]
            b += [np.full(len(has), -1), y]
            n += [count[has], np.zeros(len(x), np.int64)]
        if not a:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (a, b, n)], names=["a", "b", "n"])

    found = written(scan_units(units, ["component"], run, "a long, b long, n long"), "links")
    forget(parts)
    comp = connected_components(found.where("n = 0").select("a", "b"))
    count = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    out = written(count.join(comp, "node"), "linked")
    forget(found)
    return out


def slices(off: np.ndarray, limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row that is longer, from offsets of rows."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def stream(docs: DataFrame, cols: list, func: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch | None], schema, limit: int = 4_000_000) -> DataFrame:
    """func(rows, offsets, bytes) over docs: cols, of which the last is the text, go to Python in slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            off, data = offsets_of(r.column(r.num_columns - 1))
            for lo, hi in slices(off, limit):
                o = off[lo : hi + 1]
                out = func(r.slice(lo, hi - lo), o - o[0], data[o[0] : o[-1]])
                if out is not None and out.num_rows:
                    yield out

    return docs.select(*cols).mapInArrow(run, schema)
