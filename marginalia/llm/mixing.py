"""Mixing sources to target weights: Pfair release times and deadlines, interleaved earliest deadline first."""

from __future__ import annotations

import bisect
import heapq
import math
from array import array
from collections.abc import Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written

MAX_SOURCES = 1_000

#: Blocks of a source in one row of the schedule's table.
PIECE = 256


def shares(weights: Mapping[str, float], slots: int) -> dict[str, int]:
    """Whole slots of each source in a period of at least `slots`, in exactly the proportion of the weights.

    Weights are fractions, so such a period exists; it may be far longer than any schedule.
    """
    if any(not w > 0 or w == float("inf") for w in weights.values()):
        raise ValueError("weights are positive and finite")
    exact = {s: Fraction(w) for s, w in weights.items()}
    whole = math.lcm(*[w.denominator for w in exact.values()])
    got = {s: int(w * whole) for s, w in exact.items()}
    least = math.gcd(*got.values())
    times = max(1, -(-slots * least // sum(got.values())))
    return {s: n // least * times for s, n in got.items()}


def period(got: Mapping[str, int], room: Mapping[str, int]) -> tuple[dict[str, array], int]:
    """The slot of each block of each source in one period of sum(got) slots, and the slots until its end or until a source has placed its `room`.

    Block j of a source with share n of d slots is released at floor(j d / n) and due at
    ceil((j + 1) d / n). Of the released blocks the one that is due first takes the next slot (ties:
    the smaller share, then the name). Shares fill the period, so every block meets its deadline,
    and at each time each source has less than one block more or fewer than its share.
    """
    d = sum(got.values())
    waiting = [(0, -(-d // n), n, s, 0) for s, n in got.items()]  # release, deadline, share, source, block
    heapq.heapify(waiting)
    ready: list = []
    out: dict[str, array] = {s: array("q") for s in got}
    t = 0
    while t < d:
        while waiting and waiting[0][0] <= t:
            _, due, n, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, n, s, j))
        due, n, s, j = heapq.heappop(ready)
        if t >= due:
            raise AssertionError("a deadline was missed")
        out[s].append(t)
        t += 1
        if j + 1 == room[s]:
            break
        if j + 1 < n:
            heapq.heappush(waiting, ((j + 1) * d // n, -(-(j + 2) * d // n), n, s, j + 1))
    return out, t


def phases(blocks: Mapping[str, int], weights: Mapping[str, float], slots: int = 1000) -> list[tuple[int, int, str, int, int, int, array]]:
    """(phase, first slot, source, first block, blocks here, period, slots in the period) until all blocks are placed.

    A phase ends when a source runs out; the others go on with their weights among themselves. A phase
    that is longer than the weights' period repeats it; one that is shorter is scheduled block by block.
    """
    done = dict.fromkeys(blocks, 0)
    out, start = [], 0
    live = {s for s, n in blocks.items() if n}
    number = 0
    while live:
        got = shares({s: weights[s] for s in sorted(live)}, slots)
        plan, d = period(got, {s: blocks[s] - done[s] for s in live})
        if d < sum(got.values()):
            end = d
        else:
            last = lambda s, k: (k - 1) // got[s] * d + plan[s][(k - 1) % got[s]]  # noqa: B023, E731  the slot of a source's k-th block
            end = min(last(s, blocks[s] - done[s]) for s in live) + 1
        for s in sorted(live):
            n = len(plan[s])
            here = min(blocks[s] - done[s], end // d * n + bisect.bisect_left(plan[s], end % d))
            if here:
                out.append((number, start, s, done[s], here, d, plan[s]))
            done[s] += here
        start += end
        number += 1
        live = {s for s in live if done[s] < blocks[s]}
    return out


def _pieces(blocks: Mapping[str, int], plan: list) -> pa.Table:
    """(_s, _c, places): the slots of each source's blocks, PIECE blocks a row."""
    slots = {s: np.empty(n, np.int64) for s, n in blocks.items()}
    for _, start, s, lo, here, d, places in plan:
        i, at = np.arange(here), np.array(places, np.int64)
        slots[s][lo : lo + here] = start + i // len(at) * d + at[i % len(at)]
    cut = [(s, c, x[c * PIECE : (c + 1) * PIECE]) for s, x in slots.items() for c in range(-(-len(x) // PIECE))]
    ends = np.concatenate([[0], np.cumsum([len(x) for *_, x in cut], dtype=np.int64)]).astype(np.int32)
    places = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *[x for *_, x in cut]])))
    return pa.table({"_s": pa.array([s for s, *_ in cut], pa.string()), "_c": pa.array([c for _, c, _ in cut], pa.int64()), "places": places})


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, *, key: str = "doc_id", source: str = "source", block: int | None = None, slots: int = 1000, power: float = 0.7, seed: int = 17, bucket_rows: int = 4_000, in_order: bool = False, names: tuple[str, str, str] = ("block", "slot", "position")) -> DataFrame:
    """docs with block, slot and position: an order in which each prefix has its sources' target weights, every row once.

    Rows of a source come in the order of a keyed hash of their key, cut in blocks of `block` rows (by default
    32, or a millionth of all rows where that is more, so that the schedule has about a million blocks at most).
    Blocks are scheduled by phases(); position numbers all rows, 0 first, in order of slots. Without
    weights a source of n rows weighs n ** power; a source that the weights leave out weighs
    what the least one does. As long as no source has run out, every prefix has less than one
    block more or fewer of a source than its target, by the weights as given.
    When one runs out, this holds among those that are left. Nothing is dropped or repeated.
    in_order: partitions follow one another by position, each with as many rows and sorted, without a sampling pass.

    A null source is a source of its own. Rows that repeat a key, or have none, are ordered by a hash of
    all their columns, and equal rows in any order; where so many share a key that a bucket is crowded, rows are written once with a number
    each, by which they are spread. Empty tables give no rows; columns of docs that have these `names` are
    replaced. No task holds a source: a row's rank is its rank in one of its source's hash buckets of about bucket_rows rows, plus the rows
    in the buckets before; sources without rows are fine. At most MAX_SOURCES sources (config-sized) are accepted, since the schedule is made on the driver, which holds 8 bytes for each block.
    """
    taken = [c for c in docs.columns if c not in names]
    base = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(taken)])
    key, source = f"c{taken.index(key)}", f"c{taken.index(source)}"
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))  # a null is no text
    own = [c for c in base.columns if not isinstance(base.schema[c].dataType, _maps())]
    rows = base.withColumn("_s", name).withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))).withColumn("_g", F.xxhash64(F.lit(seed), *own))
    light = rows.select("_s", "_h")
    total = light.groupBy("_s").agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(total) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    count = {r["_s"]: r.n for r in total}
    if weights is None:
        given = {s: n**power for s, n in count.items()}
    else:
        known = {"" if s is None else f"={s}": w for s, w in weights.items()}
        given = {s: known.get(s, min(known.values(), default=1.0)) for s in count}
    block = block or max(32, -(-sum(count.values()) // (1 << 20)))
    blocks = {s: -(-n // block) for s, n in count.items()}
    plan = phases(blocks, given, slots)
    spark = docs.sparkSession
    bits = max(0, (max(count.values(), default=1) // bucket_rows).bit_length())
    bucket = F.shiftrightunsigned(F.col("_h"), 64 - bits).cast("long") if bits else F.lit(0).cast("long")
    # rows before each bucket of each source
    earlier = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)

    def buckets(light: DataFrame) -> DataFrame:
        sizes = light.withColumn("_b", bucket).groupBy("_s", "_b").agg(F.count("*").alias("n"))
        return written(sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "buckets")

    before = buckets(light)
    if bits and (before.agg(F.max("n")).first()[0] or 0) > 8 * bucket_rows:  # hashes of distinct keys don't crowd so
        rows = written(rows.withColumn("_h", F.xxhash64(F.lit(seed), F.col("_g"), F.monotonically_increasing_id())), "rows")
        forget(before)
        before = buckets(rows.select("_s", "_h"))
    before = before.drop("n")
    rank = F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", key, "_g")) - 1
    ranked = rows.withColumn("_b", bucket).withColumn("_r", rank).join(before, ["_s", "_b"]).withColumn("_r", F.col("_r") + F.col("before"))
    ranked = ranked.withColumn("block", F.floor(F.col("_r") / block).cast("long"))
    # each row meets the slots of its source's blocks near its own: 8 bytes a block in all
    table = F.broadcast(spark.createDataFrame(_pieces(blocks, plan), "_s string, _c long, places array<long>"))
    met = ranked.withColumn("_c", F.floor(F.col("block") / PIECE).cast("long")).join(table, ["_s", "_c"])
    met = met.withColumn("slot", F.element_at("places", (F.pmod("block", F.lit(PIECE)) + 1).cast("int"))).drop("places", "_c", "_h", "_g", "_b", "before")
    met = _placed(met, {s: n for s, n in count.items()}, block, plan)
    if in_order:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        per_part = max(1, -(-sum(count.values()) // parts))
        met = met.repartitionById(parts, F.floor(F.col("position") / per_part).cast("int")).sortWithinPartitions("position")
    return met.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(taken)], *[F.col(c).alias(n) for c, n in zip(("block", "slot", "position"), names, strict=True)])


def _maps():
    from pyspark.sql import types as T

    return (T.MapType, T.VariantType)


def _placed(met: DataFrame, count: Mapping[str, int], block: int, plan: list) -> DataFrame:
    """position: slots are full blocks but for the last one of each source, so rows before a slot follow from the sources that ended before it."""
    short = []
    for phase, start, s, lo, here, d, places in plan:
        if lo + here == -(-count[s] // block) and count[s] % block:
            k = here - 1
            short.append((start + k // len(places) * d + places[k % len(places)], block - count[s] % block))
    missing = F.lit(0).cast("long")
    if short:
        gaps = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.lit(g).cast("long").alias("g")) for t, g in sorted(short)])
        missing = F.aggregate(F.filter(gaps, lambda x: x.t < F.col("slot")), F.lit(0).cast("long"), lambda a, x: a + x.g)
    return met.withColumn("position", F.col("slot") * block - missing + F.pmod(F.col("_r"), F.lit(block)))
