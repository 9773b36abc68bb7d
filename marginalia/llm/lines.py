"""Line dedup: levelled sorted runs of line hashes that each new batch is merge-anti-joined with before it adds its own."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.staging import shared_dir
from .common import delete, forget, offsets_of, slices, written

BLANK = b" \t\n\x0b\x0c\r"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _digest(line: bytes, min_chars: int) -> bytes | None:
    """128 bits of a line's key, None for a key of fewer than min_chars code points."""
    import xxhash

    k = line.strip(BLANK).translate(_LOWER)
    if len(k) < min_chars or len(k) < 4 * min_chars and len(k.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(k)


def line_keys(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc): a 128-bit hash of each line key that counts, once for each row; rows without a doc or text give none."""

    def run(batches):
        for r in batches:
            off, data = offsets_of(r.column(1))
            for lo, hi in slices(off):
                found, row = [], []
                for i in range(lo, hi):
                    own = {_digest(x, min_chars) for x in data[off[i] : off[i + 1]].tobytes().split(b"\n")}
                    own.discard(None)
                    found += own
                    row.append(len(own))
                h = np.frombuffer(b"".join(found), ">i8").astype(np.int64).reshape(-1, 2)
                at = pa.array(np.repeat(np.arange(lo, hi), row))
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), r.column(0).take(at)], names=["h1", "h2", "doc"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.where(F.col(key).isNotNull() & (F.octet_length(text) >= min_chars)).select(F.col(key), F.col(text)).mapInArrow(run, f"h1 long, h2 long, doc {kind}")


class LineRuns:
    """Sorted runs of (h1, h2, docs) on levels: `fanout` runs of a level are compacted into one of the next.

    docs are the min_docs largest documents that hold the line, largest first: enough to tell whether so many
    hold it and which is the last, and runs can be merged in any order and with repeats. A run is a table in the
    shared folder, bucketed and sorted by (h1, h2), so that merge joins with it move none of its rows. A
    batch is cut to its min_docs largest documents a line before it is shuffled, so a line that a
    third of all documents hold is a few rows of each task. Then it is merge-anti-joined with the
    runs: lines of which a run knows min_docs documents and a larger one add nothing and are
    left out. The rest becomes a level-0 run.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 3, fanout: int = 4):
        self.spark, self.min_docs, self.fanout = spark, max(1, min_docs), fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _write(self, rows: DataFrame) -> str:
        name = f"marginalia_run_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{shared_dir(self.spark)}/{name}").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, f"{shared_dir(self.spark)}/{name}")

    def _union(self, names: list[str]) -> DataFrame:
        # as plain files: a union of bucketed scans claims their partitioning, though it doesn't line up their buckets
        both = self.spark.read.schema(self.spark.table(names[0]).schema).parquet(*[f"{shared_dir(self.spark)}/{n}" for n in names])
        if len(names) == 1:
            return both
        docs = F.sort_array(F.array_distinct(F.flatten(F.collect_list("docs"))), False)  # at most min_docs of each run
        return both.groupBy("h1", "h2").agg(F.slice(docs, 1, self.min_docs).alias("docs"))

    def fresh(self, rows: DataFrame) -> DataFrame:
        """(h1, h2, docs) of a batch's line_keys() that tell the runs something new."""
        rank = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy(F.desc("doc")))
        top = rows.withColumn("_r", rank).where(F.col("_r") <= self.min_docs)
        new = top.groupBy("h1", "h2").agg(F.sort_array(F.collect_set("doc"), False).alias("docs"))
        for name in [n for level in self.levels for n in level]:
            run = self.spark.table(name).where(F.size("docs") >= self.min_docs).select(F.col("h1").alias("_1"), F.col("h2").alias("_2"), F.col("docs")[0].alias("_last"))
            new = new.join(run.hint("merge"), (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")) & (F.col("docs")[0] <= F.col("_last")), "left_anti")
        return new

    def add(self, rows: DataFrame) -> None:
        """Adds a batch's line_keys()."""
        self.levels[0].append(self._write(self.fresh(rows)))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self._compact(level, level + 1)
            level += 1

    def _compact(self, first: int, to: int) -> None:
        """All runs of the levels from first up to `to`, but not its own, become one run there."""
        names = [n for level in self.levels[first:to] for n in level]
        self.levels[to].append(self._write(self._union(names)))
        for k in range(first, to):
            self.levels[k] = []
        self._drop(names)

    def merged(self) -> DataFrame | None:
        """All runs as one, each line once; None before any batch. More batches may be added after it."""
        if not any(self.levels):
            return None
        if sum(map(len, self.levels)) > 1:
            self.levels.append([])
            self._compact(0, len(self.levels) - 1)
        return self.spark.table(next(level[0] for level in self.levels if level))

    def doomed(self) -> DataFrame:
        """(h1, h2, last): lines that at least min_docs documents hold, with the largest of them."""
        runs = self._union([n for level in self.levels for n in level])
        return runs.where(F.size("docs") >= self.min_docs).select("h1", "h2", F.col("docs")[0].alias("last"))

    def close(self) -> None:
        self._drop([n for level in self.levels for n in level])
        self.levels = [[]]


def _strike(min_chars: int, digest: bool):
    def run(batches):
        for r in batches:
            *carried, struck, texts = range(r.num_columns)
            off, data = offsets_of(r.column(texts))
            for lo, hi in slices(off):
                s = r.slice(lo, hi - lo)
                marks = s.column(struck)
                given = marks.is_valid().to_pylist()
                total, dropped, out = [], [], []
                for i in range(hi - lo):
                    b = data[off[lo + i] : off[lo + i + 1]].tobytes()
                    n = b.count(b"\n") + 1
                    d = 0
                    if given[i]:
                        bad = set(bytes(x) for x in marks[i].as_py())
                        lines = b.split(b"\n")
                        kept = [x for x in lines if _digest(x, min_chars) not in bad]
                        d, b = n - len(kept), b"\n".join(kept)
                    total.append(n)
                    dropped.append(d)
                    out.append(hashlib.sha256(b).hexdigest() if digest else b)
                text = pa.array(out, pa.string()) if digest else pa.array(out, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*[s.column(c) for c in carried], pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), text], names=[*[r.schema.field(c).name for c in carried], "n_lines", "n_dropped", "_kept"])

    return run


def line_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, batches: Iterable[DataFrame] | None = None, digest: bool = False, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs without repeated lines, with n_lines (before) and n_dropped; with digest: (key, n_lines, n_dropped, kept_sha256).

    A line's key is the line without the blanks of BLANK at its ends, A-Z lower-cased. A key of at
    least min_chars code points in at least min_docs documents (distinct values of key) loses all
    its lines except in the largest document that holds it. batches: docs in parts that come one
    after the other (default: one part).

    Each batch's line keys are written once, merge-anti-joined with the runs and added to them
    (LineRuns). What a line's fate is depends on all batches, so it is read from the runs after the last one.

    Nulls: a null text is one empty line and becomes an empty text; a row with a null key is no
    document, it neither counts nor loses lines. Rows that repeat a key are one document and each
    keep or lose the same lines. Empty tables give no rows. Columns of docs stay; ones that have
    the names of `counts` are replaced. Line hashes have 128 bits.

    Line keys take 24 bytes and are shuffled twice, to their run and to the lines that go (split where
    a line is hot, by adaptive execution; not at all where these are few enough for a broadcast). Texts
    are shuffled once, to meet the lines that their document loses, under the same rule.
    """
    spark = docs.sparkSession
    runs, held = LineRuns(spark, min_docs), []
    for part in batches if batches is not None else [docs]:
        held.append(written(line_keys(part, key, text, min_chars), "keys"))
        runs.add(held[-1])
    if not held:
        held.append(written(line_keys(docs.limit(0), key, text, min_chars), "keys"))
        runs.add(held[-1])
    doomed = written(runs.doomed(), "doomed")
    runs.close()
    keys = held[0]
    for h in held[1:]:
        keys = keys.union(h)
    lost = keys.join(F.broadcast(doomed) if _small(doomed) else doomed, ["h1", "h2"]).where(F.col("doc") < F.col("last"))
    both = F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("h1", "h2")])
    lost = written(lost.groupBy("doc").agg(F.collect_list(both).alias("_struck")), "struck")
    for h in [*held, doomed]:
        forget(h)
    carried = [key] if digest else [c for c in docs.columns if c not in (text, *counts)]
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)], F.col(key).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    lost = lost.withColumnRenamed("doc", "_doc")
    rows = rows.join(lost if _small(lost) else lost.hint("shuffle_hash"), "_doc", "left").select(*[f"c{i}" for i in range(len(carried))], "_struck", "_text")
    fields = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carried)]
    out = rows.mapInArrow(_strike(min_chars, digest), ", ".join([*fields, "n_lines long, n_dropped long, _kept string"]))
    if digest:
        return out.select(F.col("c0").alias(key), F.col("n_lines").alias(counts[0]), F.col("n_dropped").alias(counts[1]), F.col("_kept").alias("kept_sha256"))
    at = {c: f"c{i}" for i, c in enumerate(carried)} | {text: "_kept"}
    return out.select(*[F.col(at[c]).alias(c) for c in docs.columns if c not in counts], F.col("n_lines").alias(counts[0]), F.col("n_dropped").alias(counts[1]))


def _small(df: DataFrame) -> bool:
    """Whether a written table is under the session's broadcast threshold by its own statistics."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return size <= limit


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM s),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.i, k.line, m.last IS NOT NULL AND k.doc_id < m.last AS gone FROM k LEFT JOIN m ON k.key = m.key),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept FROM j GROUP BY doc_id)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM g
"""
