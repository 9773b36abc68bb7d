"""Media columns: chroma fingerprints of audio, and their alignment by offset histograms and bit errors."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FRAME_S, HOP_S = 0.25, 0.125
LONG = 1 << 21
LOW_HZ, HIGH_HZ = 65.0, 3520.0

#: (kind, lowest pitch class, pitch classes, frames) of the sixteen filters; each gives two bits.
FILTERS = [
    ("pitch", 0, 12, 4),
    ("pitch", 1, 6, 6),
    ("pitch", 5, 6, 6),
    ("pitch", 3, 4, 8),
    ("pitch", 7, 4, 8),
    ("pitch", 0, 8, 3),
    ("pitch", 4, 8, 3),
    ("time", 0, 6, 8),
    ("time", 6, 6, 8),
    ("time", 3, 4, 6),
    ("time", 8, 4, 6),
    ("check", 0, 6, 8),
    ("check", 6, 6, 8),
    ("check", 2, 8, 6),
    ("middle", 0, 12, 6),
    ("middle", 4, 4, 6),
]
SPAN = max(f[3] for f in FILTERS)
CUTS = (-0.55, 0.12, 0.7)
GRAY = np.array([0, 1, 3, 2], np.uint32)


def pcm(data: bytes | None) -> tuple[int, int, Callable[[int, int], np.ndarray]] | None:
    """(rate, samples, f) of PCM audio of 8, 16, 24 or 32 bits, None for anything else; f(lo, hi) gives mono samples from -1 to 1."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
            raw = np.frombuffer(w.readframes(w.getnframes()), np.uint8)
    except (wave.Error, EOFError, KeyError, ValueError, struct.error):
        return None
    if width not in (1, 2, 3, 4) or channels < 1:
        return None
    n = len(raw) // (width * channels)

    def part(lo: int, hi: int) -> np.ndarray:
        b = raw[lo * width * channels : min(hi, n) * width * channels]
        if width == 1:
            x = (b.astype(np.float32) - 128) / 128
        elif width == 3:
            b = b.reshape(-1, 3).astype(np.int32)
            x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / float(2**23)
        else:
            x = b.view(np.dtype(f"<i{width}")).astype(np.float32) / float(2 ** (8 * width - 1))
        return x.reshape(-1, channels).mean(1)

    return rate, n, part


def decode_wav(data: bytes | None) -> tuple[int, np.ndarray] | None:
    """(rate, mono samples from -1 to 1) of PCM audio; None for anything else."""
    got = pcm(data)
    return got and (got[0], got[2](0, got[1]))


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def chroma(x: np.ndarray, rate: int) -> np.ndarray:
    """(recordings, frames, 12): each frame's energy by pitch class, scaled to length 1; silent frames are 0."""
    size, hop = max(8, int(FRAME_S * rate)), max(4, int(HOP_S * rate))
    if x.shape[1] < size:
        return np.zeros((len(x), 0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, ::hop]
    hz = np.fft.rfftfreq(size, 1 / rate)
    ok = (hz >= LOW_HZ) & (hz <= HIGH_HZ)
    to = np.zeros((ok.sum(), 12), np.float32)
    to[np.arange(ok.sum()), np.round(12 * np.log2(hz[ok] / 440)).astype(int) % 12] = 1
    power = np.abs(np.fft.rfft(frames * np.hanning(size).astype(np.float32), axis=2)[:, :, ok]) ** 2
    c = power.astype(np.float32) @ to
    norm = np.sqrt((c.astype(np.float64) ** 2).sum(2, keepdims=True))
    return np.where(norm > 1e-6, c / np.maximum(norm, 1e-12), 0.0)


def chroma_of(part: Callable[[int, int], np.ndarray], n: int, rate: int, frames: int = 256) -> np.ndarray:
    """chroma() of one recording of any length, some frames at a time."""
    size, hop = max(8, int(FRAME_S * rate)), max(4, int(HOP_S * rate))
    total = 0 if n < size else (n - size) // hop + 1
    got = [chroma(part(k * hop, (min(k + frames, total) - 1) * hop + size)[None], rate) for k in range(0, total, frames)]
    return np.concatenate(got, axis=1) if got else np.zeros((1, 0, 12))


def packed(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(integers, heard): a 32-bit integer for each window of SPAN frames, and whether the window has any sound."""
    r, n = c.shape[0], c.shape[1] - SPAN + 1
    if n <= 0:
        return np.zeros((r, 0), np.uint32), np.zeros((r, 0), bool)
    image = np.zeros((r, c.shape[1] + 1, 25))
    image[:, 1:, 1:] = np.concatenate([c, c], 2).cumsum(1).cumsum(2)  # twice 12, so that pitch classes go round

    def box(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[:, t1 : t1 + n, p1] - image[:, t0 : t0 + n, p1] - image[:, t1 : t1 + n, p0] + image[:, t0 : t0 + n, p0]

    out = np.zeros((r, n), np.uint32)
    for kind, p, h, w in FILTERS:
        if kind == "pitch":
            a, b = box(0, w, p, p + h // 2), box(0, w, p + h // 2, p + h)
        elif kind == "time":
            a, b = box(0, w // 2, p, p + h), box(w // 2, w, p, p + h)
        elif kind == "check":
            a = box(0, w // 2, p, p + h // 2) + box(w // 2, w, p + h // 2, p + h)
            b = box(0, w // 2, p + h // 2, p + h) + box(w // 2, w, p, p + h // 2)
        else:
            a = box(w // 3, 2 * w // 3, p, p + h) * 2
            b = box(0, w // 3, p, p + h) + box(2 * w // 3, w, p, p + h)
        v = np.log((0.3 + np.maximum(a, 0)) / (0.3 + np.maximum(b, 0)))
        out = out << np.uint32(2) | GRAY[np.digitize(v, CUTS)]
    return out, box(0, SPAN, 0, 12) > 1e-6


def fingerprints(media: DataFrame, *, key: str, audio: str = "audio") -> DataFrame:
    """(key, prints): the packed integers of each recording, silence left out at both ends; empty for null, broken, silent or too short audio.

    Recordings of one rate and length go through the transforms together; those of more than LONG samples one by one, some
    frames at a time, so that a recording of any length takes little more than its own bytes. Every row has a result, whatever its key.
    """

    def run(batches):
        for r in batches:
            for lo in range(0, r.num_rows, 64):
                s = r.slice(lo, 64)
                got: list = [np.empty(0, np.uint32)] * s.num_rows
                by: dict = {}
                for i, b in enumerate(s.column(1).to_pylist()):
                    if not (d := pcm(b)) or not d[1] or d[0] < 200:
                        continue
                    if d[1] <= LONG:
                        by.setdefault(d[:2], []).append((i, d[2](0, d[1])))
                        continue
                    out, heard = packed(chroma_of(d[2], d[1], d[0]))
                    if heard.any():
                        at = np.flatnonzero(heard[0])
                        got[i] = out[0][at[0] : at[-1] + 1]
                for (rate, size), rows in by.items():
                    step = max(1, 4_000_000 // size)
                    for k in range(0, len(rows), step):
                        out, heard = packed(chroma(np.stack([x for _, x in rows[k : k + step]]), rate))
                        for (i, _), v, h in zip(rows[k : k + step], out, heard, strict=True):
                            at = np.flatnonzero(h)
                            if len(at):
                                got[i] = v[at[0] : at[-1] + 1]
                cuts = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([s.column(0), pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(got).view(np.int32)))], names=["_key", "prints"])

    kind = media.schema[key].dataType.simpleString()
    return media.select(F.col(key), F.col(audio)).mapInArrow(run, f"_key {kind}, prints array<int>").withColumnRenamed("_key", key)


def align(a: np.ndarray, b: np.ndarray, max_ber: float) -> tuple[int, int, float] | None:
    """(hits, offset, bit errors) of the best alignment of two recordings' integers, or None.

    The histogram of offsets counts, for each offset, the distinct integers that both have there;
    the fullest offsets are tried by hits, then smallest distance, until one has at most max_ber wrong
    bits over its overlap.
    """
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    n = hi - lo
    if not n.sum():
        return None
    i = np.repeat(np.arange(len(a)), n)
    j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    seen = np.unique(np.stack([j - i, a[i].astype(np.int64)]), axis=1)
    offsets, hits = np.unique(seen[0], return_counts=True)
    for k in np.lexsort((offsets, np.abs(offsets), -hits)):
        o = int(offsets[k])
        s, e = max(0, -o), min(len(a), len(b) - o)
        x, y = a[s:e].astype(np.uint32), b[s + o : e + o].astype(np.uint32)
        ber = float(np.bitwise_count(x ^ y).sum()) / (32 * (e - s))
        if ber <= max_ber:
            return int(hits[k]), o, ber
    return None


def match_audio(prints: DataFrame, is_query, *, key: str, min_hits: int = 6, max_ber: float = 0.2, block: int = 256) -> DataFrame:
    """(query, match, rows, hits, offset, ber): recordings that align with each query recording, between representatives of equal ones.

    Rows with equal integers are one class, named by its smallest key; query and match are such
    names, rows counts the match's rows. Two classes match if their best alignment (align) has
    min_hits distinct integers in common, or as many as the query has if these are fewer, with at most max_ber
    wrong bits. is_query: a condition on prints' rows; a class with a query row is a query.

    No match is lost: two recordings with h integers in common share at least m of the first's rarest
    n - h + m, so only these are looked up, rarest by the number of classes that hold them, and pairs that
    share fewer than m (three) of them go no further. Candidates are met with both sides' integers by joins, which adaptive execution splits. Null keys and empty prints match nothing.
    """
    base = prints.where(F.col(key).isNotNull() & (F.size("prints") > 0)).select(F.col(key).cast("long").alias("key"), "prints", is_query.alias("q"), F.xxhash64(F.lit(5), "prints").alias("h1"), F.xxhash64(F.lit(6), "prints").alias("h2"))
    classes = written(base.groupBy("h1", "h2").agg(F.min("key").alias("id"), F.count("*").alias("rows"), F.max("q").alias("q"), F.first("prints").alias("prints")).drop("h1", "h2"), "prints")
    posts = classes.select("id", F.explode(F.array_distinct("prints")).alias("v"))
    wanted = classes.where("q").select("id", F.explode(F.array_distinct("prints")).alias("v"))
    df = posts.groupBy("v").agg(F.count("*").alias("df"))
    w = Window.partitionBy("id")  # at most a recording's integers
    n, need = F.count("*").over(w), F.least(F.lit(min_hits), F.count("*").over(w))
    rare = wanted.join(df, "v").select("id", "v", (F.row_number().over(w.orderBy("df", "v")) <= n - need + F.least(F.lit(3), need)).alias("use"), F.least(F.lit(3), need).alias("m")).where("use")
    rare = rare.select(F.col("id").alias("query"), "v", "m")
    shared = rare.join(posts, "v").where("query <> id").groupBy("query", F.col("id").alias("match")).agg(F.count("*").alias("c"), F.max("m").alias("m"))
    pairs = shared.where("c >= m").select("query", "match")
    both = pairs.join(classes.select(F.col("id").alias("query"), F.col("prints").alias("a")), "query").join(classes.select(F.col("id").alias("match"), F.col("prints").alias("b"), "rows"), "match")

    def verify(batches):
        for r in batches:
            a, b = r.column("a"), r.column("b")
            q, m, k = (r.column(c).to_numpy() for c in ("query", "match", "rows"))
            out = []
            av, ao = a.flatten().to_numpy().view(np.uint32), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(a).to_numpy())])
            bv, bo = b.flatten().to_numpy().view(np.uint32), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(b).to_numpy())])
            for i in range(r.num_rows):
                x, y = av[ao[i] : ao[i + 1]], bv[bo[i] : bo[i + 1]]
                least = min(min_hits, len(np.unique(x)))
                if len(np.intersect1d(x, y)) < least:
                    continue
                if (got := align(x, y, max_ber)) and got[0] >= least:
                    out.append((q[i], m[i], k[i], *got))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["query", "match", "rows", "hits", "offset", "ber"])

    return both.select("query", "match", "rows", "a", "b").mapInArrow(verify, "query long, match long, rows long, hits long, offset long, ber double")


def search_audio(prints: DataFrame, is_query, *, key: str, **how) -> DataFrame:
    """(key, n_prints, n_matches, best_id, best_hits, best_offset, best_ber, recording, matches): a row for each query row.

    n_matches counts the other rows that align, equal ones included. The best is the one with the
    fewest bit errors, then most hits, then the smallest key: an equal row (offset 0, no errors) where there is one.
    recording is the smallest key of the rows with equal integers. matches holds all that align, the best first: a
    (recording, ids, hits, offset, ber) for each recording, the own one included where it has other rows; ids
    are its rows' keys in order, without the query's own. Empty where nothing aligns.
    """
    hashed = prints.select(F.col(key), "prints", F.size("prints").cast("long").alias("n_prints"), F.xxhash64(F.lit(5), "prints").alias("h1"), F.xxhash64(F.lit(6), "prints").alias("h2"))
    real = hashed.where((F.col("n_prints") > 0) & F.col(key).isNotNull())
    ids = real.groupBy("h1", "h2").agg(F.min(key).cast("long").alias("query"), F.count("*").alias("copies"), F.sort_array(F.array_distinct(F.array(F.min(key), F.max(key)))).alias("_ends"))
    # the smallest other key of a class is its smallest, but for that row itself the next one
    found = written(match_audio(prints, is_query, key=key, **how), "matches")
    members = real.join(ids.select("h1", "h2", F.col("query").alias("match")), ["h1", "h2"]).groupBy("match").agg(F.sort_array(F.collect_list(F.col(key).cast("long"))).alias("ids"))
    listed = found.join(members, "match").groupBy("query").agg(F.collect_list(F.struct("ber", (-F.col("hits")).alias("less"), F.col("match").alias("recording"), "ids", "offset")).alias("_m"))
    best = found.groupBy("query").agg(F.sum("rows").alias("others"), F.min(F.struct("ber", (-F.col("hits")).alias("less"), F.col("match").alias("id"), F.abs("offset").alias("far"), "offset")).alias("b"))
    q = hashed.where(is_query).join(ids, ["h1", "h2"], "left").join(best, "query", "left").join(listed, "query", "left")
    q = q.join(members.where(F.size("ids") > 1).select(F.col("match").alias("query"), F.col("ids").alias("_own")), "query", "left")
    has = (F.col("n_prints") > 0) & F.col(key).isNotNull() & (F.col("copies") > 1)
    twin = F.when(F.col("query") == F.col(key), F.element_at("_ends", -1)).otherwise(F.col("query")).cast("long")
    pick = lambda same, other: F.when(has, same).otherwise(other)
    distinct_n = F.size(F.array_distinct("prints")).cast("long")
    match = lambda recording, ids, hits, offset, ber: F.struct(recording.alias("recording"), ids.alias("ids"), hits.alias("hits"), offset.alias("offset"), ber.alias("ber"))
    others = F.transform(F.array_sort(F.coalesce("_m", F.array().cast(listed.schema["_m"].dataType))), lambda m: match(m.recording, m.ids, -m.less, m.offset, m.ber))
    mine = F.col(key).cast("long")
    rest = F.concat(F.slice("_own", 1, F.array_position("_own", mine).cast("int") - 1), F.slice("_own", F.array_position("_own", mine).cast("int") + 1, F.size("_own")))
    same = F.array(match(F.col("query"), rest, distinct_n, F.lit(0).cast("long"), F.lit(0.0)))
    return q.select(
        F.col(key),
        "n_prints",
        (F.coalesce("others", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_matches"),
        pick(twin, F.col("b.id")).alias("best_id"),
        pick(distinct_n, -F.col("b.less")).alias("best_hits"),
        pick(F.lit(0).cast("long"), F.col("b.offset")).alias("best_offset"),
        pick(F.lit(0.0), F.col("b.ber")).alias("best_ber"),
        F.when(F.col(key).isNotNull(), F.col("query")).alias("recording"),
        F.when(has, F.concat(same, others)).when(F.col(key).isNotNull(), others).otherwise(F.slice(others, 1, 0)).alias("matches"),
    )


def sonified(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", rate: int = 2048, note_s: float = 0.5) -> DataFrame:
    """(key, audio): each vector played as a WAV recording, two notes for every four numbers.

    A stand-in for a table of recordings: near vectors sound alike. Vectors that are null, empty or hold null or
    non-finite numbers give null.
    """

    def run(batches):
        t = np.arange(int(rate * note_s)) / rate
        fade = np.minimum(1, np.minimum(t, t[::-1]) * 50)
        tones = np.stack([np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) * fade for k in range(24)]).astype(np.float32)
        for r in batches:
            out = []
            for n, v in enumerate(r.column(1).to_pylist()):
                if len(out) == 128:  # recordings are large: few go in a batch
                    yield pa.RecordBatch.from_arrays([r.column(0).slice(n - 128, 128), pa.array(out, pa.binary())], names=["_key", "audio"])
                    out = []
                if not v or any(x is None or not np.isfinite(x) for x in v):
                    out.append(None)
                    continue
                v = np.array([*v, *[0.0] * (-len(v) % 4)], np.float64).reshape(-1, 4)
                k = np.floor(12 * (0.5 + np.arctan2(v[:, [0, 2]], v[:, [1, 3]]) / (2 * np.pi))).astype(int).clip(0, 11)
                out.append(encode_wav((0.45 * tones[k[:, 0]] + 0.35 * tones[12 + k[:, 1]]).ravel(), rate))
            yield pa.RecordBatch.from_arrays([r.column(0).slice(r.num_rows - len(out)), pa.array(out, pa.binary())], names=["_key", "audio"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(F.col(key), F.col(vector)).mapInArrow(run, f"_key {kind}, audio binary").withColumnRenamed("_key", key)
