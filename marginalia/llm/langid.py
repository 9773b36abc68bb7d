"""Language ID: n-gram presence kernels with Nyström landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, stream, written
from .licenses import LOWER

#: Columns of the presence matrix: 256 bytes, then 2-, 3- and 4-grams hashed into BUCKETS each.
BUCKETS = 1 << 14
WIDTH = 256 + 3 * BUCKETS

_CLEAN = LOWER.copy()
_CLEAN[:128][~np.isin(np.arange(128), np.arange(97, 123)) & ~np.isin(np.arange(128), np.arange(65, 91))] = 32


def grams(data: np.ndarray) -> list[np.ndarray]:
    """The column of each 1- to 4-gram of bytes; A-Z lower-cased, other ASCII than letters as a space."""
    b = _CLEAN[data].astype(np.int32)
    out = [b]
    h = b
    for n in (2, 3, 4):
        h = (h[:-1] * 257 + b[n - 1 :]) & 0x3FFFFF
        if not len(h):
            break
        out.append((((h * 40503) >> 7) & (BUCKETS - 1)) + (256 + (n - 2) * BUCKETS))
    return out


def presence(off: np.ndarray, data: np.ndarray, row: np.ndarray) -> None:
    """Sets row[d, c] = 1 for each gram c of each text d. Grams never cross texts."""
    for d, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        if b > a:
            for g in grams(data[a:b]):
                row[d][g] = 1


@dataclass
class Model:
    """Scores are a text's normalised presence row times `weights`, the landmarks' rows times the regression's coefficients."""

    langs: list[str]
    weights: np.ndarray  # WIDTH x languages
    bias: np.ndarray

    def scores(self, off: np.ndarray, data: np.ndarray, batch: int = 64) -> np.ndarray:
        n = len(off) - 1
        out = np.zeros((n, len(self.langs)), np.float32)
        for lo in range(0, n, batch):
            hi = min(n, lo + batch)
            rows = np.zeros((hi - lo, WIDTH), np.uint8)
            presence(off[lo : hi + 1], data, rows)
            size = np.sqrt(np.maximum(1, rows.sum(1, dtype=np.int64)))
            out[lo:hi] = rows.astype(np.float32) @ self.weights / size[:, None].astype(np.float32) + self.bias
        return out


def fit(x: np.ndarray, langs: list[str], landmarks: int, ridge: float, seed: int = 7) -> Model:
    """Kernel ridge regression on presence rows x: k(a, b) = |a and b| / sqrt(|a| |b|), through the Nyström landmarks."""
    names = sorted(set(langs))
    unit = x.astype(np.float32)
    unit /= np.sqrt(np.maximum(1, unit.sum(1, keepdims=True)))
    pick = np.random.default_rng(seed).permutation(len(unit))[:landmarks]
    mark = unit[pick]
    k_nm = (unit @ mark.T).astype(np.float64)
    k_mm = k_nm[pick]
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = 1 / np.sqrt((y > 0).sum(0))[np.argmax(y, 1)][:, None]  # each language counts alike
    bias = np.zeros(len(names)) if len(names) == 1 else (y * weight**2).sum(0) / (weight**2).sum()
    a = k_nm * weight
    coef = np.linalg.solve(a.T @ a + ridge * k_mm + 1e-6 * np.eye(len(pick)), a.T @ ((y - bias) * weight))
    return Model(names, (mark.T.astype(np.float64) @ coef).astype(np.float32), bias.astype(np.float32))


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 200, max_rows: int = 2000, landmarks: int = 200, ridge: float = 0.5) -> Model | None:
    """A model from a bounded sample of the labelled rows of docs, or None where there are none.

    The sample has at most per_lang rows of each language, fewer where there are more than max_rows / per_lang languages, but
    one of each at least: those with the smallest hashes of their key, so that it doesn't depend on the order of rows. Executors
    turn the whole texts into packed presence rows (6 kB each), which the driver gathers. Rows with
    a null language, a null text or one without a letter are left out, also where languages are counted.
    """
    h = F.xxhash64(F.lit(11), F.col(key))
    usable = docs.where(F.col(lang).isNotNull() & F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    counts = written(usable.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")), "langs")
    languages = counts.count()
    if not languages:
        return None
    per_lang = max(1, min(per_lang, max_rows // languages))
    # the smallest hashes of a language lie under a cut that leaves it half as many again and 20
    cut = F.least(F.lit(1.0), (1.5 * per_lang + 20) / F.col("n")) * float(2**64) - float(2**63)
    near = usable.select(F.col(lang).alias("lang"), h.alias("h"), F.col(text).alias("_text")).join(counts.select("lang", cut.alias("_cut")), "lang").where(F.col("h").cast("double") <= F.col("_cut"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("_text")))
    some = near.withColumn("_r", first).where(F.col("_r") <= per_lang)

    def pack(r: pa.RecordBatch, off: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        out = []
        for d in range(r.num_rows):
            row = np.zeros((1, WIDTH), np.uint8)
            presence(off[d : d + 2], data, row)
            out.append(np.packbits(row[0]).tobytes())
        return pa.RecordBatch.from_arrays([r.column(0), r.column(1), pa.array(out, pa.binary())], names=["lang", "h", "bits"])

    packed = stream(some, ["lang", "h", "_text"], pack, "lang string, h long, bits binary")
    kept = sorted(packed.collect(), key=lambda r: (r.h, r.lang, bytes(r.bits)))
    forget(counts)
    if not kept:
        return None
    x = np.stack([np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8))[:WIDTH] for r in kept])
    return fit(x, [r.lang for r in kept], landmarks, ridge)


def predict(docs: DataFrame, model: Model | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for each row of docs, from nothing but its whole text.

    und with score 0 for a null text, one without a letter, or without a model. score: the softmax
    of the regressions' outputs, 4 times enlarged, at the predicted language; ties go to the first
    language in order. Empty tables give no rows; repeated rows and null keys are each predicted.
    """
    kind = docs.schema[key].dataType.simpleString()
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.select(F.col(key), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH x languages floats, whatever the documents

    def run(r: pa.RecordBatch, off: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        m = sent.value
        s = 4 * m.scores(off, data).astype(np.float64)
        best = s.argmax(1)
        p = 1 / np.exp(s - s.max(1, keepdims=True)).sum(1)
        has = r.column(1).to_numpy(zero_copy_only=False)
        names = np.array([*m.langs, "und"], object)[np.where(has, best, len(m.langs))]
        return pa.RecordBatch.from_arrays([r.column(0), pa.array(names, pa.string()), pa.array(np.where(has, np.round(p, 6), 0.0))], names=[key, "lang_pred", "score"])

    return stream(docs, [F.col(key), letter.alias("_has"), F.coalesce(F.col(text), F.lit("")).alias("_text")], run, f"`{key}` {kind}, lang_pred string, score double", limit=2_000_000)


def labelled(docs: DataFrame, model: Model | None, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with lang replaced by the prediction, in one pass over whole rows; without a model only und (a null text, or one without a letter) is told, and the rest stays as it is."""
    if model is None:
        return docs.withColumn(lang, F.when(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)), F.col(lang)).otherwise("und"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rest = [c for c in docs.columns if c not in (text, lang)]

    def run(r: pa.RecordBatch, off: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        m = sent.value
        best = m.scores(off, data).argmax(1)
        has = r.column(r.num_columns - 2).to_numpy(zero_copy_only=False)
        names = np.array([*m.langs, "und"], object)[np.where(has, best, len(m.langs))]
        cols = [*[r.column(i) for i in range(r.num_columns - 2)], pa.array(names, pa.string()), r.column(r.num_columns - 1)]
        return pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])

    kinds = [docs.schema[c].dataType.simpleString() for c in rest] + ["string", "string"]
    out = stream(docs, [*rest, letter.alias("_has"), F.col(text)], run, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)), limit=2_000_000)
    return out.toDF(*rest, lang, text).select(*docs.columns)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def language_id(docs: DataFrame, **names) -> DataFrame:
    """(key, held_out, lang_pred, score): trained on the labelled rows whose crc32(key) mod 4 isn't 2, and predicted for all."""
    key = names.get("key", "doc_id")
    model = train(docs.where(~held_out(key)), **names)
    found = predict(docs, model, key=key, text=names.get("text", "text"))
    return found.select(key, held_out(key).alias("held_out"), "lang_pred", "score")
