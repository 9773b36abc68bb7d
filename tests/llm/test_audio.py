import numpy as np
from pyspark.sql import functions as F

from marginalia.llm import audio as A


def song(seed, notes=24, rate=2048):
    r = np.random.default_rng(seed)
    t = np.arange(rate // 2) / rate
    return np.concatenate([0.5 * np.sin(2 * np.pi * 220 * 2 ** (r.integers(12) / 12) * t) + 0.3 * np.sin(2 * np.pi * 440 * 2 ** (r.integers(12) / 12) * t) for _ in range(notes)])


def clips():
    r = np.random.default_rng(0)
    out = {}
    for k in range(12):
        s = song(k)
        out[10 * k] = s
        if k % 2 == 0:
            out[10 * k + 1] = s[2048 * 3 :]  # starts later
            out[10 * k + 2] = s + 0.01 * r.standard_normal(len(s))
            out[10 * k + 3] = s  # a copy
    return out


def test_alignment_like_brute_force(spark):
    c = clips()
    rows = [(k, A.encode_wav(0.9 * v, 2048), "x") for k, v in c.items()]
    rows += [(900, None, "x"), (901, b"", "x"), (902, b"RIFFnonsense", "x"), (903, A.encode_wav(np.zeros(9000), 2048), "x"), (904, A.encode_wav(song(1)[:100], 2048), "x"), (None, rows[0][1], "x")]
    prints = A.fingerprints(spark.createDataFrame(rows, "id long, audio binary, prints string"), key="id").cache()
    p = {r.id: np.array(r.prints, np.int64).astype(np.uint32) for r in prints.collect() if r.id is not None}
    assert all(len(p[k]) == 0 for k in range(900, 905))
    got = {r.id: r for r in A.search_audio(prints, F.coalesce(F.col("id") % 10 == 0, F.lit(False)), key="id").collect()}
    for q in [k for k in p if k % 10 == 0]:
        want = {}
        for m in p:
            if m != q and len(p[q]) and len(p[m]):
                least = min(6, len(np.unique(p[q])))
                if (a := A.align(p[q], p[m], 0.2)) and a[0] >= least:
                    want[m] = a
        assert got[q].n_matches == len(want), q
        if q < 900 and q % 20 == 0:
            assert set(want) == {q + 1, q + 2, q + 3} and got[q].best_id == q + 3 and got[q].best_ber == 0
            assert abs(A.align(p[q], p[q + 1], 0.2)[1] + 24) <= 1  # three seconds in frames of an eighth
        elif q < 900:
            assert not want and got[q].best_id is None


def test_wav_kinds():
    x = song(3)[:4000]
    rate, y = A.decode_wav(A.encode_wav(x * 0.9, 2048))
    assert rate == 2048 and np.abs(y - 0.9 * x).max() < 1e-3 and A.decode_wav(b"x") is None


def test_box_filters_against_plain_sums():
    r = np.random.default_rng(2)
    c = r.random((1, 12, 12))
    got, heard = A.packed(c)
    assert got.shape == (1, 12 - A.SPAN + 1) and heard.all()
    wide = np.concatenate([c[0], c[0]], 1)
    for t in range(got.shape[1]):
        bits = 0
        for kind, p, h, w in A.FILTERS:
            s = lambda t0, t1, p0, p1: wide[t + t0 : t + t1, p0:p1].sum()  # noqa: B023, E731
            if kind == "pitch":
                a, b = s(0, w, p, p + h // 2), s(0, w, p + h // 2, p + h)
            elif kind == "time":
                a, b = s(0, w // 2, p, p + h), s(w // 2, w, p, p + h)
            elif kind == "check":
                a, b = s(0, w // 2, p, p + h // 2) + s(w // 2, w, p + h // 2, p + h), s(0, w // 2, p + h // 2, p + h) + s(w // 2, w, p, p + h // 2)
            else:
                a, b = 2 * s(w // 3, 2 * w // 3, p, p + h), s(0, w // 3, p, p + h) + s(2 * w // 3, w, p, p + h)
            bits = bits << 2 | int(A.GRAY[np.digitize(np.log((0.3 + a) / (0.3 + b)), A.CUTS)])
        assert bits == int(got[0, t])


def test_sonified_and_empty(spark):
    v = spark.createDataFrame([(1, [0.1] * 64), (2, None), (3, [float("nan")] * 4), (4, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.audio for r in A.sonified(v).collect()}
    assert got[1] and got[4] and got[2] is None and got[3] is None
    e = A.fingerprints(A.sonified(v.limit(0)), key="vec_id")
    assert A.search_audio(e, F.col("vec_id") % 20 == 0, key="vec_id").count() == 0


def test_all_matches_are_returned(spark):
    c = clips()
    c[7] = c[0]  # one more copy
    prints = A.fingerprints(spark.createDataFrame([(k, A.encode_wav(0.9 * v, 2048)) for k, v in c.items()], "id long, audio binary"), key="id").cache()
    p = {r.id: np.array(r.prints, np.int64).astype(np.uint32) for r in prints.collect()}
    for r in A.search_audio(prints, F.col("id") % 10 == 0, key="id").collect():
        want = {}
        for m in p:
            if m != r.id and (a := A.align(p[r.id], p[m], 0.2)) and a[0] >= min(6, len(np.unique(p[r.id]))):
                want[m] = a
        got = {i: (m.hits, m.offset, m.ber) for m in r.matches for i in m.ids}
        assert got == want and sum(len(m.ids) for m in r.matches) == r.n_matches == len(want)
        assert [m.ber for m in r.matches] == sorted(m.ber for m in r.matches) and all(m.recording == min([*m.ids, r.id] if m.recording == r.recording else m.ids) for m in r.matches)
        assert r.best_id in r.matches[0].ids if r.matches else r.best_id is None


def test_long_recordings_and_24_bits(spark):
    import io
    import wave

    r, rate = np.random.default_rng(1), 4000
    x = np.concatenate([np.sin(2 * np.pi * f * np.arange(2000) / rate) for f in 220 * 2 ** (r.integers(0, 24, 120) / 12)]) * 0.5
    b = A.encode_wav(x, rate)
    rt, n, part = A.pcm(b)
    assert (rt, n) == (rate, len(x)) and np.abs(A.chroma_of(part, n, rt, frames=7) - A.chroma(part(0, n)[None], rate)).max() < 1e-4
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(3)
        w.setframerate(rate)
        v = np.repeat((x * 8388607).astype("<i4"), 2)
        w.writeframes(v.view(np.uint8).reshape(-1, 4)[:, :3].tobytes())
    assert np.abs(A.decode_wav(out.getvalue())[1] - x).max() < 1e-6
    d = spark.createDataFrame([(1, bytearray(b)), (2, bytearray(out.getvalue()))], "id long, audio binary")
    one, two = (r.prints for r in A.fingerprints(d, key="id").orderBy("id").collect())
    assert len(one) > 200 and np.mean(np.array(one) == np.array(two)) > 0.9
