import random
import re

import numpy as np
import pytest

from marginalia.llm import ngrams

from .helpers import components, odd_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, n=3):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs, t=0.5):
    sets = [(i, grams(x)) for i, x in docs]
    links = [[a for a in range(len(sets)) if a != b and sets[a][1] and sets[b][1] and len(sets[a][1] & sets[b][1]) >= t * len(sets[a][1] | sets[b][1]) - 1e-9] for b in range(len(sets))]
    comp = components([i for i, _ in sets], [(sets[a][0], sets[b][0]) for b in range(len(sets)) for a in links[b]])
    return {i: (len(links[k]), comp[i]) for k, (i, _) in enumerate(sets)}


def corpus(n=90, seed=2):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    docs = []
    for k in range(n // 6):
        base = [word() for _ in range(r.choice([2, 5, 60, 200]))]
        for v in range(6):
            w = list(base)
            for _ in range(v * len(w) // 60):
                w[r.randrange(len(w))] = word()
            docs.append((6 * k + v, " ".join(w).upper() if v == 1 else ", ".join(w)))
    return docs


def test_links_and_components_are_those_of_all_pairs(spark):
    docs = corpus()
    got = {r.doc_id: (r.n_links, r.class_id) for r in ngrams.ngram_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_hot_groups_in_blocks(spark):
    r = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(120):
        w = list(base)
        w[r.randrange(150)] = f"z{i % 60}"  # half of them are copies of others
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, " ".join(base)) for i in range(30)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    for block in (16, 512):
        got = {x.doc_id: (x.n_links, x.class_id) for x in ngrams.ngram_join(d, block=block).collect()}
        assert got == want


def test_prefixes_are_shortened_until_the_recall_is_measured():
    k = ngrams.prefix_depth(0.5, 36, 0.99)
    assert k == 3 and ngrams.prefix_depth(0.9, 36, 0.99) == 4 and ngrams.prefix_depth(0.5, 36, 0.9999) < 3
    with pytest.raises(ValueError):
        ngrams.prefix_depth(0.02, 4, 0.99)


def test_recall_of_pairs_at_the_threshold(spark):
    r = random.Random(5)
    docs = []
    for k in range(400):  # 60 words, and 20 others for 20 of them: 40 common 3-grams (41 less the one that is cut) of 80
        w = [f"{k}x{r.randrange(10**9)}" for _ in range(62)]
        v = w[:42] + [f"{k}y{r.randrange(10**9)}" for _ in range(20)]
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    assert len(grams(docs[0][1]) & grams(docs[1][1])) * 2 == len(grams(docs[0][1]) | grams(docs[1][1]))
    got = ngrams.ngram_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sum(x.n_links for x in got) / 800 >= 0.97 and all(x.class_id // 2 == x.doc_id // 2 for x in got)


def test_shingles():
    docs = [b"one two three four five", b"one", b"", b"five four"]
    off = np.concatenate([[0], np.cumsum([len(x) for x in docs])])
    g, at, c = ngrams.shingles(off, np.frombuffer(b"".join(docs), np.uint8), 3)
    assert np.diff(at).tolist() == [3, 1, 0, 1] and len(set(c[0].tolist())) == 4 and len(set(g.tolist())) == 5


def test_odd(spark):
    d = odd_docs(spark)
    got = ngrams.ngram_join(d).collect()
    assert len(got) == 12
    by = {r.doc_id: r for r in got}
    assert by[1].n_links == 3 and by[6].n_links == 3 and by[6].class_id == 1 and not by[6].kept and by[1].kept
    assert by[3].n_links == 0 and by[3].kept and by[None].kept and by[None].class_id is None
    assert ngrams.ngram_join(d.limit(0)).count() == 0


def test_large_parts_with_few_links_are_not_compared_pair_by_pair(monkeypatch):
    r = np.random.default_rng(4)
    common = r.integers(0, 2**62, 40)
    sets = [np.unique(np.concatenate([r.choice(common, 12, replace=False), r.integers(0, 2**62, r.integers(14, 40))])) for _ in range(3000)]  # alike, but none at the threshold
    sets += [np.unique(np.append(s[2:], r.integers(0, 2**62, 2))) for s in sets[:200]]
    base = r.integers(0, 2**62, 150)
    sets += [np.unique(np.append(r.choice(base, 130, replace=False), r.integers(0, 2**62, 9))) for _ in range(700)]  # near copies of one another
    r.shuffle(sets)
    size = np.array([len(s) for s in sets])
    flat, at = np.concatenate(sets), np.concatenate([[0], np.cumsum(size)])
    both = ngrams.overlaps(flat, size)
    want = np.triu(both >= 0.5 * (size[:, None] + size - both) - 1e-9, 1)
    cells, real = [], ngrams.overlaps
    monkeypatch.setattr(ngrams, "overlaps", lambda f, s: cells.append(len(s) ** 2) or real(f, s))
    for sides in (None, r.integers(3, 5, len(sets))):
        cells.clear()
        got = np.concatenate([np.stack(p) for p in ngrams.similar(flat, at, sides, 0.5, room=5000)], axis=1)
        got = got if sides is None else got[:, sides[got[0]] != sides[got[1]]]
        found = [(min(i, j), max(i, j)) for i, j in got.T.tolist()]
        i, j = np.nonzero(want if sides is None else want & (sides[:, None] != sides))
        assert sorted(found) == list(zip(i.tolist(), j.tolist(), strict=True)) and len(found) > 100_000
        assert sum(cells) < 0.15 * len(sets) ** 2


def test_parts_in_blocks_of_grams(spark):
    r = random.Random(6)
    docs = [(i, " ".join(f"c{r.randrange(4)}" for _ in range(5)) + " " + " ".join(f"w{r.randrange(10**6)}" for _ in range(r.choice([1, 3, 300])))) for i in range(300)]
    docs += [(1000 + i, x + " more") for i, (_, x) in enumerate(docs)]
    for block in (1, 512):
        got = {x.doc_id: (x.n_links, x.class_id) for x in ngrams.ngram_join(spark.createDataFrame(docs, "doc_id long, text string"), block=block).collect()}
        assert sum(got[i][0] > 0 for i, _ in docs) >= 500 and got == brute(docs)
