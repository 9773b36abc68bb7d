import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from marginalia.llm import bpe

from .helpers import odd_docs

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return bpe.Ranks(f.read())


@pytest.fixture(scope="module")
def other(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.ids, special_tokens={})


def encoded(ranks, texts):
    b = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(x) for x in b])])
    at, ids = ranks.encode(off, np.frombuffer(b"".join(b), np.uint8))
    return [ids[at[i] : at[i + 1]] for i in range(len(b))]


def test_pattern():
    assert bpe.PATTERN == P.PATTERN


def test_like_tiktoken(ranks, other):
    r = random.Random(3)
    letters = " \n\t'abcdersvtlmREVE19é中 \x1c\x85!?-\U0001f389ß́٣Ⅷ"
    texts = ["", "don't we'll 'really ''s 's  'x\n\n  y \n", "  ", "x" * 30_000, "ab" * 9_000, "<|endoftext|>", " 's'sss'd", "a" * 5 + "  b"]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    for t, ids in zip(texts, encoded(ranks, texts), strict=True):
        assert other.encode_ordinary(t) == ids.tolist(), t[:80]
        assert ranks.decode(ids).tobytes() == t.encode()


def test_bitmap():
    b, s, r = bpe.Bitmap(50_000), set(), random.Random(1)
    for _ in range(3000):
        x = r.randrange(50_000)
        (b.add if r.random() < 0.6 else b.discard)(x)
        (s.add if x in s or b.low[x >> 6] >> (x & 63) & 1 else s.discard)(x) if b.low[x >> 6] >> (x & 63) & 1 else s.discard(x)
        assert b.least() == min(s, default=-1)


def test_query_columns(spark, other):
    docs = odd_docs(spark)
    got = bpe.bpe_digest(docs, PATH).collect()
    want = []
    for row in docs.collect():
        ids = other.encode_ordinary(row.text or "")
        want.append((row.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((row.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    full = bpe.bpe_encode(docs, PATH).collect()
    assert all(len(r.ids) == n for r, (_, n, *_) in zip(sorted(full, key=lambda r: str((r.doc_id, len(r.ids)))), sorted(want, key=lambda w: str((w[0], w[1]))), strict=True))
    assert bpe.bpe_digest(docs.limit(0), PATH).count() == 0
