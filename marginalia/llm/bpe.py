"""Byte-level BPE: pre-tokens found by whole-array rules, merged through a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, span_hash, stream

#: The pattern that split_points() follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SPACE, LETTER, NUMBER, OTHER = range(4)
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point."""
    if not _classes:
        import regex

        t = np.full(0x110000, OTHER, np.uint8)
        points = [*range(0xD800), *range(0xE000, 0x110000)]
        every, at = "".join(map(chr, points)), np.array(points)
        for name, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
            for m in regex.finditer(name, every):
                t[at[m.start() : m.end()]] = c
        t[_WHITE] = SPACE
        _classes.append(t)
    return _classes[0]


def split_points(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where a pre-token starts: cp holds the code points of texts end to end, first is true where a text starts."""
    n = len(cp)
    c = classes()[cp]
    prev, nxt = np.empty_like(c), np.empty_like(c)
    prev[1:], nxt[:-1] = c[:-1], c[1:]
    prev[:1] = nxt[-1:] = 9
    prev[first] = 9
    last = np.empty(n, bool)
    last[:-1], last[-1:] = first[1:], True
    nxt[last] = 9
    after_blank = np.zeros(n, bool)  # a space before it belongs to it
    after_blank[1:] = cp[:-1] == 32
    after_blank &= prev == SPACE
    white = c == SPACE
    start = np.where(white, (prev != SPACE) | ((nxt != SPACE) & (nxt != 9)), (c != prev) & ~after_blank)
    # contractions, where an apostrophe starts a pre-token and letters follow it
    for i in np.flatnonzero((cp == 39) & start & (nxt == LETTER)):
        a = cp[i + 1]
        if a in (115, 116, 109, 100):  # s t m d
            k = 2
        elif i + 2 < n and not last[i + 1] and (a, cp[i + 2]) in ((114, 101), (118, 101), (108, 108)):  # re ve ll
            k = 3
        else:
            continue
        start[i + 1] = False
        if i + k < n:
            start[i + k] = True
    return start


class Bitmap:
    """A set of integers below 64**3: three levels of 64-bit words, the least member by find-first-set."""

    def __init__(self, size: int):
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.top = 0

    def add(self, x: int) -> None:
        a, b = x >> 6, x >> 12
        self.low[a] |= 1 << (x & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def discard(self, x: int) -> None:
        a, b = x >> 6, x >> 12
        self.low[a] &= ~(1 << (x & 63))
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)

    def least(self) -> int:
        """-1 if empty."""
        if not self.top:
            return -1
        b = (self.top & -self.top).bit_length() - 1
        m = self.mid[b]
        a = b << 6 | ((m & -m).bit_length() - 1)
        w = self.low[a]
        return a << 6 | ((w & -w).bit_length() - 1)


class Ranks:
    """A vocabulary: merge ranks by token, and for two ids the rank of what they join to."""

    def __init__(self, text: bytes):
        self.ids = {base64.b64decode(a): int(b) for a, b in (x.split() for x in text.splitlines() if x.strip())}
        size = max(self.ids.values()) + 1
        self.tokens = [b""] * size
        for t, i in self.ids.items():
            self.tokens[i] = t
        self.byte_id = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.byte_id < 0).any():
            raise ValueError("a byte-level vocabulary has all 256 bytes")
        self.joined: dict[int, int] = {}
        for t, i in self.ids.items():
            for k in range(1, len(t)):
                a, b = self.ids.get(t[:k]), self.ids.get(t[k:])
                if a is not None and b is not None:
                    self.joined[a << 32 | b] = i
        self.first = np.full(65536, -1, np.int64)
        for a in range(256):
            for b in range(256):
                self.first[a << 8 | b] = self.joined.get(int(self.byte_id[a]) << 32 | int(self.byte_id[b]), -1)
        self.size = size
        lens = np.array([len(t) for t in self.tokens], np.int64)
        self.token_len, self.token_off = lens, np.concatenate([[0], np.cumsum(lens)])
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.cache: dict[bytes, bytes] = {}

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, all words through one rank queue.

        The words lie end to end in one linked list whose links don't cross their ends. A bucket per
        rank holds the positions of pairs with that rank; the bitmap gives the least rank with a
        bucket; its positions are taken from the left, and those whose pair has changed since are
        stale and skipped. Merges in different words don't touch, so each word sees its own least
        rank first, leftmost first, as if it were alone: some n log n steps however long a word is.
        """
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        if not n:
            return [np.empty(0, np.uint32) for _ in words]
        ends = np.cumsum([len(w) for w in words])
        pair = np.full(n, -1, np.int64)
        pair[:-1] = self.first[data[:-1].astype(np.int64) << 8 | data[1:]]
        pair[ends[ends > 0] - 1] = -1  # no pair goes beyond a word's end
        right = np.arange(1, n + 1)
        right[ends[ends > 0] - 1] = n  # n: none
        left = np.arange(-1, n - 1)
        starts = ends - [len(w) for w in words]
        left[starts[starts < n]] = n
        ids, nxt, prv, rank = self.byte_id[data].tolist(), right.tolist(), left.tolist(), pair.tolist()
        rank.append(-1)
        order = np.argsort(pair, kind="stable")
        order = order[np.searchsorted(pair[order], 0) :]
        cuts = np.flatnonzero(np.diff(pair[order], prepend=-1))
        buckets: dict[int, list[int]] = {}
        queue = Bitmap(self.size)
        for r, b in zip(pair[order][cuts].tolist(), np.split(order, cuts[1:]), strict=True) if len(cuts) else ():
            buckets[r] = b.tolist()
            queue.add(r)
        joined, add, least, discard = self.joined.get, queue.add, queue.least, queue.discard
        while (r := least()) >= 0:
            places = buckets.pop(r)
            discard(r)
            places.sort()
            for i in places:
                if rank[i] != r:
                    continue  # stale
                j = nxt[i]
                ids[i], rank[j] = r, -1
                ids[j] = -1
                k = nxt[i] = nxt[j]
                if k != n:
                    prv[k] = i
                    q = rank[i] = joined(r << 32 | ids[k], -1)
                    if q >= 0:
                        if q in buckets:
                            buckets[q].append(i)
                        else:
                            buckets[q] = [i]
                            add(q)
                else:
                    rank[i] = -1
                h = prv[i]
                if h != n:
                    q = rank[h] = joined(ids[h] << 32 | r, -1)
                    if q >= 0:
                        if q in buckets:
                            buckets[q].append(h)
                        else:
                            buckets[q] = [h]
                            add(q)
        flat = np.array(ids, np.int64)
        alive = flat >= 0
        n_alive = np.concatenate([[0], np.cumsum(alive)])
        flat = flat[alive].astype(np.uint32)
        return [flat[a:b] for a, b in zip(n_alive[starts], n_alive[ends], strict=True)]

    def encode_all(self, words: list[bytes], keep: int = 500_000) -> list[bytes]:
        """The ids of distinct words as 32-bit integers: a word that is a token is that token, others are merged; short ones are remembered, some `keep` of them."""
        cache, whole = self.cache, self.ids
        if len(cache) > keep:
            cache.clear()
        out: list = [None] * len(words)
        todo = []
        for i, w in enumerate(words):
            got = cache.get(w)
            if got is None:
                if (t := whole.get(w)) is not None:
                    got = t.to_bytes(4, "little")
                else:
                    todo.append(i)
            out[i] = got
        if todo:
            for i, made in zip(todo, self.merge([words[i] for i in todo]), strict=True):
                out[i] = ids = made.astype("<u4").tobytes()
                if len(words[i]) <= 64:
                    cache[words[i]] = ids
        return out

    def encode(self, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of texts that lie end to end in UTF-8."""
        n = len(off) - 1
        if not len(data):
            return np.zeros(n + 1, np.int64), np.empty(0, np.uint32)
        head = (data & 0xC0) != 0x80
        cp = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        byte_at = np.flatnonzero(head)
        first = np.zeros(len(data) + 1, bool)
        first[off[:-1]] = True
        start = byte_at[split_points(cp, first[byte_at])]
        end = np.append(start[1:], len(data))
        # equal pre-tokens: two polynomial hashes of each, from running sums, and the length
        keys = [span_hash(data, start, end, base) for base in BASES]
        _, rep, inv = np.unique(keys[0] ^ ((end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), return_index=True, return_inverse=True)
        if (keys[1][rep][inv] != keys[1]).any():  # a collision: tell the texts apart by themselves
            raw = data.tobytes()
            names: dict[bytes, int] = {}
            inv = np.array([names.setdefault(raw[a:b], len(names)) for a, b in zip(start, end, strict=True)])
            words = list(names)
        else:
            raw = data.tobytes()
            words = [raw[a:b] for a, b in zip(start[rep].tolist(), end[rep].tolist(), strict=True)]
        coded = self.encode_all(words)
        lens = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        at = np.concatenate([[0], np.cumsum(lens)])
        flat = np.frombuffer(b"".join(coded), "<u4")
        ids = flat[_ranges(at[inv], lens[inv])]
        upto = np.concatenate([[0], np.cumsum(lens[inv])])
        return upto[np.searchsorted(start, off)], ids

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        return self.token_bytes[_ranges(self.token_off[ids], self.token_len[ids])]


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (length[0] of them), then the same for the next."""
    total = np.cumsum(length)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - length), length)


_loaded: dict[str, Ranks] = {}


def bpe_encode(docs: DataFrame, ranks_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded): the ids of each whole text, and the bytes that the ids decode to.

    ranks_path: lines of a base64 token and its rank; the driver reads it and sends it to the
    executors once (its size is that of the vocabulary, whatever the documents). Special tokens
    are ordinary text. A null or empty text has no ids and no bytes; repeated rows and null keys
    are each encoded; columns other than key and text are not read. One pass without a shuffle.
    """
    return _map(docs, ranks_path, key, text, [("ids", "array<long>"), ("decoded", "binary")], False)


def bpe_digest(docs: DataFrame, ranks_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of bpe_encode: hashes of the ids as little-endian unsigned 32-bit integers, and of the decoded bytes."""
    return _map(docs, ranks_path, key, text, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], True)


def _map(docs: DataFrame, path: str, key: str, text: str, out: list[tuple[str, str]], digest: bool) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    with open(path, "rb") as f:
        raw = f.read()
    if len(raw) > 64_000_000:
        raise ValueError("a vocabulary file of more than 64 MB isn't sent to executors")
    sent, name = sc.broadcast(raw), hashlib.sha256(raw).hexdigest()

    def run(r: pa.RecordBatch, off: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        t = ranks_of(name, sent)
        at, ids = t.encode(off, data)
        back = t.decode(ids)
        ends = np.concatenate([[0], np.cumsum(t.token_len[ids])])[at]
        if digest:
            i, b = memoryview(ids.astype("<u4").tobytes()), memoryview(back.tobytes())
            sha = lambda v, o: pa.array([hashlib.sha256(v[x:y]).hexdigest() for x, y in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)], pa.string())
            cols = [pa.array(np.diff(at)), sha(i, at * 4), sha(b, ends)]
        else:
            cols = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int64))), pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(back.tobytes())])]
        return pa.RecordBatch.from_arrays([r.column(0), *cols], names=[key, *[c for c, _ in out]])

    kind = docs.schema[key].dataType.simpleString()
    return stream(docs, [F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text")], run, ", ".join([f"`{key}` {kind}", *[f"{c} {k}" for c, k in out]]), limit=1_000_000)


def ranks_of(name: str, sent) -> Ranks:
    """The vocabulary of a broadcast file, built once for each worker process and kept with its remembered words."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Ranks(sent.value)
    return _loaded[name]
