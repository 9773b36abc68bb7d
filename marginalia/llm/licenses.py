"""License scans: an Aho-Corasick automaton over word streams, and a shunting-yard parser for licence expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stream

#: Phrases that a caller's base scan counts.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notice phrases that the method adds.
NOTICES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "apache software license": "apache",
    "mit licence": "mit",
    "apache licence": "apache",
    "general public licence": "gpl",
    "creative commons": "cc",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
}

#: Words before a licence expression; the second needs a colon.
TAGS = {"spdx license identifier": False, "license": True, "licence": True}

FAMILIES = ["mit", "apache", "lgpl", "agpl", "gpl", "bsd", "mpl", "epl", "isc", "cc0", "cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nc", "cc-by-nd", "cc-by-sa", "cc-by", "unlicense", "zlib", "bsl"]
PERMISSIVE = {"mit", "apache", "bsd", "isc", "cc0", "cc-by", "unlicense", "zlib", "bsl", "public-domain"}
#: Permissive ids outside the families, lower-cased.
PERMISSIVE |= {"0bsd", "afl-3.0", "artistic-2.0", "blueoak-1.0.0", "ncsa", "postgresql", "psf-2.0", "python-2.0", "unicode-3.0", "unicode-dfs-2016", "upl-1.0", "wtfpl", "x11"}
#: What an SPDX tag says where there is no licence.
NO_IDS = {"none", "noassertion"}
WEIGHT = {"tag": 0.95, "base": 0.9, "notice": 0.7}

#: Words of the scan: after lower-casing A-Z, runs of digits, a-z and everything beyond ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def family(licence_id: str) -> str | None:
    s = licence_id.lower()
    if s == "boost" or s.startswith("bsl-1"):
        return "bsl"
    return next((f for f in FAMILIES if s == f or s.startswith(f + "-") or s == f + "+"), None)


def label_of(licence_id: str) -> str:
    """The family of an id, or the lower-cased id where it belongs to none."""
    return family(licence_id) or licence_id.lower()


def parse(text: str) -> list[tuple[str, str]] | None:
    """The licence expression at the start of text in postfix order: ("id", x) and ("op", and/or/with); None if there is none.

    Shunting-yard: with binds closest, then and, then or; all are left-associative and any case.
    Reading stops before the first token that can't go on a valid expression; one that is still
    open there (a missing operand or bracket) is cut back to its longest complete start.
    """
    out: list[tuple[str, str]] = []
    ops: list[str] = []
    best, operand, at = None, True, 0
    while True:
        while at < len(text) and text[at] in " \t":
            at += 1
        m = _TOKEN.match(text, at)
        if not m:
            break
        t, low = m[0], m[0].lower()
        if operand:
            if t == "(":
                ops.append(t)
            elif t == ")" or low in _RANK:
                break
            else:
                out.append(("id", t.rstrip(".:")))
                operand = False
        elif t == ")":
            while ops and ops[-1] != "(":
                out.append(("op", ops.pop()))
            if not ops:
                break
            ops.pop()
        elif low in _RANK:
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[low]:
                out.append(("op", ops.pop()))
            ops.append(low)
            operand = True
        else:
            break
        at = m.end()
        if not operand and "(" not in ops:
            best = out + [("op", o) for o in reversed(ops)]
    return best


def evaluate(postfix: list[tuple[str, str]], permissive=PERMISSIVE) -> bool:
    """Whether a choice that the expression grants is permissive: or needs one side, and both; with keeps its licence's value. Ids that `permissive` doesn't hold, as a family or lower-cased, aren't."""
    stack: list[bool] = []
    for kind, x in postfix:
        if kind == "id":
            stack.append(label_of(x) in permissive)
        else:
            b, a = stack.pop(), stack.pop()
            stack.append(a or b if x == "or" else a and b if x == "and" else a)
    return stack[-1]


def written_out(postfix: list[tuple[str, str]]) -> str:
    stack: list[tuple[str, int]] = []
    for kind, x in postfix:
        if kind == "id":
            stack.append((x, 9))
        else:
            (b, rb), (a, ra) = stack.pop(), stack.pop()
            r = _RANK[x]
            stack.append((f"{a if ra >= r else f'({a})'} {x.upper()} {b if rb > r else f'({b})'}", r))
    return stack[-1][0]


def ids_of(postfix: list[tuple[str, str]]) -> list[str]:
    """Licence ids, without the exceptions that follow with."""
    stack: list[list[str]] = []
    for kind, x in postfix:
        if kind == "id":
            stack.append([x])
        else:
            b, a = stack.pop(), stack.pop()
            stack.append(a if x == "with" else a + b)
    return stack[-1]


def license_scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", base: Mapping[str, str] = BASE, notices: Mapping[str, str] = NOTICES) -> DataFrame:
    """(key, n_words, hits, expression, permissive) for each row of docs, from its whole text.

    hits: array of (kind, label, word), in the order of their words: each place where the words of
    a base phrase ("base") or notice phrase ("notice"; of overlapping ones that start together the
    longest) stand consecutively, whatever stands between them, and each licence id ("tag") of a
    licence expression that follows a tag on its line. After "SPDX-License-Identifier:" every id counts, labelled by
    its family, or lower-cased without one; after a bare "license:", or an SPDX tag without its colon, where prose may
    follow, only expressions with an id of a known family, and of these the known ids. expression: the first such
    expression; permissive: its value (evaluate), null without one.

    A null text counts as empty: no words, no hits. Repeated rows and keys are each scanned, rows
    with a null key too. Columns other than key and text are not read. One pass without a
    shuffle; a text of any length is one slice, others go in slices of some 4 MB.
    """
    import ahocorasick

    rows = [*[(p, "base", v) for p, v in base.items()], *[(p, "notice", v) for p, v in notices.items()], *[(p, "tag", "") for p in TAGS]]
    by: dict[str, list] = {}
    for p, kind, v in rows:
        if words := "".join(chr(c) if WORD[c] else " " for c in LOWER[np.frombuffer(p.encode(), np.uint8)].tolist()).split(" "):  # as the stream has them: bytes, lower-cased
            by.setdefault(f" {' '.join(w for w in words if w)} ", []).append((kind, v))
    by.pop("  ", None)  # a phrase without words
    needs_colon = {f" {p} ": c for p, c in TAGS.items()}
    automaton: list = []

    def scan(r: pa.RecordBatch, off: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        if not automaton:
            a = ahocorasick.Automaton()
            for p, v in by.items():
                a.add_word(p, (p, v))
            a.make_automaton()
            automaton.append(a)
        n = len(off) - 1
        low = LOWER[data]
        word = WORD[low]
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[:1] = False
        first = np.zeros(len(data) + 1, bool)
        first[off[:-1]] = True
        first = first[:-1]
        start = word & (~before | first)
        count = np.zeros(len(data) + 1, np.int64)
        np.cumsum(start, out=count[1:])
        words = count[off[1:]] - count[off[:-1]]
        # the words with one space between them; a doc that starts a word next to another's end is told apart below
        gap = ~word & before
        keep = np.flatnonzero(word | gap)
        stream_ = np.where(word[keep], low[keep], np.uint8(32))
        glued = np.flatnonzero(start & before)  # a doc's first word right after the last doc's last one
        if len(glued):
            at = np.searchsorted(keep, glued)
            stream_, keep = np.insert(stream_, at, 32), np.insert(keep, at, glued)
        s = " " + stream_.tobytes().decode("latin-1") + " "
        hits: dict[int, list] = {}
        tags: dict[int, list] = {}
        ends = np.append(keep, [len(data), len(data)])
        for end, (p, what) in automaton[0].iter(s):
            b = int(keep[end - len(p) + 1])  # the byte of its first word's start: s has one space more in front
            e = int(keep[end - 2]) + 1  # one past its last byte
            d = int(np.searchsorted(off, b, "right")) - 1
            if e > off[d + 1]:
                continue
            w = int(count[b] - count[off[d]])
            for kind, label in what:
                if kind == "tag":
                    tags.setdefault(d, []).append((e, w, needs_colon[p]))
                else:
                    hits.setdefault(d, []).append((w, kind, label, len(p)))
        kinds, labels, places, lens, exprs, oks = [], [], [], np.zeros(n, np.int64), [None] * n, [None] * n
        for d in sorted(hits.keys() | tags.keys()):
            found = hits.get(d, [])
            longest = {}
            for w, kind, label, size in found:
                if kind == "notice":
                    longest[w] = max(longest.get(w, 0), size)
            out = [(w, kind, label) for w, kind, label, size in found if kind == "base" or size == longest[w]]
            for e, w, colon in sorted(tags.get(d, [])):
                raw = data[e : off[d + 1]].tobytes()
                line = raw.split(b"\n", 1)[0].split(b"\r", 1)[0].decode("utf-8", "replace")
                marked = bool(re.match(r"[ \t]*:", line))
                if colon and not marked:
                    continue
                x = parse(line.lstrip(" \t:"))
                ids = ids_of(x) if x else []
                known = [label_of(i) for i in ids if i.lower() not in NO_IDS] if marked and not colon else [family(i) for i in ids]
                if not any(known):
                    continue
                if exprs[d] is None:
                    exprs[d], oks[d] = written_out(x), evaluate(x)
                out += [(w, "tag", f) for f in known if f]
            out = sorted(set(out))
            lens[d] = len(out)
            for w, kind, label in out:
                places.append(w)
                kinds.append(kind)
                labels.append(label)
        struct = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(labels, pa.string()), pa.array(places, pa.int64())], ["kind", "label", "word"])
        cuts = pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32())
        return pa.RecordBatch.from_arrays([r.column(0), pa.array(words), pa.ListArray.from_arrays(cuts, struct), pa.array(exprs, pa.string()), pa.array(oks, pa.bool_())], names=[key, "n_words", "hits", "expression", "permissive"])

    kind = docs.schema[key].dataType.simpleString()
    return stream(docs, [F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text")], scan, f"`{key}` {kind}, n_words long, hits array<struct<kind:string,label:string,word:long>>, expression string, permissive boolean")


def license_digest(scan: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, expression, permissive) of license_scan.

    score: 1 minus the product of (1 - weight) over the distinct (kind, label) found, 0 with none.
    """
    base = F.filter("hits", lambda h: h.kind == "base")
    joined = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h.label))), ",")
    seen = F.array_distinct(F.transform("hits", lambda h: F.struct(h.kind.alias("kind"), h.label.alias("label"))))
    # products of floating numbers depend on their order, so each kind is a power of its count
    power = F.lit(1.0)
    for name, w in sorted(WEIGHT.items()):
        kinds = F.array_remove(F.transform(seen, lambda h: F.when(h.kind == F.lit(name), 1).otherwise(0)), 0)  # noqa: B023  called at once
        power = power * F.pow(F.lit(1.0 - w), F.size(kinds))
    return scan.select(
        key,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h.word)).alias("first_word"),
        F.array_max(F.transform(base, lambda h: h.word)).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("hits")).alias("labels"),
        F.round(1.0 - power, 6).alias("score"),
        "expression",
        "permissive",
    )
