import re

from marginalia.llm import licenses as L

from .helpers import odd_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    ws = WORD.findall(low)
    hits = [(i, v) for p, v in L.BASE.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    return len(ws), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({v for _, v in hits}))


TEXTS = [
    "Released under the MIT License.",
    "mit -- LICENSE\n\napache\tlicense, GNU General Public License; mit license mit license",
    "MIT",
    "License",
    None,
    "",
    "admit license mit licenses",
    "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception\nmore",
    "// SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */",
    "License: BSD-3-Clause",
    "Licensed under CC BY-NC 4.0.",
    "GNU Lesser General Public License",
    "é mit license ü",
    "x " * 100_000 + "mit license",
    "license identifier spdx license identifier nonsense",
]


def test_against_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in L.license_digest(L.license_scan(docs)).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[7].labels == "apache,gpl,mit" and got[7].permissive is True
    assert got[8].labels == "gpl" and got[8].permissive is False and "WITH" in got[8].expression
    assert got[9].labels == "bsd" and got[10].labels == "cc-by-nc" and got[11].labels == "gpl,lgpl" and got[14].labels == ""


def test_shunting_yard():
    show = lambda s: L.written_out(L.parse(s))
    assert show("mit or gpl-3.0 and apache-2.0") == "mit OR gpl-3.0 AND apache-2.0"
    assert show("(MIT OR GPL-3.0) AND BSD") == "(MIT OR GPL-3.0) AND BSD"
    assert show("MIT AND (") == "MIT" and show("MIT) AND BSD") == "MIT" and L.parse("AND MIT") is None and L.parse("") is None
    assert L.evaluate(L.parse("GPL-3.0 OR MIT")) and not L.evaluate(L.parse("GPL-3.0 AND MIT")) and not L.evaluate(L.parse("GPL-2.0 WITH x OR AGPL-3.0"))
    assert L.ids_of(L.parse("GPL-2.0 WITH classpath AND MIT")) == ["GPL-2.0", "MIT"]


def test_odd(spark):
    assert L.license_digest(L.license_scan(odd_docs(spark))).count() == 12
    assert L.license_scan(odd_docs(spark).limit(0)).count() == 0


def test_spdx_tags_keep_ids_of_no_family(spark):
    texts = ["SPDX-License-Identifier: CDDL-1.0", "# SPDX-License-Identifier: MIT AND LicenseRef-Own", "SPDX-License-Identifier: PSF-2.0\nmore", "License: unknown to us", "SPDX-License-Identifier: NONE", "SPDX-License-Identifier: EUPL-1.2 OR WTFPL"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score, r.expression, r.permissive) for r in L.license_digest(L.license_scan(docs)).collect()}
    assert got[0] == ("cddl-1.0", 0.95, "CDDL-1.0", False)
    assert got[1] == ("licenseref-own,mit", 0.9975, "MIT AND LicenseRef-Own", False)
    assert got[2] == ("psf-2.0", 0.95, "PSF-2.0", True)
    assert got[3] == got[4] == ("", 0.0, None, None)
    assert got[5] == ("eupl-1.2,wtfpl", 0.9975, "EUPL-1.2 OR WTFPL", True)


def test_phrases_of_a_caller_are_taken_as_texts_are(spark):
    d = spark.createDataFrame([(1, "Sous Licence Publique GÉNÉRALE ou licence publique générale."), (2, "The FOO Licence, or foo-licence")], "doc_id long, text string")
    got = {r.doc_id: [h.label for h in r.hits] for r in L.license_scan(d, notices={"licence publique générale": "lpg", "Foo Licence": "foo", " .. ": "none"}).collect()}
    assert got == {1: ["lpg"], 2: ["foo", "foo"]}
