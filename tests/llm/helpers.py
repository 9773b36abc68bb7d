"""Odd documents that every operator has to take, and brute-force twins."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, kept int, block string, position string, score string, verdict string, hits int, entities int"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(20_000))
BASE = "the quick brown fox jumps over the lazy dog while seven other animals watch the whole scene from a distance"


def odd_docs(spark):
    rows = [
        (1, BASE, "en", "a"),
        (2, BASE.replace("quick", "slow"), "en", "a"),
        (3, None, "en", "b"),
        (4, "", None, None),
        (5, LONG, "en", "a"),
        (6, BASE, "en", "a"),
        (6, BASE, "en", "a"),
        (None, BASE, None, "b"),
        (8, "123 !!! \n\n \t", "de", "c"),
        (9, "short", "de", "a"),
        (10, "ein ganz anderer Satz über Käse und Brötchen\n" * 3, "de", "b"),
        (11, "é" * 50 + "\U0001f600 \x00 z", "fr", "a"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, "x", "x", "x", "x", 7, 7) for r in rows], SCHEMA)


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
