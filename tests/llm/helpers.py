"""Small tables with awkward rows, and plain versions of what operators compute."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORDS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in LOWER)


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang); besides, columns whose names clash with those that operators use."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.withColumns({c: F.lit(c) for c in ("k", "c", "id", "n", "body", "tile", "spans", "root", "count")})


def prose(seed, words, size=200):
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(rng.randint(2, 8))) for _ in range(size)]
    return " ".join(rng.choice(stock) for _ in range(words))


def edited(text, seed, edits):
    rng, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
    return " ".join(words)


#: Nulls, empty, blank, one word, marks only, repeated rows, ids that are null or shared, a very long text without a gap.
ODD = [
    (900, None), (901, ""), (902, " \n\t "), (903, "word"), (904, "?!... --"), (905, "two words"), (905, "two words"),
    (None, "a text without an id"), (906, "ÄÖ É ﬁ 日本 🙂   é"), (907, "x" * 30_000), (908, "ab " * 5_000), (908, "another text of the same id"),
]


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
