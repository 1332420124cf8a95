import hashlib

import pytest
from pyspark.sql import functions as F

from concord.llm.decontaminate import (
    build_index, contamination, phrase_windows, proximity_matches, vocabulary, without_benchmark, words,
)
from tests.llm.helpers import ODD, WORDS, documents, prose

ITEMS = [(1, prose(1, 30)), (2, "Five words are enough here"), (3, None), (4, "?!"), (5, "one"), (None, "an item without an id"), (6, prose(1, 30)[20:]), (10, prose(2, 10))]


def split(text):
    return [w.decode() for w in (text or "").encode().translate(WORDS).split()]


def plain(rows, items, size=10):
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for i, text in rows:
        w, hit, found = split(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[k] - {None}
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, bool(hit)))
    return out


def corpus():
    item = prose(1, 30).split()
    rows = [(i, prose(10 + i, 40)) for i in range(20)]
    rows += [(20, f"{prose(40, 9)} {' '.join(item[3:20]).upper()}!! {prose(41, 9)}"), (21, " ".join(item[:9])), (22, " - ".join(item[5:15]))]
    rows += [(23, "five WORDS are. enough; here five words are enough here"), (24, "one"), (25, "One, one; ONE"), (26, "an item without an id")]
    rows += [(30 + i, f"{i} " + prose(2, 10) + f" {i}") for i in range(40)]
    return [*rows, *ODD]


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").withColumns({"k": F.lit(1), "wid": F.lit(2), "doc_id": F.lit(3)})


@pytest.mark.parametrize("items", [ITEMS, [], [(7, "éa 日本 12 é")]])
def test_like_a_plain_search(spark, items):
    rows = corpus()
    docs = documents(spark, rows)
    out = sorted(map(tuple, contamination(docs, benchmark(spark, items)).collect()), key=str)
    want = plain(rows, items)
    assert out == sorted(want, key=str)
    left = without_benchmark(docs, benchmark(spark, items))
    assert left.columns == docs.columns and left.count() == sum(not r[5] for r in want)


def test_repeated_rows_are_hit_like_single_ones(spark):
    leak = f"{prose(40, 9)} {prose(2, 10)} {prose(41, 9)}"
    rows = [(1, leak), (1, leak), (1, leak), (None, leak), (None, leak), (2, leak), (3, prose(42, 30)), (3, prose(42, 30))]
    docs = documents(spark, rows)
    out = sorted(map(tuple, contamination(docs, benchmark(spark, ITEMS)).collect()), key=str)
    assert out == sorted(plain(rows, ITEMS), key=str) and sum(r[5] for r in out) == 6
    assert [r.doc_id for r in without_benchmark(docs, benchmark(spark, ITEMS)).collect()] == [3, 3]


def test_words_are_those_of_the_definition(spark):
    texts = ["A-b_c 1É é", None, "", "...", "ÄÖ\x7fx", "İ I ı"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.w for r in df.select(words(F.col("t")).alias("w")).collect()] == [split(t) for t in texts]


def test_proximity(spark):
    docs = documents(spark, [(1, "alpha x x beta y gamma"), (2, "alpha x x x x x x beta gamma"), (3, "gamma beta alpha"), (4, "alpha")])
    queries = spark.createDataFrame([(1, ["alpha", "beta"]), (2, ["alpha", "beta", "gamma"]), (3, ["alpha"])], "qid long, words array<string>")
    terms = vocabulary(queries.select(F.col("words").alias("window")))
    found = proximity_matches(build_index(docs, terms), terms, queries, 3)
    keys = {r.k: r.doc_id for r in docs.select(F.xxhash64("doc_id", "text").alias("k"), "doc_id").collect()}
    pairs = {(keys[r.k], r.qid) for r in found.collect()}
    assert pairs == {(1, 1), (3, 1), (3, 2), (1, 3), (2, 3), (3, 3), (4, 3)} | ({(1, 2)} & pairs)


def test_windows_of_items(spark):
    windows, of_items = phrase_windows(benchmark(spark, ITEMS), "item_id", "text", 10)
    assert sorted(len(r.window) for r in windows.collect())[:3] == [1, 5, 5]
    assert of_items.where("item = '1'").count() == 21


def test_empty_table(spark):
    assert contamination(documents(spark, []), benchmark(spark, ITEMS)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = contamination(documents(spark, [(1, "x")]), benchmark(spark, ITEMS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
