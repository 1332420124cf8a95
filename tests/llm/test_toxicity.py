import random
import zlib

import pytest
from pyspark.sql import functions as F

from concord.llm.toxicity import Restorer, count_trigrams, restorer_model, toxicity
from tests.llm.helpers import ODD, documents, prose

BAD = ["idiot", "moron", "worthless", "pathetic"]


def corpus():
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(400):
        words = prose(i % 150, 60, 300).split()
        toxic = i % 4 == 0
        if toxic:
            for w in rng.sample(BAD, 2):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    return rows, marks


def test_held_out_rows_and_disguises(spark):
    rows, marks = corpus()
    plain = prose(500, 40, 300)
    disguised = ["1d10t", "m0r0n", "i d i o t", "p.a.t.h.e.t.i.c", "w0rthl3ss", "idiooooot", "P4TH3T1C!", "m o r o n"]
    planted = [(1000 + i, f"{plain} {w} {plain}") for i, w in enumerate(disguised)]
    clean = [(1100, plain), (1101, plain + " 2024-05-01 $5.00 a b c 100% x1 v2"), (1102, "!!! ??? 12345 " + plain)]
    docs = documents(spark, [*rows, *planted, *clean, *ODD])
    labels = spark.createDataFrame([*marks, (None, 1), (3, None), (7, 9)], "doc_id long, toxic int").withColumn("lang", F.lit("clash"))
    found = {}
    for r in toxicity(docs, labels).collect():
        found[r.doc_id] = r
        want = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1
        assert r.held_out == want and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(found[i].predicted, y) for i, y in marks if found[i].held_out]
    assert all(p == y for p, y in held) and len(held) > 100
    assert all(found[i].predicted for i, _ in planted)
    assert not any(found[i].predicted for i, _ in [*clean, *((o[0], 0) for o in ODD)])


def test_restoration(spark):
    rows, _ = corpus()
    texts = documents(spark, rows).select(F.col("text").alias("x")).withColumnRenamed("x", "body")
    restore = Restorer(restorer_model(texts))
    for token, word in {"1d10t": "idiot", "m.o.r.o.n": "moron", "worthlesss": "worthless", "p@thet1c": "pathetic"}.items():
        assert word in restore[token]
    assert restore["plain"] == ("plain",) and restore["12345678"] == () and restore["..."] == ()
    assert restore.decode("") == "" and len(restore.decode("1" * 5000)) <= 5000


def test_trigrams_are_those_of_all_plain_words(spark):
    texts = spark.createDataFrame([("Ab ab, a1c",), ("aaab",), ("日本 ab",)], "body string")
    found = {r.gram: r.n for r in count_trigrams(texts).collect()}
    assert found == {"^^a": 3, "^ab": 3, "ab$": 3, "^^?": 1, "^??": 1, "??$": 1}


@pytest.mark.parametrize("marks", [[], [(1, 0)], [(0, 1), (1, 1)]])
def test_without_labels_of_both_classes(spark, marks):
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    out = toxicity(documents(spark, [(0, "x"), (1, None)]), labels).collect()
    assert len({r.score for r in out}) == 1 and len(out) == 2
    assert toxicity(documents(spark, []), labels).count() == 0
