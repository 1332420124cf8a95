import hashlib
import os
import random
import time

import numpy as np
import pytest

from concord.llm.suffix_dedup import anchors, dedup_report, remove_repeats
from concord.llm.suffix_sort import sorted_suffixes
from concord.session import scratch_root
from tests.llm.helpers import ODD, documents, prose


def plain_order(strings, cap):
    marks = [m for k, s in enumerate(strings) for m in [*((1, b) for b in s), (0, k)]]
    order = sorted(range(len(marks)), key=lambda i: marks[i : i + 200])
    common = [0] if order else []
    for a, b in zip(order, order[1:], strict=False):
        n = 0
        while n < cap and a + n < len(marks) and b + n < len(marks) and marks[a + n] == marks[b + n] and marks[a + n][0]:
            n += 1
        common.append(n)
    return order, common


@pytest.mark.parametrize("letters", [1, 2, 3, 26, 256])
def test_induced_order_and_common_prefixes(letters):
    rng = random.Random(letters)
    for _ in range(40):
        strings = [bytes(rng.randrange(letters) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 6))]
        strings += [strings[0][2:] + b"x", strings[0]] if strings and rng.random() < 0.5 else []
        for memory in (5, 10_000):  # nearly all queues on disk, or none
            order, common, _ = sorted_suffixes(strings, 10, memory)
            assert (order.tolist(), common.tolist()) == plain_order(strings, 10)


def plain_report(rows, length):
    rows = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, body in rows:
        if i is not None:
            for p in range(len(body) - length + 1):
                w = body[p : p + length]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, body in rows:
        mark = bytearray(len(body))
        if i is not None:
            for p in range(len(body) - length + 1):
                if least[body[p : p + length]] < i:
                    mark[p : p + length] = b"\1" * length
        kept = bytes(b for b, m in zip(body, mark, strict=True) if not m)
        runs = sum(m and not (p and mark[p - 1]) for p, m in enumerate(mark))
        out.append((i, len(body), len(body) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


def corpus():
    line = "This line stands in very many of the documents, word for word."
    rows = [(i, f"{prose(i, 30)} {line} {prose(1000 + i, 20)}") for i in range(1, 40)]
    rows += [(50 + i, prose(7, 60)) for i in range(30)]  # copies
    rows += [(100, "é" * 60), (101, "aé" + "é" * 58), (102, "%" * 300), (103, "%" * 120 + prose(8, 9)), (104, prose(7, 60)[11:-7])]
    return [*rows, *ODD]


@pytest.mark.parametrize("options", [{}, {"hot_from": 3}, {"broadcast_rows": 0}, {"hot_from": 3, "broadcast_rows": 0}])
def test_like_a_plain_search(spark, options):
    rows = corpus()
    found = sorted(map(tuple, dedup_report(documents(spark, rows).repartition(5), **options).collect()), key=str)
    assert found == sorted((r[:5] for r in plain_report(rows, 50)), key=str)


def test_texts_keep_whole_letters_and_columns(spark):
    rows = corpus()
    docs = documents(spark, rows)
    out = remove_repeats(docs)
    assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
    want = {}
    for (i, t), r in zip(rows, plain_report(rows, 50), strict=True):
        want.setdefault(i, []).append((t, r))
    for r in out.collect():
        choices = want[r.doc_id]
        assert any(
            r.text == t if t is None or not plain[2] else r.text.encode() == plain[5] or len(r.text.encode()) - len(plain[5]) < 4 * plain[3] + 1
            for t, plain in choices
        )
        assert r.id == "id" and r.spans == "spans"


def test_empty_table(spark):
    assert dedup_report(documents(spark, [])).count() == 0
    assert remove_repeats(documents(spark, [])).count() == 0


@pytest.mark.parametrize("options", [{}, {"hot_from": 3}, {"broadcast_rows": 0}, {"hot_from": 3, "broadcast_rows": 0}])
def test_rounds_like_a_plain_search(spark, options):
    rows = corpus()
    docs = documents(spark, rows).repartition(5)
    found = sorted(map(tuple, dedup_report(docs, round_bytes=10_000, round_share=0, **options).collect()), key=str)
    assert found == sorted((r[:5] for r in plain_report(rows, 50)), key=str)


def test_words_that_meet_by_chance_are_no_repeated_anchors():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(200)]
    bodies = [" ".join(rng.choice(words) for _ in range(200)).encode() for _ in range(200)]
    data = np.frombuffer(b"".join(bodies), np.uint8)
    hashes = anchors(data, np.cumsum([0, *map(len, bodies)]), 50)[3]
    _, count = np.unique(hashes, return_counts=True)
    # one anchor in seven, with pieces of 16 bytes
    assert count[count > 1].sum() < 0.02 * len(hashes)


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0}])
def test_disk_is_let_go_of_after_each_step(spark, options):
    rows = [(i, f"{prose(i, 300)} {prose(i // 2, 200)}") for i in range(300)]
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f for f in manager.getAllFiles().mkString("\n").split("\n") if f.endswith(".data") and "shuffle_" in f and os.path.exists(f)}

    docs = documents(spark, rows)
    root = scratch_root(spark).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    files = shuffled()
    report = dedup_report(docs, **options)
    kept = {x.rpartition("-")[0] for x in set(os.listdir(root)) - before}
    assert kept == {"copied-texts", "spans"}
    for _ in range(40):  # Spark deletes in a thread of its own
        if not (left := sum(os.path.getsize(f) for f in shuffled() - files if os.path.exists(f))):
            break
        time.sleep(0.5)
    assert left < 0.05 * sum(len(t) for _, t in rows)
    assert report.count() == 300
