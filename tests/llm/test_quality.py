import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from concord.llm import quality
from concord.llm.quality import ORDER, classify, keep_good, score, train
from tests.llm.helpers import ODD, documents, prose


def plain_model(texts):
    """Interpolated modified Kneser-Ney with dictionaries, one language."""
    counts = {ORDER: Counter()}
    for t in texts:
        padded = b"\0" * (ORDER - 1) + t
        counts[ORDER].update(padded[i : i + ORDER] for i in range(len(t)))
    for k in range(ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    off = {}
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        off[k] = {i: max(0.05, min(i - (i + 1) * y * (n[i + 1] / n[i] if n[i] else 1), i - 0.05)) for i in (1, 2, 3)}
    total, mass = defaultdict(int), defaultdict(float)
    for k, c in counts.items():
        for g, n in c.items():
            total[k, g[:-1]] += n
            mass[k, g[:-1]] += off[k][min(n, 3)]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 256
        if (k, g[:-1]) not in total:
            return p(g[1:])
        n = counts[k][g]
        own = (n - off[k][min(n, 3)]) / total[k, g[:-1]] if n else 0.0
        return own + mass[k, g[:-1]] / total[k, g[:-1]] * p(g[1:])

    return p


def test_like_dictionaries_with_one_shard_and_with_several(spark, monkeypatch):
    texts = [prose(1, 60, 30), prose(2, 40, 30), "aaaa aaab", "é ß"]
    probes = [*texts, prose(3, 30), "", "zzzz\n", "日本"]
    frame = spark.createDataFrame([(7, t.encode()) for t in texts], "lang long, body binary")
    p = plain_model([t.encode() for t in texts])
    want = {}
    for i, t in enumerate(probes):
        padded = b"\0" * (ORDER - 1) + t.encode()
        want[i] = sum(math.log(p(padded[j : j + ORDER])) for j in range(len(t.encode())))
    rows = spark.createDataFrame([(i, 7, t.encode()) for i, t in enumerate(probes)] + [(99, 8, b"other")], "k long, lang long, body binary")
    model = train(frame)
    for rows_of_shard in (1_000_000, 300):
        monkeypatch.setattr(quality, "SHARD_ROWS", rows_of_shard)
        out = {r.k: r for r in score(rows, model).collect()}
        for i, t in enumerate(probes):
            assert out[i].n == len(t.encode()) and abs((out[i].total or 0.0) - want[i]) < 1e-3 * (1 + abs(want[i]))
        assert out[99].total is None


def test_shards_are_bounded_after_a_frequent_byte(spark, monkeypatch):
    rng = random.Random(2)
    text = " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6000)).encode()
    frame = spark.createDataFrame([(7, text)], "lang long, body binary")
    model, rows = train(frame), frame.selectExpr("1L AS k", "lang", "body")
    want = score(rows, model).first().total
    sizes, packed = [], quality.packed

    def measured(table):
        out = packed(table)
        sizes.append(sum(len(keys) for keys, _ in out.values()))
        return out

    most = sum(m.count() for m in model) // 3
    monkeypatch.setattr(quality, "packed", measured)
    monkeypatch.setattr(quality, "SHARD_ROWS", most)
    assert abs(score(rows, model).first().total / want - 1) < 1e-6
    assert len(sizes) >= 6 and all(a + b <= most + 4 * 257 for a, b in zip(sizes[::2], sizes[1::2], strict=True))
    assert max(a + b for a, b in zip(sizes[::2], sizes[1::2], strict=True)) < 1.2 * most


def test_probabilities_add_up():
    p = plain_model([b"abracadabra", b"abba"])
    for context in (b"\0\0\0\0", b"cada", b"zzzz", b"abra"):
        assert abs(sum(p(context + bytes([b])) for b in range(256)) - 1) < 1e-9


def corpus():
    rng = random.Random(1)
    rows = [(i, prose(1, 900, 60)[40 * (i % 50) : 40 * (i % 50) + rng.randint(60, 900)] + f" {prose(i, 6, 60)}") for i in range(300)]
    junk = [(1000 + i, " ".join(w.upper() + "!!$$" for w in prose(i, 40).split())) for i in range(20)]
    return rows, junk


def test_junk_goes_and_good_text_stays(spark):
    rows, junk = corpus()
    docs = documents(spark, [*rows, *junk, *ODD, (2000, "foreign", "xx"), (2001, "no language", None)])
    labels = spark.createDataFrame([(i, 1) for i, _ in rows[:200]] + [(None, 1), (1001, 0), (5, None)], "doc_id long, quality int")
    labels = labels.withColumn("text", F.lit("clash"))
    found = {}
    for r in classify(docs, labels).collect():  # rows that share an id are all rejected if one is
        if r.doc_id not in found or not r.keep:
            found[r.doc_id] = r
    assert not any(found[i].keep for i, _ in junk)
    assert sum(found[i].keep for i, _ in rows) >= 297
    for i in (900, 901, 2000, 2001):
        assert found[i].keep and found[i].perplexity is None
    left = keep_good(docs, labels)
    assert left.columns == docs.columns
    bad = {r.doc_id for r in found.values() if not r.keep}
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(str(r.doc_id) for r in docs.collect() if r.doc_id not in bad)


def test_repeated_rows_count_like_single_ones(spark):
    rows, _ = corpus()
    labels = spark.createDataFrame([(i, 1) for i, _ in rows[:200]], "doc_id long, quality int")
    twice = [rows[i] for i in range(200, 240) for _ in range(3)] + [(None, rows[250][1])] * 2

    def found(docs):
        return {(r.doc_id, r.n_bytes): r for r in classify(documents(spark, docs), labels).collect()}

    one, many = found([*rows, (None, rows[250][1])]), found([*rows, *twice])
    assert one.keys() == many.keys()
    for k, r in one.items():
        assert abs(many[k].perplexity / r.perplexity - 1) < 1e-9 and (many[k].keep, many[k].threshold) == (r.keep, r.threshold)
    assert many[None, len(rows[250][1].encode())].keep
    assert sum(r.doc_id in range(200, 240) for r in keep_good(documents(spark, [*rows, *twice]), labels).collect()) == 4 * sum(one[k].keep for k in one if k[0] in range(200, 240))


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.keep for r in classify(documents(spark, [(1, "some text"), (2, None)]), none).collect()] == [True, True]
    assert classify(documents(spark, []), none).count() == 0
