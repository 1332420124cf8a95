import hashlib
import random
import re

import numpy as np
import pytest

from concord.llm import fill_middle
from concord.llm.fill_middle import Memo, Tokens, borders, chunk_ends, fill_in_middle, fill_in_middle_report
from tests.llm.helpers import ODD, documents, edited, prose

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text, seed=42):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    w = TOKEN.findall(text)
    n = len(w)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    prefix, middle, suffix = ("".join(p) for p in (w[:a], w[a:b], w[b:]))
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    long = prose(1, 20_000)
    rows = [(i, prose(i, 1 + i * 3)) for i in range(80)]
    rows += [(300 + i, edited(long, i, 3)) for i in range(4)] + [(310, " " * 50_000), (311, "x" * 50_000 + " y"), (312, "\n" + long + "\t\t")]
    rows += [(320 + i, t) for i, t in enumerate(["a <P> b", "<S>", "x <M", "ends in <", "S> begins", "  no break 　", "a\x0bb\x0cc\x00d", "é ü\r\n🙂🙂 日本 語"] * 4)]
    return rows + ODD


def test_rows_equal_the_plain_version(spark):
    rows = texts()
    got = fill_in_middle(documents(spark, rows).repartition(3)).collect()
    assert sorted(([r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output] for r in got), key=str) == sorted(
        ([r[0], *plain_version(r[0], r[1])] for r in rows), key=str
    )
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_texts_are_restored(spark):
    rows = texts()
    got = fill_in_middle_report(documents(spark, rows)).collect()
    assert sorted(r.restored_sha256 for r in got) == sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows)


@pytest.mark.parametrize("segment", [64, 100, 1 << 19])
def test_every_cut_of_a_text(monkeypatch, segment):
    monkeypatch.setattr(fill_middle, "SEGMENT", segment)
    monkeypatch.setattr(fill_middle, "MEAN_BITS", 5)
    monkeypatch.setattr(fill_middle, "LONGEST", 90)
    rng = random.Random(4)
    for _ in range(20):
        text = "".join(rng.choice("ab  \n\té日🙂") for _ in range(rng.randint(0, 900)))
        body = np.frombuffer(text.encode(), np.uint8)
        tokens = Tokens(body, 0, chunk_ends(borders(body), 0, len(body)), Memo())
        words = TOKEN.findall(text)
        assert tokens.n == len(words)
        for k in range(len(words) + 1):
            before = "".join(words[:k])
            assert tokens.end_of(k) == (len(before.encode()), len(before))


def test_chunks_follow_the_content():
    shared = prose(3, 4000).encode()
    chunks = []
    for head in (b"", b"another beginning of some length "):
        body = np.frombuffer(head + shared, np.uint8)
        ends = chunk_ends(borders(body), 0, len(body))
        chunks.append([body[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)])
    assert set(chunks[0][1:]) == set(chunks[1][1:]) and len(chunks[0]) > 5


def test_memo_compares_bytes_and_is_bounded(monkeypatch):
    memo = Memo(most=3000)
    monkeypatch.setattr(fill_middle.xxhash, "xxh3_64_intdigest", lambda content: len(content))
    one, two = memo.get(b"a b c"), memo.get(b"abc d")
    assert (len(one.ends), len(two.ends)) == (2, 1) and memo.hits == 0
    assert memo.get(b"abc d") is two and memo.hits == 1
    for i in range(100):
        memo.get(b"x" * i + b" y")
    assert memo.size <= 3000 and len(memo.seen) < 20


def test_empty_table(spark):
    assert fill_in_middle_report(documents(spark, [])).isEmpty()
