import hashlib

import pytest
from pyspark.sql import functions as F

from concord.llm.exact_dedup import digests, exact_duplicates, settings, STATE
from tests.llm.helpers import ODD, documents, prose


def rows():
    base = [(i, prose(i % 7, 20)) for i in range(60)]
    return base + [(100 + i, "the same text") for i in range(40)] + [(200, " the same text"), (201, "The same text")] + ODD


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


def weak(text):
    """A digest under which most texts collide."""
    return F.pmod(F.crc32(text.cast("binary")), F.lit(3)).cast("string")


@pytest.fixture
def path(spark, tmp_path):
    documents(spark, rows()).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path / "documents.parquet")


def test_groups_equal_those_of_the_texts(spark, path):
    out = exact_duplicates(spark, path).cache()
    assert got(out) == expected(rows())
    kept = out.where("kept").groupBy("text_sha256").count().collect()
    assert len(kept) == len({r[1] or "" for r in rows()}) and {r["count"] for r in kept} == {1}
    assert out.where("kept and keep_id is distinct from doc_id").isEmpty()


def test_bytes_decide_where_digests_collide(spark, path):
    out = exact_duplicates(spark, path, digest=weak).cache()
    assert got(out) == expected(rows())
    assert out.where("kept").count() == len({r[1] or "" for r in rows()})


def test_small_triggers_and_a_restart_give_the_same(spark, tmp_path):
    path, state = str(tmp_path / "documents.parquet"), str(tmp_path / "state")
    first, second = rows()[:70], rows()[70:]
    documents(spark, first).repartition(3).write.parquet(path)
    assert got(exact_duplicates(spark, path, checkpoint=state, trigger=1000)) == expected(first)
    documents(spark, second).repartition(2).write.mode("append").parquet(path)
    assert got(exact_duplicates(spark, path, checkpoint=state, trigger=1000)) == expected(first + second)
    with settings(spark, STATE):
        assert digests(spark, state).agg(F.sum("n")).first()[0] == len(first + second)


def test_hot_text_meets_several_copies_of_its_kept_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("concord.llm.exact_dedup.SHARE", 3)
    monkeypatch.setattr("concord.llm.exact_dedup.BROADCAST_ROWS", 0)
    path = str(tmp_path / "documents.parquet")
    documents(spark, rows()).write.parquet(path)
    assert got(exact_duplicates(spark, path)) == expected(rows())


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    documents(spark, []).write.parquet(path)
    assert exact_duplicates(spark, path).isEmpty()
