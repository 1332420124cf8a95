import corpus_pipeline
from concord.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import documents, edited, prose
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_ngram_join import plain as plain_links
from tests.llm.test_suffix_dedup import plain_report

DATA = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "packing",
    ]


def test_stages_decide_like_plain_versions(spark, tmp_path):
    line = "A passage of more than fifty bytes that stands in two documents."
    rows = [(i, prose(i, 60)) for i in range(40)]
    rows += [(100, edited(rows[3][1], 1, 1)), (101, rows[4][1]), (102, prose(60, 30) + line), (103, line + prose(61, 30))]
    item = prose(70, 25)
    rows += [(104, f"{prose(71, 20)} {item} {prose(72, 20)}"), (105, " ".join(w.upper() + "$$!!" for w in prose(73, 30).split()))]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, at = documents(spark, rows), 0
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{at}")
        docs, at = spark.read.parquet(f"{tmp_path}/stage{at}"), at + 1
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == set(before)
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        gone = set(before) - set(after)
        texts = list(before.items())
        if name == "quality classifier":
            assert gone == {105}
        elif name == "n-gram Jaccard join":
            roots = plain_links(texts, 5, 80)[1]
            assert gone == {i for i, r in roots.items() if i != r} and {100, 101} <= gone | {100}
        elif name == "suffix-array dedup":
            assert not gone and after == {r[0]: r[5].decode("utf-8", "ignore") if r[2] else before[r[0]] for r in plain_report(texts, 50)}
            assert after[103] != before[103] and after[102] == before[102]
        else:
            assert gone == {r[0] for r in plain_hits(texts, [(1, item)]) if r[5]} == {104}
        seen.append(name)
    assert len(seen) == 4


def test_run_on_given_tables(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and "sequence_id" in out.columns
