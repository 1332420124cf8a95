import json

import pytest
from pyspark.sql import functions as F

from concord import schemas as S
from concord.operators.replay import replay
from concord.session import cut_lineage, release_scratch, scratch_root
from concord.sources import events as E
from concord.sources.tables import TableStore, load_dimension, persist_replay
from concord.streaming import apply as A

from .serial import Model
from .test_replay import T0, event, policies, random_events


def records(df):
    return {(r.tenant_id, r.entity_id): (tuple(r.fields), r.version, r.tombstone, r.source_versions, r.provider_ids) for r in df.collect()}


def as_model(m):
    return {k: (tuple(r["f"][n] for n in S.FIELDS), r["version"], r["tomb"], r["sv"], r["ids"]) for k, r in m.records.items()}


def new_store(spark, tmp_path, pols=None):
    store = TableStore(spark, str(tmp_path / "state"), buckets=4)
    load_dimension(store, "policies", spark.createDataFrame(pols or policies(), S.POLICY))
    store.commit()
    return store


def test_upsert_overwrites_and_keeps_other_keys(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"), buckets=4)
    rows = [("t0", "customer", f"e{i}", "hubspot", "a", 1) for i in range(20)]
    store.upsert("outbound_writes", spark.createDataFrame(rows, S.OUTBOUND))
    assert TableStore(spark, str(tmp_path / "s")).read("outbound_writes").count() == 0  # not published yet
    store.commit()
    store.upsert("outbound_writes", spark.createDataFrame([("t0", "customer", "e3", "hubspot", "b", 2)], S.OUTBOUND))
    store.commit()
    got = {r.entity_id: r.fingerprint for r in TableStore(spark, str(tmp_path / "s")).read("outbound_writes").collect()}
    assert got == {f"e{i}": "b" if i == 3 else "a" for i in range(20)}
    store.delete("outbound_writes", spark.createDataFrame([("t0", "customer", "e3", "hubspot")], "tenant_id string, entity_type string, entity_id string, target_source string"))
    store.rollback()
    assert store.read("outbound_writes").count() == 20


def test_compaction_keeps_rows(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"), buckets=2)
    for i in range(3):
        store.insert_absent("outbound_writes", spark.createDataFrame([("t0", "customer", f"e{i}", "hubspot", "a", 1)], S.OUTBOUND))
        store.commit()
    before = sorted(map(tuple, store.read("outbound_writes").collect()))
    store.compact("outbound_writes")
    store.commit()
    assert sorted(map(tuple, store.read("outbound_writes").collect())) == before
    assert all(len(paths) == 1 for paths in store.manifest()["tables"]["outbound_writes"].values())


def test_two_writers_cannot_publish_the_same_version(spark, tmp_path):
    a, b = TableStore(spark, str(tmp_path / "s")), TableStore(spark, str(tmp_path / "s"))
    row = spark.createDataFrame([("t0", "customer", "e", "hubspot", "a", 1)], S.OUTBOUND)
    base = b.manifest()
    a.upsert("outbound_writes", row)
    b.upsert("outbound_writes", row)
    a.commit()
    b.manifest = lambda: base  # b read the state before a published
    with pytest.raises(RuntimeError):
        b.commit()


def test_dimension_keys_are_unique(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([("t0", "shop", "Shop", T0)], S.TENANT)
    assert [r.status for r in load_dimension(store, "tenants", one).collect()] == ["created"]
    store.commit()
    assert [r.status for r in load_dimension(store, "tenants", one).collect()] == ["exists"]
    with pytest.raises(ValueError):
        load_dimension(store, "tenants", one.union(one))


def test_stream_equals_serial_model_and_restarts(spark, tmp_path):
    ev = random_events(160, 7)
    pols = policies() + policies("manual", "ignore", "t1") + policies("source_priority", "tombstone_only", "t2")
    store = new_store(spark, tmp_path, pols)
    path = str(tmp_path / "in")

    def feed(lo, hi):
        spark.createDataFrame([e for e in ev if lo <= e["arrival_seq"] < hi], S.EVENT).coalesce(1).write.mode("append").parquet(path)

    def go():
        stream = E.stream_files(spark, path, files_per_trigger=1)
        A.apply_stream(stream, store, str(tmp_path / "ck"), name="apply").awaitTermination()

    spark.createDataFrame([], S.EVENT).write.parquet(path)
    feed(0, 90)
    go()
    feed(90, 160)
    go()
    want = Model(pols).run(ev)
    assert records(store.read("canonical_records")) == as_model(want)
    dead = {r.event_id for r in store.read("dead_letter").collect()}
    assert dead == {e["event_id"] for e in ev if e["event_type"] != "deleted" and "" in e["payload"]["fields"].values()}
    assert store.read("operations").count() == len(want.changes)
    version = store.manifest()["version"]
    go()  # nothing new: no further version
    assert store.manifest()["version"] == version


def test_batch_published_before_a_crash_is_skipped(spark, tmp_path):
    store = new_store(spark, tmp_path)
    r = replay(spark.createDataFrame([event(1, "salesforce", "s1")], S.EVENT), store.read("canonical_records"), store.read("policies"))
    persist_replay(store, r, "apply", 4)
    assert store.seen("apply", 4) and store.seen("apply", 3) and not store.seen("apply", 5) and not store.seen("other", 0)


def test_unresolvable_connection_is_retried_then_applied(spark, tmp_path):
    store = new_store(spark, tmp_path)
    ev = spark.createDataFrame([event(1, "salesforce", "s1")], S.EVENT)
    nothing = spark.createDataFrame([], S.CONNECTION)
    r = replay(ev, store.read("canonical_records"), store.read("policies"), connections=nothing)
    persist_replay(store, r)
    assert [(x.attempt, x.error_class) for x in store.read("retry_queue").collect()] == [(1, "UNKNOWN")]
    assert store.read("processed_events").count() == 0
    later = F.expr("timestamp_ntz'2999-01-01 00:00:00'")
    A.retry_due(store, later, connections=nothing)
    assert [x.attempt for x in store.read("retry_queue").collect()] == [2]
    A.retry_due(store, later)  # the next attempt is only due after the backoff
    assert store.read("retry_queue").count() == 1
    A.retry_due(store, F.expr("timestamp_ntz'2999-01-01 00:05:00'"))
    assert store.read("retry_queue").count() == 0
    assert records(store.read("canonical_records"))[("t0", "s1")][1] == 1
    assert store.read("changes").count() == 1


def test_one_event_id_of_two_sources_is_kept_twice(spark, tmp_path):
    store = new_store(spark, tmp_path)
    rows = [event(i, source, "x1", eid="same") for i, source in ((1, "salesforce"), (2, "hubspot"))]
    nothing = spark.createDataFrame([], S.CONNECTION)
    ev = spark.createDataFrame(rows, S.EVENT)
    persist_replay(store, replay(ev, store.read("canonical_records"), store.read("policies"), connections=nothing))
    assert sorted(r.source for r in store.read("retry_queue").collect()) == ["hubspot", "salesforce"]


def test_poison_messages_are_durable(spark, tmp_path):
    store = new_store(spark, tmp_path)
    good = json.dumps({k: v for k, v in event(1, "salesforce", "s1").items() if k not in ("arrival_seq", "delivery")}, default=str).replace(" 00:", "T00:")
    raw = spark.createDataFrame([(good, 0, 1), ("{oops", 0, 2)], "value string, partition int, offset bigint").withColumn("value", F.encode("value", "utf-8"))
    decoded = E.decode_messages(raw)
    assert [bool(r.poison) for r in decoded.orderBy("arrival_seq").collect()] == [False, True]
    path = str(tmp_path / "in")
    decoded.write.parquet(path)
    stream = spark.readStream.schema(decoded.schema).parquet(path)
    A.apply_stream(stream, store, str(tmp_path / "ck"), name="apply").awaitTermination()
    assert records(store.read("canonical_records"))[("t0", "s1")][1] == 1
    assert [(r.reason, r.payload) for r in store.read("dead_letter").collect()] == [("undecodable message", "{oops")]


def test_publish_and_change_sink(spark, tmp_path):
    ev = spark.createDataFrame([event(i, "salesforce", f"s{i % 2}") for i in range(6)], S.EVENT)
    E.publish(ev, str(tmp_path / "topic"))
    keys = spark.read.parquet(str(tmp_path / "topic")).select("key").distinct()
    assert sorted(r.key for r in keys.collect()) == ["t0:customer:s0", "t0:customer:s1"]
    r = replay(ev, spark.createDataFrame([], S.CANONICAL), spark.createDataFrame(policies(), S.POLICY))
    E.write_changes(r.changes, str(tmp_path / "changes"))
    assert (tmp_path / "changes" / "target=hubspot").is_dir()


def test_bounded_dedupe_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([event(1, "salesforce", "s1", delivery=d) for d in (1, 2, 3)], S.EVENT).write.parquet(path)
    out = A.deduplicate_recent(E.stream_files(spark, path), "received_at", "1 hour").select("event_id")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_scratch_is_under_the_configured_folder(spark):
    root = scratch_root(spark)
    assert root.startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    assert cut_lineage(spark.range(3), "x").count() == 3
    assert release_scratch is not None
