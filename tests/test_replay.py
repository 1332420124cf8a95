import datetime as dt
import random

import pytest

from concord import schemas as S
from concord.operators.replay import replay

from .serial import NAMES, Model, made_id

T0 = dt.datetime(2024, 1, 1)


def event(seq, source, pid, kind="updated", version=None, tenant="t0", eid=None, delivery=1, at=None, **fields):
    base = dict(zip(("first_name", "last_name", "email", "phone", "company"), ("Ada", "L", f"{pid}@x.io", "1", "C")))
    base.update(fields)
    names = dict(zip(base, NAMES.get(source, NAMES["salesforce"])))
    return {
        "event_id": eid or f"e{seq}", "tenant_id": tenant, "source": source,
        "entity_type": "contact" if source == "hubspot" else "customer", "entity_id": pid, "event_type": kind,
        "source_version": seq if version is None else version,
        "occurred_at": T0 + dt.timedelta(minutes=seq if at is None else at),
        "received_at": T0 + dt.timedelta(minutes=seq), "correlation_id": None, "provenance": None,
        "payload": {"fields": {names[k]: v for k, v in base.items() if v is not None} if kind != "deleted" else {}},
        "arrival_seq": seq, "delivery": delivery,
    }


def policies(strategy="last_write_wins", delete_policy="propagate", tenant="t0"):
    return [
        {"tenant_id": tenant, "entity": "customer", "source": a, "destination": b, "mode": "async",
         "conflict_strategy": strategy, "delete_policy": delete_policy, "retry_policy": "exponential",
         "source_priority": p, "enabled": True, "created_at": T0 + dt.timedelta(seconds=i)}
        for i, (a, b, p) in enumerate([("salesforce", "hubspot", 100), ("hubspot", "salesforce", 200)])
    ]


def frames(spark, events, pols):
    return (
        spark.createDataFrame(events, S.EVENT),
        spark.createDataFrame([], S.CANONICAL),
        spark.createDataFrame(pols, S.POLICY),
    )


def run(spark, events, pols, **kw):
    return replay(*frames(spark, events, pols), **kw)


def outcome_list(r):
    return [x.outcome for x in r.outcomes.orderBy("arrival_seq", "delivery").collect()]


def record_map(r):
    return {(x.tenant_id, x.entity_id): x for x in r.canonical.collect()}


def random_events(n, seed, mails=6, pids=5):
    rnd, out = random.Random(seed), []
    tenants = ["t0", "t1", "t2"]
    for seq in range(n):
        src = rnd.choice(["salesforce", "hubspot", "salesforce"])
        tenant = rnd.choice(tenants)
        pid = f"{src[0]}{rnd.randrange(pids)}"
        if rnd.random() < 0.06:
            pid = made_id(tenant, f"{rnd.choice('sh')}{rnd.randrange(pids)}", src)
        kind = "deleted" if rnd.random() < 0.1 else "updated"
        last = "" if rnd.random() < 0.04 else "L"
        e = event(seq, src, pid, kind, version=rnd.randrange(0, 3 + seq // 8), tenant=tenant, at=seq - rnd.choice([0, 0, 90]),
                  last_name=last, email=f"m{rnd.randrange(mails)}@x.io", phone=str(rnd.randrange(3)), company=rnd.choice(["C", "D"]))
        out.append(e)
        if rnd.random() < 0.1:
            out.append(dict(e, delivery=2))
    return out


@pytest.mark.parametrize("chunk_rows,n,seed", [(2000, 500, 1), (7, 300, 2)])
def test_replay_equals_serial_model(spark, chunk_rows, n, seed):
    events = random_events(n, seed)
    pols = policies() + policies("manual", "ignore", "t1") + policies("source_priority", "tombstone_only", "t2")
    want = Model(pols).run(events)
    got = run(spark, events, pols, chunk_rows=chunk_rows)
    rows = [tuple(x) for x in got.outcomes.select("arrival_seq", "delivery", "event_id", "outcome", "entity_id").orderBy("arrival_seq", "delivery").collect()]
    assert rows == want.outcomes
    recs = record_map(got)
    assert set(recs) == set(want.records)
    for key, w in want.records.items():
        g = recs[key]
        assert g.fields.asDict() == w["f"], key
        assert (g.version, g.tombstone, g.source_versions, g.provider_ids) == (w["version"], w["tomb"], w["sv"], w["ids"]), key
        assert {k: tuple(v) for k, v in g.field_provenance.items()} == w["prov"]
    changes = sorted((x.event_id, x.target, x.op, x.provider_id) for x in got.changes.collect())
    assert changes == sorted(c[:4] for c in want.changes)
    out = {(x.tenant_id, x.entity_id, x.target_source): x.fingerprint for x in got.outbound.collect()}
    assert out == want.written
    conf = {(x.tenant_id, x.entity_id, x.source_a, x.source_b, x.version_a, x.version_b): x.status for x in got.conflicts.collect()}
    assert conf == want.conflicts


def test_hundred_duplicates_write_once(spark):
    r = run(spark, [event(1, "salesforce", "s1", "created", delivery=d) for d in range(1, 101)], policies())
    assert outcome_list(r) == ["applied"] + ["duplicate"] * 99
    assert r.changes.count() == 1 and r.claims.count() == 1


def test_update_then_delete_tombstones(spark):
    r = run(spark, [event(1, "salesforce", "s1", "created"), event(2, "salesforce", "s1", email="n@x.io"), event(3, "salesforce", "s1", "deleted")], policies())
    rec = record_map(r)[("t0", "s1")]
    assert outcome_list(r) == ["applied", "applied", "deleted"]
    assert rec.tombstone and rec.fields.email == "n@x.io" and rec.source_versions == {"salesforce": 3}
    assert [x.op for x in r.changes.orderBy("arrival_seq").collect()] == ["create", "update", "delete"]


def test_delete_policy_ignore_still_tombstones_without_change_rows(spark):
    r = run(spark, [event(1, "salesforce", "s1"), event(2, "salesforce", "s1", "deleted", version=0)], policies(delete_policy="ignore"))
    rec = record_map(r)[("t0", "s1")]
    assert rec.tombstone and rec.source_versions == {"salesforce": 0}
    assert r.changes.where("op = 'delete'").count() == 0


def test_out_of_order_is_stale(spark):
    r = run(spark, [event(1, "salesforce", "s1", version=3), event(2, "salesforce", "s1", version=2)], policies())
    assert outcome_list(r) == ["applied", "stale"]
    assert record_map(r)[("t0", "s1")].source_versions == {"salesforce": 3}


def test_echo_and_identity_by_email(spark):
    r = run(spark, [event(1, "salesforce", "s1", email="a@x.io"), event(2, "hubspot", "h9", email="a@x.io"), event(3, "hubspot", "h9", email="a@x.io", phone="7")], policies())
    assert outcome_list(r) == ["applied", "echo", "applied"]
    rec = record_map(r)[("t0", "s1")]
    assert rec.provider_ids == {"salesforce": "s1", "hubspot": "h9"} and rec.version == 2


def test_manual_parks_and_field_merge_resolves(spark):
    ev = [event(1, "salesforce", "s1", email="a@x.io"), event(2, "hubspot", "h1", email="a@x.io", phone="9")]
    parked = run(spark, ev, policies("manual"))
    assert outcome_list(parked) == ["applied", "parked"]
    assert [x.status for x in parked.conflicts.collect()] == ["CONFLICT_PENDING"]
    assert record_map(parked)[("t0", "s1")].source_versions == {"salesforce": 1}
    merged = run(spark, ev, policies("field_merge"))
    assert outcome_list(merged) == ["applied", "applied"]
    assert record_map(merged)[("t0", "s1")].field_provenance["phone"].source == "hubspot"
    assert [x.status for x in merged.conflicts.collect()] == ["AUTO_RESOLVED"]


def test_schema_errors_and_missing_policy(spark):
    r = run(spark, [event(1, "salesforce", "s1", last_name=""), event(2, "salesforce", "s2", tenant="t9")], policies())
    assert outcome_list(r) == ["failed", "no_policy"]
    assert [(x.kind, x.message) for x in r.failures.collect()] == [("SCHEMA_ERROR", "missing required field last_name")]
    assert r.claims.count() == 0


def test_replaying_claimed_events_changes_nothing(spark):
    ev = random_events(60, 9)
    first = run(spark, ev, policies())
    again = replay(
        spark.createDataFrame(ev, S.EVENT), first.canonical, spark.createDataFrame(policies(), S.POLICY),
        outbound=first.outbound, processed=first.claims,
    )
    assert {x.outcome for x in again.outcomes.collect()} <= {"duplicate", "failed", "no_policy"}
    assert again.canonical.count() == 0


def test_two_batches_equal_one(spark):
    ev = random_events(200, 4)
    pols = policies() + policies("manual", "ignore", "t1") + policies("field_merge", "propagate", "t2")
    want = record_map(run(spark, ev, pols))
    a = run(spark, [e for e in ev if e["arrival_seq"] < 100], pols)
    b = replay(
        spark.createDataFrame([e for e in ev if e["arrival_seq"] >= 100], S.EVENT), a.canonical,
        spark.createDataFrame(pols, S.POLICY), outbound=a.outbound, processed=a.claims,
    )
    got = {**record_map(a), **record_map(b)}
    assert got == want


def test_oversized_cluster_range_split(spark):
    # One record holds all rows; it must be cut into many bounded chunks and still equal the serial result.
    ev = [event(i, "salesforce" if i % 5 else "hubspot", "s1" if i % 5 else "h1", email="a@x.io", phone=str(i % 4), version=i // 2) for i in range(1, 160)]
    want = Model(policies()).run(ev)
    got = run(spark, ev, policies(), chunk_rows=10)
    assert outcome_list(got) == [o[3] for o in want.outcomes]
    assert record_map(got)[("t0", "s1")].version == want.records[("t0", "s1")]["version"]


def test_email_shared_by_many_stored_records_reaches_only_the_oldest_live(spark):
    from concord.operators.identity import touched_records
    from concord.operators.routing import first_deliveries, route, to_steps

    writer = {"source": "salesforce", "version": 1, "occurred_at": T0, "priority": 100}
    stored = [
        ("t0", "customer", f"c{i:03d}", ("A", "L", "none@x.io", "1", "C"), 1, {"salesforce": 1}, {"salesforce": f"c{i:03d}"},
         {n: writer for n in S.FIELDS}, i == 0, "salesforce", None, T0 + dt.timedelta(minutes=i))
        for i in range(60)
    ]
    canonical = spark.createDataFrame(stored, S.CANONICAL)
    pols = spark.createDataFrame(policies(), S.POLICY)
    ev = [event(100, "hubspot", "h1", email="none@x.io", phone="2"), event(101, "hubspot", "h1", "deleted"),
          event(102, "hubspot", "h2", email="none@x.io", phone="3"), event(103, "hubspot", "h2", email="other@x.io"), event(104, "hubspot", "h3", email="none@x.io", phone="4")]
    events = spark.createDataFrame(ev, S.EVENT)
    steps = to_steps(first_deliveries(route(events, pols)))
    assert touched_records(steps, canonical).count() == 3  # 1 + one delete + one other email
    got = {x.event_id: x.entity_id for x in replay(events, canonical, pols).outcomes.collect()}
    assert got == {"e100": "c001", "e101": "c001", "e102": "c002", "e103": "c002", "e104": "c003"}


def test_rounds_over_chunks_write_only_what_they_fold_again(spark, monkeypatch):
    from concord.operators import replay as R

    kept, real = [], R.cut_lineage

    def keep(df, label):
        out = real(df, label)
        kept.append((label, out))
        return out

    monkeypatch.setattr(R, "cut_lineage", keep)
    run(spark, [event(i, "salesforce", "p", phone=str(i)) for i in range(1, 25)], policies(), chunk_rows=8)

    def rows(label):
        return sum(df.count() for name, df in kept if name == label)

    assert rows("stale") > 0
    assert rows("folded") == rows("chunks") + rows("stale")


@pytest.mark.parametrize("levels", [1, 3])
def test_slices_of_slices_give_the_same_log(spark, monkeypatch, levels):
    from concord.operators import replay as R

    monkeypatch.setattr(R, "LEVELS", levels)
    R._fold_expr.cache_clear()
    try:
        ev = [event(i, "salesforce", "p", phone=str(i)) for i in range(1, 29)]
        got = run(spark, ev, policies())
        assert outcome_list(got) == ["applied"] * 28
        (record,) = got.canonical.collect()
        assert record.version == 28 and record.fields.phone == "28"
    finally:
        R._fold_expr.cache_clear()
