import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from concord import schemas as S
from concord.operators import failures, fullsync, ingest, metrics, reconcile, reports, resolution, scope
from concord.operators.replay import replay

from .test_replay import T0, event, outcome_list, policies, record_map

NOW = "timestamp_ntz'2024-03-01 00:00:00'"


def now():
    return F.expr(NOW)


def minutes(n):
    return T0 + dt.timedelta(minutes=n)


# Ingest


def deliveries(spark, bodies, slug="shop", provider="salesforce", signature=None, secret="k"):
    import hashlib
    import hmac

    rows = [
        (f"d{i}", slug, provider, signature or "sha256=" + hmac.new(secret.encode(), b.encode(), hashlib.sha256).hexdigest(), b, minutes(i), i, 1)
        for i, b in enumerate(bodies)
    ]
    return spark.createDataFrame(rows, S.DELIVERY)


def dims(spark):
    return (
        spark.createDataFrame([("t0", "shop", "Shop", T0)], S.TENANT),
        spark.createDataFrame([("t0", "salesforce", "u", "k", T0)], S.CONNECTION),
    )


def body(**kw):
    return json.dumps({"event_id": "e1", "entity_type": "customer", "entity_id": "s1", "event_type": "created", "source_version": 1,
                       "occurred_at": "2024-01-01T00:00:00Z", "payload": {"fields": {"id": "s1", "first_name": "A"}}, **kw})


def acks(spark, d, stored=None):
    a = ingest.accept(d, *dims(spark), stored=stored)
    return a, [(r.status, r.reason) for r in ingest.acknowledgements(a).orderBy("delivery_id").collect()]


def test_accept_reasons(spark):
    times = [body(event_id="e3", occurred_at="yesterday"), body(event_id="e4", occurred_at=None), body(event_id="e5", occurred_at="")]
    _, got = acks(spark, deliveries(spark, [body(), body(), body(event_id="e2", entity_id=""), "{oops", "[]", *times]))
    assert got[5:] == [("rejected", "malformed webhook payload"), ("received", None), ("rejected", "malformed webhook payload")]
    got = got[:5]
    assert got == [
        ("received", None), ("duplicate", None), ("rejected", "missing entity_type/entity_id"), ("rejected", "malformed webhook payload"),
        ("rejected", "malformed webhook payload"),
    ]
    assert acks(spark, deliveries(spark, [body()], slug="nobody"))[1] == [("rejected", "unknown tenant")]
    assert acks(spark, deliveries(spark, [body()], provider="hubspot"))[1] == [("rejected", "no connection for provider")]
    assert acks(spark, deliveries(spark, [body()], secret="other"))[1] == [("rejected", "invalid signature")]


def test_defaults_and_stored_duplicates(spark):
    a, got = acks(spark, deliveries(spark, [body(event_id="", source=""), body(event_id="", source="")]))
    assert [s for s, _ in got] == ["received", "duplicate"]
    stored = ingest.source_events(a)
    row = stored.first()
    assert row.source == "salesforce" and len(row.event_id) == 64 and row.provenance == {} and row.status == "received"
    assert acks(spark, deliveries(spark, [body(event_id="", source="")]), stored=stored)[1] == [("duplicate", None)]
    back = ingest.rebuild(stored).first()
    assert back.payload.fields["first_name"] == "A" and back.occurred_at == T0


def test_pending_and_guarded_status(spark):
    a, _ = acks(spark, deliveries(spark, [body(event_id=f"e{i}") for i in range(5)]))
    stored = ingest.source_events(a)
    assert [r.event_id for r in ingest.pending(stored, 2).collect()] == ["e0", "e1"]
    first = ingest.pending(stored, 2)
    moved = ingest.advance(stored, first, "validated", only_from="received")
    again = ingest.advance(moved, stored, "failed", only_from="validated")
    assert {r.event_id: r.status for r in again.collect()} == {"e0": "failed", "e1": "failed", "e2": "received", "e3": "received", "e4": "received"}


# Failures


def queue(spark, rows=()):
    return spark.createDataFrame(list(rows), S.RETRY)


def letters(spark, rows=()):
    return spark.createDataFrame(list(rows), S.DEAD_LETTER)


def failed(spark, kind, message="boom", eid="e1"):
    return spark.createDataFrame([("t0", "salesforce", eid, kind, message, json.dumps({"event_id": eid}), 0)], "tenant_id string, source string, event_id string, kind string, message string, state string, hint int")


def attempts(df, kind, message="boom"):
    return df.withColumns({"kind": F.lit(kind).cast("string"), "message": F.lit(message), "hint": F.lit(0)})


def test_outage_then_recovery(spark):
    retries, dead = failures.first_failure(failed(spark, "TRANSIENT"), now())
    assert dead.count() == 0
    q = failures.enqueue(queue(spark), retries)
    assert [(r.attempt, r.max_attempts) for r in q.collect()] == [(1, 8)]
    q, d = failures.settle(q, letters(spark), failures.retry_outcome(attempts(q, "TRANSIENT"), now()), now())
    assert [r.attempt for r in q.collect()] == [2]
    q, d = failures.settle(q, d, failures.retry_outcome(attempts(q, None), now()), now())
    assert q.count() == 0 and d.count() == 0


def test_schema_error_goes_to_dead_letters_and_is_discarded(spark):
    retries, dead = failures.first_failure(failed(spark, "SCHEMA_ERROR", "missing required field last_name"), now())
    assert retries.count() == 0
    d = failures.bury(letters(spark), dead, now())
    assert [(r.status, r.error_class) for r in d.collect()] == [("open", "SCHEMA_ERROR")]
    decisions = spark.createDataFrame([("t0", "salesforce", "e1", "discard", "ops")], "tenant_id string, source string, event_id string, action string, actor string")
    d, entries, audit = failures.decide_letters(d, decisions, now())
    assert [r.status for r in d.collect()] == ["discarded"] and entries.count() == 0
    assert [(r.action, r.actor) for r in audit.collect()] == [("dlq.discard", "ops")]
    assert [r.status for r in failures.resolve_letters(d, dead, now()).collect()] == ["discarded"]


def test_exhaustion_then_replay(spark):
    row = ("t0", "salesforce", "e1", 7, 8, T0, "x", "TRANSIENT", '{"event_id":"e1"}', T0)
    q = queue(spark, [row])
    q, d = failures.settle(q, letters(spark), failures.retry_outcome(attempts(q, "TRANSIENT"), now()), now())
    assert q.count() == 0 and [r.status for r in d.collect()] == ["open"]
    decisions = spark.createDataFrame([("t0", "salesforce", "e1", "retry", "ops")], "tenant_id string, source string, event_id string, action string, actor string")
    d, entries, _ = failures.decide_letters(d, decisions, now())
    q = failures.enqueue(q, entries)
    assert [(r.status) for r in d.collect()] == ["retrying"] and [r.attempt for r in q.collect()] == [1]
    q, d = failures.settle(q, d, failures.retry_outcome(attempts(q, None), now()), now())
    assert q.count() == 0 and [r.status for r in d.collect()] == ["resolved"]
    again = failures.bury(d, failed(spark, "X").selectExpr("tenant_id", "source", "event_id", "'again' as reason", "'X' as error_class", "state as payload"), now())
    assert [(r.status, r.reason, r.resolved_at) for r in again.collect()] == [("open", "again", None)]


def test_corrupt_state_is_dead_lettered(spark):
    q = queue(spark, [("t0", "salesforce", "e1", 1, 8, T0, "x", "TRANSIENT", "{oops", T0)])
    r = failures.retry_outcome(attempts(q, None), now()).first()
    assert (r.decision, r.final_class, r.final_reason) == ("dead_letter", "SCHEMA_ERROR", "unreadable retry entry")


def test_due_order_and_limit(spark):
    q = queue(spark, [("t0", "salesforce", f"e{i}", 1, 8, minutes(9 - i), "x", "T", "{}", T0) for i in range(10)])
    at = F.lit(minutes(5)).cast("timestamp_ntz")
    assert [r.event_id for r in failures.due(q, at, 3).collect()] == ["e9", "e8", "e7"]


# Full sync and reconciliation


def snap(spark, rows):
    data = [(t, i, v, d, {k: x for k, x in zip(("first_name", "last_name", "email", "phone", "company"), f)}) for t, i, v, d, f in rows]
    return spark.createDataFrame(data, "tenant_id string, id string, source_version bigint, deleted boolean, data map<string,string>")


def good(n, **kw):
    return (kw.get("first", "A"), kw.get("last", "L"), f"{n}@x.io", kw.get("phone", "1"), "C")


def test_full_sync_resumes_exactly_once(spark):
    pols = spark.createDataFrame(policies(), S.POLICY)
    rows = [("t0", f"s{i}", 1, False, good(f"s{i}")) for i in range(6)]
    half = fullsync.to_events(fullsync.examine(snap(spark, rows[:2]), F.col("tenant_id"), "salesforce"), F.lit("j1"), now())
    a = replay(half, spark.createDataFrame([], S.CANONICAL), pols)
    whole = fullsync.examine(snap(spark, rows + [("t0", "s8", 1, True, good("s8")), ("t0", "s9", 1, False, good("s9", last=""))]), F.col("tenant_id"), "salesforce")
    b = replay(fullsync.to_events(whole, F.lit("j1"), now()), a.canonical, pols, outbound=a.outbound, processed=a.claims)
    outcomes = sorted(r.outcome for r in b.outcomes.collect())
    assert outcomes == ["applied"] * 4 + ["duplicate"] * 2
    assert set(record_map(a)) | set(record_map(b)) == {("t0", f"s{i}") for i in range(6)}
    c = fullsync.counters(whole, F.lit(40)).first()
    assert (c.processed, c.failed, c.total, c.cursor) == (6, 1, 40, "s9")
    dead = fullsync.dead_letters(whole, F.lit("j1")).first()
    assert (dead.event_id, dead.error_class) == ("jobsync:j1:s9", "SCHEMA_ERROR")


def test_full_sync_applies_by_id(spark):
    rows = [("t0", f"s{i}", 1, False, good("same", first=f"F{i}")) for i in (4, 2, 5, 0, 3, 1)]
    events = fullsync.to_events(fullsync.examine(snap(spark, rows), F.col("tenant_id"), "salesforce"), F.lit("j1"), now())
    assert [r.entity_id for r in events.orderBy("arrival_seq").collect()] == [f"s{i}" for i in range(6)]
    r = replay(events, spark.createDataFrame([], S.CANONICAL), spark.createDataFrame(policies(), S.POLICY))
    assert [k for k in record_map(r)] == [("t0", "s0")]


def test_finding_is_adopted_without_a_policy(spark):
    from concord.operators.routing import route

    e = event(1, "salesforce", "s1")
    e["provenance"] = {**(e.get("provenance") or {}), "reconcile_finding_id": "f1"}
    plain = event(2, "salesforce", "s2")
    out = route(spark.createDataFrame([e, plain], S.EVENT), spark.createDataFrame([], S.POLICY)).orderBy("arrival_seq").collect()
    assert [(r.static_outcome, r.dests) for r in out] == [(None, []), ("no_policy", None)]
    r = replay(spark.createDataFrame([e], S.EVENT), spark.createDataFrame([], S.CANONICAL), spark.createDataFrame([], S.POLICY))
    assert len(record_map(r)) == 1 and r.changes.count() == 0


@pytest.fixture(scope="module")
def synced(spark):
    ev = [event(i, "salesforce", f"s{i}", "created", last_name="L", first_name="A", phone="1", company="C") for i in range(1, 5)]
    ev.append(event(9, "salesforce", "s4", "deleted"))
    return replay(spark.createDataFrame(ev, S.EVENT), spark.createDataFrame([], S.CANONICAL), spark.createDataFrame(policies(), S.POLICY))


def sweep(spark, synced, mode="auto", delete_policy="propagate"):
    # s1 drifted, s2 in sync, s3 absent, s4 tombstoned here but live there, s7 unknown, s8 invalid.
    s = snap(spark, [("t0", "s1", 2, False, good("s1", phone="9")), ("t0", "s2", 2, False, good("s2")), ("t0", "s3", 2, True, good("s3")),
                     ("t0", "s4", 2, False, good("s4")), ("t0", "s7", 3, False, good("s7")), ("t0", "s8", 1, False, good("s8", last=""))])
    runs = reconcile.open_runs(spark.createDataFrame([("r1", "t0", "salesforce", mode, "j1")], "run_id string, tenant_id string, source string, mode string, job_id string"), now())
    compared = reconcile.compare(s, synced.canonical, "salesforce")
    pols = spark.createDataFrame(policies(delete_policy=delete_policy), S.POLICY)
    return compared, runs, reconcile.findings(compared, pols, runs, now()), pols


def test_sweep_classifies_and_counts(spark, synced):
    compared, runs, found, _ = sweep(spark, synced)
    got = {r.provider_id: (r.kind, r.direction, r.status) for r in found.collect()}
    assert got == {
        "s1": ("drift", "push_canonical", "pending"), "s3": ("missing", "push_canonical", "skipped"),
        "s4": ("deleted", "delete", "pending"), "s7": ("missed", "adopt_provider", "pending"),
    }
    c = reconcile.run_counters(compared, found, runs).first()
    assert (c.total, c.failed, c.drift, c.missed, c.deleted) == (5, 1, 1, 2, 1)
    closed = reconcile.close_runs(runs, reconcile.run_counters(compared, found, runs), now()).first()
    assert (closed.status, closed.missed) == ("completed", 2)
    failed_run = reconcile.close_runs(runs, reconcile.run_counters(compared, found, runs), now(), F.lit("provider down")).first()
    assert (failed_run.status, failed_run.error) == ("failed", "provider down")


def test_missing_is_recreated_only_when_deletes_are_ignored(spark, synced):
    _, runs, found, _ = sweep(spark, synced, delete_policy="ignore")
    status = {r.kind: (r.status, r.error) for r in found.collect()}
    assert status["missing"] == ("pending", None)
    assert status["deleted"] == ("skipped", "delete_policy=ignore: deletes stay where they are")
    ops = {r.provider_id: r.op for r in reconcile.push_repairs(found, runs, synced.canonical).collect()}
    assert sorted(ops.values()) == ["create", "update"]


def test_manual_mode_parks_everything_and_operator_decides(spark, synced):
    compared, runs, found, pols = sweep(spark, synced, mode="manual")
    assert {r.status for r in found.collect()} == {"pending"}
    by_kind = {r.kind: r.finding_id for r in found.collect()}
    decisions = spark.createDataFrame(
        [(by_kind["drift"], "apply", "adopt_provider", "ops"), (by_kind["missed"], "dismiss", None, "ops"), (by_kind["deleted"], "apply", "sideways", "ops"), ("nope", "apply", None, "ops")],
        "finding_id string, action string, direction string, actor string",
    )
    decided = reconcile.decide_findings(found, decisions)
    got = {r.finding_id: (r.problem, r.direction) for r in decided.collect()}
    assert got[by_kind["drift"]] == (None, "adopt_provider") and got["nope"][0] == "unknown finding"
    assert got[by_kind["deleted"]][0].startswith("no such direction") and got[by_kind["missed"]] == (None, "adopt_provider")
    adopted = replay(reconcile.adopt_events(decided.where("problem is null and action = 'apply'"), runs, now()), synced.canonical, pols, outbound=synced.outbound)
    rec = record_map(adopted)[("t0", "s1")]
    assert rec.fields.phone == "9" and rec.source_versions["salesforce"] == 2 and rec.field_provenance["phone"].priority == 100
    moves = spark.createDataFrame([(by_kind["drift"], "failed", "x"), (by_kind["missed"], "dismissed", None)], "finding_id string, to string, error string")
    once = reconcile.set_finding_status(found, moves, now())
    twice = reconcile.set_finding_status(once, spark.createDataFrame([(by_kind["drift"], "applied", None), (by_kind["missed"], "applied", None)], "finding_id string, to string, error string"), now())
    status = {r.kind: r.status for r in twice.collect()}
    assert (status["drift"], status["missed"]) == ("failed", "dismissed")
    reopened = reconcile.set_finding_status(once, spark.createDataFrame([(by_kind["drift"], "pending", None)], "finding_id string, to string, error string"), now())
    assert {r.kind: r.status for r in reopened.collect()}["drift"] == "pending"


def test_push_not_found_recreates_and_updates_state(spark, synced):
    _, runs, found, _ = sweep(spark, synced)
    pushed = reconcile.push_repairs(found, runs, synced.canonical)
    results = pushed.select("tenant_id", "event_id", F.lit("NOT_FOUND").alias("kind"))
    again = reconcile.recreate_not_found(pushed, results).collect()
    assert [(r.op, r.entity_id) for r in again] == [("create", "s1")] and again[0].provider_id.startswith("salesforce-")
    state = reconcile.pushed_state(synced.canonical, pushed, pushed.select("tenant_id", "event_id", F.lit(7).cast("bigint").alias("new_version"))).first()
    assert (state.entity_id, state.source_versions["salesforce"], state.version) == ("s1", 7, 2)
    gone = reconcile.push_repairs(found, runs, synced.canonical.where("entity_id <> 's1'")).first()
    assert gone.op is None


def test_repair_outcomes(spark):
    ddl = (
        "finding_id string, op string, tenant_id string, entity_type string, entity_id string, source string, event_id string, "
        "target string, provider_id string, payload map<string,string>, fingerprint string, provider_version bigint"
    )
    ops = {"f1": "delete", "f2": "delete", "f3": None, "f4": "update", "f5": "update", "f6": "create", "f7": "update"}
    rows = [(f, op, "t0", "customer", f"c{f}", "hubspot", f"reconcile:{f}", "hubspot", "p", None, "" if op == "delete" else f"fp-{f}", 4) for f, op in ops.items()]
    changes = spark.createDataFrame(rows, ddl)
    answers = [("f1", "NOT_FOUND", None, None), ("f2", "RATE_LIMITED", "slow down", None), ("f4", "TIMEOUT", None, None), ("f4", None, None, 5),
               ("f5", "NOT_FOUND", None, None), ("f6", "NOT_FOUND", None, None), ("zz", None, None, 9)]
    ddl = "tenant_id string, event_id string, kind string, message string, new_version bigint"
    results = spark.createDataFrame([("t0", f"reconcile:{f}", *rest) for f, *rest in answers], ddl)
    found, operations, outbound = reconcile.repair_outcomes(changes, results, now())
    assert {r.finding_id: (r.to, r.error) for r in found.collect()} == {
        "f1": ("applied", None), "f2": ("failed", "slow down"), "f3": ("skipped", "the canonical record is gone"),
        "f4": ("applied", None), "f6": ("failed", "NOT_FOUND"),
    }
    assert operations.columns == spark.createDataFrame([], S.OPERATION).columns
    assert sorted((r.entity_id, r.applied_version, r.fingerprint) for r in operations.collect()) == [("cf1", 4, ""), ("cf4", 4, "fp-f4")]
    assert outbound.columns == spark.createDataFrame([], S.OUTBOUND).columns
    assert [(r.entity_id, r.fingerprint, r.applied_version) for r in outbound.collect()] == [("cf4", "fp-f4", 5)]
    again = reconcile.recreate_not_found(changes, results)
    found, _, outbound = reconcile.repair_outcomes(again, spark.createDataFrame([("t0", "reconcile:f5", None, None, 8)], ddl), now())
    assert [tuple(r) for r in found.collect()] == [("f5", "applied", None)]
    assert [(r.entity_id, r.applied_version) for r in outbound.collect()] == [("cf5", 8)]


def test_stored_findings_stand(spark, synced):
    _, _, found, _ = sweep(spark, synced)
    assert reconcile.new_findings(found.where("kind = 'drift'"), found).count() == found.count() - 1


def test_delete_policy_falls_back_to_destination_then_default(spark):
    rows = [dict(policies()[0], source="salesforce", destination="hubspot", delete_policy="ignore")]
    got = {r.source: r.delete_policy for r in reconcile.delete_policies(spark.createDataFrame(rows, S.POLICY)).collect()}
    assert got == {"salesforce": "ignore", "hubspot": "ignore"}


# Conflict decisions


def test_resolve_and_dismiss(spark):
    pols = spark.createDataFrame(policies("manual"), S.POLICY)
    ev = [event(1, "salesforce", "s1", email="a@x.io"), event(2, "hubspot", "h1", email="a@x.io", phone="9")]
    first = replay(spark.createDataFrame(ev, S.EVENT), spark.createDataFrame([], S.CANONICAL), pols)
    assert outcome_list(first) == ["applied", "parked"]
    none = F.lit(None).cast("string")
    conflicts = first.conflicts.withColumns({"resolved_by": none, "resolved_at": none.cast("timestamp_ntz")})
    cid = conflicts.first().conflict_id
    ddl = "conflict_id string, action string, side string, actor string"
    decided = resolution.decide(conflicts, spark.createDataFrame([(cid, "resolve", "b", "ops"), ("zz", "dismiss", None, "ops"), (cid, "resolve", "c", "ops")], ddl))
    assert sorted(str(r.problem) for r in decided.collect()) == ["None", "conflict not found", 'side must be "a" or "b"']
    ok = decided.where("problem is null")
    second = replay(resolution.resolution_events(ok, now()), first.canonical, pols, outbound=first.outbound, processed=first.claims)
    rec = record_map(second)[("t0", "s1")]
    assert rec.fields.phone == "9" and rec.field_provenance["phone"].source == "hubspot" and rec.field_provenance["phone"].priority == 100
    assert [(r.target, r.op) for r in second.changes.collect()] == [("salesforce", "update")]
    done = resolution.set_status(conflicts, resolution.resolved(ok, second.outcomes), now())
    assert [(r.status, r.resolved_by) for r in done.collect()] == [("RESOLVED", "operator")]
    gone = replay(resolution.resolution_events(ok, now()), spark.createDataFrame([], S.CANONICAL), pols)
    assert outcome_list(gone) == ["ignored"]
    dismissed = resolution.set_status(conflicts, resolution.dismissals(resolution.decide(conflicts, spark.createDataFrame([(cid, "dismiss", None, "ops")], ddl))), now())
    after = resolution.set_status(dismissed, spark.createDataFrame([(cid, "RESOLVED", "manual", "x")], "conflict_id string, to string, strategy string, by string"), now())
    assert [r.status for r in after.collect()] == ["DISMISSED"]
    late = resolution.decide(dismissed, spark.createDataFrame([(cid, "resolve", "a", "ops")], ddl))
    assert late.first().problem == "conflict is not pending resolution"
    assert [r.action for r in resolution.audit_rows(ok, now()).collect()] == ["conflict.resolve"]


# Reports, scope, metrics


def test_scope_is_fail_closed_and_guards_writes(spark):
    df = spark.createDataFrame([("t0", 1), ("t1", 2)], "tenant_id string, x int")
    assert [r.x for r in scope.scoped(df, "t0").collect()] == [1]
    assert scope.scoped(df, None).count() == 0 and scope.scoped(df, "").count() == 0
    with pytest.raises(scope.CrossTenantWrite):
        scope.guard_write(df, "t0")
    assert scope.guard_write(scope.scoped(df, "t0"), "t0").count() == 1


def brute_throttle(rows, limit):
    out, start, n = {}, {}, {}
    for ip, t in sorted(rows, key=lambda r: r[1]):
        if ip not in start or t >= start[ip] + dt.timedelta(seconds=60):
            start[ip], n[ip] = t, 0
        n[ip] += 1
        out[(ip, start[ip])] = (n[ip], max(0, n[ip] - limit))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_throttle_windows_equal_brute_force(spark, seed):
    import random

    rnd = random.Random(seed)
    t, rows = T0, []
    for _ in range(300):
        t += dt.timedelta(seconds=rnd.choice([0, 1, 5, 7.5, 30, 59.999999, 60, 200]))
        rows.append((rnd.choice("ab"), t))
    got = {(r.ip, r.opened_at): (r.attempts, r.refused) for r in reports.throttled(spark.createDataFrame(rows, "ip string, attempted_at timestamp_ntz"), limit=3).collect()}
    assert got == brute_throttle(rows, 3)


def test_lockout_is_cleared_by_success(spark):
    rows = [("t0", "a", False, minutes(i)) for i in range(5)] + [("t0", "a", True, minutes(5))] + [("t0", "a", False, minutes(6 + i)) for i in range(4)]
    rows += [("t0", "b", False, minutes(4 * i)) for i in range(9)]
    got = reports.lockouts(spark.createDataFrame(rows, "tenant_id string, email string, success boolean, attempted_at timestamp_ntz"))
    assert [(r.email, r.attempted_at, r.recent_failures) for r in got.collect()] == [("a", minutes(4), 5)]


def test_overview_limits(spark):
    tables = {
        "conflicts": spark.createDataFrame([], S.CONFLICT), "runs": spark.createDataFrame([], S.RUN), "dead_letter": letters(spark),
        "source_events": spark.createDataFrame([], S.SOURCE_EVENT), "audit_log": spark.createDataFrame([], S.AUDIT),
        "operations": spark.createDataFrame([("t0", "customer", "s1", "salesforce", "hubspot", f"e{i:02d}", 1, "f", minutes(i)) for i in range(30)], S.OPERATION),
        "sync_jobs": spark.createDataFrame([], S.SYNC_JOB),
    }
    got = reports.overview(tables, "t0")
    assert set(got) == {"conflicts", "runs", "dead_letters", "events", "audit", "operations", "jobs"}
    assert [r.event_id for r in got["operations"].collect()] == [f"e{i:02d}" for i in range(29, 14, -1)]
    assert reports.single(tables["operations"], "t0", event_id="e03").count() == 1


def test_exact_percentiles_and_empty_histogram(spark):
    df = spark.range(0, 101).withColumn("v", F.col("id").cast("double"))
    got = {r.p: r.value for r in metrics.exact_percentiles(df, "v", [0.0, 0.5, 0.95, 0.99, 1.0]).collect()}
    assert got == {0.0: 0.0, 0.5: 50.0, 0.95: 95.0, 0.99: 99.0, 1.0: 100.0}
    h = metrics.histogram(df.where("false"), "v")
    assert h.select(metrics.histogram_quantile(F.col("cumulative"), 0.95).alias("q")).first().q is None


def test_alert_needs_the_whole_hold_time(spark):
    rows = [("events", minutes(i), 10) for i in range(60)] + [("failed", minutes(i), 5) for i in range(20, 30)] + [("failed", minutes(i), 5) for i in range(40, 43)]
    obs = spark.createDataFrame(rows, "metric string, at timestamp_ntz, n bigint")
    fired = [r.step for r in metrics.alert(obs, "event_failure_rate_high", 60).orderBy("step").collect()]
    assert fired and fired[0] == minutes(30) and all(minutes(30) <= s <= minutes(46) for s in fired)


# Settled and lost events as sets


def test_unsettled_events_by_sketches_and_exactly(spark):
    keys = "tenant_id string, source string, event_id string, at timestamp_ntz"
    many = spark.range(60_000).selectExpr("'big' tenant_id", "'crm' source", "cast(id as string) event_id", "timestamp_ntz'2024-03-01 00:00:00' at")
    rows = [("a", "crm", "1", T0), ("a", "crm", "1", T0), ("a", "crm1", "1", T0), ("a", "crm", "11", T0), ("b", "crm", "1", T0), ("b", "crm", None, T0)]
    events = spark.createDataFrame([(*r[:3], r[3].replace(tzinfo=None)) for r in rows], keys).union(many)
    applied = many.where("cast(event_id as int) % 2 = 0").union(events.where("tenant_id = 'a' and source = 'crm' and event_id = '1'"))
    letters = spark.createDataFrame([("c", "crm", "1", T0.replace(tzinfo=None))], keys)
    exact = reports.unsettled(events, applied, letters)
    assert exact.count() == 30_000 + 3
    assert {r.event_id for r in exact.where("tenant_id = 'a'").collect()} == {"1", "11"}
    sketches = [reports.key_sketches(df, "at") for df in (events, applied, letters)]
    found = {r.tenant_id: (r.received, r.unsettled) for r in reports.unsettled_estimate(*sketches).collect()}
    assert found["a"] == (3, 2) and found["b"] == (1, 1) and set(found) == {"a", "b", "big"}
    assert abs(found["big"][0] - 60_000) < 1_200 and abs(found["big"][1] - 30_000) < 1_800
    # sketches of parts merge to those of the whole
    parts = sketches[0].where("tenant_id <> 'big'").union(sketches[0].where("tenant_id <> 'big'"))
    again = {r.tenant_id: (r.received, r.unsettled) for r in reports.unsettled_estimate(parts, *sketches[1:]).collect()}
    assert again["a"] == (3, 2) and again["b"] == (1, 1)
    assert {r.unsettled for r in reports.unsettled_estimate(parts).collect()} == {3, 1}
    assert reports.unsettled_estimate(sketches[0].limit(0), sketches[1]).count() == 0
