"""The ordered replay of the change feed as a recursive SQL query, one event per person and step.

Used only to check the replay with a second engine. In this feed a person is one (tenant, email) with
at most two provider ids, so at most two canonical records can exist: `a`, created by the salesforce
id, and `b`, created by the hubspot id.
"""

from __future__ import annotations

from concord.schemas import FIELDS

WRITER = "STRUCT(source VARCHAR, version BIGINT, occurred_at TIMESTAMP, priority INTEGER)"
SLOT = (
    "STRUCT(f STRUCT(" + ", ".join(f"{n} VARCHAR" for n in FIELDS) + "), p STRUCT(" + ", ".join(f"{n} {WRITER}" for n in FIELDS)
    + "), sv_s BIGINT, sv_h BIGINT, w_s VARCHAR, w_h VARCHAR, id_s VARCHAR, id_h VARCHAR, tomb BOOLEAN, ver BIGINT, born BIGINT)"
)

EVENTS = """
SELECT c.*, p.conflict_strategy AS strategy, p.delete_policy, p.source_priority AS priority, c.source = 'salesforce' AS is_s,
       row_number() OVER (PARTITION BY c.tenant_id, c.email ORDER BY arrival_seq) AS n,
       sha256(concat('first_name=', first_name, '|last_name=', last_name, '|email=', email, '|phone=', phone, '|company=', company)) AS fp
FROM {change_feed} c JOIN {policies} p USING (tenant_id, source)
WHERE delivery = 1 AND (c.event_type = 'deleted' OR last_name <> '')
"""


def _both(expr: str) -> str:
    """`expr` with {x}/{o} = own / other provider suffix, chosen by the event's source."""
    return f"CASE WHEN is_s THEN {expr.format(x='s', o='h')} ELSE {expr.format(x='h', o='s')} END"


def _derived(entity: str, target: str) -> str:
    return f"concat({target}, '-', substr(sha256(concat(tenant_id, ':customer:', {entity}, ':', {target})), 1, 24))"


def steps_sql() -> str:
    found_a = f"coalesce({_both('a.id_{x}')} = provider_id, false)"
    found_b = f"coalesce({_both('b.id_{x}')} = provider_id, false)"
    live = {x: f"({x} IS NOT NULL AND NOT {x}.tomb)" for x in "ab"}
    at = f"""CASE WHEN {found_a} THEN 'a' WHEN {found_b} THEN 'b' WHEN event_type = 'deleted' THEN 'none'
             WHEN {live['a']} AND ({live['b']}) THEN CASE WHEN a.born < b.born THEN 'a' ELSE 'b' END
             WHEN {live['a']} THEN 'a' WHEN {live['b']} THEN 'b' ELSE 'new' END"""
    clash = {n: f"coalesce(s.p.{n}.source <> source AND s.f.{n} IS DISTINCT FROM {n}, false)" for n in FIELDS}
    any_clash = "(" + " OR ".join(clash.values()) + ")"

    def wins(n: str) -> str:
        p = f"s.p.{n}"
        return (
            f"CASE WHEN strategy = 'source_priority' THEN priority < {p}.priority OR (priority = {p}.priority AND occurred_at > {p}.occurred_at) "
            f"ELSE occurred_at > {p}.occurred_at OR (occurred_at = {p}.occurred_at AND priority < {p}.priority) END"
        )

    outcome = f"""CASE WHEN event_type = 'deleted' THEN CASE WHEN spot = 'none' OR s.tomb THEN 'noop_delete' ELSE 'deleted' END
        WHEN source_version <= coalesce({_both('s.sv_{x}')}, 0) THEN 'stale'
        WHEN coalesce({_both('s.w_{x}')} = fp, false) THEN 'echo'
        WHEN {any_clash} AND strategy = 'manual' THEN 'parked' ELSE 'applied' END"""
    keep = {n: f"({clash[n]} AND NOT ({wins(n)}))" for n in FIELDS}
    result = "struct_pack(" + ", ".join(f"{n} := CASE WHEN {keep[n]} THEN s.f.{n} ELSE {n} END" for n in FIELDS) + ")"
    writers = "struct_pack(" + ", ".join(
        f"{n} := CASE WHEN {keep[n]} THEN s.p.{n} ELSE struct_pack(source := source, version := source_version, occurred_at := occurred_at, priority := priority) END"
        for n in FIELDS
    ) + ")"
    first = "CASE " + " ".join(
        f"WHEN {clash[n]} THEN struct_pack(source_a := s.p.{n}.source, version_a := s.p.{n}.version)" for n in sorted(FIELDS)
    ) + " END"
    entity = (
        "CASE spot WHEN 'a' THEN concat('sf-', suffix) WHEN 'b' THEN concat('hub-', suffix) WHEN 'new' THEN provider_id END"
    )
    other = "CASE WHEN is_s THEN 'hubspot' ELSE 'salesforce' END"
    fp2 = "sha256(concat('first_name=', res.first_name, '|last_name=', res.last_name, '|email=', res.email, '|phone=', res.phone, '|company=', res.company))"
    applied, changed = "outcome = 'applied'", "outcome IN ('applied', 'deleted')"

    def own(flag: str, name: str, new: str) -> str:
        return f"CASE WHEN {flag} THEN {new} ELSE s.{name} END"

    slot = f"""CASE WHEN spot = 'none' OR (spot = 'new' AND outcome <> 'applied') THEN NULL ELSE struct_pack(
        f := CASE WHEN {applied} THEN res ELSE s.f END, p := CASE WHEN {applied} THEN writers ELSE s.p END,
        sv_s := {own(f'{changed} AND is_s', 'sv_s', 'source_version')}, sv_h := {own(f'{changed} AND NOT is_s', 'sv_h', 'source_version')},
        w_s := {own(f'{applied} AND NOT is_s', 'w_s', 'fp2')}, w_h := {own(f'{applied} AND is_s', 'w_h', 'fp2')},
        id_s := CASE WHEN event_type <> 'deleted' AND is_s THEN provider_id WHEN {applied} AND NOT is_s THEN coalesce(s.id_s, target_id) ELSE s.id_s END,
        id_h := CASE WHEN event_type <> 'deleted' AND NOT is_s THEN provider_id WHEN {applied} AND is_s THEN coalesce(s.id_h, target_id) ELSE s.id_h END,
        tomb := CASE WHEN {applied} THEN false WHEN outcome = 'deleted' THEN true ELSE s.tomb END,
        ver := coalesce(s.ver, 0) + CASE WHEN {changed} THEN 1 ELSE 0 END, born := coalesce(s.born, arrival_seq))::{SLOT} END"""
    into = "CASE spot WHEN 'new' THEN CASE WHEN is_s THEN 'a' ELSE 'b' END ELSE spot END"
    has_target = f"{_both('s.id_{o}')} IS NOT NULL"
    return f"""
SELECT NULL::VARCHAR AS tenant_id, NULL::VARCHAR AS email, 0::BIGINT AS n, NULL::{SLOT} AS a, NULL::{SLOT} AS b, NULL::VARCHAR AS event_id, NULL::VARCHAR AS source,
       NULL::BIGINT AS arrival_seq, NULL::VARCHAR AS outcome, NULL::VARCHAR AS entity_id, NULL::VARCHAR AS target, NULL::VARCHAR AS op, NULL::VARCHAR AS target_id,
       NULL::VARCHAR AS fp2, NULL::BOOLEAN AS clashed, NULL::VARCHAR AS source_a, NULL::BIGINT AS version_a, NULL::BIGINT AS source_version, NULL::VARCHAR AS strategy WHERE false
UNION ALL SELECT DISTINCT tenant_id, email, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {{serial_events}}
UNION ALL
SELECT tenant_id, email, n, CASE WHEN into_slot = 'a' AND slot IS NOT NULL THEN slot ELSE a END, CASE WHEN into_slot = 'b' AND slot IS NOT NULL THEN slot ELSE b END,
       event_id, source, arrival_seq, outcome, CASE WHEN at_new_unwritten THEN NULL ELSE entity END, target,
       CASE WHEN outcome = 'applied' THEN CASE WHEN had_target THEN 'update' ELSE 'create' END WHEN outcome = 'deleted' AND had_target AND delete_policy = 'propagate' THEN 'delete' END,
       target_id, CASE WHEN outcome = 'applied' THEN fp2 END, clashed AND outcome IN ('applied', 'parked'), fc.source_a, fc.version_a, source_version, strategy
FROM (
  SELECT *, {slot} AS slot, {into} AS into_slot, spot = 'new' AND outcome <> 'applied' AS at_new_unwritten FROM (
    SELECT *, {fp2} AS fp2, coalesce({_both('s.id_{o}')}, {_derived('entity', 'target')}) AS target_id, {has_target} AS had_target FROM (
      SELECT *, {outcome} AS outcome, {result} AS res, {writers} AS writers, {first} AS fc, {any_clash} AS clashed, {entity} AS entity, {other} AS target FROM (
        SELECT *, CASE spot WHEN 'a' THEN a WHEN 'b' THEN b END AS s, substr(provider_id, strpos(provider_id, '-') + 1) AS suffix FROM (
          SELECT q.*, {at} AS spot FROM (SELECT e.*, r.a, r.b FROM serial_run r JOIN {{serial_events}} e ON e.tenant_id = r.tenant_id AND e.email = r.email AND e.n = r.n + 1) q)))))
"""


OUTCOMES = """
SELECT r.tenant_id, r.source, r.event_id, r.arrival_seq, 1 AS delivery, r.entity_id, r.outcome FROM {serial_run} r WHERE n > 0
UNION ALL SELECT tenant_id, source, event_id, arrival_seq, delivery, NULL, CASE WHEN event_type <> 'deleted' AND last_name = '' THEN 'failed' ELSE 'duplicate' END
FROM {change_feed} WHERE delivery = 2 OR (event_type <> 'deleted' AND last_name = '')
"""

RECORDS = """
WITH last AS (SELECT tenant_id, email, arg_max(a, n) FILTER (n > 0) AS a, arg_max(b, n) FILTER (n > 0) AS b, replace(replace(email, 'u', ''), '@example.com', '') AS k FROM {serial_run} GROUP BY 1, 2),
     r AS (SELECT tenant_id, concat('sf-', lpad(k, 12, '0')) AS entity_id, a AS s FROM last WHERE a IS NOT NULL
           UNION ALL SELECT tenant_id, concat('hub-', lpad(k, 12, '0')), b FROM last WHERE b IS NOT NULL)
SELECT tenant_id, entity_id, s.f.first_name AS first_name, s.f.last_name AS last_name, s.f.email AS email, s.f.phone AS phone, s.f.company AS company, s.ver AS version, s.tomb AS tombstone,
       s.sv_s AS version_salesforce, s.sv_h AS version_hubspot, s.id_s AS salesforce_id, s.id_h AS hubspot_id,
       s.p.company.source AS company_source, s.p.company.version AS company_version, s.p.company.occurred_at AS company_at, s.p.phone.source AS phone_source, s.p.phone.priority AS phone_priority
FROM r
"""

CHANGES = "SELECT tenant_id, event_id, entity_id, target, op, target_id AS provider_id, coalesce(fp2, '') AS fingerprint FROM {serial_run} WHERE op IS NOT NULL"

OUTBOUND = """
SELECT tenant_id, entity_id, target AS target_source, arg_max(fp2, n) AS fingerprint, arg_max(source_version, n) AS applied_version
FROM {serial_run} WHERE op IN ('create', 'update') GROUP BY 1, 2, 3
"""

CONFLICTS = """
SELECT tenant_id, entity_id, source_a, source AS source_b, version_a, source_version AS version_b, arg_min(CASE outcome WHEN 'parked' THEN 'CONFLICT_PENDING' ELSE 'AUTO_RESOLVED' END, n) AS status,
       arg_min(strategy, n) AS resolution_strategy FROM {serial_run} WHERE clashed GROUP BY 1, 2, 3, 4, 5, 6
"""

# Operator decisions on the conflicts the replay parked: odd incoming versions take side b, others side
# a, and every fifth is dismissed. The stored side is the record at that step, which parking left alone.
PARKED = """
SELECT r.tenant_id, r.email, r.entity_id, r.source_a, r.version_a, r.source AS source_b, r.source_version AS version_b, e.received_at,
       CASE WHEN r.entity_id LIKE 'sf-%' THEN r.a.f.company ELSE r.b.f.company END AS company_a, e.company AS company_b,
       CASE WHEN r.source_version % 5 = 0 THEN 'dismiss' ELSE 'resolve' END AS action, CASE WHEN r.source_version % 2 = 1 THEN 'b' ELSE 'a' END AS side
FROM {serial_run} r JOIN {serial_events} e ON e.tenant_id = r.tenant_id AND e.email = r.email AND e.n = r.n
WHERE r.outcome = 'parked'
QUALIFY row_number() OVER (PARTITION BY r.tenant_id, r.entity_id, r.source_a, r.version_a, r.source, r.source_version ORDER BY r.n) = 1
"""

RESOLVED = """
SELECT p.tenant_id, p.entity_id, c.version + count(*) AS version, false AS tombstone,
       arg_max(CASE side WHEN 'a' THEN company_a ELSE company_b END, received_at) AS company,
       arg_max(CASE side WHEN 'a' THEN source_a ELSE source_b END, received_at) AS company_source
FROM {parked} p JOIN {serial_records} c ON c.tenant_id = p.tenant_id AND c.entity_id = p.entity_id WHERE action = 'resolve'
GROUP BY p.tenant_id, p.entity_id, c.version
"""

DECIDED = """
SELECT tenant_id, entity_id, source_a, source_b, version_a, version_b, CASE action WHEN 'dismiss' THEN 'DISMISSED' ELSE 'RESOLVED' END AS status, 'operator' AS resolved_by FROM {parked}
"""

COUNTERS = """
WITH o AS (SELECT r.source, r.outcome, e.received_at AS moment, CASE WHEN r.op IS NULL THEN 0 ELSE 1 END AS w, CASE WHEN r.clashed THEN 1 ELSE 0 END AS c
           FROM {serial_run} r JOIN {serial_events} e ON e.tenant_id = r.tenant_id AND e.email = r.email AND e.n = r.n
           UNION ALL SELECT source, CASE WHEN event_type <> 'deleted' AND last_name = '' THEN 'failed' ELSE 'duplicate' END, received_at, 0, 0
           FROM {change_feed} WHERE delivery = 2 OR (event_type <> 'deleted' AND last_name = ''))
SELECT date_trunc('hour', moment) AS window_start, source, count(*) AS events, count(*) FILTER (outcome NOT IN ('failed', 'duplicate')) AS success, count(*) FILTER (outcome = 'failed') AS failed,
       count(*) FILTER (outcome = 'duplicate') AS duplicates, count(*) FILTER (outcome = 'stale') AS stale, count(*) FILTER (outcome = 'echo') AS loops_prevented, cast(sum(w) AS bigint) AS destination_writes,
       0 AS retries_scheduled, count(*) FILTER (outcome = 'failed') AS dlq, cast(sum(c) AS bigint) AS conflicts_detected, count(*) FILTER (c = 1 AND outcome = 'applied') AS conflicts_resolved
FROM o GROUP BY 1, 2
"""
