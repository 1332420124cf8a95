"""Registered queries: one per operator family, each with the SQL a second engine checks it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord import schemas as S
from concord.functions import columns as C
from concord.functions import conflict, providers, same_fields, same_value
from concord.operators import failures, fullsync, identity, ingest, metrics, reconcile, reports, resolution, routing, scope
from concord.plans import shapes as X
from concord.plans.feeds import frame, with_feeds
from concord.session import cut_lineage, scratch_root

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}  # shared sub-queries of the checking SQL
FIELDS = ", ".join(S.FIELDS)


def query(name: str, sql: str | None = None, recursive: bool = False):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_feeds(sql, VIEWS, recursive)
        return fn

    return add


FP = "sha256(concat('first_name=', {0}first_name, '|last_name=', {0}last_name, '|email=', {0}email, '|phone=', {0}phone, '|company=', {0}company))"
NAMES = {
    "salesforce": ["first_name", "last_name", "email", "phone", "company"],
    "hubspot": ["firstName", "lastName", "emailAddress", "phoneNumber", "organization"],
}

# Ingest -------------------------------------------------------------------------------------------

VIEWS["acks"] = """
WITH c AS (
  SELECT *, CASE WHEN arrival_seq % 23 = 5 THEN 'unknown tenant' WHEN arrival_seq % 29 = 6 THEN 'no connection for provider'
                 WHEN arrival_seq % 31 = 7 THEN 'invalid signature' WHEN arrival_seq % 19 = 4 THEN 'malformed webhook payload'
                 WHEN arrival_seq % 17 = 3 THEN 'missing entity_type/entity_id' END AS reason
  FROM {change_feed}),
r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, source, event_id, reason ORDER BY arrival_seq, delivery) AS k FROM c)
SELECT *, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN k > 1 THEN 'duplicate' ELSE 'received' END AS ack FROM r
"""


def _accepted(spark, sf):
    return ingest.accept(X.deliveries(spark, sf), frame(spark, sf, "tenants"), frame(spark, sf, "connections"))


@query("ingest_acknowledge", "SELECT concat('d-', arrival_seq, '-', delivery) AS delivery_id, ack AS status, reason FROM {acks}")
def _(spark, sf):
    return ingest.acknowledgements(_accepted(spark, sf)).drop("event_id")


@query("ingest_first_delivery", "SELECT tenant_id, source, event_id, min(arrival_seq) AS arrival_seq, count(*) AS deliveries FROM {change_feed} GROUP BY ALL")
def _(spark, sf):
    return routing.first_deliveries(X.change_events(spark, sf)).select(*S.EK, "arrival_seq", "deliveries")


@query(
    "ingest_mark_duplicates",
    """SELECT tenant_id, source, event_id, arrival_seq, delivery,
       row_number() OVER (PARTITION BY tenant_id, source, event_id ORDER BY arrival_seq, delivery) > 1 AS duplicate FROM {change_feed}""",
)
def _(spark, sf):
    return routing.mark_duplicates(X.change_events(spark, sf)).select(*S.EK, *S.ORDER, "duplicate")


@query(
    "source_event_rebuild",
    f"""SELECT tenant_id, source, provider_entity_type AS entity_type, provider_id AS entity_id, event_type, source_version, occurred_at,
        'crm' AS origin_source, first_name, email, arrival_seq FROM {{acks}} WHERE ack = 'received'""",
)
def _(spark, sf):
    e = ingest.rebuild(ingest.source_events(_accepted(spark, sf)))
    f = providers.normalize(F.col("source"), F.col("payload.fields"))
    return e.select(
        "tenant_id", "source", "entity_type", "entity_id", "event_type", "source_version", "occurred_at",
        F.col("provenance.origin_source").alias("origin_source"), f["first_name"].alias("first_name"), f["email"].alias("email"), "arrival_seq",
    )


@query(
    "source_event_pending",
    """SELECT arrival_seq, tenant_id, source, received_at FROM {acks} WHERE ack = 'received' ORDER BY received_at, arrival_seq LIMIT 1000""",
)
def _(spark, sf):
    return ingest.pending(ingest.source_events(_accepted(spark, sf)), 1000).select("arrival_seq", "tenant_id", "source", "received_at")


@query(
    "source_event_status",
    """SELECT tenant_id, source, event_id, CASE WHEN status_code = 401 THEN 'dlq' WHEN source <> 'hubspot' THEN 'failed' WHEN status_code = 200 THEN 'validated' ELSE 'received' END AS status
       FROM {write_results}""",
)
def _(spark, sf):
    r = frame(spark, sf, "write_results")
    rows = r.select(*S.EK, F.when((F.col("source") == "hubspot") | (F.col("status_code") == 401), "received").otherwise("failed").alias("status"), "status_code")
    ok = r.where("status_code = 200")
    moved = ingest.advance(rows, ok, "validated", only_from="received")
    moved = ingest.advance(moved, r.where("status_code = 401"), "dlq")
    # Rows that were not `received` are untouched by the guarded step.
    return moved.select(*S.EK, "status")


@query(
    "publish_keys",
    """SELECT concat(tenant_id, ':', provider_entity_type, ':', provider_id) AS key, count(*) AS messages, min(arrival_seq) AS first_seq, max(arrival_seq) AS last_seq
       FROM {change_feed} GROUP BY 1""",
)
def _(spark, sf):
    k = ingest.keyed(X.change_events(spark, sf))
    seq = F.from_json("value", "arrival_seq bigint")["arrival_seq"]
    return k.groupBy("key").agg(F.count(F.lit(1)).alias("messages"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"))


@query("domain_quarantine", "SELECT arrival_seq, delivery, 'conflict_strategy' AS violations FROM {change_feed} JOIN {policies} USING (tenant_id, source) WHERE conflict_strategy = 'unknown'")
def _(spark, sf):
    p = frame(spark, sf, "policies").select("tenant_id", "source", "conflict_strategy", "delete_policy")
    rows = frame(spark, sf, "change_feed").join(p, ["tenant_id", "source"])
    _, bad = ingest.in_domain_split(
        rows, {"conflict_strategy": S.STRATEGIES, "delete_policy": S.DELETE_POLICIES, "event_type": S.EVENT_TYPES}
    )
    return bad.select("arrival_seq", "delivery", F.concat_ws(",", "violations").alias("violations"))


# Sources ------------------------------------------------------------------------------------------


@query("snapshot_since", "SELECT id, version AS source_version FROM {sf_snapshot} WHERE updated_at >= TIMESTAMP '2024-01-01 01:00:00'")
def _(spark, sf):
    import datetime as dt

    return ingest.since(X.snapshot(spark, sf), dt.datetime(2024, 1, 1, 1)).select("id", "source_version")


_PAGE = "SELECT id, version FROM {sf_snapshot} WHERE id > 'sf-000000000010' ORDER BY id LIMIT 50"


@query("snapshot_page", _PAGE)
def _(spark, sf):
    return ingest.page(X.snapshot(spark, sf), "sf-000000000010", 50).select("id", F.col("source_version").alias("version"))


@query("snapshot_cursor", f"SELECT CASE WHEN count(*) >= 50 THEN max(id) END AS next_cursor FROM ({_PAGE})")
def _(spark, sf):
    return ingest.next_cursor(ingest.page(X.snapshot(spark, sf), "sf-000000000010", 50), 50)


# Scalar transforms --------------------------------------------------------------------------------


@query(
    "record_envelope",
    """SELECT id, CASE c_kind WHEN 3 THEN 0 ELSE version END AS source_version, CASE WHEN c_kind = 2 THEN false ELSE deleted END AS deleted,
       CASE WHEN id = '' THEN 'record missing id' END AS error
       FROM (SELECT CASE WHEN version = 4 AND deleted THEN '' ELSE id END AS id, version, deleted, version % 4 AS c_kind FROM {sf_snapshot})""",
)
def _(spark, sf):
    s = frame(spark, sf, "sf_snapshot")
    kind = F.col("version") % 4
    quote = F.lit('"')
    version = (
        F.when(kind == 1, F.concat(quote, F.col("version").cast("string"), quote))
        .when(kind == 3, F.concat(quote, F.lit("v"), F.col("version").cast("string"), quote))
        .otherwise(F.col("version").cast("string"))
    )
    deleted = F.when(kind == 2, F.concat(quote, F.col("deleted").cast("string"), quote)).otherwise(F.col("deleted").cast("string"))
    ident = F.when((F.col("version") == 4) & F.col("deleted"), F.lit("")).otherwise(F.col("id"))
    raw = F.concat(F.lit('{"id":"'), ident, F.lit('","version":'), version, F.lit(',"deleted":'), deleted, F.lit("}"))
    return s.select(providers.envelope(F.lit("salesforce"), raw).alias("e")).select("e.*")


@query(
    "record_validate",
    """SELECT arrival_seq, delivery, CASE WHEN last_name = '' THEN CASE source WHEN 'hubspot' THEN 'missing required field lastName' ELSE 'missing required field last_name' END END AS error FROM {change_feed}""",
)
def _(spark, sf):
    return X.change_events(spark, sf).select(*S.ORDER, providers.missing_field(F.col("source"), F.col("payload.fields")).alias("error"))


@query("record_normalize", f"SELECT arrival_seq, delivery, 'customer' AS entity_type, {FIELDS}, {FP.format('')} AS fingerprint FROM {{change_feed}}")
def _(spark, sf):
    f = providers.normalize(F.col("source"), F.col("payload.fields"))
    e = X.change_events(spark, sf).select(*S.ORDER, providers.canonical_type(F.col("source")).alias("entity_type"), f.alias("f"))
    return e.select(*S.ORDER, "entity_type", "f.*", C.fingerprint(F.col("f")).alias("fingerprint"))


@query(
    "record_denormalize",
    """SELECT entity_id, first_name AS "firstName", last_name AS "lastName", email AS "emailAddress", phone AS "phoneNumber", company AS organization,
       CASE WHEN tombstone THEN 'true' ELSE 'false' END AS deleted FROM {canonical_seed}""",
)
def _(spark, sf):
    c = X.canonical_seed(spark, sf).withColumn("m", providers.denormalize(F.lit("hubspot"), F.col("fields"), F.col("tombstone")))
    return c.select("entity_id", *[F.col("m")[k].alias(k) for k in (*NAMES["hubspot"], "deleted")])


@query("record_updated_at", "SELECT event_id, ts - INTERVAL '90' MINUTE AS updated_at, NULL::TIMESTAMP AS unparsable FROM {events}")
def _(spark, sf):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+01:30"))
    data = F.create_map(F.lit("updated_at"), text)
    return frame(spark, sf, "events").select(
        "event_id", providers.updated_at(F.lit("salesforce"), data).alias("updated_at"), C.parse_rfc3339(F.concat(text, F.lit("?"))).alias("unparsable")
    )


@query(
    "field_equality",
    """SELECT c.entity_id, c.email IS NOT DISTINCT FROM s.email AS same_email,
       c.first_name = s.first_name AND c.last_name = s.last_name AND c.email = s.email AND c.phone = s.phone AND c.company = s.company AS same_fields
       FROM {canonical_seed} c JOIN {sf_snapshot} s ON c.tenant_id = s.tenant_id AND c.salesforce_id = s.id""",
)
def _(spark, sf):
    c = X.canonical_seed(spark, sf).select("tenant_id", "entity_id", F.col("provider_ids")["salesforce"].alias("id"), "fields")
    s = frame(spark, sf, "sf_snapshot").select("tenant_id", "id", X.fields_struct().alias("theirs"))
    j = c.join(s, ["tenant_id", "id"])
    return j.select("entity_id", same_value(F.col("fields.email"), F.col("theirs.email")).alias("same_email"), same_fields(F.col("fields"), F.col("theirs")).alias("same_fields"))


@query("composed_ids", "SELECT concat('jobsync:job-1:', id) AS job_event, concat('reconcile:', id) AS repair_event, concat('resolve:', id) AS resolve_event FROM {sf_snapshot}")
def _(spark, sf):
    i = F.col("id")
    return frame(spark, sf, "sf_snapshot").select(
        C.compose_id("jobsync", F.lit("job-1"), i).alias("job_event"), C.compose_id("reconcile", i).alias("repair_event"), C.compose_id("resolve", i).alias("resolve_event")
    )


@query("provenance_json", "SELECT entity_id, prov_source AS email_writer, prov_priority AS email_priority, prov_occurred_at AS email_at, 5 AS n FROM {canonical_seed}")
def _(spark, sf):
    text = C.encode_provenance(F.col("field_provenance"))
    c = X.canonical_seed(spark, sf).select("entity_id", C.decode_provenance(text).alias("p"))
    w = F.col("p")["email"]
    return c.select("entity_id", w["source"].alias("email_writer"), w["priority"].alias("email_priority"), w["occurred_at"].alias("email_at"), F.size("p").alias("n"))


@query(
    "snapshot_decode",
    """SELECT entity_id, CASE WHEN tombstone THEN NULL ELSE email END AS email, CASE WHEN tombstone THEN 'lost' END AS raw FROM {canonical_seed}""",
)
def _(spark, sf):
    c = X.canonical_seed(spark, sf)
    text = F.when(F.col("tombstone"), F.lit("  lost ")).otherwise(F.to_json("fields"))
    d = C.decode_snapshot(text)
    return c.select("entity_id", d["email"].alias("email"), d["raw"].alias("raw"))


@query("provider_id_lookup", "SELECT entity_id, hubspot_id IS NOT NULL AS has_hubspot, hubspot_id FROM {canonical_seed}")
def _(spark, sf):
    ids = F.col("provider_ids")
    return X.canonical_seed(spark, sf).select("entity_id", F.map_contains_key(ids, "hubspot").alias("has_hubspot"), F.try_element_at(ids, F.lit("hubspot")).alias("hubspot_id"))


# Apply path ---------------------------------------------------------------------------------------


@query(
    "policy_route",
    """SELECT c.arrival_seq, c.delivery, CASE WHEN p.tenant_id IS NULL THEN 'no_policy' WHEN c.event_type <> 'deleted' AND c.last_name = '' THEN 'failed' END AS static_outcome,
       p.conflict_strategy AS strategy, p.source_priority AS priority, p.destination AS first_target
       FROM {change_feed} c LEFT JOIN (SELECT * FROM {policies} WHERE tenant_id <> 't4' OR source <> 'hubspot') p USING (tenant_id, source)""",
)
def _(spark, sf):
    p = frame(spark, sf, "policies").withColumn("enabled", ~((F.col("tenant_id") == "t4") & (F.col("source") == "hubspot")))
    r = routing.route(X.change_events(spark, sf), p, frame(spark, sf, "connections"))
    return r.select(*S.ORDER, "static_outcome", "strategy", "priority", F.get("dests", F.lit(0))["target"].alias("first_target"))


@query(
    "identity_resolve",
    """WITH mail AS (SELECT tenant_id, email, arg_min(entity_id, (created_at, entity_id)) AS by_email FROM {canonical_seed} WHERE NOT tombstone AND email <> '' GROUP BY ALL),
       links AS (SELECT tenant_id, 'salesforce' AS source, salesforce_id AS provider_id, entity_id AS by_id FROM {canonical_seed}
                 UNION ALL SELECT tenant_id, 'hubspot', hubspot_id, entity_id FROM {canonical_seed} WHERE hubspot_id IS NOT NULL)
       SELECT arrival_seq, coalesce(by_id, by_email, provider_id) AS entity_id,
              CASE WHEN by_id IS NOT NULL THEN 'provider_id' WHEN by_email IS NOT NULL THEN 'email' ELSE 'new' END AS matched_by
       FROM {edits} LEFT JOIN links USING (tenant_id, source, provider_id) LEFT JOIN mail USING (tenant_id, email)""",
)
def _(spark, sf):
    e = frame(spark, sf, "edits").select("arrival_seq", "tenant_id", F.lit("customer").alias("entity_type"), "source", "provider_id", "email")
    return identity.resolve_once(e, X.canonical_seed(spark, sf)).select("arrival_seq", "entity_id", "matched_by")


@query(
    "identity_clusters",
    """SELECT concat('hub-', substr(sf, 4)) AS id, tenant_id, concat('hub-', substr(sf, 4)) AS cluster_low, 2 AS n FROM
       (SELECT tenant_id, concat('sf-', substr(provider_id, strpos(provider_id, '-') + 1)) AS sf FROM {change_feed}
        WHERE event_type <> 'deleted' AND last_name <> '' GROUP BY 1, 2 HAVING count(DISTINCT source) = 2)""",
)
def _(spark, sf):
    routed = routing.route(X.change_events(spark, sf), frame(spark, sf, "policies"))
    steps = cut_lineage(routing.to_steps(routing.first_deliveries(routed.where("static_outcome is null"))), "steps")
    labels = identity.clusters(steps, X.empty(spark, S.CANONICAL))
    sized = labels.groupBy("tenant_id", F.col("cluster").alias("cluster_low")).agg((F.count(F.lit(1)) + 1).cast("int").alias("n"))
    return sized.select(F.col("cluster_low").alias("id"), "tenant_id", "cluster_low", "n")


VIEWS["contested"] = f"""
SELECT e.arrival_seq, e.strategy, e.source, e.source_version, e.occurred_at, e.priority, c.entity_id, c.prov_source, c.prov_priority, c.prov_occurred_at,
       c.version_salesforce AS prov_version, {', '.join(f'c.{f} AS old_{f}, e.{f} AS new_{f}' for f in S.FIELDS)},
       CASE WHEN e.strategy = 'source_priority' THEN (e.priority < c.prov_priority OR (e.priority = c.prov_priority AND e.occurred_at > c.prov_occurred_at))
            ELSE (e.occurred_at > c.prov_occurred_at OR (e.occurred_at = c.prov_occurred_at AND e.priority < c.prov_priority)) END AS incoming_wins
FROM {{edits}} e JOIN {{canonical_seed}} c ON e.tenant_id = c.tenant_id AND e.email = c.email
"""


def _contested(spark, sf):
    e = frame(spark, sf, "edits").select("arrival_seq", "event_id", "tenant_id", "strategy", "source", "source_version", "occurred_at", "priority", "email", X.fields_struct().alias("incoming"))
    c = X.canonical_seed(spark, sf).select(
        "tenant_id", "entity_id", F.col("fields.email").alias("email"), F.col("fields").alias("stored"),
        F.struct(*[F.col("field_provenance")[n].alias(n) for n in S.FIELDS]).alias("prov"),
    )
    found = conflict.detect(F.col("stored"), F.col("prov"), F.col("incoming"), F.col("source"), F.col("source_version"), F.col("occurred_at"), F.col("priority"))
    return e.join(c, ["tenant_id", "email"]).withColumn("conflicts", found)


@query(
    "conflict_detect",
    " UNION ALL ".join(
        f"""SELECT arrival_seq, '{f}' AS field, prov_source AS source_a, prov_version AS version_a, old_{f} AS value_a, source AS source_b, source_version AS version_b, new_{f} AS value_b
            FROM {{contested}} WHERE prov_source <> source AND old_{f} IS DISTINCT FROM new_{f}"""
        for f in S.FIELDS
    ),
)
def _(spark, sf):
    return _contested(spark, sf).select("arrival_seq", F.explode("conflicts").alias("c")).select(
        "arrival_seq", *[F.col(f"c.{n}").alias(n) for n in ("field", "source_a", "version_a", "value_a", "source_b", "version_b", "value_b")]
    )


@query(
    "conflict_resolve",
    """SELECT arrival_seq, strategy, CASE WHEN strategy = 'manual' THEN '' WHEN strategy = 'unknown' THEN 'a' WHEN incoming_wins THEN 'b' ELSE 'a' END AS side
       FROM {contested} WHERE prov_source <> source AND old_company IS DISTINCT FROM new_company""",
)
def _(spark, sf):
    c = _contested(spark, sf).select("arrival_seq", "strategy", F.explode("conflicts").alias("c")).where("c.field = 'company'")
    side = conflict.winning_side(F.col("strategy"), F.col("c.occurred_at_a"), F.col("c.priority_a"), F.col("c.occurred_at_b"), F.col("c.priority_b"))
    return c.select("arrival_seq", "strategy", side.alias("side"))


_clash = "(prov_source <> source AND old_{0} IS DISTINCT FROM new_{0})"
_any_clash = "(" + " OR ".join(_clash.format(f) for f in S.FIELDS) + ")"


@query(
    "conflict_merge",
    f"""SELECT arrival_seq, parked,
        {', '.join(f"CASE WHEN parked THEN NULL WHEN {_clash.format(f)} AND NOT incoming_wins THEN old_{f} ELSE new_{f} END AS {f}" for f in S.FIELDS)},
        CASE WHEN parked THEN NULL WHEN {_clash.format('company')} AND NOT incoming_wins THEN prov_source ELSE source END AS company_writer,
        CASE WHEN parked THEN NULL WHEN {_clash.format('company')} AND NOT incoming_wins THEN prov_priority ELSE priority END AS company_priority
        FROM (SELECT *, strategy = 'manual' AND {_any_clash} AS parked FROM {{contested}})""",
)
def _(spark, sf):
    c = _contested(spark, sf)
    args = [F.col(x) for x in ("stored", "prov", "incoming", "source", "occurred_at", "priority")]
    takes = F.struct(*[conflict.takes_incoming(n, conflict.effective_strategy(F.col("strategy")), *args).alias(n) for n in S.FIELDS])
    c = c.withColumn("takes", takes)
    merged = conflict.merge_fields(F.col("stored"), F.col("incoming"), F.col("takes"))
    prov = conflict.merge_provenance(F.col("prov"), F.col("takes"), F.col("source"), F.col("source_version"), F.col("occurred_at"), lambda n: F.col("priority"))
    parked = (F.size("conflicts") > 0) & (conflict.effective_strategy(F.col("strategy")) == "manual")
    c = c.select("arrival_seq", parked.alias("parked"), F.when(~parked, merged).alias("m"), F.when(~parked, prov).alias("p"))
    return c.select("arrival_seq", "parked", "m.*", F.col("p.company.source").alias("company_writer"), F.col("p.company.priority").alias("company_priority"))


@query(
    "conflict_records",
    f"""WITH r AS (SELECT *, {"CASE " + " ".join(f"WHEN {_clash.format(f)} THEN '{f}'" for f in sorted(S.FIELDS)) + " END"} AS field,
               row_number() OVER (PARTITION BY entity_id, prov_source, source, prov_version, source_version ORDER BY arrival_seq) AS k
               FROM {{contested}} WHERE {_any_clash})
        SELECT entity_id, prov_source AS source_a, prov_version AS version_a, source AS source_b, source_version AS version_b,
               CASE WHEN strategy = 'manual' THEN 'CONFLICT_PENDING' ELSE 'AUTO_RESOLVED' END AS status, strategy AS resolution_strategy, old_company, new_company
        FROM r WHERE k = 1""",
)
def _(spark, sf):
    from concord.operators.replay import conflict_records

    c = _contested(spark, sf)
    log = c.select(
        "tenant_id", F.lit("customer").alias("entity_type"), "entity_id", "event_id", "conflicts", "stored", "incoming", "strategy", "arrival_seq",
        F.lit(1).alias("delivery"), F.col("occurred_at").alias("received_at"),
        F.when((F.col("strategy") == "manual"), "parked").otherwise("applied").alias("outcome"),
    )
    r = conflict_records(log)
    return r.select(
        "entity_id", "source_a", "version_a", "source_b", "version_b", "status", "resolution_strategy",
        C.decode_snapshot(F.col("payload_a"))["company"].alias("old_company"), C.decode_snapshot(F.col("payload_b"))["company"].alias("new_company"),
    )


# Failures -----------------------------------------------------------------------------------------

VIEWS["classified"] = """
SELECT *, CASE status_code WHEN 429 THEN 'RATE_LIMITED' WHEN 401 THEN 'AUTHENTICATION' WHEN 404 THEN 'NOT_FOUND' WHEN 422 THEN 'SCHEMA_ERROR'
                           WHEN 409 THEN 'CONFLICT' WHEN 500 THEN 'TRANSIENT' WHEN 503 THEN 'TRANSIENT' WHEN 418 THEN 'UNKNOWN' END AS kind,
       CASE WHEN status_code = 429 THEN coalesce(retry_after_s, 0) ELSE 0 END AS hint
FROM {write_results}
"""
_retry = "kind NOT IN ('AUTHENTICATION', 'SCHEMA_ERROR')"


def _delay(n: str) -> str:
    exp = f"least(60.0e0, least(60.0e0, pow(2.0e0, ({n}) - 1)) * (0.7e0 + fraction * 0.6e0))"
    return f"least(CASE WHEN hint > 0 AND hint < {exp} THEN hint ELSE {exp} END, 60.0e0)"


def _results(spark, sf):
    return failures.classify(frame(spark, sf, "write_results"))


def _queue_rows(spark, sf):
    """Every failed result as a queue entry that has been tried `attempt` times."""
    state = F.when(F.col("arrival_seq") % 41 == 0, F.lit("{lost")).otherwise(F.to_json(F.struct("event_id", "source")))
    return _results(spark, sf).select(
        *S.EK, "attempt", "max_attempts", F.col("received_at").alias("next_attempt_at"), F.lit("earlier").alias("last_error"),
        F.lit("TRANSIENT").alias("error_class"), state.alias("state"), F.col("received_at").alias("updated_at"),
        "kind", "message", "hint", "fraction",
    )


@query("failure_classify", f"SELECT tenant_id, event_id, kind, hint, kind IS NOT NULL AND {_retry} AS retry FROM {{classified}}")
def _(spark, sf):
    return _results(spark, sf).select("tenant_id", "event_id", "kind", "hint", F.coalesce("retry", F.lit(False)).alias("retry"))


@query("backoff_schedule", f"SELECT event_id, attempt, {_delay('attempt')} AS delay_s FROM {{classified}} WHERE kind IS NOT NULL")
def _(spark, sf):
    return _results(spark, sf).where("kind is not null").select("event_id", "attempt", failures.delay(F.col("attempt"), F.col("hint"), F.col("fraction")).alias("delay_s"))


def _failed(spark, sf):
    return _results(spark, sf).where("kind is not null").withColumn("state", F.to_json(F.struct("event_id")))


@query(
    "failure_dispatch",
    f"""SELECT tenant_id, event_id, CASE WHEN {_retry} THEN 'retry_queue' ELSE 'dead_letter' END AS sink, kind AS error_class, message AS reason FROM {{classified}} WHERE kind IS NOT NULL""",
)
def _(spark, sf):
    retries, dead = failures.first_failure(_failed(spark, sf), X.now(), fraction=F.col("fraction"))
    return retries.select("tenant_id", "event_id", F.lit("retry_queue").alias("sink"), "error_class", F.col("last_error").alias("reason")).unionByName(
        dead.select("tenant_id", "event_id", F.lit("dead_letter").alias("sink"), "error_class", "reason")
    )


@query(
    "retry_enqueue",
    f"""SELECT tenant_id, event_id, attempt + CASE WHEN kind IS NOT NULL AND {_retry} THEN 1 ELSE 0 END AS attempt, max_attempts,
        CASE WHEN kind IS NOT NULL AND {_retry} THEN message ELSE 'earlier' END AS last_error FROM {{classified}}""",
)
def _(spark, sf):
    queue = _queue_rows(spark, sf).select(*S.EK, "attempt", "max_attempts", "next_attempt_at", "last_error", "error_class", "state", "updated_at")
    retries, _ = failures.first_failure(_failed(spark, sf), X.now(), max_attempts=99, fraction=F.col("fraction"))
    return failures.enqueue(queue, retries).select("tenant_id", "event_id", "attempt", "max_attempts", "last_error")


@query("retry_due", "SELECT tenant_id, event_id, received_at AS next_attempt_at FROM {write_results} WHERE received_at <= TIMESTAMP '2024-01-08 00:00:00' ORDER BY received_at, tenant_id, event_id LIMIT 100")
def _(spark, sf):
    return failures.due(_queue_rows(spark, sf), F.expr("timestamp_ntz'2024-01-08 00:00:00'")).select("tenant_id", "event_id", "next_attempt_at")


@query(
    "retry_outcome",
    f"""SELECT event_id, d AS decision, attempt + 1 AS n, CASE WHEN lost THEN 'SCHEMA_ERROR' ELSE kind END AS final_class,
        CASE WHEN lost THEN 'unreadable retry entry' ELSE message END AS final_reason, CASE WHEN d = 'requeue' THEN {_delay('attempt + 1')} END AS delay_s
        FROM (SELECT *, arrival_seq % 41 = 0 AS lost, CASE WHEN arrival_seq % 41 = 0 THEN 'dead_letter' WHEN kind IS NULL THEN 'succeeded'
              WHEN NOT ({_retry}) OR attempt + 1 >= max_attempts THEN 'dead_letter' ELSE 'requeue' END AS d FROM {{classified}})""",
)
def _(spark, sf):
    return failures.retry_outcome(_queue_rows(spark, sf), X.now(), F.col("fraction")).select("event_id", "decision", "n", "final_class", "final_reason", "delay_s")


VIEWS["settled"] = f"""
SELECT *, CASE WHEN arrival_seq % 41 = 0 THEN 'dead_letter' WHEN kind IS NULL THEN 'succeeded'
              WHEN NOT ({_retry}) OR attempt + 1 >= max_attempts THEN 'dead_letter' ELSE 'requeue' END AS decision FROM {{classified}}
"""


def _letters(spark, sf):
    """Letters of earlier failures: some open, some already discarded or resolved."""
    r = frame(spark, sf, "write_results")
    n = F.col("arrival_seq") % 3
    return r.select(
        *S.EK, F.lit("old").alias("reason"), F.lit("TRANSIENT").alias("error_class"), F.to_json(F.struct("event_id")).alias("payload"),
        F.when(n == 0, "open").when(n == 1, "discarded").otherwise("resolved").alias("status"), F.col("received_at").alias("created_at"),
        F.when(n != 0, F.col("received_at")).alias("resolved_at"),
    )


@query(
    "dead_letter_settle",
    """SELECT event_id, CASE WHEN decision = 'dead_letter' THEN 'open' WHEN decision = 'succeeded' AND arrival_seq % 3 <> 1 THEN 'resolved'
              ELSE CASE arrival_seq % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'discarded' ELSE 'resolved' END END AS status,
       CASE WHEN decision <> 'dead_letter' THEN 'old' WHEN arrival_seq % 41 = 0 THEN 'unreadable retry entry' ELSE message END AS reason FROM {settled}""",
)
def _(spark, sf):
    rows = _queue_rows(spark, sf)
    decided = failures.retry_outcome(rows, X.now(), F.col("fraction"))
    queue = rows.select(*S.EK, "attempt", "max_attempts", "next_attempt_at", "last_error", "error_class", "state", "updated_at")
    _, letters = failures.settle(queue, _letters(spark, sf), decided, X.now())
    return letters.select("event_id", "status", "reason")


@query("retry_settle", "SELECT event_id, attempt + 1 AS attempt, message AS last_error, kind AS error_class FROM {settled} WHERE decision = 'requeue'")
def _(spark, sf):
    rows = _queue_rows(spark, sf)
    decided = failures.retry_outcome(rows, X.now(), F.col("fraction"))
    queue = rows.select(*S.EK, "attempt", "max_attempts", "next_attempt_at", "last_error", "error_class", "state", "updated_at")
    queue, _ = failures.settle(queue, _letters(spark, sf), decided, X.now())
    return queue.select("event_id", "attempt", "last_error", "error_class")


def _letter_decisions(spark, sf):
    r = frame(spark, sf, "write_results").where("status_code in (401, 422, 500)")
    return r.select(*S.EK, F.when(F.col("status_code") == 401, "discard").otherwise("retry").alias("action"), F.lit("ops").alias("actor"))


@query(
    "dead_letter_decide",
    """SELECT event_id, CASE status_code WHEN 401 THEN 'discarded' WHEN 422 THEN 'retrying' WHEN 500 THEN 'retrying'
                             ELSE CASE arrival_seq % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'discarded' ELSE 'resolved' END END AS status,
       status_code IN (422, 500) AS queued, CASE status_code WHEN 401 THEN 'dlq.discard' WHEN 422 THEN 'dlq.retry' WHEN 500 THEN 'dlq.retry' END AS audit_action FROM {write_results}""",
)
def _(spark, sf):
    letters, entries, audit = failures.decide_letters(_letters(spark, sf), _letter_decisions(spark, sf), X.now())
    return (
        letters.select("event_id", "status")
        .join(entries.select("event_id", F.lit(True).alias("queued")), "event_id", "left")
        .join(audit.select(F.col("resource_id").alias("event_id"), F.col("action").alias("audit_action")), "event_id", "left")
        .withColumn("queued", F.coalesce("queued", F.lit(False)))
    )


# Full sync ----------------------------------------------------------------------------------------


def _examined(spark, sf):
    return fullsync.examine(X.snapshot(spark, sf), F.col("tenant_id"), "salesforce")


@query(
    "fullsync_events",
    "SELECT concat('jobsync:job-1:', id) AS event_id, tenant_id, 'customer' AS entity_type, id AS entity_id, version AS source_version, email, 'salesforce' AS origin FROM {sf_snapshot} WHERE NOT deleted AND last_name <> ''",
)
def _(spark, sf):
    e = fullsync.to_events(_examined(spark, sf), F.lit("job-1"), X.now())
    return e.select("event_id", "tenant_id", "entity_type", "entity_id", "source_version", F.col("payload.fields")["email"].alias("email"), F.col("provenance.origin_source").alias("origin"))


@query(
    "fullsync_dead_letters",
    "SELECT concat('jobsync:job-1:', id) AS event_id, tenant_id, 'missing required field last_name' AS reason, 'SCHEMA_ERROR' AS error_class, id AS payload_entity FROM {sf_snapshot} WHERE NOT deleted AND last_name = ''",
)
def _(spark, sf):
    d = fullsync.dead_letters(_examined(spark, sf), F.lit("job-1"))
    return d.select("event_id", "tenant_id", "reason", "error_class", F.get_json_object("payload", "$.entity_id").alias("payload_entity"))


@query(
    "fullsync_counters",
    "SELECT tenant_id, count(*) FILTER (last_name <> '') AS processed, count(*) FILTER (last_name = '') AS failed, count(*) AS total, max(id) AS cursor FROM {sf_snapshot} WHERE NOT deleted GROUP BY 1",
)
def _(spark, sf):
    return fullsync.counters(_examined(spark, sf)).select("tenant_id", "processed", "failed", "total", "cursor")


@query(
    "fullsync_apply_counters",
    """SELECT tenant_id, count(*) FILTER (last_name <> '' AND ok) AS processed, count(*) FILTER (last_name = '' OR NOT ok) AS failed, count(*) AS total FROM
       (SELECT *, EXISTS (SELECT 1 FROM {connections} c WHERE c.tenant_id = s.tenant_id AND c.provider = 'salesforce' AND c.tenant_id <> 't1') AS ok FROM {sf_snapshot} s WHERE NOT deleted) GROUP BY 1""",
)
def _(spark, sf):
    job = F.lit("job-1")
    e = _examined(spark, sf)
    connected = frame(spark, sf, "connections").where("tenant_id <> 't1'")
    failed = routing.route(fullsync.to_events(e, job, X.now()), frame(spark, sf, "policies"), connected).where("static_outcome = 'failed'")
    return fullsync.counters(e, job=job, failures=failed).select("tenant_id", "processed", "failed", "total")


# Reconciliation -----------------------------------------------------------------------------------

VIEWS["compared"] = """
SELECT coalesce(s.tenant_id, c.tenant_id) AS tenant_id, coalesce(s.id, c.salesforce_id) AS provider_id, c.entity_id AS canonical_id,
       c.company AS canonical_company, s.company AS provider_company, s.version AS provider_version, c.version_salesforce,
       CASE WHEN s.id IS NOT NULL AND s.last_name = '' THEN 'invalid' WHEN c.entity_id IS NULL THEN 'missed'
            WHEN s.id IS NOT NULL AND c.tombstone THEN 'deleted'
            WHEN s.id IS NOT NULL AND (s.first_name, s.last_name, s.email, s.phone, s.company) IS DISTINCT FROM (c.first_name, c.last_name, c.email, c.phone, c.company) THEN 'drift'
            WHEN s.id IS NOT NULL THEN 'in_sync' WHEN c.tombstone THEN 'tombstoned' ELSE 'missing' END AS state
FROM (SELECT * FROM {sf_snapshot} WHERE NOT deleted) s FULL OUTER JOIN {canonical_seed} c ON s.tenant_id = c.tenant_id AND s.id = c.salesforce_id
"""
VIEWS["found"] = """
SELECT concat('run-', tenant_id) AS run_id, tenant_id, state AS kind, provider_id, coalesce(canonical_id, '') AS canonical_id,
       CASE WHEN state = 'missing' THEN version_salesforce ELSE provider_version END AS provider_version,
       CASE state WHEN 'deleted' THEN 'delete' WHEN 'missed' THEN 'adopt_provider' ELSE 'push_canonical' END AS direction,
       tenant_id <> 't3' AND ((state = 'deleted' AND p.delete_policy <> 'propagate') OR (state = 'missing' AND p.delete_policy NOT IN ('tombstone_only', 'ignore'))) AS blocked, p.delete_policy
FROM {compared} JOIN (SELECT tenant_id, delete_policy FROM {policies} WHERE source = 'salesforce') p USING (tenant_id)
WHERE state IN ('missed', 'deleted', 'drift', 'missing')
"""


def _compared(spark, sf):
    return reconcile.compare(X.snapshot(spark, sf), X.canonical_seed(spark, sf), "salesforce")


def _runs(spark, sf):
    t = frame(spark, sf, "tenants")
    requests = t.select(
        F.concat(F.lit("run-"), "tenant_id").alias("run_id"), "tenant_id", F.lit("salesforce").alias("source"),
        F.when(F.col("tenant_id") == "t3", "manual").otherwise("sometimes").alias("mode"), F.concat(F.lit("job-"), "tenant_id").alias("job_id"),
    )
    return reconcile.open_runs(requests, X.now())


def _findings(spark, sf):
    return reconcile.findings(_compared(spark, sf), frame(spark, sf, "policies"), _runs(spark, sf), X.now())


@query("reconcile_compare", "SELECT tenant_id, provider_id, canonical_id, state FROM {compared}")
def _(spark, sf):
    return _compared(spark, sf).select("tenant_id", "provider_id", "canonical_id", "state")


@query(
    "reconcile_findings",
    """SELECT run_id, kind, provider_id, canonical_id, provider_version, direction, CASE WHEN blocked THEN 'skipped' ELSE 'pending' END AS status,
       CASE WHEN blocked THEN concat('delete_policy=', delete_policy, CASE kind WHEN 'deleted' THEN ': deletes stay where they are' ELSE ': the outside deletion stands' END) END AS error FROM {found}""",
)
def _(spark, sf):
    return _findings(spark, sf).select("run_id", "kind", "provider_id", "canonical_id", "provider_version", "direction", "status", "error")


@query("reconcile_new_findings", "SELECT run_id, kind, provider_id FROM {found} WHERE kind <> 'drift'")
def _(spark, sf):
    f = _findings(spark, sf)
    return reconcile.new_findings(f.where("kind = 'drift'"), f).select("run_id", "kind", "provider_id")


@query(
    "reconcile_counters",
    """SELECT c.run_id, c.total, c.failed, coalesce(k.drift, 0) AS drift, coalesce(k.missed, 0) AS missed, coalesce(k.deleted, 0) AS deleted FROM
       (SELECT concat('run-', tenant_id) AS run_id, count(*) AS total, count(*) FILTER (state = 'invalid') AS failed FROM {compared} WHERE state NOT IN ('missing', 'tombstoned') GROUP BY 1) c
       LEFT JOIN (SELECT run_id, count(*) FILTER (kind = 'drift') AS drift, count(*) FILTER (kind IN ('missed', 'missing')) AS missed, count(*) FILTER (kind = 'deleted') AS deleted FROM {found} GROUP BY 1) k USING (run_id)""",
)
def _(spark, sf):
    return reconcile.run_counters(_compared(spark, sf), _findings(spark, sf), _runs(spark, sf)).select("run_id", "total", "failed", "drift", "missed", "deleted")


@query(
    "reconcile_close_runs",
    """SELECT concat('run-', tenant_id) AS run_id, CASE WHEN tenant_id = 't3' THEN 'manual' ELSE 'auto' END AS mode, 'completed' AS status, count(*) FILTER (state NOT IN ('missing', 'tombstoned')) AS total,
       count(*) FILTER (state = 'drift') AS drift FROM {compared} GROUP BY tenant_id""",
)
def _(spark, sf):
    runs = _runs(spark, sf)
    counted = reconcile.run_counters(_compared(spark, sf), _findings(spark, sf), runs)
    return reconcile.close_runs(runs, counted, X.now()).select("run_id", "mode", "status", "total", "drift")


@query(
    "reconcile_repair_rows",
    """SELECT concat('run-', c.tenant_id) AS run_id, f.provider_id, CASE f.direction WHEN 'delete' THEN 'delete' WHEN 'push_canonical' THEN CASE f.kind WHEN 'missing' THEN 'create' ELSE 'update' END END AS op,
       CASE f.direction WHEN 'push_canonical' THEN c.company END AS company
       FROM {found} f JOIN {canonical_seed} c ON f.tenant_id = c.tenant_id AND f.canonical_id = c.entity_id WHERE NOT f.blocked AND f.direction <> 'adopt_provider'""",
)
def _(spark, sf):
    f, runs = _findings(spark, sf), _runs(spark, sf)
    key = f.select("finding_id", "run_id", F.col("provider_id").alias("found_id"))
    d = reconcile.delete_repairs(f, runs)
    p = reconcile.push_repairs(f, runs, X.canonical_seed(spark, sf))
    cols = ["finding_id", "op", "payload"]
    return (
        d.select(*cols).unionByName(p.select(*cols)).join(key, "finding_id")
        .select("run_id", F.col("found_id").alias("provider_id"), "op", F.col("payload")["company"].alias("company"))
    )


@query(
    "reconcile_repair_events",
    """SELECT tenant_id, provider_id AS entity_id, provider_version AS source_version, 'updated' AS event_type, direction FROM {found} WHERE NOT blocked""",
)
def _(spark, sf):
    f = _findings(spark, sf)
    e = reconcile.repair_events(f, _runs(spark, sf), X.now())
    d = f.select(C.compose_id("reconcile", F.col("finding_id")).alias("event_id"), "direction")
    return e.join(d, "event_id").select("tenant_id", "entity_id", "source_version", "event_type", "direction")


def _pushed(spark, sf):
    p = reconcile.push_repairs(_findings(spark, sf), _runs(spark, sf), X.canonical_seed(spark, sf))
    results = p.select("tenant_id", "event_id", (F.col("provider_version") + 1).alias("new_version"))
    return reconcile.pushed_state(X.canonical_seed(spark, sf), p, results)


@query(
    "reconcile_pushed_state",
    """SELECT c.entity_id, c.version + 1 AS version, f.provider_version + 1 AS version_salesforce, false AS tombstone, c.hubspot_id
       FROM {found} f JOIN {canonical_seed} c ON f.tenant_id = c.tenant_id AND f.canonical_id = c.entity_id WHERE NOT f.blocked AND f.direction = 'push_canonical'""",
)
def _(spark, sf):
    return _pushed(spark, sf).select(
        "entity_id", "version", F.col("source_versions")["salesforce"].alias("version_salesforce"), "tombstone", F.try_element_at("provider_ids", F.lit("hubspot")).alias("hubspot_id")
    )


VIEWS["repairs"] = """
SELECT *, a <> 4 AND a <> 2 AND NOT gone AND NOT (a = 1 AND kind = 'missing') AS good FROM (
  SELECT *, n % 5 AS a, direction = 'push_canonical' AND n % 7 = 3 AS gone FROM (
    SELECT *, CAST(right(canonical_id, 6) AS int) AS n FROM {found} WHERE NOT blocked AND direction <> 'adopt_provider') x) y
"""


@query(
    "reconcile_outcomes",
    """SELECT run_id, kind, provider_id, canonical_id, CASE WHEN gone THEN 'skipped' WHEN good THEN 'applied' WHEN a = 4 THEN 'pending' ELSE 'failed' END AS status,
       CASE WHEN gone THEN 'the canonical record is gone' WHEN a = 2 THEN 'slow down' WHEN a = 1 AND NOT good THEN 'NOT_FOUND' END AS error,
       CASE WHEN good THEN provider_version END AS ledger_version, CASE WHEN good AND direction = 'push_canonical' THEN provider_version + CASE WHEN a = 1 THEN 2 ELSE 1 END END AS echo_version
       FROM {repairs}
       UNION ALL SELECT run_id, kind, provider_id, canonical_id, CASE WHEN blocked THEN 'skipped' ELSE 'pending' END,
       CASE WHEN blocked THEN concat('delete_policy=', delete_policy, CASE kind WHEN 'deleted' THEN ': deletes stay where they are' ELSE ': the outside deletion stands' END) END, NULL, NULL
       FROM {found} WHERE blocked OR direction = 'adopt_provider'""",
)
def _(spark, sf):
    f, runs = cut_lineage(_findings(spark, sf), "findings"), _runs(spark, sf)
    n = F.substring("entity_id", -6, 6).cast("int")
    answer, none = n % 5, F.lit(None).cast("string")
    kept = X.canonical_seed(spark, sf).where(n % 7 != 3)
    changes = cut_lineage(reconcile.delete_repairs(f, runs).unionByName(reconcile.push_repairs(f, runs, kept)), "repairs")
    results = changes.where(F.col("op").isNotNull() & (answer != 4)).select(
        "tenant_id", "event_id", F.when(answer == 1, "NOT_FOUND").when(answer == 2, "RATE_LIMITED").alias("kind"),
        F.when(answer == 2, "slow down").alias("message"), (F.col("provider_version") + 1).alias("new_version"),
    )
    again = reconcile.recreate_not_found(changes, results)
    created = again.select("tenant_id", "event_id", none.alias("kind"), none.alias("message"), (F.col("provider_version") + 2).alias("new_version"))
    rounds = [reconcile.repair_outcomes(c, r, X.now()) for c, r in ((changes, results), (again, created))]
    moves, ledger, sent = (first.unionByName(second) for first, second in zip(*rounds, strict=True))
    done = reconcile.set_finding_status(f, moves, X.now()).withColumn("event_id", C.compose_id("reconcile", F.col("finding_id")))
    ledger = ledger.select("event_id", F.col("applied_version").alias("ledger_version"))
    sent = sent.select("tenant_id", F.col("entity_id").alias("canonical_id"), F.col("applied_version").alias("echo_version"))
    return done.join(ledger, "event_id", "left").join(sent, ["tenant_id", "canonical_id"], "left").select(
        "run_id", "kind", "provider_id", "canonical_id", "status", "error", "ledger_version", "echo_version"
    )


def _adopted(spark, sf):
    from concord.operators.replay import replay

    events = reconcile.adopt_events(_findings(spark, sf), _runs(spark, sf), X.now())
    return replay(events, X.canonical_seed(spark, sf), frame(spark, sf, "policies"))


@query(
    "reconcile_adopt",
    """SELECT coalesce(m.entity_id, f.provider_id) AS entity_id, s.phone, s.company, coalesce(m.version, 0) + 1 AS version, s.version AS version_salesforce, 100 AS company_priority, f.provider_id AS salesforce_id
       FROM {found} f JOIN {sf_snapshot} s ON s.tenant_id = f.tenant_id AND s.id = f.provider_id
       LEFT JOIN (SELECT * FROM {canonical_seed} WHERE NOT tombstone) m ON m.tenant_id = f.tenant_id AND m.email = s.email WHERE f.kind = 'missed'""",
)
def _(spark, sf):
    c = _adopted(spark, sf).canonical
    return c.select(
        "entity_id", "fields.phone", "fields.company", "version", F.col("source_versions")["salesforce"].alias("version_salesforce"),
        F.col("field_provenance")["company"]["priority"].alias("company_priority"), F.col("provider_ids")["salesforce"].alias("salesforce_id"),
    )


def _finding_decisions(f):
    n = F.pmod(F.col("provider_version"), F.lit(4))
    return f.select(
        "finding_id", F.when(n == 3, "dismiss").otherwise("apply").alias("action"),
        F.when(n == 1, "adopt_provider").when(n == 2, "sideways").otherwise("").alias("direction"), F.lit("ops").alias("actor"),
    )


@query(
    "finding_decide",
    """SELECT run_id, kind, provider_id, CASE WHEN blocked THEN 'already decided' WHEN provider_version % 4 = 2 THEN 'no such direction' END AS problem,
       CASE provider_version % 4 WHEN 1 THEN 'adopt_provider' WHEN 2 THEN 'sideways' ELSE direction END AS direction FROM {found}""",
)
def _(spark, sf):
    f = _findings(spark, sf)
    return reconcile.decide_findings(f, _finding_decisions(f)).select("run_id", "kind", "provider_id", "problem", "direction")


@query(
    "finding_status",
    """SELECT run_id, kind, provider_id, CASE WHEN blocked THEN 'skipped' WHEN provider_version % 4 = 3 THEN 'dismissed' WHEN provider_version % 4 = 2 THEN 'pending' ELSE 'applied' END AS status FROM {found}""",
)
def _(spark, sf):
    f = _findings(spark, sf)
    d = reconcile.decide_findings(f, _finding_decisions(f)).where("problem is null")
    moves = d.select("finding_id", F.when(F.col("action") == "dismiss", "dismissed").otherwise("applied").alias("to"), F.lit(None).cast("string").alias("error"))
    return reconcile.set_finding_status(f, moves, X.now()).select("run_id", "kind", "provider_id", "status")


# Decisions ----------------------------------------------------------------------------------------


def _audit(spark, sf):
    f = _findings(spark, sf)
    _, _, letters = failures.decide_letters(_letters(spark, sf), _letter_decisions(spark, sf), X.now())
    found = reconcile.finding_audit(reconcile.decide_findings(f, _finding_decisions(f)), X.now())
    return letters.unionByName(found)


@query(
    "audit_rows",
    """SELECT tenant_id, CASE status_code WHEN 401 THEN 'dlq.discard' ELSE 'dlq.retry' END AS action, 'dead_letter' AS resource_type, count(*) AS n FROM {write_results} WHERE status_code IN (401, 422, 500) GROUP BY 1, 2
       UNION ALL SELECT tenant_id, CASE WHEN provider_version % 4 = 3 THEN 'finding.dismiss' ELSE 'finding.apply' END, 'reconciliation_finding', count(*) FROM {found} WHERE NOT blocked AND provider_version % 4 <> 2 GROUP BY 1, 2""",
)
def _(spark, sf):
    return _audit(spark, sf).groupBy("tenant_id", "action", "resource_type").agg(F.count(F.lit(1)).alias("n"))


# Reports ------------------------------------------------------------------------------------------


@query("report_audit", "SELECT event_id AS resource_id, 'dlq.retry' AS action FROM {write_results} WHERE status_code IN (422, 500) AND tenant_id = 't1' ORDER BY event_id LIMIT 15")
def _(spark, sf):
    return reports.audit(_audit(spark, sf), "t1", actor="ops", action="dlq.retry", resource="dead_letter", limit=15).select("resource_id", "action")


@query("report_source_events", "SELECT event_id, received_at FROM {change_feed} WHERE delivery = 1 AND tenant_id = 't2' ORDER BY received_at DESC LIMIT 10")
def _(spark, sf):
    e = X.change_events(spark, sf).where("delivery = 1")
    return reports.source_events(e, "t2", 10).select("event_id", "received_at")


@query("report_dead_letters", "SELECT event_id, 'open' AS status FROM {write_results} WHERE arrival_seq % 3 = 0 AND tenant_id = 't0' ORDER BY received_at DESC, event_id LIMIT 20")
def _(spark, sf):
    return reports.dead_letters(_letters(spark, sf), "t0", "open", 20).select("event_id", "status")


@query("report_findings", "SELECT kind, provider_id FROM {found} WHERE run_id = 'run-t1' AND blocked ")
def _(spark, sf):
    return reports.findings(_findings(spark, sf), "t1", "run-t1", "skipped", 1000).select("kind", "provider_id")


@query("report_runs", "SELECT concat('run-', tenant_id) AS run_id, count(*) AS runs FROM {tenants} WHERE tenant_id = 't1' GROUP BY 1")
def _(spark, sf):
    return reports.runs(_runs(spark, sf), "t1", 5).groupBy("run_id").agg(F.count(F.lit(1)).alias("runs"))


@query("report_operations", "SELECT event_id, source FROM {write_results} WHERE tenant_id = 't3' AND source = 'hubspot' ORDER BY received_at DESC, event_id LIMIT 15")
def _(spark, sf):
    ops = frame(spark, sf, "write_results").select(
        "tenant_id", F.lit("customer").alias("entity_type"), F.col("event_id").alias("entity_id"), "source",
        F.when(F.col("source") == "hubspot", "salesforce").otherwise("hubspot").alias("target_source"), "event_id", F.col("received_at").alias("created_at"),
    )
    return reports.operations(ops, "t3", "customer", None, "salesforce", 15).select("event_id", "source")


@query(
    "report_sync_jobs",
    "SELECT concat('job-', cast(o_orderkey AS varchar)) AS job_id FROM {orders} WHERE o_custkey % 5 = 1 ORDER BY o_orderdate DESC, concat('job-', cast(o_orderkey AS varchar)) LIMIT 10",
)
def _(spark, sf):
    jobs = frame(spark, sf, "orders").select(
        F.concat(F.lit("job-"), F.col("o_orderkey").cast("string")).alias("job_id"), F.concat(F.lit("t"), (F.col("o_custkey") % 5).cast("string")).alias("tenant_id"), F.col("o_orderdate").alias("created_at")
    )
    return reports.sync_jobs(jobs, "t1", 10).select("job_id")


@query(
    "report_dimensions",
    """SELECT 'tenant' AS what, slug AS name FROM {tenants} UNION ALL SELECT 'connection', provider FROM {connections} WHERE tenant_id = 't1'
       UNION ALL SELECT 'policy', concat(source, '>', destination) FROM {policies} WHERE tenant_id = 't1'""",
)
def _(spark, sf):
    t = reports.tenants(frame(spark, sf, "tenants")).select(F.lit("tenant").alias("what"), F.col("slug").alias("name"))
    c = reports.connections(frame(spark, sf, "connections"), "t1").select(F.lit("connection").alias("what"), F.col("provider").alias("name"))
    p = reports.policies(frame(spark, sf, "policies"), "t1").select(F.lit("policy").alias("what"), F.concat_ws(">", "source", "destination").alias("name"))
    return t.unionByName(c).unionByName(p)


@query("report_live_sessions", "SELECT session_id, created_at FROM {sessions} WHERE tenant_id = 't2' AND revoked_at IS NULL AND expires_at > TIMESTAMP '1998-06-01 00:00:00' ORDER BY created_at DESC, session_id LIMIT 500")
def _(spark, sf):
    return reports.live_sessions(frame(spark, sf, "sessions"), "t2", F.expr("timestamp_ntz'1998-06-01 00:00:00'"), 500).select("session_id", "created_at")


@query("report_processed_counts", "SELECT tenant_id, count(DISTINCT (source, event_id)) AS processed FROM {change_feed} GROUP BY 1")
def _(spark, sf):
    return reports.processed_counts(routing.first_deliveries(X.change_events(spark, sf)))


@query(
    "report_convergence",
    """SELECT tenant_id, e.source, e.pending, c.canonical, d.dead, q.retrying, greatest(0, e.source - c.canonical - d.dead) AS data_loss FROM
       (SELECT tenant_id, count(*) AS source, count(*) AS pending FROM {change_feed} WHERE delivery = 1 GROUP BY 1) e JOIN (SELECT tenant_id, count(*) AS canonical FROM {canonical_seed} GROUP BY 1) c USING (tenant_id)
       JOIN (SELECT tenant_id, count(*) AS dead FROM {write_results} GROUP BY 1) d USING (tenant_id) JOIN (SELECT tenant_id, count(*) AS retrying FROM {write_results} GROUP BY 1) q USING (tenant_id)""",
)
def _(spark, sf):
    e = X.change_events(spark, sf).where("delivery = 1").withColumn("status", F.lit("received"))
    return reports.convergence(e, X.canonical_seed(spark, sf), _letters(spark, sf), _queue_rows(spark, sf))


def _settled(spark, sf):
    r = frame(spark, sf, "write_results")
    return r.where("status_code < 300"), r.where("status_code in (401, 422)")


@query(
    "report_unsettled",
    """SELECT DISTINCT tenant_id, source, event_id FROM {change_feed} f WHERE event_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {write_results} r
       WHERE r.tenant_id = f.tenant_id AND r.source = f.source AND r.event_id = f.event_id AND (status_code < 300 OR status_code IN (401, 422)))""",
)
def _(spark, sf):
    return reports.unsettled(X.change_events(spark, sf), *_settled(spark, sf))


@query(
    "report_unsettled_estimate",
    """WITH e AS (SELECT DISTINCT tenant_id, source, event_id, cast(received_at AS date) AS day FROM {change_feed} WHERE event_id IS NOT NULL),
       d AS (SELECT DISTINCT tenant_id, source, event_id FROM {write_results} WHERE status_code < 300 OR status_code IN (401, 422))
       SELECT e.tenant_id, day, count(*) AS received, count(*) - count(d.event_id) AS unsettled FROM e LEFT JOIN d
       ON d.tenant_id = e.tenant_id AND d.source = e.source AND d.event_id = e.event_id GROUP BY 1, 2""",
)
def _(spark, sf):
    sketches = [reports.key_sketches(df, "received_at") for df in (X.change_events(spark, sf), *_settled(spark, sf))]
    return reports.unsettled_estimate(*sketches)


@query("report_duplicate_emails", "SELECT tenant_id, email, count(*) AS n FROM {edits} GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    return reports.duplicate_emails(frame(spark, sf, "edits"))


@query(
    "report_lockouts",
    """WITH e AS (SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY tenant_id, email ORDER BY attempted_at) AS epoch FROM {login_attempts}),
       n AS (SELECT *, sum(CASE WHEN success THEN 0 ELSE 1 END) OVER (PARTITION BY tenant_id, email, epoch ORDER BY attempted_at RANGE BETWEEN INTERVAL '899999999' MICROSECOND PRECEDING AND CURRENT ROW) AS recent_failures FROM e)
       SELECT tenant_id, email, attempted_at, cast(recent_failures AS bigint) AS recent_failures FROM n WHERE NOT success AND recent_failures >= 5""",
)
def _(spark, sf):
    return reports.lockouts(frame(spark, sf, "login_attempts"))


@query(
    "report_throttled",
    """WITH RECURSIVE a AS (SELECT ip, attempted_at AS t, count(*) AS n FROM {login_attempts} GROUP BY 1, 2),
       w AS (SELECT ip, min(t) AS opened_at FROM a GROUP BY 1
             UNION ALL SELECT w.ip, (SELECT min(t) FROM a WHERE a.ip = w.ip AND a.t >= w.opened_at + INTERVAL '60' SECOND) FROM w WHERE w.opened_at IS NOT NULL),
       s AS (SELECT ip, opened_at FROM w WHERE opened_at IS NOT NULL)
       SELECT s.ip, s.opened_at, cast(sum(a.n) AS bigint) AS attempts, cast(greatest(0, sum(a.n) - 12) AS bigint) AS refused
       FROM s JOIN a ON a.ip = s.ip AND a.t >= s.opened_at AND a.t < s.opened_at + INTERVAL '60' SECOND GROUP BY 1, 2""",
    recursive=True,
)
def _(spark, sf):
    return reports.throttled(frame(spark, sf, "login_attempts"), limit=12)


@query("report_throttled_tumbling", "SELECT ip, date_trunc('minute', attempted_at) AS minute, count(*) - 12 AS refused FROM {login_attempts} GROUP BY 1, 2 HAVING count(*) > 12")
def _(spark, sf):
    return reports.throttled_tumbling(frame(spark, sf, "login_attempts"), limit=12)


@query("tenant_scope", "SELECT CASE WHEN tenant_id = 't1' THEN 'visible' ELSE 'foreign' END AS what, tenant_id, count(*) AS n FROM {change_feed} GROUP BY 1, 2")
def _(spark, sf):
    c = frame(spark, sf, "change_feed")
    views = {"visible": scope.scoped(c, "t1"), "without_tenant": scope.scoped(c, None), "foreign": scope.foreign_rows(c, "t1")}
    seen = None
    for what, rows in views.items():
        named = rows.groupBy(F.lit(what).alias("what"), "tenant_id").agg(F.count(F.lit(1)).alias("n"))
        seen = named if seen is None else seen.unionByName(named)
    return seen


# Metrics ------------------------------------------------------------------------------------------


@query(
    "metric_rate",
    """SELECT source, window_end, count(*) / 60.0e0 AS per_second FROM
       (SELECT source, time_bucket(INTERVAL '15' SECOND, received_at) + k * INTERVAL '15' SECOND AS window_end FROM {change_feed} CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k)) GROUP BY 1, 2""",
)
def _(spark, sf):
    return metrics.rate(metrics.per_step(frame(spark, sf, "change_feed"), "received_at", ["source"]), ["source"])


@query(
    "metric_increase",
    """SELECT window_end, count(*) AS n FROM (SELECT time_bucket(INTERVAL '15' SECOND, received_at) + k * INTERVAL '15' SECOND AS window_end FROM {change_feed} CROSS JOIN (SELECT unnest(range(1, 21)) AS k)) GROUP BY 1""",
)
def _(spark, sf):
    return metrics.increase(metrics.per_step(frame(spark, sf, "change_feed"), "received_at"))


_LE = [f"{b:g}" for b in metrics.DURATION_BOUNDS]
VIEWS["cells"] = " UNION ALL ".join(
    f"SELECT route, {i} AS pos, '{le}' AS le, {b}e0 AS bound, count(*) FILTER (duration_s <= {b}e0) AS cumulative FROM {{request_log}} GROUP BY route"
    for i, (le, b) in enumerate(zip(_LE, metrics.DURATION_BOUNDS))
) + f" UNION ALL SELECT route, {len(_LE)}, '+Inf', 1e300, count(*) FROM {{request_log}} GROUP BY route"


@query("metric_histogram", "SELECT route, pos, le, cumulative FROM {cells}")
def _(spark, sf):
    return metrics.buckets(metrics.histogram(frame(spark, sf, "request_log"), "duration_s", ["route"]), ["route"])


@query(
    "metric_quantiles",
    """WITH c AS (SELECT *, lag(cumulative, 1, 0) OVER w AS below, lag(bound, 1, 0.0e0) OVER w AS low, max(cumulative) OVER (PARTITION BY route) AS total FROM {cells} WINDOW w AS (PARTITION BY route ORDER BY pos)),
       q AS (SELECT route, arg_min(CASE WHEN le = '+Inf' THEN 60.0e0 ELSE low + (bound - low) * ((total * 0.95e0 - below) / (cumulative - below)) END, pos) AS p95 FROM c WHERE cumulative >= total * 0.95e0 GROUP BY 1),
       b AS (SELECT route, arg_min(le, pos) AS p50_bound FROM c WHERE cumulative >= total * 0.5e0 GROUP BY 1)
       SELECT route, p95, p50_bound FROM q JOIN b USING (route)""",
)
def _(spark, sf):
    h = metrics.histogram(frame(spark, sf, "request_log"), "duration_s", ["route"])
    return h.select("route", metrics.histogram_quantile(F.col("cumulative"), 0.95).alias("p95"), metrics.bucket_bound(F.col("cumulative"), 0.5).alias("p50_bound"))


@query(
    "metric_exact_percentiles",
    """WITH r AS (SELECT route, duration_s, row_number() OVER (PARTITION BY route ORDER BY duration_s) - 1 AS i, count(*) OVER (PARTITION BY route) AS n FROM {request_log})
       SELECT route, p, n, min(duration_s) AS value FROM r CROSS JOIN (SELECT unnest([0.5e0, 0.95e0, 0.99e0]) AS p) WHERE i = cast(floor((n - 1) * p) AS bigint) GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return metrics.exact_percentiles(frame(spark, sf, "request_log"), "duration_s", [0.5, 0.95, 0.99], ["route"])


@query(
    "burst_summary",
    """WITH r AS (SELECT route, duration_s * 1000 AS l, row_number() OVER (PARTITION BY route ORDER BY duration_s) - 1 AS i, count(*) OVER (PARTITION BY route) AS n FROM {request_log}),
       b AS (SELECT route, count(*) AS sent, count(*) FILTER (status = 200) AS accepted, count(*) FILTER (status <> 200) AS rejected, 0 AS errors, date_diff('microsecond', min(ts), max(ts)) / 1e6 AS elapsed_s FROM {request_log} GROUP BY 1)
       SELECT b.*, max(CASE WHEN i = floor((n - 1) * 0.5e0) THEN l END) AS p50, max(CASE WHEN i = floor((n - 1) * 0.95e0) THEN l END) AS p95, max(CASE WHEN i = floor((n - 1) * 0.99e0) THEN l END) AS p99,
              accepted / elapsed_s AS throughput FROM b JOIN r USING (route) GROUP BY ALL""",
)
def _(spark, sf):
    log = frame(spark, sf, "request_log").select("route", "status", (F.col("duration_s") * 1000).alias("latency_ms"), F.col("ts").alias("at"))
    return metrics.burst_summary(log, ["route"])


@query(
    "metric_counter_deltas",
    """SELECT concat(source, ':', event_type) AS metric, count(*) FILTER (delivery = 2) + count(*) FILTER (delivery = 1) - count(*) FILTER (delivery = 1) AS delta FROM {change_feed} GROUP BY 1""",
)
def _(spark, sf):
    c = frame(spark, sf, "change_feed").withColumn("metric", F.concat_ws(":", "source", "event_type"))
    before = c.where("delivery = 1").groupBy("metric").agg(F.count(F.lit(1)).alias("value"))
    return metrics.counter_deltas(before, c.groupBy("metric").agg(F.count(F.lit(1)).alias("value")))


@query(
    "metric_in_flight",
    """WITH m AS (SELECT ts AS moment, 1 AS d FROM {request_log} UNION ALL SELECT ts + to_microseconds(cast(round(duration_s * 1000000) AS bigint)), -1 FROM {request_log}),
       n AS (SELECT time_bucket(INTERVAL '15' SECOND, moment) AS step, sum(d) AS d FROM m GROUP BY 1)
       SELECT step, cast(sum(d) OVER (ORDER BY step) AS bigint) AS in_flight FROM n""",
)
def _(spark, sf):
    return metrics.in_flight(frame(spark, sf, "request_log"))


@query(
    "metric_outcome_counters",
    """SELECT date_trunc('minute', received_at) AS window_start, source, count(*) AS events, count(*) FILTER (status_code = 200) AS success, count(*) FILTER (status_code <> 200) AS failed,
       count(*) FILTER (status_code NOT IN (200, 401, 422)) AS retries_scheduled, count(*) FILTER (status_code IN (401, 422)) AS dlq FROM {write_results} GROUP BY 1, 2""",
)
def _(spark, sf):
    r = _results(spark, sf).select(
        "source", F.when(F.col("kind").isNull(), "applied").otherwise("failed").alias("outcome"), "kind", F.col("received_at").alias("at"), F.lit(1).alias("n_writes"), F.lit(0).alias("n_conflicts")
    )
    return metrics.outcome_counters(r).select("window_start", "source", "events", "success", "failed", "retries_scheduled", "dlq")


@query("metric_writes_by_target", "SELECT date_trunc('minute', received_at) AS window_start, CASE source WHEN 'hubspot' THEN 'salesforce' ELSE 'hubspot' END AS target, count(*) AS destination_writes FROM {write_results} GROUP BY 1, 2")
def _(spark, sf):
    r = frame(spark, sf, "write_results").select(F.when(F.col("source") == "hubspot", "salesforce").otherwise("hubspot").alias("target"), F.col("received_at").alias("at"))
    return metrics.writes_by_target(r)


@query("metric_finding_counters", "SELECT 'salesforce' AS source, (SELECT count(DISTINCT tenant_id) FROM {compared}) AS runs, count(*) AS findings, count(*) FILTER (NOT blocked AND kind = 'drift') AS repairs FROM {found}")
def _(spark, sf):
    f = _findings(spark, sf)
    applied = f.withColumn("status", F.when((F.col("status") == "pending") & (F.col("kind") == "drift"), "applied").otherwise(F.col("status")))
    return metrics.finding_counters(applied, _runs(spark, sf).withColumn("status", F.lit("completed")))


ALERT_STEP = 60
ALERT_SQL: dict[str, str] = {}
_DENSE = """
WITH g AS (SELECT unnest(generate_series(lo, hi, INTERVAL '60' SECOND)) AS step FROM (SELECT min(time_bucket(INTERVAL '60' SECOND, done_at)) AS lo, max(time_bucket(INTERVAL '60' SECOND, done_at)) AS hi FROM {write_results})),
     s AS (SELECT time_bucket(INTERVAL '60' SECOND, done_at) AS step, count(*) AS events, count(*) FILTER (status_code <> 200) AS failed, count(*) FILTER (status_code = 200) AS success,
                  coalesce(sum(weight) FILTER (status_code NOT IN (200, 401, 422)), 0) AS retries, count(*) FILTER (status_code IN (401, 422)) AS dlq, coalesce(sum(weight) FILTER (status_code = 409), 0) AS conflicts,
                  coalesce(sum(weight) FILTER (status_code = 404), 0) AS findings, count(*) AS requests, count(*) FILTER (status_code IN (500, 503)) AS errors FROM {write_results} GROUP BY 1),
     d AS (SELECT g.step, __COLS__ FROM g LEFT JOIN s USING (step)),
     v AS (SELECT step, __VALUE__ AS value FROM d WINDOW w5 AS (ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w10 AS (ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
     t AS (SELECT *, row_number() OVER (ORDER BY step) AS pos, coalesce(value __COND__, false) AS active FROM v),
     i AS (SELECT *, pos - row_number() OVER (ORDER BY step) AS island FROM t WHERE active),
     f AS (SELECT *, min(pos) OVER (PARTITION BY island) AS p0, min(step) OVER (PARTITION BY island) AS since FROM i)
SELECT '__NAME__' AS alert, step, since, value FROM f WHERE (pos - p0) * 60 >= __HOLD__
""".replace("__COLS__", ", ".join(f"coalesce({c}, 0) AS {c}" for c in "events failed success retries dlq conflicts findings requests errors".split()))


def _observations(spark, sf):
    r = frame(spark, sf, "write_results")
    code = F.col("status_code")
    named = {
        "events": F.lit(1), "failed": F.when(code != 200, 1), "success": F.when(code == 200, 1), "retries": F.when(~code.isin(200, 401, 422), F.col("weight")),
        "dlq": F.when(code.isin(401, 422), 1), "conflicts": F.when(code == 409, F.col("weight")), "findings": F.when(code == 404, F.col("weight")), "requests": F.lit(1),
        "errors": F.when(code.isin(500, 503), 1),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("bigint").alias("n")) for k, v in named.items()])
    return r.select(F.col("done_at").alias("at"), F.explode(rows).alias("o")).where("o.n is not null").select("at", "o.metric", "o.n")


for _name, _value, _cond in (
    ("event_failure_rate_high", "sum(failed) OVER w5 / nullif(sum(events) OVER w5, 0)", "> 0.05"),
    ("dlq_growth", "cast(sum(dlq) OVER w10 AS double)", "> 0"),
    ("retry_backlog", "(sum(retries) OVER w5 - sum(success) OVER w5) / 300.0e0", "> 0.1"),
    ("reconcile_drift_spike", "cast(sum(findings) OVER w10 AS double)", "> 100"),
    ("conflict_spike", "cast(sum(conflicts) OVER w10 AS double)", "> 100"),
    ("no_events_processed", "cast(sum(events) OVER w10 AS double)", "= 0"),
    ("api_error_rate_high", "sum(errors) OVER w5 / nullif(sum(requests) OVER w5, 0)", "> 0.1"),
):
    _sql = _DENSE
    for _mark, _text in (("__VALUE__", _value), ("__COND__", _cond), ("__NAME__", _name), ("__HOLD__", str(metrics.ALERTS[_name]["hold"]))):
        _sql = _sql.replace(_mark, _text)
    ALERT_SQL[_name] = _sql
    query(f"alert_{_name}", _sql)(lambda spark, sf, _n=_name: metrics.alert(_observations(spark, sf), _n, ALERT_STEP))


@query(
    "metric_latency_p95",
    """WITH h AS (SELECT time_bucket(INTERVAL '15' SECOND, ts) + k * INTERVAL '15' SECOND AS window_end, duration_s AS v FROM {request_log} CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k)),
       c AS (SELECT window_end, pos, bound, count(*) FILTER (v <= bound) AS cumulative FROM h CROSS JOIN (SELECT unnest(range(0, 16)) AS pos, unnest([__BOUNDS__, 1e300]) AS bound) GROUP BY 1, 2, 3),
       d AS (SELECT *, lag(cumulative, 1, 0) OVER w AS below, lag(bound, 1, 0.0e0) OVER w AS low, max(cumulative) OVER (PARTITION BY window_end) AS total FROM c WINDOW w AS (PARTITION BY window_end ORDER BY pos))
       SELECT window_end, arg_min(CASE WHEN pos = 15 THEN 60.0e0 ELSE low + (bound - low) * ((total * 0.95e0 - below) / (cumulative - below)) END, pos) * 1000 AS latency_ms FROM d WHERE cumulative >= total * 0.95e0 GROUP BY 1""".replace(
        "__BOUNDS__", ", ".join(f"{b}e0" for b in metrics.DURATION_BOUNDS)
    ),
)
def _(spark, sf):
    return metrics.latency_quantile(frame(spark, sf, "request_log"))


# Ordered replay -----------------------------------------------------------------------------------

from concord.operators.replay import replay  # noqa: E402
from concord.plans import serial_sql as Q  # noqa: E402

VIEWS["serial_events"] = Q.EVENTS
VIEWS["serial_run"] = Q.steps_sql()


def _replayed(spark, sf, **kw):
    return replay(X.change_events(spark, sf), X.empty(spark, S.CANONICAL), frame(spark, sf, "policies"), connections=frame(spark, sf, "connections"), **kw)


def _flat_records(c: DataFrame) -> DataFrame:
    sv, ids, prov = (F.col(n) for n in ("source_versions", "provider_ids", "field_provenance"))
    return c.select(
        "tenant_id", "entity_id", "fields.*", "version", "tombstone",
        F.try_element_at(sv, F.lit("salesforce")).alias("version_salesforce"), F.try_element_at(sv, F.lit("hubspot")).alias("version_hubspot"),
        F.try_element_at(ids, F.lit("salesforce")).alias("salesforce_id"), F.try_element_at(ids, F.lit("hubspot")).alias("hubspot_id"),
        prov["company"]["source"].alias("company_source"), prov["company"]["version"].alias("company_version"), prov["company"]["occurred_at"].alias("company_at"),
        prov["phone"]["source"].alias("phone_source"), prov["phone"]["priority"].alias("phone_priority"),
    )


@query("replay_canonical", Q.RECORDS, recursive=True)
def _(spark, sf):
    return _flat_records(_replayed(spark, sf).canonical)


@query("replay_outcomes", Q.OUTCOMES, recursive=True)
def _(spark, sf):
    return _replayed(spark, sf).outcomes.select(*S.EK, *S.ORDER, "entity_id", "outcome")


@query("replay_changes", Q.CHANGES, recursive=True)
def _(spark, sf):
    r = _replayed(spark, sf)
    ops = r.operations.select("tenant_id", "source", "event_id", F.col("target_source").alias("target"), "fingerprint")
    return r.changes.join(ops, ["tenant_id", "source", "event_id", "target"]).select("tenant_id", "event_id", "entity_id", "target", "op", "provider_id", "fingerprint")


@query("replay_outbound", Q.OUTBOUND, recursive=True)
def _(spark, sf):
    return _replayed(spark, sf).outbound.select("tenant_id", "entity_id", "target_source", "fingerprint", "applied_version")


@query("replay_conflicts", Q.CONFLICTS, recursive=True)
def _(spark, sf):
    return _replayed(spark, sf).conflicts.select("tenant_id", "entity_id", "source_a", "source_b", "version_a", "version_b", "status", "resolution_strategy")


@query("replay_chunked", Q.RECORDS, recursive=True)
def _(spark, sf):
    """The same result when every cluster above 20 events is cut into chunks and iterated."""
    return _flat_records(_replayed(spark, sf, chunk_rows=20).canonical)


@query("metric_replay_counters", Q.COUNTERS, recursive=True)
def _(spark, sf):
    return metrics.outcome_counters(_replayed(spark, sf).observations, 3600)


VIEWS["parked"], VIEWS["serial_records"] = Q.PARKED, Q.RECORDS


def _decided(spark, sf):
    """Replay, then operator decisions on everything that was parked, then their replay."""
    first = _replayed(spark, sf)
    none = F.lit(None).cast("string")
    conflicts = first.conflicts.withColumns({"resolved_by": none, "resolved_at": none.cast("timestamp_ntz")})
    pending = conflicts.where("status = 'CONFLICT_PENDING'")
    decisions = pending.select(
        "conflict_id", F.when(F.col("version_b") % 5 == 0, "dismiss").otherwise("resolve").alias("action"),
        F.when(F.col("version_b") % 2 == 1, "b").otherwise("a").alias("side"), F.lit("ops").alias("actor"),
    )
    decided = resolution.decide(conflicts, decisions)
    second = replay(resolution.resolution_events(decided, X.now()), first.canonical, frame(spark, sf, "policies"), outbound=first.outbound, processed=first.claims)
    return conflicts, decided, second


@query("operator_resolution", Q.RESOLVED, recursive=True)
def _(spark, sf):
    _, _, second = _decided(spark, sf)
    return second.canonical.select("tenant_id", "entity_id", "version", "tombstone", F.col("fields.company").alias("company"), F.col("field_provenance")["company"]["source"].alias("company_source"))


@query("operator_decisions", Q.DECIDED, recursive=True)
def _(spark, sf):
    conflicts, decided, second = _decided(spark, sf)
    moves = resolution.resolved(decided, second.outcomes).unionByName(resolution.dismissals(decided))
    out = resolution.set_status(conflicts, moves, X.now())
    return out.where("resolved_by is not null").select("tenant_id", "entity_id", "source_a", "source_b", "version_a", "version_b", "status", "resolved_by")


# Streams ------------------------------------------------------------------------------------------

from concord.sources.events import read_events, stream_files  # noqa: E402
from concord.sources.tables import TableStore, load_dimension  # noqa: E402
from concord.streaming import alerts as live, apply as streaming, redelivery  # noqa: E402


FILES_PER_SLICE = 4


def _fresh_dir(spark, label: str) -> str:
    import uuid

    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def _event_files(spark, sf, batches: int = 2) -> str:
    """The change feed as event files, written in arrival order as a sequence of time slices of FILES_PER_SLICE files each."""
    path = _fresh_dir(spark, "event-files")
    events = cut_lineage(X.change_events(spark, sf), "change-feed")
    span = events.agg(F.min("arrival_seq").alias("lo"), F.max("arrival_seq").alias("hi")).first()
    width = (span.hi - span.lo) // batches + 1
    for i in range(batches):
        low = span.lo + i * width
        # dealt by row, so that each slice has its files whatever its keys
        rows = events.where(F.col("arrival_seq").between(low, low + width - 1)).repartition(FILES_PER_SLICE)
        rows.write.mode("append").parquet(path)
    return path


@query("event_scan", "SELECT tenant_id, source, event_id, delivery, event_type, source_version, occurred_at, email FROM {change_feed}")
def _(spark, sf):
    e = read_events(spark, _event_files(spark, sf))
    f = providers.normalize(F.col("source"), F.col("payload.fields"))
    return e.select(*S.EK, "delivery", "event_type", "source_version", "occurred_at", f["email"].alias("email"))


@query("stream_apply", Q.RECORDS, recursive=True)
def _(spark, sf):
    store = TableStore(spark, _fresh_dir(spark, "state"), buckets=8)
    load_dimension(store, "policies", frame(spark, sf, "policies"))
    store.commit()
    events = stream_files(spark, _event_files(spark, sf), files_per_trigger=FILES_PER_SLICE)
    streaming.apply_stream(events, store, _fresh_dir(spark, "offsets"), name="apply").awaitTermination()
    return _flat_records(store.read("canonical_records"))


@query("stream_deduplicate", "SELECT DISTINCT tenant_id, source, event_id FROM {change_feed}")
def _(spark, sf):
    out = _fresh_dir(spark, "unique")
    events = streaming.deduplicate(stream_files(spark, _event_files(spark, sf), files_per_trigger=FILES_PER_SLICE)).select(*S.EK)
    writer = events.writeStream.format("parquet").option("path", out).option("checkpointLocation", _fresh_dir(spark, "offsets"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("tenant_id string, source string, event_id string").parquet(out)


@query("stream_rates", "SELECT source, window_end, count(*) AS n, count(*) / 60.0e0 AS per_second FROM (SELECT source, date_trunc('minute', received_at) + INTERVAL '1' MINUTE AS window_end FROM {change_feed}) GROUP BY 1, 2")
def _(spark, sf):
    out = _fresh_dir(spark, "rates")
    events = stream_files(spark, _event_files(spark, sf), files_per_trigger=FILES_PER_SLICE)
    live = streaming.live_counts(events, "received_at", slide="1 minute", by=["source"])

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    writer = live.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", _fresh_dir(spark, "offsets"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("window_end timestamp_ntz, source string, n bigint, per_second double").parquet(out).select("source", "window_end", "n", "per_second")


def _observation_stream(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Observations as a stream of time slices with a tick in each step and two at the end, when all windows have closed; and the last step."""
    path = _fresh_dir(spark, "observation-files")
    rows = cut_lineage(_observations(spark, sf), "observations")
    span = rows.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    beats = live.ticks(metrics.grid(rows.select(metrics.floor_to(F.col("at"), ALERT_STEP).alias("step")), ALERT_STEP), "step")
    both = rows.unionByName(beats).crossJoin(F.broadcast(span))  # one row
    cut = F.expr("lo + (hi - lo) / 2")
    for part in (F.col("at") < cut, F.col("at") >= cut):
        both.where(part).select("at", "metric", "n").repartition(FILES_PER_SLICE).write.mode("append").parquet(path)
    for wait in ("2 minutes", "6 hours"):
        live.ticks(span.select((F.col("hi") + F.expr(f"interval {wait}")).alias("end")), "end").repartition(FILES_PER_SLICE, "n").write.mode("append").parquet(path)
    stream = stream_files(spark, path, schema="at timestamp_ntz, metric string, n bigint", files_per_trigger=FILES_PER_SLICE)
    return stream, span.select(metrics.floor_to(F.col("hi"), ALERT_STEP).cast("timestamp_ntz").alias("end"))


def _appended(spark, stream: DataFrame, label: str) -> DataFrame:
    """What a stream appends until it has seen all its files."""
    out = _fresh_dir(spark, label)
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", _fresh_dir(spark, "offsets"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


LIVE_ALERTS = ("event_failure_rate_high", "conflict_spike", "no_events_processed")


@query("stream_alerts", " UNION ALL ".join(f"SELECT alert, step, value FROM ({ALERT_SQL[n]})" for n in LIVE_ALERTS))
def _(spark, sf):
    stream, last = _observation_stream(spark, sf)
    out = None
    for name in LIVE_ALERTS:
        rows = _appended(spark, live.live_alerts(stream, name, ALERT_STEP), "live-alerts")
        out = rows if out is None else out.unionByName(rows)
    return out.join(F.broadcast(last), F.col("step") <= F.col("end")).select("alert", "step", "value")


@query("stream_incidents", f"""SELECT alert, since, min(step) AS first, count(*) AS fired FROM ({ALERT_SQL['api_error_rate_high']})
       WHERE since < (SELECT max(since) FROM ({ALERT_SQL['api_error_rate_high']})) GROUP BY alert, since""")
def _(spark, sf):
    """All incidents but the last, which the end of the data cuts short."""
    stream, _ = _observation_stream(spark, sf)
    found = _appended(spark, live.incidents(stream, "api_error_rate_high", ALERT_STEP), "incidents")
    return found.join(F.broadcast(found.agg(F.max("since").alias("end"))), F.col("since") < F.col("end")).select("alert", "since", "first", "fired")


@query("stream_retry_timers", "SELECT tenant_id, source, event_id, attempt, received_at AS next_attempt_at, arrival_seq FROM {classified} WHERE kind IS NOT NULL")
def _(spark, sf):
    """Every result waits for a retry; those that succeeded are taken out again in the same batch. The rest has long been due."""
    path = _fresh_dir(spark, "moves")
    rows = frame(spark, sf, "write_results").select(*S.EK, "arrival_seq")
    waiting = cut_lineage(_queue_rows(spark, sf).join(rows, S.EK), "waiting")
    moves = redelivery.schedule(waiting).unionByName(redelivery.cancel(waiting.where("kind is null")))
    moves.repartition(FILES_PER_SLICE, *S.EK).write.parquet(path)
    stream = stream_files(spark, path, schema=moves.schema, files_per_trigger=1)
    due, out = redelivery.redeliver(stream), _fresh_dir(spark, "redelivered")
    writer = due.writeStream.format("parquet").option("path", out).option("checkpointLocation", _fresh_dir(spark, "offsets"))
    redelivery.drain(writer.trigger(processingTime="0 seconds").start())
    return spark.read.schema(due.schema).parquet(out).select(*S.EK, "attempt", "next_attempt_at", "arrival_seq")


@query(
    "table_upsert",
    """SELECT c.entity_id, coalesce(e.company, c.company) AS company, CASE WHEN e.company IS NULL THEN c.version ELSE c.version + 1 END AS version FROM {canonical_seed} c
       LEFT JOIN (SELECT tenant_id, email, arg_max(company, arrival_seq) AS company FROM {edits} GROUP BY 1, 2) e ON e.tenant_id = c.tenant_id AND e.email = c.email""",
)
def _(spark, sf):
    store = TableStore(spark, _fresh_dir(spark, "state"), buckets=8)
    seed = X.canonical_seed(spark, sf)
    store.upsert("canonical_records", seed)
    store.commit()
    last = frame(spark, sf, "edits").groupBy("tenant_id", "email").agg(F.max_by("company", "arrival_seq").alias("latest"))
    edited = seed.withColumn("email", F.col("fields.email")).join(last, ["tenant_id", "email"])
    edited = edited.withColumn("fields", F.col("fields").withField("company", F.col("latest"))).withColumn("version", F.col("version") + 1)
    store.upsert("canonical_records", edited)
    store.commit()
    return store.read("canonical_records").select("entity_id", F.col("fields.company").alias("company"), "version")


@query("table_insert_absent", "SELECT tenant_id, source, event_id, min(arrival_seq) AS entity_id FROM {change_feed} GROUP BY 1, 2, 3")
def _(spark, sf):
    store = TableStore(spark, _fresh_dir(spark, "state"), buckets=8)
    c = routing.first_deliveries(X.change_events(spark, sf)).select(
        *S.EK, F.lit("customer").alias("entity_type"), F.col("arrival_seq").cast("string").alias("entity_id"), F.col("received_at").alias("processed_at")
    )
    store.insert_absent("processed_events", c.where("source = 'hubspot'"))
    store.commit()
    # The stored rows stand: the second insert offers other values for their keys.
    store.insert_absent("processed_events", c.withColumn("entity_id", F.when(F.col("source") == "hubspot", F.lit("-1")).otherwise(F.col("entity_id"))))
    store.commit()
    return store.read("processed_events").select(*S.EK, F.col("entity_id").cast("bigint").alias("entity_id"))


@query("event_sink_changes", "SELECT target, event_id, op, CASE WHEN op = 'delete' THEN NULL WHEN target = 'hubspot' THEN 'firstName' ELSE 'first_name' END AS name_field FROM (SELECT event_id, op, target FROM {serial_run} WHERE op IN ('create', 'update', 'delete'))", recursive=True)
def _(spark, sf):
    from concord.sources.events import write_changes

    out = _fresh_dir(spark, "changes")
    write_changes(_replayed(spark, sf).changes, out)
    back = spark.read.schema("event_id string, op string, payload string, target string").parquet(out)
    keys = F.map_keys(F.from_json("payload", "map<string,string>"))
    name = F.filter(keys, lambda k: k.isin("firstName", "first_name"))
    return back.select("target", "event_id", "op", F.get(name, F.lit(0)).alias("name_field"))


@query("dimension_load", "SELECT tenant_id, source, destination, CASE WHEN tenant_id = 't1' THEN 'exists' ELSE 'created' END AS status FROM {policies}")
def _(spark, sf):
    store = TableStore(spark, _fresh_dir(spark, "state"), buckets=8)
    p = frame(spark, sf, "policies")
    load_dimension(store, "policies", p.where("tenant_id = 't1'"))
    store.commit()
    return load_dimension(store, "policies", p).select("tenant_id", "source", "destination", "status")


@query("delete_policy", "SELECT tenant_id, source, delete_policy FROM {policies} WHERE source = 'salesforce' UNION ALL SELECT tenant_id, destination, delete_policy FROM {policies} WHERE source = 'salesforce'")
def _(spark, sf):
    # Only the salesforce policies: hubspot then falls back to the policy that has it as destination.
    return reconcile.delete_policies(frame(spark, sf, "policies").where("source = 'salesforce'"))


@query(
    "metric_request_rate",
    """SELECT status, window_end, count(*) / 60.0e0 AS per_second FROM
       (SELECT status, time_bucket(INTERVAL '15' SECOND, ts) + k * INTERVAL '15' SECOND AS window_end FROM {request_log} CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k)) GROUP BY 1, 2""",
)
def _(spark, sf):
    return metrics.rate(metrics.per_step(frame(spark, sf, "request_log"), "ts", ["status"]), ["status"])


VIEWS["contested_records"] = f"""
SELECT tenant_id, entity_id, prov_version AS version_a, source_version AS version_b, min(occurred_at) AS detected_at FROM
  (SELECT e.tenant_id, x.* FROM {{contested}} x JOIN {{edits}} e USING (arrival_seq)) WHERE strategy = 'manual' AND {_any_clash}
GROUP BY tenant_id, entity_id, prov_source, source, prov_version, source_version
"""

@query(
    "report_overview",
    """(SELECT 'events' AS panel, event_id AS id FROM {change_feed} WHERE delivery = 1 AND tenant_id = 't1' ORDER BY received_at DESC LIMIT 10)
       UNION ALL (SELECT 'dead_letters', event_id FROM {write_results} WHERE tenant_id = 't1' ORDER BY received_at DESC, event_id LIMIT 20)
       UNION ALL (SELECT 'runs', concat('run-', tenant_id) FROM {tenants} WHERE tenant_id = 't1')
       UNION ALL (SELECT 'audit', event_id FROM {write_results} WHERE tenant_id = 't1' AND status_code = 401 ORDER BY event_id LIMIT 15)
       UNION ALL (SELECT 'conflicts', concat(entity_id, ':', version_a, ':', version_b) FROM {contested_records} WHERE tenant_id = 't1' ORDER BY detected_at DESC, concat(entity_id, ':', version_a, ':', version_b) LIMIT 20)""",
)
def _(spark, sf):
    c = _contested(spark, sf).where("strategy = 'manual' and size(conflicts) > 0")
    first = F.get("conflicts", F.lit(0))
    key = ["tenant_id", "entity_id", first["source_a"], first["source_b"], first["version_a"].alias("version_a"), first["version_b"].alias("version_b")]
    pending = c.groupBy(*key).agg(F.min("occurred_at").alias("detected_at")).select(
        "tenant_id", F.concat_ws(":", "entity_id", "version_a", "version_b").alias("conflict_id"), F.lit("CONFLICT_PENDING").alias("status"), "detected_at", "entity_id", "version_a", "version_b"
    )
    _, _, audit = failures.decide_letters(_letters(spark, sf), _letter_decisions(spark, sf).where("action = 'discard'"), X.now())
    none = X.change_events(spark, sf).where("false")
    tables = {
        "conflicts": pending, "runs": _runs(spark, sf), "dead_letter": _letters(spark, sf), "source_events": X.change_events(spark, sf).where("delivery = 1"), "audit_log": audit,
        "operations": none.withColumns({"created_at": F.col("received_at"), "target_source": F.col("source")}), "sync_jobs": none.withColumns({"created_at": F.col("received_at"), "job_id": F.col("event_id")}),
    }
    got = reports.overview(tables, "t1")
    ids = {"events": "event_id", "dead_letters": "event_id", "runs": "run_id", "audit": "resource_id", "conflicts": "conflict_id"}
    out = None
    for panel, column in ids.items():
        rows = got[panel].select(F.lit(panel).alias("panel"), F.col(column).alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out
