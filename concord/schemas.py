"""Explicit schemas of the data model. All times are UTC wall clock (`TIMESTAMP_NTZ`)."""

from __future__ import annotations

# The canonical customer has exactly these string fields.
FIELDS = ("first_name", "last_name", "email", "phone", "company")
ENTITY_TYPE = "customer"

# Allowed domains of the enumerated columns.
EVENT_TYPES = ("created", "updated", "deleted")
EVENT_STATUSES = ("received", "validated", "processed", "failed", "dlq", "stale", "duplicate")
CONFLICT_STATUSES = ("CONFLICT_PENDING", "AUTO_RESOLVED", "RESOLVED", "DISMISSED")
STRATEGIES = ("last_write_wins", "source_priority", "manual", "field_merge")
DELETE_POLICIES = ("propagate", "tombstone_only", "ignore")
DLQ_STATUSES = ("open", "retrying", "resolved", "discarded")
FINDING_KINDS = ("drift", "missed", "deleted", "missing")
FINDING_STATUSES = ("pending", "applied", "dismissed", "failed", "skipped")
DIRECTIONS = ("push_canonical", "adopt_provider", "delete")

EK = ["tenant_id", "source", "event_id"]
CK = ["tenant_id", "entity_type", "entity_id"]
ORDER = ["arrival_seq", "delivery"]

NTZ = "timestamp_ntz"
CUSTOMER_DDL = "struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">"
WRITER_DDL = "struct<source:string,version:bigint,occurred_at:timestamp_ntz,priority:int>"
PROVENANCE_DDL = "struct<" + ",".join(f"{f}:{WRITER_DDL}" for f in FIELDS) + ">"
CONFLICT_DDL = (
    "struct<field:string,source_a:string,version_a:bigint,occurred_at_a:timestamp_ntz,priority_a:int,"
    "value_a:string,source_b:string,version_b:bigint,occurred_at_b:timestamp_ntz,priority_b:int,value_b:string>"
)
WRITE_DDL = "struct<target:string,op:string,provider_id:string>"


EVENT_PROVENANCE_DDL = (
    "struct<origin_source:string,origin_event_id:string,sync_operation_id:string,"
    "resolved_conflict_id:string,reconcile_finding_id:string>"
)
EVENT = (
    "event_id string, tenant_id string, source string, entity_type string, entity_id string, "
    "event_type string, source_version bigint, occurred_at timestamp_ntz, received_at timestamp_ntz, "
    f"correlation_id string, provenance {EVENT_PROVENANCE_DDL}, payload struct<fields:map<string,string>>, "
    "arrival_seq bigint, delivery int"
)
DELIVERY = (
    "delivery_id string, tenant_slug string, provider string, signature string, body string, "
    "received_at timestamp_ntz, arrival_seq bigint, delivery int"
)
SOURCE_EVENT = (
    "tenant_id string, source string, event_id string, entity_type string, entity_id string, event_type string, "
    "source_version bigint, occurred_at timestamp_ntz, received_at timestamp_ntz, correlation_id string, "
    "provenance map<string,string>, raw string, status string, arrival_seq bigint, delivery int"
)
SNAPSHOT = ("id string, source_version bigint, deleted boolean, data map<string,string>, updated_at timestamp_ntz")
POLICY = (
    "tenant_id string, entity string, source string, destination string, mode string, conflict_strategy string, "
    "delete_policy string, retry_policy string, source_priority int, enabled boolean, created_at timestamp_ntz"
)
CONNECTION = (
    "tenant_id string, provider string, base_url string, webhook_secret string, created_at timestamp_ntz"
)
TENANT = ("tenant_id string, slug string, name string, created_at timestamp_ntz")
CANONICAL = (
    f"tenant_id string, entity_type string, entity_id string, fields {CUSTOMER_DDL}, version bigint, "
    f"source_versions map<string,bigint>, provider_ids map<string,string>, "
    f"field_provenance map<string,{WRITER_DDL}>, tombstone boolean, origin_source string, "
    "origin_event_id string, created_at timestamp_ntz"
)
OUTBOUND = (
    "tenant_id string, entity_type string, entity_id string, target_source string, fingerprint string, "
    "applied_version bigint"
)
PROCESSED = (
    "tenant_id string, source string, event_id string, entity_type string, entity_id string, processed_at timestamp_ntz"
)
OPERATION = (
    "tenant_id string, entity_type string, entity_id string, source string, target_source string, event_id string, "
    "applied_version bigint, fingerprint string, created_at timestamp_ntz"
)
CONFLICT = (
    "conflict_id string, tenant_id string, entity_type string, entity_id string, source_a string, version_a bigint, "
    "payload_a string, source_b string, version_b bigint, payload_b string, detected_at timestamp_ntz, status string, "
    "resolution_strategy string, resolved_by string, resolved_at timestamp_ntz"
)
CONFLICT_KEY = ["tenant_id", "entity_type", "entity_id", "source_a", "source_b", "version_a", "version_b"]
RETRY = (
    "tenant_id string, source string, event_id string, attempt int, max_attempts int, next_attempt_at timestamp_ntz, "
    "last_error string, error_class string, state string, updated_at timestamp_ntz"
)
DEAD_LETTER = (
    "tenant_id string, source string, event_id string, reason string, error_class string, payload string, status string, "
    "created_at timestamp_ntz, resolved_at timestamp_ntz"
)
WRITE_RESULT = (
    "tenant_id string, event_id string, target string, status_code int, retry_after_s int, message string"
)
RUN = (
    "run_id string, tenant_id string, entity string, source string, mode string, status string, job_id string, "
    "total bigint, drift bigint, missed bigint, deleted bigint, started_at timestamp_ntz, finished_at timestamp_ntz, "
    "error string"
)
FINDING = (
    "finding_id string, run_id string, tenant_id string, kind string, provider_id string, canonical_id string, "
    f"canonical_fields {CUSTOMER_DDL}, provider_fields {CUSTOMER_DDL}, provider_version bigint, direction string, "
    "status string, error string, created_at timestamp_ntz, applied_at timestamp_ntz"
)
SYNC_JOB = (
    "job_id string, tenant_id string, job_type string, source string, destination string, status string, "
    "cursor string, processed bigint, failed bigint, total bigint, error string, created_at timestamp_ntz"
)
AUDIT = (
    "tenant_id string, actor string, action string, resource_type string, resource_id string, detail string, "
    "created_at timestamp_ntz"
)
