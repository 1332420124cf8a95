"""Delivery intake: parse, authenticate, resolve tenant, deduplicate, acknowledge, publish."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.columns import clamp_limit, event_key, parse_rfc3339
from concord.functions.signature import key_pads, signature_ok
from concord.operators.routing import mark_duplicates
from concord.schemas import EK, EVENT_PROVENANCE_DDL
from concord.session import cut_lineage, small

BODY_DDL = (
    "event_id string, source string, entity_type string, entity_id string, event_type string, source_version bigint, "
    "occurred_at string, correlation_id string, provenance map<string,string>, payload struct<fields:map<string,string>>, "
    "_corrupt string"
)


def parse(deliveries: DataFrame) -> DataFrame:
    """Body text to a `hook` struct; `malformed` marks bodies that are not a JSON object."""
    hook = F.from_json("body", BODY_DDL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return deliveries.withColumn("hook", hook).withColumn(
        "malformed", F.col("hook").isNull() | F.col("hook._corrupt").isNotNull() | F.col("body").isNull()
    )


def with_defaults(parsed: DataFrame) -> DataFrame:
    """Missing source is the route's provider, a missing event id is derived from the body (so that
    a repeated delivery is a duplicate), missing provenance is an empty map."""
    h = F.col("hook")

    def given(name: str, fallback: Column) -> Column:
        return F.coalesce(F.nullif(h[name], F.lit("")), fallback)

    return parsed.select(
        "*",
        given("event_id", F.sha2("body", 256)).alias("event_id"),
        given("source", F.col("provider")).alias("source"),
        F.coalesce(h["entity_type"], F.lit("")).alias("entity_type"),
        F.coalesce(h["entity_id"], F.lit("")).alias("entity_id"),
        F.coalesce(h["event_type"], F.lit("")).alias("event_type"),
        F.coalesce(h["source_version"], F.lit(0)).alias("source_version"),
        parse_rfc3339(h["occurred_at"]).alias("occurred_at"),
        h["correlation_id"].alias("correlation_id"),
        F.coalesce(h["provenance"], F.expr("cast(map() as map<string,string>)")).alias("provenance"),
    )


def resolve_tenant(deliveries: DataFrame, tenants: DataFrame, connections: DataFrame) -> DataFrame:
    """Tenant by slug and connection by provider; the signing pads are computed per connection."""
    conn = connections.select(
        "tenant_id", "provider", F.col("webhook_secret").alias("secret"), key_pads(F.col("webhook_secret")).alias("pads"), F.lit(True).alias("connected")
    )
    return deliveries.join(
        small(tenants.select("tenant_id", F.col("slug").alias("tenant_slug"))), "tenant_slug", "left"
    ).join(small(conn, store=False), ["tenant_id", "provider"], "left")


def bad_time() -> Column:
    """A time was given but is none."""
    return F.col("hook.occurred_at").isNotNull() & F.col("occurred_at").isNull()


def reject_reason() -> Column:
    """First failed check, in the order a delivery is examined; null when it is acceptable."""
    return (
        F.when(F.col("tenant_id").isNull(), F.lit("unknown tenant"))
        .when(F.col("connected").isNull(), F.lit("no connection for provider"))
        .when(~signature_ok(F.col("secret"), F.col("pads"), F.col("body"), F.col("signature")), F.lit("invalid signature"))
        .when(F.col("malformed") | bad_time(), F.lit("malformed webhook payload"))
        .when((F.col("entity_type") == "") | (F.col("entity_id") == ""), F.lit("missing entity_type/entity_id"))
    )


def accept(deliveries: DataFrame, tenants: DataFrame, connections: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Every delivery with its acknowledgement: `received`, `duplicate` or `rejected` + reason."""
    checked = with_defaults(parse(resolve_tenant(deliveries, tenants, connections))).withColumn("reason", reject_reason())
    # Stored once: the steps below read it several times, and parsing and signing are the costly part.
    checked = cut_lineage(checked.drop("hook", "pads", "secret"), "checked")
    good = mark_duplicates(checked.where(F.col("reason").isNull()), stored)
    bad = checked.where(F.col("reason").isNotNull()).withColumn("duplicate", F.lit(False))
    status = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("duplicate"), "duplicate").otherwise("received")
    return good.unionByName(bad).withColumn("status", status)


def acknowledgements(accepted: DataFrame) -> DataFrame:
    return accepted.select("delivery_id", F.when(F.col("status") != "rejected", F.col("event_id")).alias("event_id"), "status", "reason")


def source_events(accepted: DataFrame) -> DataFrame:
    """Rows to store: first deliveries, status `received`, with the raw body kept as text."""
    return accepted.where("status = 'received'").select(
        *EK,
        "entity_type",
        "entity_id",
        "event_type",
        "source_version",
        "occurred_at",
        "received_at",
        "correlation_id",
        "provenance",
        F.col("body").alias("raw"),
        F.lit("received").alias("status"),
        "arrival_seq",
        "delivery",
    )


def rebuild(stored: DataFrame) -> DataFrame:
    """Stored rows back to change events; the payload comes from the raw body, and only three
    provenance keys survive."""
    raw = F.from_json("raw", "payload struct<fields:map<string,string>>")
    prov = F.struct(
        *[F.try_element_at("provenance", F.lit(k)).alias(k) for k in ("origin_source", "origin_event_id", "sync_operation_id")],
        F.lit(None).cast("string").alias("resolved_conflict_id"),
        F.lit(None).cast("string").alias("reconcile_finding_id"),
    ).cast(EVENT_PROVENANCE_DDL)
    return stored.select(
        "event_id", "tenant_id", "source", "entity_type", "entity_id", "event_type", "source_version", "occurred_at",
        "received_at", "correlation_id", prov.alias("provenance"), raw["payload"].alias("payload"), "arrival_seq", "delivery",
    )


def pending(stored: DataFrame, limit: int | None = None) -> DataFrame:
    """Oldest received events, up to the clamped limit."""
    n = clamp_limit(limit, 1000)
    return stored.where("status = 'received'").orderBy("received_at", *EK).limit(n)


def keyed(events: DataFrame) -> DataFrame:
    """Message key and JSON value of each event, ready for a Kafka sink."""
    key = event_key(F.col("tenant_id"), F.col("entity_type"), F.col("entity_id"))
    return events.select(key.alias("key"), F.to_json(F.struct(*[c for c in events.columns])).alias("value"))


def advance(stored: DataFrame, keys: DataFrame, to: str, only_from: str | None = None) -> DataFrame:
    """Set the status of the given event keys; with `only_from`, rows in another state stay as they are."""
    hit = keys.select(*EK).distinct().withColumn("hit", F.lit(True))
    guard = F.col("hit").isNotNull()
    if only_from is not None:
        guard = guard & (F.col("status") == only_from)
    return stored.join(hit, EK, "left").withColumn("status", F.when(guard, F.lit(to)).otherwise(F.col("status"))).drop("hit")


def in_domain_split(df: DataFrame, rules: dict[str, tuple[str, ...]]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with the offending column names)."""
    from concord.functions.columns import in_domain

    bad = F.filter(
        F.array(*[F.when(~in_domain(F.col(c), allowed), F.lit(c)) for c, allowed in rules.items()]), lambda x: x.isNotNull()
    )
    marked = df.withColumn("violations", bad)
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)


def since(snapshot: DataFrame, moment: dt.datetime | None) -> DataFrame:
    """Records changed at or after `moment`."""
    if moment is None:
        return snapshot
    # As text, because a datetime literal would be shifted by the session zone.
    return snapshot.where(F.col("updated_at") >= F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz"))


def page(snapshot: DataFrame, cursor: str | None = None, limit: int | None = None) -> DataFrame:
    """One keyset page by id, strictly after the cursor."""
    n = clamp_limit(limit, 1000)
    after = snapshot if not cursor else snapshot.where(F.col("id") > cursor)
    return after.orderBy("id").limit(n)


def next_cursor(page_rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Last id of a full page; null when the page was not full."""
    n = clamp_limit(limit, 1000)
    return page_rows.agg(F.when(F.count(F.lit(1)) >= n, F.max("id")).alias("next_cursor"))
