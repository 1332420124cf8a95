"""Policy routing, validation and idempotency claims: which events reach the replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import fingerprint
from concord.functions.conflict import effective_strategy
from concord.functions.providers import canonical_type, missing_field, normalize
from concord.schemas import EK, ORDER
from concord.session import small


def routes(policies: DataFrame) -> DataFrame:
    """One row per (tenant, source, entity): destinations in creation order, plus the strategy and
    priority of the first policy (defaults last_write_wins and 100)."""
    item = F.struct("created_at", "destination", "delete_policy", "conflict_strategy", "source_priority")
    return (
        policies.where("enabled")
        .groupBy("tenant_id", "source", F.col("entity").alias("entity_type"))
        .agg(F.sort_array(F.collect_list(item)).alias("p"))  # one entry per destination
        .select(
            "tenant_id",
            "source",
            "entity_type",
            F.transform("p", lambda x: F.struct(x["destination"].alias("target"), x["delete_policy"].alias("delete_policy"))).alias("dests"),
            F.coalesce(F.nullif(F.get("p", F.lit(0))["conflict_strategy"], F.lit("")), F.lit("last_write_wins")).alias("strategy"),
            F.coalesce(F.get("p", F.lit(0))["source_priority"], F.lit(100)).alias("priority"),
        )
    )


def _error(kind: str, message: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), message.alias("message"))


def route(events: DataFrame, policies: DataFrame, connections: DataFrame | None = None) -> DataFrame:
    """Attach route, normalized fields and, where the event cannot be applied, a static outcome.

    Static outcomes depend on the event alone: `failed` (no connection or adapter, missing fields,
    failed validation) or `no_policy`. They take no claim, so every delivery gets the same answer.
    Events that adopt a reconcile finding need no policy: without one they change the record and go nowhere.
    """
    fields = F.col("payload.fields")
    out = events.withColumn("provider_entity_type", F.col("entity_type")).withColumn("entity_type", canonical_type(F.col("source")))
    out = out.join(small(routes(policies)), ["tenant_id", "source", "entity_type"], "left")
    no_connection = F.col("entity_type").isNull()
    if connections is not None:
        known = connections.select("tenant_id", F.col("provider").alias("source"), F.lit(True).alias("connected")).distinct()
        out = out.join(small(known), ["tenant_id", "source"], "left")
        no_connection = no_connection | F.col("connected").isNull()
    upsert = F.col("event_type") != "deleted"
    empty = F.coalesce(F.size(fields) <= 0, F.lit(True))
    forced = F.coalesce(F.col("provenance.resolved_conflict_id"), F.lit("")) != ""
    adopts = F.coalesce(F.col("provenance.reconcile_finding_id"), F.lit("")) != ""
    invalid = missing_field(F.col("source"), fields)
    error = (
        F.when(no_connection, _error("UNKNOWN", F.lit("not found")))
        .when(F.col("dests").isNull() & ~adopts, F.lit(None))
        .when(upsert & empty, _error("SCHEMA_ERROR", F.lit("the payload has no fields")))
        .when(upsert & ~forced & invalid.isNotNull(), _error("SCHEMA_ERROR", invalid))
    )
    nowhere = F.col("dests").isNull()
    out = out.withColumn("error", error).withColumn(
        "static_outcome", F.when(F.col("error").isNotNull(), "failed").when(nowhere & ~adopts, "no_policy")
    )
    none = F.expr("cast(array() as array<struct<target:string,delete_policy:string>>)")
    return out.withColumns(
        {
            "dests": F.when(nowhere & adopts, none).otherwise(F.col("dests")),
            "strategy": F.when(nowhere & adopts, "last_write_wins").otherwise(F.col("strategy")),
            "priority": F.when(nowhere & adopts, F.lit(100)).otherwise(F.col("priority")),
        }
    )


def first_deliveries(events: DataFrame) -> DataFrame:
    """One row per event key: the earliest delivery, with the number of deliveries.

    `min_by` combines map-side, so a key copied a billion times shuffles one row per task.
    """
    cols = [c for c in events.columns if c not in EK]
    return (
        events.groupBy(*EK)
        .agg(F.min_by(F.struct(*cols), F.struct(*ORDER)).alias("first"), F.count(F.lit(1)).alias("deliveries"))
        .select(*EK, "first.*", "deliveries")
    )


def mark_duplicates(deliveries: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Per delivery: is it the first of its event key, in this batch and against `seen`?

    The winning position per key is a combinable `min`; joining it back leaves a hot key's rows to
    be split by the skew-join handling instead of sorting them in one window partition.
    """
    winner = deliveries.groupBy(*EK).agg(F.min(F.struct(*ORDER)).alias("first_order"))
    if seen is not None:
        known = seen.select(*EK).distinct().withColumn("seen", F.lit(True))
        winner = winner.join(known, EK, "left")
    else:
        winner = winner.withColumn("seen", F.lit(None).cast("boolean"))
    same = F.struct(*ORDER) == F.col("first_order")
    return (
        deliveries.join(winner, EK)
        .withColumn("duplicate", F.coalesce("seen", F.lit(False)) | ~same)
        .drop("first_order", "seen")
    )


def to_steps(routed: DataFrame) -> DataFrame:
    """Routed, applicable events in the compact shape the replay folds over."""
    f = normalize(F.col("source"), F.col("payload.fields"))
    kind = (
        F.when(F.coalesce(F.col("provenance.resolved_conflict_id"), F.lit("")) != "", "resolve")
        .when(F.coalesce(F.col("provenance.reconcile_finding_id"), F.lit("")) != "", "adopt")
        .when(F.col("event_type") == "deleted", "delete")
        .otherwise("upsert")
    )
    return routed.select(
        "tenant_id",
        "entity_type",
        "arrival_seq",
        "delivery",
        "event_id",
        "source",
        F.col("entity_id").alias("pid"),
        kind.alias("kind"),
        F.coalesce("source_version", F.lit(0)).cast("bigint").alias("version"),
        "occurred_at",
        "received_at",
        f.alias("f"),
        fingerprint(f).alias("fp"),
        "strategy",
        effective_strategy(F.col("strategy")).alias("mode"),
        F.col("priority").cast("int").alias("priority"),
        "dests",
    )
