"""Full synchronisation: a provider snapshot as change events, with dead letters and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.columns import compose_id
from concord.functions.providers import canonical_type, missing_field
from concord.schemas import EVENT_PROVENANCE_DDL
from concord.session import numbered


def examine(snapshot: DataFrame, tenant: Column, source: str) -> DataFrame:
    """Live records of a snapshot with their validation `error`; deletions are not backfilled."""
    return (
        snapshot.where(~F.col("deleted"))
        .withColumn("tenant_id", tenant)
        .withColumn("source", F.lit(source))
        .withColumn("error", missing_field(F.lit(source), F.col("data")))
    )


def to_events(examined: DataFrame, job: Column, now: Column) -> DataFrame:
    """Valid records as `created` events with ids that are stable across resumed runs."""
    prov = F.struct(
        F.col("source"), F.lit(None).cast("string"), job, F.lit(None).cast("string"), F.lit(None).cast("string")
    ).cast(EVENT_PROVENANCE_DDL)
    # A snapshot has no arrival order of its own: its records apply by id.
    valid = numbered(examined.where(F.col("error").isNull()).drop("arrival_seq"), "tenant_id", "id")
    return valid.select(
        compose_id("jobsync", job, F.col("id")).alias("event_id"),
        "tenant_id",
        "source",
        canonical_type(F.col("source")).alias("entity_type"),
        F.col("id").alias("entity_id"),
        F.lit("created").alias("event_type"),
        "source_version",
        now.alias("occurred_at"),
        now.alias("received_at"),
        F.lit(None).cast("string").alias("correlation_id"),
        prov.alias("provenance"),
        F.struct(F.col("data").alias("fields")).alias("payload"),
        "arrival_seq",
        F.lit(1).alias("delivery"),
    )


def dead_letters(examined: DataFrame, job: Column) -> DataFrame:
    """Invalid records, to be buried with a replayable event as payload."""
    event_id = compose_id("jobsync", job, F.col("id"))
    state = F.to_json(
        F.struct(
            event_id.alias("event_id"), "tenant_id", "source", canonical_type(F.col("source")).alias("entity_type"),
            F.col("id").alias("entity_id"), F.lit("created").alias("event_type"), "source_version",
            F.struct(F.col("data").alias("fields")).alias("payload"),
        )
    )
    return examined.where(F.col("error").isNotNull()).select(
        "tenant_id", "source", event_id.alias("event_id"), F.col("error").alias("reason"), F.lit("SCHEMA_ERROR").alias("error_class"), state.alias("payload")
    )


def counters(examined: DataFrame, reported: Column | None = None, job: Column | None = None, failures: DataFrame | None = None) -> DataFrame:
    """Progress row per tenant: processed, failed, total (the provider's own count when positive)
    and the cursor, which is the last id covered. With the `failures` of applying the job's events ({tenant_id, source,
    event_id}), records that passed the check and could not be applied count as failed."""
    n = F.count(F.lit(1))
    total = n if reported is None else F.when(reported > 0, reported).otherwise(n)
    bad = F.col("error").isNotNull()
    if failures is not None:
        known = failures.select("tenant_id", "source", "event_id").distinct().withColumn("unapplied", F.lit(True))
        examined = examined.withColumn("event_id", compose_id("jobsync", job, F.col("id"))).join(known, ["tenant_id", "source", "event_id"], "left")
        bad = bad | F.col("unapplied").isNotNull()
    return examined.groupBy("tenant_id", "source").agg(
        F.count_if(~bad).alias("processed"),
        F.count_if(bad).alias("failed"),
        total.alias("total"),
        F.max("id").alias("cursor"),
    )
