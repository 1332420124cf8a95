"""Operator decisions on conflicts: pick a side, or dismiss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.columns import compose_id, decode_snapshot, micros
from concord.schemas import EVENT_PROVENANCE_DDL


def decide(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions {conflict_id, action: resolve|dismiss, side, actor} joined to their conflicts.

    `problem` is null for decisions that take effect: only pending conflicts can be decided, and a
    resolution needs side a or b.
    """
    both = decisions.join(conflicts, "conflict_id", "left")
    problem = (
        F.when(F.col("tenant_id").isNull(), "conflict not found")
        .when((F.col("status") != "CONFLICT_PENDING") & (F.col("action") == "resolve"), "conflict is not pending resolution")
        .when(F.col("status") != "CONFLICT_PENDING", "conflict is not pending")
        .when((F.col("action") == "resolve") & ~F.coalesce(F.col("side").isin("a", "b"), F.lit(False)), 'side must be "a" or "b"')
    )
    a = F.col("side") == "a"
    return both.select(
        "*",
        problem.alias("problem"),
        F.when(a, F.col("source_a")).otherwise(F.col("source_b")).alias("winner_source"),
        F.when(a, F.col("version_a")).otherwise(F.col("version_b")).alias("winner_version"),
        F.when(a, F.col("payload_a")).otherwise(F.col("payload_b")).alias("winner_payload"),
    )


def resolution_events(decided: DataFrame, now: Column) -> DataFrame:
    """Events that force the chosen side. They go through the ordinary replay, which applies them
    without ordering, echo or conflict checks. Fields are named as the winning provider names them,
    because a stored snapshot is canonical and replay reads provider names."""
    from concord.functions.providers import per_provider
    from concord.schemas import FIELDS

    chosen = decode_snapshot(F.col("winner_payload"))
    native = per_provider(
        F.col("winner_source"),
        lambda p: F.map_from_entries(
            F.filter(
                F.array(*[F.struct(F.lit(p.names[n]).alias("k"), F.try_element_at(chosen, F.lit(n)).alias("v")) for n in FIELDS]),
                lambda x: x["v"].isNotNull(),
            )
        ),
    )
    ok = decided.where(F.col("problem").isNull() & (F.col("action") == "resolve"))
    prov = F.struct(
        F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("conflict_id"), F.lit(None).cast("string")
    ).cast(EVENT_PROVENANCE_DDL)
    return ok.select(
        compose_id("resolve", F.col("conflict_id")).alias("event_id"),
        "tenant_id",
        F.col("winner_source").alias("source"),
        "entity_type",
        "entity_id",
        F.lit("updated").alias("event_type"),
        F.col("winner_version").alias("source_version"),
        now.alias("occurred_at"),
        now.alias("received_at"),
        F.lit(None).cast("string").alias("correlation_id"),
        prov.alias("provenance"),
        F.struct(native.alias("fields")).alias("payload"),
        # Decisions of one batch on the same record apply in the order the conflicts were detected.
        micros(F.col("detected_at")).alias("arrival_seq"),
        F.lit(1).alias("delivery"),
    )


def set_status(conflicts: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Apply {conflict_id, to, strategy, by}; a dismissed conflict never changes again."""
    new = changes.groupBy("conflict_id").agg(F.max_by(F.struct("to", "strategy", "by"), "to").alias("n"))
    hit = F.col("n").isNotNull() & (F.col("status") != "DISMISSED")
    return conflicts.join(new, "conflict_id", "left").select(
        *[
            {
                "status": F.when(hit, F.col("n.to")).otherwise(F.col("status")),
                "resolution_strategy": F.when(hit, F.col("n.strategy")).otherwise(F.col("resolution_strategy")),
                "resolved_by": F.when(hit, F.col("n.by")).otherwise(F.col("resolved_by")),
                "resolved_at": F.when(hit, now).otherwise(F.col("resolved_at")),
            }
            .get(c, F.col(c))
            .alias(c)
            for c in conflicts.columns
        ]
    )


def dismissals(decided: DataFrame) -> DataFrame:
    return decided.where(F.col("problem").isNull() & (F.col("action") == "dismiss")).select(
        "conflict_id", F.lit("DISMISSED").alias("to"), F.col("resolution_strategy").alias("strategy"), F.lit("operator").alias("by")
    )


def resolved(decided: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Conflicts whose resolution event was applied."""
    done = outcomes.where("outcome = 'resolved'").select("tenant_id", "event_id")
    return (
        decided.withColumn("event_id", compose_id("resolve", F.col("conflict_id")))
        .join(done, ["tenant_id", "event_id"], "left_semi")
        .select("conflict_id", F.lit("RESOLVED").alias("to"), F.lit("manual").alias("strategy"), F.lit("operator").alias("by"))
    )


def audit_rows(decided: DataFrame, now: Column) -> DataFrame:
    ok = decided.where(F.col("problem").isNull())
    detail = F.when(
        F.col("action") == "resolve", F.to_json(F.struct("entity_type", "entity_id", "side", "winner_source", "winner_version"))
    ).otherwise(F.to_json(F.struct("entity_type", "entity_id", F.col("resolution_strategy").alias("strategy"))))
    return ok.select(
        "tenant_id",
        "actor",
        F.concat(F.lit("conflict."), F.col("action")).alias("action"),
        F.lit("conflict").alias("resource_type"),
        F.col("conflict_id").alias("resource_id"),
        detail.alias("detail"),
        now.alias("created_at"),
    )
