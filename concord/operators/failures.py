"""Failed work as data: classification, retry queue, dead letters and their decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.columns import clamp_limit
from concord.functions.resilience import (
    BASE_SECONDS,
    MAX_SECONDS,
    after_seconds,
    backoff_seconds,
    error_kind,
    hash_fraction,
    retry_after,
    retryable,
    shortened,
)

KEY = ["tenant_id", "source", "event_id"]
MAX_ATTEMPTS = 8


def classify(results: DataFrame) -> DataFrame:
    """Write results with `kind` (null on success), `hint` seconds and `retry`."""
    kind = error_kind(F.col("status_code"))
    return results.select(
        "*",
        kind.alias("kind"),
        retry_after(F.col("status_code"), F.col("retry_after_s").cast("string")).alias("hint"),
        (kind.isNotNull() & retryable(kind)).alias("retry"),
    )


def delay(attempt: Column, hint: Column, fraction: Column, base: float = BASE_SECONDS, cap: float = MAX_SECONDS) -> Column:
    return shortened(backoff_seconds(attempt, fraction, base, cap), hint, cap)


def first_failure(failed: DataFrame, now: Column, max_attempts: int = MAX_ATTEMPTS, fraction: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Split first failures into (retry entries, dead letters).

    `failed` has tenant_id, source, event_id, kind, message, state and optionally hint.
    """
    hint = F.col("hint") if "hint" in failed.columns else F.lit(0)
    jitter = fraction if fraction is not None else hash_fraction(F.col("event_id"), F.lit(1))
    wait = delay(F.lit(1), hint, jitter)
    retries = failed.where(retryable(F.col("kind"))).select(
        *KEY,
        F.lit(1).alias("attempt"),
        F.lit(max_attempts).alias("max_attempts"),
        after_seconds(now, wait).alias("next_attempt_at"),
        F.col("message").alias("last_error"),
        F.col("kind").alias("error_class"),
        "state",
        now.alias("updated_at"),
    )
    dead = failed.where(~retryable(F.col("kind"))).select(
        *KEY,
        F.col("message").alias("reason"),
        F.col("kind").alias("error_class"),
        F.col("state").alias("payload"),
        F.lit("open").alias("status"),
        now.alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
    )
    return retries, dead


def enqueue(queue: DataFrame, entries: DataFrame) -> DataFrame:
    """Queue after an enqueue: new keys start at attempt 1, a clash adds an attempt and refreshes the
    entry, while `max_attempts` stays as first given. Several entries of a key count one attempt each."""
    new = entries.groupBy(*KEY).agg(
        F.count(F.lit(1)).cast("int").alias("added"),
        F.min_by("max_attempts", "updated_at").alias("first_max"),
        F.max_by(F.struct("next_attempt_at", "last_error", "error_class", "state", "updated_at"), F.struct("updated_at", "next_attempt_at")).alias("n"),
    )
    old = queue.select(*KEY, *[F.col(c).alias(f"old_{c}") for c in queue.columns if c not in KEY])
    rest = ["next_attempt_at", "last_error", "error_class", "state", "updated_at"]
    return old.join(new, KEY, "full_outer").select(
        *KEY,
        (F.coalesce("old_attempt", F.lit(0)) + F.coalesce("added", F.lit(0))).cast("int").alias("attempt"),
        F.coalesce("old_max_attempts", "first_max").alias("max_attempts"),
        *[F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in rest],
    )


def all_due(queue: DataFrame, now: Column) -> DataFrame:
    """Every entry whose time has come: what a round works on."""
    return queue.where(F.col("next_attempt_at") <= now)


def due(queue: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """A page of due entries, the earliest first: what a listing shows."""
    return queue.where(F.col("next_attempt_at") <= now).orderBy("next_attempt_at", "tenant_id", "event_id", "source").limit(clamp_limit(limit, 1000))


def retry_outcome(attempts: DataFrame, now: Column, fraction: Column | None = None) -> DataFrame:
    """Decide what follows a processed retry entry.

    `attempts` is a queue row plus `kind` (null on success), `message` and `hint`. Adds
    `decision` (succeeded / dead_letter / requeue), the failure count `n`, the class and reason to
    record, and the next attempt time.
    """
    readable = F.from_json("state", "event_id string")["event_id"].isNotNull()
    n = F.col("attempt") + 1
    jitter = fraction if fraction is not None else hash_fraction(F.col("event_id"), n)
    wait = delay(n, F.coalesce("hint", F.lit(0)), jitter)
    decision = (
        F.when(~readable, "dead_letter")
        .when(F.col("kind").isNull(), "succeeded")
        .when(~retryable(F.col("kind")) | (n >= F.col("max_attempts")), "dead_letter")
        .otherwise("requeue")
    )
    out = attempts.withColumn("decision", decision)
    return out.select(
        "*",
        n.alias("n"),
        F.when(~readable, "SCHEMA_ERROR").otherwise(F.col("kind")).alias("final_class"),
        F.when(~readable, "unreadable retry entry").otherwise(F.col("message")).alias("final_reason"),
        F.when(F.col("decision") == "requeue", wait).alias("delay_s"),
        F.when(F.col("decision") == "requeue", after_seconds(now, wait)).alias("due_at"),
    )


def settle(queue: DataFrame, letters: DataFrame, decided: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Queue and dead letters after a round of retry outcomes."""
    gone = decided.where("decision <> 'requeue'").select(*KEY)
    again = decided.where("decision = 'requeue'").select(
        *KEY,
        F.lit(1).alias("attempt"),
        "max_attempts",
        F.col("due_at").alias("next_attempt_at"),
        F.col("final_reason").alias("last_error"),
        F.col("final_class").alias("error_class"),
        "state",
        now.alias("updated_at"),
    )
    queue = enqueue(queue.join(gone, KEY, "left_anti"), again)
    dead = decided.where("decision = 'dead_letter'").select(
        *KEY, F.col("final_reason").alias("reason"), F.col("final_class").alias("error_class"), F.col("state").alias("payload")
    )
    letters = bury(letters, dead, now)
    return queue, resolve_letters(letters, decided.where("decision = 'succeeded'"), now)


def bury(letters: DataFrame, dead: DataFrame, now: Column) -> DataFrame:
    """Dead-letter upsert: an existing entry of the key is reopened with the new reason."""
    new = dead.groupBy(*KEY).agg(F.max_by(F.struct("reason", "error_class", "payload"), "reason").alias("n"))
    old = letters.select(*KEY, *[F.col(c).alias(f"old_{c}") for c in letters.columns if c not in KEY])
    hit = F.col("n").isNotNull()
    return old.join(new, KEY, "full_outer").select(
        *KEY,
        *[F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in ("reason", "error_class", "payload")],
        F.when(hit, "open").otherwise(F.col("old_status")).alias("status"),
        F.coalesce("old_created_at", now).alias("created_at"),
        F.when(~hit, F.col("old_resolved_at")).alias("resolved_at"),
    )


def resolve_letters(letters: DataFrame, succeeded: DataFrame, now: Column) -> DataFrame:
    """Close the letters of succeeded events, unless an operator discarded them."""
    ok = succeeded.select(*KEY).distinct().withColumn("ok", F.lit(True))
    hit = F.col("ok").isNotNull() & (F.col("status") != "discarded")
    return letters.join(ok, KEY, "left").select(
        *[c for c in letters.columns if c not in ("status", "resolved_at")],
        F.when(hit, "resolved").otherwise(F.col("status")).alias("status"),
        F.when(hit, now).otherwise(F.col("resolved_at")).alias("resolved_at"),
    )


def decide_letters(letters: DataFrame, decisions: DataFrame, now: Column, max_attempts: int = MAX_ATTEMPTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Operator decisions {tenant_id, source, event_id, action: retry|discard, actor}.

    Returns (letters, retry entries due at once, audit rows).
    """
    chosen = decisions.groupBy(*KEY).agg(F.max_by(F.struct("action", "actor"), "action").alias("d"))
    both = letters.join(chosen, KEY, "left")
    action = F.col("d.action")
    out = both.select(
        *[c for c in letters.columns if c not in ("status", "resolved_at")],
        F.when(action == "retry", "retrying").when(action == "discard", "discarded").otherwise(F.col("status")).alias("status"),
        F.when(action.isNotNull(), now).otherwise(F.col("resolved_at")).alias("resolved_at"),
    )
    entries = both.where(action == "retry").select(
        *KEY,
        F.lit(1).alias("attempt"),
        F.lit(max_attempts).alias("max_attempts"),
        now.alias("next_attempt_at"),
        F.lit("replayed by an operator").alias("last_error"),
        "error_class",
        F.col("payload").alias("state"),
        now.alias("updated_at"),
    )
    audit = both.where(action.isin("retry", "discard")).select(
        "tenant_id",
        F.col("d.actor").alias("actor"),
        F.concat(F.lit("dlq."), action).alias("action"),
        F.lit("dead_letter").alias("resource_type"),
        F.col("event_id").alias("resource_id"),
        F.to_json(F.struct("event_id", "error_class")).alias("detail"),
        now.alias("created_at"),
    )
    return out, entries, audit
