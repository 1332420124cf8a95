"""Structured Streaming queries: intake, apply, live metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from concord.operators.replay import replay
from concord.schemas import EK, EVENT
from concord.session import cut_lineage, numbered, utc_now
from concord.sources.tables import TableStore, persist_replay


def apply_stream(events: DataFrame, store: TableStore, checkpoint: str, name: str = "apply", available_now: bool = True, **options) -> StreamingQuery:
    """Replay every micro-batch against the stored state and publish one version per batch.

    Order follows arrival and versions, never event time: nothing is dropped for being late, so
    there is no watermark. A batch that was published before a crash is skipped when Spark runs it
    again, and offsets advance only after the publication.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        if store.seen(name, batch_id):
            return
        store.rollback()
        rows = batch
        if "poison" in batch.columns:
            bury_poison(store, batch.where("poison is not null"))
            rows = batch.where("poison is null").drop("poison")
        result = replay(
            rows,
            store.read("canonical_records"),
            store.read("policies"),
            outbound=store.read("outbound_writes"),
            processed=store.read("processed_events"),
            **options,
        )
        persist_replay(store, result, name, batch_id)

    writer = events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def bury_poison(store: TableStore, poison: DataFrame) -> None:
    """Undecodable messages become dead letters in the version of their batch."""
    from concord.operators import failures

    rows = poison.select(
        F.coalesce("tenant_id", F.lit("")).alias("tenant_id"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.sha2("poison", 256).alias("event_id"),
        F.lit("undecodable message").alias("reason"),
        F.lit("SCHEMA_ERROR").alias("error_class"),
        F.col("poison").alias("payload"),
    )
    if rows.limit(1).count():
        store.replace("dead_letter", failures.bury(store.read("dead_letter"), rows, utc_now()))


def retry_due(store: TableStore, now, limit: int | None = None, **options) -> int:
    """One round over the due retries: replay their events, then settle the queue and letters.

    Events apply in the order of their due times, and at one time in the order in which they arrived first. All due
    entries are taken unless `limit` asks for a page of them.
    """
    from concord.operators import failures

    queue = store.read("retry_queue")
    due = cut_lineage(failures.all_due(queue, now) if limit is None else failures.due(queue, now, limit), "due")
    events = due.select(F.from_json("state", EVENT).alias("e"), "next_attempt_at").select("e.*", "next_attempt_at")
    events = events.where("event_id is not null").withColumnRenamed("arrival_seq", "arrived").drop("delivery")
    events = numbered(events, "next_attempt_at", "arrived", *EK).drop("next_attempt_at", "arrived").withColumn("delivery", F.lit(1))
    result = replay(
        events, store.read("canonical_records"), store.read("policies"), outbound=store.read("outbound_writes"), processed=store.read("processed_events"), **options
    )
    failed = result.failures.select(*EK, "kind", "message")
    attempts = due.join(failed, EK, "left").withColumn("hint", F.lit(0))
    queue, letters = failures.settle(store.read("retry_queue"), store.read("dead_letter"), failures.retry_outcome(attempts, now), now)
    quiet = result.__class__(**{**result.__dict__, "failures": result.failures.where(F.lit(False))})
    queue, letters = cut_lineage(queue, "queue"), cut_lineage(letters, "letters")
    store.replace("retry_queue", queue)
    store.replace("dead_letter", letters)
    return persist_replay(store, quiet)


def deduplicate(events: DataFrame) -> DataFrame:
    """First delivery per event key for ever: exact, with state that grows with the number of keys."""
    return events.dropDuplicates(EK)


def deduplicate_recent(events: DataFrame, at: str, horizon: str) -> DataFrame:
    """Weaker, bounded variant: repeats are recognized only within `horizon` of the first delivery."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", horizon)
    return timed.dropDuplicatesWithinWatermark(EK).drop("_at")


def live_counts(events: DataFrame, at: str, late: str = "10 minutes", window: str = "1 minute", slide: str = "15 seconds", by: list[str] | None = None) -> DataFrame:
    """Rolling per-second rates on a live stream."""
    return (
        events.withColumn("_at", F.col(at).cast("timestamp"))
        .withWatermark("_at", late)
        .groupBy(F.window("_at", window, slide).alias("w"), *(by or []))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.end").cast("timestamp_ntz").alias("window_end"), *(by or []), "n", (F.col("n") / (F.unix_seconds("w.end") - F.unix_seconds("w.start"))).alias("per_second"))
    )
