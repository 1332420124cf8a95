"""Delayed redelivery with timers: retries come back when they are due, without a scan of a queue.

Waiting retries are keyed state with processing-time timers, kept by the state store and its checkpoint. Events are dealt to
shelves by hash; a shelf is one state value with one timer, for its earliest retry, so a trigger asks the store a few times for each
shelf and not for each event. It touches the shelves of the entries that arrive or fall due and no others; after a
restart timers go on where they stood, and an entry that was sent is gone with the batch that sent it.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from concord.schemas import EK

#: State stores with timers need RocksDB.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Part of the checkpoint, as the key of the state. A trigger rewrites the shelves it touches, so a shelf should hold some thousands of entries at most.
SHELVES = 1 << 12
OUT = "tenant_id string, source string, event_id string, attempt int, due_us bigint, arrival_seq bigint, state string"
_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def micros(at: Column | str) -> Column:
    """Microseconds of a UTC wall clock, whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), at)


_NAMES = [c.split()[0] for c in OUT.split(", ")]
_SHELF = ", ".join(f"{n} array<{t}>" for n, t in (c.split() for c in OUT.split(", "))) + ", timer bigint"


def _fires(due_us: int) -> int:
    """Milliseconds at which a retry is due."""
    return -(-due_us // 1000)


class Waiting(StatefulProcessor):
    """The retries of one shelf, at most one for each event, and the timer of the earliest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shelf = handle.getValueState("shelf", _SHELF)

    def _held(self) -> tuple[dict[tuple, tuple], int | None]:
        held = self.shelf.get()
        if held is None:
            return {}, None
        *columns, timer = held
        return {entry[:3]: entry[3:] for entry in zip(*columns, strict=True)}, timer

    def _send(self, entries: dict[tuple, tuple], now: int, timer: int | None, fired: int | None = None) -> Iterator[pd.DataFrame]:
        """Send what is due, keep the rest under the timer of the earliest. Spark deletes the timer that `fired` itself."""
        due = [(*event, *entry) for event, entry in entries.items() if _fires(entry[1]) <= now]
        rest = [(*event, *entry) for event, entry in entries.items() if _fires(entry[1]) > now]
        first = min(_fires(entry[4]) for entry in rest) if rest else None
        if timer is not None and timer != first and timer != fired:
            self.handle.deleteTimer(timer)
        if rest:
            self.shelf.update((*map(list, zip(*rest, strict=True)), first))
            if first != timer:
                self.handle.registerTimer(first)
        elif timer is not None:
            self.shelf.clear()
        return iter([pd.DataFrame(due, columns=_NAMES)] if due else [])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entries, timer = self._held()
        moves = pd.concat(list(rows)).sort_values(["order", "arrival_seq"], kind="stable")
        for action, *event, attempt, due, seq, state in zip(*(moves[n] for n in ["action", *_NAMES]), strict=True):
            event = tuple(None if v != v else v for v in event)  # pandas may have nan for null
            held = entries.pop(event, None)
            if action == "schedule":
                entries[event] = (int(attempt) if held is None else held[0] + 1, int(due), int(seq), None if state != state else state)
        return self._send(entries, timerValues.getCurrentProcessingTimeInMs(), timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        entries, timer = self._held()
        return self._send(entries, timerValues.getCurrentProcessingTimeInMs(), timer, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def schedule(entries: DataFrame, order: Column | None = None) -> DataFrame:
    """Moves that put retry-queue entries (RETRY columns and arrival_seq) in wait. An entry of an event that waits already takes
    its place and counts one attempt more. A missing due time is due at once."""
    return entries.select(
        *EK, F.lit("schedule").alias("action"), "attempt", F.coalesce(micros(F.col("next_attempt_at")), F.lit(0)).alias("due_us"),
        F.coalesce("arrival_seq", F.lit(0)).cast("bigint").alias("arrival_seq"), "state", (order if order is not None else F.lit(0)).cast("int").alias("order"),
    )


def cancel(keys: DataFrame, order: Column | None = None) -> DataFrame:
    """Moves that take the events of `keys` out of wait: they succeeded, went to the dead letters or were discarded."""
    none = F.lit(None)
    return keys.select(
        *EK, F.lit("cancel").alias("action"), F.lit(0).alias("attempt"), F.lit(0).cast("bigint").alias("due_us"), F.lit(0).cast("bigint").alias("arrival_seq"),
        none.cast("string").alias("state"), (order if order is not None else F.lit(1)).cast("int").alias("order"),
    )


def redeliver(moves: DataFrame, shelves: int = SHELVES) -> DataFrame:
    """Stream of retries that have fallen due: EK, attempt, next_attempt_at, arrival_seq, state. Apply the rows of a batch in the
    order of `next_attempt_at` and `arrival_seq`. Moves of one event in one batch count by `order`. A checkpoint stays with its number
    of `shelves`. Sets the session's state store to RocksDB, which timers need, for the streams started from here on."""
    spark = moves.sparkSession
    spark.conf.set(*PROVIDER)
    dealt = moves.withColumn("shelf", F.pmod(F.xxhash64(*EK), F.lit(shelves)).cast("int"))
    due = dealt.groupBy("shelf").transformWithStateInPandas(Waiting(), OUT, "Append", "ProcessingTime")
    at = F.timestamp_add("MICROSECOND", F.col("due_us"), F.expr(_EPOCH))
    return due.select(*EK, "attempt", at.alias("next_attempt_at"), "arrival_seq", "state")


def drain(query: StreamingQuery, batches: int = 2) -> None:
    """Stop a stream of timers after so many batches in a row without input: what is due by then has been sent.

    Such a stream always has a next batch, since time goes on, so a trigger that ends with the input would never end. Start it with
    a processing-time trigger.
    """
    try:
        seen, quiet = -1, 0
        while quiet < batches:
            if not query.isActive:
                query.awaitTermination()
                return
            progress = query.lastProgress
            if progress is not None and progress["batchId"] > seen:
                quiet = 0 if progress["numInputRows"] else quiet + progress["batchId"] - max(seen, 0)
                seen = progress["batchId"]
            time.sleep(0.2)
    finally:
        query.stop()
