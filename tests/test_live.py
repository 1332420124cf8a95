"""Alerts and timers on live streams."""

import datetime as dt
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from concord.operators import metrics
from concord.streaming import alerts, redelivery

T0 = dt.datetime(2024, 1, 1)
OBS = "at timestamp_ntz, metric string, n bigint"


def observations(seed):
    rnd, rows = random.Random(seed), []
    for minute in range(180):
        quiet = 60 <= minute < 110
        for _ in range(0 if quiet else rnd.randint(1, 6)):
            at = T0 + dt.timedelta(minutes=minute, seconds=rnd.randint(0, 59))
            rows.append((at, "events", 1))
            if (minute // 40) % 2 or rnd.random() < 0.02:
                rows.append((at, "failed", 1))
            rows.append((at, "conflicts", rnd.choice([0, 30])))
    return rows


def drained(stream, tmp_path, name, schema):
    out = str(tmp_path / name)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(out), q


def live(spark, tmp_path, seed=3, slices=6):
    rows = observations(seed)
    beats = [(T0 + dt.timedelta(minutes=m), alerts.TICK, 0) for m in range(180)]
    # time goes on until everything that was seen has left all windows
    end = [(T0 + dt.timedelta(minutes=m), alerts.TICK, 0) for m in (181, 360)]
    path = str(tmp_path / "in")
    edges = [T0 + dt.timedelta(minutes=180 * i // slices) for i in range(slices + 1)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = [r for r in [*rows, *beats] if lo <= r[0] < hi]
        spark.createDataFrame(part, OBS).coalesce(1).write.mode("append").parquet(path)
    for r in end:
        spark.createDataFrame([r], OBS).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).parquet(path)
    return spark.createDataFrame([*rows, *beats], OBS), stream


@pytest.mark.parametrize("name", ["event_failure_rate_high", "conflict_spike", "no_events_processed"])
def test_live_alerts_equal_the_batch_alerts(spark, tmp_path, name):
    batch, stream = live(spark, tmp_path)
    last = T0 + dt.timedelta(minutes=179)
    want = {(r.step, r.value) for r in metrics.alert(batch, name, 60).collect()}
    found, q = drained(alerts.live_alerts(stream, name, 60), tmp_path, name, "alert string, step timestamp_ntz, value double")
    rows = found.where(F.col("step") <= F.lit(last)).collect()
    assert want and {(r.step, r.value) for r in rows} == want and len(rows) == len(want)
    # windows that the watermark has passed hold no state any more
    left = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in q.recentProgress]
    assert left[-1] <= 30 < max(left)


def test_incidents_equal_the_runs_of_the_batch_alert(spark, tmp_path):
    batch, stream = live(spark, tmp_path)
    name = "event_failure_rate_high"
    runs = metrics.alert(batch, name, 60).groupBy("since").agg(F.min("step").alias("first"), F.max("step").alias("last"), F.count("*").alias("fired"))
    found, _ = drained(alerts.incidents(stream, name, 60), tmp_path, "runs", "alert string, since timestamp_ntz, first timestamp_ntz, last timestamp_ntz, fired bigint")
    want = sorted((r.since, r.first, r.fired) for r in runs.where(F.col("last") < F.lit(T0 + dt.timedelta(minutes=179))).collect())
    assert want and want == sorted((r.since, r.first, r.fired) for r in found.where(F.col("last") < F.lit(T0 + dt.timedelta(minutes=179))).collect())


ENTRY = "tenant_id string, source string, event_id string, attempt int, next_attempt_at timestamp_ntz, state string, arrival_seq bigint"


def test_retries_come_back_when_due_and_once_over_a_restart(spark, tmp_path):
    path, out, ck = (str(tmp_path / n) for n in ("moves", "out", "ck"))
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None)

    def put(rows, cancels=()):
        entries = spark.createDataFrame([("t0", "hubspot", e, a, at, f"s-{e}", seq) for e, a, at, seq in rows], ENTRY)
        moves = redelivery.schedule(entries)
        if cancels:
            moves = moves.unionByName(redelivery.cancel(entries.where(F.col("event_id").isin(*cancels))))
        moves.coalesce(1).write.mode("append").parquet(path)
        return moves.schema

    soon = now + dt.timedelta(seconds=25)
    schema = put([("a", 1, now - dt.timedelta(hours=1), 5), ("b", 2, None, 4), ("c", 1, soon, 3), ("d", 1, now, 2), ("e", 1, soon, 1)], ["d"])

    def run(until):
        stream = redelivery.redeliver(spark.readStream.schema(schema).parquet(path))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(processingTime="1 second").start()
        deadline = time.time() + 90
        try:
            while len(read()) < until and time.time() < deadline:
                time.sleep(0.5)
        finally:
            q.stop()
        return read()

    def read():
        try:
            rows = spark.read.schema(ENTRY).parquet(out).collect()
        except Exception:
            return []
        return sorted((r.next_attempt_at, r.arrival_seq, r.event_id, r.attempt, r.state) for r in rows)

    first = run(2)
    assert [r[2] for r in first] == ["b", "a"] and [r[3] for r in first] == [2, 1]
    put([("c", 1, soon + dt.timedelta(seconds=1), 3)])  # a further failure of an event that waits
    both = run(4)
    assert dt.datetime.now(dt.UTC).replace(tzinfo=None) >= soon
    assert [r[2:] for r in both] == [("b", 2, "s-b"), ("a", 1, "s-a"), ("e", 1, "s-e"), ("c", 2, "s-c")]


class Shelf:
    """The state and timers of one shelf, and how often they were asked."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentProcessingTimeInMs


def test_many_retries_take_few_calls_of_the_store():
    shelf, waiting = Shelf(), redelivery.Waiting()
    waiting.init(shelf)
    columns = ["tenant_id", "source", "event_id", "action", "attempt", "due_us", "arrival_seq", "state", "order"]

    def put(rows, now):
        return sent(waiting.handleInputRows((0,), iter([pd.DataFrame(rows, columns=columns)]), At(now)))

    def sent(frames):
        return [tuple(r) for f in frames for r in f.itertuples(index=False)]

    def move(i, action="schedule", attempt=1, due=None, order=0):
        return ("t0" if i % 2 else None, "hubspot", f"e{i}", action, attempt, (1_000_000 + i * 1000 if due is None else due), i, f"s{i}", order)

    assert put([move(i) for i in range(2000)] + [move(i, "cancel", order=1) for i in range(0, 2000, 10)], 500) == []
    assert shelf.timers == {1001} and shelf.calls <= 4
    # one waits longer and counts one attempt more, one is due at once, one is taken out
    assert [r[2:4] for r in put([move(1, due=9_000_000), move(2, due=0), move(3, "cancel")], 900)] == [("e2", 2)]
    shelf.timers -= {1004}  # Spark takes out a timer that has fired
    assert [r[2] for r in sent(waiting.handleExpiredTimer((0,), At(1005), At(1004)))] == ["e4", "e5"]
    assert shelf.timers == {1006} and shelf.calls <= 12
    shelf.timers -= {1006}
    rest = sent(waiting.handleExpiredTimer((0,), At(9000), At(1006)))
    assert [(r[2], r[3]) for r in rest if r[3] != 1] == [("e1", 2)] and rest[0][:3] == (None, "hubspot", "e6")
    assert len(rest) == 2000 - 200 - 4 and shelf.value is None and not shelf.timers
