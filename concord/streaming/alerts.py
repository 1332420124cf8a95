"""Rolling metrics and alert conditions on a live stream of observations.

Stateful operators are chained in append mode: sums per step, sliding windows over the steps, and the hold time over the windows
that meet the condition. The watermark passes from one to the next through the time of each window, so a closed window is sent
on once and its state is dropped; state follows the open windows and not the length of the stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.operators.metrics import ALERTS, STEP

#: The metric name of rows that only say that time has passed.
TICK = "tick"


def ticks(times: DataFrame, at: str) -> DataFrame:
    """Observations that count nothing: steps without events exist through them, which an alert on silence needs."""
    return times.select(F.col(at).alias("at"), F.lit(TICK).alias("metric"), F.lit(0).cast("bigint").alias("n"))


def _seconds(n: int) -> str:
    return f"{n} seconds"


def live_sums(observations: DataFrame, metrics: list[str], window: int, step: int = STEP, late: str = "10 minutes") -> DataFrame:
    """(time, step, one column per metric): sums over the `window` seconds that end with each step.

    `observations` has metric, at and n; rows of other metrics only mark their step as present. Rows that come more than
    `late` behind the latest one may be left out.
    """
    timed = observations.withColumn("_at", F.col("at").cast("timestamp")).withWatermark("_at", late)
    n = [F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("n"))), F.lit(0)).alias(m) for m in metrics]
    steps = timed.groupBy(F.window("_at", _seconds(step)).alias("w")).agg(*n)
    steps = steps.select(F.window_time("w").alias("time"), *metrics)
    sums = steps.groupBy(F.window("time", _seconds(window), _seconds(step)).alias("w")).agg(*[F.sum(m).alias(m) for m in metrics])
    last = (F.col("w.end") - F.expr(f"interval {step} seconds")).cast("timestamp_ntz")
    return sums.select(F.window_time("w").alias("time"), last.alias("step"), *metrics)


def _active(observations: DataFrame, name: str, step: int, late: str) -> DataFrame:
    rule = ALERTS[name]
    sums = live_sums(observations, rule["metrics"], rule["window"], step, late)
    scored = sums.select("time", "step", rule["value"](F.col).alias("value"))
    return scored.where(F.coalesce(rule["when"](F.col("value")), F.lit(False)))


def live_alerts(observations: DataFrame, name: str, step: int = STEP, late: str = "10 minutes") -> DataFrame:
    """(alert, step, value) for each step at which a standard alert fires: the condition has been met on every step for the
    hold time. A step is sent as soon as the watermark has passed it. Steps are those that have observations (see `ticks`)."""
    hold = ALERTS[name]["hold"]
    over = F.window("time", _seconds(hold + step), _seconds(step)).alias("w")
    held = _active(observations, name, step, late).groupBy(over).agg(F.count(F.lit(1)).alias("met"), F.max(F.struct("step", "value")).alias("last"))
    return held.where(F.col("met") == hold // step + 1).select(F.lit(name).alias("alert"), "last.step", "last.value")


def incidents(observations: DataFrame, name: str, step: int = STEP, late: str = "10 minutes") -> DataFrame:
    """(alert, since, first, last, fired): each closed run of steps on which a standard alert's condition was met for its hold
    time, with the first and last step at which it fired, and how often. Runs are session windows whose gap is one step."""
    hold = ALERTS[name]["hold"]
    run: Column = F.session_window("time", _seconds(step + step // 2)).alias("w")
    # a stream has no session windows without a key, and a plain constant is optimized away
    key = F.concat(F.lit(name), F.substring(F.col("step").cast("string"), 1, 0)).alias("alert")
    spans = _active(observations, name, step, late).groupBy(key, run).agg(F.min("step").alias("since"), F.max("step").alias("last"))
    first = F.col("since") + F.expr(f"interval {hold} seconds")
    fired = F.expr(f"timestampdiff(SECOND, since, last) - {hold}") / step + 1
    return spans.where(F.col("last") >= first).select("alert", "since", first.alias("first"), "last", fired.cast("bigint").alias("fired"))
