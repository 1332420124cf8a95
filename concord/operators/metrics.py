"""Counters, rates, histograms, quantiles and alert conditions over event-time series.

Input is first reduced to one row per (series, step); sliding windows, grids and hold times then work
on that reduced series, whose size depends on the time span and not on the number of events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.session import cut_lineage

STEP = 15

# Upper bounds of the processing-time histogram, in seconds.
DURATION_BOUNDS = (0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)


def floor_to(at: Column, seconds: int) -> Column:
    """Start of the step holding `at`, independent of the session zone."""
    return F.window(at, f"{seconds} seconds")["start"]


# M1 ----------------------------------------------------------------------------------------------

SUCCESS = ("applied", "deleted", "noop_delete", "stale", "echo", "parked", "resolved", "ignored", "adopted")


def outcome_counters(outcomes: DataFrame, seconds: int = 60) -> DataFrame:
    """Engine counters per window and source. `outcomes` has source, outcome, at and, per event,
    n_writes, n_conflicts and the failure `kind` (null when it did not fail)."""
    o = F.col("outcome")

    def n(cond: Column) -> Column:
        return F.count_if(cond)

    permanent = F.coalesce(F.col("kind").isin("PERMANENT", "AUTHENTICATION", "SCHEMA_ERROR"), F.lit(False))
    return outcomes.groupBy(floor_to(F.col("at"), seconds).alias("window_start"), "source").agg(
        F.count(F.lit(1)).alias("events"),
        n(o.isin(*SUCCESS)).alias("success"),
        n(o == "failed").alias("failed"),
        n(o == "duplicate").alias("duplicates"),
        n(o == "stale").alias("stale"),
        n(o == "echo").alias("loops_prevented"),
        F.sum("n_writes").alias("destination_writes"),
        n((o == "failed") & ~permanent).alias("retries_scheduled"),
        n((o == "failed") & permanent).alias("dlq"),
        n(F.col("n_conflicts") > 0).alias("conflicts_detected"),
        n((F.col("n_conflicts") > 0) & (o == "applied")).alias("conflicts_resolved"),
    )


def writes_by_target(changes: DataFrame, seconds: int = 60) -> DataFrame:
    return changes.groupBy(floor_to(F.col("at"), seconds).alias("window_start"), "target").agg(F.count(F.lit(1)).alias("destination_writes"))


def finding_counters(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Reconciliation counters per source: runs completed, findings recorded, repairs applied."""
    f = findings.join(runs.select("run_id", "source"), "run_id").groupBy("source").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(F.col("status") == "applied").alias("repairs")
    )
    r = runs.where("status = 'completed'").groupBy("source").agg(F.count(F.lit(1)).alias("runs"))
    return r.join(f, "source", "full_outer").fillna(0, ["runs", "findings", "repairs"])


# M2, M3 ------------------------------------------------------------------------------------------


def per_step(events: DataFrame, at: str, by: list[str] | None = None, value: Column | None = None, step: int = STEP) -> DataFrame:
    """One row per (series, step) with `n`."""
    amount = F.count(F.lit(1)) if value is None else F.sum(value)
    return events.groupBy(*(by or []), floor_to(F.col(at), step).alias("step")).agg(amount.alias("n"))


def increase(steps: DataFrame, by: list[str] | None = None, window: int = 300, step: int = STEP) -> DataFrame:
    """Sum over a sliding window, labelled by the window's end."""
    win = F.window("step", f"{window} seconds", f"{step} seconds")
    return steps.groupBy(*(by or []), win.alias("w")).agg(F.sum("n").alias("n")).select(*(by or []), F.col("w.end").alias("window_end"), "n")


def rate(steps: DataFrame, by: list[str] | None = None, window: int = 60, step: int = STEP) -> DataFrame:
    """Per-second rate over a sliding window."""
    return increase(steps, by, window, step).select(*(by or []), "window_end", (F.col("n") / F.lit(float(window))).alias("per_second"))


# M4 - M6 -----------------------------------------------------------------------------------------


def histogram(df: DataFrame, value: str, by: list[str] | None = None, bounds: tuple[float, ...] = DURATION_BOUNDS) -> DataFrame:
    """Cumulative bucket counts as one array per series; the last entry is the +Inf bucket."""
    v = F.col(value)
    cells = [F.count_if(v <= b).alias(f"b{i}") for i, b in enumerate(bounds)] + [F.count(v).alias("inf")]
    wide = df.groupBy(*(by or [])).agg(*cells)
    return wide.select(*(by or []), F.array(*[F.col(f"b{i}") for i in range(len(bounds))], F.col("inf")).alias("cumulative"))


def buckets(hist: DataFrame, by: list[str] | None = None, bounds: tuple[float, ...] = DURATION_BOUNDS) -> DataFrame:
    """One row per bucket: `le` (text, +Inf last) and the cumulative count."""
    labels = F.array(*[F.lit(f"{b:g}") for b in bounds], F.lit("+Inf"))
    return hist.select(*(by or []), F.posexplode(F.arrays_zip(labels.alias("le"), F.col("cumulative").alias("n"))).alias("pos", "c")).select(
        *(by or []), "pos", F.col("c.le").alias("le"), F.col("c.n").alias("cumulative")
    )


def histogram_quantile(cumulative: Column, q: float, bounds: tuple[float, ...] = DURATION_BOUNDS) -> Column:
    """Quantile by linear interpolation inside the bucket that reaches the rank. A rank in the +Inf
    bucket gives the highest finite bound; an empty histogram gives null."""
    total = F.element_at(cumulative, len(bounds) + 1)
    rank = total * F.lit(q)
    out = F.when(total == 0, F.lit(None).cast("double"))
    for i, upper in enumerate(bounds):
        lower = bounds[i - 1] if i else 0.0
        below = F.element_at(cumulative, i) if i else F.lit(0)
        here = F.element_at(cumulative, i + 1)
        out = out.when(here >= rank, F.lit(lower) + F.lit(upper - lower) * F.try_divide(rank - below, here - below))
    return out.otherwise(F.lit(bounds[-1]))


def bucket_bound(cumulative: Column, p: float, bounds: tuple[float, ...] = DURATION_BOUNDS) -> Column:
    """Label of the smallest bucket whose cumulative count reaches p of the total."""
    target = F.element_at(cumulative, len(bounds) + 1) * F.lit(p)
    out: Column | None = None
    for i, bound in enumerate(bounds):
        cond = F.element_at(cumulative, i + 1) >= target
        out = F.when(cond, F.lit(f"{bound:g}")) if out is None else out.when(cond, F.lit(f"{bound:g}"))
    return out.otherwise(F.lit("+Inf"))


# M7, M8 ------------------------------------------------------------------------------------------


def exact_percentiles(df: DataFrame, value: str, ps: list[float], by: list[str] | None = None) -> DataFrame:
    """The element at position floor((n-1)*p) of the sorted values, per group.

    Equal values are counted first, so a value that holds a large share of the rows becomes one row.
    Range partitioning by (group, value) then gives every distinct value its span of positions from
    its partition's offset and its local running count; no group is gathered anywhere.
    """
    key = by or ["_all"]
    counted = (df if by else df.withColumn("_all", F.lit(0))).where(F.col(value).isNotNull()).groupBy(*key, F.col(value).alias("value")).agg(
        F.count(F.lit(1)).alias("c")
    )
    row = F.monotonically_increasing_id()
    placed = cut_lineage(
        counted.repartitionByRange(*key, "value")
        .sortWithinPartitions(*key, "value")
        .select(*key, "value", "c", F.shiftright(row, 33).alias("part"), row.bitwiseAND((1 << 33) - 1).alias("pos")),
        "sorted",
    )
    sizes = placed.groupBy("part").agg(F.sum("c").alias("rows"))
    # One row per partition: this unpartitioned window and the broadcast are over that many rows.
    offsets = sizes.select("part", (F.sum("rows").over(W.orderBy("part")) - F.col("rows")).alias("offset"))
    local = F.sum("c").over(W.partitionBy("part").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    spans = placed.join(F.broadcast(offsets), "part").withColumn("to", F.col("offset") + local).withColumn("from", F.col("to") - F.col("c"))
    groups = spans.groupBy(*key).agg(F.min("from").alias("first"), F.sum("c").alias("n"))
    targets = F.array(*[F.struct(F.lit(p).alias("p"), (F.col("first") + F.floor((F.col("n") - 1) * F.lit(p))).alias("idx")) for p in ps])
    hits = F.filter(targets, lambda t: (t["idx"] >= F.col("from")) & (t["idx"] < F.col("to")))
    out = spans.join(groups, key).select(*key, "n", "value", F.explode(hits).alias("t")).select(*key, "t.p", "n", "value")
    return out if by else out.drop("_all")


def burst_summary(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Load summary of a delivery log {status, latency_ms, at}: sent, accepted, rejected, errors,
    throughput over the elapsed time, and p50/p95/p99 latency. Status null means a transport error."""
    by = by or []
    key = by or ["_all"]
    if not by:
        log = log.withColumn("_all", F.lit(0))
    seconds = F.expr("timestampdiff(MICROSECOND, min(at), max(at))") / F.lit(1e6)
    ok = F.col("status").isin(200, 202)
    base = log.groupBy(*key).agg(
        F.count(F.lit(1)).alias("sent"),
        F.count_if(ok).alias("accepted"),
        F.count_if(~ok).alias("rejected"),
        F.count_if(F.col("status").isNull()).alias("errors"),
        seconds.alias("elapsed_s"),
    )
    pct = exact_percentiles(log, "latency_ms", [0.5, 0.95, 0.99], key).groupBy(*key).agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    )
    out = base.join(pct, key, "left").withColumn("throughput", F.try_divide(F.col("accepted").cast("double"), F.col("elapsed_s")))
    return out if by else out.drop("_all")


# M9 ----------------------------------------------------------------------------------------------


def counter_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    b = before.select("metric", F.col("value").alias("b"))
    a = after.select("metric", F.col("value").alias("a"))
    return b.join(a, "metric", "full_outer").select("metric", (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("delta"))


# M10 - M17 ---------------------------------------------------------------------------------------


def grid(steps: DataFrame, step: int = STEP) -> DataFrame:
    """Every step between the first and the last one, so that silent steps exist with zero.

    Days are generated first and steps within a day second, so no row holds a long array.
    """
    span = steps.agg(F.min("step").alias("lo"), F.max("step").alias("hi"))
    days = span.select("lo", "hi", F.explode(F.sequence(F.date_trunc("day", "lo"), F.date_trunc("day", "hi"), F.expr("interval 1 day"))).alias("day"))
    ticks = days.select("lo", "hi", F.explode(F.sequence("day", F.col("day") + F.expr(f"interval 1 day - interval {step} seconds"), F.expr(f"interval {step} seconds"))).alias("step"))
    return ticks.where(F.col("step").between(F.col("lo"), F.col("hi"))).select(F.col("step").cast("timestamp_ntz").alias("step"))


def series(observations: DataFrame, metrics: list[str], step: int = STEP) -> DataFrame:
    """Dense step series with one column per metric, from long rows {metric, at, n}."""
    picked = observations.where(F.col("metric").isin(metrics))
    reduced = picked.groupBy(floor_to(F.col("at"), step).alias("step")).agg(
        *[F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("n"))), F.lit(0)).alias(m) for m in metrics]
    )
    all_steps = observations.groupBy(floor_to(F.col("at"), step).alias("step")).agg(F.lit(1).alias("one"))
    return grid(all_steps, step).join(reduced, "step", "left").fillna(0, metrics)


def trailing(name: str, seconds: int, step: int = STEP) -> Column:
    """Sum over the trailing window on a dense series."""
    return F.sum(name).over(W.orderBy("step").rowsBetween(-(seconds // step) + 1, 0))


def held(conditions: DataFrame, seconds: int, step: int = STEP) -> DataFrame:
    """Steps at which `active` has been true on every step for `seconds`: consecutive true steps form
    an island, and the alert fires once the island is old enough."""
    line = W.orderBy("step")
    marked = conditions.withColumn("pos", F.row_number().over(line))
    true = marked.where("active")
    island = true.withColumn("island", F.col("pos") - F.row_number().over(line))
    first = W.partitionBy("island")
    out = island.withColumn("since_pos", F.min("pos").over(first)).withColumn("since", F.min("step").over(first))
    return out.where((F.col("pos") - F.col("since_pos")) * step >= seconds).select("step", "since", "value")


def alert(observations: DataFrame, name: str, step: int = STEP) -> DataFrame:
    """Firing steps of one of the standard alerts."""
    rule = ALERTS[name]
    dense = series(observations, rule["metrics"], step)
    scored = dense.select("step", rule["value"](lambda name: trailing(name, rule["window"], step)).alias("value"))
    active = scored.withColumn("active", F.coalesce(rule["when"](F.col("value")), F.lit(False)))
    return held(active, rule["hold"], step).select(F.lit(name).alias("alert"), "step", "since", "value")


def _ratio(top: str, bottom: str):
    return lambda total: F.try_divide(total(top).cast("double"), total(bottom).cast("double"))


def _growth(name: str):
    return lambda total: total(name).cast("double")


# Metrics, window, threshold and hold time of each standard alert. `value` is made from sums over the window.
ALERTS = {
    "event_failure_rate_high": {"metrics": ["failed", "events"], "window": 300, "value": _ratio("failed", "events"), "when": lambda v: v > 0.05, "hold": 600},
    "dlq_growth": {"metrics": ["dlq"], "window": 600, "value": _growth("dlq"), "when": lambda v: v > 0, "hold": 300},
    "retry_backlog": {
        "metrics": ["retries", "success"],
        "window": 300,
        "value": lambda total: (total("retries") - total("success")) / F.lit(300.0),
        "when": lambda v: v > 0.1,
        "hold": 900,
    },
    "reconcile_drift_spike": {"metrics": ["findings"], "window": 600, "value": _growth("findings"), "when": lambda v: v > 100, "hold": 300},
    "conflict_spike": {"metrics": ["conflicts"], "window": 600, "value": _growth("conflicts"), "when": lambda v: v > 100, "hold": 300},
    "no_events_processed": {"metrics": ["events"], "window": 600, "value": _growth("events"), "when": lambda v: v == 0, "hold": 1800},
    "api_error_rate_high": {"metrics": ["errors", "requests"], "window": 300, "value": _ratio("errors", "requests"), "when": lambda v: v > 0.1, "hold": 600},
}


# M18 ---------------------------------------------------------------------------------------------


def in_flight(log: DataFrame, step: int = STEP) -> DataFrame:
    """Requests open at the end of each step. Starts and ends are netted per step before the running
    sum, so the ordered pass is over steps, not requests."""
    ends = F.col("ts") + F.make_dt_interval(secs=F.col("duration_s").cast("decimal(18,6)"))
    moves = log.select(F.explode(F.array(F.struct(F.col("ts").alias("at"), F.lit(1).alias("d")), F.struct(ends.alias("at"), F.lit(-1).alias("d")))).alias("m"))
    net = moves.groupBy(floor_to(F.col("m.at"), step).alias("step")).agg(F.sum("m.d").alias("d"))
    return net.select("step", F.sum("d").over(W.orderBy("step")).alias("in_flight"))


def latency_quantile(log: DataFrame, q: float = 0.95, window: int = 60, step: int = STEP) -> DataFrame:
    """Interpolated latency quantile in milliseconds over a sliding window."""
    per = histogram(log.withColumn("step", floor_to(F.col("ts"), step)), "duration_s", ["step"])
    win = F.window("step", f"{window} seconds", f"{step} seconds")
    n = len(DURATION_BOUNDS) + 1
    summed = per.groupBy(win.alias("w")).agg(F.array(*[F.sum(F.element_at("cumulative", i + 1)) for i in range(n)]).alias("cumulative"))
    return summed.select(F.col("w.end").alias("window_end"), (histogram_quantile(F.col("cumulative"), q) * 1000).alias("latency_ms"))
