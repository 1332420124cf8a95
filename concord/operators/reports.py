"""Listings, counts and checks over the state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.functions.columns import clamp_limit, micros
from concord.operators.scope import scoped
from concord.schemas import EK
from concord.session import cut_lineage


def listing(
    df: DataFrame,
    tenant_id: str | None,
    order: Column,
    ties: list[str],
    limit: int | None = None,
    cap: int = 1000,
    filters: dict[str, str | None] | None = None,
) -> DataFrame:
    """Tenant rows matching the given equality filters, sorted and cut to the clamped limit.

    Sort plus limit runs as a distributed top-k; the tie columns make the cut deterministic.
    """
    out = scoped(df, tenant_id)
    for column, value in (filters or {}).items():
        if value:
            out = out.where(F.col(column) == value)
    return out.orderBy(order, *ties).limit(clamp_limit(limit, cap))


def conflicts(df: DataFrame, tenant_id: str | None, status: str | None = None, limit: int | None = None) -> DataFrame:
    return listing(df, tenant_id, F.desc("detected_at"), ["conflict_id"], limit, filters={"status": status})


def dead_letters(df: DataFrame, tenant_id: str | None, status: str | None = None, limit: int | None = None) -> DataFrame:
    return listing(df, tenant_id, F.desc("created_at"), ["event_id"], limit, filters={"status": status})


def source_events(df: DataFrame, tenant_id: str | None, limit: int | None = None) -> DataFrame:
    return listing(df, tenant_id, F.desc("received_at"), ["source", "event_id"], limit)


def sync_jobs(df: DataFrame, tenant_id: str | None, limit: int | None = None) -> DataFrame:
    return listing(df, tenant_id, F.desc("created_at"), ["job_id"], limit)


def runs(df: DataFrame, tenant_id: str | None, limit: int | None = None) -> DataFrame:
    return listing(df, tenant_id, F.desc("started_at"), ["run_id"], limit)


def findings(df: DataFrame, tenant_id: str | None, run_id: str, status: str | None = None, limit: int | None = None) -> DataFrame:
    return listing(df, tenant_id, F.asc("created_at"), ["finding_id"], limit, filters={"run_id": run_id, "status": status})


def audit(df: DataFrame, tenant_id: str | None, actor: str | None = None, action: str | None = None, resource: str | None = None, limit: int | None = None) -> DataFrame:
    return listing(
        df, tenant_id, F.desc("created_at"), ["action", "resource_id"], limit, 500,
        {"actor": actor, "action": action, "resource_type": resource},
    )


def operations(df: DataFrame, tenant_id: str | None, entity_type: str | None = None, entity_id: str | None = None, target: str | None = None, limit: int | None = None) -> DataFrame:
    return listing(
        df, tenant_id, F.desc("created_at"), ["event_id", "target_source"], limit, 500,
        {"entity_type": entity_type, "entity_id": entity_id, "target_source": target},
    )


def connections(df: DataFrame, tenant_id: str | None) -> DataFrame:
    return scoped(df, tenant_id).orderBy("created_at", "provider")


def tenants(df: DataFrame) -> DataFrame:
    return df.orderBy("created_at", "tenant_id")


def policies(df: DataFrame, tenant_id: str | None) -> DataFrame:
    return scoped(df, tenant_id).where("enabled").orderBy("created_at", "source", "destination")


def live_sessions(df: DataFrame, tenant_id: str | None, now: Column, limit: int | None = None) -> DataFrame:
    live = df.where(F.col("revoked_at").isNull() & (F.col("expires_at") > now))
    return listing(live, tenant_id, F.desc("created_at"), ["session_id"], limit, 500)


def single(df: DataFrame, tenant_id: str | None, **key: str) -> DataFrame:
    """One row by its key, inside a tenant."""
    out = scoped(df, tenant_id)
    for column, value in key.items():
        out = out.where(F.col(column) == value)
    return out


def processed_counts(processed: DataFrame) -> DataFrame:
    return processed.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("processed"))


def convergence(events: DataFrame, canonical: DataFrame, letters: DataFrame, queue: DataFrame) -> DataFrame:
    """Per tenant: events not accounted for by a canonical record or a dead letter, and backlogs."""

    def tally(df: DataFrame, name: str, when: Column | None = None) -> DataFrame:
        row = [F.lit(0).cast("bigint").alias(c) for c in names if c != name]
        hit = F.count(F.lit(1)) if when is None else F.count_if(when)
        return df.groupBy("tenant_id").agg(hit.alias(name)).select("tenant_id", name, *row)

    names = ["source", "pending", "canonical", "dead", "retrying"]
    rows = (
        tally(events, "source")
        .unionByName(tally(events, "pending", F.col("status") == "received"))
        .unionByName(tally(canonical, "canonical"))
        .unionByName(tally(letters, "dead"))
        .unionByName(tally(queue, "retrying"))
    )
    total = rows.groupBy("tenant_id").agg(*[F.sum(c).alias(c) for c in names])
    return total.withColumn("data_loss", F.greatest(F.lit(0), F.col("source") - F.col("canonical") - F.col("dead")))


#: Distinct keys (as a power of two) up to which a sketch is exact; it takes eight bytes for each at most.
SKETCH_POWER = 14


def key_sketches(df: DataFrame, at: str) -> DataFrame:
    """(tenant_id, day, keys): theta sketches of the event keys of each tenant and day. They are folded before the shuffle, can be
    stored, and merge with those of later runs. A repeated key counts once, one with a null part not at all."""
    key = F.concat(F.octet_length("source"), F.lit(":"), "source", "event_id")
    days = df.select("tenant_id", F.to_date(at).alias("day"), key.alias("key"))
    return days.groupBy("tenant_id", "day").agg(F.theta_sketch_agg("key", SKETCH_POWER).alias("keys"))


def unsettled_estimate(received: DataFrame, *settled: DataFrame) -> DataFrame:
    """Per tenant and day, from sketches alone: how many events were received, and how many of them neither an applied change nor a
    dead letter of any day accounts for. Exact while a tenant's sketches hold less than 2 ** SKETCH_POWER keys; beyond that the error of
    `received` is below two percent, that of `unsettled` relative to the settled keys. Rows of sketches are merged by tenant; no raw row is read."""
    days = received.groupBy("tenant_id", "day").agg(F.theta_union_agg("keys", SKETCH_POWER).alias("keys"))
    done = None
    for sketches in settled:
        rows = sketches.select("tenant_id", "keys")
        done = rows if done is None else done.unionByName(rows)
    count = F.theta_sketch_estimate("keys").alias("received")
    if done is None:
        return days.select("tenant_id", "day", count, F.theta_sketch_estimate("keys").alias("unsettled"))
    done = done.groupBy("tenant_id").agg(F.theta_union_agg("keys", SKETCH_POWER).alias("done"))
    rest = F.theta_sketch_estimate(F.theta_difference("keys", F.col("done")))
    left = F.when(F.col("done").isNull(), F.theta_sketch_estimate("keys")).otherwise(rest)
    return days.join(done, "tenant_id", "left").select("tenant_id", "day", count, left.alias("unsettled"))


def unsettled(events: DataFrame, *settled: DataFrame) -> DataFrame:
    """The keys themselves, once each: events that none of the other tables holds."""
    out = events.select(*EK).where(" AND ".join(f"{c} IS NOT NULL" for c in EK)).distinct()
    for df in settled:
        out = out.join(df.select(*EK), EK, "left_anti")
    return out


def duplicate_emails(records: DataFrame) -> DataFrame:
    """Destination records that share an email."""
    return records.groupBy("tenant_id", "email").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _copies(df: DataFrame, at: str, seconds: int) -> DataFrame:
    """Each row in its own time slice and, marked as context, in the following one. A trailing window
    no longer than a slice then only needs the rows of one (key, slice) group, which cuts a key that
    holds a large share of the data by time."""
    slice_ = F.floor(micros(F.col(at)) / F.lit(seconds * 1_000_000))
    copies = F.array(F.struct(slice_.alias("slice"), F.lit(False).alias("context")), F.struct((slice_ + 1).alias("slice"), F.lit(True).alias("context")))
    return df.select("*", F.explode(copies).alias("c")).select(*df.columns, "c.*")


def lockouts(attempts: DataFrame, limit: int = 5, minutes: int = 15) -> DataFrame:
    """Failed attempts at which the account has `limit` or more failures in the trailing window, where
    a success clears the failures before it."""
    rows = _copies(attempts.select("tenant_id", "email", "success", "attempted_at"), "attempted_at", minutes * 60)
    group = ["tenant_id", "email", "slice"]
    line = W.partitionBy(*group).orderBy("attempted_at").rangeBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("epoch", F.sum(F.when(F.col("success"), 1).otherwise(0)).over(line)).withColumn("us", micros(F.col("attempted_at")))
    span = W.partitionBy(*group, "epoch").orderBy("us").rangeBetween(-(minutes * 60_000_000 - 1), 0)
    counted = rows.withColumn("recent_failures", F.sum(F.when(F.col("success"), 0).otherwise(1)).over(span))
    return counted.where(~F.col("context") & ~F.col("success") & (F.col("recent_failures") >= limit)).select(
        "tenant_id", "email", "attempted_at", "recent_failures"
    )


def throttled(attempts: DataFrame, limit: int = 30, seconds: int = 60) -> DataFrame:
    """Per-address windows that open at the first attempt after the previous window ended, with the
    number of attempts and how many of them exceed the limit.

    Which attempts open a window depends on the whole chain before it. The chain is followed by
    doubling: every attempt time knows which attempt opens the window after its own, and each round
    doubles the length of the jumps, so n windows take log2(n) rounds.
    """
    us = micros(F.col("attempted_at"))
    times = attempts.groupBy("ip", "attempted_at").agg(F.count(F.lit(1)).alias("n")).select("ip", us.alias("us"), "attempted_at", "n")
    times = cut_lineage(times, "attempt-times")
    width = seconds * 1_000_000
    slice_ = F.floor(F.col("us") / F.lit(width))
    # Next opening: the first attempt at or after us + width. It is in the slice of us + width, or it
    # is the first attempt of the next slice that has any.
    firsts = times.groupBy("ip", slice_.alias("slice")).agg(F.min("us").alias("first"))
    later = firsts.select("ip", "slice", F.lead("first").over(W.partitionBy("ip").orderBy("slice")).alias("after"), "first")
    marks = times.select("ip", slice_.alias("slice"), F.col("us").alias("t"), F.col("us").alias("attempt"), F.lit(None).cast("bigint").alias("probe"))
    probes = times.select("ip", (slice_ + 1).alias("slice"), (F.col("us") + width).alias("t"), F.lit(None).cast("bigint").alias("attempt"), F.col("us").alias("probe"))
    # Latest first: a frame that begins with the partition is a running minimum, one that ends with it is worked out anew in each row.
    here = W.partitionBy("ip", "slice").orderBy(F.desc("t")).rangeBetween(W.unboundedPreceding, 0)
    inside = marks.unionByName(probes).withColumn("hit", F.min("attempt").over(here)).where("probe is not null")
    # When the probed slice is empty, its successor is the successor of the attempt's own slice.
    own = later.select("ip", (F.col("slice") + 1).alias("slice"), F.col("after").alias("own_after"))
    probed = later.select("ip", "slice", "after", F.lit(True).alias("filled"))
    hop = (
        inside.join(probed, ["ip", "slice"], "left")
        .join(own, ["ip", "slice"])
        .select("ip", F.col("probe").alias("us"), F.coalesce("hit", F.when(F.col("filled"), F.col("after")).otherwise(F.col("own_after"))).alias("to"))
    )
    hop = cut_lineage(hop.where("to is not null"), "hop")
    opened = cut_lineage(times.groupBy("ip").agg(F.min("us").alias("us")), "opened")
    count = opened.count()
    while True:
        ahead = opened.join(hop, ["ip", "us"]).select("ip", F.col("to").alias("us"))
        opened = cut_lineage(opened.unionByName(ahead).distinct(), "opened")
        grown = opened.count()
        if grown == count:
            break
        count = grown
        far = hop.select("ip", F.col("us").alias("to"), F.col("to").alias("far"))
        hop = cut_lineage(hop.join(far, ["ip", "to"]).select("ip", "us", F.col("far").alias("to")), "hop")
    # Every attempt belongs to the last opening at or before it, which lies in its slice or the one before.
    both = times.join(opened.withColumn("opens", F.lit(True)), ["ip", "us"], "left")
    spread = both.withColumn("slice", slice_).select("*", F.explode(F.array(F.struct(F.col("slice").alias("s"), F.lit(False).alias("context")), F.struct((F.col("slice") + 1).alias("s"), F.lit(True).alias("context")))).alias("c"))
    back = W.partitionBy("ip", "c.s").orderBy("us").rowsBetween(W.unboundedPreceding, 0)
    owned = spread.withColumn("opened_us", F.last(F.when(F.col("opens"), F.col("us")), ignorenulls=True).over(back)).where(~F.col("c.context"))
    n = F.sum("n")
    return owned.groupBy("ip", "opened_us").agg(
        F.min("attempted_at").alias("opened_at"), n.alias("attempts"), F.greatest(F.lit(0), n - limit).alias("refused")
    ).drop("opened_us")


def throttled_tumbling(attempts: DataFrame, limit: int = 30) -> DataFrame:
    """Approximation of `throttled` on calendar minutes."""
    return (
        attempts.groupBy("ip", F.window("attempted_at", "1 minute").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > limit)
        .select("ip", F.col("w.start").alias("minute"), (F.col("n") - limit).alias("refused"))
    )


def overview(tables: dict[str, DataFrame], tenant_id: str) -> dict[str, DataFrame]:
    """The operational overview: the newest rows of each table with the usual limits."""
    return {
        "conflicts": conflicts(tables["conflicts"], tenant_id, "CONFLICT_PENDING", 20),
        "runs": runs(tables["runs"], tenant_id, 5),
        "dead_letters": dead_letters(tables["dead_letter"], tenant_id, None, 20),
        "events": source_events(tables["source_events"], tenant_id, 10),
        "audit": audit(tables["audit_log"], tenant_id, limit=15),
        "operations": operations(tables["operations"], tenant_id, limit=15),
        "jobs": sync_jobs(tables["sync_jobs"], tenant_id, 10),
    }
