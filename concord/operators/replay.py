"""Ordered replay of change events onto canonical records.

Order matters only inside a cluster (see `identity`), so the plan is: find clusters, bring the
events of a cluster together, and fold over them in arrival order with a Catalyst `aggregate`.

A cluster may hold any share of the data. Its events are therefore never gathered beyond
`chunk_rows`: larger clusters are range-partitioned by arrival into chunks, every chunk is folded
in parallel from an assumed start state, and chunks whose assumed start differs from their
predecessor's result are folded again until none differs. By induction over the chunks the fixed
point is the sequential result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.functions import conflict, fingerprint, let
from concord.functions.columns import blank
from concord.functions.providers import denormalize, provider_names
from concord.operators.identity import clusters, created_id, touched_records
from concord.operators.routing import first_deliveries, mark_duplicates, route, to_steps
from concord.schemas import (
    CK,
    CONFLICT_DDL,
    CUSTOMER_DDL,
    EK,
    FIELDS,
    NTZ,
    PROVENANCE_DDL,
    WRITE_DDL,
    WRITER_DDL,
)
from concord.session import cut_lineage

CHUNK_ROWS = 2_000
LEVELS = 3
PART_ROWS = 200_000
# Above this many oversized clusters the list is no longer worth broadcasting: chunk everything.
MAX_BROADCAST_CLUSTERS = 100_000
GROUP = ["tenant_id", "entity_type", "cluster"]
STEP_COLS = [
    "arrival_seq", "delivery", "event_id", "source", "pid", "kind", "version", "occurred_at", "received_at",
    "f", "fp", "strategy", "mode", "priority", "dests",
]


def _by_provider(value_type: str) -> str:
    return "struct<" + ",".join(f"{p}:{value_type}" for p in provider_names()) + ">"


def slot_ddl() -> str:
    """Replay state of one canonical record. Per-provider values are struct fields, so that states
    can be compared and ordered (maps cannot)."""
    return (
        f"struct<entity_id:string,f:{CUSTOMER_DDL},prov:{PROVENANCE_DDL},versions:{_by_provider('bigint')},"
        f"written:{_by_provider('string')},ids:{_by_provider('string')},tombstone:boolean,origin_source:string,"
        "origin_event_id:string,created_at:timestamp_ntz,created_seq:bigint,changes:bigint,fresh:boolean>"
    )


def log_ddl() -> str:
    return (
        "struct<arrival_seq:bigint,delivery:int,event_id:string,source:string,pid:string,kind:string,version:bigint,"
        f"occurred_at:timestamp_ntz,received_at:timestamp_ntz,entity_id:string,outcome:string,strategy:string,"
        f"conflicts:array<{CONFLICT_DDL}>,stored:{CUSTOMER_DDL},incoming:{CUSTOMER_DDL},result:{CUSTOMER_DDL},"
        f"fp:string,writes:array<{WRITE_DDL}>>"
    )


def _pick(values: Column, name: Column) -> Column:
    out: Column | None = None
    for p in provider_names():
        out = F.when(name == p, values[p]) if out is None else out.when(name == p, values[p])
    return out


def _per(build) -> Column:
    return F.struct(*[build(p).alias(p) for p in provider_names()])


def _find(slots: Column, e: Column) -> Column:
    """1-based position of the record this event reaches, 0 when there is none."""
    by_id = F.coalesce(
        F.array_position(
            F.transform(
                slots,
                lambda x: F.when(e["kind"] == "resolve", x["entity_id"] == e["pid"]).otherwise(
                    F.coalesce(_pick(x["ids"], e["source"]) == e["pid"], F.lit(False))
                ),
            ),
            F.lit(True),
        ),
        F.lit(0),
    )
    by_email = F.array_min(
        F.transform(
            slots,
            lambda x, i: F.when(
                ~x["tombstone"] & (x["f"]["email"] == e["f"]["email"]),
                F.struct(x["created_at"], x["created_seq"], (i + 1).cast("bigint").alias("pos")),
            ),
        )
    )["pos"]
    may_mail = ((e["kind"] == "upsert") & (e["f"]["email"] != "")) | (e["kind"] == "adopt")
    return F.when(by_id > 0, by_id).when(may_mail, F.coalesce(by_email, F.lit(0))).otherwise(F.lit(0)).cast("bigint")


def _outcome(at: Column, c: Column, e: Column, clashes: Column) -> Column:
    return (
        F.when(
            e["kind"] == "delete",
            F.when((at == 0) | c["tombstone"], F.lit("noop_delete")).otherwise(F.lit("deleted")),
        )
        .when(e["kind"] == "resolve", F.when(at == 0, F.lit("ignored")).otherwise(F.lit("resolved")))
        .when(e["kind"] == "adopt", F.lit("adopted"))
        .when(e["version"] <= F.coalesce(_pick(c["versions"], e["source"]), F.lit(0)), F.lit("stale"))
        .when(F.coalesce(_pick(c["written"], e["source"]) == e["fp"], F.lit(False)), F.lit("echo"))
        .when((F.size(clashes) > 0) & (e["mode"] == conflict.MANUAL), F.lit("parked"))
        .otherwise(F.lit("applied"))
    )


def _flags(outcome: Column) -> Column:
    """The outcome with what it implies, worked out once per event."""
    return let(
        outcome,
        lambda o: let(
            (o == "applied") | (o == "resolved") | (o == "adopted"),
            lambda w: F.struct(o.alias("name"), w.alias("writes"), (w | (o == "deleted")).alias("changes")),
        ),
    )


def _step(slots: Column, e: Column) -> Column:
    """One event applied to the records of its cluster: the new slots and the log entry."""

    def with_position(at: Column) -> Column:
        clash_slot = F.get(F.filter(slots, lambda x: x["entity_id"] == e["pid"]), F.lit(0))
        fresh = F.struct(
            e["pid"].alias("entity_id"),
            F.lit(None).cast(CUSTOMER_DDL).alias("f"),
            F.lit(None).cast(PROVENANCE_DDL).alias("prov"),
            F.lit(None).cast(_by_provider("bigint")).alias("versions"),
            clash_slot["written"].alias("written"),
            F.lit(None).cast(_by_provider("string")).alias("ids"),
            F.lit(False).alias("tombstone"),
            F.lit(None).cast("string").alias("origin_source"),
            F.lit(None).cast("string").alias("origin_event_id"),
            F.coalesce(clash_slot["created_at"], e["received_at"]).alias("created_at"),
            F.coalesce(clash_slot["created_seq"], e["arrival_seq"]).alias("created_seq"),
            F.lit(0).cast("bigint").alias("changes"),
            F.lit(True).alias("fresh"),
        ).cast(slot_ddl())
        return let(F.when(at > 0, F.get(slots, (at - 1).cast("int"))).otherwise(fresh), lambda c: with_slot(at, c))

    def with_slot(at: Column, c: Column) -> Column:
        found = F.when(
            e["kind"] == "upsert",
            conflict.detect(c["f"], c["prov"], e["f"], e["source"], e["version"], e["occurred_at"], e["priority"]),
        ).otherwise(F.expr(f"cast(array() as array<{CONFLICT_DDL}>)"))
        return let(
            found,
            lambda clashes: let(_flags(_outcome(at, c, e, clashes)), lambda outcome: with_outcome(at, c, clashes, outcome)),
        )

    def with_outcome(at: Column, c: Column, clashes: Column, outcome: Column) -> Column:
        forced = (e["kind"] == "resolve") | (e["kind"] == "adopt")
        takes = F.struct(
            *[
                (
                    forced
                    | conflict.takes_incoming(
                        n, e["mode"], c["f"], c["prov"], e["f"], e["source"], e["occurred_at"], e["priority"]
                    )
                ).alias(n)
                for n in FIELDS
            ]
        )
        return let(
            takes,
            lambda t: let(
                conflict.merge_fields(c["f"], e["f"], t), lambda f: with_fields(at, c, clashes, outcome, t, f)
            ),
        )

    def with_fields(at: Column, c: Column, clashes: Column, outcome: Column, t: Column, f: Column) -> Column:
        writes, changes = outcome["writes"], outcome["changes"]
        outcome = outcome["name"]
        fp = F.when(F.size(clashes) == 0, e["fp"]).otherwise(fingerprint(f))

        def priority(n: str) -> Column:
            return (
                F.when(e["kind"] == "resolve", F.coalesce(c["prov"][n]["priority"], F.lit(100)))
                .when(e["kind"] == "adopt", F.lit(100))
                .otherwise(e["priority"])
                .cast("int")
            )

        links = (e["kind"] == "upsert") | (e["kind"] == "adopt")

        def with_fingerprint(fp: Column) -> Column:
            linked = _per(
                lambda p: F.when(links & (e["source"] == p), e["pid"]).otherwise(c["ids"][p])
            )
            return let(linked, lambda ids: finish(fp, ids))

        def targets(p: str) -> Column:
            return writes & F.exists(e["dests"], lambda d: d["target"] == p)

        def new_id(p) -> Column:
            return created_id(F.col("tenant_id"), F.col("entity_type"), c["entity_id"], p)

        def finish(fp: Column, ids: Column) -> Column:
            slot = F.struct(
                c["entity_id"].alias("entity_id"),
                F.when(writes, f).otherwise(c["f"]).alias("f"),
                F.when(
                    writes,
                    conflict.merge_provenance(c["prov"], t, e["source"], e["version"], e["occurred_at"], priority),
                )
                .otherwise(c["prov"])
                .alias("prov"),
                _per(lambda p: F.when(changes & (e["source"] == p), e["version"]).otherwise(c["versions"][p])).alias("versions"),
                _per(lambda p: F.when(targets(p), fp).otherwise(c["written"][p])).alias("written"),
                _per(lambda p: F.when(targets(p) & blank(ids[p]), new_id(p)).otherwise(ids[p])).alias("ids"),
                F.when(writes, F.lit(False)).when(outcome == "deleted", F.lit(True)).otherwise(c["tombstone"]).alias("tombstone"),
                F.when(changes, e["source"]).otherwise(c["origin_source"]).alias("origin_source"),
                F.when(changes, e["event_id"]).otherwise(c["origin_event_id"]).alias("origin_event_id"),
                c["created_at"].alias("created_at"),
                c["created_seq"].alias("created_seq"),
                (c["changes"] + F.when(changes, F.lit(1)).otherwise(F.lit(0))).cast("bigint").alias("changes"),
                c["fresh"].alias("fresh"),
            ).cast(slot_ddl())
            return let(slot, lambda slot: yield_(fp, ids, slot))

        def yield_(fp: Column, ids: Column, slot: Column) -> Column:
            kept = (
                F.when((at == 1) & (F.size(slots) == 1), F.array(slot))
                .when(at > 0, F.transform(slots, lambda x, i: F.when(i == at - 1, slot).otherwise(x)))
                .when(writes, F.concat(F.filter(slots, lambda x: x["entity_id"] != e["pid"]), F.array(slot)))
                .otherwise(slots)
            )
            sent = (
                F.when(
                    writes,
                    F.transform(
                        e["dests"],
                        lambda d: F.struct(
                            d["target"].alias("target"),
                            F.when(blank(_pick(ids, d["target"])), F.lit("create")).otherwise(F.lit("update")).alias("op"),
                            F.coalesce(F.nullif(_pick(ids, d["target"]), F.lit("")), new_id(d["target"])).alias("provider_id"),
                        ),
                    ),
                )
                .when(
                    outcome == "deleted",
                    F.transform(
                        F.filter(
                            e["dests"],
                            lambda d: (d["delete_policy"] == "propagate") & ~blank(_pick(ids, d["target"])),
                        ),
                        lambda d: F.struct(
                            d["target"].alias("target"), F.lit("delete").alias("op"), _pick(ids, d["target"]).alias("provider_id")
                        ),
                    ),
                )
                .otherwise(F.expr(f"cast(array() as array<{WRITE_DDL}>)"))
            )
            # Stale and echoed events are dropped before conflicts are looked at.
            disputed = (F.size(clashes) > 0) & ((outcome == "applied") | (outcome == "parked"))
            entry = F.struct(
                e["arrival_seq"], e["delivery"], e["event_id"], e["source"], e["pid"], e["kind"], e["version"],
                e["occurred_at"], e["received_at"],
                F.when((at > 0) | writes, c["entity_id"]).alias("entity_id"),
                outcome.alias("outcome"),
                e["strategy"],
                F.when(disputed, clashes).otherwise(F.expr(f"cast(array() as array<{CONFLICT_DDL}>)")).alias("conflicts"),
                F.when(disputed, c["f"]).alias("stored"),
                F.when(disputed, e["f"]).alias("incoming"),
                F.when(writes, f).alias("result"),
                F.when(writes, fp).alias("fp"),
                sent.alias("writes"),
            ).cast(log_ddl())
            return F.struct(kept.alias("slots"), entry.alias("entry"))

        return let(fp, with_fingerprint)

    return let(_find(slots, e), with_position)


def fold(groups: DataFrame) -> DataFrame:
    """`groups` has GROUP, `slots` (start state) and `steps` (sorted). Adds `out.slots` and `out.log`."""
    return groups.withColumn("out", _fold_expr(groups.sparkSession.sparkContext.applicationId, tuple(provider_names())))


@lru_cache(maxsize=4)
def _fold_expr(_application: str, _providers: tuple[str, ...]) -> Column:
    """The fold as one expression. It only names columns, so it is built once per application."""
    no_log = F.expr(f"cast(array() as array<{log_ddl()}>)")

    # An aggregate copies its state at every element, so a growing log must not be part of a long
    # one: the steps are taken in slices of slices, LEVELS deep, each with as many parts as the next, and only whole
    # slices are added to the collected log. A step thus copies LEVELS * n ** (1 / LEVELS) / 2 entries. For
    # the same reason a step yields its own entry, which joins the slice's log as the next one starts.
    def grown(s: Column) -> Column:
        return F.when(s["last"]["entry"].isNull(), s["log"]).otherwise(F.concat(s["log"], F.array(s["last"]["entry"])))

    def slice_(slots: Column, steps: Column) -> Column:
        zero = F.struct(
            F.struct(slots.alias("slots"), F.lit(None).cast(log_ddl()).alias("entry")).alias("last"), no_log.alias("log")
        )
        return F.aggregate(
            steps,
            zero,
            lambda s, e: F.struct(_step(s["last"]["slots"], e).alias("last"), grown(s).alias("log")),
            lambda s: F.struct(s["last"]["slots"].alias("slots"), grown(s).alias("log")),
        )

    def sliced(slots: Column, steps: Column, width: Column, level: int) -> Column:
        if level == 0:
            return slice_(slots, steps)
        size = F.lit(1)
        for _ in range(level):
            size = size * width
        return F.aggregate(
            F.sequence(F.lit(1), F.size(steps), size),
            F.struct(slots.alias("slots"), no_log.alias("log")),
            lambda s, at: let(
                sliced(s["slots"], F.slice(steps, at, size), width, level - 1),
                lambda done: F.struct(done["slots"].alias("slots"), F.concat(s["log"], done["log"]).alias("log")),
            ),
        )

    width = F.ceil(F.pow(F.size("steps"), F.lit(1 / LEVELS))).cast("int")
    return let(width, lambda width: sliced(F.col("slots"), F.col("steps"), width, LEVELS - 1))


def to_slots(canonical: DataFrame, outbound: DataFrame | None) -> DataFrame:
    """Stored records as replay slots: (tenant, entity_type, entity_id, slot)."""
    if outbound is None:
        out = canonical.withColumn("w", F.lit(None).cast("map<string,string>"))
    else:
        last = outbound.groupBy(*CK).agg(
            F.map_from_entries(F.collect_list(F.struct("target_source", "fingerprint"))).alias("w")  # one entry per provider
        )
        out = canonical.join(last, CK, "left")

    def writer(n: str) -> Column:
        return F.try_element_at(F.col("field_provenance"), F.lit(n))

    slot = F.struct(
        F.col("entity_id"),
        F.col("fields").alias("f"),
        F.struct(*[writer(n).alias(n) for n in FIELDS]).alias("prov"),
        _per(lambda p: F.try_element_at(F.col("source_versions"), F.lit(p))).alias("versions"),
        _per(lambda p: F.try_element_at(F.col("w"), F.lit(p))).alias("written"),
        _per(lambda p: F.try_element_at(F.col("provider_ids"), F.lit(p))).alias("ids"),
        F.col("tombstone"),
        F.col("origin_source"),
        F.col("origin_event_id"),
        F.col("created_at"),
        F.lit(-1).cast("bigint").alias("created_seq"),
        F.lit(0).cast("bigint").alias("changes"),
        F.lit(False).alias("fresh"),
    ).cast(slot_ddl())
    return out.select(*CK, slot.alias("slot"))


def _start_states(slots: DataFrame, labels: DataFrame) -> DataFrame:
    lab = labels.withColumnRenamed("id", "entity_id")
    return (
        slots.join(lab, CK, "left")
        .groupBy("tenant_id", "entity_type", F.coalesce("cluster", "entity_id").alias("cluster"))
        .agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    )


def _step_struct() -> Column:
    return F.struct(*STEP_COLS)


def _no_slots() -> Column:
    return F.expr(f"cast(array() as array<{slot_ddl()}>)")


def _fold_whole(steps: DataFrame, start: DataFrame) -> DataFrame:
    grouped = steps.groupBy(*GROUP).agg(F.sort_array(F.collect_list(_step_struct())).alias("steps"))
    grouped = grouped.join(start, GROUP, "left").withColumn("slots", F.coalesce("slots", _no_slots()))
    return fold(grouped).select(*GROUP, F.lit(0).alias("part"), F.lit(0).alias("chunk"), "out.slots", "out.log")


def _comparable(slots: Column) -> Column:
    """State as the next chunk sees it: without the change counter of the chunk that made it."""
    return F.sort_array(
        F.transform(slots, lambda x: x.withField("changes", F.lit(0).cast("bigint")).withField("fresh", F.lit(False)))
    )


def _components(slot: Column) -> dict[str, Column]:
    """The parts of a record state that are written independently of each other."""
    parts = {f"f_{n}": F.struct(slot["f"][n].alias("value"), slot["prov"][n].alias("writer")) for n in FIELDS}
    for name in ("versions", "written", "ids"):
        parts.update({f"{name}_{p}": F.struct(slot[name][p].alias("value")) for p in provider_names()})
    parts["tombstone"] = F.struct(slot["tombstone"].alias("value"))
    parts["origin"] = F.struct(slot["origin_source"].alias("source"), slot["origin_event_id"].alias("event_id"))
    parts["created"] = F.struct(slot["created_at"].alias("at"), slot["created_seq"].alias("seq"))
    return parts


def _assemble(entity_id: Column, parts: dict[str, Column]) -> Column:
    """Inverse of `_components`."""

    def providers(name: str) -> Column:
        return _per(lambda p: parts[f"{name}_{p}"]["value"]).alias(name)

    return F.struct(
        entity_id.alias("entity_id"),
        F.struct(*[parts[f"f_{n}"]["value"].alias(n) for n in FIELDS]).alias("f"),
        F.struct(*[parts[f"f_{n}"]["writer"].alias(n) for n in FIELDS]).alias("prov"),
        providers("versions"),
        providers("written"),
        providers("ids"),
        parts["tombstone"]["value"].alias("tombstone"),
        parts["origin"]["source"].alias("origin_source"),
        parts["origin"]["event_id"].alias("origin_event_id"),
        parts["created"]["at"].alias("created_at"),
        parts["created"]["seq"].alias("created_seq"),
        F.lit(0).cast("bigint").alias("changes"),
        F.lit(False).alias("fresh"),
    ).cast(slot_ddl())


def _wanted_starts(done: DataFrame) -> DataFrame:
    """The state each chunk must start from, given what the chunks before it produced.

    Per component, a chunk either wrote it (its result differs from what it was given) or passed it
    through; the wanted value is the last one written before. Facts such as a version set a million
    chunks earlier thus arrive in one round. Input is one small row per chunk and record.
    """
    key = [*GROUP, "part", "chunk"]
    states = done.select(*key, "start", "given", _comparable(F.col("made")).alias("made"))
    names = (
        states.select(*GROUP, F.explode(F.transform(F.concat("start", "made"), lambda x: x["entity_id"])).alias("entity_id")).distinct()
    )

    def slot_of(array: str) -> Column:
        return F.get(F.filter(array, lambda x: x["entity_id"] == F.col("entity_id")), F.lit(0)).alias(array)

    rows = states.join(names, GROUP).select(*key, "entity_id", slot_of("start"), slot_of("given"), slot_of("made"))
    before = W.partitionBy(*GROUP, "entity_id").orderBy("part", "chunk").rowsBetween(W.unboundedPreceding, -1)
    given, made, start = (_components(F.col(c)) for c in ("given", "made", "start"))
    born = F.col("given").isNull() & F.col("made").isNotNull()
    latest = {
        n: F.coalesce(
            F.last(F.when(born | ~made[n].eqNullSafe(given[n]), made[n]), ignorenulls=True).over(before),
            start[n],
        ).alias(n)
        for n in made
    }
    present = (F.coalesce(F.max(born).over(before), F.lit(False)) | F.col("start").isNotNull()).alias("present")
    return (
        rows.select(*key, "entity_id", present, *latest.values())
        .where("present")
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list(_assemble(F.col("entity_id"), {n: F.col(n) for n in made}))).alias("wanted"))
    )


def _chunks(steps: DataFrame, chunk_rows: int, rows: int) -> DataFrame:
    """Cut oversized clusters into runs of at most `chunk_rows` consecutive events.

    Range partitioning on (cluster, arrival) splits a hot cluster over many partitions because its
    rows differ in arrival; after the local sort the generated row id gives the position.
    """
    spark = steps.sparkSession
    # AQE may not merge or split these partitions (their ids are used), so size them by the row count.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // PART_ROWS + 1)
    order = [*GROUP, "arrival_seq", "delivery", "event_id", "source"]
    ordered = steps.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id()
    placed = ordered.withColumn("part", F.shiftright(row, 33).cast("int")).withColumn(
        "chunk", F.floor(row.bitwiseAND((1 << 33) - 1) / F.lit(chunk_rows)).cast("int")
    )
    # The row ids are only valid for this very partitioning, so pin them before any regrouping.
    placed = cut_lineage(placed, "placed")
    return placed.groupBy(*GROUP, "part", "chunk").agg(F.sort_array(F.collect_list(_step_struct())).alias("steps"))


def _fold_chunked(steps: DataFrame, start: DataFrame, chunk_rows: int, rows: int) -> DataFrame:
    key = [*GROUP, "part", "chunk"]
    pieces = cut_lineage(_chunks(steps, chunk_rows, rows), "chunks")
    keys = pieces.select(*key)
    first = cut_lineage(keys.join(start, GROUP, "left").select(*key, F.coalesce("slots", _no_slots()).alias("start")), "starts")
    assumed = first.withColumn("slots", F.col("start"))
    made = cut_lineage(fold(pieces.join(assumed, key)).select(*key, F.col("slots").alias("given"), "out"), "folded")
    folds = made.select(*key, F.lit(0).alias("round"), "out.slots", "out.log")
    # Rounds compare states alone; the logs stay where they were written and are read once, at the end.
    states = made.select(*key, "given", F.col("out.slots").alias("made"), F.lit(0).alias("round"))
    rounds = 0
    while True:
        done = states.join(first, key)
        wanted = done.select(*key, "given").join(_wanted_starts(done), key, "left").select(
            *key, "given", F.coalesce("wanted", _no_slots()).alias("wanted")
        )
        stale = cut_lineage(
            wanted.where(~F.col("wanted").eqNullSafe(F.sort_array("given"))).select(*key, F.col("wanted").alias("slots")), "stale"
        )
        if stale.limit(1).count() == 0:
            break
        rounds += 1
        made = cut_lineage(fold(pieces.join(stale, key)).select(*key, F.col("slots").alias("given"), "out"), "folded")
        folds = folds.unionByName(made.select(*key, F.lit(rounds).alias("round"), "out.slots", "out.log"))
        redone = made.select(*key, "given", F.col("out.slots").alias("made"), F.lit(rounds).alias("round"))
        states = cut_lineage(states.join(stale.select(*key), key, "left_anti").unionByName(redone), "states")
    if rounds:
        folds = folds.join(states.select(*key, "round"), [*key, "round"], "left_semi")
    return folds.select(*key, "slots", "log")


@dataclass
class Replay:
    """Everything one replay decides. All frames are lazy views of one stored fold."""

    outcomes: DataFrame  # one row per delivery
    canonical: DataFrame  # new state of every touched record
    changes: DataFrame  # rows to send to destinations
    outbound: DataFrame  # last fingerprint per (record, target)
    operations: DataFrame  # ledger rows
    conflicts: DataFrame  # conflict records, first per key
    claims: DataFrame  # event keys to remember as processed
    failures: DataFrame  # failed events with kind and message
    observations: DataFrame  # one row per delivery for the counters


def replay(
    events: DataFrame,
    canonical: DataFrame,
    policies: DataFrame,
    outbound: DataFrame | None = None,
    processed: DataFrame | None = None,
    connections: DataFrame | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> Replay:
    """Apply `events` (EVENT schema) to `canonical` (CANONICAL schema) under `policies`."""
    routed = cut_lineage(route(events, policies, connections), "routed")
    blocked = routed.where(F.col("static_outcome").isNotNull())
    open_ = routed.where(F.col("static_outcome").isNull())
    fresh = open_ if processed is None else open_.join(processed.select(*EK), EK, "left_anti")
    steps = cut_lineage(to_steps(first_deliveries(fresh)), "steps")

    touched = cut_lineage(touched_records(steps, canonical), "touched")
    labels = clusters(steps, touched)
    steps = steps.join(labels.withColumnRenamed("id", "pid"), ["tenant_id", "entity_type", "pid"], "left").withColumn(
        "cluster", F.coalesce("cluster", "pid")
    )
    start = _start_states(to_slots(touched, outbound), labels)

    sizes = steps.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("events")).where(F.col("events") > chunk_rows)
    big = cut_lineage(sizes, "oversized")
    found = big.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("events"), F.lit(0)).alias("events")).first()
    if found.n == 0:
        folded = _fold_whole(steps, start)
    elif found.n <= MAX_BROADCAST_CLUSTERS:
        keys = F.broadcast(big.select(*GROUP))
        folded = _fold_whole(steps.join(keys, GROUP, "left_anti"), start).unionByName(
            _fold_chunked(steps.join(keys, GROUP, "left_semi"), start, chunk_rows, found.events)
        )
    else:
        folded = _fold_chunked(steps, start, chunk_rows, steps.count())
    folded = cut_lineage(folded, "replayed")
    return _results(folded, routed, blocked, open_, touched, processed)


def _event_columns() -> list[Column]:
    """The event as it was delivered, for a later retry."""
    plain = ["event_id", "tenant_id", "source", "entity_id", "event_type", "source_version", "occurred_at", "received_at", "correlation_id", "provenance", "payload"]
    return [F.col("provider_entity_type").alias("entity_type"), *[F.col(c) for c in plain], F.col("arrival_seq")]


def _results(folded: DataFrame, routed: DataFrame, blocked: DataFrame, open_: DataFrame, touched: DataFrame, processed) -> Replay:
    log = folded.select("tenant_id", "entity_type", F.explode("log").alias("l")).select("tenant_id", "entity_type", "l.*")
    order = ["arrival_seq", "delivery"]

    decided = log.select(*EK, *order, "entity_id", "outcome")
    marked = mark_duplicates(open_.select(*EK, *order, "received_at"), processed).where("duplicate")
    repeats = marked.select(*EK, *order, F.lit(None).cast("string").alias("entity_id"), F.lit("duplicate").alias("outcome"))
    static = blocked.select(*EK, *order, F.lit(None).cast("string").alias("entity_id"), F.col("static_outcome").alias("outcome"))
    outcomes = decided.unionByName(repeats).unionByName(static)

    zero, none = F.lit(0), F.lit(None).cast("string")
    observations = (
        log.select("source", "outcome", F.col("received_at").alias("at"), F.size("writes").alias("n_writes"), F.size("conflicts").alias("n_conflicts"), none.alias("kind"))
        .unionByName(marked.select("source", F.lit("duplicate").alias("outcome"), F.col("received_at").alias("at"), zero.alias("n_writes"), zero.alias("n_conflicts"), none.alias("kind")))
        .unionByName(
            blocked.select("source", F.col("static_outcome").alias("outcome"), F.col("received_at").alias("at"), zero.alias("n_writes"), zero.alias("n_conflicts"), F.col("error.kind").alias("kind"))
        )
    )

    sent = log.where(F.size("writes") > 0).select("*", F.posexplode("writes").alias("pos", "w"))
    changes = sent.select(
        *CK,
        "source",
        "event_id",
        "arrival_seq",
        F.col("w.target").alias("target"),
        F.col("w.op").alias("op"),
        F.col("w.provider_id").alias("provider_id"),
        F.when(F.col("w.op") != "delete", denormalize(F.col("w.target"), F.col("result"))).alias("payload"),
    )
    operations = sent.select(
        *CK,
        "source",
        F.col("w.target").alias("target_source"),
        "event_id",
        F.col("version").alias("applied_version"),
        F.coalesce("fp", F.lit("")).alias("fingerprint"),
        F.col("received_at").alias("created_at"),
    )
    upserts = sent.where(F.col("w.op") != "delete")
    outbound = (
        upserts.groupBy(*CK, F.col("w.target").alias("target_source"))
        .agg(
            F.max_by(
                F.struct("fp", F.when(F.col("kind") == "upsert", F.col("version")).otherwise(F.lit(0)).alias("version")),
                F.struct(*order, "event_id"),
            ).alias("m")
        )
        .select(*CK, "target_source", F.col("m.fp").alias("fingerprint"), F.col("m.version").cast("bigint").alias("applied_version"))
    )
    return Replay(
        outcomes=outcomes,
        canonical=_states(folded, touched),
        changes=changes,
        outbound=outbound,
        operations=operations,
        conflicts=conflict_records(log),
        claims=log.select(*EK, "entity_type", F.col("pid").alias("entity_id"), F.col("received_at").alias("processed_at")),
        failures=blocked.where(F.col("static_outcome") == "failed").select(
            *EK, *order, "error.kind", "error.message", F.to_json(F.struct(*_event_columns())).alias("state")
        ),
        observations=observations,
    )


def _states(folded: DataFrame, touched: DataFrame) -> DataFrame:
    """Final record states. The change counter is additive, so it is summed over the chunks since
    the record was last (re)created, on top of the stored version if it never was."""
    at = F.struct("part", "chunk")
    rows = folded.select("tenant_id", "entity_type", at.alias("at"), F.explode("slots").alias("slot")).select(
        "tenant_id", "entity_type", F.col("slot.entity_id").alias("entity_id"), "at", "slot"
    )
    last = rows.groupBy(*CK).agg(
        F.max_by("slot", "at").alias("slot"),
        F.max(F.when(F.col("slot.fresh"), F.col("at"))).alias("reborn"),
    )
    added = (
        rows.select(*CK, "at", F.col("slot.changes").alias("n"))
        .join(last.select(*CK, "reborn"), CK)
        .groupBy(*CK)
        .agg(F.sum(F.when(F.col("reborn").isNull() | (F.col("at") >= F.col("reborn")), F.col("n"))).alias("n"))
    )
    before = touched.select(*CK, F.col("version").alias("before"), _entries("provider_ids").alias("ids_before"))
    s = F.col("slot")

    def as_map(values: Column, ddl: str) -> Column:
        pairs = F.array(*[F.struct(F.lit(p).alias("k"), values[p].alias("v")) for p in provider_names()])
        return F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull())).cast(ddl)

    writers = F.array(*[F.struct(F.lit(n).alias("k"), s["prov"][n].alias("v")) for n in FIELDS])
    version = F.coalesce("n", F.lit(0)) + F.when(F.col("reborn").isNull(), F.coalesce("before", F.lit(0))).otherwise(F.lit(0))
    return (
        last.join(added, CK)
        .join(before, CK, "left")
        # Records that were only within reach stay out: neither changed nor newly linked.
        .withColumn("ids_now", _entries(as_map(s["ids"], "map<string,string>")))
        .where((F.col("n") > 0) | ~F.col("ids_now").eqNullSafe(F.col("ids_before")))
        .select(
            *CK,
            s["f"].alias("fields"),
            version.cast("bigint").alias("version"),
            as_map(s["versions"], "map<string,bigint>").alias("source_versions"),
            as_map(s["ids"], "map<string,string>").alias("provider_ids"),
            F.map_from_entries(F.filter(writers, lambda x: x["v"]["source"].isNotNull())).cast(f"map<string,{WRITER_DDL}>").alias("field_provenance"),
            s["tombstone"].alias("tombstone"),
            s["origin_source"].alias("origin_source"),
            s["origin_event_id"].alias("origin_event_id"),
            s["created_at"].alias("created_at"),
        )
    )


def _entries(mapping) -> Column:
    """A map in comparable form."""
    return F.sort_array(F.map_entries(mapping))


def conflict_records(log: DataFrame) -> DataFrame:
    """One record per event with clashes, built from the first clashing field; the first record of a
    conflict key stands."""
    first = F.get("conflicts", F.lit(0))
    rows = log.where(F.size("conflicts") > 0).select(
        "tenant_id",
        "entity_type",
        "entity_id",
        first["source_a"].alias("source_a"),
        first["version_a"].alias("version_a"),
        F.to_json("stored").alias("payload_a"),
        first["source_b"].alias("source_b"),
        first["version_b"].alias("version_b"),
        F.to_json("incoming").alias("payload_b"),
        F.col("received_at").alias("detected_at"),
        F.when(F.col("outcome") == "parked", "CONFLICT_PENDING").otherwise("AUTO_RESOLVED").alias("status"),
        F.col("strategy").alias("resolution_strategy"),
        "arrival_seq",
        "delivery",
        "event_id",
    )
    key = ["tenant_id", "entity_type", "entity_id", "source_a", "source_b", "version_a", "version_b"]
    rest = [c for c in rows.columns if c not in key]
    return (
        rows.groupBy(*key)
        .agg(F.min_by(F.struct(*rest), F.struct("arrival_seq", "delivery", "event_id")).alias("r"))
        .select(F.sha2(F.concat_ws("|", *key), 256).alias("conflict_id"), *key, "r.*")
        .drop("arrival_seq", "delivery", "event_id")
    )
