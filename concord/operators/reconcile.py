"""Reconciliation: compare a provider snapshot with canonical state, classify, gate and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import fingerprint, same_fields
from concord.functions.columns import blank, compose_id
from concord.functions.providers import denormalize, missing_field, normalize, provider
from concord.operators.identity import created_id
from concord.schemas import CK, CUSTOMER_DDL, DIRECTIONS, EVENT_PROVENANCE_DDL, FIELDS
from concord.session import numbered, small

FINDING_KEY = ["run_id", "kind", "provider_id"]


def provider_side(snapshot: DataFrame, source: str) -> DataFrame:
    """Live provider rows, normalized, with a validation error where a required field is missing.

    `snapshot` has tenant_id, id, source_version, deleted and data.
    """
    data = F.col("data")
    return snapshot.where(~F.col("deleted")).select(
        "tenant_id",
        F.col("id").alias("provider_id"),
        F.col("source_version").alias("provider_version"),
        missing_field(F.lit(source), data).alias("error"),
        normalize(F.lit(source), data).alias("provider_fields"),
    )


def canonical_side(canonical: DataFrame, source: str) -> DataFrame:
    """Canonical records that map an id at the provider."""
    pid = F.try_element_at("provider_ids", F.lit(source))
    return canonical.where(F.map_contains_key("provider_ids", source) & (pid != "")).select(
        "tenant_id",
        pid.alias("provider_id"),
        F.col("entity_id").alias("canonical_id"),
        F.col("fields").alias("canonical_fields"),
        "tombstone",
        F.coalesce(F.try_element_at("source_versions", F.lit(source)), F.lit(0)).alias("known_version"),
    )


def compare(snapshot: DataFrame, canonical: DataFrame, source: str) -> DataFrame:
    """Full outer comparison on (tenant, provider id): one shuffle, no per-record lookup.

    `kind` is drift / missed / deleted / missing, or null; `state` also tells in_sync, invalid and
    tombstoned rows apart. Deleted provider rows count as absent, invalid ones as present.
    """
    prov = provider_side(snapshot, source).withColumn("seen", F.lit(True))
    canon = canonical_side(canonical.where(F.col("entity_type") == provider(source).canonical_type), source).withColumn("known", F.lit(True))
    both = prov.join(canon, ["tenant_id", "provider_id"], "full_outer")
    seen, known = F.col("seen").isNotNull(), F.col("known").isNotNull()
    state = (
        F.when(seen & F.col("error").isNotNull(), "invalid")
        .when(seen & ~known, "missed")
        .when(seen & F.col("tombstone"), "deleted")
        .when(seen & ~same_fields(F.col("canonical_fields"), F.col("provider_fields")), "drift")
        .when(seen, "in_sync")
        .when(F.col("tombstone"), "tombstoned")
        .otherwise("missing")
    )
    return both.select(
        "tenant_id",
        F.lit(source).alias("source"),
        "provider_id",
        "canonical_id",
        F.when(known, F.col("canonical_fields")).alias("canonical_fields"),
        F.when(seen, F.col("provider_fields")).otherwise(F.col("canonical_fields")).alias("provider_fields"),
        F.when(seen, F.col("provider_version")).otherwise(F.col("known_version")).alias("provider_version"),
        state.alias("state"),
        F.when(state.isin("missed", "deleted", "drift", "missing"), state).alias("kind"),
    )


def direction_of(kind: Column) -> Column:
    return F.when(kind == "deleted", "delete").when(kind == "missed", "adopt_provider").otherwise("push_canonical")


def delete_policies(policies: DataFrame) -> DataFrame:
    """(tenant, source) -> delete policy: the first policy with it as source, else as destination."""
    on = policies.where("enabled")
    first = F.struct("created_at", "destination", "source")
    as_source = on.groupBy("tenant_id", "source").agg(F.min_by("delete_policy", first).alias("own"))
    as_target = on.groupBy("tenant_id", F.col("destination").alias("source")).agg(F.min_by("delete_policy", first).alias("other"))
    return as_source.join(as_target, ["tenant_id", "source"], "full_outer").select(
        "tenant_id", "source", F.coalesce("own", "other").alias("delete_policy")
    )


def repairable(kind: Column, policy: Column) -> Column:
    return F.when(kind == "deleted", policy == "propagate").when(kind == "missing", policy.isin("tombstone_only", "ignore")).otherwise(F.lit(True))


def gate_reason(kind: Column, policy: Column) -> Column:
    why = F.when(kind == "deleted", "deletes stay where they are").otherwise("the outside deletion stands")
    return F.concat(F.lit("delete_policy="), policy, F.lit(": "), why)


def findings(compared: DataFrame, policies: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Finding rows per run. In auto mode a finding the policy blocks is `skipped` with the reason;
    the others start `pending`. `runs` has run_id, tenant_id, source, mode."""
    head = runs.select("run_id", "tenant_id", "source", "mode")
    rows = (
        compared.where(F.col("kind").isNotNull())
        .join(small(head), ["tenant_id", "source"])
        .join(small(delete_policies(policies)), ["tenant_id", "source"], "left")
        .withColumn("delete_policy", F.coalesce("delete_policy", F.lit("propagate")))
    )
    blocked = (F.col("mode") == "auto") & ~repairable(F.col("kind"), F.col("delete_policy"))
    empty = F.struct(*[F.lit(None).cast("string").alias(n) for n in FIELDS]).cast(CUSTOMER_DDL)
    return rows.select(
        F.sha2(F.concat_ws("|", *FINDING_KEY), 256).alias("finding_id"),
        "run_id",
        "tenant_id",
        "kind",
        "provider_id",
        F.coalesce("canonical_id", F.lit("")).alias("canonical_id"),
        F.coalesce("canonical_fields", empty).alias("canonical_fields"),
        "provider_fields",
        F.coalesce("provider_version", F.lit(0)).cast("bigint").alias("provider_version"),
        direction_of(F.col("kind")).alias("direction"),
        F.when(blocked, "skipped").otherwise("pending").alias("status"),
        F.when(blocked, gate_reason(F.col("kind"), F.col("delete_policy"))).alias("error"),
        now.alias("created_at"),
        F.when(blocked, now).alias("applied_at"),
    )


def new_findings(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Findings not stored yet; a stored decision on the same key stands."""
    return found.join(stored.select(*FINDING_KEY), FINDING_KEY, "left_anti")


def run_counters(compared: DataFrame, stored: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run: provider rows swept, and findings by kind with `missing` counted as missed."""
    head = small(runs.select("run_id", "tenant_id", "source"))
    swept = (
        compared.where(F.col("state").isin("in_sync", "invalid", "missed", "deleted", "drift"))
        .groupBy("tenant_id", "source")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "invalid").alias("failed"))
    )
    kinds = stored.groupBy("run_id").agg(
        F.count_if(F.col("kind") == "drift").alias("drift"),
        F.count_if(F.col("kind").isin("missed", "missing")).alias("missed"),
        F.count_if(F.col("kind") == "deleted").alias("deleted"),
    )
    zero = {c: 0 for c in ("total", "failed", "drift", "missed", "deleted")}
    return swept.join(head, ["tenant_id", "source"], "right").join(kinds, "run_id", "left").fillna(zero)


# Run lifecycle -----------------------------------------------------------------------------------


def open_runs(requests: DataFrame, now: Column) -> DataFrame:
    """Run rows for {run_id, tenant_id, source, mode, job_id}; an unknown mode means auto."""
    return requests.select(
        "run_id", "tenant_id", F.lit("customer").alias("entity"), "source",
        F.when(F.col("mode") == "manual", "manual").otherwise("auto").alias("mode"),
        F.lit("running").alias("status"), "job_id",
        *[F.lit(0).cast("bigint").alias(c) for c in ("total", "drift", "missed", "deleted")],
        now.alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("finished_at"), F.lit(None).cast("string").alias("error"),
    )


def unfinished(runs: DataFrame) -> DataFrame:
    return runs.where(~F.col("status").isin("completed", "failed"))


def close_runs(runs: DataFrame, counted: DataFrame, now: Column, failure: Column | None = None) -> DataFrame:
    """Completed runs with their counters, or failed ones when a failure text is given."""
    n = counted.select("run_id", *[F.col(c).alias(f"n_{c}") for c in ("total", "drift", "missed", "deleted")], F.lit(True).alias("hit"))
    hit = F.col("hit").isNotNull() & ~F.col("status").isin("completed", "failed")
    text = failure if failure is not None else F.lit(None).cast("string")
    done = F.when(text.isNull(), "completed").otherwise("failed")
    return runs.join(n, "run_id", "left").select(
        *[
            {
                "status": F.when(hit, done).otherwise(F.col("status")),
                "finished_at": F.when(hit, now).otherwise(F.col("finished_at")),
                "error": F.when(hit, text).otherwise(F.col("error")),
                **{k: F.when(hit, F.col(f"n_{k}")).otherwise(F.col(k)) for k in ("total", "drift", "missed", "deleted")},
            }
            .get(c, F.col(c))
            .alias(c)
            for c in runs.columns
        ]
    )


# Repairs -----------------------------------------------------------------------------------------


def repair_events(found: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """One deterministic event per pending finding; the id makes a resumed run exactly-once."""
    src = runs.select("run_id", "source")
    fields = adopted_payload()
    prov = F.struct(*[F.lit(None).cast("string")] * 4, F.col("finding_id")).cast(EVENT_PROVENANCE_DDL)
    pending = found.where("status = 'pending'").drop("arrival_seq").join(small(src), "run_id")
    # Findings of one run apply by kind and provider id.
    return numbered(pending, "run_id", "kind", "provider_id").select(
        compose_id("reconcile", F.col("finding_id")).alias("event_id"),
        "tenant_id",
        "source",
        F.lit("customer").alias("entity_type"),
        F.col("provider_id").alias("entity_id"),
        F.lit("updated").alias("event_type"),
        F.col("provider_version").alias("source_version"),
        now.alias("occurred_at"),
        now.alias("received_at"),
        F.lit(None).cast("string").alias("correlation_id"),
        prov.alias("provenance"),
        F.struct(fields.alias("fields")).alias("payload"),
        "arrival_seq",
        F.lit(1).alias("delivery"),
    )


def adopted_payload() -> Column:
    """Provider fields of a finding under the provider's own names, as replay reads them."""
    return denormalize(F.col("source"), F.col("provider_fields"))


def delete_repairs(found: DataFrame, runs: DataFrame) -> DataFrame:
    """Change rows that push a delete to the provider."""
    return _repairs(found, runs, "delete").select(
        "tenant_id", F.lit("customer").alias("entity_type"), F.col("canonical_id").alias("entity_id"), "source", "finding_id",
        compose_id("reconcile", F.col("finding_id")).alias("event_id"), F.col("source").alias("target"), F.lit("delete").alias("op"),
        "provider_id", F.lit(None).cast("map<string,string>").alias("payload"), F.lit("").alias("fingerprint"), "provider_version",
    )


def push_repairs(found: DataFrame, runs: DataFrame, canonical: DataFrame) -> DataFrame:
    """Change rows that write canonical state back: missing records are created, others updated.

    A finding whose canonical record is gone gets op null (to be skipped).
    """
    rows = _repairs(found, runs, "push_canonical").withColumn("entity_type", F.lit("customer"))
    canon = canonical.select(*CK[:2], F.col("entity_id").alias("canonical_id"), F.col("fields").alias("now_fields"))
    both = rows.join(canon, ["tenant_id", "entity_type", "canonical_id"], "left")
    create = (F.col("kind") == "missing") | blank(F.col("provider_id"))
    gone = F.col("now_fields").isNull()
    return both.select(
        "tenant_id",
        "entity_type",
        F.col("canonical_id").alias("entity_id"),
        "source",
        "finding_id",
        compose_id("reconcile", F.col("finding_id")).alias("event_id"),
        F.col("source").alias("target"),
        F.when(~gone, F.when(create, "create").otherwise("update")).alias("op"),
        F.when(create, created_id(F.col("tenant_id"), F.col("entity_type"), F.col("canonical_id"), F.col("source")))
        .otherwise(F.col("provider_id"))
        .alias("provider_id"),
        F.when(~gone, denormalize(F.col("source"), F.col("now_fields"))).alias("payload"),
        F.when(~gone, fingerprint(F.col("now_fields"))).alias("fingerprint"),
        "provider_version",
    )


def adopt_events(found: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Events whose replay makes the provider's fields canonical and fans them out."""
    return repair_events(found.where("direction = 'adopt_provider'"), runs, now)


def _repairs(found: DataFrame, runs: DataFrame, direction: str) -> DataFrame:
    return found.where((F.col("status") == "pending") & (F.col("direction") == direction)).join(small(runs.select("run_id", "source")), "run_id")


def recreate_not_found(changes: DataFrame, results: DataFrame) -> DataFrame:
    """Updates the provider answered with NOT_FOUND become creates; deletes so answered are done."""
    kinds = results.select("tenant_id", "event_id", F.col("kind").alias("result"))
    both = changes.join(kinds, ["tenant_id", "event_id"])
    lost = (F.col("result") == "NOT_FOUND") & (F.col("op") == "update")
    return both.where(lost).select(
        *[
            {
                "op": F.lit("create"),
                "provider_id": created_id(F.col("tenant_id"), F.col("entity_type"), F.col("entity_id"), F.col("target")),
            }
            .get(c, F.col(c))
            .alias(c)
            for c in changes.columns
        ]
    )


def repair_outcomes(changes: DataFrame, results: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the provider's answers make of repairs: (findings, operations, outbound).

    `changes` are rows of `delete_repairs` or `push_repairs`, `results` {tenant_id, event_id, kind, message, new_version} with kind
    null for success; of repeated answers a success counts. Deleting what is gone already succeeds. A repair without a canonical
    record (op null) is skipped without an answer. Changes without an answer decide nothing, nor do updates answered with
    NOT_FOUND: `recreate_not_found` makes creates of them, whose answers are judged here in their turn.

    `findings` {finding_id, to, error} suits `set_finding_status`, `operations` are ledger rows, and `outbound` holds the
    fingerprints by which echoes of the pushes are known.
    """
    answer = F.struct("kind", "message", "new_version")
    best = F.struct(F.col("kind").isNotNull(), -F.coalesce("new_version", F.lit(0)), "kind", "message")
    answers = results.groupBy("tenant_id", "event_id").agg(F.min_by(answer, best).alias("answer"))
    kind, op = F.col("answer.kind"), F.col("op")
    lost = F.coalesce(kind == "NOT_FOUND", F.lit(False))
    state = (
        F.when(op.isNull(), "skipped")
        .when(F.col("answer").isNull() | (lost & (op == "update")), F.lit(None))
        .when(kind.isNull() | (lost & (op == "delete")), "applied")
        .otherwise("failed")
    )
    judged = changes.join(answers, ["tenant_id", "event_id"], "left").withColumn("to", state)
    error = F.when(F.col("to") == "skipped", "the canonical record is gone").when(F.col("to") == "failed", F.coalesce("answer.message", "answer.kind"))
    done = judged.where("to = 'applied'").withColumn("target_source", F.col("target"))
    operations = done.select(
        *CK, "source", "target_source", "event_id", F.col("provider_version").alias("applied_version"), "fingerprint", now.alias("created_at")
    )
    outbound = (
        done.where(op != "delete")
        .groupBy(*CK, "target_source")
        .agg(F.max_by(F.struct("fingerprint", F.col("answer.new_version").alias("applied_version")), F.struct("answer.new_version", "event_id")).alias("m"))
        .select(*CK, "target_source", "m.*")
    )
    return judged.where(F.col("to").isNotNull()).select("finding_id", "to", error.alias("error")), operations, outbound


def pushed_state(canonical: DataFrame, pushed: DataFrame, results: DataFrame) -> DataFrame:
    """Canonical rows after successful pushes: id mapping, reported version, one version step, live.

    `results` has tenant_id, event_id and new_version as reported by the provider.
    """
    done = (
        pushed.where(F.col("op").isNotNull())
        .join(results.select("tenant_id", "event_id", "new_version"), ["tenant_id", "event_id"])
        .groupBy(*CK)
        .agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("source", "provider_id", "new_version"), "event_id").alias("p"))
    )
    return canonical.join(done, CK).select(
        *[
            {
                "version": F.col("version") + F.col("n"),
                "provider_ids": _put("provider_ids", F.col("p.source"), F.col("p.provider_id")),
                "source_versions": _put("source_versions", F.col("p.source"), F.col("p.new_version")),
                "tombstone": F.lit(False),
            }
            .get(c, F.col(c))
            .alias(c)
            for c in canonical.columns
        ]
    )


def _put(name: str, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(name, lambda k, _: k != key), F.create_map(key, value))


def set_finding_status(stored: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Apply {finding_id, to, error}: pending findings take any state, failed ones only pending."""
    new = changes.groupBy("finding_id").agg(F.max_by(F.struct("to", "error"), "to").alias("n"))
    hit = F.col("n").isNotNull() & ((F.col("status") == "pending") | ((F.col("status") == "failed") & (F.col("n.to") == "pending")))
    return stored.join(new, "finding_id", "left").select(
        *[
            {
                "status": F.when(hit, F.col("n.to")).otherwise(F.col("status")),
                "error": F.when(hit, F.col("n.error")).otherwise(F.col("error")),
                "applied_at": F.when(hit, F.coalesce("applied_at", now)).otherwise(F.col("applied_at")),
            }
            .get(c, F.col(c))
            .alias(c)
            for c in stored.columns
        ]
    )


def decide_findings(stored: DataFrame, decisions: DataFrame) -> DataFrame:
    """Operator decisions {finding_id, action: apply|dismiss, direction, actor} with `problem` and
    the direction to use. Only pending findings can be decided; an override must be a known one."""
    both = decisions.withColumnRenamed("direction", "override").join(stored, "finding_id", "left")
    wanted = F.nullif(F.col("override"), F.lit(""))
    problem = (
        F.when(F.col("run_id").isNull(), "unknown finding")
        .when(F.col("status") != "pending", "already decided")
        .when(
            (F.col("action") == "apply") & wanted.isNotNull() & ~wanted.isin(*DIRECTIONS),
            "no such direction",
        )
    )
    return both.select(
        *[F.coalesce(F.when(F.col("action") == "apply", wanted), F.col("direction")).alias(c) if c == "direction" else F.col(c) for c in both.columns if c != "override"],
        problem.alias("problem"),
    )


def finding_audit(decided: DataFrame, now: Column) -> DataFrame:
    detail = F.when(F.col("action") == "apply", F.to_json(F.struct("run_id", "kind", "direction", "provider_id"))).otherwise(
        F.to_json(F.struct("run_id", "kind", "provider_id"))
    )
    return decided.where(F.col("problem").isNull()).select(
        "tenant_id", "actor", F.concat(F.lit("finding."), F.col("action")).alias("action"),
        F.lit("reconciliation_finding").alias("resource_type"), F.col("finding_id").alias("resource_id"), detail.alias("detail"), now.alias("created_at"),
    )
