"""Which events can touch the same canonical record, found before events are partitioned.

An event reaches a record by provider id or by email, so two events may depend on each other even
though their keys differ. Records that share an id or an email (in this batch or in stored state)
form one *cluster*; replay is sequential inside a cluster and parallel across clusters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.functions.providers import provider_names
from concord.session import cut_lineage

SCOPE = ["tenant_id", "entity_type"]


def created_id(tenant: Column, entity_type: Column, entity_id: Column, target: Column | str) -> Column:
    """Deterministic id of the record a create makes at a destination."""
    target = F.lit(target) if isinstance(target, str) else target
    return F.concat(target, F.lit("-"), F.substring(F.sha2(F.concat_ws(":", tenant, entity_type, entity_id, target), 256), 1, 24))


def provider_links(canonical: DataFrame) -> DataFrame:
    """(tenant, entity_type, provider, provider_id) -> entity_id, one row per mapped id."""
    return canonical.select(*SCOPE, "entity_id", "tombstone", F.explode("provider_ids").alias("provider", "provider_id"))


def live_by_email(canonical: DataFrame) -> DataFrame:
    """Oldest live record per exact email."""
    return (
        canonical.where(~F.col("tombstone") & (F.col("fields.email") != ""))
        .groupBy(*SCOPE, F.col("fields.email").alias("email"))
        .agg(F.min(F.struct("created_at", "entity_id")).alias("m"))
        .select(*SCOPE, "email", F.col("m.entity_id").alias("entity_id"))
    )


def resolve_once(events: DataFrame, canonical: DataFrame) -> DataFrame:
    """One-step resolution against stored state: by provider id, else by email, else a new record.

    `events` needs tenant_id, entity_type, source, provider_id and email. Both joins are equi-joins
    on the lookup key, with at most one match per event.
    """
    links = provider_links(canonical).select(
        *SCOPE, F.col("provider").alias("source"), "provider_id", F.col("entity_id").alias("by_id")
    )
    mail = live_by_email(canonical).withColumnRenamed("entity_id", "by_email")
    out = events.join(links, [*SCOPE, "source", "provider_id"], "left").join(mail, [*SCOPE, "email"], "left")
    return out.select(
        *events.columns,
        F.coalesce("by_id", "by_email", "provider_id").alias("entity_id"),
        F.when(F.col("by_id").isNotNull(), "provider_id").when(F.col("by_email").isNotNull(), "email").otherwise("new").alias("matched_by"),
    )


def _memberships(events: DataFrame, touched: DataFrame) -> DataFrame:
    """(scope, id, hub): which record ids hang on which emails or stored records."""
    mail = events.where(F.col("f.email") != "").select(*SCOPE, F.col("pid").alias("id"), F.concat(F.lit("e:"), "f.email").alias("hub"))
    # A destination may already report on the record we create there in this very batch.
    derived = (
        events.where(F.col("kind") != "delete")
        .select(*SCOPE, "pid")
        .distinct()
        .select(
            *SCOPE,
            F.col("pid").alias("owner"),
            F.explode(
                F.array(*[created_id(F.col("tenant_id"), F.col("entity_type"), F.col("pid"), p) for p in provider_names()])
            ).alias("id"),
        )
        .join(events.select(*SCOPE, F.col("pid").alias("id")).distinct(), [*SCOPE, "id"])
    )
    created = derived.select(*SCOPE, "id", F.concat(F.lit("n:"), "owner").alias("hub")).unionByName(
        derived.select(*SCOPE, F.col("owner").alias("id"), F.concat(F.lit("n:"), "owner").alias("hub"))
    )
    stored = touched.select(
        *SCOPE,
        "entity_id",
        F.explode(F.concat(F.array("entity_id"), F.map_values("provider_ids"))).alias("id"),
    ).select(*SCOPE, "id", F.concat(F.lit("c:"), "entity_id").alias("hub"))
    stored_mail = touched.where(F.col("fields.email") != "").select(
        *SCOPE, F.col("entity_id").alias("id"), F.concat(F.lit("e:"), "fields.email").alias("hub")
    )
    return mail.unionByName(created).unionByName(stored).unionByName(stored_mail).distinct()


def _lookups_needed(events: DataFrame) -> DataFrame:
    """(scope, email, need): how many stored records an email lookup of this batch can reach at most.

    A lookup takes the oldest live record. A further one is only reached after the record taken before
    was deleted or given another email, by an id that this batch connects to the email. So the bound is
    one plus the deletes and differing upserts of the ids that mention the email.
    """
    email = F.when((F.col("kind") != "delete") & (F.col("f.email") != ""), F.col("f.email"))
    per = events.groupBy(*SCOPE, "pid", email.alias("email")).agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy(*SCOPE, "pid").agg(F.sum("n").alias("total"))
    mentions = per.where(F.col("email").isNotNull())
    return mentions.join(total, [*SCOPE, "pid"]).groupBy(*SCOPE, "email").agg((F.sum(F.col("total") - F.col("n")) + 1).alias("need"))


def touched_records(events: DataFrame, canonical: DataFrame) -> DataFrame:
    """Stored records an event of this batch could reach: by entity id or mapped id, and per email
    the oldest live ones, as many as lookups can need."""
    ids = events.select(*SCOPE, F.col("pid").alias("id")).distinct()
    own = canonical.select(*SCOPE, "entity_id", F.explode(F.concat(F.array("entity_id"), F.map_values("provider_ids"))).alias("id"))
    by_id = cut_lineage(own.join(ids, [*SCOPE, "id"], "left_semi").select(*SCOPE, "entity_id").distinct(), "reached")
    need = cut_lineage(_lookups_needed(events), "lookups")
    most = need.agg(F.max("need").alias("k")).first().k or 0
    live = canonical.where(~F.col("tombstone") & (F.col("fields.email") != "")).select(
        *SCOPE, "entity_id", F.col("fields.email").alias("email"), "created_at"
    )
    # The constant bound lets Spark cut each email to its oldest rows before the shuffle.
    rank = F.row_number().over(W.partitionBy(*SCOPE, "email").orderBy("created_at", "entity_id"))
    oldest = (
        live.join(need.select(*SCOPE, "email"), [*SCOPE, "email"], "left_semi")
        .join(by_id, [*SCOPE, "entity_id"], "left_anti")
        .withColumn("rank", rank)
        .where(F.col("rank") <= int(most))
        .join(need, [*SCOPE, "email"])
        .where(F.col("rank") <= F.col("need"))
        .select(*SCOPE, "entity_id")
    )
    return canonical.join(by_id.unionByName(oldest), [*SCOPE, "entity_id"], "left_semi")


def clusters(events: DataFrame, touched: DataFrame) -> DataFrame:
    """(scope, id) -> cluster for ids whose cluster is not simply the id itself.

    Minimum-label propagation over the id/hub memberships, with label jumping so that chains
    shrink geometrically. Each round is two combinable `min` aggregations: a hub shared by a huge
    number of ids is reduced map-side and never collected.
    """
    edges = cut_lineage(_memberships(events, touched), "memberships")
    # A hub with one id links nothing.
    shared = edges.groupBy(*SCOPE, "hub").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    edges = cut_lineage(edges.join(shared.select(*SCOPE, "hub"), [*SCOPE, "hub"], "left_semi"), "shared")
    labels = edges.select(*SCOPE, "id").distinct().withColumn("label", F.col("id"))
    while True:
        hubs = edges.join(labels, [*SCOPE, "id"]).groupBy(*SCOPE, "hub").agg(F.min("label").alias("hub_label"))
        nearest = edges.join(hubs, [*SCOPE, "hub"]).groupBy(*SCOPE, "id").agg(F.min("hub_label").alias("near"))
        moved = labels.join(nearest, [*SCOPE, "id"]).select(
            *SCOPE, "id", F.col("label").alias("was"), F.least("label", "near").alias("label")
        )
        # Jump: the label is itself an id, so follow it one step further.
        ahead = moved.select(*SCOPE, F.col("id").alias("label"), F.col("label").alias("next"))
        moved = moved.join(ahead, [*SCOPE, "label"], "left").select(
            *SCOPE, "id", "was", F.least("label", F.coalesce("next", "label")).alias("label")
        )
        moved = cut_lineage(moved, "labels")
        changed = moved.where(F.col("was") != F.col("label")).limit(1).count()
        labels = moved.drop("was")
        if not changed:
            return labels.where(F.col("id") != F.col("label")).withColumnRenamed("label", "cluster")
