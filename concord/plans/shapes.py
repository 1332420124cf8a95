"""Feeds in the typed shapes the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord import schemas as S
from concord.functions.providers import per_provider
from concord.plans.feeds import frame

NOW = "timestamp_ntz'2024-03-01 00:00:00'"


def now() -> Column:
    return F.expr(NOW)


def native_map(source: Column, id_column: Column | None = None) -> Column:
    """The flat canonical columns of a feed as the provider's own field map."""

    def build(p):
        pairs = [x for n in S.FIELDS for x in (F.lit(p.names[n]), F.col(n))]
        if id_column is not None:
            pairs = [F.lit(p.id_key), id_column, *pairs]
        return F.create_map(*pairs)

    return per_provider(source, build)


def fields_struct(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + n).alias(n) for n in S.FIELDS])


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = frame(spark, sf_dir, "change_feed")
    return c.select(
        "event_id",
        "tenant_id",
        "source",
        F.col("provider_entity_type").alias("entity_type"),
        F.col("provider_id").alias("entity_id"),
        "event_type",
        "source_version",
        "occurred_at",
        "received_at",
        F.lit(None).cast("string").alias("correlation_id"),
        F.lit(None).cast(S.EVENT_PROVENANCE_DDL).alias("provenance"),
        F.struct(native_map(F.col("source"), F.col("provider_id")).alias("fields")).alias("payload"),
        "arrival_seq",
        "delivery",
    )


def canonical_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = frame(spark, sf_dir, "canonical_seed")
    writer = F.struct(
        F.col("prov_source").alias("source"), F.col("version_salesforce").alias("version"),
        F.col("prov_occurred_at").alias("occurred_at"), F.col("prov_priority").alias("priority"),
    ).cast(S.WRITER_DDL)
    ids = F.filter(
        F.array(
            F.struct(F.lit("salesforce").alias("k"), F.col("salesforce_id").alias("v")),
            F.struct(F.lit("hubspot").alias("k"), F.col("hubspot_id").alias("v")),
        ),
        lambda x: x["v"].isNotNull(),
    )
    return c.select(
        *S.CK,
        fields_struct().alias("fields"),
        "version",
        F.create_map(F.lit("salesforce"), F.col("version_salesforce")).alias("source_versions"),
        F.map_from_entries(ids).alias("provider_ids"),
        F.create_map(*[x for n in S.FIELDS for x in (F.lit(n), writer)]).alias("field_provenance"),
        "tombstone",
        F.col("prov_source").alias("origin_source"),
        F.lit(None).cast("string").alias("origin_event_id"),
        "created_at",
    )


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = frame(spark, sf_dir, "sf_snapshot")
    return s.select(
        "tenant_id", "id", F.col("version").alias("source_version"), "deleted", native_map(F.lit("salesforce"), F.col("id")).alias("data"), "updated_at"
    )


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Webhook deliveries of the change feed: JSON bodies, a few broken, unsigned, misrouted or
    incomplete. The conditions are the ones the acknowledgement check repeats."""
    from concord.functions.signature import hmac_sha256, key_pads
    from concord.session import small

    c = frame(spark, sf_dir, "change_feed")
    n = F.col("arrival_seq")
    body = F.to_json(
        F.struct(
            F.when(n % 13 != 0, F.col("event_id")).alias("event_id"),
            F.when(n % 3 != 0, F.col("source")).alias("source"),
            F.col("provider_entity_type").alias("entity_type"),
            F.when(n % 17 != 3, F.col("provider_id")).alias("entity_id"),
            "event_type",
            "source_version",
            F.concat(F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("occurred_at"),
            F.struct(F.lit("crm").alias("origin_source")).alias("provenance"),
            F.struct(native_map(F.col("source"), F.col("provider_id")).alias("fields")).alias("payload"),
        )
    )
    out = c.select("*", F.when(n % 19 == 4, F.lit("{broken")).otherwise(body).alias("body"))
    keys = frame(spark, sf_dir, "connections").select("tenant_id", F.col("provider").alias("source"), key_pads(F.col("webhook_secret")).alias("pads"))
    out = out.join(small(keys), ["tenant_id", "source"])
    good = F.concat(F.lit("sha256="), hmac_sha256(F.col("pads"), F.col("body")))
    return out.select(
        F.concat_ws("-", F.lit("d"), "arrival_seq", "delivery").alias("delivery_id"),
        F.when(n % 23 == 5, F.lit("nobody")).otherwise(F.concat(F.lit("shop-"), "tenant_id")).alias("tenant_slug"),
        F.when(n % 29 == 6, F.lit("unlinked")).otherwise(F.col("source")).alias("provider"),
        F.when(n % 31 == 7, F.lit("sha256=00")).otherwise(good).alias("signature"),
        "body",
        "received_at",
        "arrival_seq",
        "delivery",
    )
