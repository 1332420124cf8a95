"""Reading and publishing change events and provider snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators.ingest import keyed
from concord.schemas import DELIVERY, EVENT, SNAPSHOT


def read_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Batch scan of an event table with the fixed schema."""
    return spark.read.schema(EVENT).format(fmt).load(path)


def read_deliveries(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(DELIVERY).format(fmt).load(path)


def read_snapshot(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(SNAPSHOT).format(fmt).load(path)


def stream_files(spark: SparkSession, path: str, schema: str = EVENT, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Stream of event files; the query's checkpoint keeps the offsets."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def stream_topic(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Stream of a Kafka topic from its start. Arrival order inside a key is the offset order."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .options(**options)
        .load()
    )
    return decode_messages(raw)


def decode_messages(raw: DataFrame) -> DataFrame:
    """Message value to event columns. Undecodable values keep their text in `poison`."""
    text = F.col("value").cast("string")
    event = F.from_json(text, EVENT + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = raw.select(event.alias("e"), text.alias("text"), "partition", "offset")
    fields = [c.strip().split(" ")[0] for c in _top_level(EVENT) if not c.strip().startswith(("arrival_seq", "delivery"))]
    poison = F.when(F.col("e._corrupt").isNotNull() | F.col("e.event_id").isNull(), F.col("text"))
    return out.select(*[F.col(f"e.{c}").alias(c) for c in fields], F.col("offset").alias("arrival_seq"), F.lit(1).alias("delivery"), poison.alias("poison"))


def _top_level(ddl: str) -> list[str]:
    depth, item, items = 0, "", []
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            items.append(item)
            item = ""
        else:
            item += ch
    return [*items, item]


def publish(events: DataFrame, path: str, mode: str = "append") -> None:
    """Write events so that all events of one entity land in the same file set, in key order."""
    out = keyed(events)
    out.repartition("key").write.mode(mode).parquet(path)


def publish_topic(events: DataFrame, servers: str, topic: str, **options: str) -> None:
    keyed(events).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).options(**options).save()


def write_changes(changes: DataFrame, path: str, mode: str = "append") -> None:
    """Destination change sets, one directory per target."""
    changes.withColumn("payload", F.to_json("payload")).write.mode(mode).partitionBy("target").parquet(path)
