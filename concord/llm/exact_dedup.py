"""Exact deduplication of documents with keyed streaming state.

A stream reads the files of a table in bounded triggers and folds every row into the state of its text's digest: how often
the text stands, the largest id, and where the row of that id lies (file and row number). The state has no watermark and
never expires; RocksDB keeps it on disk and its change log in the checkpoint, from which a restarted stream goes on and
which any later job reads as a table. It holds no text, so it grows with the number of distinct texts and not with their size.

A digest alone decides nothing. Every row that hits the state of another is held against the full bytes at the locator of
that state; rows that differ although their digests agree are grouped by their texts themselves. A text that a third of
all rows share is folded before it is shuffled, and the row it is held against is dealt out with it in shares.

DataFrame and Structured Streaming operations only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import sized
from concord.session import cut_lineage, scratch_root

#: Rows of one text that are held against one copy of its kept row.
SHARE = 1000
#: Repeated digests (a hundred bytes each) up to which their table is broadcast.
BROADCAST_ROWS = 200_000
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    # a store reserves no disk ahead: there is one for each shuffle partition, most of them small
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rows(table: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """The id, the text (null: empty), its digest, and where the row lies."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at")
    return table.select(F.col(id_col).cast("long").alias("id"), body.alias("body"), digest(body).alias("digest"), at)


def follow(
    spark: SparkSession, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text",
    trigger: int = 16 << 30, digest: Callable[[Column], Column] = sha256,
) -> None:
    """Fold the rows of all files of `path` that `checkpoint` has not seen yet into its state, `trigger` bytes at a time."""
    schema = spark.read.parquet(path).select(id_col, text_col).schema
    # a table that is one file is only taken as a pattern
    pattern = f"{path[:-1]}[{path[-1]}]"
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", trigger).parquet(pattern)
    state = _rows(stream, id_col, text_col, digest).groupBy("digest")
    state = state.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "at")).alias("keep"))
    writer = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def digests(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as a table (digest, n, keep: id and at); empty if the stream has seen no file yet."""
    commits = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    files = commits.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(commits) or not files.listStatus(commits):
        return spark.createDataFrame([], "digest string, n long, keep struct<id:long,at:struct<file:string,row:long>>")
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(F.col("key").getItem("digest").alias("digest"), F.col("value.count").alias("n"), F.col("value.max").alias("keep"))


def exact_duplicates(
    spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", checkpoint: str | None = None,
    trigger: int = 16 << 30, digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """Per row of the Parquet table at `path`: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if all their bytes are; a null text is empty, and an empty text is a text like any other. Of equal texts the
    row with the largest id stays; of several rows with that id the last one by file and row number. Null ids come before all
    others, so a group has a null keep_id only if it has no id at all. Texts may be of any length. An empty table gives no row;
    other columns are not read. With a `checkpoint` of an earlier call only new files are read into the state; each file is
    read once, and files are not expected to change.
    """
    checkpoint = checkpoint or f"{scratch_root(spark)}/exact-dedup-{uuid.uuid4().hex}"
    with settings(spark, STATE):
        follow(spark, path, checkpoint, id_col, text_col, trigger, digest)
        groups = digests(spark, checkpoint).where("n > 1").select("digest", "n", "keep")
        groups = cut_lineage(groups, "repeated-digests")
    rows = _rows(spark.read.parquet(path), id_col, text_col, digest)
    marked = rows.join(sized(groups, BROADCAST_ROWS), "digest", "left")
    stays = F.col("keep.at") == F.col("at")
    other = _differing(marked.where("n is not null"), stays)
    out = marked.select(
        "id", "digest", "at", F.col("n").isNull().alias("single"), "n", F.col("keep.id").alias("keep_id"), stays.alias("stays"),
        F.sha2("body", 256).alias("text_sha256"),
    )
    if not other.isEmpty():
        out = _regrouped(out, rows, other)
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("single"), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("single") | F.coalesce("stays", F.lit(False))).alias("kept"),
        "text_sha256",
    )


def _differing(repeated: DataFrame, stays: Column) -> DataFrame:
    """Rows (digest, at) whose bytes are not those of the row that their digest's state points to."""
    shares = F.ceil(F.col("n") / SHARE)
    content = repeated.where(stays).select("digest", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"), F.col("body").alias("content"))
    hits = repeated.where(~stays).select("digest", F.pmod(F.xxhash64("at"), shares).alias("share"), "at", "body")
    met = hits.join(content, ["digest", "share"], "left")
    return cut_lineage(met.where("content is null or body <> content").select("digest", "at"), "differing")


def _regrouped(out: DataFrame, rows: DataFrame, other: DataFrame) -> DataFrame:
    """`out` with the differing rows taken from their digest's group and grouped by their texts."""
    texts = rows.join(other, ["digest", "at"], "left_semi")
    groups = texts.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("own_n"), F.max(F.struct("id", "at")).alias("own"))
    own = texts.select("digest", "at", "body").join(groups, ["digest", "body"]).select("digest", "at", "own_n", "own")
    own = cut_lineage(own, "regrouped")
    gone = other.groupBy("digest").agg(F.count(F.lit(1)).alias("gone"))
    out = out.join(gone, "digest", "left").join(own, ["digest", "at"], "left")
    mine = F.col("own").isNotNull()
    return out.select(
        "id", "single", "text_sha256",
        F.when(mine, F.col("own_n")).otherwise(F.col("n") - F.coalesce("gone", F.lit(0))).alias("n"),
        F.when(mine, F.col("own.id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(mine, F.col("own.at") == F.col("at")).otherwise(F.col("stays")).alias("stays"),
    )


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
