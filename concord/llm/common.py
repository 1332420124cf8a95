"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.session import cut_lineage, scratch_root

#: `bytes.translate` tables: A-Z to a-z, and besides every ASCII byte but 0-9 and a-z to a space.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORDS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(stored: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A stored table, marked for broadcast if it has at most `most` rows; else Spark joins it by a shuffle. The tables
    have a few numbers in each row."""
    return F.broadcast(stored) if stored.limit(most + 1).count() <= most else stored


def discard(*stored: DataFrame) -> None:
    """Delete tables that `cut_lineage` has written and that nothing reads any more; other frames are left alone."""
    for df in stored:
        files = df.inputFiles()
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent() if files else None
        if path is not None and f"{scratch_root(df.sparkSession)}/".split("://")[-1].rstrip("/") == path.getParent().toUri().getPath():
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that no frame needs any more; it does so when the driver collects its garbage."""
    for wait in (1.2, 1.0):  # Py4J tells the driver once a second which frames are gone, and what they held may go only then
        gc.collect()
        time.sleep(wait)
        spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_bytes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id as a long and the whole text as UTF-8 bytes; a null text is empty. Other columns are not read."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return df.select(F.col(id_col).cast("long").alias("id"), text.alias("body"))


def slices(batches: Iterable[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the variable-length columns of one slice hold about `max_bytes`; one row is never cut."""
    for batch in batches:
        size = batch.nbytes
        step = max(1, batch.num_rows * max_bytes // max(size, max_bytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and the offset at which each value starts, and the end."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an undirected edge list (a, b), root being the smallest node that links reach.

    Alternates the two star operations until the edges stop changing. Every round is two aggregations with
    map-side combining and two joins that adaptive execution may split at hubs; each round is stored, so a lost
    executor repeats one round. Self-loops and repeated edges are allowed; without edges the result is empty.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now, before = cut_lineage(now, "edges"), None
    for _ in range(max_rounds):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut_lineage(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (uint64 in and out)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
