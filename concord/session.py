"""Session defaults, scratch storage and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Dimension tables (policies, connections, tenants) are broadcast only when a
# count proves they stay below this many rows; above it Spark shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20


def build_session(app: str = "concord", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; cluster values win when given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in `spark.checkpoint.dir`. Only local sessions, where every
    task runs on this machine, may do without it and get a private folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="concord-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/concord/{spark.sparkContext.applicationId}"


def release_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables. Frames that read them become unusable."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once as a columnar table in the shared scratch folder and read it back.

    Later steps scan only the columns they need, and a lost executor re-reads files
    instead of replaying the whole plan.
    """
    path = f"{scratch_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES, store: bool = True) -> DataFrame:
    """Mark a dimension for broadcast only if it is proven to be small. It is evaluated once: what is measured and
    broadcast is a stored copy. `store=False` keeps secrets off the disk and evaluates it twice."""
    stored = cut_lineage(df, "dimension") if store else df
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in stored.columns])))), F.lit(0))
    found = stored.agg(F.count(F.lit(1)).alias("n"), size.alias("bytes")).first()
    return F.broadcast(stored) if found.n <= max_rows and found.bytes <= max_bytes else stored


def numbered(df: DataFrame, *order: str, name: str = "arrival_seq") -> DataFrame:
    """Add numbers that rise in the given order over the whole table: rows are dealt by range and sorted inside their
    partition, so no single task sees them all. Stored, so that the numbers stay as they are."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(dealt.withColumn(name, F.monotonically_increasing_id()), "numbered")


def utc_now():
    """Now as a UTC wall clock, whatever the session's zone is."""
    return F.expr("convert_timezone(current_timezone(), 'UTC', localtimestamp())")
