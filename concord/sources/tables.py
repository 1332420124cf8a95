"""State tables on plain Parquet: immutable versions named by one manifest.

Parquet has no MERGE, so a change writes new files and a commit publishes one small JSON manifest
that names the current files of every table. Readers only see published versions, and all tables of
a batch change together. Keyed tables are split into hash buckets; an upsert rewrites the buckets it
touches and the manifest carries the others forward.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord import schemas as S
from concord.session import cut_lineage, utc_now

BUCKETS = 64
# Table -> (schema, key columns, bucket columns). Append-only tables have no key.
TABLES: dict[str, tuple[str, list[str], list[str]]] = {
    "canonical_records": (S.CANONICAL, S.CK, S.CK),
    "outbound_writes": (S.OUTBOUND, [*S.CK, "target_source"], S.CK),
    "processed_events": (S.PROCESSED, S.EK, S.EK),
    "source_events": (S.SOURCE_EVENT, S.EK, S.EK),
    "conflicts": (S.CONFLICT, S.CONFLICT_KEY, ["tenant_id", "entity_id"]),
    "retry_queue": (S.RETRY, S.EK, S.EK),
    "dead_letter": (S.DEAD_LETTER, S.EK, S.EK),
    "runs": (S.RUN, ["run_id"], ["run_id"]),
    "findings": (S.FINDING, ["run_id", "kind", "provider_id"], ["run_id", "provider_id"]),
    "sync_jobs": (S.SYNC_JOB, ["job_id"], ["job_id"]),
    "policies": (S.POLICY, ["tenant_id", "entity", "source", "destination"], ["tenant_id"]),
    "connections": (S.CONNECTION, ["tenant_id", "provider"], ["tenant_id"]),
    "tenants": (S.TENANT, ["slug"], ["slug"]),
    "operations": (S.OPERATION, [], []),
    "audit_log": (S.AUDIT, [], []),
    "changes": (
        "tenant_id string, entity_type string, entity_id string, source string, event_id string, arrival_seq bigint, "
        "target string, op string, provider_id string, payload map<string,string>",
        [],
        [],
    ),
}


class TableStore:
    """Reads the published state; stages writes; publishes them with `commit`."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._staged: dict[str, dict[str, list[str]]] = {}

    # Files ---------------------------------------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _manifests(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/_manifests")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self) -> dict:
        versions = self._manifests()
        if not versions:
            return {"version": 0, "tables": {}, "batches": {}}
        fs, p = self._fs(f"{self.root}/_manifests/{versions[-1]:012d}.json")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    # Reading -------------------------------------------------------------------------------------

    def read(self, table: str) -> DataFrame:
        return self._load(table, self._current(table))

    def read_buckets(self, table: str, buckets: list[int]) -> DataFrame:
        now = self._current(table)
        return self._load(table, {b: now[b] for b in map(str, buckets) if b in now})

    def _current(self, table: str) -> dict[str, list[str]]:
        if table in self._staged:
            return self._staged[table]
        return self.manifest()["tables"].get(table, {})

    def _load(self, table: str, files: dict[str, list[str]]) -> DataFrame:
        paths = [f"{self.root}/{p}" for group in files.values() for p in group]
        if not paths:
            return self.spark.createDataFrame([], TABLES[table][0])
        return self.spark.read.schema(TABLES[table][0]).parquet(*paths)

    # Writing -------------------------------------------------------------------------------------

    def _bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*TABLES[table][2]), F.lit(self.buckets)).cast("int")

    def _write(self, table: str, rows: DataFrame) -> dict[str, list[str]]:
        """Write rows under a fresh folder, one sub-folder per bucket; returns bucket -> paths."""
        folder = f"{table}/{uuid.uuid4().hex}"
        rows.withColumn("_b", self._bucket(table)).repartition(self.buckets, "_b").write.partitionBy("_b").parquet(f"{self.root}/{folder}")
        fs, p = self._fs(f"{self.root}/{folder}")
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return {n[3:]: [f"{folder}/{n}"] for n in names if n.startswith("_b=")}

    def _touched(self, table: str, rows: DataFrame) -> list[int]:
        # At most `buckets` small rows.
        return [r[0] for r in rows.select(self._bucket(table).alias("b")).distinct().collect()]

    def _stage(self, table: str, changed: dict[str, list[str]], touched: list[int]) -> None:
        kept = {b: f for b, f in self._current(table).items() if int(b) not in set(touched)}
        self._staged[table] = {**kept, **changed}

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Insert or overwrite by key. `rows` holds at most one row per key."""
        schema, key, _ = TABLES[table]
        cols = self._columns(table)
        rows = cut_lineage(rows.select(*cols), "upserted")
        touched = self._touched(table, rows)
        old = self.read_buckets(table, touched)
        both = old.select(*cols).withColumn("_new", F.lit(0)).unionByName(rows.select(*cols).withColumn("_new", F.lit(1)))
        # At most two rows per key, so the window partitions stay tiny.
        first = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("_new")))
        merged = both.withColumn("_rn", first).where("_rn = 1").select(*cols)
        self._stage(table, self._write(table, merged), touched)

    def insert_absent(self, table: str, rows: DataFrame) -> DataFrame:
        """Add rows whose key is not stored yet; stored rows stand. Of rows with one key in the input the least stands.
        Returns the rows added."""
        _, key, _ = TABLES[table]
        rest = F.struct(*[c for c in self._columns(table) if c not in key])
        # Maps have no order, their JSON text has.
        rows = rows.groupBy(*key).agg(F.min_by(rest, F.to_json(rest)).alias("r")).select(*key, "r.*")
        rows = cut_lineage(rows, "offered")
        touched = self._touched(table, rows)
        known = self.read_buckets(table, touched).select(*key)
        new = rows.select(*self._columns(table)).join(known, key, "left_anti")
        added = self._write(table, new)
        now = self._current(table)
        merged = {b: [*now.get(b, []), *added.get(b, [])] for b in {*now, *added}}
        self._staged[table] = merged
        return self._load(table, added)

    def delete(self, table: str, keys: DataFrame) -> None:
        _, key, _ = TABLES[table]
        touched = self._touched(table, keys)
        kept = self.read_buckets(table, touched).join(keys.select(*key), key, "left_anti")
        self._stage(table, self._write(table, kept), touched)

    def replace(self, table: str, rows: DataFrame) -> None:
        """The table becomes exactly `rows`."""
        self._staged[table] = self._write(table, rows.select(*self._columns(table))) if TABLES[table][1] else self._plain(table, rows)

    def append(self, table: str, rows: DataFrame) -> None:
        now = self._current(table)
        new = self._plain(table, rows)
        self._staged[table] = {**now, **new}

    def compact(self, table: str) -> None:
        """Rewrite a table that many small batches have appended to."""
        self.replace(table, self.read(table))

    def _plain(self, table: str, rows: DataFrame) -> dict[str, list[str]]:
        folder = f"{table}/{uuid.uuid4().hex}"
        rows.select(*self._columns(table)).write.parquet(f"{self.root}/{folder}")
        return {folder.split("/")[1]: [folder]}

    def _columns(self, table: str) -> list[str]:
        return self.spark.createDataFrame([], TABLES[table][0]).columns

    # Committing ----------------------------------------------------------------------------------

    def seen(self, stream: str, batch_id: int) -> bool:
        """Whether a stream's batch was published already."""
        return self.manifest()["batches"].get(stream, -1) >= batch_id

    def commit(self, stream: str | None = None, batch_id: int | None = None) -> int:
        """Publish all staged tables at once. The manifest is created under the next number and
        never overwritten, so of two writers only one can publish that version."""
        base = self.manifest()
        nxt = {"version": base["version"] + 1, "tables": {**base["tables"], **self._staged}, "batches": dict(base["batches"])}
        if stream is not None:
            nxt["batches"][stream] = batch_id
        fs, final = self._fs(f"{self.root}/_manifests/{nxt['version']:012d}.json")
        _, temp = self._fs(f"{self.root}/_manifests/.{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        try:
            out.write(bytearray(json.dumps(nxt).encode()))
        finally:
            out.close()
        if fs.exists(final) or not fs.rename(temp, final):
            fs.delete(temp, False)
            raise RuntimeError(f"version {nxt['version']} was published by another writer")
        self._staged = {}
        return nxt["version"]

    def rollback(self) -> None:
        self._staged = {}


def load_dimension(store: TableStore, table: str, rows: DataFrame) -> DataFrame:
    """Add configuration rows (tenants, connections, policies). A repeated key inside the input is an
    error; a key that exists already is left as it is and reported in the result."""
    _, key, _ = TABLES[table]
    if rows.groupBy(*key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{table}: repeated key in input")
    existing = rows.join(store.read(table).select(*key), key, "left_semi").select(*key)
    clashes = existing.withColumn("status", F.lit("exists"))
    added = store.insert_absent(table, rows).select(*key).withColumn("status", F.lit("created"))
    return added.unionByName(clashes)


def persist_replay(store: TableStore, result, stream: str | None = None, batch_id: int | None = None, now: Column | None = None) -> int:
    """Write everything a replay decided and publish it as one version.

    Claims are written only for events that reached a final outcome; failed ones become retry
    entries or dead letters in the same version, so nothing is acknowledged without a durable trace.
    """
    from concord.operators import failures

    none = F.lit(None).cast("string")
    store.upsert("canonical_records", result.canonical)
    store.upsert("outbound_writes", result.outbound)
    store.append("operations", result.operations)
    store.append("changes", result.changes)
    store.insert_absent("processed_events", result.claims)
    store.insert_absent("conflicts", result.conflicts.withColumns({"resolved_by": none, "resolved_at": none.cast("timestamp_ntz")}))
    now = utc_now() if now is None else now
    # Of repeated deliveries of one event the first stands.
    first = F.min_by(F.struct("kind", "message", "state"), F.struct("arrival_seq", "delivery")).alias("f")
    once = result.failures.groupBy(*S.EK).agg(first).select(*S.EK, "f.*")
    retries, dead = failures.first_failure(cut_lineage(once, "failures"), now)
    if retries.limit(1).count():
        store.replace("retry_queue", failures.enqueue(store.read("retry_queue"), retries))
    if dead.limit(1).count():
        store.replace("dead_letter", failures.bury(store.read("dead_letter"), dead, now))
    return store.commit(stream, batch_id)
