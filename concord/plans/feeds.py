"""Input feeds derived from the supplied tables.

Each feed is one SQL text that both Spark and the checking engine run. `{name}` refers to another
feed or a supplied table, `{NTZ}` is the engine's name for a zone-less timestamp.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

FEEDS: dict[str, str] = {}

# Two providers over the same people, repeated deliveries, reordered versions, skewed clocks, empty
# required fields and deletes. (arrival_seq, delivery) is a total order.
FEEDS["change_feed"] = """
WITH base AS (
  SELECT event_id, ts, user_id, event_type, value,
         CASE WHEN event_id % 3 = 0 THEN 'hubspot' ELSE 'salesforce' END AS source
  FROM {events}),
ver AS (
  SELECT base.*, row_number() OVER (PARTITION BY source, user_id ORDER BY event_id) AS rn FROM base),
one AS (
  SELECT event_id AS arrival_seq, 1 AS delivery,
         concat('t', cast(user_id % 5 AS varchar(10))) AS tenant_id, source,
         concat('ev-', cast(event_id AS varchar(20))) AS event_id,
         CASE WHEN source = 'hubspot' THEN 'contact' ELSE 'customer' END AS provider_entity_type,
         concat(CASE WHEN source = 'hubspot' THEN 'hub-' ELSE 'sf-' END, lpad(cast(user_id AS varchar(20)), 12, '0')) AS provider_id,
         CASE WHEN event_type = 'signup' THEN 'created'
              WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'deleted' ELSE 'updated' END AS event_type,
         cast(greatest(1, rn - CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END) AS bigint) AS source_version,
         CASE WHEN event_id % 11 = 0 THEN ts - INTERVAL '6' HOUR ELSE ts END AS occurred_at,
         ts AS received_at,
         concat('F', cast(user_id AS varchar(20))) AS first_name,
         CASE WHEN event_id % 50 = 7 THEN '' ELSE concat('L', cast(user_id % 17 AS varchar(20))) END AS last_name,
         concat('u', cast(user_id AS varchar(20)), '@example.com') AS email,
         concat('+1-', cast(cast(floor(value / 10) AS bigint) AS varchar(20))) AS phone,
         concat('C-', event_type) AS company
  FROM ver)
SELECT * FROM one
UNION ALL
SELECT arrival_seq, 2, tenant_id, source, event_id, provider_entity_type, provider_id, event_type, source_version,
       occurred_at, received_at, first_name, last_name, email, phone, company
FROM one WHERE arrival_seq % 20 = 0
"""

FEEDS["tenants"] = """
SELECT tenant_id, concat('shop-', tenant_id) AS slug, concat('Shop ', tenant_id) AS name, min(received_at) AS created_at
FROM {change_feed} GROUP BY tenant_id
"""

FEEDS["connections"] = """
SELECT tenant_id, source AS provider, concat('https://', source, '.example') AS base_url,
       concat('secret-', tenant_id, '-', source) AS webhook_secret, min(received_at) AS created_at
FROM {change_feed} GROUP BY tenant_id, source
"""

FEEDS["policies"] = """
SELECT tenant_id, 'customer' AS entity, provider AS source,
       CASE WHEN provider = 'salesforce' THEN 'hubspot' ELSE 'salesforce' END AS destination,
       'async' AS mode,
       CASE tenant_id WHEN 't0' THEN 'last_write_wins' WHEN 't1' THEN 'source_priority' WHEN 't2' THEN 'field_merge'
                      WHEN 't3' THEN 'manual' ELSE 'unknown' END AS conflict_strategy,
       CASE tenant_id WHEN 't1' THEN 'tombstone_only' WHEN 't2' THEN 'ignore' ELSE 'propagate' END AS delete_policy,
       'exponential' AS retry_policy,
       cast(CASE WHEN provider = 'salesforce' THEN 100 ELSE 200 END AS int) AS source_priority,
       true AS enabled, created_at
FROM {connections}
"""

# Provider extracts: every customer, some tombstoned at the provider, some lacking a required field.
FEEDS["sf_snapshot"] = """
SELECT concat('t', cast(c_custkey % 5 AS varchar(10))) AS tenant_id,
       concat('sf-', lpad(cast(c_custkey AS varchar(20)), 12, '0')) AS id,
       cast(1 + c_custkey % 4 AS bigint) AS version, c_custkey % 29 = 0 AS deleted,
       concat('F', cast(c_custkey AS varchar(20))) AS first_name,
       CASE WHEN c_custkey % 37 = 5 THEN '' ELSE concat('L', cast(c_custkey % 17 AS varchar(20))) END AS last_name,
       concat('c', cast(c_custkey AS varchar(20)), '@example.com') AS email,
       concat('+1-', cast(c_nationkey AS varchar(20))) AS phone, c_mktsegment AS company,
       CAST('2024-01-01 00:00:00' AS {NTZ}) + c_custkey * INTERVAL '1' MINUTE AS updated_at
FROM {customer}
"""

# Canonical state: one record per customer. Where the salesforce id is another one, the provider row
# is unknown here and the mapped row is absent there.
FEEDS["canonical_seed"] = """
SELECT concat('t', cast(c_custkey % 5 AS varchar(10))) AS tenant_id, 'customer' AS entity_type,
       concat('cust-', lpad(cast(c_custkey AS varchar(20)), 12, '0')) AS entity_id,
       concat(CASE WHEN c_custkey % 8 = 6 THEN 'sf-x' ELSE 'sf-' END, lpad(cast(c_custkey AS varchar(20)), 12, '0')) AS salesforce_id,
       CASE WHEN c_custkey % 4 <> 0 THEN concat('hub-', lpad(cast(c_custkey AS varchar(20)), 12, '0')) END AS hubspot_id,
       concat('F', cast(c_custkey AS varchar(20))) AS first_name,
       concat('L', cast(c_custkey % 17 AS varchar(20))) AS last_name,
       concat('c', cast(c_custkey AS varchar(20)), '@example.com') AS email,
       concat('+1-', cast(c_nationkey AS varchar(20))) AS phone,
       CASE WHEN c_custkey % 19 = 3 THEN 'DRIFTED' ELSE c_mktsegment END AS company,
       c_custkey % 23 = 2 AS tombstone, cast(1 AS bigint) AS version_salesforce, cast(3 AS bigint) AS version,
       CASE WHEN c_custkey % 2 = 0 THEN 'salesforce' ELSE 'hubspot' END AS prov_source,
       cast(CASE WHEN c_custkey % 2 = 0 THEN 100 ELSE 200 END AS int) AS prov_priority,
       CAST('2024-01-15 00:00:00' AS {NTZ}) AS prov_occurred_at,
       CAST('2024-01-01 00:00:00' AS {NTZ}) + c_custkey * INTERVAL '1' SECOND AS created_at
FROM {customer}
"""

# One incoming edit per order, aimed at the customer who placed it.
FEEDS["edits"] = """
SELECT o_orderkey AS arrival_seq, concat('t', cast(o_custkey % 5 AS varchar(10))) AS tenant_id,
       CASE WHEN o_orderkey % 2 = 0 THEN 'salesforce' ELSE 'hubspot' END AS source,
       concat('od-', cast(o_orderkey AS varchar(20))) AS event_id,
       concat(CASE WHEN o_orderkey % 2 = 0 THEN 'sf-' ELSE 'hub-' END, lpad(cast(o_custkey AS varchar(20)), 12, '0')) AS provider_id,
       cast(2 + o_orderkey % 5 AS bigint) AS source_version,
       CASE WHEN o_orderkey % 6 = 0 THEN CAST('2024-01-15 00:00:00' AS {NTZ})
            ELSE CAST('2024-01-10 00:00:00' AS {NTZ}) + (o_orderkey % 11) * INTERVAL '1' DAY END AS occurred_at,
       cast(CASE WHEN o_orderkey % 2 = 0 THEN 100 ELSE 200 END AS int) AS priority,
       concat('F', cast(o_custkey AS varchar(20))) AS first_name,
       concat('L', cast(o_orderkey % 17 AS varchar(20))) AS last_name,
       concat('c', cast(o_custkey AS varchar(20)), '@example.com') AS email,
       concat('+1-', cast(o_orderkey % 25 AS varchar(20))) AS phone, o_orderpriority AS company,
       CASE o_orderkey % 5 WHEN 0 THEN 'last_write_wins' WHEN 1 THEN 'source_priority' WHEN 2 THEN 'field_merge'
            WHEN 3 THEN 'manual' ELSE 'unknown' END AS strategy
FROM {orders}
"""

FEEDS["write_results"] = """
SELECT tenant_id, event_id, source, arrival_seq, cast(1 + arrival_seq % 9 AS int) AS attempt, cast(8 AS int) AS max_attempts,
       cast(CASE arrival_seq % 12 WHEN 0 THEN 429 WHEN 1 THEN 500 WHEN 2 THEN 503 WHEN 3 THEN 401 WHEN 4 THEN 404
            WHEN 5 THEN 422 WHEN 6 THEN 409 WHEN 7 THEN 418 ELSE 200 END AS int) AS status_code,
       cast(CASE WHEN arrival_seq % 24 = 0 THEN 2 END AS int) AS retry_after_s,
       concat('answer ', cast(arrival_seq % 12 AS varchar(10))) AS message,
       received_at, CAST('2024-01-01 00:00:00' AS {NTZ}) + arrival_seq * INTERVAL '5' SECOND
                    + cast(floor(arrival_seq / 500) AS bigint) * INTERVAL '1' HOUR AS done_at,
       cast(CASE WHEN floor(arrival_seq / 250) % 3 = 1 THEN 30 ELSE 1 END AS bigint) AS weight, (arrival_seq * 7919 % 10000) / 10000.0e0 AS fraction
FROM {change_feed} WHERE delivery = 1
"""

FEEDS["login_attempts"] = """
SELECT concat('t', cast(user_id % 5 AS varchar(10))) AS tenant_id,
       concat('u', cast(user_id % 20 AS varchar(10)), '@example.com') AS email,
       concat('10.0.0.', cast(user_id % 3 AS varchar(10))) AS ip,
       event_type = 'signup' AND event_id % 4 = 0 AS success,
       CAST('2024-01-01 00:00:00' AS {NTZ}) + event_id * INTERVAL '1' SECOND AS attempted_at
FROM {events}
"""

FEEDS["request_log"] = """
SELECT event_id AS request_id, ts, cast(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS int) AS status,
       value / 10.0e0 AS duration_s, event_type AS route
FROM {events}
"""

FEEDS["sessions"] = """
SELECT concat('s-', cast(o_orderkey AS varchar(20))) AS session_id, concat('t', cast(o_custkey % 5 AS varchar(10))) AS tenant_id,
       concat('u-', cast(o_custkey AS varchar(20))) AS user_id, o_orderdate AS created_at,
       o_orderdate + INTERVAL '30' DAY AS expires_at,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '1' DAY END AS revoked_at
FROM {orders}
"""


def refs(text: str) -> list[str]:
    return [r for r in dict.fromkeys(re.findall(r"\{(\w+)\}", text)) if r != "NTZ"]


def frame(spark: SparkSession, sf_dir: str, name: str, _cache: dict | None = None) -> DataFrame:
    """A supplied table or a feed as a DataFrame."""
    cache = {} if _cache is None else _cache
    if name not in cache:
        if name in TABLES:
            cache[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            text = FEEDS[name].replace("{NTZ}", "TIMESTAMP_NTZ")
            cache[name] = spark.sql(text, **{r: frame(spark, sf_dir, r, cache) for r in refs(text)})
    return cache[name]


def with_feeds(body: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """`body` for the checking engine: every `{feed}` it names becomes a CTE."""
    known = {**FEEDS, **(extra or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for r in refs(text):
            if r in known and r not in order:
                visit(known[r])
                order.append(r)

    visit(body)

    def plain(text: str) -> str:
        return re.sub(r"\{(\w+)\}", lambda m: "TIMESTAMP" if m[1] == "NTZ" else m[1], text).strip()

    ctes = [f"{n} AS {'' if re.search(rf'FROM {n} ', known[n]) else 'MATERIALIZED '}({plain(known[n])})" for n in order]
    text = plain(body)
    if not ctes:
        return text
    head = "WITH RECURSIVE " if recursive else "WITH "
    if text.upper().startswith("WITH "):
        text = text[text.index(" ") + 1 :]
        if text.upper().startswith("RECURSIVE "):
            text = text[10:]
        return head + ",\n".join(ctes) + ",\n" + text
    return head + ",\n".join(ctes) + "\n" + text
