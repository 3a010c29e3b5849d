"""Reading the given Parquet tables, and state-shaped views derived from them.

The views turn orders, events, conversations and documents into a change log, records, queues, jobs, streams,
objects and so on.  Each is one SQL text with three placeholders that differ between dialects, so that
the DataFrames and the SQL used to check them start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SPARK = {"ms": "unix_millis(CAST({} AS TIMESTAMP))", "sha": "sha2({}, 256)", "blen": "CAST(octet_length({}) AS BIGINT)"}
DUCKDB = {"ms": "(epoch_us({}) // 1000)", "sha": "sha256({})", "blen": "CAST(strlen({}) AS BIGINT)"}

VIEWS: dict[str, str] = {
    "kv_log": """
SELECT CAST(floor(event_id / 4) AS BIGINT) + 1 AS tx_id, event_id + 1 AS sequence,
       CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS kind,
       concat('user:', lpad(CAST(user_id AS STRING), 4, '0')) AS k,
       CASE WHEN event_type = 'error' THEN NULL ELSE props END AS v
FROM events""",
    "kv_commits": """
SELECT DISTINCT CAST(floor(event_id / 4) AS BIGINT) + 1 AS tx_id FROM events
WHERE (CAST(floor(event_id / 4) AS BIGINT) + 1) % 5 <> 0""",
    "records": "SELECT o_orderkey AS pk, concat(o_orderstatus, '|', o_orderpriority) AS v, o_custkey FROM orders",
    "record_index": """
SELECT 'status' AS idx, o_orderstatus AS idx_value, o_orderkey AS pk FROM orders
UNION ALL SELECT 'priority' AS idx, o_orderpriority AS idx_value, o_orderkey AS pk FROM orders
UNION ALL SELECT 'price' AS idx, lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS STRING), 12, '0') AS idx_value, o_orderkey AS pk FROM orders""",
    "queue_messages": """
SELECT event_type AS queue, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS BIGINT) AS id,
       CASE WHEN event_id % 10 = 9 THEN 'dead' WHEN event_id % 10 IN (6, 7, 8) THEN 'leased' ELSE 'ready' END AS state,
       CAST(floor(value) AS BIGINT) % 10 AS priority,
       CASE WHEN event_id % 10 < 6 THEN 0 ELSE 1 + event_id % 3 END AS attempts,
       {ms:ts} AS available_at_ms,
       CASE WHEN event_id % 10 IN (6, 7, 8) THEN {ms:ts} + (event_id % 7) * 3600000 ELSE 0 END AS lease_until_ms,
       props AS payload
FROM events""",
    "jobs": """
SELECT lpad(CAST(o_orderkey AS STRING), 16, '0') AS id, o_orderpriority AS handler,
       CASE o_orderkey % 8 WHEN 0 THEN 'completed' WHEN 1 THEN 'dead' WHEN 2 THEN 'cancelled'
            WHEN 3 THEN 'leased' WHEN 4 THEN 'leased' ELSE 'ready' END AS state,
       {ms:o_orderdate} AS available_at_ms,
       CASE WHEN o_orderkey % 3 = 0 THEN {ms:o_orderdate} + 2592000000 END AS deadline_ms,
       o_custkey % 5 AS priority, o_orderkey % 4 AS attempts, 3 AS max_attempts,
       1000 * (1 + o_orderkey % 5) AS retry_backoff_ms,
       CASE WHEN o_orderkey % 8 IN (3, 4) THEN {ms:o_orderdate} + 86400000 ELSE 0 END AS lease_until_ms,
       concat('cust:', CAST(o_custkey AS STRING)) AS idempotency_key
FROM orders""",
    "stream_entries": """
SELECT role AS stream, CAST(row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS BIGINT) - 1 AS stream_offset,
       conv_id, turn, text AS payload
FROM conversations""",
    "subscription_acks": """
SELECT r.role AS stream, concat('sub', CAST(n.n_nationkey AS STRING)) AS subscription, CAST(n.n_nationkey AS BIGINT) * 3 AS acked_through
FROM (SELECT DISTINCT role FROM conversations) r CROSS JOIN nation n WHERE n.n_nationkey < 5""",
    "objects": """
SELECT object_id, size, expires_at_unix FROM (
  SELECT {sha:text} AS object_id, {blen:text} AS size, CASE WHEN doc_id % 4 = 0 THEN 1700000000 + doc_id END AS expires_at_unix,
         row_number() OVER (PARTITION BY {sha:text} ORDER BY doc_id) AS rn
  FROM documents) t WHERE rn = 1""",
    "object_refs": """
SELECT source AS namespace, lpad(CAST(doc_id AS STRING), 10, '0') AS name, {sha:text} AS object_id
FROM documents WHERE doc_id % 3 <> 0""",
    "ttl_kv": """
SELECT concat('session:', CAST(c_custkey AS STRING)) AS k, c_name AS v,
       CASE WHEN c_custkey % 4 <> 0 THEN 1700000000000 + (c_custkey % 1000) * 1000 END AS expires_at_ms
FROM customer""",
    "rpc_requests": """
SELECT conv_id, turn, conv_id * 100 + turn AS tx_id, text AS payload, 1700000000000 + conv_id * 1000 + turn AS created_at_ms,
       CASE WHEN conv_id % 2 = 1 THEN 1700000000000 + conv_id * 1000 + turn + 500 END AS deadline_ms
FROM conversations WHERE role = 'user'""",
    "rpc_responses": """
SELECT conv_id * 100 + (turn - 1) AS tx_id, text AS payload, 1700000000000 + conv_id * 1000 + turn AS completed_at_ms
FROM conversations WHERE role = 'assistant' AND conv_id % 3 <> 0""",
    "workflows": """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey - o_orderkey % 6 END AS parent_id,
       CASE o_orderkey % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'waiting' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'cancelled' END AS status,
       CASE WHEN o_orderkey % 5 = 1 AND o_orderkey % 2 = 0 THEN {ms:o_orderdate} + 86400000 END AS resume_at_ms,
       CASE WHEN o_orderkey % 5 = 1 AND o_orderkey % 2 = 1 THEN o_orderpriority END AS signal_name,
       {ms:o_orderdate} AS created_at_ms
FROM orders""",
    "workflow_history": """
SELECT conv_id AS workflow_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) - 1 AS sequence,
       CASE role WHEN 'system' THEN 'created' WHEN 'user' THEN 'signal_received' ELSE 'step_changed' END AS kind, turn AS at_ms
FROM conversations""",
    "schedules": """
SELECT p_partkey AS id, p_brand AS handler, CASE WHEN p_partkey % 4 = 0 THEN 'once' ELSE 'interval' END AS mode,
       CAST(p_size AS BIGINT) * 60000 + 60000 AS every_ms, 1700000000000 + p_partkey * 1000 AS next_run_ms, p_partkey % 7 <> 0 AS enabled
FROM part""",
    "outbox": """
SELECT CAST(floor(event_id / 4) AS BIGINT) + 1 AS tx_id, event_id % 4 AS seq_in_tx, event_type AS topic, props AS payload,
       {ms:ts} AS created_at_ms, event_id % 5 = 0 AS acked
FROM events WHERE event_type IN ('purchase', 'signup')""",
}

_TABLE = re.compile(r"\bFROM\s+(events|orders|conversations|documents|customer|part)\b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def expand(text: str, dialect: dict[str, str]) -> str:
    return re.sub(r"\{(ms|sha|blen):(\w+)\}", lambda m: dialect[m[1]].format(m[2]), text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a lazy DataFrame over the tables in sf_dir."""
    sql = expand(VIEWS[name], SPARK)
    used = {*_TABLE.findall(sql)} | ({"nation"} if "nation" in sql else set())
    return spark.sql(re.sub(r"\b(FROM|JOIN)\s+(" + "|".join(sorted(used)) + r")\b", r"\1 {\2}", sql), **{t: table(spark, sf_dir, t) for t in used})


def duckdb_views(*names: str) -> str:
    """A WITH clause that defines these views in DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({expand(VIEWS[n], DUCKDB)})" for n in names)
