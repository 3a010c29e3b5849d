"""One query for each state operator, over whole derived views, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.columns import due
from ledgerloom.operators import collections, health, jobs, log, messaging, objects, queues, rpc, schedules, ttl, workflows
from ledgerloom.sources.tables import duckdb_views, table, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EVENTS_NOW = 1_705_500_000_000  # January 2024, amid the events
ORDERS_NOW = 900_000_000_000  # July 1998, amid the orders
STATE_NOW = 1_700_000_500_000


def query(name: str, views: tuple[str, ...] = (), sql: str | None = None):
    """Register a query; sql may use the named views."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = (duckdb_views(*views) + "\n" if views else "") + sql
        return f

    return add


_LIVE = """, live AS (
  SELECT k, v FROM (SELECT l.*, row_number() OVER (PARTITION BY k ORDER BY sequence DESC) AS rn FROM kv_log l SEMI JOIN kv_commits USING (tx_id)) WHERE rn = 1 AND kind = 'PUT')
"""
_LOG = ("kv_log", "kv_commits")


def _log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, d, "kv_log"), view(spark, d, "kv_commits")


@query("kv_replay", _LOG, _LIVE + "SELECT k, v FROM live")
def kv_replay(spark, d):
    return log.replay(*_log(spark, d))


@query("kv_prefix", _LOG, _LIVE + "SELECT k, v FROM live WHERE k LIKE 'user:00%'")
def kv_prefix(spark, d):
    return log.prefix_scan(log.replay(*_log(spark, d)), "user:00")


@query("kv_get", _LOG, _LIVE + "SELECT k, v FROM live WHERE k = 'user:0007'")
def kv_get(spark, d):
    return log.get(log.replay(*_log(spark, d)), "user:0007")


@query("kv_as_of", _LOG, ", early AS (SELECT l.*, row_number() OVER (PARTITION BY k ORDER BY sequence DESC) AS rn FROM kv_log l SEMI JOIN kv_commits USING (tx_id) WHERE tx_id <= 1000) SELECT k, v FROM early WHERE rn = 1 AND kind = 'PUT'")
def kv_as_of(spark, d):
    return log.replay(*_log(spark, d), as_of=1000)


@query("log_verify", _LOG, _LIVE + """SELECT (SELECT count(*) FROM kv_log) AS records, (SELECT max(sequence) FROM kv_log) AS last_sequence,
  (SELECT count(*) FROM (SELECT DISTINCT tx_id FROM kv_log) SEMI JOIN kv_commits USING (tx_id)) AS committed,
  (SELECT count(*) FROM (SELECT DISTINCT tx_id FROM kv_log) ANTI JOIN kv_commits USING (tx_id)) AS pending, (SELECT count(*) FROM live) AS live_keys""")  # fmt: skip
def log_verify(spark, d):
    return log.verify(*_log(spark, d))


@query("pending_tx", _LOG, "SELECT tx_id, count(*) AS n_records FROM kv_log ANTI JOIN kv_commits USING (tx_id) GROUP BY tx_id")
def pending_tx(spark, d):
    return log.pending(*_log(spark, d))


def _staged(spark, d):
    """Each customer's next operation: every third is a delete."""
    c = table(spark, d, "customer")
    return c.select(
        F.concat(F.lit("user:"), F.lpad(F.col("c_custkey").cast("string"), 4, "0")).alias("k"), F.col("c_custkey").alias("sequence"),
        F.when(F.col("c_custkey") % 3 == 0, "DELETE").otherwise("PUT").alias("kind"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("v"),
    )


_STAGED = ", staged AS (SELECT 'user:' || CASE WHEN c_custkey > 9999 THEN substr(CAST(c_custkey AS VARCHAR), 1, 4) ELSE lpad(CAST(c_custkey AS VARCHAR), 4, '0') END AS k, c_custkey AS sequence, CASE WHEN c_custkey % 3 = 0 THEN 'DELETE' ELSE 'PUT' END AS kind, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS v FROM customer)"


@query("kv_overlay", _LOG, _LIVE + _STAGED + """, both_ AS (SELECT k, -1 AS sequence, 'PUT' AS kind, v FROM live UNION ALL SELECT * FROM staged)
SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sequence DESC) AS rn FROM both_) WHERE rn = 1 AND kind = 'PUT'""")
def kv_overlay(spark, d):
    return log.overlay(log.replay(*_log(spark, d)), _staged(spark, d))


@query("kv_cas_batch", _LOG, _LIVE + """, req AS (SELECT k, max(CASE WHEN tx_id % 2 = 0 THEN v END) AS expected, 'swapped:' || k AS next FROM kv_log GROUP BY k)
SELECT r.k, l.v IS NOT DISTINCT FROM expected AS swapped, CASE WHEN l.v IS NOT DISTINCT FROM expected THEN next ELSE l.v END AS v FROM req r LEFT JOIN live l ON r.k = l.k""")
def kv_cas_batch(spark, d):
    rows, commits = _log(spark, d)
    wanted = rows.groupBy("k").agg(F.max(F.when(F.col("tx_id") % 2 == 0, F.col("v"))).alias("expected")).withColumn("next", F.concat(F.lit("swapped:"), "k"))
    return log.compare_and_swap(log.replay(rows, commits), wanted)


@query("counter_running", _LOG, """SELECT k, sequence, delta, CAST(sum(delta) OVER (PARTITION BY k ORDER BY sequence) AS BIGINT) AS value
FROM (SELECT k, sequence, CASE WHEN kind = 'PUT' THEN 1 ELSE -1 END AS delta FROM kv_log)""")
def counter_running(spark, d):
    return log.counters(_log(spark, d)[0].select("k", "sequence", F.when(F.col("kind") == "PUT", 1).otherwise(-1).alias("delta")))


_FEED = """, feed AS (
  SELECT tx_id, row_number() OVER (PARTITION BY tx_id ORDER BY sequence) - 1 AS seq, kind, k,
         CASE WHEN kind = 'PUT' THEN CAST(strlen(v) AS BIGINT) END AS value_len, CASE WHEN kind = 'PUT' THEN sha256(v) END AS value_sha256
  FROM kv_log SEMI JOIN kv_commits USING (tx_id))
"""


@query("cdc_changes", _LOG, _FEED + "SELECT * FROM feed")
def cdc_changes(spark, d):
    return log.changes(*_log(spark, d))


@query("cdc_after", _LOG, _FEED + "SELECT * FROM feed WHERE tx_id > 60 OR (tx_id = 59 AND seq > 1) ORDER BY tx_id, seq LIMIT 500")
def cdc_after(spark, d):
    return log.changes_after(log.changes(*_log(spark, d)), 59, 500, after_seq=1)


@query("cdc_transaction", _LOG, _FEED + "SELECT * FROM feed WHERE tx_id = 77")
def cdc_transaction(spark, d):
    return log.changes_of(log.changes(*_log(spark, d)), 77)


@query("cdc_prune", _LOG, _FEED + "SELECT tx_id, seq FROM feed WHERE tx_id <= 120 ORDER BY tx_id, seq LIMIT 300")
def cdc_prune(spark, d):
    return log.prune(log.changes(*_log(spark, d)), 120, 300).select("tx_id", "seq")


def _domains(spark, d):
    """Keys of several domains: users, sessions and objects."""
    users = log.replay(*_log(spark, d))
    sessions = view(spark, d, "ttl_kv").select("k", "v")
    files = view(spark, d, "objects").select(F.concat(F.lit("object:"), "object_id").alias("k"), F.col("size").cast("string").alias("v"))
    return users.unionByName(sessions).unionByName(files)


_DOMAINS = (*_LOG, "ttl_kv", "objects")
_ALL = ", everything AS (SELECT k, v FROM live UNION ALL SELECT k, v FROM ttl_kv UNION ALL SELECT 'object:' || object_id, CAST(size AS VARCHAR) FROM objects)"
NAMESPACES = ["user", "session", "object", "queue", "job"]


@query("namespace_stats", _DOMAINS, _LIVE + _ALL + """
SELECT ns, count(k) AS n_keys, CAST(coalesce(sum(strlen(v)), 0) AS BIGINT) AS value_bytes
FROM (VALUES ('user'), ('session'), ('object'), ('queue'), ('job')) t(ns) LEFT JOIN everything ON split_part(k, ':', 1) = ns GROUP BY ns""")
def namespace_stats(spark, d):
    return log.namespace_stats(_domains(spark, d), NAMESPACES)


@query("namespace_over_quota", _LOG, _LIVE + _STAGED + """, both_ AS (SELECT k, -1 AS sequence, 'PUT' AS kind, v FROM live UNION ALL SELECT * FROM staged),
after_ AS (SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sequence DESC) AS rn FROM both_) WHERE rn = 1 AND kind = 'PUT')
SELECT 'user' AS ns, CAST(sum(strlen(v)) AS BIGINT) AS value_bytes, CAST(100 AS BIGINT) AS max_bytes FROM after_ HAVING sum(strlen(v)) > 100""")
def namespace_over_quota(spark, d):
    limits = spark.createDataFrame([("user", 100)], "ns string, max_bytes long")
    return log.over_quota(log.replay(*_log(spark, d)), _staged(spark, d), limits)


_STORAGE = """, s AS (
  SELECT (SELECT CAST(sum(strlen(k) + coalesce(strlen(v), 0)) AS BIGINT) FROM kv_log) AS logged_bytes, count(*) AS n_keys,
         CAST(sum(strlen(k)) AS BIGINT) AS key_bytes, CAST(sum(strlen(v)) AS BIGINT) AS value_bytes FROM live)
"""


@query("storage_stats", _LOG, _LIVE + _STORAGE + "SELECT *, logged_bytes / (key_bytes + value_bytes) AS amplification, greatest(logged_bytes - key_bytes - value_bytes, 0) AS backlog_bytes FROM s")
def storage_stats(spark, d):
    rows, commits = _log(spark, d)
    return log.storage_stats(rows, log.replay(rows, commits))


@query("health_alerts", ("queue_messages", *_LOG), _LIVE + f"""
SELECT signal, CAST(value AS DOUBLE) AS value FROM (
  SELECT 'dead' AS signal, count(*) FILTER (state = 'dead') AS value FROM queue_messages
  UNION ALL SELECT 'lag_ms', greatest({EVENTS_NOW} - min(available_at_ms) FILTER (state = 'ready'), 0) FROM queue_messages
  UNION ALL SELECT 'pending', count(DISTINCT tx_id) FROM kv_log ANTI JOIN kv_commits USING (tx_id)) WHERE value > 0""")  # fmt: skip
def health_alerts(spark, d):
    rows, commits = _log(spark, d)
    lag = F.greatest(F.lit(EVENTS_NOW) - F.col("oldest_ready_ms"), F.lit(0)).alias("lag_ms")
    signals = queues.health(view(spark, d, "queue_messages")).select("dead", lag).join(log.verify(rows, commits).select("pending"))
    return log.alerts(signals, {"dead": 0, "lag_ms": 0, "pending": 0})


_RECORDS = ("records", "record_index")


@query("index_range", _RECORDS, "SELECT idx_value, i.pk, v FROM (SELECT * FROM record_index WHERE idx = 'price' AND idx_value >= '000010000000' AND idx_value < '000030000000' ORDER BY idx_value DESC, pk DESC LIMIT 1000) i JOIN records r ON i.pk = r.pk")
def index_range(spark, d):
    wanted = collections.IndexRange(("000010000000", True), ("000030000000", False), descending=True, limit=1000)
    return collections.index_range(view(spark, d, "records"), view(spark, d, "record_index"), "price", wanted)


@query("index_exact", _RECORDS, "SELECT r.pk, v, o_custkey FROM records r JOIN record_index i ON r.pk = i.pk WHERE idx = 'priority' AND idx_value = '1-URGENT'")
def index_exact(spark, d):
    return collections.index_exact(view(spark, d, "records"), view(spark, d, "record_index"), "priority", "1-URGENT")


@query("index_dangling", _RECORDS, "SELECT idx, idx_value, pk FROM record_index ANTI JOIN (SELECT pk FROM records WHERE pk % 97 <> 0) USING (pk)")
def index_dangling(spark, d):
    return collections.dangling(view(spark, d, "records").filter("pk % 97 <> 0"), view(spark, d, "record_index"))


@query("unique_violations", _RECORDS, "SELECT idx_value, count(DISTINCT pk) AS n_owners, min(pk) AS first_pk FROM record_index WHERE idx = 'price' GROUP BY idx_value HAVING count(DISTINCT pk) > 1")
def unique_violations(spark, d):
    return collections.unique_violations(view(spark, d, "record_index"), "price")


@query("upsert_conflicts", _RECORDS, """, incoming AS (SELECT 'price' AS idx, idx_value, pk + 1 AS pk FROM record_index WHERE idx = 'price' AND pk % 10 = 0),
owners AS (SELECT * FROM record_index ANTI JOIN incoming USING (pk) UNION ALL SELECT * FROM incoming)
SELECT DISTINCT w.idx, w.idx_value, w.pk, o.pk AS owner FROM incoming w JOIN owners o ON w.idx = o.idx AND w.idx_value = o.idx_value AND w.pk <> o.pk""")
def upsert_conflicts(spark, d):
    index = view(spark, d, "record_index")
    incoming = index.filter("idx = 'price' and pk % 10 = 0").withColumn("pk", F.col("pk") + 1)
    return collections.upsert_conflicts(index, incoming, ["price"])


@query("collection_scan_shortlex", _RECORDS, "SELECT CAST(pk AS VARCHAR) AS pk, v FROM records")
def collection_scan_shortlex(spark, d):
    return collections.scan(view(spark, d, "records").select(F.col("pk").cast("string").alias("pk"), "v"))


@query("collection_upsert", _RECORDS, "SELECT pk, v, o_custkey FROM records WHERE pk % 10 <> 0 UNION ALL SELECT pk, 'new|' || v, o_custkey FROM records WHERE pk % 10 = 0")
def collection_upsert(spark, d):
    rows = view(spark, d, "records")
    return collections.upsert(rows, rows.filter("pk % 10 = 0").withColumn("v", F.concat(F.lit("new|"), "v")))


@query("collection_upsert_index", _RECORDS, """SELECT idx, idx_value, pk FROM record_index WHERE pk % 10 <> 0
UNION ALL SELECT 'status' AS idx, 'new' AS idx_value, pk FROM records WHERE pk % 10 = 0 UNION ALL SELECT 'price', 'p' || CAST(pk AS VARCHAR), pk FROM records WHERE pk % 10 = 0""")
def collection_upsert_index(spark, d):
    rows, index = view(spark, d, "records"), view(spark, d, "record_index")
    incoming = rows.filter("pk % 10 = 0").withColumn("v", F.concat(F.lit("new|"), "v"))
    entries = incoming.select(F.lit("status").alias("idx"), F.lit("new").alias("idx_value"), "pk").unionByName(incoming.select(F.lit("price").alias("idx"), F.concat(F.lit("p"), F.col("pk").cast("string")).alias("idx_value"), "pk"))
    return collections.upsert_indexed(rows, index, incoming, entries, ["price"])[1]


@query("collection_delete_index", _RECORDS, "SELECT idx, idx_value, pk FROM record_index WHERE pk % 10 <> 3")
def collection_delete_index(spark, d):
    rows, index = view(spark, d, "records"), view(spark, d, "record_index")
    return collections.delete_indexed(rows, index, rows.filter("pk % 10 = 3"))[1]


@query("collection_migrate_index", _RECORDS, "SELECT 'state' AS idx, upper(split_part(v, '|', 1)) AS idx_value, pk FROM records")
def collection_migrate_index(spark, d):
    def entries(moved):
        return moved.select(F.lit("state").alias("idx"), F.substring_index("v", "|", 1).alias("idx_value"), "pk")

    return collections.migrate_collection(view(spark, d, "records"), view(spark, d, "record_index"), 2, 2, 3, F.upper, entries)[1]


@query("collection_migrate_report", _RECORDS, "SELECT count(*) AS records_seen, count(*) AS records_migrated, (count(*) + 499) // 500 AS batches_committed, false AS dry_run, 3 AS version FROM records")
def collection_migrate_report(spark, d):
    return collections.migrate_collection(view(spark, d, "records"), view(spark, d, "record_index"), 2, 2, 3, F.upper, batch_size=500)[2]


@query("schema_migrate", (), """WITH q AS (SELECT p_partkey AS name, p_size AS version, p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS expected, p_size + p_partkey % 4 AS next FROM part WHERE p_partkey % 9 <> 0
  UNION ALL SELECT -p_partkey - 1, NULL, 1, 2 FROM part WHERE p_partkey % 50 = 0)
SELECT name, CASE WHEN version IS NULL THEN 'not_found' WHEN version <> expected THEN 'conflict' WHEN next <= expected THEN 'invalid' ELSE 'migrated' END AS outcome,
       CASE WHEN version = expected AND next > expected THEN next ELSE version END AS version FROM q""")
def schema_migrate(spark, d):
    part = table(spark, d, "part")
    defined = part.select(F.col("p_partkey").alias("name"), F.col("p_size").alias("version"))
    asked = part.filter("p_partkey % 9 <> 0").selectExpr("p_partkey AS name", "p_size + IF(p_partkey % 3 = 0, 1, 0) AS expected", "p_size + p_partkey % 4 AS next")
    unknown = part.filter("p_partkey % 50 = 0").selectExpr("-p_partkey - 1 AS name", "1 AS expected", "2 AS next")
    return collections.migrate_schema(defined, asked.unionByName(unknown))


@query("collection_migrate", _RECORDS, "SELECT pk, upper(v) AS v, o_custkey FROM records")
def collection_migrate(spark, d):
    return collections.migrate(view(spark, d, "records"), F.upper)


@query("schema_contiguity", (), """, h AS (SELECT p_brand AS name, p_size AS from_version, min(p_size + 1 + p_partkey % 2) AS to_version FROM part GROUP BY ALL)
SELECT *, to_version > from_version AND coalesce(lag(to_version) OVER (PARTITION BY name ORDER BY from_version, to_version) = from_version, lag(to_version) OVER (PARTITION BY name ORDER BY from_version, to_version) IS NULL) AS contiguous FROM h""".replace(", h AS", "WITH h AS", 1))
def schema_contiguity(spark, d):
    steps = table(spark, d, "part").groupBy(F.col("p_brand").alias("name"), F.col("p_size").alias("from_version")).agg(F.min(F.col("p_size") + 1 + F.col("p_partkey") % 2).alias("to_version"))
    return collections.migration_steps(steps)


_QUEUE = ("queue_messages",)
_ELIGIBLE = "((state = 'ready' AND available_at_ms <= {now}) OR (state = 'leased' AND lease_until_ms <= {now}))"


@query("queue_claim", _QUEUE, f"""SELECT queue, id, 'leased' AS state, priority, attempts + 1 AS attempts, available_at_ms, CAST({EVENTS_NOW + 30000} AS BIGINT) AS lease_until_ms, payload, claim
FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY priority DESC, id) AS claim FROM queue_messages WHERE {_ELIGIBLE.format(now=EVENTS_NOW)}) WHERE claim <= 3""")  # fmt: skip
def queue_claim(spark, d):
    return queues.claim(view(spark, d, "queue_messages"), EVENTS_NOW, 30_000, 3)


@query("queue_settle", _QUEUE, """, c AS (SELECT *, CASE id % 4 WHEN 0 THEN 'ack' WHEN 1 THEN 'nack' WHEN 2 THEN 'dead' END AS cmd, CASE WHEN id % 5 = 0 THEN attempts + 1 ELSE attempts END AS gen FROM queue_messages),
h AS (SELECT *, state = 'leased' AND cmd IS NOT NULL AND gen = attempts AS hit FROM c)
SELECT queue, id, CASE WHEN hit AND cmd = 'nack' THEN 'ready' WHEN hit AND cmd = 'dead' THEN 'dead' ELSE state END AS state, priority, attempts,
       CASE WHEN hit AND cmd = 'nack' THEN CAST(5 AS BIGINT) ELSE available_at_ms END AS available_at_ms, CASE WHEN hit THEN 0 ELSE lease_until_ms END AS lease_until_ms, payload
FROM h WHERE NOT (hit AND cmd = 'ack')""")
def queue_settle(spark, d):
    rows = view(spark, d, "queue_messages")
    name = F.when(F.col("id") % 4 == 0, "ack").when(F.col("id") % 4 == 1, "nack").when(F.col("id") % 4 == 2, "dead")
    commands = rows.select("queue", "id", F.when(F.col("id") % 5 == 0, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("generation"), name.alias("command"), F.lit(5).cast("long").alias("at_ms"))
    return queues.settle(rows, commands.filter("command is not null"))


@query("queue_push", _QUEUE, """SELECT queue, coalesce(last, 0) + place AS id, 'ready' AS state, prio AS priority, CAST(0 AS BIGINT) AS attempts, CAST(0 AS BIGINT) AS available_at_ms, CAST(0 AS BIGINT) AS lease_until_ms, payload FROM (
  SELECT CASE WHEN conv_id % 2 = 0 THEN 'view' ELSE 'fresh' END AS queue, turn AS prio, text AS payload, row_number() OVER (PARTITION BY conv_id % 2 ORDER BY conv_id * 100 + turn) AS place FROM conversations)
LEFT JOIN (SELECT queue, max(id) AS last FROM queue_messages GROUP BY queue) USING (queue)""")
def queue_push(spark, d):
    new = table(spark, d, "conversations").select(
        F.when(F.col("conv_id") % 2 == 0, "view").otherwise("fresh").alias("queue"), F.col("turn").alias("priority"), F.col("text").alias("payload"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("at"), F.lit(None).cast("long").alias("available_at_ms"),
    )
    return queues.push(view(spark, d, "queue_messages"), new, "at")


_QUEUE_COUNTS = "count(*) FILTER (state = 'ready') AS ready, count(*) FILTER (state = 'leased') AS leased, count(*) FILTER (state = 'dead') AS dead, count(*) AS total, min(available_at_ms) FILTER (state = 'ready') AS oldest_ready_ms FROM queue_messages"


@query("queue_stats", _QUEUE, f"SELECT queue, {_QUEUE_COUNTS} GROUP BY queue")
def queue_stats(spark, d):
    return queues.stats(view(spark, d, "queue_messages"))


@query("queue_health", _QUEUE, f"SELECT {_QUEUE_COUNTS}")
def queue_health(spark, d):
    return queues.health(view(spark, d, "queue_messages"))


@query("queue_lag", _QUEUE, f"SELECT queue, greatest({EVENTS_NOW} - min(available_at_ms) FILTER (state = 'ready'), 0) AS lag_ms FROM queue_messages GROUP BY queue")
def queue_lag(spark, d):
    return queues.lag(view(spark, d, "queue_messages"), EVENTS_NOW)


@query("queue_purge_dead", _QUEUE, "SELECT queue, count(*) AS n_purged FROM queue_messages WHERE state = 'dead' GROUP BY queue")
def queue_purge_dead(spark, d):
    return queues.purge_dead(view(spark, d, "queue_messages"))


_JOBS = ("jobs",)
_DELAY = "CAST((retry_backoff_ms * greatest(attempts, 1) * (91 + ((list_sum(list_transform(range(1, 17), lambda i: ascii(substr(id, CAST(i AS BIGINT), 1)))) + attempts) % 256) % 20)) // 100 AS BIGINT)"


@query("job_retry_delay", _JOBS, f"SELECT id, {_DELAY} AS delay_ms FROM jobs")
def job_retry_delay(spark, d):
    return jobs.retry_delays(view(spark, d, "jobs"))


_RECLAIMABLE = f"(state = 'ready' OR (state = 'leased' AND lease_until_ms <= {ORDERS_NOW}))"
_HANDLERS = ["1-URGENT", "2-HIGH", "5-LOW"]


@query("job_claim", _JOBS, f"""SELECT id, handler, priority, attempts < max_attempts AS claimed, CASE WHEN attempts < max_attempts THEN 'leased' ELSE 'dead' END AS state, attempts + 1 AS attempts,
  CAST(CASE WHEN attempts < max_attempts THEN {ORDERS_NOW + 60000} ELSE 0 END AS BIGINT) AS lease_until_ms, CASE WHEN attempts >= max_attempts THEN 'max attempts exceeded' END AS detail
FROM (SELECT * FROM jobs WHERE {_RECLAIMABLE} AND (state = 'leased' OR available_at_ms <= {ORDERS_NOW}) AND coalesce(deadline_ms > {ORDERS_NOW}, true) AND handler IN ('1-URGENT', '2-HIGH', '5-LOW')
  ORDER BY priority DESC, available_at_ms, id LIMIT 60)""")  # fmt: skip
def job_claim(spark, d):
    """Sixty claims in a row."""
    return jobs.claim(view(spark, d, "jobs"), ORDERS_NOW, 60_000, _HANDLERS, claims=60).select("id", "handler", "priority", "claimed", "state", "attempts", "lease_until_ms", "detail")


@query("job_deadline_dead", _JOBS, f"SELECT id, 'dead' AS state, 0 AS lease_until_ms, 'deadline exceeded' AS detail FROM jobs WHERE {_RECLAIMABLE} AND deadline_ms <= {ORDERS_NOW}")
def job_deadline_dead(spark, d):
    return jobs.expired(view(spark, d, "jobs"), ORDERS_NOW).select("id", "state", "lease_until_ms", "detail")


@query("job_reap", _JOBS, f"""SELECT id, CASE WHEN attempts >= max_attempts THEN 'dead' ELSE 'ready' END AS state, 0 AS lease_until_ms, CASE WHEN attempts >= max_attempts THEN available_at_ms ELSE {ORDERS_NOW} END AS available_at_ms,
  CASE WHEN attempts >= max_attempts THEN 'lease expired: max attempts exhausted' ELSE 'lease expired' END AS detail FROM jobs WHERE state = 'leased' AND lease_until_ms <= {ORDERS_NOW}""")  # fmt: skip
def job_reap(spark, d):
    return jobs.reap(view(spark, d, "jobs"), ORDERS_NOW).select("id", "state", "lease_until_ms", "available_at_ms", "detail")


@query("job_fail", _JOBS, f"SELECT id, CASE WHEN attempts >= max_attempts THEN 'dead' ELSE 'ready' END AS state, CASE WHEN attempts >= max_attempts THEN available_at_ms ELSE {ORDERS_NOW} + {_DELAY} END AS available_at_ms, 0 AS lease_until_ms FROM jobs WHERE state = 'leased'")
def job_fail(spark, d):
    return jobs.fail(view(spark, d, "jobs"), ORDERS_NOW).select("id", "state", "available_at_ms", "lease_until_ms")


@query("job_settle", _JOBS, f""", c AS (SELECT *, CASE CAST(id AS BIGINT) % 7 WHEN 0 THEN 'complete' WHEN 1 THEN 'fail' WHEN 2 THEN 'release' WHEN 3 THEN 'heartbeat' WHEN 4 THEN 'retry' WHEN 5 THEN 'cancel' END AS cmd FROM jobs)
SELECT id, CASE WHEN state = 'leased' AND cmd = 'complete' THEN 'completed' WHEN state = 'leased' AND cmd = 'release' THEN 'ready' WHEN state = 'leased' AND cmd = 'fail' AND attempts >= max_attempts THEN 'dead'
  WHEN state = 'leased' AND cmd = 'fail' THEN 'ready' WHEN cmd = 'retry' AND state = 'dead' THEN 'ready' WHEN cmd = 'cancel' AND state IN ('ready', 'leased') THEN 'cancelled' ELSE state END AS state,
  CASE WHEN cmd = 'retry' AND state = 'dead' THEN 0 ELSE attempts END AS attempts,
  CASE WHEN (state = 'leased' AND cmd = 'release') OR (cmd = 'retry' AND state = 'dead') THEN {ORDERS_NOW} WHEN state = 'leased' AND cmd = 'fail' AND attempts < max_attempts THEN {ORDERS_NOW} + {_DELAY} ELSE available_at_ms END AS available_at_ms,
  CASE WHEN state = 'leased' AND cmd = 'heartbeat' THEN {ORDERS_NOW + 5000} WHEN (state = 'leased' AND cmd IN ('complete', 'fail', 'release', 'cancel')) OR (state = 'ready' AND cmd = 'cancel') OR (state = 'dead' AND cmd = 'retry') THEN 0 ELSE lease_until_ms END AS lease_until_ms FROM c""")  # fmt: skip
def job_settle(spark, d):
    rows = view(spark, d, "jobs")
    name = F.get(F.array(*map(F.lit, ["complete", "fail", "release", "heartbeat", "retry", "cancel"])), (F.col("id").cast("long") % 7).cast("int"))
    commands = rows.select("id", name.alias("command"), F.col("attempts").alias("generation"), F.lit(ORDERS_NOW + 5000).cast("long").alias("until_ms")).filter("command is not null")
    return jobs.settle(rows, commands, ORDERS_NOW).select("id", "state", "attempts", "available_at_ms", "lease_until_ms")


@query("job_idempotent", _JOBS, """, a AS (SELECT idempotency_key, min(id) AS reuses FROM jobs WHERE state IN ('ready', 'leased') GROUP BY 1),
s AS (SELECT c_custkey AS spec_id, 'cust:' || CAST(c_custkey // 2 AS VARCHAR) AS idempotency_key FROM customer)
SELECT spec_id, s.idempotency_key, reuses, reuses IS NULL AND spec_id = min(spec_id) OVER (PARTITION BY s.idempotency_key) AS is_new FROM s LEFT JOIN a USING (idempotency_key)""")
def job_idempotent(spark, d):
    specs = table(spark, d, "customer").select(F.col("c_custkey").alias("spec_id"), F.concat(F.lit("cust:"), F.floor(F.col("c_custkey") / 2).cast("string")).alias("idempotency_key"))
    return jobs.submit(view(spark, d, "jobs"), specs)


@query("job_list", _JOBS, "SELECT id, available_at_ms FROM jobs")
def job_list(spark, d):
    return jobs.listing(view(spark, d, "jobs")).select("id", "available_at_ms")


@query("job_stats", _JOBS, "SELECT " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in jobs.STATES) + ", count(*) AS total FROM jobs")
def job_stats(spark, d):
    return jobs.stats(view(spark, d, "jobs"))


@query("job_history", (), "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS sequence FROM lineitem")
def job_history(spark, d):
    steps = table(spark, d, "lineitem").withColumn("at", F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return jobs.history(steps, "l_orderkey", "at").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "sequence")


_STREAMS = ("stream_entries", "subscription_acks")


@query("stream_read", _STREAMS, "SELECT stream_offset, conv_id, turn FROM stream_entries WHERE stream = 'user' AND stream_offset >= 50 ORDER BY stream_offset LIMIT 100")
def stream_read(spark, d):
    return messaging.read_from(view(spark, d, "stream_entries"), "user", 50, 100).select("stream_offset", "conv_id", "turn")


@query("stream_tail", _STREAMS, "SELECT stream, max(stream_offset) AS tail_offset FROM stream_entries GROUP BY stream")
def stream_tail(spark, d):
    return messaging.tail(view(spark, d, "stream_entries"))


@query("stream_append", _STREAMS, """SELECT stream, coalesce(last, -1) + place AS stream_offset, payload FROM (
  SELECT CASE WHEN event_type = 'error' THEN 'system' ELSE event_type END AS stream, props AS payload, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS place FROM events)
LEFT JOIN (SELECT stream, max(stream_offset) AS last FROM stream_entries GROUP BY stream) USING (stream)""")
def stream_append(spark, d):
    new = table(spark, d, "events").select(F.when(F.col("event_type") == "error", "system").otherwise(F.col("event_type")).alias("stream"), F.col("props").alias("payload"), "event_id")
    return messaging.append(view(spark, d, "stream_entries"), new, "event_id")


@query("topic_poll", _STREAMS, """SELECT stream, subscription, stream_offset, payload FROM subscription_acks JOIN stream_entries USING (stream)
WHERE stream_offset > acked_through AND stream_offset <= acked_through + 5""")
def topic_poll(spark, d):
    cursors = messaging.cursors(view(spark, d, "subscription_acks"))
    return messaging.poll(view(spark, d, "stream_entries"), cursors, 5).select("stream", "subscription", "stream_offset", "payload")


@query("subscription_reset", _STREAMS, """SELECT stream, subscription, CASE WHEN subscription = 'sub1' THEN 0 ELSE max(acked_through) + 1 END AS next_offset FROM subscription_acks GROUP BY stream, subscription
UNION ALL SELECT DISTINCT stream, 'fresh', 9 FROM stream_entries""")
def subscription_reset(spark, d):
    cursors = messaging.cursors(view(spark, d, "subscription_acks"))
    back = cursors.filter("subscription = 'sub1'").withColumn("next_offset", F.lit(0).cast("long"))
    fresh = view(spark, d, "stream_entries").select("stream").distinct().select("stream", F.lit("fresh").alias("subscription"), F.lit(9).cast("long").alias("next_offset"))
    return messaging.reset(cursors, back.unionByName(fresh))


@query("cursor_regression", (), """SELECT event_id, acked_through, before FROM (
  SELECT event_id, CAST(floor(value) AS BIGINT) AS acked_through, max(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY event_type, user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)
WHERE acked_through < before""")
def cursor_regression(spark, d):
    acks = table(spark, d, "events").select(F.col("event_type").alias("stream"), F.col("user_id").cast("string").alias("subscription"), F.floor("value").cast("long").alias("acked_through"), "event_id")
    return messaging.cursor_regressions(acks, "event_id").select("event_id", "acked_through", "before")


def _group_commands(spark, d):
    """Claims, acks, nacks and resets made of events: two consumers, leases of a day."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_id") % 11 == 10, "reset").when(F.col("event_id") % 3 == 0, "claim").when(F.col("event_id") % 3 == 1, "ack").otherwise("nack")
    return e.select(
        F.lit("user").alias("stream"), F.concat(F.lit("g"), (F.col("user_id") % 40).cast("string")).alias("grp"), F.col("event_id").alias("seq"), kind.alias("command"),
        F.concat(F.lit("w"), (F.col("event_id") % 2).cast("string")).alias("consumer"), F.unix_millis(F.col("ts").cast("timestamp")).alias("now_ms"),
        F.lit(86_400_000).cast("long").alias("lease_ms"), (F.col("event_id") % 4).alias("generation"), (F.col("event_id") % 3).alias("stream_offset"),
    )


_GROUP_SQL = """
WITH RECURSIVE t AS (SELECT count(*) - 1 AS tail FROM conversations WHERE role = 'user'),
c AS (
  SELECT 'g' || CAST(user_id % 40 AS VARCHAR) AS grp, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS rn,
         CASE WHEN event_id % 11 = 10 THEN 'reset' WHEN event_id % 3 = 0 THEN 'claim' WHEN event_id % 3 = 1 THEN 'ack' ELSE 'nack' END AS cmd,
         'w' || CAST(event_id % 2 AS VARCHAR) AS consumer, epoch_us(ts) // 1000 AS now_ms, event_id % 4 AS gen, event_id % 3 AS off FROM events),
r AS (
  SELECT DISTINCT grp, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS nxt, CAST(NULL AS BIGINT) AS leased, CAST(0 AS BIGINT) AS until, CAST(0 AS BIGINT) AS generation, CAST(NULL AS VARCHAR) AS owner FROM c
  UNION ALL
  SELECT grp, rn, CASE WHEN acks THEN leased + 1 WHEN cmd = 'reset' THEN off ELSE nxt END, CASE WHEN takes THEN nxt WHEN frees THEN NULL ELSE leased END,
         CASE WHEN takes THEN now_ms + 86400000 WHEN frees THEN 0 ELSE until END, generation + CASE WHEN takes THEN 1 ELSE 0 END, CASE WHEN takes THEN consumer WHEN frees THEN NULL ELSE owner END
  FROM (SELECT *, cmd = 'ack' AND ours AS acks, cmd = 'claim' AND NOT busy AND nxt <= tail AS takes, (cmd = 'claim' AND NOT busy AND nxt > tail) OR (cmd IN ('ack', 'nack') AND ours) OR cmd = 'reset' AS frees
    FROM (SELECT c.*, nxt, leased, until, generation, owner, tail, leased IS NOT NULL AND until > now_ms AS busy, coalesce(owner = consumer AND generation = gen AND leased = off, false) AS ours
      FROM r JOIN c ON c.grp = r.grp AND c.rn = r.rn + 1, t)))
SELECT 'user' AS stream, grp, nxt AS next_offset, leased AS leased_offset, until AS lease_until_ms, generation, owner
FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rn DESC) AS k FROM r) WHERE k = 1"""


@query("group_fold", (), _GROUP_SQL)
def group_fold(spark, d):
    return messaging.group_fold(_group_commands(spark, d), messaging.tail(view(spark, d, "stream_entries")))


_RPC = ("rpc_requests", "rpc_responses")


@query("rpc_pending", _RPC, "SELECT tx_id, created_at_ms FROM rpc_requests ANTI JOIN rpc_responses USING (tx_id) WHERE tx_id > 1000")
def rpc_pending(spark, d):
    return rpc.pending(view(spark, d, "rpc_requests"), view(spark, d, "rpc_responses"), after=1000).select("tx_id", "created_at_ms")


@query("rpc_expire", _RPC, f"SELECT tx_id, 'deadline exceeded' AS payload, CAST({STATE_NOW} AS BIGINT) AS completed_at_ms, true AS is_error FROM rpc_requests ANTI JOIN rpc_responses USING (tx_id) WHERE deadline_ms <= {STATE_NOW}")
def rpc_expire(spark, d):
    return rpc.expire(view(spark, d, "rpc_requests"), view(spark, d, "rpc_responses"), STATE_NOW)


@query("rpc_expire_limit", _RPC, f"SELECT tx_id, 'deadline exceeded' AS payload, CAST({STATE_NOW} AS BIGINT) AS completed_at_ms, true AS is_error FROM rpc_requests ANTI JOIN rpc_responses USING (tx_id) WHERE deadline_ms <= {STATE_NOW} ORDER BY tx_id LIMIT 25")
def rpc_expire_limit(spark, d):
    return rpc.expire(view(spark, d, "rpc_requests"), view(spark, d, "rpc_responses"), STATE_NOW, 25)


@query("rpc_respond", _RPC, """, a AS (SELECT conv_id * 100 + turn AS answer_id, conv_id * 100 + turn - turn % 3 AS tx_id FROM conversations)
SELECT answer_id, tx_id, CASE WHEN tx_id IN (SELECT tx_id FROM rpc_responses) THEN 'already_responded' WHEN tx_id NOT IN (SELECT tx_id FROM rpc_requests) THEN 'not_found'
  WHEN row_number() OVER (PARTITION BY tx_id ORDER BY answer_id) > 1 THEN 'already_responded' ELSE 'responded' END AS outcome FROM a""")
def rpc_respond(spark, d):
    answers = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), (F.col("conv_id") * 100 + F.col("turn") - F.col("turn") % 3).alias("tx_id"))
    return rpc.respond(view(spark, d, "rpc_requests"), view(spark, d, "rpc_responses"), answers)


@query("rpc_ack", _RPC, "SELECT tx_id, completed_at_ms FROM rpc_responses WHERE tx_id % 7 <> 0")
def rpc_ack(spark, d):
    rows = view(spark, d, "rpc_responses")
    return rpc.ack(rows, rows.filter("tx_id % 7 = 0")).select("tx_id", "completed_at_ms")


@query("outbox_ack", ("outbox",), "SELECT tx_id, seq_in_tx, topic FROM outbox WHERE NOT acked AND tx_id % 3 <> 0")
def outbox_ack(spark, d):
    rows = view(spark, d, "outbox")
    return rpc.outbox_ack(rows, rows.filter("tx_id % 3 = 0")).select("tx_id", "seq_in_tx", "topic")


@query("outbox_len", ("outbox",), "SELECT count(*) FILTER (NOT acked) AS n FROM outbox")
def outbox_len(spark, d):
    return rpc.outbox_len(view(spark, d, "outbox"))


@query("rpc_roundtrip", _RPC, "SELECT q.tx_id, completed_at_ms - created_at_ms AS latency_ms, CAST(strlen(r.payload) AS BIGINT) AS response_bytes FROM rpc_requests q JOIN rpc_responses r ON q.tx_id = r.tx_id")
def rpc_roundtrip(spark, d):
    return rpc.roundtrips(view(spark, d, "rpc_requests"), view(spark, d, "rpc_responses"))


@query("outbox_pending", ("outbox",), "SELECT tx_id, seq_in_tx, topic, payload FROM outbox WHERE NOT acked AND tx_id > 10 ORDER BY tx_id, seq_in_tx LIMIT 1000")
def outbox_pending(spark, d):
    return rpc.outbox_pending(view(spark, d, "outbox"), 10, 1000).select("tx_id", "seq_in_tx", "topic", "payload")


_OBJECTS = ("objects", "object_refs")


@query("object_dedup", (), "SELECT sha256(text) AS object_id, CAST(max(strlen(text)) AS BIGINT) AS size, count(*) AS copies, min(doc_id) AS first_writer FROM documents GROUP BY 1")
def object_dedup(spark, d):
    return objects.deduplicate(table(spark, d, "documents"), "text", "doc_id")


@query("object_chunks", (), "SELECT doc_id, i AS chunk, sha256(encode(text)[i * 1000 + 1 : i * 1000 + 1000]) AS data_sha256 FROM (SELECT doc_id, text, unnest(range(0, (strlen(text) + 999) // 1000)) AS i FROM documents)")
def object_chunks(spark, d):
    return objects.chunks(table(spark, d, "documents").withColumn("text", F.col("text").cast("binary")), "doc_id", "text", 1000).select("doc_id", "chunk", F.sha2("data", 256).alias("data_sha256"))


@query("object_refs_prefix", _OBJECTS, "SELECT name, object_id FROM object_refs WHERE namespace = 'src3' AND name LIKE '00000000%'")
def object_refs_prefix(spark, d):
    return objects.refs_by_prefix(view(spark, d, "object_refs"), "src3", "00000000").select("name", "object_id")


@query("object_gc", _OBJECTS, "SELECT object_id, size FROM objects ANTI JOIN object_refs USING (object_id)")
def object_gc(spark, d):
    return objects.orphans(view(spark, d, "objects"), view(spark, d, "object_refs")).select("object_id", "size")


@query("object_retention", _OBJECTS, """, o AS (SELECT *, object_id IN (SELECT object_id FROM object_refs) AS named, expires_at_unix <= 1700000600 AS old FROM objects)
SELECT count(*) AS scanned, count(*) FILTER (old) AS expired, count(*) FILTER (old AND named) AS referenced, count(*) FILTER (old AND NOT named) AS removed FROM o""")
def object_retention(spark, d):
    return objects.retention(view(spark, d, "objects"), view(spark, d, "object_refs"), 1_700_000_600)


@query("object_chunk", (), "SELECT doc_id, sha256(encode(text)[101:350]) AS data_sha256 FROM documents")
def object_chunk(spark, d):
    return objects.chunk(table(spark, d, "documents"), "text", 100, 250).select("doc_id", F.sha2("text", 256).alias("data_sha256"))


@query("object_gc_report", _OBJECTS, "SELECT (SELECT count(*) FROM objects) AS scanned, (SELECT count(DISTINCT object_id) FROM object_refs) AS referenced, least(50, (SELECT count(*) FROM objects ANTI JOIN object_refs USING (object_id))) AS removed")
def object_gc_report(spark, d):
    return objects.gc_report(view(spark, d, "objects"), view(spark, d, "object_refs"), 50)


_TTL = ("ttl_kv",)


@query("ttl_put", _TTL, """SELECT k, CASE WHEN CAST(substr(k, 9) AS BIGINT) % 6 = 0 THEN 'new:' || v ELSE v END AS v, CASE WHEN CAST(substr(k, 9) AS BIGINT) % 6 = 0 THEN 7 ELSE expires_at_ms END AS expires_at_ms FROM ttl_kv""")
def ttl_put(spark, d):
    kv = view(spark, d, "ttl_kv")
    puts = kv.filter("CAST(substring(k, 9) AS BIGINT) % 6 = 0").select("k", F.concat(F.lit("new:"), "v").alias("v"), F.lit(7).cast("long").alias("expires_at_ms"))
    return ttl.put_with_ttl(kv.withColumn("expires_at_ms", F.col("expires_at_ms").cast("long")), puts)


@query("ttl_clear", _TTL, """SELECT k, v, CASE WHEN CAST(substr(k, 9) AS BIGINT) % 5 <> 0 THEN expires_at_ms END AS expires_at_ms, CAST(substr(k, 9) AS BIGINT) % 5 = 0 AND expires_at_ms IS NOT NULL AS cleared FROM ttl_kv""")
def ttl_clear(spark, d):
    kv = view(spark, d, "ttl_kv")
    return ttl.clear_ttl(kv, kv.filter("CAST(substring(k, 9) AS BIGINT) % 5 = 0"))


@query("ttl_visible", _TTL, f"SELECT k, v, expires_at_ms FROM ttl_kv WHERE expires_at_ms IS NULL OR expires_at_ms > {STATE_NOW}")
def ttl_visible(spark, d):
    return ttl.visible(view(spark, d, "ttl_kv"), STATE_NOW)


@query("ttl_purge", _TTL, f"SELECT k, expires_at_ms FROM ttl_kv WHERE expires_at_ms <= {STATE_NOW} ORDER BY strlen(k), k LIMIT 200")
def ttl_purge(spark, d):
    return ttl.purge(view(spark, d, "ttl_kv"), STATE_NOW, 200).select("k", "expires_at_ms")


@query("ttl_purge_report", _TTL, f"SELECT (SELECT count(*) FROM ttl_kv WHERE expires_at_ms IS NOT NULL) AS scanned, count(*) AS expired, count(*) FILTER (CAST(substr(k, 9) AS BIGINT) % 7 <> 0) AS removed FROM ttl_kv WHERE expires_at_ms <= {STATE_NOW}")
def ttl_purge_report(spark, d):
    kv = view(spark, d, "ttl_kv")
    state = kv.filter("CAST(substring(k, 9) AS BIGINT) % 7 <> 0").select("k", "v")
    return ttl.purge_report(kv.filter("expires_at_ms is not null").select("k", "expires_at_ms"), state, STATE_NOW, 2**31 - 1)


_FLOW = ("workflows", "workflow_history")


@query("workflow_children", ("workflows",), """SELECT parent_id AS id, count(*) AS n_children, count(*) FILTER (status IN ('running', 'waiting')) AS n_open, first(id ORDER BY created_at_ms, id) AS oldest
FROM workflows WHERE parent_id IS NOT NULL GROUP BY parent_id""")
def workflow_children(spark, d):
    return workflows.children(view(spark, d, "workflows"))


@query("workflow_due", ("workflows",), f"SELECT id, 'running' AS status, resume_at_ms FROM workflows WHERE status = 'waiting' AND resume_at_ms <= {ORDERS_NOW} ORDER BY id LIMIT 500")
def workflow_due(spark, d):
    return workflows.due(view(spark, d, "workflows"), ORDERS_NOW, 500).select("id", "status", "resume_at_ms")


@query("workflow_signals", ("workflows",), "SELECT id, 'running' AS status, o_comment AS state FROM workflows JOIN (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'other' ELSE o_orderpriority END AS signal_name, o_orderstatus AS o_comment FROM orders) USING (id, signal_name) WHERE status = 'waiting'")
def workflow_signals(spark, d):
    sent = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "other").otherwise(F.col("o_orderpriority")).alias("signal_name"), F.col("o_orderstatus").alias("payload"))
    return workflows.signals(view(spark, d, "workflows"), sent)


@query("workflow_history_seq", _FLOW, "SELECT conv_id AS workflow_id, turn AS at_ms, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS sequence FROM conversations")
def workflow_history_seq(spark, d):
    return workflows.numbered(view(spark, d, "workflow_history").select("workflow_id", "at_ms"), "workflow_id", "at_ms")


@query("workflow_history_gaps", _FLOW, """, h AS (SELECT * FROM workflow_history WHERE (workflow_id + sequence) % 5 <> 0)
SELECT workflow_id, count(*) AS n FROM h GROUP BY 1 HAVING min(sequence) <> 0 OR max(sequence) <> count(*) - 1 OR count(DISTINCT sequence) <> count(*)""")
def workflow_history_gaps(spark, d):
    return workflows.history_gaps(view(spark, d, "workflow_history").filter("(workflow_id + sequence) % 5 <> 0"))


_FLOW_SQL = """
WITH RECURSIVE c AS (
  SELECT conv_id AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, turn * 10 AS at_ms, sha256(text) AS payload,
         ['create', 'wait_signal', 'signal', 'set_step', 'wait_until', 'resume', 'complete', 'cancel'][turn + 1] AS cmd FROM conversations),
r AS (
  SELECT DISTINCT id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS step, CAST(NULL AS VARCHAR) AS state, CAST(NULL AS VARCHAR) AS signal, CAST(NULL AS BIGINT) AS resume_at_ms, CAST(0 AS BIGINT) AS events FROM c
  UNION ALL
  SELECT id, rn, CASE WHEN did IN ('create', 'set_step', 'signal', 'resume') THEN 'running' WHEN did IN ('wait_signal', 'wait_until') THEN 'waiting' WHEN did = 'complete' THEN 'completed' WHEN did = 'cancel' THEN 'cancelled' ELSE status END,
         CASE WHEN did IN ('create', 'set_step') THEN 'go' ELSE step END, CASE WHEN did IN ('create', 'set_step', 'signal', 'complete') THEN payload ELSE state END,
         CASE WHEN did = 'wait_signal' THEN 'go' WHEN did IS NOT NULL THEN NULL ELSE signal END, CASE WHEN did = 'wait_until' THEN at_ms WHEN did IS NOT NULL THEN NULL ELSE resume_at_ms END,
         events + CASE WHEN did IS NULL THEN 0 ELSE 1 END
  FROM (SELECT *, CASE WHEN cmd = 'create' THEN CASE WHEN status IS NULL THEN cmd END WHEN NOT coalesce(status IN ('running', 'waiting'), false) THEN NULL
          WHEN cmd = 'signal' THEN CASE WHEN signal = 'go' THEN cmd END WHEN cmd = 'resume' THEN CASE WHEN resume_at_ms <= at_ms THEN cmd END ELSE cmd END AS did
    FROM (SELECT c.*, status, step, state, signal, resume_at_ms, events FROM r JOIN c ON c.id = r.id AND c.rn = r.rn + 1)))
SELECT id, status, step, state, signal, resume_at_ms, events FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rn DESC) AS k FROM r) WHERE k = 1"""


@query("workflow_fold", (), _FLOW_SQL)
def workflow_fold(spark, d):
    """Commands made of conversations: each turn is a command on its conversation's workflow."""
    c = table(spark, d, "conversations")
    kinds = ["create", "wait_signal", "signal", "set_step", "wait_until", "resume", "complete", "cancel"]
    name = F.get(F.array(*map(F.lit, kinds)), F.col("turn").cast("int"))
    return workflows.fold(c.select(F.col("conv_id").alias("id"), F.col("turn").alias("seq"), name.alias("command"), F.lit("go").alias("name"), F.sha2("text", 256).alias("payload"), (F.col("turn") * 10).alias("at_ms")))


_SCHEDULES = ("schedules",)


@query("schedule_tick", _SCHEDULES, f"""SELECT id, handler, next_run_ms AS fired_at_ms, CASE WHEN mode = 'once' THEN next_run_ms ELSE next_run_ms + (({STATE_NOW} - next_run_ms) // every_ms + 1) * every_ms END AS next_run_ms, mode <> 'once' AS enabled
FROM (SELECT * FROM schedules WHERE enabled AND next_run_ms <= {STATE_NOW} ORDER BY id LIMIT 400)""")  # fmt: skip
def schedule_tick(spark, d):
    return schedules.tick(view(spark, d, "schedules"), STATE_NOW, 400)


@query("schedule_due", _SCHEDULES, f"SELECT id, next_run_ms FROM schedules WHERE enabled AND next_run_ms <= {STATE_NOW}")
def schedule_due(spark, d):
    return view(spark, d, "schedules").filter(F.col("enabled") & due(F.col("next_run_ms"), STATE_NOW)).select("id", "next_run_ms")


@query("cron_match", (), "SELECT event_id FROM events WHERE minute(ts) % 15 = 0 AND hour(ts) BETWEEN 9 AND 17 AND month(ts) BETWEEN 1 AND 5 AND (day(ts) IN (1, 6) OR dayofweek(ts) BETWEEN 1 AND 5)")
def cron_match(spark, d):
    return schedules.cron_matches(table(spark, d, "events"), "*/15 9-17 1,6 1-5 1-5").select("event_id")


@query("cron_next", (), """SELECT event_id, min(t) AS next_fire FROM (SELECT event_id, ts, unnest(range(0, 15)) AS i, unnest(range(0, 15)) AS j FROM events) e,
LATERAL (SELECT date_trunc('day', ts) + INTERVAL (i) DAY + INTERVAL 30 MINUTE + INTERVAL 6 HOUR AS t) x WHERE t > ts AND (day(t) = 13 OR dayofweek(t) = 5) GROUP BY event_id""")
def cron_next(spark, d):
    found = schedules.cron_next(table(spark, d, "events"), "30 6 13 * 5", days=15)
    return found.select("event_id", F.col("next_fire").cast("timestamp_ntz").alias("next_fire"))


@query("cron_tick", _SCHEDULES, f"""SELECT id, next_run_ms AS fired_at_ms, next_run_ms AS last_fired_at_ms, id % 3 + 1 AS fire_count,
  CASE id % 3 WHEN 0 THEN (next_run_ms // 300000 + 1) * 300000 WHEN 1 THEN (next_run_ms // 3600000 + 1) * 3600000 ELSE ((next_run_ms - 23400000) // 86400000 + 1) * 86400000 + 23400000 END AS next_run_ms
FROM (SELECT * FROM schedules WHERE enabled AND next_run_ms <= {STATE_NOW} ORDER BY id LIMIT 400)""")  # fmt: skip
def cron_tick(spark, d):
    own = F.when(F.col("id") % 3 == 0, "*/5 * * * *").when(F.col("id") % 3 == 1, "0 * * * *").otherwise("30 6 * * *")
    return schedules.cron_tick(view(spark, d, "schedules").withColumn("fire_count", F.col("id") % 3).withColumn("expression", own), STATE_NOW, 400)


def _triggers(spark, d):
    n = table(spark, d, "nation")
    return n.select(
        F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_name").alias("template"), (F.col("n_nationkey") % 4 != 0).alias("enabled"),
    )


@query("trigger_fire", (), f"""SELECT 't' || CAST(n_nationkey AS VARCHAR) AS name, CASE WHEN event_type = 'view' THEN n_name ELSE props END AS payload, CAST({EVENTS_NOW} AS BIGINT) AS fired_at_ms
FROM events JOIN nation ON user_id % 25 = n_nationkey WHERE n_nationkey % 4 <> 0""")
def trigger_fire(spark, d):
    sent = table(spark, d, "events").select(F.concat(F.lit("t"), (F.col("user_id") % 25).cast("string")).alias("trigger"), F.when(F.col("event_type") != "view", F.col("props")).alias("payload"))
    return schedules.fire(_triggers(spark, d), sent, EVENTS_NOW)


@query("trigger_counters", (), f"""WITH f AS (SELECT user_id % 25 AS n_nationkey, count(*) AS n FROM events WHERE user_id % 25 <> 7 GROUP BY 1)
SELECT 't' || CAST(n_nationkey AS VARCHAR) AS name, n_nationkey % 4 <> 0 AS enabled, n_nationkey + CASE WHEN n_nationkey % 4 <> 0 THEN coalesce(n, 0) ELSE 0 END AS fire_count,
       CASE WHEN n_nationkey % 4 <> 0 AND n IS NOT NULL THEN {EVENTS_NOW} WHEN n_nationkey < 12 THEN 1 END AS last_fired_at_ms FROM nation LEFT JOIN f USING (n_nationkey)""")
def trigger_counters(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("name"), (F.col("n_nationkey") % 4 != 0).alias("enabled"), F.col("n_nationkey").cast("long").alias("fire_count"), F.when(F.col("n_nationkey") < 12, 1).cast("long").alias("last_fired_at_ms"))
    sent = table(spark, d, "events").filter("user_id % 25 <> 7").select(F.concat(F.lit("t"), (F.col("user_id") % 25).cast("string")).alias("trigger"))
    return schedules.after_fire(n, sent, EVENTS_NOW)


@query("trigger_match", (), "SELECT source, name, k, trigger FROM (SELECT 'collection' AS source, o_orderpriority AS name, o_orderkey AS k FROM orders) JOIN (SELECT 'collection' AS source, CASE WHEN n_nationkey % 2 = 0 THEN '1-URGENT' ELSE '2-HIGH' END AS name, n_name AS trigger FROM nation WHERE n_nationkey < 4) USING (source, name)")
def trigger_match(spark, d):
    done = table(spark, d, "orders").select(F.lit("collection").alias("source"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("k"))
    listening = table(spark, d, "nation").select(F.lit("collection").alias("source"), F.when(F.col("n_nationkey") % 2 == 0, "1-URGENT").otherwise("2-HIGH").alias("name"), F.col("n_name").alias("trigger"), (F.col("n_nationkey") < 4).alias("enabled"))
    return schedules.match_changes(done, listening)


_HEALTH = (*_LOG, "queue_messages", "jobs", "objects", "outbox", "rpc_requests", "stream_entries", "ttl_kv", "workflows", "records")
_SPACES = {"ttl": ("ttl_kv", "v"), "collections": ("records", "v"), "queues": ("queue_messages", "payload"), "jobs": ("jobs", "idempotency_key"), "outbox": ("outbox", "payload"), "rpc": ("rpc_requests", "payload"), "streams": ("stream_entries", "payload"), "objects": ("objects", "object_id"), "workflows": ("workflows", "signal_name")}


@query("health_report", _HEALTH, _LIVE + _STORAGE + ", e AS (" + " UNION ALL ".join(f"SELECT '{k}' AS namespace, {c} AS v FROM {t}" for k, (t, c) in _SPACES.items()) + """),
n AS (SELECT ns AS section, count(e.namespace) AS keys, CAST(coalesce(sum(strlen(v)), 0) AS BIGINT) AS value_bytes FROM (VALUES """ + ", ".join(f"('{k}')" for k in health.NAMESPACES) + """) t(ns) LEFT JOIN e ON e.namespace = ns GROUP BY ns),
q AS (SELECT """ + _QUEUE_COUNTS + f""")
SELECT section, 'keys' AS name, keys AS value FROM n UNION ALL SELECT section, 'value_bytes', value_bytes FROM n
UNION ALL SELECT 'storage', unnest(['logged_bytes', 'n_keys', 'key_bytes', 'value_bytes', 'backlog_bytes', 'within_limit']), unnest([logged_bytes, n_keys, key_bytes, value_bytes, greatest(logged_bytes - key_bytes - value_bytes, 0), CAST(logged_bytes <= 1000000 AS BIGINT)]) FROM s
UNION ALL SELECT 'queue', unnest(['ready', 'leased', 'dead', 'total', 'oldest_ready_ms', 'ready_lag_ms']), unnest([ready, leased, dead, total, oldest_ready_ms, greatest({EVENTS_NOW} - greatest(oldest_ready_ms, 0), 0)]) FROM q""")
def health_report(spark, d):
    rows, commits = _log(spark, d)
    parts = [view(spark, d, t).select(F.lit(k).alias("namespace"), F.col(c).alias("v")) for k, (t, c) in _SPACES.items()]
    entries = parts[0]
    for p in parts[1:]:
        entries = entries.unionByName(p)
    return health.report(entries, log.storage_stats(rows, log.replay(rows, commits)), queues.health(view(spark, d, "queue_messages")), EVENTS_NOW, 1_000_000)


@query("history_trend", (), """WITH h AS (SELECT event_type, event_id, value, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS previous, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events)
SELECT event_type, count(*) AS samples, round(min(value), 3) AS min_value, round(max(value), 3) AS max_value, round(avg(value), 3) AS mean_value, round(max(value) FILTER (rn = 1), 3) AS latest_value,
       round(max(value - previous) FILTER (rn = 1), 3) AS change, round(max(CASE WHEN previous <> 0 THEN (value - previous) / previous * 100 END) FILTER (rn = 1), 3) AS change_percent FROM h GROUP BY event_type""")
def history_trend(spark, d):
    return health.trend(table(spark, d, "events"), "event_type", "event_id", "value")


@query("object_verify", (), "SELECT sha256(text) AS object_id, doc_id % 10 <> 0 OR text = '' AS intact FROM documents")
def object_verify(spark, d):
    damaged = F.when(F.col("doc_id") % 10 == 0, F.substring("text", 2, 2**30)).otherwise(F.col("text"))
    return objects.verify(table(spark, d, "documents").select(F.sha2("text", 256).alias("object_id"), damaged.alias("content")), "content")


@query("object_resolve", _OBJECTS, "SELECT namespace, name, object_id FROM object_refs SEMI JOIN (SELECT * FROM objects WHERE size > 1000) USING (object_id)")
def object_resolve(spark, d):
    return objects.resolve(view(spark, d, "object_refs"), view(spark, d, "objects").filter("size > 1000")).select("namespace", "name", "object_id")


@query("collection_delete", _RECORDS, "SELECT pk, v, o_custkey FROM records WHERE pk % 10 <> 3")
def collection_delete(spark, d):
    rows = view(spark, d, "records")
    return collections.delete(rows, rows.filter("pk % 10 = 3"))
