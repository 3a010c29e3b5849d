"""Change log: replay, overlay, compare-and-swap, counters, verification and the change feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import counter_value


def committed(log: DataFrame, commits: DataFrame) -> DataFrame:
    """Operations of transactions that have a commit."""
    return log.join(commits, "tx_id", "left_semi")


def latest(changes: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last row of each key; order must be total within a key.  One shuffle, combined before it."""
    last = changes.groupBy(*keys).agg(F.max(F.struct(*order, *values)).alias("last"))
    return last.select(*keys, *[F.col(f"last.{c}").alias(c) for c in values])


def replay(log: DataFrame, commits: DataFrame, as_of: int | None = None) -> DataFrame:
    """Live state (k, v): last write wins in commit order; deletes drop the key.  as_of: transactions up to this one.

    commits may carry commit_sequence for interleaved writers; otherwise sequences are in commit order.
    """
    rows = log.join(commits, "tx_id") if "commit_sequence" in commits.columns else committed(log, commits)
    if as_of is not None:
        rows = rows.filter(F.col("tx_id") <= as_of)
    order = (["commit_sequence"] if "commit_sequence" in commits.columns else []) + ["sequence"]
    return latest(rows, ["k"], order, ["kind", "v"]).filter("kind = 'PUT'").select("k", "v")


def prefix_scan(state: DataFrame, prefix: str) -> DataFrame:
    """Keys that start with the prefix, in byte order (the caller sorts last if it reshapes)."""
    return state.filter(F.col("k").startswith(prefix)).orderBy("k")


def get(state: DataFrame, key: str) -> DataFrame:
    """Point lookup; expiry is not looked at."""
    return state.filter(F.col("k") == key)


def overlay(state: DataFrame, staged: DataFrame) -> DataFrame:
    """What a transaction sees: its staged operations (sequence, kind, k, v) over the committed state."""
    base = state.select("k", F.lit(-1).cast("long").alias("sequence"), F.lit("PUT").alias("kind"), "v")
    return latest(base.unionByName(staged.select("k", "sequence", "kind", "v")), ["k"], ["sequence"], ["kind", "v"]).filter("kind = 'PUT'").select("k", "v")


def compare_and_swap(state: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (k, expected, next; one for each key) -> k, swapped, v: the value afterwards.

    A null expected means the key must be absent, a null next deletes it; a mismatch changes nothing.
    """
    now = requests.join(state.withColumnRenamed("v", "current"), "k", "left")
    ok = F.col("current").eqNullSafe(F.col("expected"))
    return now.select("k", ok.alias("swapped"), F.when(ok, F.col("next")).otherwise(F.col("current")).alias("v"))


def counters(deltas: DataFrame) -> DataFrame:
    """Running value of each counter (k, sequence, delta); overflow raises under ANSI arithmetic."""
    return deltas.withColumn("value", F.sum("delta").over(Window.partitionBy("k").orderBy("sequence")))


def increment(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """Counter keys (k, v binary) plus summed deltas (k, delta): k, value; absent counts 0, other than 8 bytes fails."""
    sums = deltas.groupBy("k").agg(F.sum("delta").alias("delta"))
    base = F.when(F.col("v").isNull(), F.lit(0)).otherwise(F.coalesce(counter_value(F.col("v")), F.raise_error(F.lit("invalid counter")).cast("long")))
    return sums.join(state, "k", "left").select("k", (base + F.col("delta")).alias("value"))


def verify(log: DataFrame, commits: DataFrame) -> DataFrame:
    """One row: records, committed and pending transactions, live keys, highest sequence."""
    head = log.agg(F.count("*").alias("records"), F.max("sequence").alias("last_sequence"))
    done = log.select("tx_id").distinct().join(commits.withColumn("ok", F.lit(1)), "tx_id", "left").agg(F.count("ok").alias("committed"), (F.count("*") - F.count("ok")).alias("pending"))
    live = replay(log, commits).agg(F.count("*").alias("live_keys"))
    return head.join(done).join(live)  # three single rows


def pending(log: DataFrame, commits: DataFrame) -> DataFrame:
    """Transactions without a commit, with their number of records."""
    return log.join(commits, "tx_id", "left_anti").groupBy("tx_id").agg(F.count("*").alias("n_records"))


def changes(log: DataFrame, commits: DataFrame) -> DataFrame:
    """The change feed: dense sequence from 0 in each transaction, length and digest of put values, none for deletes."""
    seq = (F.row_number().over(Window.partitionBy("tx_id").orderBy("sequence")) - 1).cast("long")
    put = F.col("kind") == "PUT"
    return committed(log, commits).select(
        "tx_id", seq.alias("seq"), "kind", "k",
        F.when(put, F.octet_length("v").cast("long")).alias("value_len"), F.when(put, F.sha2("v", 256)).alias("value_sha256"),
    )


def changes_after(feed: DataFrame, after: int | None, limit: int, after_seq: int | None = None) -> DataFrame:
    """The next rows after a transaction (or after a place inside one); limit 0 gives none."""
    if after is None:
        rows = feed
    elif after_seq is None:
        rows = feed.filter(F.col("tx_id") > after)
    else:
        rows = feed.filter((F.col("tx_id") > after) | ((F.col("tx_id") == after) & (F.col("seq") > after_seq)))
    return rows.orderBy("tx_id", "seq").limit(limit)


def changes_of(feed: DataFrame, tx_id: int) -> DataFrame:
    return feed.filter(F.col("tx_id") == tx_id).orderBy("seq")


def prune(feed: DataFrame, through: int, limit: int) -> DataFrame:
    """The rows that a prune removes: the first `limit` with tx_id up to through."""
    return feed.filter(F.col("tx_id") <= through).orderBy("tx_id", "seq").limit(limit)


def namespace(key: Column) -> Column:
    """The part of a key before its first colon."""
    return F.substring_index(key, ":", 1)


def namespace_stats(state: DataFrame, namespaces: list[str]) -> DataFrame:
    """Keys and value bytes of each of a fixed list of namespaces; those without keys count 0."""
    spark = state.sparkSession
    fixed = spark.createDataFrame([(n,) for n in namespaces], "ns string")
    sums = state.groupBy(namespace(F.col("k")).alias("ns")).agg(F.count("*").alias("n_keys"), F.sum(F.octet_length("v").cast("long")).alias("value_bytes"))
    return fixed.join(sums, "ns", "left").select("ns", F.coalesce("n_keys", F.lit(0)).cast("long").alias("n_keys"), F.coalesce("value_bytes", F.lit(0)).cast("long").alias("value_bytes"))


def over_quota(state: DataFrame, staged: DataFrame, limits: DataFrame) -> DataFrame:
    """Namespaces touched by staged operations whose value bytes afterwards exceed limits (ns, max_bytes)."""
    touched = staged.select(namespace(F.col("k")).alias("ns")).distinct()
    sums = overlay(state, staged).groupBy(namespace(F.col("k")).alias("ns")).agg(F.sum(F.octet_length("v").cast("long")).alias("value_bytes"))
    return sums.join(touched, "ns", "left_semi").join(limits, "ns").filter("value_bytes > max_bytes")


def storage_stats(log: DataFrame, state: DataFrame) -> DataFrame:
    """One row: logged bytes against live bytes, and their ratio (1 if both are nothing, the bytes if nothing lives)."""
    size = F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0))
    logged = log.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("logged_bytes"))
    live = state.agg(F.count("*").alias("n_keys"), F.coalesce(F.sum(F.octet_length("k").cast("long")), F.lit(0)).alias("key_bytes"), F.coalesce(F.sum(F.octet_length("v").cast("long")), F.lit(0)).alias("value_bytes"))
    live_bytes = F.col("key_bytes") + F.col("value_bytes")
    ratio = F.when(live_bytes > 0, F.col("logged_bytes") / live_bytes).when(F.col("logged_bytes") > 0, F.col("logged_bytes").cast("double")).otherwise(1.0)
    return logged.join(live).select("logged_bytes", "n_keys", "key_bytes", "value_bytes", ratio.alias("amplification"), F.greatest(F.col("logged_bytes") - live_bytes, F.lit(0)).cast("long").alias("backlog_bytes"))


def alerts(health: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Signals of a one-row health table that exceed their threshold: signal, value."""
    pairs = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in thresholds)
    long = health.select(F.expr(f"stack({len(thresholds)}, {pairs}) AS (signal, value)"))
    most = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(float(v)))])
    return long.filter(F.col("value") > most[F.col("signal")])
