"""Trends of measured histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trend(history: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """For each key: samples, min, max, mean, latest, and the change from the sample before (absolute and percent; null if there is none, or it was 0).

    The two latest samples come from a bounded aggregate, so no key's history is gathered.
    """

    def rounded(c: Column) -> Column:
        return F.round(c, 3)

    last = F.max(F.struct(order, value)).alias("last")
    first = history.groupBy(key).agg(F.count("*").alias("samples"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"), last)
    before = history.join(first.select(key, F.col(f"last.{order}").alias("_at")), key).filter(F.col(order) < F.col("_at"))
    previous = before.groupBy(key).agg(F.max(F.struct(order, value))[value].alias("previous"))
    latest = F.col(f"last.{value}")
    return first.join(previous, key, "left").select(
        key, "samples", rounded(F.col("lo")).alias("min_value"), rounded(F.col("hi")).alias("max_value"), rounded(F.col("mean")).alias("mean_value"),
        rounded(latest).alias("latest_value"), rounded(latest - F.col("previous")).alias("change"),
        F.when(F.col("previous") != 0, rounded((latest - F.col("previous")) / F.col("previous") * 100)).alias("change_percent"),
    )


#: The namespaces of a health report.
NAMESPACES = ("ttl", "collections", "queues", "jobs", "schedules", "cron", "triggers", "outbox", "rpc", "cdc", "streams", "subscriptions", "consumer_groups", "objects", "workflows")


def report(entries: DataFrame, storage: DataFrame, queue: DataFrame, now_ms: int, max_bytes: int | None = None) -> DataFrame:
    """A health report as rows (section, name, value): keys and bytes of all fixed namespaces, storage, backlog, queues and their lag.

    entries: namespace, k, v; storage: one row of log.storage_stats; queue: one row of queues.health.
    """
    names = F.explode(F.array(*map(F.lit, NAMESPACES))).alias("namespace")
    own = entries.groupBy("namespace").agg(F.count("*").alias("keys"), F.sum(F.octet_length("v")).alias("value_bytes"))
    spaces = storage.select(names).join(own, "namespace", "left")
    within = F.lit(1) if max_bytes is None else (F.col("logged_bytes") <= max_bytes).cast("int")
    lag = F.greatest(F.lit(now_ms) - F.greatest("oldest_ready_ms", F.lit(0)), F.lit(0))

    def rows(df: DataFrame, section, parts: dict) -> DataFrame:
        return df.select(F.explode(F.array(*[F.struct(section.alias("section"), F.lit(k).alias("name"), v.cast("long").alias("value")) for k, v in parts.items()])).alias("r")).select("r.*")

    spaces = rows(spaces, F.col("namespace"), {k: F.coalesce(k, F.lit(0)) for k in ("keys", "value_bytes")})
    stored = rows(storage, F.lit("storage"), {k: F.col(k) for k in ("logged_bytes", "n_keys", "key_bytes", "value_bytes", "backlog_bytes")} | {"within_limit": within})
    return spaces.unionByName(stored).unionByName(rows(queue, F.lit("queue"), {k: F.col(k) for k in ("ready", "leased", "dead", "total", "oldest_ready_ms")} | {"ready_lag_ms": lag}))
