"""Keys with an expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import shortlex


def visible(kv: DataFrame, now_ms: int) -> DataFrame:
    """Keys that have not expired: hidden from expires_at_ms on."""
    return kv.filter(F.col("expires_at_ms").isNull() | (F.col("expires_at_ms") > now_ms))


def with_ttl(state: DataFrame, expiries: DataFrame) -> DataFrame:
    """State (k, v) with its expiries (k, expires_at_ms): a plain later put, or a delete and put, keeps the expiry."""
    return state.join(expiries, "k", "left")


def purge(kv: DataFrame, now_ms: int, limit: int) -> DataFrame:
    """The keys a sweep removes: expired ones in shortlex order, at most limit (0: none)."""
    return kv.filter(F.col("expires_at_ms") <= now_ms).orderBy(*shortlex("k")).limit(limit)


def purge_report(expiries: DataFrame, state: DataFrame, now_ms: int, limit: int) -> DataFrame:
    """One row of a sweep: scanned, expired, removed (those that still exist)."""
    gone = purge(expiries, now_ms, limit).join(state.select("k", F.lit(1).alias("there")), "k", "left")
    counts = gone.agg(F.count("*").alias("expired"), F.count("there").alias("removed"))
    return expiries.agg(F.count("*").alias("scanned")).join(counts)


def put_with_ttl(kv: DataFrame, puts: DataFrame) -> DataFrame:
    """kv (k, v, expires_at_ms) after puts of the same columns, one for a key: value and expiry are replaced together."""
    return kv.join(puts.select("k"), "k", "left_anti").unionByName(puts)


def clear_ttl(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """kv without the expiries of these keys; values stay.  cleared: whether there was one."""
    marked = kv.join(keys.select("k", F.lit(True).alias("_hit")), "k", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return marked.select("k", "v", F.when(~hit, F.col("expires_at_ms")).alias("expires_at_ms"), (hit & F.col("expires_at_ms").isNotNull()).alias("cleared"))
