"""Leased priority queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def eligible(now_ms: int) -> Column:
    """Ready and available, or leased with a lease that has run out (then availability is not looked at)."""
    return ((F.col("state") == "ready") & (F.col("available_at_ms") <= now_ms)) | ((F.col("state") == "leased") & (F.col("lease_until_ms") <= now_ms))


def claim(messages: DataFrame, now_ms: int, lease_ms: int, n: int = 1) -> DataFrame:
    """The rows that n claims on every queue write: highest priority first, then lowest id; attempts are the lease's generation."""
    best = F.row_number().over(Window.partitionBy("queue").orderBy(F.desc("priority"), "id"))
    return (
        messages.filter(eligible(now_ms)).withColumn("claim", best).filter(F.col("claim") <= n)
        .withColumns({"state": F.lit("leased"), "attempts": F.col("attempts") + 1, "lease_until_ms": F.lit(now_ms + lease_ms).cast("long")})
    )


def settle(messages: DataFrame, commands: DataFrame) -> DataFrame:
    """Apply acks, nacks and dead letters (queue, id, generation, command, at_ms): the messages afterwards.

    A command counts if the message is leased with that generation, even after its lease ran out; ack deletes it.
    """
    own = commands.select("queue", "id", F.col("generation").alias("_g"), F.col("command").alias("_c"), F.col("at_ms").alias("_at"))
    row = messages.join(own, ["queue", "id"], "left")
    hit = (F.col("state") == "leased") & (F.col("_g") == F.col("attempts"))
    after = F.when(hit & (F.col("_c") == "nack"), "ready").when(hit & (F.col("_c") == "dead"), "dead").otherwise(F.col("state"))
    kept = row.filter(~F.coalesce(hit & (F.col("_c") == "ack"), F.lit(False)))
    moved = F.coalesce(hit & F.col("_c").isin("nack", "dead"), F.lit(False))
    return kept.withColumns({
        "available_at_ms": F.when(moved & (F.col("_c") == "nack"), F.col("_at")).otherwise(F.col("available_at_ms")),
        "lease_until_ms": F.when(moved, F.lit(0)).otherwise(F.col("lease_until_ms")),
        "state": F.coalesce(after, F.col("state")),
    }).drop("_g", "_c", "_at")


def push(messages: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """New messages (queue, payload, priority, available_at_ms) with ids that go on after each queue's last, from 1."""
    last = messages.groupBy("queue").agg(F.max("id").alias("last"))
    place = F.row_number().over(Window.partitionBy("queue").orderBy(order))
    return incoming.withColumn("place", place).join(last, "queue", "left").select(
        "queue", (F.coalesce("last", F.lit(0)) + F.col("place")).cast("long").alias("id"), F.lit("ready").alias("state"),
        F.coalesce("priority", F.lit(0)).cast("long").alias("priority"), F.lit(0).cast("long").alias("attempts"),
        F.coalesce("available_at_ms", F.lit(0)).cast("long").alias("available_at_ms"), F.lit(0).cast("long").alias("lease_until_ms"), "payload",
    )


def _counts() -> list[Column]:
    return [
        *[F.count_if(F.col("state") == s).alias(s) for s in ("ready", "leased", "dead")],
        F.count("*").alias("total"), F.min(F.when(F.col("state") == "ready", F.col("available_at_ms"))).alias("oldest_ready_ms"),
    ]


def stats(messages: DataFrame) -> DataFrame:
    """Counts by state and the oldest ready time of each queue."""
    return messages.groupBy("queue").agg(*_counts())


def health(messages: DataFrame) -> DataFrame:
    """The same over all queues."""
    return messages.agg(*_counts())


def lag(messages: DataFrame, now_ms: int) -> DataFrame:
    """How long each queue's oldest ready message has waited; 0 if it lies ahead, null if none is ready."""
    return stats(messages).select("queue", F.when(F.col("oldest_ready_ms").isNotNull(), F.greatest(F.lit(now_ms) - F.col("oldest_ready_ms"), F.lit(0))).cast("long").alias("lag_ms"))


def purge_dead(messages: DataFrame) -> DataFrame:
    """Dead messages, which a purge deletes, counted by queue."""
    return messages.filter("state = 'dead'").groupBy("queue").agg(F.count("*").alias("n_purged"))
