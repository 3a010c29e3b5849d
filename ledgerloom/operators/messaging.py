"""Append-only streams, subscription cursors and consumer groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def append(entries: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """New entries (stream, payload) with dense offsets after each stream's last, from 0."""
    last = entries.groupBy("stream").agg(F.max("stream_offset").alias("last"))
    place = F.row_number().over(Window.partitionBy("stream").orderBy(order))
    return incoming.withColumn("place", place).join(last, "stream", "left").select("stream", (F.coalesce("last", F.lit(-1)) + F.col("place")).cast("long").alias("stream_offset"), "payload")


def read_from(entries: DataFrame, stream: str, offset: int, limit: int) -> DataFrame:
    return entries.filter((F.col("stream") == stream) & (F.col("stream_offset") >= offset)).orderBy("stream_offset").limit(limit)


def tail(entries: DataFrame) -> DataFrame:
    return entries.groupBy("stream").agg(F.max("stream_offset").alias("tail_offset"))


def cursors(acks: DataFrame) -> DataFrame:
    """next_offset of each (stream, subscription): after the furthest acknowledged entry."""
    return acks.groupBy("stream", "subscription").agg((F.max("acked_through") + 1).alias("next_offset"))


def reset(subscriptions: DataFrame, resets: DataFrame) -> DataFrame:
    """Cursors (stream, subscription, next_offset) after resets of the same columns, which may also go back, or name new ones."""
    return subscriptions.join(resets, ["stream", "subscription"], "left_anti").unionByName(resets)


def poll(entries: DataFrame, subscriptions: DataFrame, limit: int) -> DataFrame:
    """The next entries of every subscription (stream, subscription, next_offset); cursors don't move.

    An offset range is one slice of a dense stream, so each subscription meets `limit` entries and not its stream.
    """
    wanted = subscriptions.select("stream", "subscription", F.explode(F.sequence(F.col("next_offset"), F.col("next_offset") + (limit - 1))).alias("stream_offset")) if limit else subscriptions.limit(0).withColumnRenamed("next_offset", "stream_offset")
    return wanted.join(entries, ["stream", "stream_offset"])


def cursor_regressions(acks: DataFrame, order: str) -> DataFrame:
    """Acknowledgements that move a cursor backwards (staying is allowed)."""
    before = F.max("acked_through").over(Window.partitionBy("stream", "subscription").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return acks.withColumn("before", before).filter("acked_through < before")


GROUP_STATE = "struct<next_offset: bigint, leased_offset: bigint, lease_until_ms: bigint, generation: bigint, owner: string>"


def group_fold(commands: DataFrame, tails: DataFrame) -> DataFrame:
    """Consumer groups after their commands: stream, grp, next_offset, leased_offset, lease_until_ms, generation, owner.

    commands: stream, grp, seq, command (claim, ack, nack, reset), consumer, now_ms, lease_ms, generation,
    stream_offset; tails: stream, tail_offset.  A claim needs no lease, or one that has run out, and an entry; ack
    and nack need the owner, generation and offset of the lease, though not in time; reset keeps the generation.
    Each group is folded in order of seq; its commands are gathered in one row, as its state is sequential.
    """
    start = F.expr(f"CAST(struct(0, NULL, 0, 0, NULL) AS {GROUP_STATE})")
    rows = commands.join(tails, "stream", "left")
    listed = rows.groupBy("stream", "grp").agg(
        F.sort_array(F.collect_list(F.struct("seq", "command", "consumer", "now_ms", "lease_ms", "generation", "stream_offset", "tail_offset"))).alias("c")
    )

    def state(next_offset, leased, until, generation, owner):
        return F.struct(next_offset.alias("next_offset"), leased.alias("leased_offset"), until.alias("lease_until_ms"), generation.alias("generation"), owner.alias("owner")).cast(GROUP_STATE)

    none, zero = F.lit(None), F.lit(0)

    def step(s, c):
        busy = s["leased_offset"].isNotNull() & (s["lease_until_ms"] > c["now_ms"])
        entry = F.coalesce(c["tail_offset"] >= s["next_offset"], F.lit(False))
        ours = F.coalesce((s["owner"] == c["consumer"]) & (s["generation"] == c["generation"]) & (s["leased_offset"] == c["stream_offset"]), F.lit(False))
        freed = state(s["next_offset"], none, zero, s["generation"], none)
        return (
            F.when((c["command"] == "claim") & busy, s)
            .when((c["command"] == "claim") & entry, state(s["next_offset"], s["next_offset"], c["now_ms"] + c["lease_ms"], s["generation"] + 1, c["consumer"]))
            .when(c["command"] == "claim", freed)
            .when((c["command"] == "ack") & ours, state(s["leased_offset"] + 1, none, zero, s["generation"], none))
            .when((c["command"] == "nack") & ours, freed)
            .when(c["command"] == "reset", state(c["stream_offset"], none, zero, s["generation"], none))
            .otherwise(s)
        )

    return listed.select("stream", "grp", F.aggregate("c", start, step).alias("s")).select("stream", "grp", "s.*")
