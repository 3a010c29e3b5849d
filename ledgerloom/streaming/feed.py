"""Incremental consumption: the change feed of a store, and consumer groups as stateful streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.operators import log
from ledgerloom.sources.store import KV, Store

_MARKER = "tx_id long, last_sequence long, segments map<string, struct<path: string, rows: long>>"


def change_feed(store: Store, checkpoint: str, handler: Callable[[DataFrame, int], None], **trigger) -> StreamingQuery:
    """Call handler(changes, batch id) for newly committed transactions.

    The stream follows the commit markers, so uncommitted segments are never seen; its checkpoint is the cursor.
    """
    base = store.base
    markers = store.spark.readStream.schema(_MARKER).option("pathGlobFilter", "*.json").json(f"{base}/commits")

    def batch(rows: DataFrame, number: int) -> None:
        fresh = [r for r in rows.select("tx_id", F.col("segments")[KV]["path"].alias("path")).collect() if r.path]
        if fresh:
            commits = store.spark.createDataFrame([(r.tx_id,) for r in fresh], "tx_id long")
            handler(log.changes(store.spark.read.parquet(*[f"{base}/{r.path}" for r in fresh]), commits), number)

    return markers.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


_STATE = "next_offset long, leased_offset long, lease_until_ms long, generation long, owner string"
_OUT = "stream string, grp string, seq long, command string, ok boolean, next_offset long, leased_offset long, generation long"


def _advance(state: tuple, c) -> tuple[bool, tuple]:
    """One command on a group's state (next, leased, until, generation, owner)."""
    after, leased, until, generation, owner = state
    if c.command == "reset":
        return True, (c.stream_offset, None, 0, generation, None)
    if c.command == "claim":
        if leased is not None and until > c.now_ms:
            return False, state
        if not c.tail_offset >= after:
            return False, (after, None, 0, generation, None)
        return True, (after, after, c.now_ms + c.lease_ms, generation + 1, c.consumer)
    if leased is None or (owner, generation, leased) != (c.consumer, c.generation, c.stream_offset):
        return False, state
    return True, (leased + 1 if c.command == "ack" else after, None, 0, generation, None)


def group_leases(commands: DataFrame) -> DataFrame:
    """Consumer groups over a stream of commands: one row for each command with its outcome.

    commands: stream, grp, seq, command, consumer, now_ms, lease_ms, generation, stream_offset, tail_offset.
    A group's commands are applied in order of seq within a micro-batch.
    """

    def apply(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = state.get if state.exists else (0, None, 0, 0, None)
        rows = pd.concat(frames).sort_values("seq")
        out = []
        for c in rows.itertuples(index=False):
            ok, own = _advance(own, c)
            out.append((*key, c.seq, c.command, ok, own[0], own[1], own[3]))
        state.update(own)
        frame = pd.DataFrame(out, columns=["stream", "grp", "seq", "command", "ok", "next_offset", "leased_offset", "generation"])
        yield frame.astype({"leased_offset": "Int64"})

    return commands.groupBy("stream", "grp").applyInPandasWithState(apply, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """An extension: counts by event type and time window, with a watermark for late rows."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), "event_type").agg(F.count("*").alias("n"))
