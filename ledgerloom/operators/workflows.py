"""Workflow state: steps, signals, timers, children and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def due(workflows: DataFrame, now_ms: int, limit: int) -> DataFrame:
    """Waiting workflows whose timer has come, by id, at most limit: running again."""
    rows = workflows.filter((F.col("status") == "waiting") & (F.col("resume_at_ms") <= now_ms)).orderBy("id").limit(limit)
    return rows.withColumn("status", F.lit("running"))


def children(workflows: DataFrame) -> DataFrame:
    """For each parent its number of children, how many still run or wait, and the oldest."""
    kids = workflows.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id"))
    return kids.agg(F.count("*").alias("n_children"), F.count_if(F.col("status").isin("running", "waiting")).alias("n_open"), F.min(F.struct("created_at_ms", "id"))["id"].alias("oldest"))


def history_gaps(history: DataFrame) -> DataFrame:
    """Workflows whose history sequence is not dense from 0."""
    own = history.groupBy("workflow_id").agg(F.count("*").alias("n"), F.min("sequence").alias("lo"), F.max("sequence").alias("hi"), F.count_distinct("sequence").alias("d"))
    return own.filter("lo <> 0 or hi <> n - 1 or d <> n").select("workflow_id", "n")


def signals(workflows: DataFrame, sent: DataFrame) -> DataFrame:
    """Signals (id, signal_name, payload) that find a workflow waiting on exactly that name: it runs, with the payload as its state."""
    hit = workflows.filter("status = 'waiting' and signal_name is not null").join(sent, ["id", "signal_name"])
    return hit.select("id", F.lit("running").alias("status"), F.col("payload").alias("state"))


STATE = "struct<status: string, step: string, state: string, signal: string, resume_at_ms: bigint, events: bigint>"


def fold(commands: DataFrame) -> DataFrame:
    """Workflows after their commands in order of seq: id, status, step, state, signal, resume_at_ms, events.

    commands: id, seq, command (create, set_step, wait_signal, signal, wait_until, resume, complete, fail,
    cancel), name, payload, at_ms.  Terminal states take nothing more; a signal needs a wait on its name; a
    resume needs a timer that has come.  events counts the history rows.
    """
    start = F.expr(f"CAST(struct(NULL, NULL, NULL, NULL, NULL, 0) AS {STATE})")
    listed = commands.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seq", "command", "name", "payload", "at_ms"))).alias("c"))
    none = F.lit(None)

    def state(s, status, step=None, data=None, signal=none, until=none):
        return F.struct(
            F.lit(status).alias("status"), (s["step"] if step is None else step).alias("step"), (s["state"] if data is None else data).alias("state"),
            signal.alias("signal"), until.alias("resume_at_ms"), (s["events"] + 1).alias("events"),
        ).cast(STATE)

    def apply(s, c):
        live = F.coalesce(s["status"].isin("running", "waiting"), F.lit(False))
        is_ = lambda name: c["command"] == name
        waits = F.coalesce(s["signal"] == c["name"], F.lit(False))
        timed = F.coalesce(s["resume_at_ms"] <= c["at_ms"], F.lit(False))
        return (
            F.when(is_("create") & s["status"].isNull(), state(s, "running", c["name"], c["payload"]))
            .when(~live, s)
            .when(is_("set_step"), state(s, "running", c["name"], c["payload"]))
            .when(is_("wait_signal"), state(s, "waiting", signal=c["name"]))
            .when(is_("signal") & waits, state(s, "running", data=c["payload"]))
            .when(is_("wait_until"), state(s, "waiting", until=c["at_ms"]))
            .when(is_("resume") & timed, state(s, "running"))
            .when(is_("complete"), state(s, "completed", data=c["payload"]))
            .when(is_("fail"), state(s, "failed", data=c["payload"]))
            .when(is_("cancel"), state(s, "cancelled"))
            .otherwise(s)
        )

    return listed.select("id", F.aggregate("c", start, apply).alias("s")).select("id", "s.*")


def numbered(events: DataFrame, key: str, order: str) -> DataFrame:
    return events.withColumn("sequence", (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long"))
