"""Request and reply correlation, and the outbox."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pending(requests: DataFrame, responses: DataFrame, after: int | None = None, limit: int = 0) -> DataFrame:
    """Requests without a response, after a transaction, in order; limit 0 is no limit."""
    rows = requests.join(responses.select("tx_id"), "tx_id", "left_anti")
    rows = rows if after is None else rows.filter(F.col("tx_id") > after)
    return rows.orderBy("tx_id").limit(limit) if limit else rows


def respond(requests: DataFrame, responses: DataFrame, answers: DataFrame) -> DataFrame:
    """The outcome of each answer (answer_id, tx_id): responded, already_responded (also by an earlier answer), not_found."""
    first = F.row_number().over(Window.partitionBy("tx_id").orderBy("answer_id")) == 1
    asked = requests.select("tx_id", F.lit(True).alias("_asked"))
    done = responses.select("tx_id", F.lit(True).alias("_done"))
    row = answers.withColumn("_first", first).join(asked, "tx_id", "left").join(done, "tx_id", "left")
    outcome = F.when(F.col("_done").isNotNull() | (F.col("_asked").isNotNull() & ~F.col("_first")), "already_responded").when(F.col("_asked").isNull(), "not_found").otherwise("responded")
    return row.select("answer_id", "tx_id", outcome.alias("outcome"))


def ack(responses: DataFrame, ids: DataFrame) -> DataFrame:
    """Responses that stay after these tx_ids were acknowledged."""
    return responses.join(ids.select("tx_id"), "tx_id", "left_anti")


def outbox_ack(outbox: DataFrame, events: DataFrame) -> DataFrame:
    """Events (tx_id, seq_in_tx) that stay in the outbox; those that are not there change nothing."""
    return outbox.filter("not acked").join(events.select("tx_id", "seq_in_tx"), ["tx_id", "seq_in_tx"], "left_anti")


def outbox_len(outbox: DataFrame) -> DataFrame:
    return outbox.agg(F.count_if(~F.col("acked")).alias("n"))


def expire(requests: DataFrame, responses: DataFrame, now_ms: int, limit: int | None = None) -> DataFrame:
    """Error responses for pending requests whose deadline has come, at most limit of them in order (0: none)."""
    late = pending(requests, responses).filter(F.col("deadline_ms") <= now_ms)
    late = late if limit is None else late.orderBy("tx_id").limit(limit)
    return late.select("tx_id", F.lit("deadline exceeded").alias("payload"), F.lit(now_ms).cast("long").alias("completed_at_ms"), F.lit(True).alias("is_error"))


def roundtrips(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Answered requests with the time from request to response."""
    answers = responses.select("tx_id", "completed_at_ms", F.octet_length("payload").cast("long").alias("response_bytes"))
    return requests.join(answers, "tx_id").select("tx_id", (F.col("completed_at_ms") - F.col("created_at_ms")).alias("latency_ms"), "response_bytes")


def outbox_pending(outbox: DataFrame, after: int | None = None, limit: int = 0) -> DataFrame:
    """Events that nobody acknowledged, in commit order; limit 0 is no limit."""
    rows = outbox.filter("not acked")
    rows = rows if after is None else rows.filter(F.col("tx_id") > after)
    return rows.orderBy("tx_id", "seq_in_tx").limit(limit) if limit else rows
