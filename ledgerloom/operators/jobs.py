"""Retrying jobs with deadlines, backoff and idempotency keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import retry_delay_ms

STATES = ("ready", "leased", "completed", "dead", "cancelled")


def reclaimable(now_ms: int) -> Column:
    return (F.col("state") == "ready") | ((F.col("state") == "leased") & (F.col("lease_until_ms") <= now_ms))


def past_deadline(now_ms: int) -> Column:
    return F.coalesce(F.col("deadline_ms") <= now_ms, F.lit(False))


def _wanted(jobs: DataFrame, handlers: list[str] | None) -> DataFrame:
    return jobs.filter(F.col("handler").isin(handlers)) if handlers else jobs


def expired(jobs: DataFrame, now_ms: int, handlers: list[str] | None = None) -> DataFrame:
    """What a claim does besides: ready jobs, available or not, and run-out leases past their deadline turn dead."""
    rows = _wanted(jobs, handlers).filter(reclaimable(now_ms) & past_deadline(now_ms))
    return rows.withColumns({"state": F.lit("dead"), "lease_until_ms": F.lit(0).cast("long"), "detail": F.lit("deadline exceeded")})


def claim(jobs: DataFrame, now_ms: int, lease_ms: int, handlers: list[str] | None = None, claims: int = 1) -> DataFrame:
    """The rows that `claims` claims in a row write, each over all handlers of the list (none: all).

    Highest priority, then earliest available, then lowest id.  A chosen job whose attempts are used up turns dead,
    and that claim returns nothing (claimed is false) even if others wait.
    """
    open_ = (F.col("state") == "leased") | (F.col("available_at_ms") <= now_ms)
    rows = _wanted(jobs, handlers).filter(reclaimable(now_ms) & ~past_deadline(now_ms) & open_)
    live = F.col("attempts") + 1 <= F.col("max_attempts")
    return rows.orderBy(F.desc("priority"), "available_at_ms", "id").limit(claims).withColumns({
        "claimed": live, "state": F.when(live, "leased").otherwise("dead"), "attempts": F.col("attempts") + 1,
        "lease_until_ms": F.when(live, F.lit(now_ms + lease_ms)).otherwise(F.lit(0)).cast("long"),
        "detail": F.when(~live, "max attempts exceeded"),
    })


def reap(jobs: DataFrame, now_ms: int) -> DataFrame:
    """Leases that have run out: dead if no attempt is left, else ready from now on.  Deadlines are not looked at."""
    spent = F.col("attempts") >= F.col("max_attempts")
    return jobs.filter((F.col("state") == "leased") & (F.col("lease_until_ms") <= now_ms)).withColumns({
        "state": F.when(spent, "dead").otherwise("ready"), "lease_until_ms": F.lit(0).cast("long"),
        "available_at_ms": F.when(spent, F.col("available_at_ms")).otherwise(F.lit(now_ms)),
        "detail": F.when(spent, "lease expired: max attempts exhausted").otherwise("lease expired"),
    })


def fail(jobs: DataFrame, now_ms: int) -> DataFrame:
    """What a failure makes of every leased job: dead if no attempt is left, else ready after its retry delay."""
    spent = F.col("attempts") >= F.col("max_attempts")
    delay = retry_delay_ms(F.col("id"), F.col("retry_backoff_ms"), F.col("attempts"))
    return jobs.filter("state = 'leased'").withColumns({
        "state": F.when(spent, "dead").otherwise("ready"), "lease_until_ms": F.lit(0).cast("long"),
        "available_at_ms": F.when(spent, F.col("available_at_ms")).otherwise(F.lit(now_ms) + delay),
    })


def retry_delays(jobs: DataFrame) -> DataFrame:
    return jobs.select("id", retry_delay_ms(F.col("id"), F.col("retry_backoff_ms"), F.col("attempts")).alias("delay_ms"))


def settle(jobs: DataFrame, commands: DataFrame, now_ms: int) -> DataFrame:
    """Apply worker and operator commands (id, command, generation, until_ms), at most one for a job: the jobs afterwards.

    complete, release, heartbeat and fail need a lease of that generation; retry takes dead jobs, cancel ready
    and leased ones; anything else changes nothing.  All that end a lease set it to 0.
    """
    own = commands.select("id", F.col("command").alias("_c"), F.col("generation").alias("_g"), F.col("until_ms").alias("_until"))
    row = jobs.join(own, "id", "left")
    held = F.coalesce((F.col("state") == "leased") & (F.col("_g") == F.col("attempts")), F.lit(False))
    spent = F.col("attempts") >= F.col("max_attempts")
    delay = retry_delay_ms(F.col("id"), F.col("retry_backoff_ms"), F.col("attempts"))

    def command(name: str) -> Column:
        return F.coalesce(F.col("_c") == name, F.lit(False))

    revive = command("retry") & (F.col("state") == "dead")
    state = (
        F.when(held & command("complete"), "completed").when(held & command("release"), "ready")
        .when(held & command("fail") & spent, "dead").when(held & command("fail"), "ready")
        .when(revive, "ready").when(command("cancel") & F.col("state").isin("ready", "leased"), "cancelled").otherwise(F.col("state"))
    )
    available = F.when(held & command("release") | revive, F.lit(now_ms)).when(held & command("fail") & ~spent, F.lit(now_ms) + delay).otherwise(F.col("available_at_ms"))
    stop = F.col("_c").isin("cancel") & F.col("state").isin("ready", "leased") | held & F.col("_c").isin("complete", "release", "fail") | revive
    until = F.when(held & command("heartbeat"), F.col("_until")).when(F.coalesce(stop, F.lit(False)), F.lit(0)).otherwise(F.col("lease_until_ms")).cast("long")
    return row.select(*[
        {"state": state.alias("state"), "available_at_ms": available.alias("available_at_ms"),
         "lease_until_ms": until.alias("lease_until_ms"),
         "attempts": F.when(revive, F.lit(0)).otherwise(F.col("attempts")).alias("attempts")}.get(c, F.col(c)) for c in jobs.columns
    ])


def submit(jobs: DataFrame, specs: DataFrame) -> DataFrame:
    """For each spec (spec_id, idempotency_key): the active job that it reuses, else null (then the first spec of a key is new)."""
    active = jobs.filter(F.col("state").isin("ready", "leased")).filter("idempotency_key is not null").groupBy("idempotency_key").agg(F.min("id").alias("reuses"))
    first = F.min("spec_id").over(Window.partitionBy("idempotency_key"))
    joined = specs.join(active, "idempotency_key", "left").withColumn("first", first)
    new = F.col("reuses").isNull() & (F.col("idempotency_key").isNull() | (F.col("spec_id") == F.col("first")))
    return joined.select("spec_id", "idempotency_key", "reuses", new.alias("is_new"))


def listing(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("available_at_ms"), F.desc("id"))


def stats(jobs: DataFrame) -> DataFrame:
    """One row: jobs by state, and all."""
    return jobs.agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES], F.count("*").alias("total"))


def history(events: DataFrame, key: str = "id", order: str = "at_ms") -> DataFrame:
    """Events with a dense sequence from 0 for each key."""
    return events.withColumn("sequence", (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long"))
