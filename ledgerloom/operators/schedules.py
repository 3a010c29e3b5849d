"""Interval, one-time and cron schedules; triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.cron import HORIZON_DAYS, Cron, next_fire_ms


def tick(schedules: DataFrame, now_ms: int, limit: int) -> DataFrame:
    """Due schedules (by id, at most limit): one job each at its scheduled time; missed times coalesce.

    fired_at_ms, and the schedule afterwards: one-time ones are off, intervals go on at the first time after now.
    """
    due = schedules.filter(F.col("enabled") & (F.col("next_run_ms") <= now_ms)).orderBy("id").limit(limit)
    once = F.col("mode") == "once"
    missed = F.expr(f"({now_ms} - next_run_ms) div every_ms + 1")
    return due.select(
        "id", "handler", F.col("next_run_ms").alias("fired_at_ms"),
        F.when(once, F.col("next_run_ms")).otherwise(F.col("next_run_ms") + missed * F.col("every_ms")).alias("next_run_ms"),
        (~once).alias("enabled"),
    )


def cron_matches(events: DataFrame, expression: str, at: str = "ts") -> DataFrame:
    return events.filter(Cron.parse(expression).matches(F.col(at)))


def cron_next(events: DataFrame, expression: str, at: str = "ts", days: int = HORIZON_DAYS) -> DataFrame:
    return events.withColumn("next_fire", Cron.parse(expression).next_after(F.col(at), days))


def cron_tick(schedules: DataFrame, now_ms: int, limit: int) -> DataFrame:
    """Due cron schedules, each with its own expression: one occurrence each per tick, so missed ones are caught up.

    The next time follows the scheduled one, not now.
    """
    due = schedules.filter(F.col("enabled") & (F.col("next_run_ms") <= now_ms)).orderBy("id").limit(limit)
    step = next_fire_ms(F.col("expression"), F.col("next_run_ms"))
    return due.select("id", F.col("next_run_ms").alias("fired_at_ms"), step.alias("next_run_ms"), (F.col("fire_count") + 1).alias("fire_count"), F.col("next_run_ms").alias("last_fired_at_ms"))


def fire(triggers: DataFrame, events: DataFrame, now_ms: int) -> DataFrame:
    """Explicit firings (trigger, payload) of enabled triggers (name, template, enabled): the jobs' payloads.

    An empty payload leaves the template's; a disabled trigger gives no row.
    """
    hit = events.join(triggers.filter("enabled"), events["trigger"] == triggers["name"])
    payload = F.when(F.octet_length(F.coalesce(events["payload"], F.lit(""))) > 0, events["payload"]).otherwise(triggers["template"])
    return hit.select("name", payload.alias("payload"), F.lit(now_ms).cast("long").alias("fired_at_ms"))


def after_fire(triggers: DataFrame, events: DataFrame, now_ms: int) -> DataFrame:
    """Triggers (name, enabled, fire_count, last_fired_at_ms) after these firings; disabled ones don't count."""
    sent = events.groupBy(F.col("trigger").alias("name")).agg(F.count("*").alias("_n"))
    row = triggers.join(sent, "name", "left")
    hit = F.col("enabled") & F.col("_n").isNotNull()
    return row.select("name", "enabled", (F.col("fire_count") + F.when(hit, F.col("_n")).otherwise(0)).alias("fire_count"), F.when(hit, F.lit(now_ms)).otherwise(F.col("last_fired_at_ms")).cast("long").alias("last_fired_at_ms"))


def match_changes(changes: DataFrame, triggers: DataFrame) -> DataFrame:
    """An opt-in extension: changes (source, name, k) that enabled triggers (source, name, trigger) listen to."""
    return changes.join(triggers.filter("enabled").select("source", "name", "trigger"), ["source", "name"])
