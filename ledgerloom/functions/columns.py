"""Column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def due(at: Column, now_ms: int) -> Column:
    """All boundaries are inclusive: due at exactly now."""
    return at <= F.lit(now_ms)


def shortlex(column: str) -> list[Column]:
    """Order of keys that are stored with their length in front: shorter first, then by bytes."""
    return [F.octet_length(F.col(column)), F.col(column)]


def retry_delay_ms(job_id: Column, backoff_ms: Column, attempts: Column) -> Column:
    """backoff * attempts, scaled to 91..110 % by a jitter that follows from the id's bytes and the attempts."""
    hexed = F.hex(job_id.cast("binary"))
    byte = F.transform(
        F.sequence(F.lit(0), F.octet_length(job_id.cast("binary")) - 1),
        lambda i: F.conv(F.substring(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("long"),
    )
    total = F.aggregate(byte, F.lit(0).cast("long"), lambda s, b: s + b)
    total = F.when(F.octet_length(job_id.cast("binary")) > 0, total).otherwise(0)
    scale = 91 + ((total + attempts) % 256) % 20
    scaled = backoff_ms.cast("long") * F.greatest(attempts, F.lit(1)) * scale
    return F.call_function("div", scaled, F.lit(100).cast("long"))


def counter_value(value: Column) -> Column:
    """A counter stored as eight little-endian bytes; null for any other length."""
    return F.when(F.octet_length(value) == 8, F.conv(F.hex(F.reverse(value)), 16, -10).cast("long"))
