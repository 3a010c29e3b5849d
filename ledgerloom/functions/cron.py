"""Five-field UTC cron expressions: minute, hour, day of month, month, day of week (0 = Sunday).

Fields hold *, numbers, lists, ranges and steps.  If both day fields are restricted, either may match; only a
bare * counts as unrestricted there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_BOUNDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))
HORIZON_DAYS = 8 * 366


def _field(text: str, low: int, high: int) -> frozenset[int]:
    allowed: set[int] = set()
    for part in text.split(","):
        body, slash, step_text = part.partition("/")
        if slash and not step_text.isdigit() or slash and int(step_text) == 0:
            raise ValueError(f"bad step in {text!r}")
        step = int(step_text) if slash else 1
        first, dash, last = body.partition("-")
        if body == "*":
            start, stop = low, high
        elif first.isdigit() and (last.isdigit() if dash else True):
            start, stop = int(first), int(last) if dash else int(first)
        else:
            raise ValueError(f"bad field {text!r}")
        if not low <= start <= stop <= high:
            raise ValueError(f"{text!r} is outside {low}-{high}")
        allowed.update(range(start, stop + 1, step))
    return frozenset(allowed)


@dataclass(frozen=True)
class Cron:
    minutes: frozenset[int]
    hours: frozenset[int]
    days: frozenset[int]
    months: frozenset[int]
    weekdays: frozenset[int]
    any_day: bool
    any_weekday: bool
    text: str = ""

    @classmethod
    def parse(cls, text: str) -> Cron:
        fields = text.split()
        if len(fields) != 5:
            raise ValueError(f"five fields are needed: {text!r}")
        sets = [_field(f, *b) for f, b in zip(fields, _BOUNDS, strict=True)]
        return cls(*sets, fields[2] == "*", fields[4] == "*", text)

    def on_day(self, day: Column) -> Column:
        """Whether the date of a timestamp fits."""
        date, week = F.dayofmonth(day).isin(*self.days), (F.dayofweek(day) - 1).isin(*self.weekdays)
        if self.any_day or self.any_weekday:
            fits = date & week  # the unrestricted field holds every value
        else:
            fits = date | week
        return F.month(day).isin(*self.months) & fits

    def matches(self, at: Column) -> Column:
        """Whether a timestamp's minute fits; the session's zone has to be UTC."""
        return self.on_day(at) & F.hour(at).isin(*self.hours) & F.minute(at).isin(*self.minutes)

    def _fits(self, days: np.ndarray) -> np.ndarray:
        """Which of these days (since 1970) fit."""
        dates = days.astype("datetime64[D]")
        months = dates.astype("datetime64[M]")
        month, date, week = months.astype(np.int64) % 12 + 1, (dates - months).astype(np.int64) + 1, (days + 4) % 7
        by_date, by_week = np.isin(date, list(self.days)), np.isin(week, list(self.weekdays))
        fits = by_date & by_week if self.any_day or self.any_weekday else by_date | by_week
        return fits & np.isin(month, list(self.months))

    def next_minutes(self, minutes: np.ndarray, days: int = HORIZON_DAYS) -> np.ndarray:
        """The first fitting minute (since 1970) strictly after each given one; -1 if none comes within `days` days.

        The fitting days of the whole span and the fitting times of a day are listed once and searched.
        """
        day, time = np.divmod(minutes, 1440)
        times = np.array([60 * h + m for h in sorted(self.hours) for m in sorted(self.minutes)])
        span = np.arange(day.min(), day.max() + days + 1) if len(day) else day
        fitting = span[self._fits(span)]
        here = np.searchsorted(fitting, day)
        today = np.append(fitting, -1)[here] == day
        slot = np.searchsorted(times, time, "right")
        later = ~today | (slot == len(times))
        here = here + (today & later)
        found = np.append(fitting, -1)[np.minimum(here, len(fitting))]
        out = found * 1440 + np.where(later, times[0], times[np.minimum(slot, len(times) - 1)])
        return np.where((here < len(fitting)) & (found <= day + days), out, -1)

    def next_after(self, at: Column, days: int = HORIZON_DAYS) -> Column:
        """The first matching minute strictly after a timestamp, null beyond the horizon of that many days."""
        return F.timestamp_millis(next_fire_ms(F.lit(self.text), F.unix_millis(at.cast("timestamp")), days))


@lru_cache(maxsize=1024)
def _parsed(text: str) -> Cron:
    return Cron.parse(text)


def next_fire_ms(expression: Column, at_ms: Column, days: int = HORIZON_DAYS) -> Column:
    """The first time (ms) strictly after at_ms that fits each row's own expression, null if there is none within `days` days."""

    @F.arrow_udf("long")
    def run(texts: pa.Array, at: pa.Array) -> pa.Array:
        ms = at.to_numpy(zero_copy_only=False)
        known = at.is_valid().to_numpy(zero_copy_only=False) & texts.is_valid().to_numpy(zero_copy_only=False)
        names, out = np.array(texts.to_pylist(), object), np.full(len(ms), -1, np.int64)
        for name in set(names[known]):
            own = np.flatnonzero(known & (names == name))
            found = _parsed(name).next_minutes(ms[own].astype(np.int64) // 60_000, days)
            out[own] = np.where(found < 0, -1, found * 60_000)
        return pa.array(out, mask=out < 0)

    return run(expression, at_ms)
