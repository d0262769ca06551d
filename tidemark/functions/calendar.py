"""Calendar arithmetic: months that overflow, ISO weeks, retention tiers, schedules and blackout windows."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400


def plus_months(at: Column, months: Column | int) -> Column:
    """A calendar month later with overflow: the 31st of a month of 30 days is the first of the next."""
    n = F.lit(months) if isinstance(months, int) else months
    day = F.date_add(F.add_months(F.trunc(at, "MM"), n), F.dayofmonth(at) - 1)
    return at_time_of(day, at)


def at_time_of(day: Column, at: Column) -> Column:
    """The time of day of one moment on another day."""
    return F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.date_trunc("day", at).cast("timestamp")))


def plus_days(at: Column, days: Column | int) -> Column:
    n = F.lit(days) if isinstance(days, int) else days
    return F.timestamp_micros(F.unix_micros(at.cast("timestamp")) + n.cast("long") * F.lit(DAY * 1_000_000).cast("long"))


def day_key(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def week_key(at: Column) -> Column:
    """ISO year and week."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), at).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(at).cast("string"), 2, "0"))


def month_key(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def next_month_start(at: Column) -> Column:
    return F.add_months(F.trunc(at, "MM"), 1)


def tier_until(at: Column, base_days: int, daily: int = 0, weekly: int = 0, monthly: int = 0) -> dict[str, Column]:
    """How long a backup of each tier is kept, never shorter than the base."""
    base = plus_days(at, base_days)
    found = {"base": base}
    if daily:
        found["daily"] = F.greatest(base, plus_days(at, daily))
    if weekly:
        found["weekly"] = F.greatest(base, plus_days(at, 7 * weekly))
    if monthly:
        found["monthly"] = F.greatest(base, plus_months(at, monthly))
    return found


_FIELDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


class Cron:
    """Five fields of numbers, lists, ranges and steps; 7 is Sunday too; day of month or of week when both are set."""

    def __init__(self, text: str):
        if m := re.fullmatch(r"at (\d{1,2}):(\d{2})", text.strip()):
            text = f"{int(m[2])} {int(m[1])} * * *"
        fields = text.split()
        if len(fields) != 5:
            raise ValueError(f"not a schedule: {text!r}")
        self.sets = [self._field(f, *b) for f, b in zip(fields, _FIELDS, strict=True)]
        self.sets[4] = {d % 7 for d in self.sets[4]}
        self.any_day, self.any_weekday = fields[2] == "*", fields[4] == "*"
        if len(self.sets[0]) > 1:
            raise ValueError("more often than once an hour")
        if self.next(dt.datetime(2024, 1, 1)) is None:
            raise ValueError(f"never comes: {text!r}")

    @staticmethod
    def _field(text: str, low: int, high: int) -> set[int]:
        found: set[int] = set()
        for part in text.split(","):
            m = re.fullmatch(r"(\*|\d+(?:-\d+)?)(?:/(\d+))?", part)
            if not m:
                raise ValueError(f"not a schedule field: {text!r}")
            step = int(m[2] or 1)
            a, b = (low, high) if m[1] == "*" else (int(m[1].split("-")[0]), int(m[1].split("-")[-1]))
            b = high if m[2] and "-" not in m[1] else b
            if not (low <= a <= b <= high) or step < 1:
                raise ValueError(f"out of range: {text!r}")
            found |= set(range(a, b + 1, step))
        return found

    def on(self, day: dt.date) -> bool:
        by_day, by_week = day.day in self.sets[2], (day.weekday() + 1) % 7 in self.sets[4]
        if not self.any_day and not self.any_weekday:
            return day.month in self.sets[3] and (by_day or by_week)
        return day.month in self.sets[3] and by_day and by_week

    def next(self, after: dt.datetime, years: int = 5) -> dt.datetime | None:
        """The first moment after `after`, within `years`."""
        day = after.date()
        for _ in range(366 * years):
            if self.on(day):
                for h in sorted(self.sets[1]):
                    for m in sorted(self.sets[0]):
                        at = dt.datetime.combine(day, dt.time(h, m))
                        if at > after:
                            return at
            day += dt.timedelta(days=1)
        return None

    def moments(self, start: dt.datetime, end: dt.datetime) -> Iterator[dt.datetime]:
        at = self.next(start)
        while at and at < end:
            yield at
            at = self.next(at)

    def longest_gap(self, start: dt.datetime = dt.datetime(2026, 1, 1)) -> dt.timedelta:
        found = list(self.moments(start, start + dt.timedelta(days=366)))
        return max((b - a for a, b in zip(found, found[1:], strict=False)), default=dt.timedelta(days=366))


def parse_interval(text: str) -> dt.timedelta:
    """`daily` or nothing, `Nd`, or hours and minutes; at least an hour, at most 64-bit nanoseconds."""
    text = text.strip()
    if text in ("", "daily"):
        return dt.timedelta(hours=24)
    named = {"hourly": 1, "weekly": 168}
    if text in named:
        return dt.timedelta(hours=named[text])
    if m := re.fullmatch(r"(-?\d+)d", text):
        seconds = int(m[1]) * DAY
    elif m := re.fullmatch(r"(-?)(?:(\d+)h)?(?:(\d+)m)?(?:(\d+)s)?", text):
        seconds = (int(m[2] or 0) * 3600 + int(m[3] or 0) * 60 + int(m[4] or 0)) * (-1 if m[1] else 1)
    else:
        raise ValueError(f"not an interval: {text!r}")
    if seconds < 3600 or seconds * 10**9 >= 1 << 63:
        raise ValueError(f"out of range: {text!r}")
    return dt.timedelta(seconds=seconds)


def parse_blackout(text: str) -> list[tuple[int, int]]:
    """(start, end) minutes of `HH:MM-HH:MM` windows parted by commas; an end before its start is on the next day."""
    found = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(r"(\d{2}):(\d{2})-(\d{2}):(\d{2})", part)
        if not m:
            raise ValueError(f"not a window: {part!r}")
        a, b = int(m[1]) * 60 + int(m[2]), int(m[3]) * 60 + int(m[4])
        if a == b or max(a, b) >= 1440:
            raise ValueError(f"not a window: {part!r}")
        found.append((a, b))
    return found


def coalesced(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Windows that overlap or touch joined, as (start, length); a window over midnight joins one at the day's start."""
    spans = sorted((a, b if b > a else b + 1440) for a, b in windows)
    spans = sorted(spans + [(a + 1440, b + 1440) for a, b in spans])
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return sorted({(a % 1440, min(b - a, 1440)) for a, b in out if a < 1440})


def minute_of(at: Column) -> Column:
    return F.hour(at) * 60 + F.minute(at)


def in_blackout(at: Column, windows: list[tuple[int, int]]) -> Column:
    """Whether a moment lies in a window; starts belong to it, ends do not."""
    m = minute_of(at)
    found = F.lit(False)
    for a, b in windows:
        found = found | (((m >= a) & (m < b)) if a < b else ((m >= a) | (m < b)))
    return found


def blackout_end(at: Column, windows: list[tuple[int, int]]) -> Column:
    """When the joined window that a moment lies in ends; null outside of all."""
    m = minute_of(at)
    start = F.date_trunc("day", at)
    end = F.lit(None).cast("timestamp")
    for a, length in coalesced(windows):
        since = F.pmod(m - a, F.lit(1440))
        stop = F.timestamp_micros(F.unix_micros(start.cast("timestamp")) + (m - since + length).cast("long") * F.lit(60_000_000).cast("long"))
        end = F.when(since < length, stop).otherwise(end)
    return end


def next_run(at: Column, schedule: str) -> Column:
    """The first moment of a schedule after each moment, as a timestamp without zone; each distinct minute of a batch is
    looked up once."""
    cron = Cron(schedule)

    @F.pandas_udf("timestamp_ntz")
    def following(moments: pd.Series) -> pd.Series:
        minutes = pd.to_datetime(moments).dt.floor("min")
        found = {m: cron.next(pd.Timestamp(m).to_pydatetime()) for m in minutes.dropna().unique()}
        return pd.to_datetime(minutes.map(found))

    return following(at.cast("timestamp_ntz"))


def blackout_minutes(windows: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """by, minutes, windows: total length of windows given by their minutes of the day; one that ends before it starts
    passes midnight, one that ends where it starts is empty."""
    length = F.pmod(F.col(end) - F.col(start), F.lit(1440)).cast("long")
    return windows.groupBy(*by).agg(F.sum(length).alias("minutes"), F.count(F.lit(1)).alias("windows"))
