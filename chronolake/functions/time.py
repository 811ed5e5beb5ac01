"""Time functions. ``now`` is always given; timestamps carry no time zone."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(x: datetime) -> Column:
    """A literal without time zone."""
    return F.to_timestamp_ntz(F.lit(x.isoformat(sep=" ", timespec="microseconds")))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", at(datetime(1970, 1, 1)), ts)


def millis(ts: Column) -> Column:
    return F.floor(micros(ts) / 1000).cast("long")


def day_bucket(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def slot(ms: Column, minutes: int) -> Column:
    """Number of the slot of so many minutes since the epoch."""
    return F.floor(ms / (minutes * 60_000)).cast("long")


def daypart(ts: Column) -> Column:
    """Morning 4-11, afternoon 12-15, evening 16-19, else night."""
    h = F.hour(ts)
    return F.when(h.between(4, 11), "Morning").when(h.between(12, 15), "Afternoon").when(h.between(16, 19), "Evening").otherwise("Night")


def age_hours(ts: Column, now: datetime) -> Column:
    return F.greatest(F.lit(0.0), F.timestamp_diff("MICROSECOND", ts, at(now)) / 3.6e9)


def recency(hours: Column) -> Column:
    """1 / (1 + 0.03 h), hours up to 720."""
    return 1 / (1 + 0.03 * F.least(hours, F.lit(720.0)))


def half_life(age: Column, span: float) -> Column:
    return F.pow(F.lit(2.0), -age / span)


def ebbinghaus(decay: Column, days: Column, half_life_days: float = 21.0, floor: float = 0.15) -> Column:
    """Decayed score; rows of up to a day keep theirs."""
    return F.when(days <= 1, decay).otherwise(F.greatest(F.lit(floor), decay * F.pow(F.lit(0.5), days / half_life_days)))


def relative_filter(ts: Column, name: str | None, now: datetime) -> Column:
    """Named time filter: 1h, 24h, 7d (or week) are rolling, today and yesterday calendar days; other names filter nothing."""
    spans = {"1h": timedelta(hours=1), "24h": timedelta(hours=24), "7d": timedelta(days=7), "week": timedelta(days=7)}
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if name in spans:
        return ts >= at(now - spans[name])
    if name == "today":
        return (ts >= at(midnight)) & (ts < at(midnight + timedelta(days=1)))
    if name == "yesterday":
        return (ts >= at(midnight - timedelta(days=1))) & (ts < at(midnight))
    return F.lit(True)


def rolling_today(ts: Column, now: datetime) -> Column:
    """The planner's "today": the last 24 hours."""
    return ts >= at(now - timedelta(hours=24))


def window(ts: Column, low: datetime | None, high: datetime | None) -> Column:
    """Membership of a closed window of which either end may be open."""
    out = F.lit(True)
    if low is not None:
        out = out & (ts >= at(low))
    if high is not None:
        out = out & (ts <= at(high))
    return out


def parse_window(arg) -> tuple[datetime | None, datetime | None]:
    """A window argument: milliseconds, an ISO string (its start), or {from, to}; from after to is an error."""

    def one(x):
        if x is None or x == "":
            return None
        if isinstance(x, (int, float)):
            return datetime(1970, 1, 1) + timedelta(milliseconds=x)
        return datetime.fromisoformat(str(x).replace("Z", "")).replace(tzinfo=None)

    low, high = (one(arg.get("from")), one(arg.get("to"))) if isinstance(arg, dict) else (one(arg), None)
    if low and high and low > high:
        raise ValueError("the window ends before it begins")
    return low, high


def human_duration(minutes: Column) -> Column:
    h, m = F.floor(minutes / 60).cast("long"), F.pmod(minutes, F.lit(60)).cast("long")
    return F.when(minutes < 1, "under a minute").when(h == 0, F.concat(m.cast("string"), F.lit("m"))).otherwise(F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m")))
