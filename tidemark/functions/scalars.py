"""Column expressions shared by the operators. All timestamps are zone-less UTC."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import TREND_THRESHOLD_PCT

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def instant(value: datetime) -> Column:
    """A Python datetime as a timestamp_ntz literal, in UTC whatever the session zone."""
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def epoch_ms_to_ts(ms: Column) -> Column:
    """Epoch milliseconds (integer or float) to timestamp_ntz; NULL stays NULL."""
    micros = F.round(ms.cast("double") * 1000.0).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, F.expr(_EPOCH))


def ts_to_epoch_ms(ts: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", F.expr(_EPOCH), ts).cast("double")


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def week_start(ts: Column) -> Column:
    """Monday 00:00 of the week."""
    return F.trunc(ts.cast("date"), "week").cast("timestamp_ntz")


def month_start(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "month").cast("timestamp_ntz")


def calendar_days(created: Column, now: datetime) -> Column:
    """Day boundaries crossed between `created` and `now`."""
    return F.datediff(instant(now).cast("date"), created.cast("date"))


def elapsed_days(created: Column, now: datetime) -> Column:
    """Whole 24-hour periods between `created` and `now`, at least 1."""
    days = F.timestamp_diff("DAY", created, instant(now)).cast("int")
    return F.when(created.isNotNull(), F.greatest(days, F.lit(1)))


def daily_rate(count: Column, created: Column, now: datetime) -> Column:
    """Lifetime count per calendar day; an unknown age counts as one day."""
    return count / F.greatest(calendar_days(created, now), F.lit(1))


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Round half away from zero on the scaled binary value, as SQL engines do on doubles.

    `F.round` rounds the printed decimal instead, which differs for values such as 1.005.
    """
    scale = float(10**digits)
    return F.round(value.cast("double") * scale) / F.lit(scale)


def round_half_even(value: Column) -> Column:
    """Round to whole numbers, ties to even."""
    return F.bround(value.cast("double"), 0)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double; NULL unless whole is positive."""
    return F.when(whole > 0, part / whole)


def trend(recent: Column, prior: Column, threshold_pct: float = TREND_THRESHOLD_PCT) -> Column:
    """'up', 'down' or 'flat' by relative change; unknown or zero prior is flat."""
    change = F.when(prior != 0, (recent - prior) / F.abs(prior) * 100.0)
    return (
        F.when(change > threshold_pct, "up").when(change < -threshold_pct, "down").otherwise("flat")
    )


def owner_key(handle: Column) -> Column:
    """File- and URL-safe form of an owner handle."""
    return F.regexp_replace(F.lower(handle), "[^a-z0-9_-]", "-")


def json_text(value: Column) -> Column:
    """A variant as JSON text, nested values as they are; NULL when it is absent or empty."""
    text = F.to_json(value)
    return F.when(~text.isin("null", "{}", "[]", '""', "false", "0", "0.0"), text)


def json_keys(text: Column) -> Column:
    """Keys of a JSON object; an empty array for NULL or malformed text."""
    parsed = F.from_json(text, "map<string,string>")
    return F.coalesce(F.map_keys(parsed), F.array().cast("array<string>"))


def label(name: Column, slug: Column) -> Column:
    """Display name, or the slug where the name is missing or empty."""
    return F.coalesce(F.nullif(name, F.lit("")), slug)
