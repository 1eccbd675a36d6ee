"""Calendar expressions on dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(key: Column | str) -> Column:
    """Date of an integer yyyymmdd."""
    return F.to_date((F.col(key) if isinstance(key, str) else key).cast("string"), "yyyyMMdd")


def next_month_end(d: Column | str) -> Column:
    """Month end after a month end."""
    return F.last_day(F.add_months(d, 1))


def formation_year(d: Column | str) -> Column:
    """Year whose June formation holds at d: July to next June."""
    return F.when(F.month(d) >= 7, F.year(d)).otherwise(F.year(d) - 1).cast("long")


def is_tuesday(d: Column | str) -> Column:
    return F.weekday(d) == 1


def session_minute(ts: Column | str, zone: str = "America/New_York") -> Column:
    """Minutes since 09:30 of a UTC time in the exchange's zone, daylight saving considered."""
    local = F.from_utc_timestamp(ts, zone)
    return (F.hour(local) * 60 + F.minute(local) - 570).cast("int")


def third_friday(d: Column | str) -> Column:
    """Third Friday of d's month."""
    first = F.trunc(d, "month")
    return F.date_add(F.next_day(F.date_sub(first, 1), "Fri"), 14)


def quarter_start(d: Column | str) -> Column:
    return F.trunc(d, "quarter")


def quarter_end(d: Column | str) -> Column:
    return F.date_sub(F.add_months(F.trunc(d, "quarter"), 3), 1)


def open_minute_utc(d: Column | str, zone: str = "America/New_York") -> Column:
    """Minute of the UTC day at which the exchange opens (09:30 in its zone) on date d."""
    at = F.to_utc_timestamp(F.timestamp_seconds(F.unix_date(d).cast("long") * 86_400 + 570 * 60), zone)
    return (F.hour(at) * 60 + F.minute(at)).cast("int")
