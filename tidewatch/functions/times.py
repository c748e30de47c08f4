"""Naive-UTC time arithmetic. "Now" is always an argument named ``as_of``."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

# The lookback range in hours, and the site's time zone.
MIN_HOURS, MAX_HOURS, DEFAULT_HOURS = 1, 168, 24
SITE_ZONE = "Asia/Jakarta"


def clamp_hours(hours: int | None) -> int:
    if hours is None:
        return DEFAULT_HOURS
    return max(MIN_HOURS, min(hours, MAX_HOURS))


def naive_utc(moment: datetime | str) -> datetime:
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment)
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return moment


def moment_literal(moment: datetime | str) -> str:
    return f"TIMESTAMP_NTZ'{naive_utc(moment).isoformat(sep=' ')}'"


def hours_before(as_of: datetime | str, hours: int) -> datetime:
    return naive_utc(as_of) - timedelta(hours=hours)


def floor_hour(timestamp: str) -> str:
    """Start of the hour. Stays a naive time, unlike ``date_trunc``, which yields a zoned one."""
    return f"{timestamp} - make_dt_interval(0, 0, minute({timestamp}), extract(SECOND FROM {timestamp}))"


def local_time(timestamp: str, zone: str = SITE_ZONE) -> str:
    return f"convert_timezone('UTC', '{zone}', {timestamp})"
