"""Time ranges of the statistics: instants computed once, on the driver."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from zoneinfo import ZoneInfo

UTC = dt.timezone.utc


def _instant(local: dt.datetime, tz: str) -> dt.datetime:
    return local.replace(tzinfo=ZoneInfo(tz)).astimezone(UTC)


def day_bounds(date: dt.date, tz: str) -> tuple[dt.datetime, dt.datetime]:
    """First instant of a local calendar date and of the next one."""
    midnight = dt.datetime.combine(date, dt.time())
    return _instant(midnight, tz), _instant(midnight + dt.timedelta(days=1), tz)


def instant(moment: dt.datetime) -> dt.datetime:
    """A moment without a zone is taken as UTC."""
    return moment.astimezone(UTC) if moment.tzinfo else moment.replace(tzinfo=UTC)


@dataclass(frozen=True)
class Range:
    """Bounds of a range; ``stop`` is the earlier of its end and ``as_of``."""

    start: dt.datetime
    end: dt.datetime
    stop: dt.datetime
    granularity: str
    first_date: dt.date
    days: int
    tz: str

    @property
    def minutes(self) -> float:
        return (self.stop - self.start).total_seconds() / 60


def range_bounds(name: str, as_of: dt.datetime, tz: str = "UTC") -> Range:
    """``today`` and ``yesterday`` by hour, ``7d`` and ``30d`` by day including the day of ``as_of``."""
    now = instant(as_of)
    today = now.astimezone(ZoneInfo(tz)).date()
    back, days = {"today": (0, 1), "yesterday": (1, 1), "7d": (6, 7), "30d": (29, 30)}[name]
    first = today - dt.timedelta(days=back)
    start = day_bounds(first, tz)[0]
    end = day_bounds(first + dt.timedelta(days=days - 1), tz)[1]
    granularity = "hour" if days == 1 else "day"
    return Range(start, end, min(end, now), granularity, first, days, tz)
