"""Date ranges of queries, worked out on the driver before a plan is made."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone, tzinfo


@dataclass(frozen=True)
class DateRange:
    """[start, end) in UTC; None is open."""

    start: datetime | None = None
    end: datetime | None = None


def day_start(at: datetime, tz: tzinfo) -> datetime:
    return at.astimezone(tz).replace(hour=0, minute=0, second=0, microsecond=0).astimezone(timezone.utc)


def months_before(at: datetime, months: int, tz: tzinfo) -> datetime:
    """The same day of an earlier month, or that month's last day."""
    local = at.astimezone(tz)
    year, month = divmod(local.year * 12 + local.month - 1 - months, 12)
    return local.replace(year=year, month=month + 1, day=min(local.day, calendar.monthrange(year, month + 1)[1])).astimezone(timezone.utc)


def _month_start(at: datetime, tz: tzinfo) -> datetime:
    return day_start(at.astimezone(tz).replace(day=1), tz)


def relative(term: str, now: datetime, tz: tzinfo = timezone.utc) -> DateRange | None:
    """today, yesterday, this-week, last-week (from Monday), this-month, last-month."""
    today = day_start(now, tz)
    monday = day_start(now.astimezone(tz) - timedelta(days=now.astimezone(tz).weekday()), tz)
    month = _month_start(now, tz)
    day, week = timedelta(days=1), timedelta(days=7)
    return {
        "today": DateRange(today, today + day),
        "yesterday": DateRange(today - day, today),
        "this-week": DateRange(monday, monday + week),
        "last-week": DateRange(monday - week, monday),
        "this-month": DateRange(month, _month_start(month + timedelta(days=32), tz)),
        "last-month": DateRange(_month_start(month - day, tz), month),
    }.get(term)


def absolute(text: str, tz: tzinfo = timezone.utc) -> datetime | None:
    """An RFC 3339 instant, or a date at local midnight."""
    try:
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
            return datetime.fromisoformat(text).replace(tzinfo=tz).astimezone(timezone.utc)
        at = datetime.fromisoformat(text)
        return at.astimezone(timezone.utc) if at.tzinfo else None
    except ValueError:
        return None


def ago(text: str, now: datetime, tz: tzinfo = timezone.utc) -> datetime | None:
    """3d, 2w or 1m before now, at the start of that day."""
    m = re.fullmatch(r"(\d+)([dwm])", text)
    if not m or int(m[1]) == 0:
        return None
    n = int(m[1])
    at = months_before(now, n, tz) if m[2] == "m" else now - timedelta(days=n * (7 if m[2] == "w" else 1))
    return day_start(at, tz)


def build_range(date: str | None, start: str | None, end: str | None, now: datetime, tz: tzinfo = timezone.utc) -> DateRange:
    """A relative term wins over bounds; what can't be read is an error."""
    if date:
        found = relative(date, now, tz)
        if found is None:
            raise ValueError(f"unknown date term: {date}")
        return found

    def bound(text: str | None) -> datetime | None:
        if text is None:
            return None
        at = absolute(text, tz) or ago(text, now, tz)
        if at is None:
            raise ValueError(f"can't read date: {text}")
        return at

    return DateRange(bound(start), bound(end))
