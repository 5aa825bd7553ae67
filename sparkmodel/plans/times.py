"""Times: what users write, where ranges end, and the variables that models see. All times are UTC."""

from __future__ import annotations

import calendar
import re
from datetime import UTC, date, datetime, timedelta
from enum import Enum
from typing import Any

TimeLike = datetime | date | int | float | str
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
UNITS = {"second": "seconds", "minute": "minutes", "hour": "hours", "day": "days", "week": "weeks"}
RELATIVE = re.compile(r"^(\d+)\s+(second|minute|hour|day|week|month|year)s?\s+ago$")
DAY_WORDS = {"today": 0, "yesterday": -1, "tomorrow": 1}


def add_months(t: datetime, n: int) -> datetime:
    month = t.year * 12 + t.month - 1 + n
    year, month = divmod(month, 12)
    return t.replace(year=year, month=month + 1, day=min(t.day, calendar.monthrange(year, month + 1)[1]))


def to_datetime(value: TimeLike, now: datetime | None = None) -> datetime:
    """A time from a datetime (naive: UTC), date, number (YYYYMMDD if that is a date, else epoch millis) or text.

    Text is ISO, a number, 'now', 'today', 'yesterday', 'tomorrow' (midnights) or '3 weeks ago' (days and longer:
    midnights too).
    """
    now = now or datetime.now(UTC)
    if isinstance(value, datetime):
        return value.astimezone(UTC) if value.tzinfo else value.replace(tzinfo=UTC)
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day, tzinfo=UTC)
    if isinstance(value, (int, float)):
        if isinstance(value, int) and 1000_01_01 <= value <= 9999_12_31:
            try:
                return datetime.strptime(str(value), "%Y%m%d").replace(tzinfo=UTC)
            except ValueError:
                pass
        return EPOCH + timedelta(milliseconds=value)
    text = value.strip().lower()
    if re.fullmatch(r"-?\d+", text):
        return to_datetime(int(text), now)
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if text == "now":
        return now
    if text in DAY_WORDS:
        return midnight + timedelta(days=DAY_WORDS[text])
    if m := RELATIVE.match(text):
        n, unit = int(m[1]), m[2]
        if unit in ("month", "year"):
            return add_months(midnight, -n * (12 if unit == "year" else 1))
        return (now if unit in ("second", "minute", "hour") else midnight) - timedelta(**{UNITS[unit]: n})
    return to_datetime(datetime.fromisoformat(value.strip()))


def is_date_like(value: TimeLike) -> bool:
    """Whether a value names a whole day rather than a moment."""
    if isinstance(value, datetime):
        return False
    if isinstance(value, date):
        return True
    if isinstance(value, (int, float)):
        return isinstance(value, int) and 1000_01_01 <= value <= 9999_12_31
    text = value.strip().lower()
    if text in DAY_WORDS or (m := RELATIVE.match(text)) and m[2] in ("day", "week", "month", "year"):
        return True
    return bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}|\d{8}", text))


def exclusive_end(value: TimeLike, now: datetime | None = None) -> datetime:
    """Where a range ends: a day is inside it, a moment is not."""
    end = to_datetime(value, now)
    return end + timedelta(days=1) if is_date_like(value) else end


def inclusive_end(value: TimeLike, now: datetime | None = None) -> datetime:
    """The last moment (to the microsecond) inside a range, for BETWEEN."""
    return exclusive_end(value, now) - timedelta(microseconds=1)


def millis(t: TimeLike) -> int:
    return (to_datetime(t) - EPOCH) // timedelta(milliseconds=1)


def from_millis(ms: int) -> datetime:
    return EPOCH + timedelta(milliseconds=ms)


def spellings(name: str, t: datetime) -> dict[str, Any]:
    """A time in the forms that models refer to, as <name>_<form>."""
    naive = t.replace(tzinfo=None)
    return {
        f"{name}_dt": t,
        f"{name}_dtntz": naive,
        f"{name}_date": t.date(),
        f"{name}_ds": t.strftime("%Y-%m-%d"),
        f"{name}_ts": naive.strftime("%Y-%m-%d %H:%M:%S") + (f".{naive.microsecond:06d}" if naive.microsecond else ""),
        f"{name}_tstz": t.isoformat(sep=" "),
        f"{name}_epoch": t.timestamp(),
        f"{name}_millis": millis(t),
        f"{name}_hour": t.hour,
    }


def variables(start: TimeLike | None, end: TimeLike | None, execution: TimeLike) -> dict[str, Any]:
    """All time variables; without a range (views, full refreshes) only those of the execution time."""
    out = spellings("execution", to_datetime(execution))
    if start is not None and end is not None:
        out |= spellings("start", to_datetime(start)) | spellings("end", inclusive_end(end)) | spellings("latest", inclusive_end(end))
    return out


def literal(t: datetime, kind: str, fmt: str = "%Y-%m-%d") -> Any:
    """A time as a value that compares with a column of a type: date, timestamps, or text and numbers by a format."""
    if kind == "date":
        return t.date()
    if kind == "timestamp":
        return t
    if kind == "timestamp_ntz":
        return t.replace(tzinfo=None)
    text = t.strftime(fmt)
    return text if kind == "string" else int(text)


class IntervalUnit(Enum):
    """The grain in which a model's loads are booked."""

    YEAR = 366 * 86400
    MONTH = 31 * 86400
    DAY = 86400
    HOUR = 3600
    HALF_HOUR = 1800
    QUARTER_HOUR = 900
    FIVE_MINUTE = 300

    @property
    def label(self) -> str:
        """A date_format pattern that is equal within one unit and sorts by time (small units: their minutes)."""
        return {"YEAR": "yyyy", "MONTH": "yyyy-MM", "DAY": "yyyy-MM-dd", "HOUR": "yyyy-MM-dd HH"}.get(self.name, "yyyy-MM-dd HH-mm")

    @property
    def stamp(self) -> str:
        """The strftime form of label."""
        return {"YEAR": "%Y", "MONTH": "%Y-%m", "DAY": "%Y-%m-%d", "HOUR": "%Y-%m-%d %H"}.get(self.name, "%Y-%m-%d %H-%M")

    def floor(self, t: datetime) -> datetime:
        midnight = t.replace(hour=0, minute=0, second=0, microsecond=0)
        if self is IntervalUnit.YEAR:
            return midnight.replace(month=1, day=1)
        if self is IntervalUnit.MONTH:
            return midnight.replace(day=1)
        return midnight + timedelta(seconds=(t - midnight).seconds // self.value * self.value) if self is not IntervalUnit.DAY else midnight

    def add(self, t: datetime, n: int = 1) -> datetime:
        if self in (IntervalUnit.YEAR, IntervalUnit.MONTH):
            return add_months(t, n * (12 if self is IntervalUnit.YEAR else 1))
        return t + timedelta(seconds=self.value * n)

    def ceil(self, t: datetime) -> datetime:
        low = self.floor(t)
        return low if low == t else self.add(low)


NAMED = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}
FIELDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
NAMES = ({}, {}, {}, {m.lower(): i for i, m in enumerate(calendar.month_abbr) if m}, {d: i for i, d in enumerate(("sun", "mon", "tue", "wed", "thu", "fri", "sat"))})


class Cron:
    """A schedule of five fields: lists, ranges, steps and names; a day matches by month day or week day if both are set."""

    def __init__(self, text: str):
        self.text = text
        fields = NAMED.get(text.strip().lower(), text).split()
        if len(fields) != 5:
            raise ValueError(f"a schedule has five fields: {text}")
        self.allowed = [self.parse(f, *bounds, names) for f, bounds, names in zip(fields, FIELDS, NAMES, strict=True)]
        self.allowed[4] = {d % 7 for d in self.allowed[4]}
        self.by_both = fields[2] != "*" and fields[4] != "*"

    @staticmethod
    def parse(field: str, low: int, high: int, names: dict[str, int]) -> set[int]:
        out: set[int] = set()
        for part in field.lower().split(","):
            span, _, step = part.partition("/")
            first, _, last = span.partition("-")
            value = lambda x: names.get(x) if x in names else int(x)
            a, b = (low, high) if first == "*" else (value(first), value(last) if last else (high if step else value(first)))
            if not low <= a <= b <= high:
                raise ValueError(f"{part} is not within {low}-{high}")
            out |= set(range(a, b + 1, int(step or 1)))
        return out

    def day_fits(self, t: datetime) -> bool:
        month_day, week_day = t.day in self.allowed[2], (t.weekday() + 1) % 7 in self.allowed[4]
        return t.month in self.allowed[3] and (month_day or week_day if self.by_both else month_day and week_day)

    def next(self, after: datetime) -> datetime:
        """The first time later than `after`."""
        t = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
        for _ in range(366 * 8):
            if self.day_fits(t):
                for hour in sorted(h for h in self.allowed[1] if h >= t.hour):
                    for minute in sorted(self.allowed[0]):
                        if hour > t.hour or minute >= t.minute:
                            return t.replace(hour=hour, minute=minute)
            t = t.replace(hour=0, minute=0) + timedelta(days=1)
        raise ValueError(f"{self.text} never comes")

    def previous(self, before: datetime) -> datetime:
        """The last time earlier than `before`."""
        t = (before - timedelta(microseconds=1)).replace(second=0, microsecond=0)
        for _ in range(366 * 8):
            if self.day_fits(t):
                for hour in sorted((h for h in self.allowed[1] if h <= t.hour), reverse=True):
                    for minute in sorted(self.allowed[0], reverse=True):
                        if hour < t.hour or minute <= t.minute:
                            return t.replace(hour=hour, minute=minute)
            t = t.replace(hour=23, minute=59) - timedelta(days=1)
        raise ValueError(f"{self.text} never comes")

    def floor(self, t: datetime) -> datetime:
        """t itself if the schedule has it, else the time before."""
        return self.previous(t + timedelta(microseconds=1))

    def unit(self) -> IntervalUnit:
        """The largest unit that fits into every gap of the schedule."""
        t, gaps = datetime(2020, 1, 1, tzinfo=UTC), []
        for _ in range(50):
            n = self.next(t)
            gaps.append((n - t).total_seconds())
            t = n
        least = min(gaps[1:])
        if least >= 365 * 86400:
            return IntervalUnit.YEAR
        if least >= 28 * 86400:
            return IntervalUnit.MONTH
        return next((u for u in IntervalUnit if u.value <= least and u.value <= 86400), IntervalUnit.FIVE_MINUTE)
