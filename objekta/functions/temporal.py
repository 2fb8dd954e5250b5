"""Dates, times of day, time stamps and intervals. Times of day and intervals are microseconds (long)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Julian day of 1970-01-01.
EPOCH_JULIAN = 2440588
SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR
#: Weekdays count from Sunday, 0.
WEEKDAYS = ("SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT")
#: strftime's letters and Spark's.
FORMATS = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "j": "DDD", "a": "EEE", "A": "EEEE", "b": "MMM", "B": "MMMM", "%": "%"}


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def micros(ts: Column) -> Column:
    """Microseconds since 1970."""
    return F.unix_micros(ts.cast("timestamp"))


def date(y, m, d) -> Column:
    return F.make_date(_lit(y), _lit(m), _lit(d))


def date_of(text: Column) -> Column:
    return F.to_date(text, "yyyy-MM-dd")


def julian(d: Column) -> Column:
    return F.datediff(d, F.lit("1970-01-01").cast("date")) + EPOCH_JULIAN


def from_julian(n: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (n - EPOCH_JULIAN).cast("int"))


def weekday(d: Column) -> Column:
    return F.dayofweek(d) - 1


def is_leap_year(d: Column) -> Column:
    y = F.year(d)
    return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))


def is_between(d: Column, a: Column, b: Column) -> Column:
    """Both ends are outside; their order doesn't matter."""
    return (d > F.least(a, b)) & (d < F.greatest(a, b))


def next_weekday(d: Column, which: int) -> Column:
    """The day itself if it is one."""
    return F.when(weekday(d) == which, d).otherwise(F.next_day(d, WEEKDAYS[which]))


def previous_weekday(d: Column, which: int) -> Column:
    return F.when(weekday(d) == which, d).otherwise(F.date_sub(F.next_day(d, WEEKDAYS[which]), 7))


def add_days(d: Column, n) -> Column:
    return F.date_add(d, _lit(n))


def subtract_days(d: Column, n) -> Column:
    return F.date_sub(d, _lit(n))


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(a, b)


def time(h, m, s, us=0) -> Column:
    """A time of day."""
    return _lit(h).cast("long") * HOUR + _lit(m).cast("long") * MINUTE + _lit(s).cast("long") * SECOND + _lit(us).cast("long")


def time_of(ts: Column) -> Column:
    return F.pmod(micros(ts), F.lit(DAY))


def add_to_time(t: Column, interval) -> Column:
    """Within the day: past midnight it starts anew."""
    return F.pmod(t + _lit(interval), F.lit(DAY))


def hour_of(t: Column) -> Column:
    return F.floor(t / HOUR).cast("long")


def minute_of(t: Column) -> Column:
    return F.floor(F.pmod(t, F.lit(HOUR)) / MINUTE).cast("long")


def second_of(t: Column) -> Column:
    return F.floor(F.pmod(t, F.lit(MINUTE)) / SECOND).cast("long")


def microsecond_of(t: Column) -> Column:
    return F.pmod(t, F.lit(SECOND))


def stamp(us: Column) -> Column:
    """A time stamp from microseconds since 1970."""
    return F.timestamp_micros(us)


def plus(ts: Column, interval) -> Column:
    return F.timestamp_micros(micros(ts) + _lit(interval))


def minus(ts: Column, interval) -> Column:
    return F.timestamp_micros(micros(ts) - _lit(interval))


def zoned(ts: Column, minutes) -> Column:
    """The clock of a zone that is so many minutes ahead of GMT."""
    return plus(ts, _lit(minutes).cast("long") * MINUTE)


def to_gmt(ts: Column, minutes) -> Column:
    return minus(ts, _lit(minutes).cast("long") * MINUTE)


def interval_between(a: Column, b: Column) -> Column:
    return micros(a) - micros(b)


def interval(days=0, hours=0, minutes=0, seconds=0) -> Column:
    return _lit(days).cast("long") * DAY + _lit(hours).cast("long") * HOUR + _lit(minutes).cast("long") * MINUTE + _lit(seconds).cast("long") * SECOND


def interval_parts(us: Column) -> Column:
    """days, hours, minutes, seconds of an interval; all have its sign."""
    return F.struct(*[(F.call_function("div", us, F.lit(unit)) % (whole or (1 << 62))).alias(n) for n, unit, whole in (("days", DAY, 0), ("hours", HOUR, 24), ("minutes", MINUTE, 60), ("seconds", SECOND, 60))])


def product(us: Column, n) -> Column:
    return us * _lit(n)


def quotient(us: Column, n) -> Column:
    return F.call_function("div", us, _lit(n))


def is_zero(us: Column) -> Column:
    return us == 0


def time_format(seconds: Column, fmt: str) -> Column:
    """strftime of seconds since 1970, in the session's time zone."""
    out = []
    for code, plain in re.findall(r"%(.)|([^%]+)", fmt):
        if code and code not in FORMATS:
            raise ValueError(f"no format %{code}")
        out.append(FORMATS[code] if code else re.sub(r"[A-Za-z]+", r"'\g<0>'", plain.replace("'", "''")))
    return F.date_format(F.timestamp_seconds(seconds), "".join(out))
