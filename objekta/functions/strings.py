"""String functions as Columns. Places count from 0, in characters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What trimming takes away: blank, tab, newline, vertical tab, carriage return.
_TRIMMED = r"[ \t\n\x0B\r]+"


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def length(s: Column) -> Column:
    return F.length(s)


def substring(s: Column, start, n) -> Column:
    """n characters from start, or as many as there are."""
    return F.substring(s, _lit(start) + 1, _lit(n))


def substr_or_null(s: Column, start, n) -> Column:
    """Null where start is negative or not before the end, or n is negative."""
    start, n = _lit(start), _lit(n)
    return F.when((start >= 0) & (start < F.length(s)) & (n >= 0), F.substring(s, start + 1, n))


def match_from(s: Column, pattern: str, start: int = 0) -> Column:
    """The first match of a regular expression from a place on; null if there is none."""
    part = F.substring(s, F.lit(start + 1), F.length(s))
    return F.when(part.rlike(pattern), F.regexp_extract(part, pattern, 0))


def lower(s: Column) -> Column:
    return F.lower(s)


def upper(s: Column) -> Column:
    return F.upper(s)


def capitalise_words(s: Column) -> Column:
    """hello_wide_world becomes HelloWideWorld. For strings without blanks."""
    return F.replace(F.initcap(F.replace(s, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))


def trim_left(s: Column) -> Column:
    return F.regexp_replace(s, "^" + _TRIMMED, "")


def trim_right(s: Column) -> Column:
    return F.regexp_replace(s, _TRIMMED + r"\z", "")


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1, bytewise."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def find(s: Column, sub, start: int = 0) -> Column:
    """Place of the first occurrence from start on, -1 if there is none."""
    return F.call_function("locate", _lit(sub), s, F.lit(start + 1)) - 1


def find_last(s: Column, sub: str) -> Column:
    """Place of the last occurrence, -1 if there is none."""
    back = F.instr(F.reverse(s), sub[::-1])
    return F.when(back == 0, -1).otherwise(F.length(s) - back - len(sub) + 1)


def append(s: Column, t) -> Column:
    return F.concat(s, _lit(t))


def prepend(s: Column, t) -> Column:
    return F.concat(_lit(t), s)


def insert(s: Column, at: int, t) -> Column:
    return F.overlay(s, _lit(t), at + 1, 0)


def erase(s: Column, at: int, n: int) -> Column:
    return F.overlay(s, F.lit(""), at + 1, n)


def overwrite(s: Column, at: int, n: int, t) -> Column:
    """n characters from a place on become t."""
    return F.overlay(s, _lit(t), at + 1, n)


def replace(s: Column, old, new) -> Column:
    """Every occurrence."""
    return F.replace(s, _lit(old), _lit(new))


def matches_whole(s: Column, pattern: str) -> Column:
    return s.rlike(rf"\A(?:{pattern})\z")


def split(s: Column, separator: str) -> Column:
    return F.split(s, re.escape(separator))


def split_by(s: Column, pattern: str) -> Column:
    return F.split(s, pattern)


def char_at(s: Column, i) -> Column:
    return F.substring(s, _lit(i) + 1, F.lit(1))


def put_char(s: Column, i: int, c) -> Column:
    return F.overlay(s, _lit(c), i + 1, 1)
