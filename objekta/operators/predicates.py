"""Predicates and logic as Columns. Equality is two-valued: null equals null and nothing else."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import Column
from pyspark.sql import functions as F


def equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def different(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def compare(a: Column, op: Literal["<", "<=", ">", ">="], b: Column, null_is_true: bool = False) -> Column:
    """Order of numbers or strings (bytewise). A null makes it false; null_is_true: exactly one null makes it true, two false."""
    found = F.coalesce({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op], F.lit(False))
    return F.when(a.isNull() != b.isNull(), True).otherwise(found) if null_is_true else found


def between(x: Column, low: Column, high: Column, ends: Literal["[]", "[[", "][", "]]"] = "[]") -> Column:
    """Brackets as written: [ a low end that belongs, ] one that doesn't; ] a high end that belongs, [ one that doesn't."""
    above = x >= low if ends[0] == "[" else x > low
    below = x <= high if ends[1] == "]" else x < high
    return F.coalesce(above & below, F.lit(False))


def matches(x: Column, pattern: str, ignore_case: bool = False) -> Column:
    """A regular expression occurs in x; also what the keyword like means here."""
    return F.coalesce(x.rlike(("(?i)" if ignore_case else "") + pattern), F.lit(False))


def differs(x: Column, pattern: str, ignore_case: bool = False) -> Column:
    return ~matches(x, pattern, ignore_case)


def is_in(x: Column, values: Column | list | tuple | set) -> Column:
    """Membership in a collection column, or among plain values, which reaches the scan; a null is in a collection that has a null."""
    if not isinstance(values, Column):
        known = x.isin([v for v in values if v is not None])
        return known & x.isNotNull() if None not in values else known | x.isNull()
    return F.coalesce(F.exists(values, lambda e: e.eqNullSafe(x)), F.lit(False))


def choose(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(condition, yes).otherwise(no)


def for_all(values: Column, condition) -> Column:
    """Every element meets it; true of none."""
    return F.coalesce(F.forall(values, lambda e: F.coalesce(condition(e), F.lit(False))), F.lit(True))


def there_is(values: Column, condition) -> Column:
    return F.coalesce(F.exists(values, lambda e: F.coalesce(condition(e), F.lit(False))), F.lit(False))


def for_some(values: Column, least: int, most: int | None, condition) -> Column:
    """The number of elements that meet it lies within [least, most]; most None: the collection's size."""
    n = F.coalesce(F.size(F.filter(values, lambda e: F.coalesce(condition(e), F.lit(False)))), F.lit(0))
    n = F.greatest(n, F.lit(0))
    return n >= least if most is None else n.between(least, most)


def lists_ordered(a: Column, op: Literal["<", "<=", ">", ">="], b: Column) -> Column:
    """Two lists element by element: the comparison holds at each place of the shorter."""
    test = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.coalesce(test(x, y), F.lit(False)))
    return F.forall(pairs, lambda x: x)
