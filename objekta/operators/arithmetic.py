"""Arithmetic of integers and floats. Integers divide to an integer, towards zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _call(name: str, *columns: Column) -> Column:
    return F.call_function(name, *columns)


def int_divide(a: Column, b: Column) -> Column:
    """Truncating; a division by zero raises, as Spark's does."""
    return _call("div", a, b)


def divide(a: Column, b: Column) -> Column:
    return a.cast("double") / b.cast("double")


def modulo(a: Column, b: Column) -> Column:
    """The sign is that of a."""
    return a % b


def shift_left(a: Column, n: int) -> Column:
    return F.shiftleft(a, n)


def shift_right(a: Column, n: int) -> Column:
    return F.shiftright(a, n)


def bit_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def bit_or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def bit_xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def bit_not(a: Column) -> Column:
    return F.bitwise_not(a)


def negate(a: Column) -> Column:
    return F.lit(0) - a


def absolute(a: Column) -> Column:
    return F.abs(a)


def join_strings(*parts: Column) -> Column:
    """+ of strings."""
    return F.concat(*parts)
