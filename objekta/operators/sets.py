"""Set operators: over array columns (a collection in a row) and over DataFrames (a collection as rows).

A set has each element once; a bag may repeat them. Membership is null-safe equality. Of two bags, intersect and except
keep the left elements with their multiplicity, so they are semi and anti joins and not multiset minima.
"""

from __future__ import annotations

from functools import reduce
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Kind = Literal["set", "bag"]
Result = Literal["set", "bag", "list"]


def marked(df: DataFrame, kind: Result) -> DataFrame:
    """Notes what kind of collection a result is: select distinct gives a set, order by a list, any other select a bag. Later DataFrame operations forget it."""
    df.object_kind = kind
    return df


def kind_of(df: DataFrame) -> Result:
    return getattr(df, "object_kind", "bag")


def own_kinds(a: DataFrame, b: DataFrame) -> tuple[Kind, Kind]:
    """The kinds that two results carry, for the operators below; a list raises there."""
    return kind_of(a), kind_of(b)


def _kind(a: Kind, b: Kind) -> Kind:
    if not {a, b} <= {"set", "bag"}:
        raise TypeError(f"set operators take sets and bags, not {a} and {b}")
    return "bag" if "bag" in (a, b) else "set"


def has(values: Column, x: Column) -> Column:
    return F.exists(values, lambda e: e.eqNullSafe(x))


def union(a: Column, b: Column, kinds: tuple[Kind, Kind] = ("set", "set")) -> Column:
    """A bag if either is one, else a set."""
    return F.concat(a, b) if _kind(*kinds) == "bag" else F.array_union(a, b)


def intersect(a: Column, b: Column, kinds: tuple[Kind, Kind] = ("set", "set")) -> Column:
    return F.filter(a, lambda x: has(b, x)) if _kind(*kinds) == "bag" else F.array_intersect(a, b)


def except_(a: Column, b: Column, kinds: tuple[Kind, Kind] = ("set", "set")) -> Column:
    return F.filter(a, lambda x: ~has(b, x)) if _kind(*kinds) == "bag" else F.array_except(a, b)


def included(a: Column, b: Column) -> Column:
    """a <= b: every element of a is in b."""
    return F.forall(a, lambda x: has(b, x))


def properly_included(a: Column, b: Column) -> Column:
    """a < b: included, and fewer elements."""
    return (F.size(a) < F.size(b)) & included(a, b)


def same(a: Column, b: Column, kinds: tuple[Kind, Kind] = ("set", "set")) -> Column:
    """One kind, as many elements, every right one in the left; multiplicities are not compared."""
    if kinds[0] != kinds[1]:
        return F.lit(False)
    return (F.size(a) == F.size(b)) & included(b, a)


def add(a: Column, b: Column, kind: Literal["set", "bag", "list", "array"]) -> Column:
    """+ of two collections of a kind."""
    return F.array_union(a, b) if kind == "set" else F.concat(a, b)


def union_rows(a: DataFrame, b: DataFrame, kinds: tuple[Kind, Kind] = ("set", "set")) -> DataFrame:
    both = a.unionByName(b)
    return both if _kind(*kinds) == "bag" else both.distinct()


def _on_all(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Distinct right rows, as multiplicities there never matter: that also thins them before the shuffle."""
    left, right = a.alias("a"), b.select(*a.columns).distinct().alias("b")
    same_row = reduce(lambda x, y: x & y, [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in a.columns])
    return left.join(right, same_row, how)


def intersect_rows(a: DataFrame, b: DataFrame, kinds: tuple[Kind, Kind] = ("set", "set")) -> DataFrame:
    return _on_all(a, b, "left_semi") if _kind(*kinds) == "bag" else a.intersect(b.select(*a.columns))


def except_rows(a: DataFrame, b: DataFrame, kinds: tuple[Kind, Kind] = ("set", "set")) -> DataFrame:
    return _on_all(a, b, "left_anti") if _kind(*kinds) == "bag" else a.subtract(b.select(*a.columns))


def included_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: included, properly_included. Counts happen on the executors."""
    missing = _on_all(a, b, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    sizes = a.agg(F.count(F.lit(1)).alias("n_a")).crossJoin(b.agg(F.count(F.lit(1)).alias("n_b")))
    return missing.crossJoin(sizes).select((F.col("missing") == 0).alias("included"), ((F.col("missing") == 0) & (F.col("n_a") < F.col("n_b"))).alias("properly_included"))
