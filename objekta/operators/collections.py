"""Collections in array columns: constructors, access, order, aggregates, conversions and changes. Places count from 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

MAXINT = (1 << 63) - 1
MININT = -(1 << 63)


def make_list(*items: Column) -> Column:
    return F.array(*items)


make_bag = make_array = make_list


def make_set(*items: Column) -> Column:
    return F.array_distinct(F.array(*items))


def struct_of(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def to_set(values: Column) -> Column:
    """Of a list, bag or array; the other conversions change nothing but the kind's name."""
    return F.array_distinct(values)


def convert(df: DataFrame, name: str, kind: str) -> Column:
    """toset, tobag, tolist and toarray of a column that must be a collection; others raise."""
    if kind not in ("set", "bag", "list", "array"):
        raise ValueError(f"no kind of collection: {kind}")
    found = df.schema[name].dataType
    if not isinstance(found, ArrayType):
        raise TypeError(f"to {kind}: collection expected, got {found.simpleString()} {name}")
    return to_set(F.col(name)) if kind == "set" else F.col(name)


def contents(values: Column, kind: str = "list") -> Column:
    """The elements of a collection value; of an array they are a set."""
    return to_set(values) if kind == "array" else values


def at(values: Column, i: int | Column) -> Column:
    """The element at a place; outside the collection it raises."""
    return F.element_at(values, (F.lit(i) if isinstance(i, int) else i) + 1)


def at_or_null(values: Column, i: int | Column) -> Column:
    return F.get(values, F.lit(i) if isinstance(i, int) else i)


def char_at(text: Column, i: int) -> Column:
    return F.substring(text, i + 1, 1)


def part(values: Column, i: int, j: int | None = None) -> Column:
    """[i:j], both ends included; j None: to the end."""
    return F.slice(values, i + 1, F.size(values) if j is None else j - i + 1)


def char_part(text: Column, i: int, j: int) -> Column:
    """[i:j] of a string: the list of its characters."""
    return F.filter(F.split(F.substring(text, i + 1, j - i + 1), ""), lambda c: c != "")


def indexed(values: Column) -> Column:
    """(index, value) pairs, as a sparse array keeps them; places without a value are left out."""
    return F.filter(F.transform(values, lambda x, i: F.struct(i.alias("index"), x.alias("value"))), lambda p: p["value"].isNotNull())


def cardinality(values: Column) -> Column:
    """0 of nothing; nulls count."""
    return F.when(values.isNull(), 0).otherwise(F.size(values))


count = cardinality


def dimensions(values: Column, depth: int) -> Column:
    """Sizes of a regular array of arrays, outermost first."""
    sizes = []
    for _ in range(depth):
        sizes.append(F.size(values))
        values = F.get(values, F.lit(0))
    return F.array(*sizes)


def split_every(values: Column, n: int) -> Column:
    """An array of arrays of n elements each (the last may have fewer)."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(n))
    return F.when(F.size(values) > 0, F.transform(starts, lambda i: F.slice(values, i, n))).otherwise(F.slice(F.array(values), 1, 0))


def total(values: Column, nulls_raise: bool = False) -> Column:
    """0 of no elements. Nulls are skipped unless they are to raise."""
    zero = F.lit(0).cast("double")
    if nulls_raise:
        return F.aggregate(values, zero, lambda acc, x: acc + F.when(x.isNull(), F.raise_error(F.lit("sum of a null")).cast("double")).otherwise(x))
    return F.aggregate(values, zero, lambda acc, x: acc + F.coalesce(x, F.lit(0)))


def average(values: Column) -> Column:
    """Of the elements that are not null; null of none."""
    some = F.filter(values, lambda x: x.isNotNull())
    return F.try_divide(total(some), F.size(some))


def least(values: Column, empty: Column | None = None) -> Column:
    """Nulls are skipped. empty: what no elements give (null, or the largest integer for callers that expect a sentinel)."""
    found = F.array_min(values)
    return found if empty is None else F.coalesce(found, empty)


def greatest(values: Column, empty: Column | None = None) -> Column:
    found = F.array_max(values)
    return found if empty is None else F.coalesce(found, empty)


def first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def rest(values: Column) -> Column:
    """All but the first."""
    return F.slice(values, 2, F.greatest(F.size(values), F.lit(1)))


def first_n(values: Column, n: int) -> Column:
    return F.slice(values, 1, n)


def n_from(values: Column, start: int, n: int) -> Column:
    return F.slice(values, start + 1, n)


def distinct(values: Column) -> Column:
    """In the order of first occurrence."""
    return F.array_distinct(values)


def flatten(values: Column, depth: int = 1) -> Column:
    for _ in range(depth):
        values = F.flatten(values)
    return values


def contains(values: Column, x: Column) -> Column:
    return F.coalesce(F.exists(values, lambda e: e.eqNullSafe(x)), F.lit(False))


def if_empty(values: Column, other: Column) -> Column:
    return F.when(cardinality(values) == 0, other).otherwise(values)


def null_if_empty(values: Column) -> Column:
    return F.when(cardinality(values) > 0, values)


def get_one(values: Column, nested: bool = False) -> Column:
    """The first element (of the first inner collection that has one, if nested); null of none."""
    return first(F.flatten(values) if nested else values)


def equal_by_place(df: DataFrame, a: str, b: str) -> Column:
    """Two struct columns field by field, in order; the names of fields don't matter, but their number does."""
    x, y = df.schema[a].dataType.names, df.schema[b].dataType.names
    if len(x) != len(y):
        return F.lit(False)
    out = F.lit(True)
    for m, n in zip(x, y, strict=True):
        out = out & F.col(a).getField(m).eqNullSafe(F.col(b).getField(n))
    return out


def interval(low: Column, high: Column) -> Column:
    """Integers from low to high, both included; none if low is above high."""
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def sort(values: Column) -> Column:
    """Ascending, nulls first."""
    return F.sort_array(values)


def reverse_sort(values: Column) -> Column:
    """Descending, nulls last."""
    return F.sort_array(values, asc=False)


def sort_by(values: Column, key: Callable[[Column], Column], descending: bool = False) -> Column:
    """By a key of each element; elements with equal keys keep an order by value. Null keys first (last if descending)."""
    paired = F.transform(values, lambda x: F.struct(key(x).alias("key"), x.alias("value")))
    return F.transform(F.sort_array(paired, asc=not descending), lambda p: p["value"])


def sort_by_place(values: Column, i: int, descending: bool = False) -> Column:
    """A list of lists by their i-th elements."""
    return sort_by(values, lambda x: F.get(x, F.lit(i)), descending)


def each(values: Column, make: Callable[[Column], Column], only: Callable[[Column], Column] | None = None) -> Column:
    """Comprehension: make(x) for the elements that meet only."""
    return F.transform(F.filter(values, only) if only else values, make)


def fold(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """A loop over the elements with an accumulator."""
    return F.aggregate(values, start, step)


def insert(values: Column, x: Column, kind: str = "list") -> Column:
    """add x to a set or bag, append x to a list or array."""
    added = F.array_append(values, x)
    return F.array_distinct(added) if kind == "set" else added


def insert_at(values: Column, i: int, x: Column) -> Column:
    return F.array_insert(values, i + 1, x)


def put_at(values: Column, i: int, x: Column) -> Column:
    return F.transform(values, lambda e, k: F.when(k == i, x).otherwise(e))


def remove(values: Column, x: Column) -> Column:
    """Every occurrence of x goes."""
    return F.filter(values, lambda e: ~e.eqNullSafe(x))


def remove_at(values: Column, i: int) -> Column:
    return F.filter(values, lambda e, k: k != i)


def emptied(values: Column) -> Column:
    return F.slice(values, 1, 0)
