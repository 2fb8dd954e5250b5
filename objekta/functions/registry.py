"""Functions of the user: macros over Columns, methods of classes, and aggregates."""

from __future__ import annotations

from collections.abc import Callable
from inspect import signature

from pyspark.sql import Column
from pyspark.sql import functions as F

from objekta.model import Schema


class Functions:
    """Named Column builders. A call puts the builder's expression in place, so that Catalyst sees through it."""

    def __init__(self):
        self.known: dict[str, Callable[..., Column]] = {}

    def define(self, make: Callable[..., Column], name: str = "") -> Callable[..., Column]:
        self.known[name or make.__name__] = make
        return make

    def __call__(self, name: str, *args, **named) -> Column:
        """Missing arguments take the builder's defaults; plain values become literals."""
        if name not in self.known:
            raise KeyError(f"no function {name}")
        bound = signature(self.known[name]).bind(*args, **named)
        bound.apply_defaults()
        return self.known[name](*[a if isinstance(a, Column) or callable(a) else F.lit(a) for a in bound.args], **bound.kwargs)


class Methods:
    """Methods by class and name; a subclass's own goes before an inherited one."""

    def __init__(self, schema: Schema):
        self.schema, self.known = schema, {}

    def define(self, cls: str, name: str, make: Callable[..., Column]) -> None:
        self.known[cls, name] = make

    def resolve(self, cls: str, name: str) -> Callable[..., Column]:
        for c in self.schema.ancestors(cls):
            if (c.name, name) in self.known:
                return self.known[c.name, name]
        raise KeyError(f"{cls} has no method {name}")

    def dispatch(self, cls: str, class_column: Column, name: str, *args: Column) -> Column:
        """The method of each object's own class, in one expression."""
        out = self.resolve(cls, name)(*args)
        for sub in self.schema.subclasses(cls):
            if (sub, name) in self.known and sub != cls:
                below = self.schema.subclasses(sub)
                out = F.when(class_column.isin(below), self.known[sub, name](*args)).otherwise(out)
        return out


class Aggregate:
    """An aggregate of the user's own: parts are aggregates that Spark merges (sums, counts, extremes of what the user computes), finish combines them.

    So a group is summed before the shuffle and never stands in one place as rows.
    """

    def __init__(self, finish: Callable[..., Column], **parts: Callable[..., Column]):
        self.finish, self.parts = finish, parts

    def __call__(self, *values: Column) -> Column:
        return self.finish(**{name: part(*values) for name, part in self.parts.items()})
