"""Object schemas, declared in Python: classes with attributes, references, inverse collections and inheritance.

A class has a table, and its objects are rows: a reference is a foreign-key column, an embedded literal a struct, a
collection attribute an array column, and an inverse collection exists only as the join that computes it. Subclasses live
in the table of their root class (one row holds the attributes of all of them) and are told apart by a predicate.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Literal

from pyspark.sql import DataFrame, SparkSession

CollectionKind = Literal["set", "bag", "list", "array"]
Kind = Literal["scalar", "literal", "reference", "inverse", "link", "set", "bag", "list", "array"]


@dataclass(frozen=True)
class Attribute:
    """column: where the table has it (the name itself if empty). target: class of a reference or inverse collection.
    via: the reference attribute of the target that an inverse collection goes back by. through, via, to: the class whose
    objects link owners (its attribute via) and elements (to) of an N-N relationship. least and most: cardinality."""

    name: str
    kind: Kind = "scalar"
    column: str = ""
    target: str = ""
    via: str = ""
    through: str = ""
    to: str = ""
    unique: bool = False
    not_null: bool = False
    least: int | None = None
    most: int | None = None

    @property
    def stored(self) -> str:
        return self.column or self.name


def scalar(name: str, column: str = "", **more) -> Attribute:
    return Attribute(name, "scalar", column, **more)


def reference(name: str, target: str, column: str = "", **more) -> Attribute:
    return Attribute(name, "reference", column, target, **more)


def inverse(name: str, target: str, via: str, **more) -> Attribute:
    return Attribute(name, "inverse", "", target, via, **more)


def link(name: str, target: str, through: str, via: str, to: str, **more) -> Attribute:
    return Attribute(name, "link", "", target, via, through, to, **more)


def collection(kind: CollectionKind, name: str, column: str = "", **more) -> Attribute:
    return Attribute(name, kind, column, **more)


def literal(name: str, column: str = "", **more) -> Attribute:
    return Attribute(name, "literal", column, **more)


@dataclass(frozen=True)
class ClassDef:
    """table and key are those of the root class in a subclass. where: SQL predicate over the table that tells a subclass's objects."""

    name: str
    attributes: tuple[Attribute, ...] = ()
    table: str = ""
    key: str = ""
    extends: str = ""
    where: str = ""


@dataclass(frozen=True)
class Schema:
    classes: dict[str, ClassDef] = field(default_factory=dict)
    enums: dict[str, dict[str, int]] = field(default_factory=dict)

    @classmethod
    def of(cls, *classes: ClassDef, enums: dict[str, dict[str, int]] | None = None) -> Schema:
        schema = cls({c.name: c for c in classes}, enums or {})
        for c in classes:
            if c.extends and c.extends not in schema.classes:
                raise ValueError(f"{c.name} extends {c.extends}, which is not declared")
            for a in c.attributes:
                for other in (a.target, a.through):
                    if other and other not in schema.classes:
                        raise ValueError(f"{c.name}.{a.name} refers to {other}, which is not declared")
        return schema

    def __getitem__(self, name: str) -> ClassDef:
        if name not in self.classes:
            raise KeyError(f"no class {name}")
        return self.classes[name]

    def ancestors(self, name: str) -> list[ClassDef]:
        """The class, its parent and so on up to the root."""
        out = [self[name]]
        while out[-1].extends:
            out.append(self[out[-1].extends])
        return out

    def root(self, name: str) -> ClassDef:
        return self.ancestors(name)[-1]

    def subclasses(self, name: str) -> list[str]:
        """The class and everything below it."""
        return [c for c in self.classes if any(a.name == name for a in self.ancestors(c))]

    def attributes(self, name: str, below: bool = True) -> dict[str, Attribute]:
        """Own and inherited attributes; with below also those that only subclasses have, null for other objects."""
        out: dict[str, Attribute] = {}
        for c in reversed(self.ancestors(name)):
            out |= {a.name: a for a in c.attributes}
        if below:
            for sub in self.subclasses(name):
                for a in self[sub].attributes:
                    out.setdefault(a.name, a)
        return out

    def attribute(self, cls: str, name: str) -> Attribute:
        found = self.attributes(cls).get(name)
        if found is None:
            raise KeyError(f"{cls} has no attribute {name}")
        return found

    def with_class(self, c: ClassDef) -> Schema:
        return replace(self, classes=self.classes | {c.name: c})

    def enum_value(self, member: str) -> int:
        for members in self.enums.values():
            if member in members:
                return members[member]
        raise KeyError(f"no enum has {member}")

    def frame(self, spark: SparkSession) -> DataFrame:
        """The schema as data: a row for each attribute that a class declares."""
        rows = [(c.name, c.extends or None, self.root(c.name).table, a.name, a.kind, a.target or None) for c in self.classes.values() for a in c.attributes]
        return spark.createDataFrame(rows, "class string, extends string, stored_in string, attribute string, kind string, target string")

    def class_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c.name, c.extends or None, len(self.attributes(c.name, below=False)), len(self.subclasses(c.name)) - 1) for c in self.classes.values()]
        return spark.createDataFrame(rows, "name string, parent string, n_attributes int, n_subclasses int")
