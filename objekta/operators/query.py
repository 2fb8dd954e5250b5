"""Queries over object paths.

    From(catalog, c="Customer").unnest("o", "c.orders").where(lambda p: p("c.nation.name") == "NATION_3").select(name="c.name")

A variable's attributes are columns that are named by their path. Following a reference is a left join, made once for each
prefix however often the query uses it; following an inverse collection in unnest() is an inner join on the foreign
key, and unnesting an array attribute an explode. A where() on a path through a null reference is false, and select()
leaves out rows whose projected path goes through one. Catalyst prunes what no path uses and picks the join strategies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objekta.model import Attribute
from objekta.operators.sets import marked
from objekta.sources.catalog import Catalog

Path = Callable[[str], Column]


def column(path: str) -> Column:
    return F.col(f"`{path}`")


class From:
    """Immutable: each method gives a new query."""

    def __init__(self, catalog: Catalog, _shallow: tuple[str, ...] = (), **variables: str):
        """from v1 in Class1, v2 in Class2: a cartesian product that where() turns into joins. _shallow: variables without subclasses."""
        self.catalog, self.classes, self.joined = catalog, {}, frozenset()
        self.df: DataFrame | None = None
        for name, cls in variables.items():
            rows = self._renamed(cls, name, deep=name not in _shallow)
            self.classes[name] = cls
            self.df = rows if self.df is None else self.df.crossJoin(rows)

    def _renamed(self, cls: str, prefix: str, deep: bool = True) -> DataFrame:
        rows = self.catalog.extent(cls, deep)
        return rows.select(*[F.col(c).alias(f"{prefix}.{c}") for c in rows.columns])

    def _with(self, df: DataFrame, joined=None, **classes: str) -> From:
        out = object.__new__(From)
        out.catalog, out.df, out.classes, out.joined = self.catalog, df, self.classes | classes, self.joined if joined is None else joined
        return out

    def _walk(self, path: str) -> tuple[list[tuple[str, str]], str]:
        """(prefix, class) of each reference to follow, and the column; a field of a struct keeps its dot."""
        parts = path.split(".")
        if parts[0] not in self.classes:
            raise KeyError(f"no variable {parts[0]} in {path}")
        cls, prefix, steps = self.classes[parts[0]], parts[0], []
        for i, name in enumerate(parts[1:], start=1):
            if not cls:
                return steps, prefix
            a = self.catalog.schema.attribute(cls, name)
            prefix = f"{prefix}.{name}"
            last = i == len(parts) - 1
            if a.kind == "reference" and not last:
                cls = a.target
                steps.append((prefix, cls))
            elif a.kind in ("inverse", "link"):
                raise ValueError(f"{path} goes through a collection: unnest it, or use any_of() or collect()")
            elif not last:
                return steps, prefix
        return steps, prefix

    def _resolve(self, paths: list[str]) -> tuple[From, dict[str, Column], dict[str, list[str]]]:
        """The query with all joins that the paths need; a column and the followed references for each path."""
        df, joined, columns, followed = self.df, self.joined, {}, {}
        for path in paths:
            steps, base = self._walk(path)
            for prefix, cls in steps:
                if prefix not in joined:
                    target = self._renamed(cls, prefix)
                    df = df.join(target, column(prefix) == column(f"{prefix}.{self.catalog.key(cls)}"), "left")
                    joined = joined | {prefix}
            c = column(base)
            for name in path[len(base) :].split(".")[1:]:
                c = c.getField(name)
            columns[path] = c
            followed[path] = [f"{prefix}.{self.catalog.key(cls)}" for prefix, cls in steps]
        return self._with(df, joined), columns, followed

    def _use(self, make: Callable[[Path], Column]) -> tuple[From, Column]:
        """Runs make twice: once to see its paths, once with their columns."""
        seen: list[str] = []

        def note(path: str) -> Column:
            seen.append(path)
            return F.lit(None)

        make(note)
        query, columns, _ = self._resolve(seen)
        return query, make(columns.__getitem__)

    def where(self, condition: Callable[[Path], Column]) -> From:
        query, c = self._use(condition)
        return query._with(query.df.where(c))  # a filter drops nulls; a coalesce around it would hide join keys and pushed filters from Catalyst

    def join(self, name: str, cls: str, condition: Callable[[Path], Column]) -> From:
        """Another variable, with the condition that ties it to those before (equi- or theta-join)."""
        product = self._with(self.df.crossJoin(self._renamed(cls, name)), **{name: cls})
        return product.where(condition)

    def unnest(self, name: str, path: str, index: str | None = None) -> From:
        """A dependent variable: an element of the collection for each row. index: variable for an array's places."""
        owner, _, attribute = path.rpartition(".")
        cls = self._class_at(owner)
        a = self.catalog.schema.attribute(cls, attribute)
        if a.kind in ("inverse", "link"):
            query, c, _ = self._resolve([f"{owner}.{self.catalog.key(cls)}"])
            inner, back = self._elements(a, name)
            return query._with(query.df.join(inner.df, column(back) == next(iter(c.values()))), **{name: a.target})
        query, c, _ = self._resolve([path])
        kept = [column(x) for x in query.df.columns]
        if index:
            return query._with(query.df.select(*kept, F.posexplode(c[path]).alias(index, name)), **{name: "", index: ""})
        return query._with(query.df.select(*kept, F.explode(c[path]).alias(name)), **{name: ""})

    def _elements(self, a: Attribute, name: str) -> tuple[From, str]:
        """Elements of all owners as the variable name, and the column with the owner's key."""
        inner = From(self.catalog, **{name: a.target})
        if a.kind == "inverse":
            return inner, f"{name}.{a.via}"
        back = f"{name}.__owner"
        links = self.catalog.extent(a.through).where(F.col(a.via).isNotNull() & F.col(a.to).isNotNull())
        links = links.select(F.col(a.via).alias(back), F.col(a.to).alias("__element")).distinct()
        return inner._with(inner.df.join(links, column(f"{name}.{self.catalog.key(a.target)}") == F.col("__element")).drop("__element")), back

    def _class_at(self, path: str) -> str:
        parts = path.split(".")
        cls = self.classes[parts[0]]
        for name in parts[1:]:
            cls = self.catalog.schema.attribute(cls, name).target
        return cls

    def any_of(self, path: str, condition: Callable[[Path], Column] | None = None, negate: bool = False) -> From:
        """Rows with an element of the inverse collection that meets the condition over e (negate: with none). Never multiplies rows."""
        owner, _, attribute = path.rpartition(".")
        cls = self._class_at(owner)
        a = self.catalog.schema.attribute(cls, attribute)
        inner, back = self._elements(a, "e")
        inner = inner.where(condition) if condition else inner
        query, c, _ = self._resolve([f"{owner}.{self.catalog.key(cls)}"])
        keys = inner.df.select(column(back).alias("__owner"))
        return query._with(query.df.join(keys, F.col("__owner") == next(iter(c.values())), "left_anti" if negate else "left_semi"))

    def all_of(self, path: str, condition: Callable[[Path], Column]) -> From:
        """Rows of whose collection every element meets the condition (an empty collection does)."""
        return self.any_of(path, lambda p: ~F.coalesce(condition(p), F.lit(False)), negate=True)

    def collect(self, path: str, **aggregates: tuple[Callable[[Path], Column], Callable[[Column], Column]]) -> From:
        """Aggregates over an inverse collection, as columns of their names; each is (value over e, aggregate function).

        Elements are aggregated by the foreign key before the join, so a row meets one row. Owners without elements get null.
        """
        if clash := set(aggregates) & set(self.classes):
            raise ValueError(f"{sorted(clash)}: names of variables")
        owner, _, attribute = path.rpartition(".")
        cls = self._class_at(owner)
        a = self.catalog.schema.attribute(cls, attribute)
        inner, back = self._elements(a, "e")
        values = {}
        for name, (make, _) in aggregates.items():
            inner, values[name] = inner._use(make)
        rows = inner.df.groupBy(column(back).alias(f"{path}.__owner")).agg(*[fn(values[n]).alias(n) for n, (_, fn) in aggregates.items()])
        query, c, _ = self._resolve([f"{owner}.{self.catalog.key(cls)}"])
        return query._with(query.df.join(rows, column(f"{path}.__owner") == next(iter(c.values())), "left"), **{n: "" for n in aggregates})

    def count_of(self, path: str, name: str) -> From:
        """The collection's cardinality, 0 where it is empty."""
        query = self.collect(path, **{name: (lambda p: F.lit(1), F.count)})
        return query._with(query.df.withColumn(name, F.coalesce(column(name), F.lit(0))))

    def within(self, path: str, keys: DataFrame, negate: bool = False) -> From:
        """path in (select ...): a semi join with a one-column DataFrame (negate: an anti join). Null is in nothing."""
        query, c, _ = self._resolve([path])
        other = keys.select(F.col(keys.columns[0]).alias("__key"))
        return query._with(query.df.join(other, F.col("__key") == c[path], "left_anti" if negate else "left_semi"))

    def everything(self, variable: str) -> DataFrame:
        """select *: the stored attributes of one variable."""
        return self.df.select(*[column(c).alias(c[len(variable) + 1 :]) for c in self.df.columns if c.startswith(variable + ".") and "." not in c[len(variable) + 1 :] and "__" not in c])

    def select(self, *paths: str, distinct: bool = False, keep_null_paths: bool = False, **named: str | Callable[[Path], Column]) -> DataFrame:
        """Columns by name, each a path or a function of paths; positional paths are named by their last part."""
        wanted = {p.rpartition(".")[2]: p for p in paths} | named
        query, columns, followed = self._resolve([p for p in wanted.values() if isinstance(p, str)])
        for name, make in wanted.items():
            if not isinstance(make, str):
                query, columns[name] = query._use(make)
        df = query.df
        if not keep_null_paths:
            for key in dict.fromkeys(k for p in wanted.values() if isinstance(p, str) for k in followed[p]):
                df = df.where(column(key).isNotNull())
        out = df.select(*[columns[p if isinstance(p, str) else name].alias(name) for name, p in wanted.items()])
        return marked(out.distinct(), "set") if distinct else marked(out, "bag")

    def group_by(self, *paths: str, having: Callable[[Path], Column] | None = None, **aggregates: tuple[Callable[[Path], Column], Callable[[Column], Column]]) -> DataFrame:
        """A row for each value of the paths (keys are named by their last parts) with aggregates, each (value over paths, aggregate function).

        The group itself as a collection is (lambda p: F.struct(...), F.collect_list), which holds all its rows at once; having is over the result's names.
        Rows whose key goes through a null reference are left out, as in select().
        """
        keys = {p.rpartition(".")[2]: p for p in paths}
        query, columns, followed = self._resolve([*paths])
        values = {}
        for name, (make, _) in aggregates.items():
            query, values[name] = query._use(make)
        df = query.df
        for key in dict.fromkeys(k for p in paths for k in followed[p]):
            df = df.where(column(key).isNotNull())
        out = df.groupBy(*[columns[p].alias(name) for name, p in keys.items()]).agg(*[fn(values[n]).alias(n) for n, (_, fn) in aggregates.items()])
        return marked(out.where(having(column)) if having else out, "set")

    def contents(self, path: str) -> DataFrame:
        """The elements of a stored collection, of all rows, with their own attributes: a bag of objects."""
        query = self.unnest("contents", path)
        return marked(query.everything("contents") if query.classes["contents"] else query.df.select(column("contents")), "bag")


def matching(catalog: Catalog, cls: str, condition: Callable[[Path], Column]) -> DataFrame:
    """Keys of the objects that meet a condition: a comparison without a from clause selects objects, not truth values."""
    return From(catalog, x=cls).where(condition).select(f"x.{catalog.key(cls)}")
