"""Changes to objects. Tables are immutable, so each gives the table after the change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def create(table: DataFrame, rows: DataFrame, created: str = "") -> DataFrame:
    """New objects; attributes that they don't set are null. created: the attribute that takes the time of creation (a table has none of its own)."""
    rows = rows.withColumn(created, F.current_timestamp()) if created else rows
    return table.unionByName(rows, allowMissingColumns=True)


def link(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """A stored N-N collection with more links. Both have the columns of owner and element; pairs that are linked stay one link, those with a null are none."""
    own = pairs.select(*links.columns[:2]).dropna()
    return links.unionByName(own, allowMissingColumns=True).dropDuplicates(links.columns[:2])


def unlink(links: DataFrame, pairs: DataFrame) -> DataFrame:
    a, b = links.columns[:2]
    gone = pairs.select(F.col(a).alias("__owner"), F.col(b).alias("__element")).distinct()
    return links.join(gone, (F.col(a) == F.col("__owner")) & (F.col(b) == F.col("__element")), "left_anti")


def delete(table: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Without the objects whose key is in the first column of keys."""
    gone = keys.select(F.col(keys.columns[0]).alias("__gone"))
    return table.join(gone, F.col(key) == F.col("__gone"), "left_anti")


def clear_references(table: DataFrame, reference: str, keys: DataFrame) -> DataFrame:
    """What deleting the objects does to references to them: they become null."""
    gone = keys.select(F.col(keys.columns[0]).alias("__gone")).distinct()
    joined = table.join(gone, F.col(reference) == F.col("__gone"), "left")
    return joined.select(*[F.when(F.col("__gone").isNull(), F.col(c)).alias(c) if c == reference else F.col(c) for c in table.columns])


def update(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Attributes of the objects that where holds for; the others stay as they are."""
    holds = F.coalesce(where, F.lit(False))
    return table.withColumns({n: F.when(holds, v).otherwise(F.col(n)).cast(table.schema[n].dataType) for n, v in values.items()})


def evolve(table: DataFrame, removed: tuple[str, ...] = (), renamed: dict[str, str] | None = None, converted: dict[str, str] | None = None, extended: dict[str, Column] | None = None, migrated: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Schema evolution: attributes removed, renamed (old: new), cast to a type, added, or computed from their old value."""
    out = table.drop(*removed).withColumnsRenamed(renamed or {})
    out = out.withColumns({n: F.col(n).try_cast(t) for n, t in (converted or {}).items()})
    out = out.withColumns({n: make(F.col(n)) for n, make in (migrated or {}).items()})
    return out.withColumns(extended or {})
