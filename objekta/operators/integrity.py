"""Constraints as checks: each gives the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objekta.sources.catalog import Catalog


def not_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that several rows have, with their count. Nulls don't count as equal."""
    some = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(some).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing(df: DataFrame, *columns: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def out_of_cardinality(catalog: Catalog, cls: str, attribute: str, least: int | None = None, most: int | None = None) -> DataFrame:
    """Objects whose inverse collection has fewer or more elements than allowed: key, n. Bounds default to the schema's."""
    a = catalog.schema.attribute(cls, attribute)
    least, most = a.least if least is None else least, a.most if most is None else most
    key = catalog.key(cls)
    counts = catalog.extent(a.target).groupBy(a.via).agg(F.count(F.lit(1)).alias("n"))
    rows = catalog.extent(cls).select(key).join(counts, F.col(key) == F.col(a.via), "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))
    broken = F.lit(False)
    if least is not None:
        broken = broken | (F.col("n") < least)
    if most is not None:
        broken = broken | (F.col("n") > most)
    return rows.where(broken)


def dangling(catalog: Catalog, cls: str, attribute: str) -> DataFrame:
    """Objects whose reference names no object."""
    a = catalog.schema.attribute(cls, attribute)
    target = catalog.extent(a.target).select(F.col(catalog.key(a.target)).alias("__key"))
    return catalog.extent(cls).where(F.col(attribute).isNotNull()).join(target, F.col(attribute) == F.col("__key"), "left_anti")


def inverse_differs(one_side: DataFrame, other_side: DataFrame) -> DataFrame:
    """Pairs (owner, element) that only one of two stored sides of a relationship has."""
    a, b = one_side.toDF("owner", "element"), other_side.toDF("owner", "element")
    return a.exceptAll(b).withColumn("side", F.lit("one")).unionByName(b.exceptAll(a).withColumn("side", F.lit("other")))


def check(catalog: Catalog, cls: str) -> dict[str, DataFrame]:
    """All checks that the schema declares for a class, by name."""
    df, out = catalog.extent(cls), {}
    for a in catalog.schema.attributes(cls).values():
        if a.unique:
            out[f"unique {a.name}"] = not_unique(df, a.name)
        if a.not_null:
            out[f"not null {a.name}"] = missing(df, a.name)
        if a.kind == "inverse" and (a.least is not None or a.most is not None):
            out[f"cardinality {a.name}"] = out_of_cardinality(catalog, cls, a.name)
        if a.kind == "reference":
            out[f"dangling {a.name}"] = dangling(catalog, cls, a.name)
    return out


def key_histogram(df: DataFrame, column: str) -> DataFrame:
    """How many keys have how many entries: the statistics of an index on the column."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("entries")).groupBy("entries").agg(F.count(F.lit(1)).alias("n_keys"))
