"""Databases of objects: a schema over tables, class extents as DataFrames, export and import."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cache, reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from objekta.model import Schema


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_folder()
    return f"{found}/{name}-{uuid.uuid4().hex}"


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="objekta-")


Reader = Callable[[str], DataFrame]


class Catalog:
    """read gives the DataFrame of a table by its name; nothing is read before an action asks for it."""

    def __init__(self, spark: SparkSession, schema: Schema, read: Reader):
        self.spark, self.schema, self.read = spark, schema, read

    @classmethod
    def parquet(cls, spark: SparkSession, schema: Schema, folder: str) -> Catalog:
        return cls(spark, schema, lambda t: spark.read.parquet(f"{folder}/{t}.parquet"))

    @classmethod
    def frames(cls, spark: SparkSession, schema: Schema, frames: dict[str, DataFrame]) -> Catalog:
        return cls(spark, schema, frames.__getitem__)

    def replacing(self, table: str, frame: DataFrame) -> Catalog:
        """The same database after a table has changed."""
        return Catalog(self.spark, self.schema, lambda t: frame if t == table else self.read(t))

    def extent(self, name: str, deep: bool = True) -> DataFrame:
        """Objects of a class, those of its subclasses included unless deep is False, with a column for each stored attribute."""
        schema, root = self.schema, self.schema.root(name)
        rows = self.read(root.table)
        for c in schema.ancestors(name):
            if c.where:
                rows = rows.where(c.where)
        if not deep:
            for sub in schema.subclasses(name):
                if sub != name and schema[sub].where:
                    rows = rows.where(~F.coalesce(F.expr(schema[sub].where), F.lit(False)))
        stored = {a.name: a for a in schema.attributes(name).values() if a.kind not in ("inverse", "link")}
        return rows.select(*[F.col(a.stored).alias(n) for n, a in stored.items()])

    def key(self, name: str) -> str:
        return self.schema.root(name).key

    def class_of(self, name: str):
        """Column over the extent's table: the most special class of each object."""
        out = F.lit(name)
        for sub in self.schema.subclasses(name):
            if sub != name:
                out = F.when(F.coalesce(F.expr(self.schema[sub].where), F.lit(False)), F.lit(sub)).otherwise(out)
        return out

    def objects(self, name: str, keys: Iterable) -> DataFrame:
        """The objects with these keys."""
        return self.extent(name).where(F.col(self.key(name)).isin(list(keys)))

    def iterate(self, name: str) -> Iterator[Row]:
        """A cursor: a partition at a time comes to the driver."""
        return self.extent(name).toLocalIterator(prefetchPartitions=True)

    def modified(self, name: str) -> DataFrame:
        """Keys with the time at which the file that holds the object was written."""
        root = self.schema.root(name)
        key = self.schema.attribute(root.name, root.key).stored
        return self.read(root.table).select(F.col(key).alias(root.key), F.col("_metadata.file_modification_time").alias("modified"))

    def export(self, folder: str, tables: Iterable[str]) -> None:
        for t in tables:
            self.read(t).write.parquet(f"{folder}/{t}.parquet")


def across(catalogs: dict[str, Catalog], name: str) -> DataFrame:
    """A class's objects in several databases, with the database's name."""
    parts = [c.extent(name).withColumn("database", F.lit(k)) for k, c in catalogs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
