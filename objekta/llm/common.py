"""Helpers that the training-data operators share: tables, the shared folder, unused column names."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: the blank and \t \n \v \f \r, as a class for Java's regular expressions.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own if all runs on this machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_dir()
    return found


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="objekta-")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Lets Spark remove the shuffle files of a query when it ends. What cut() has written is read from the table, so nothing asks for them again.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str, *spent: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, and a lost executor loses nothing.

    spent: results of cut() that nothing but this table was made of; their files go once it is written.
    codec: zstd for size, snappy for a wide table that is read soon and often.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    remove(*spent)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def remove(*spent: DataFrame) -> None:
    """Deletes the files of results of cut() whose successors are written."""
    for df in spent:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, whatever extra columns it brings (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def solid(df: DataFrame, *columns) -> DataFrame:
    """A select whose columns are computed once: neither projections nor filters that follow are merged into it (they would repeat it inside lambdas)."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text):
    """Column: the words [^\\x20\\x09-\\x0D]+ of a text, none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")
