"""Order, limits and top-k over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from objekta.operators.sets import marked


def order_by(df: DataFrame, *keys: str | Column, descending: bool = False) -> DataFrame:
    """One direction for all keys given by name, nulls first ascending and last descending; a Column brings its own. The result is a list."""
    order = lambda k: F.col(k).desc_nulls_last() if descending else F.col(k).asc_nulls_first()
    return marked(df.orderBy(*[k if isinstance(k, Column) else order(k) for k in keys]), "list")


def one(df: DataFrame, *keys: str | Column) -> DataFrame:
    """A single element; with keys, the first by them."""
    return top(df, 1, *keys) if keys else df.limit(1)


def top(df: DataFrame, n: int, *keys: str | Column, descending: bool = False, offset: int = 0) -> DataFrame:
    """The first n after offset: partial top-n per partition, so that no full sort is shuffled."""
    rows = order_by(df, *keys, descending=descending)
    return (rows.offset(offset) if offset else rows).limit(n)


def top_per_group(df: DataFrame, n: int, group: list[str], *keys: Column) -> DataFrame:
    """Extension: the first n rows of each group. Spark keeps n rows a group before the shuffle (WindowGroupLimit)."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*keys))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)
