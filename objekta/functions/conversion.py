"""Conversions between types, and questions about types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from objekta.model import Schema

KINDS: dict[str, tuple[type, ...]] = {
    "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType),
    "num": (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType),
    "string": (T.StringType,),
    "bool": (T.BooleanType,),
    "coll": (T.ArrayType,),
    "struct": (T.StructType,),
}


def to_string(x: Column, is_float: bool = False) -> Column:
    """Floats with six decimals."""
    return F.format_string("%.6f", x.cast("double")) if is_float else x.cast("string")


def to_int(x: Column, is_string: bool = False) -> Column:
    """Floats lose their fraction; of a string the leading digits count, and none are 0."""
    if not is_string:
        return x.cast("long")
    return F.when(x.isNotNull(), F.coalesce(F.regexp_extract(x, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0)).cast("long"))


def to_float(x: Column, is_string: bool = False) -> Column:
    if not is_string:
        return x.cast("double")
    number = F.regexp_extract(x, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(x.isNotNull(), F.coalesce(number.try_cast("double"), F.lit(0.0)))


def to_char(x: Column, is_string: bool = False) -> Column:
    """Of a number the character with that code; of a string itself if it is one character."""
    return F.when(F.length(x) == 1, x).otherwise(F.lit("\0")) if is_string else F.chr(x.cast("long"))


def code_of(c: Column) -> Column:
    """A character as a number."""
    return F.ascii(c)


def type_of(x: Column) -> Column:
    return F.typeof(x)


def is_kind(df: DataFrame, column: str, kind: str) -> bool:
    """Known from the schema: int, float, num, string, bool, coll or struct."""
    return isinstance(df.schema[column].dataType, KINDS[kind])


def is_kind_of_attribute(schema: Schema, cls: str, attribute: str, kind: str) -> bool:
    """Known from the object schema: bag, set, list, array, coll or object (a reference)."""
    found = schema.attribute(cls, attribute).kind
    stored = {"inverse": "set", "link": "set", "reference": "object"}.get(found, found)
    return stored in ("bag", "set", "list", "array") if kind == "coll" else stored == kind


def is_empty(x: Column) -> Column:
    return x.isNull()
