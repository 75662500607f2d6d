"""Canonical bytes of items: what every hash family hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def item_bytes(df: DataFrame, item: str) -> Column:
    """Strings as UTF-8, binary as it is, integers and booleans as 8 bytes big-endian, others as their text.

    NULL stays NULL: a null item is neither inserted nor present.
    """
    kind, column = df.schema[item].dataType, F.col(item)
    if isinstance(kind, T.BinaryType):
        return column
    if isinstance(kind, T.IntegralType | T.BooleanType):
        return F.unhex(F.lpad(F.hex(column.cast("long")), 16, "0"))
    return F.encode(column.cast("string"), "UTF-8")
