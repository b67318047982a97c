"""Broadcast only behind a measured size.

A side is broadcast when its size in bytes (one aggregate job) is under a
bound; otherwise the plan is left to a shuffle join, which AQE may still
split for skew at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes of values a broadcast side may hold.
BROADCAST_MAX_BYTES = 128 << 20
# The same bound for rows of a few numbers (ids, ranks, scores), whose count is
# known before they are computed.
BROADCAST_MAX_ROWS = 2_000_000


def value_bytes(field: T.StructField) -> Column:
    """Bytes of one value: text by its length, numeric lists by their size."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType):
        return F.coalesce(F.size(c), F.lit(0)) * 8 + 16
    return F.lit(8)


def bounded_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    row = sum((value_bytes(f) for f in df.schema.fields), F.lit(0).cast("bigint"))
    size = df.agg(F.coalesce(F.sum(row), F.lit(0)).alias("bytes")).first().bytes
    return F.broadcast(df) if size <= max_bytes else df
