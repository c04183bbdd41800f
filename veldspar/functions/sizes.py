"""Broadcasts behind a check of size."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType

#: Rows and bytes that a broadcast side may have.
MOST, MOST_BYTES = 1 << 16, 64 << 20


def _bytes_of(name: str, kind: DataType) -> Column:
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        return F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0)) * 8 + 16
    return F.lit(8)


def fits(df: DataFrame, most: int = MOST, most_bytes: int = MOST_BYTES) -> bool:
    """Whether df has at most so many rows and bytes; no more of it than that many rows is looked at."""
    size = reduce(Column.__add__, [_bytes_of(f.name, f.dataType) for f in df.schema], F.lit(0)).cast("long")
    seen = df.limit(most + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return seen["n"] <= most and seen["b"] <= most_bytes


def in_blocks(df: DataFrame, key: str, block: int = MOST // 4) -> Iterator[DataFrame]:
    """df in parts of about `block` rows by hash of the key, each small enough to broadcast; df itself if it fits."""
    if fits(df):
        yield df
        return
    n = -(-df.count() // block)
    for b in range(n):
        yield df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == b)


def broadcast_within(df: DataFrame, most: int = MOST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """df marked for broadcast if it fits; else as it is, and Spark picks the join by its own statistics."""
    return F.broadcast(df) if fits(df, most, most_bytes) else df
