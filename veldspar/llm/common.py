"""Table access, split hashes, and the storage that the corpus operators share with the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import materialise, scratch, shared_dir

__all__ = ["filtered", "free_name", "materialise", "possible", "quoted", "ready", "scratch", "shared_dir", "shuffle_partitions", "split_of", "table", "text_or_empty", "with_few", "without"]

#: Bits of a sieve at most: 8 MB, whatever the tables' size, and keys beyond which a sieve would let most rows through.
SIEVE_BITS = 26
SIEVE_KEYS = 1 << 25


def ready(spark: SparkSession) -> SparkSession:
    """The session, once its Python workers can import this package."""
    ship(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_of(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod.  A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def free_name(columns: list[str], name: str) -> str:
    while name in columns:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def filtered(docs: DataFrame, keep: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The rows that keep lets through; it is given columns by place, as names with dots cannot be passed to it."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)


def _sifted(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, str] | None:
    """rows with a flag that is false only if the row's key is not among keys; None if there are too many keys for that to help.

    The keys' hashes are marked in a bitmap of at most 2**SIEVE_BITS bits, the proven bound of what is broadcast.
    """
    n = keys.count()
    if n > SIEVE_KEYS:
        return None
    bits = min(SIEVE_BITS, max(15, (16 * n).bit_length()))
    place, bucket, marks, flag = (free_name(rows.columns, x) for x in ("_place", "_bucket", "_marks", "_flag"))
    hashed = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    own = keys.select(hashed.alias(place))
    bitmap = own.groupBy(F.bitmap_bucket_number(place).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias(marks))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(marks, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    placed = rows.withColumn(place, hashed).withColumn(bucket, F.bitmap_bucket_number(place))
    return placed.join(F.broadcast(bitmap), bucket, "left").withColumn(flag, marked).drop(place, bucket, marks), flag


def possible(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key (a column of both) is among keys, and a few others, without a shuffle of the rows; all rows if keys are very many."""
    sifted = _sifted(rows, key, keys)
    return rows if sifted is None else sifted[0].filter(F.col(sifted[1])).drop(sifted[1])


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose key is not in gone (key); only rows that a sieve does not clear are shuffled.  rows is read twice, so it must be repeatable."""
    sifted = _sifted(rows, key, gone)
    if sifted is None:
        return rows.join(gone.hint("shuffle_hash"), key, "left_anti")
    flagged, flag = sifted
    clear = flagged.filter(~F.col(flag)).drop(flag)
    return clear.unionByName(flagged.filter(F.col(flag)).drop(flag).join(gone.hint("shuffle_hash"), key, "left_anti").select(*map(quoted, clear.columns)))


def with_few(rows: DataFrame, key: str, few: DataFrame) -> DataFrame:
    """rows left-joined with few on the key; rows that a sieve clears are not shuffled."""
    sifted = _sifted(rows, key, few.select(key))
    if sifted is None:
        return rows.join(few, key, "left")
    flagged, flag = sifted
    more = [c for c in few.columns if c != key]
    clear = flagged.filter(~F.col(flag)).drop(flag).select("*", *[F.lit(None).cast(few.schema[c].dataType).alias(c) for c in more])
    return clear.unionByName(flagged.filter(F.col(flag)).drop(flag).join(few.hint("shuffle_hash"), key, "left"))
