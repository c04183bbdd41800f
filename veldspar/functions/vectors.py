"""Vector arithmetic as Column expressions (double precision, inside the JVM) and as numpy block kernels."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def l2_squared(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance of two arrays of equal length."""
    return total(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(l2_squared(a, b))


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm_squared(a: Column | str) -> Column:
    return total(F.transform(col(a), lambda x: x.cast("double") * x.cast("double")))


def l2_squared_by_norms(a: Column | str, b: Column | str) -> Column:
    """The same distance as norms and inner product, held at zero from below."""
    return F.greatest(F.lit(0.0), norm_squared(a) + norm_squared(b) - F.lit(2.0) * dot(a, b))


def scaled(a: Column | str, factor: float) -> Column:
    return F.transform(col(a), lambda x: x.cast("double") * F.lit(float(factor)))


def transposed(df: DataFrame, vec: str = "vec", id_: str = "id") -> DataFrame:
    """(dim, id, value) rows of the vectors, the layout by dimension."""
    return df.select(F.col(id_).alias("id"), F.posexplode(vec).alias("dim", "value")).select(F.col("dim").cast("long"), "id", F.col("value").cast("double").alias("value"))


def quantisation(df: DataFrame, vec: str = "vec", *, clamp: bool = True) -> DataFrame:
    """(dim, scale, zp): per dimension the affine map of its range to signed bytes.

    A constant dimension has scale 0 and zero point 0.  With clamp the zero point is held to a signed
    byte, which saturates dimensions that do not straddle zero; without it every value keeps its place.
    """
    long = df.select(F.posexplode(vec).alias("dim", "x"))
    per = long.groupBy(F.col("dim").cast("long").alias("dim")).agg(F.min("x").cast("double").alias("lo"), F.max("x").cast("double").alias("hi"))
    scale = (F.col("hi") - F.col("lo")) / F.lit(255.0)
    zero = F.when(scale > 0, F.round(F.lit(-128.0) - F.col("lo") / scale)).otherwise(F.lit(0.0))
    if clamp:
        zero = F.greatest(F.lit(-128.0), F.least(F.lit(127.0), zero))
    return per.select("dim", scale.alias("scale"), zero.cast("long").alias("zp"))


def packed_parameters(parameters: DataFrame) -> DataFrame:
    """One row with the scales and zero points in order of dimension: as many numbers as a vector has."""
    rows = F.sort_array(F.collect_list(F.struct("dim", "scale", "zp")))
    one = parameters.agg(rows.alias("p"))
    return one.select(F.transform("p", lambda x: x["scale"]).alias("scales"), F.transform("p", lambda x: x["zp"]).alias("zps"))


def quantised(df: DataFrame, parameters: DataFrame, vec: str = "vec", *, half_even: bool = False) -> DataFrame:
    """df with codes: signed bytes of vec.  The parameters, one row of a vector's width, are broadcast."""
    rounding = F.bround if half_even else F.round
    both = df.crossJoin(F.broadcast(packed_parameters(parameters)))

    def code(x: Column, i: Column) -> Column:
        s, z = F.get("scales", i), F.get("zps", i)
        y = F.when(s > 0, rounding(x.cast("double") / s)).otherwise(F.lit(0.0)) + z
        return F.greatest(F.lit(-128.0), F.least(F.lit(127.0), y)).cast("byte")

    return both.withColumn("codes", F.transform(vec, code)).drop("scales", "zps")


def dequantised(df: DataFrame, parameters: DataFrame, codes: str = "codes", out: str = "approx") -> DataFrame:
    both = df.crossJoin(F.broadcast(packed_parameters(parameters)))
    value = F.transform(codes, lambda q, i: F.get("scales", i) * (q.cast("double") - F.get("zps", i)))
    return both.withColumn(out, value).drop("scales", "zps")


def from_unsigned_bytes(a: Column | str) -> Column:
    """Unsigned byte vectors as doubles, divided by 100."""
    return F.transform(col(a), lambda x: x.cast("double") / F.lit(100.0))


def half(a: np.ndarray, factor: float = 1.0) -> np.ndarray:
    """Vectors scaled and rounded to half precision."""
    return (a * factor).astype(np.float16)


def upper_bound(bounds: Column | str, x: Column) -> Column:
    """Place of the last bound that is not above x, the first if all are."""
    return F.greatest(F.lit(0), F.size(F.filter(col(bounds), lambda b: b <= x)) - 1).cast("long")


def lower_bound(bounds: Column | str, x: Column) -> Column:
    """Place of the first bound that is not below x, the number of bounds if all are."""
    return F.size(F.filter(col(bounds), lambda b: b < x)).cast("long")


def linear_cell(buckets: list[Column | str], shape: list[int]) -> Column:
    """Cell number of a tuple of buckets, the last dimension running fastest."""
    return reduce(lambda acc, bs: acc * F.lit(bs[1]).cast("long") + col(bs[0]).cast("long"), zip(buckets, shape), F.lit(0).cast("long"))


def scattered(id_: Column, factor: int = 7919, modulus: int = 1000) -> Column:
    """A cheap repeatable scatter of integers."""
    return (id_ * F.lit(factor)) % F.lit(modulus)


def distances(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of all queries (rows) to all points (columns) by norms and one matrix product, then made exact enough to rank by near ties recomputed by the caller."""
    p, q = points.astype(np.float64), queries.astype(np.float64)
    out = (q * q).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2.0 * (q @ p.T)
    return np.maximum(out, 0.0)


def exact_distances(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Squared distances in the order of summation of the Column expression, so that ties fall alike."""
    d = points.astype(np.float64) - query.astype(np.float64)
    return np.cumsum(d * d, axis=1)[:, -1] if d.shape[1] else np.zeros(len(d))


def halved(points: DataFrame) -> DataFrame:
    """(id, half, gap): vectors as two-byte floats in binary, and the distance of each from what it stood for; null vectors have neither.

    Numbers beyond the range of two bytes (65,504) are refused, as no bound of the error would hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves, gaps = [], []
            for vec in batch.column(1).to_pylist():
                if vec is None:
                    halves.append(None)
                    gaps.append(None)
                    continue
                x = np.array(vec, np.float64)
                if np.abs(x).max(initial=0.0) > 65504:
                    raise ValueError("a vector has numbers beyond what two bytes hold")
                half = x.astype("<f2")
                halves.append(half.tobytes())
                gaps.append(float(np.sqrt(((half.astype(np.float64) - x) ** 2).sum())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(halves, pa.binary()), pa.array(gaps, pa.float64())], ["id", "half", "gap"])

    ship(points.sparkSession)
    return points.select("id", "vec").mapInArrow(run, "id long, half binary, gap double")
