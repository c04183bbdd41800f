"""Tables in the folder that driver and executors share, which cut lineage and survive lost executors.

A returned DataFrame reads such tables, so no operator deletes any.  Whoever uses the results may: tables written inside `with owned(spark) as tables` belong to that
scope, and `tables.drop(*kept)` deletes those that none of the kept DataFrames reads.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

DEFAULT_SHARED = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, else the context's checkpoint folder; a machine's own folder only if all runs on that machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or DEFAULT_SHARED).rstrip("/")


class Tables:
    """Paths of the tables and folders made in a scope, and not dropped yet."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def drop(self, *kept: DataFrame) -> int:
        """Delete what no kept DataFrame reads; returns how many tables that were.

        What a DataFrame reads is known by its files.  One that was cached must be kept by its tables too, as it may have to read them again: pass it as it was before.
        """
        names = {m[1] for df in kept for f in df.inputFiles() if (m := re.search(r"/veldspar/([^/]+)/", f))}
        gone = [path for path in self.paths if path.rsplit("/", 1)[1] not in names]
        for path in gone:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        self.paths = [path for path in self.paths if path not in set(gone)]
        return len(gone)


_scopes: ContextVar[tuple[Tables, ...]] = ContextVar("scopes", default=())


@contextmanager
def owned(spark: SparkSession) -> Iterator[Tables]:
    """A scope that owns the tables written inside it by this thread; they stay after it, until they are dropped.  Scopes nest, and an outer one owns them too."""
    tables = Tables(spark)
    token = _scopes.set((*_scopes.get(), tables))
    try:
        yield tables
    finally:
        _scopes.reset(token)


def scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/veldspar/{name}-{uuid.uuid4().hex}"
    for tables in _scopes.get():
        tables.paths.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
