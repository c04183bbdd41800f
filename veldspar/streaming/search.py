"""Stateless search of arriving queries: every micro-batch of queries is one bounded query set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..storage import scratch


def search_stream(queries: DataFrame, search: Callable[[DataFrame], DataFrame], path: str, *, checkpoint: str | None = None) -> StreamingQuery:
    """Start searching a stream of (qid, qvec, bounds); each batch's results go to path/batch=n.

    A batch that is run again after a failure overwrites its own folder, so results are exactly once.
    """

    def answer(batch: DataFrame, number: int) -> None:
        search(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    where = checkpoint or scratch(queries.sparkSession, "search-stream")
    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", where).trigger(availableNow=True).start()
