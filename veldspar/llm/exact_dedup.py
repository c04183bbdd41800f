"""Exact deduplication with streaming state kept on disk, in DataFrame expressions only.

1. Every document becomes a sighting: digest (SHA-256), stable identifier, and content locator (a pair file, row).  By default the
   rows are copied to the shared folder with the name of their arrival as file and a number as row, written once, so that whatever docs is, a
   locator means one row; of a plain read of files, whose rows do not move, the caller may name locator columns instead.
2. A Structured Streaming query groups sightings by digest, files_per_trigger files at a time.  Its state lives in RocksDB on the
   executors' disks, never expires, and holds per digest the largest identifier, its locator and a count;
   state is checkpointed to the shared folder, so a lost executor's part is rebuilt.
   With state_path all of it stays there, and further arrivals meet the digests of the earlier ones.
3. Digests seen more than once are hits.  Per hit the least and the greatest of its whole texts are compared, which differ unless all are equal byte
   for byte; should two texts share a digest, that digest's documents are grouped again by full text.

Texts of hits alone leave their task, found by a sieve of the hits' digests of fixed size, and once per digest and task; a digest with
a third of all rows is pre-aggregated there.

Cases: null text counts as empty; among equal texts the largest id stays, a null id only if there is no other;
of rows repeated with one id the later locator stays; an empty table gives an empty result; other columns,
whatever their names, are ignored, but kept by keep_one.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.binary import exists
from .common import materialise, possible, quoted, scratch, shuffle_partitions, text_or_empty, without

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FILES_PER_TRIGGER = 10_000


class _Seen:
    """The sightings of a state folder, those of one arrival, and the state after it."""

    def __init__(self, docs: DataFrame, located: tuple[str, str] | None, state_path: str | None, arrival: str | None, files_per_trigger: int, digest_bytes: int):
        if located and state_path:
            raise ValueError("a kept state needs its own copies of the rows: give located or state_path")
        self.spark, self.home = docs.sparkSession, (state_path or scratch(docs.sparkSession, "dedup")).rstrip("/")
        arrival = arrival or uuid.uuid4().hex
        text = text_or_empty(quoted("text").cast("string"))
        sha = F.sha2(text.cast("binary"), 256)
        hashes = [F.unhex(F.substring(sha, 1, 2 * digest_bytes)).alias("digest"), F.unhex(sha).alias("sha")]
        if located:
            at = [quoted(located[0]).alias("file"), quoted(located[1]).alias("row")]
            rows = docs.select(*at, *hashes, F.struct("doc_id").alias("doc"))
        else:
            rows = docs.select(F.lit(arrival).alias("file"), F.monotonically_increasing_id().alias("row"), *hashes, F.struct(*map(quoted, docs.columns)).alias("doc"))
        path = f"{self.home}/sightings/{arrival}"
        self.new = not exists(self.spark, f"{path}/_SUCCESS")
        if self.new:  # an arrival that is named again was taken in before
            rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.all = self.spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{self.home}/sightings")
        self.own = self.spark.read.schema(rows.schema).parquet(path)
        at = [docs[located[0]].alias("file"), docs[located[1]].alias("row")] if located else []
        #: Every sighting with its text.
        self.texts = docs.select(*at, *hashes, "doc_id", text.alias("text")) if located else self.all.select("file", "row", "digest", "sha", "doc.doc_id", text_or_empty(F.col("doc.text").cast("string")).alias("text"))
        self.several = state_path is not None
        self.state = self._state(files_per_trigger)

    def _state(self, files_per_trigger: int) -> DataFrame:
        """digest, keep (doc_id, file, row), group_size: the stream's state once it has read all sightings, of the arrival's digests at least.

        A batch writes the state of the digests it met.  Those of a new arrival were all met in this run, so only its batches are read, however long the history.
        """
        session = self.spark.newSession()  # own settings for the state store, none left behind
        prefix = "spark.sql.streaming.stateStore."
        for key, value in {
            "spark.sql.shuffle.partitions": str(shuffle_partitions(self.spark)),
            prefix + "providerClass": ROCKSDB,
            prefix + "rocksdb.changelogCheckpointing.enabled": "true",
            prefix + "rocksdb.boundedMemoryUsage": "true",
            prefix + "rocksdb.maxMemoryUsageMB": "256",
            prefix + "rocksdb.writeBufferSizeMB": "8",
            prefix + "rocksdb.allowFAllocate": "false",  # else each partition's store reserves 4 MB of disk
        }.items():
            session.conf.set(key, value)
        narrow = self.all.select("file", "row", "digest", F.struct("doc.doc_id").alias("doc")).schema
        reader = session.readStream.schema(narrow).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger)
        sightings = reader.parquet(f"{self.home}/sightings").select("digest", "doc.doc_id", "file", "row")
        state = sightings.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        out, ran = f"{self.home}/updates", []

        def keep_updates(batch: DataFrame, number: int) -> None:
            ran.append(number)
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch overwrites itself

        query = state.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{self.home}/stream").foreachBatch(keep_updates).start()
        query.awaitTermination()
        if self.new and not ran:  # there were no rows
            return self.spark.createDataFrame([], state.schema)
        batches = [f"{out}/batch={n}" for n in sorted(set(ran))] if self.new else [f"{out}/batch=*"]
        try:
            updates = self.spark.read.schema(state.schema).option("basePath", out).parquet(*batches)
        except AnalysisException:  # no batch ever ran: there were no rows
            return self.spark.createDataFrame([], state.schema)
        latest = F.max(F.struct("group_size", "keep")).alias("s")  # counts only grow, so the largest is the latest
        return updates.groupBy("digest").agg(latest).select("digest", "s.keep", "s.group_size")

    def verdicts(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256, file, row of the arrival's rows."""
        hits = self.state.filter("group_size > 1")
        if self.several:
            hits = hits.join(self.own.select("digest").distinct(), "digest", "left_semi")
        hits = materialise(hits, "dedup-hits")
        # Full bytes of hits.
        ends = possible(self.texts.select("digest", "text"), "digest", hits.select("digest")).groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most"))
        differ = materialise(ends.filter("least <> most").select("digest"), "dedup-differ")

        own = self.own.select("doc.doc_id", "digest", "sha", "file", "row")
        extra = None
        if not differ.isEmpty():
            hits = hits.join(differ, "digest", "left_anti")
            apart = self.texts.join(differ, "digest", "left_semi")
            groups = apart.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
            apart = apart.join(own.select("file", "row"), ["file", "row"], "left_semi")
            extra = apart.join(groups, ["digest", "text"]).select("doc_id", "sha", "file", "row", "keep", "group_size")
            own = own.join(differ, "digest", "left_anti")
        alone = F.struct("doc_id", "file", "row")
        rows = own.join(hits, "digest", "left").select("doc_id", "sha", "file", "row", F.coalesce("keep", alone).alias("keep"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
        if extra is not None:
            rows = rows.unionByName(extra)
        is_keeper: Column = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
        return rows.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", is_keeper.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "file", "row")


def exact_dedup(
    docs: DataFrame, *, located: tuple[str, str] | None = None, state_path: str | None = None, arrival: str | None = None, files_per_trigger: int = FILES_PER_TRIGGER, digest_bytes: int = 32
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, file, row: one row per row of docs.

    located names columns of docs that hold each row's file and place in it, as plain_read adds; without it the rows are copied.
    With state_path, of the shared folder, groups and keepers count all arrivals so far; an arrival given the name of an earlier one is not counted again.
    digest_bytes below 32 shortens the digest, so that tests reach the grouping by full texts.
    """
    columns = ["doc_id", "text", *(located or ())]
    return _Seen(docs.select(*map(quoted, columns)), located, state_path, arrival, files_per_trigger, digest_bytes).verdicts()


def plain_read(docs: DataFrame) -> tuple[DataFrame, tuple[str, str]]:
    """doc_id, text and locator of a table read from Parquet files with nothing done to it, for exact_dedup's located."""
    of_file = docs.metadataColumn("_metadata")  # the reader's own, even where the table has a column of that name
    return docs.select("doc_id", "text", of_file["file_path"].alias("file"), of_file["row_index"].alias("row")), ("file", "row")


def keep_one(docs: DataFrame, *, state_path: str | None = None, arrival: str | None = None, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """The rows of docs that stay, with all their columns; with state_path, those that stay among all arrivals so far."""
    seen = _Seen(docs, None, state_path, arrival, files_per_trigger, 32)
    gone = materialise(seen.verdicts().filter("NOT kept").select("row"), "dedup-gone")
    return without(seen.own.select("row", "doc"), "row", gone).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM {docs} WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
