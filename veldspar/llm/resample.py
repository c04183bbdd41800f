"""Importance resampling towards a target distribution, over hashed word n-grams.

Words are runs of letters and digits, lower-cased A-Z.  A document's features are its runs of 1 to N words, repeats counted; a feature's
bucket is the CRC-32 of its words joined by one space, modulo BUCKETS.  The CRC of each word is computed once, and those of longer runs are put
together from them by length shifts over GF(2) (see crc), so no run of words is ever written down.

1. All raw and all target documents are counted by bucket, per task and then summed: BUCKETS rows at most, whatever the tables' size.
2. A bucket's gain is 1000 times the log ratio of its add-one shares in target and raw documents, rounded down; a document's weight is the mean of
   its features' gains, rounded down.
3. Gumbel noise from the hash of the id is added, and of the documents of MIN_WORDS words at least the given share of highest scores is drawn:
   a weighted sample without replacement.  Ranks come from ranges of the scores, not from one task.

Cases: null and wordless texts have no features and weight 0, and are not drawn; a null id hashes as the empty text and stands before the others
of its score; rows repeated with one id and score are ranked each, in either order; an empty table gives an empty result; without target documents all target counts are 0;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import with_rank
from . import crc, kernel
from .common import materialise, ready

BUCKETS = 10000
N = 2
MIN_WORDS = 20
#: Hundredths of the documents long enough that are drawn.
PERCENT = 25
SEED = "7"


def features(column: pa.Array, n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: bucket of every feature, the document of each, and the number of words of each document."""
    space = np.uint32(crc.zlib.crc32(b" "))
    for _, _, buf, off in kernel.slices(column):
        low = kernel.LOWER[buf]
        start, end, woff = kernel.find_words(low, off, kernel.NOT_ALNUM)
        one, size = crc.words(low, start, end), end - start
        doc = np.repeat(np.arange(len(off) - 1), np.diff(woff))
        led = crc.join(np.full(len(one), space), one, size)  # the word after a space
        out, docs = [one], [doc]
        run = one
        for k in range(2, n + 1):
            at, goff = kernel.gram_starts(woff, k)
            joined = np.zeros(len(one), np.uint32)
            joined[at] = crc.join(run[at], led[at + k - 1], size[at + k - 1] + 1)
            run = joined
            out.append(joined[at])
            docs.append(np.repeat(np.arange(len(off) - 1), np.diff(goff)))
        yield (np.concatenate(out) % np.uint32(buckets)).astype(np.int64), np.concatenate(docs), np.diff(woff)


def bucket_counts(docs: DataFrame, n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all documents are in each bucket; one row per bucket and task is shuffled, one per bucket collected."""
    ready(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for bucket, _, _ in features(batch.column(0), n, buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    found = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket 1000 times the log of how much commoner it is in the target, rounded down."""
    b, s, t = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + b) / ((x + 1.0) * (t + b)))) for x, y in zip(raw.tolist(), target.tolist())], np.int64)


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """1000 times a Gumbel variable fixed by the id, rounded down."""
    word = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((F.conv(word, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, *, n: int = N, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row per row of docs; rank is null for rows not drawn.  target has a column text."""
    spark = ready(docs.sparkSession)
    gain = spark.sparkContext.broadcast(gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets)))  # one number a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [[np.zeros(0, np.int64)] for _ in range(3)]
            for bucket, doc, n_words in features(batch.column(1), n, buckets):
                count = np.bincount(doc, minlength=len(n_words))
                order = np.argsort(doc, kind="stable")
                cut = np.concatenate([[0], np.cumsum(count)])
                total = np.concatenate([[0], np.cumsum(gain.value[bucket[order]])])[cut]
                for held, x in zip(parts, (n_words, count, np.diff(total) // np.maximum(count, 1))):
                    held.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.concatenate(x)) for x in parts]], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weighed = rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resample-scores")
    long_enough = scored.filter(F.col("n_words") >= min_words)
    drawn = percent * long_enough.count() // 100
    ranked = with_rank(long_enough, [F.desc("score"), F.col("doc_id").asc_nulls_first()])
    rank = F.when(F.col("rank") < drawn, F.col("rank") + 1).alias("rank")
    names = ["doc_id", "n_features", "weight", "score"]
    rest = scored.filter(F.col("n_words") < min_words).select(*names, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*names, rank).unionByName(rest)


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of docs with all their columns, for documents of distinct ids."""
    from .common import free_name, possible, quoted

    key = free_name(docs.columns, "_doc")
    kept = materialise(resample(docs, target, **options).filter("rank IS NOT NULL").select(F.col("doc_id").alias(key)).distinct(), "resample-drawn")
    rows = docs.withColumn(key, quoted("doc_id").cast("long"))
    return possible(rows, key, kept).join(kept.hint("shuffle_hash"), key, "left_semi").select(*map(quoted, docs.columns))


#: The CRC is taken bit by bit over distinct features.
ORACLE_SQL = r"""
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS big, 'abcdefghijklmnopqrstuvwxyz' AS small),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), big, small), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, letters),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), big, small), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, letters),
df AS (SELECT r, f, count(*) AS n FROM (SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d) GROUP BY r, f),
bf AS (SELECT f, count(*) AS n FROM (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b) GROUP BY f),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
k AS MATERIALIZED (SELECT f, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(0, length(h) // 2),
    lambda i: [CAST((strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, v: xor(xor(c, v) >> 1, (xor(c, v) & 1) * 3988292384))) % 10000 AS bucket FROM u),
s AS (SELECT bucket, sum(n) AS x FROM df JOIN k USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS y FROM bf JOIN k USING (f) GROUP BY bucket),
z AS (SELECT CAST(coalesce((SELECT sum(x) FROM s), 0) AS DOUBLE) AS big, CAST(coalesce((SELECT sum(y) FROM t), 0) AS DOUBLE) AS small),
g AS (SELECT s.bucket, CAST(floor(1000.0::DOUBLE * ln((coalesce(y, 0) + 1.0::DOUBLE) * (big + 10000.0::DOUBLE) / ((x + 1.0::DOUBLE) * (small + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), z),
m AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM df JOIN k USING (f) JOIN g USING (bucket) GROUP BY r),
sc AS (SELECT d.r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
    CASE WHEN n_features IS NULL THEN 0 WHEN total >= 0 THEN total // n_features ELSE -((-total + n_features - 1) // n_features) END AS weight FROM d LEFT JOIN m USING (r)),
sd AS (SELECT *, weight + CAST(floor(-1000.0::DOUBLE * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM sc),
rk AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank, count(*) OVER () AS n FROM sd WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM sd LEFT JOIN rk USING (r)
"""
