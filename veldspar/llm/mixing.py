"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame expressions only.

Each source gets a token target: its weight's share of all tokens, held to MAX_EPOCHS times
its own size, what is cut off being shared out again by weight.  A source then gives whole
epochs first; the rest of its target is a weighted sample without replacement: document i
gets the key -ln(u_i) / w_i (an exponential variable with rate w_i), documents are sorted by
key inside the source, and their sizes are summed up to the budget.  The document at the
edge gives only the words that still fit.

The sort of a source never meets in one task: keys are cut into monotone buckets of about
max(PER_BUCKET, sqrt(n)) documents, by the distribution function of the source's keys (documents of one weight have exponential keys of that
rate, and how many a source has of each weight is counted), sizes are pre-aggregated by (source, bucket), bucket totals are
prefix-summed, and documents are only sorted inside their bucket.

Cases: a null or blank text has size 0 and gives 0 words; a null source is a source, last
in order; a null id hashes as the empty text; repeated rows are drawn each for itself; an
empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS = 3
PER_BUCKET = 128
SEED = "veldspar-mix"
#: Sampling weight of a document by its quality label.
QUALITY_WEIGHTS = {1: 1.0, None: 0.5, 0: 0.25}


def n_words(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, more: Sequence[Column] = ()) -> DataFrame:
    """Of rows (source, size): source, sid, docs, source_size, more aggregates, target.  One row a source is all that meets in one task."""
    every = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "sid")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"), *more)
    per = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("w", ((F.col("sid") - 1) % 3 + 1).cast("double")).withColumn("top", F.col("source_size") * float(max_epochs))
    per = per.withColumn("ratio", F.col("top") / F.col("w")).withColumn("total", F.sum("source_size").over(every).cast("double"))
    # In order of top / w a source is held at its top if its share of what the earlier ones leave reaches that top.
    per = per.withColumn("left", F.col("total") - F.coalesce(F.sum("top").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("w_left", F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    per = per.withColumn("held", F.col("top") * F.col("w_left") <= F.col("left") * F.col("w"))
    free = F.sum(F.when(~F.col("held"), F.col("w"))).over(every)
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("held"), F.col("top"))).over(every), F.lit(0.0))
    known = [c for c in per.columns if c not in ("w", "top", "ratio", "total", "left", "w_left", "held")]
    return per.select(*known, F.when(F.col("held"), F.col("top")).otherwise(rest / free * F.col("w")).alias("target"))


def sampling_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """Exponential key with the document's weight as its rate; smaller keys are drawn earlier."""
    word = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed)).cast("binary")), 1, 8)
    return -F.ln((F.conv(word, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)) / weight


def mix_sources(docs: DataFrame, labels: DataFrame | None = None, *, max_epochs: int = MAX_EPOCHS, seed: str = SEED, weights: dict | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per row of docs.

    labels (doc_id, quality) gives sampling weights; documents without a label, and all if labels is None, get the weight of None.
    """
    weights = weights or QUALITY_WEIGHTS
    base = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    weight = F.lit(weights[None])
    if labels is not None:
        best = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
        base = base.join(best, "doc_id", "left")
        for value, w in weights.items():
            if value is not None:
                weight = F.when(F.col("quality") == value, F.lit(w)).otherwise(weight)
    base = materialise(base.select("doc_id", "source", "size", weight.alias("weight"), sampling_key(F.col("doc_id"), weight, seed).alias("key")), "mix-keys")

    rates = sorted(set(weights.values()))
    shares = [F.avg((F.col("weight") == F.lit(w)).cast("double")).alias(f"share{i}") for i, w in enumerate(rates)]
    targets = materialise(source_targets(base, max_epochs, shares), "mix-targets").withColumnRenamed("source", "of_source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = base.join(targets, F.col("source").eqNullSafe(F.col("of_source")), "inner").drop("of_source")
    rows = rows.withColumn("epochs", epochs).withColumn("budget", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
    buckets = F.ceil(F.col("docs") / F.greatest(F.lit(float(PER_BUCKET)), F.sqrt("docs")))
    below = reduce(Column.__add__, [F.col(f"share{i}") * (F.lit(1.0) - F.exp(-F.col("key") * F.lit(float(w)))) for i, w in enumerate(rates)])
    rows = rows.withColumn("bucket", F.least(F.floor(buckets * below), buckets - 1).cast("long"))
    rows = materialise(rows.drop("weight", *[f"share{i}" for i in range(len(rates))]), "mix-rows")

    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = F.sum("bucket_size").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = materialise(sums.select("sid", "bucket", F.coalesce(before, F.lit(0)).alias("offset")), "mix-offsets")
    inside = F.sum("size").over(Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    drawn = rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(offsets, ["sid", "bucket"])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("offset") - F.col("inside")))
    return drawn.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"))


ORACLE_SQL = r"""
WITH lab AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
base AS (
  SELECT d.doc_id, d.source, CAST(len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':veldspar-mix'), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)
      / (CASE WHEN q = 0 THEN 0.25 WHEN q = 1 THEN 1.0 ELSE 0.5 END)::DOUBLE AS k
  FROM {docs} d LEFT JOIN lab USING (doc_id)),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM base GROUP BY source),
p2 AS (SELECT *, CAST((sid - 1) % 3 + 1 AS DOUBLE) AS w, source_size * 3.0::DOUBLE AS top, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM per),
p3 AS (SELECT *, total - coalesce(sum(top) OVER (ORDER BY top / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
         sum(w) OVER (ORDER BY top / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM p2),
p4 AS (SELECT *, top * w_left <= lft * w AS held FROM p3),
targets AS (SELECT source, source_size,
    CASE WHEN held THEN top ELSE (total - coalesce(sum(CASE WHEN held THEN top END) OVER (), 0)) / sum(CASE WHEN NOT held THEN w END) OVER () * w END AS target FROM p4),
rows_ AS (SELECT b.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
cum AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM rows_)
SELECT doc_id, source, size, source_size, target,
  epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS taken
FROM cum
"""
