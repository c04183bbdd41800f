"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared
folder and read again as the next stage's docs.  All but the last return documents with all their columns:

1. quality: documents that the classifier rejects go;
2. exact dedup: of equal texts the largest id stays;
3. near dedup: one document of each group of near-duplicates (five-word shingles, similarity 0.8 and more) stays;
4. decontamination: documents contaminated by benchmark items go;
5. mixing: how many words of each document the mix of sources takes.

Cases: null and empty texts count as one text, of which one document stays, and give no words to the mix; documents without a label are judged like the others; a null source is a source of its own; null
ids and repeated rows are judged row by row, as each stage's module says; columns of any name pass through to the mix; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veldspar.llm import decontaminate, exact_dedup, minhash, mixing, quality
from veldspar.llm.common import materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("decontamination", decontaminate_stage),
    ("mixing", mix_stage),
]

#: The classifier is trained, which SQL cannot express; a test compares the rows with plain versions of all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
