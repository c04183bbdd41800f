"""One query per corpus operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, exact_dedup, html_extract, language, lattice, line_dedup, minhash, mixing, pii, quality, resample, substring
from .common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, at = exact_dedup.plain_read(table(spark, sf_dir, "documents"))
    return exact_dedup.exact_dedup(rows, located=at).drop("file", "row")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, similarity=85)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_texts(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(table(spark, sf_dir, "pages"))
    return rows.withColumn("kept_sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.sanitise(table(spark, sf_dir, "documents"))
    return rows.withColumn("sanitised_sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


OPERATORS = (
    op1_substring_dedup,
    op2_exact_dedup,
    op3_minhash,
    op4_html_extract,
    op5_quality,
    op6_decontaminate,
    op7_lm_score,
    op8_language,
    op9_mix_sources,
    op10_line_dedup,
    op11_pii,
    op12_resample,
    op13_conversations,
)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.ORACLE_SQL.format(docs="documents"),
        "op9_mix_sources": mixing.ORACLE_SQL.replace("{docs}", "documents"),
        "op10_line_dedup": line_dedup.ORACLE_SQL,
        "op12_resample": resample.ORACLE_SQL,
        "op13_conversations": conversations.ORACLE_SQL,
    }
