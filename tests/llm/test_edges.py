"""Repeated rows and null ids: every row has a result, and the defined one."""

import pytest
from pyspark.sql import functions as F

from veldspar.llm import decontaminate, exact_dedup, html_extract, language, lattice, line_dedup, minhash, mixing, quality, substring

LONG = " ".join(f"word{i}" for i in range(30))
ROWS = [(1, LONG, "en", "a"), (1, LONG, "en", "a"), (None, LONG, "en", None), (None, None, None, None), (2, "x", "en", "a"), (2, "x", "en", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_substring_keeps_the_first_of_null_then_smallest_id(docs):
    got = rows(substring.remove_repeats(docs), "doc_id", "n_words", "n_removed")
    assert got == sorted([(1, 30, 30), (1, 30, 30), (None, 30, 0), (None, 0, 0), (2, 1, 0), (2, 1, 0)], key=repr)


def test_near_duplicates_give_null_ids_no_group(docs):
    got = rows(minhash.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted([(1, 26, 1, True), (1, 26, 1, True), (None, 26, None, True), (None, 0, None, True), (2, 1, 2, True), (2, 1, 2, True)], key=repr)


def test_one_result_for_each_row(spark, docs):
    labels = spark.createDataFrame([(2, 1), (None, 0)], "doc_id long, quality int")
    bench = spark.createDataFrame([(None, LONG), (7, LONG), (7, "x")], "item_id long, text string")
    results = [
        exact_dedup.exact_dedup(docs),
        quality.classify(docs, labels),
        decontaminate.contamination(docs, bench),
        decontaminate.contamination(docs, bench, block_bytes=10),
        lattice.score_texts(docs, rounds=1),
        language.identify(docs),
        mixing.mix_sources(docs, labels),
    ]
    for df in results:
        assert sorted((r["doc_id"] for r in df.collect()), key=repr) == sorted((r[0] for r in ROWS), key=repr)
    hits = rows(results[2], "doc_id", "n_hit", "items")
    assert hits == sorted([(1, 30, ",7"), (1, 30, ",7"), (None, 30, ",7"), (None, 0, ""), (2, 1, "7"), (2, 1, "7")], key=repr)
    assert rows(results[3], "doc_id", "n_hit", "items") == hits


def test_pages_of_repeated_and_null_ids(spark):
    pages = spark.createDataFrame([(None, None, "<article><p>A b c.</p></article>"), (1, "http://h/x", None), (1, "http://h/x", None)], "page_id long, url string, html string")
    assert html_extract.extract_text(pages).count() == line_dedup.line_dedup(pages).count() == 3
    assert line_dedup.line_dedup(pages).filter(F.col("page_id") == 1).select("text").distinct().collect()[0][0] == ""


def test_ties_in_size_and_key_are_drawn_once_each(spark):
    docs = spark.createDataFrame([(i // 2, "a b c", f"s{i % 3}") for i in range(60)], "doc_id long, text string, source string")
    got = mixing.mix_sources(docs)
    per = {r["source"]: (r["t"], r["g"]) for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()}
    assert all(abs(t - g) <= 1 for t, g in per.values()) and got.count() == 60


def test_filtering_stages_keep_columns_of_any_name(spark, docs):
    names = ("_metadata", "a.b", "c`d", "kept", "quality", "piece", "_row", "_doc", "_flag")
    named = docs
    for i, n in enumerate(names):
        named = named.withColumn(n, F.lit(i))
    labels = spark.createDataFrame([(2, 1), (None, 0), (1, 1)], "doc_id long, quality int")
    bench = spark.createDataFrame([(7, LONG)], "item_id long, text string")
    stages = {
        "quality": lambda d: quality.filter_quality(d, labels),
        "exact": exact_dedup.keep_one,
        "near": minhash.keep_one,
        "decontaminate": lambda d: decontaminate.decontaminate(d, bench),
        "decontaminate in blocks": lambda d: decontaminate.decontaminate(d, bench.unionByName(bench.withColumn("text", F.lit("q r s t u v w"))), block_bytes=10),
    }
    for stage, function in stages.items():
        plain, got = function(docs), function(named)
        assert got.columns == named.columns, stage
        assert rows(got, "doc_id", "text", "source") == rows(plain, "doc_id", "text", "source"), stage
        assert rows(got.select(*["`" + n.replace("`", "``") + "`" for n in names]), *names) == [tuple(range(len(names)))] * got.count(), stage
