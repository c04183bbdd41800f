"""The corpus operators against plain versions, on documents with nulls, copies, near copies, long and empty texts."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from veldspar.llm import components, decontaminate, exact_dedup, html_extract, html_pages, language, lattice, line_dedup, minhash, mixing, quality, queries, substring
from veldspar.llm.common import table

CLASHING = ["rep", "family", "bucket", "key", "file", "row", "_row", "piece", "score", "kept", "size", "target", "n", "gone_file", "_gone", "sha", "digest"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(5)
    words = {l: ["".join(r.choice(a) for _ in range(r.randint(1, 3))) for _ in range(60)] for l, a in (("en", ["th", "er", "on", "an", "re"]), ("de", ["sch", "ung", "ein", "ü", "ch"]))}
    rows = []

    def text(lang, n):
        return " ".join(r.choice(words[lang]).capitalize() if r.random() < 0.1 else r.choice(words[lang]) for _ in range(n))

    shared = text("en", 60)
    for i in range(150):
        lang = "en" if i % 3 else "de"
        t = text(lang, r.choice([1, 2, 5, 30, 80, 200]))
        if i % 10 == 4:
            t = t + " " + shared
        if i % 11 == 7:
            t = rows[i // 2][1]
        if i % 13 == 5:
            w = (rows[i // 2][1] or "x").split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        if i % 10 == 0:
            t = " ".join(w + "###" for w in t.split(" "))
        rows.append((i, t, lang, f"s{min(i % 7, 3)}", len(t)))
    rows += [(200, None, "en", None, None), (201, "", None, "s1", 0), (202, " \t\n ", "de", "s2", 4), (203, "12 34 !!", "en", "s2", 8), (204, text("en", 12000), "en", "s0", 1), (205, shared * 3, "en", "s0", 1), (206, "One", "en", "s9", 3), (207, "ONE", "en", "s9", 3)]
    return rows


ROWS = corpus()
PAIRS = [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The tables as Parquet, documents in several files and with columns of clashing names."""
    root = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(ROWS, DOCS)
    docs.select("*", *[F.lit("x").alias(c) for c in CLASHING]).repartition(3).write.parquet(f"{root}/documents.parquet")
    items = [(1, " ".join(ROWS[4][1].split()[3:40])), (2, ROWS[154][1][:400]), (3, "One"), (4, None), (5, ""), (6, " ".join(ROWS[30][1].split()[:5])), (7, " ".join(ROWS[8][1].split()[-20:]) + " tail")]
    extra = [F.lit("x").alias(c) for c in ("block", "source", "n_words", "doc_id", "_row")]
    spark.createDataFrame(items, "item_id long, text string").select("*", *extra).write.parquet(f"{root}/benchmark.parquet")
    labels = [(i, int(i % 10 != 0), 0) for i in range(150) if i % 4] + [(7, 1, 1), (999, 1, 0), (None, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").select("*", *[F.lit("x").alias(c) for c in ("text", "source", "size", "key", "w")]).write.parquet(f"{root}/labels.parquet")
    pages = [(i, f"https://Site{i % 2}.example/{i}", f"<html><body><nav><a href='/'>Home</a></nav><p>About us {i % 2}</p><p>Text <b>number</b> {i}</p><script>Home</script></body></html>") for i in range(12)]
    pages += [(30 + i, "http://me:pw@two.example:80/x", f"\tTop\n<p> page {i}\x0c</p><b>x</b> \t <!-- Top --><p>last < {i}") for i in range(2)]
    pages += [(40, "http://two.example/y", "<p>Top</p>\t<script>Top"), (41, "http://one.example", "<p>Alone</p>a <b c")]
    pages += [(20, None, "<p>Alone</p>"), (21, "https://site0.example/x", None), (22, "no host", ""), (20, None, "<p>Alone</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").select("*", F.lit(1).alias("lines"), F.lit(2).alias("host")).write.parquet(f"{root}/pages.parquet")
    return root


@pytest.fixture(scope="module")
def docs(spark, folder):
    return table(spark, folder, "documents")


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def with_sql(spark, folder, name):
    """Rows of a query and of its SQL, in a common order."""
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(n) for n in names]
    expected = [tuple(row[k] for k in order) for row in want.fetchall()]
    got = queries.queries()[name](spark, folder)
    assert sorted(got.columns) == names
    return sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))), sorted(map(repr, expected))


def test_long_words_that_sums_of_powers_confuse(spark):
    from tests.llm.test_kernel import doubled

    rows, items = [], []
    for n in (1024, 4096):
        a, b = doubled(n), doubled(n, "b", "a")
        lead = " ".join(f"w{i}" for i in range(19))
        rows += [(len(rows) + i, t) for i, t in enumerate((f"{lead} {a}", f"{lead} {b}", a, b, f"{lead} {a} x", f"{b} {lead}"))]
        items += [(n, f"{' '.join(lead.split()[-12:])} {b}"), (n + 1, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = substring.remove_repeats(docs).withColumn("kept_sha256", F.sha2(F.col("text").cast("binary"), 256))
    assert by_id(cut, "n_words", "n_removed", "kept_sha256") == brute.substring(rows)
    for k, percent in ((3, 85), (1, 100), (3, 50)):
        assert by_id(minhash.near_duplicates(docs, shingle=k, similarity=percent), "n_shingles", "component_id", "kept") == brute.near(rows, k, percent)
    for block in (1 << 24, 900):
        hits = decontaminate.contamination(docs, bench, block_bytes=block)
        assert by_id(hits, "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute.contamination(rows, items)
    wanted = brute.base_scores(rows)
    for i, got in by_id(lattice.score_texts(docs, rounds=0), "n_tokens", "n_known", "train_tokens", "base_score").items():
        assert got[:3] == wanted[i][:3] and math.isclose(got[3], wanted[i][3], rel_tol=1e-9)


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op9_mix_sources", "op10_line_dedup"])
def test_against_sql(spark, folder, name):
    got, want = with_sql(spark, folder, name)
    assert got == want


def test_substring(spark, folder, docs):
    want = brute.substring(PAIRS)
    assert by_id(queries.op1_substring_dedup(spark, folder), "n_words", "n_removed", "kept_sha256") == want
    small = substring.remove_repeats(docs, piece_bytes=500, per_shard=300)
    assert by_id(small.withColumn("s", F.sha2(F.col("text").cast("binary"), 256)), "n_words", "n_removed", "s") == want


def test_pieces_stay_bucketed_and_out_of_the_catalog(spark, docs):
    pieces = substring.write_pieces(docs, 500)
    answers = spark.range(5).withColumnRenamed("id", "piece").groupBy("piece").count()
    plan = pieces.join(answers.hint("shuffle_hash"), "piece", "left")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    assert sum(len(r["ids"]) for r in pieces.collect()) == len(ROWS)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("veldspar")]


def test_exact_dedup_compares_full_texts_when_digests_collide(docs, tmp_path):
    right = by_id(exact_dedup.exact_dedup(docs), "keep_id", "group_size", "kept", "text_sha256")
    assert by_id(exact_dedup.exact_dedup(docs, digest_bytes=1), "keep_id", "group_size", "kept", "text_sha256") == right
    rows, at = exact_dedup.plain_read(docs)
    assert by_id(exact_dedup.exact_dedup(rows, located=at, digest_bytes=1), "keep_id", "group_size", "kept", "text_sha256") == right
    half = docs.filter("doc_id % 2 = 0")
    exact_dedup.exact_dedup(docs.filter("doc_id % 2 = 1"), state_path=f"file://{tmp_path}/state", digest_bytes=1).count()
    got = by_id(exact_dedup.exact_dedup(half, state_path=f"file://{tmp_path}/state", digest_bytes=1), "keep_id", "group_size", "kept", "text_sha256")
    assert got == {i: x for i, x in right.items() if i % 2 == 0}


def test_exact_dedup_reads_the_updates_of_a_new_arrival_only(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    rows = [spark.createDataFrame([(10 * a + i, f"text {i % 3} {a * (i % 2)}") for i in range(6)], "doc_id long, text string") for a in range(4)]
    for a, part in enumerate(rows):
        seen = exact_dedup._Seen(part, None, path, f"part {a}", 1, 32)
        read = {f.split("/batch=")[1].split("/")[0] for f in seen.state.inputFiles()}
        every = {d.name.removeprefix("batch=") for d in (tmp_path / "state" / "updates").iterdir()}
        assert read and (len(read) < len(every) or a == 0)
        so_far = [r for p in rows[: a + 1] for r in p.collect()]
        texts = Counter(r["text"] for r in so_far)
        got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in seen.verdicts().collect()}
        assert got == {r["doc_id"]: (max(x["doc_id"] for x in so_far if x["text"] == r["text"]), texts[r["text"]]) for r in part.collect()}
    again = exact_dedup._Seen(rows[1], None, path, "part 1", 1, 32)  # taken in before: no batch is new, and all are read
    assert {r["doc_id"]: r["group_size"] for r in again.verdicts().collect()} == {r["doc_id"]: texts[r["text"]] for r in rows[1].collect()}
    empty = exact_dedup._Seen(rows[0].limit(0), None, path, "none", 1, 32)
    assert empty.verdicts().count() == 0


def test_exact_dedup_state_takes_batches_and_arrivals(spark, docs, tmp_path):
    path = f"file://{tmp_path}/state"
    right = by_id(exact_dedup.exact_dedup(docs), "keep_id", "group_size", "kept")
    assert by_id(exact_dedup.exact_dedup(docs.repartition(3), files_per_trigger=1), "keep_id", "group_size", "kept") == right
    first, second = docs.filter("doc_id < 90").repartition(2), docs.filter("doc_id >= 90")
    plain = {}
    for i, t in PAIRS:
        if i < 90:
            plain.setdefault(t or "", []).append(i)
    assert by_id(exact_dedup.exact_dedup(first, state_path=path, arrival="one", files_per_trigger=1), "keep_id", "group_size") == {i: (max(g), len(g)) for g in plain.values() for i in g}
    for _ in range(2):  # the second time its rows are not counted again
        got = by_id(exact_dedup.exact_dedup(second, state_path=path, arrival="two"), "keep_id", "group_size", "kept")
        assert got == {i: x for i, x in right.items() if i >= 90}
    kept = exact_dedup.keep_one(docs.filter("doc_id IN (3, 7, 18)"), state_path=path, arrival="two more")  # each seen before under its id: the later place stays
    assert kept.columns == docs.columns and kept.count() == sum(right[i][0] == i for i in (3, 7, 18))


def test_exact_dedup_of_rows_that_share_a_place_in_a_file(spark, tmp_path):
    spark.createDataFrame([(1, "a|b|a"), (2, "c|b"), (3, "d")], "doc_id long, text string").write.parquet(f"{tmp_path}/t")
    split = spark.read.parquet(f"{tmp_path}/t").select("doc_id", F.explode(F.split("text", "[|]")).alias("text"))
    assert sorted(r["text"] for r in exact_dedup.keep_one(split).collect()) == ["a", "b", "c", "d"]
    assert sorted((r["text_sha256"], r["group_size"]) for r in exact_dedup.exact_dedup(split).filter("kept").collect()) == sorted((brute.sha(t), n) for t, n in (("a", 2), ("b", 2), ("c", 1), ("d", 1)))
    named = split.withColumn("_metadata", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("doc", F.lit(3)).withColumn("_flag", F.lit(4))
    assert exact_dedup.keep_one(named).columns == named.columns and exact_dedup.keep_one(named).count() == 4
    spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z")], "doc_id long, text string, _metadata string").write.parquet(f"{tmp_path}/named/documents.parquet")
    got = by_id(queries.queries()["op2_exact_dedup"](spark, f"{tmp_path}/named"), "keep_id", "group_size", "kept")
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True)}
    drawn = spark.read.parquet(f"{tmp_path}/t").sample(0.7, seed=3)
    assert exact_dedup.keep_one(drawn).count() == drawn.count()


def test_exact_dedup_of_repeated_rows_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(map(repr, [tuple(r)[:4] for r in exact_dedup.exact_dedup(rows).collect()]))
    assert got == sorted(map(repr, [(1, 1, 3, True), (1, 1, 3, False), (None, 1, 3, False), (None, None, 1, True), (2, 3, 2, False), (3, 3, 2, True)]))
    assert exact_dedup.keep_one(rows).count() == 3


def test_near_duplicates(spark, folder, docs, monkeypatch):
    want = brute.near(PAIRS, 3, 85)
    assert by_id(queries.op3_minhash(spark, folder), "n_shingles", "component_id", "kept") == want
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 3)
    assert by_id(minhash.near_duplicates(docs, shingle=5, similarity=80), "n_shingles", "component_id", "kept") == brute.near(PAIRS, 5, 80)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == sum(x[2] for x in brute.near(PAIRS, 5, 80).values())


def test_a_large_family_is_linked_across_blocks(spark, monkeypatch):
    r = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(60)] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 8)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 700)
    got = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, similarity=85), "n_shingles", "component_id", "kept")
    assert got == brute.near(rows, 3, 85)


def test_a_chain_of_mostly_unlinked_documents(spark, monkeypatch):
    r = random.Random(9)
    words, rows = [f"w{i}" for i in range(80)], []
    for i in range(400):  # each keeps about three in four of the words of the one before: near enough to share a bucket, seldom to be linked
        words = [f"x{r.randrange(10**6)}" if r.random() < r.choice([0.0, 0.01, 0.1]) else w for w in words]
        rows.append((i, " ".join(words)))
    want = brute.near(rows, 3, 85)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert 20 < len({x[1] for x in want.values()}) < 390
    assert by_id(minhash.near_duplicates(docs, shingle=3, similarity=85), "n_shingles", "component_id", "kept") == want
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 4)
    assert by_id(minhash.near_duplicates(docs, shingle=3, similarity=85), "n_shingles", "component_id", "kept") == want


@pytest.mark.parametrize("similarity", [30, 65, 96])
def test_near_duplicates_at_any_threshold(spark, similarity):
    r = random.Random(similarity)
    rows = []
    for i in range(120):
        words = rows[r.randrange(len(rows))][1].split() if rows and i % 3 else [f"y{r.randrange(10**6)}" for _ in range(60)]
        rows.append((i, " ".join(f"z{r.randrange(10**6)}" if r.random() < r.choice([0.005, 0.02, 0.1]) else w for w in words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(minhash.near_duplicates(docs, shingle=3, similarity=similarity), "n_shingles", "component_id", "kept") == brute.near(rows, 3, similarity)


def test_band_shapes():
    assert minhash.band_shape(85) == (25, 5) and minhash.band_shape(80) == (31, 4)
    for similarity in range(11, 101):
        bands, places = minhash.band_shape(similarity)
        assert bands * places <= 126 and (1 - (similarity / 100) ** places) ** bands <= 1e-6
    for similarity in (5, 101):
        with pytest.raises(ValueError, match="similarity"):
            minhash.band_shape(similarity)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    label = {}
    for a, b in edges:
        label[a], label[b] = min(label.get(a, a), a), min(label.get(b, b), b)
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in label.items() if any(a != b and k in (a, b) for a, b in edges)}


def test_decontamination(spark, folder, docs):
    bench = table(spark, folder, "benchmark")
    want = brute.contamination(PAIRS, [(r["item_id"], r["text"]) for r in bench.collect()])
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_id(queries.op6_decontaminate(spark, folder), *columns) == want
    assert by_id(decontaminate.contamination(docs, bench, block_bytes=300), *columns) == want
    clean = sorted(i for i, x in want.items() if not x[4])
    for block in (1 << 20, 300):
        kept = decontaminate.decontaminate(docs, bench, block_bytes=block)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == clean


def test_decontamination_of_repeated_words(spark):
    r = random.Random(6)

    def text(words, n):
        return " ".join(r.choice(words) for _ in range(n))

    items, rows = [], []
    for i in range(12):
        words = ["a", "b", "c"][: 1 + i % 3]
        items.append((i, text(words, r.choice([1, 5, 12, 13, 14, 30]))))
        rows += [(10 * i + j, f"{text(words, 60)} {items[-1][1]} {text(['x', 'y'], 20)}") for j in range(3)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for block in (1 << 20, 60):
        assert by_id(decontaminate.contamination(docs, bench, block_bytes=block), *columns) == brute.contamination(rows, items)


def test_decontamination_of_one_word_over_and_over_takes_time_in_proportion():
    import time

    import pyarrow as pa

    index = decontaminate.Index(["1"], pa.array(["a " * 10_000]))
    began = time.process_time()
    (found,) = decontaminate._spans(pa.array(["a " * 500_000]), index)
    assert decontaminate._judge(*found) == ([500_000], ["1"], [1])
    assert time.process_time() - began < 10


def test_quality(spark, folder, docs):
    rows = {r["doc_id"]: r for r in queries.op5_quality(spark, folder).collect()}
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    held = [i for i in range(150) if rows[i]["held_out"] and len(ROWS[i][1]) > 30 and i % 11 != 7 and i % 13 != 5]
    assert np.mean([rows[i]["predicted"] == (i % 10 != 0) for i in held]) > 0.95
    kept = quality.filter_quality(docs, table(spark, folder, "labels"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["predicted"]}
    import pyarrow as pa

    weights = np.random.default_rng(1).normal(size=1 << quality.BITS)
    alone = quality.scores(pa.array([ROWS[5][1]]), weights, 0.5)[0]
    assert {x for i in range(40) for x in quality.scores(pa.array([*(r[1] for r in ROWS[:i]), ROWS[5][1]]), weights, 0.5)[-1:]} == {alone}
    none = quality.classify(docs, table(spark, folder, "labels").limit(0))
    assert {r["score"] for r in none.collect()} == {0.5}


def test_quality_training_against_a_plain_learner():
    import pyarrow as pa

    texts, labels = [r[1] for r in ROWS[:60]], np.array([int(r[0] % 10 != 0) for r in ROWS[:60]])
    rule, bits = quality.Ftrl(), 12
    got, bias = quality.train(pa.array(texts), labels, bits=bits, rule=rule)
    counts = []
    for places, off in quality.features(pa.array(texts), quality.kernel.Hasher(quality.SEED), bits):
        counts += [Counter(places[a:b].tolist()) for a, b in zip(off[:-1], off[1:])]
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= rule.l1 else -(z[i] - math.copysign(rule.l1, z[i])) / ((rule.beta + math.sqrt(n[i])) / rule.alpha + rule.l2)

    order, share = np.random.default_rng(quality.SEED), {y: np.mean(labels == y) for y in (0, 1)}
    for _ in range(quality.EPOCHS):
        for d in order.permutation(len(texts)):
            x = {i: c / math.sqrt(sum(counts[d].values())) for i, c in counts[d].items()} | {"bias": 1.0}
            w = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x))) - labels[d]
            for i, v in x.items():
                step = g * v * 0.5 / share[labels[d]]
                z[i] += step - (math.sqrt(n[i] + step * step) - math.sqrt(n[i])) / rule.alpha * w[i]
                n[i] += step * step
    assert bias == pytest.approx(weight("bias"), abs=1e-6)
    assert np.allclose(got, [weight(i) for i in range(1 << bits)], atol=1e-6)


def test_the_sample_of_languages_is_bounded_in_bytes(spark):
    rows = [(i, f"{'word ' * (i % 40)}tail{i}", "en") for i in range(300)] + [(1000 + i, "x" * 5000 + str(i), "en") for i in range(50)]
    rows += [(2000 + i, "y" * (3000 + 10 * i), "de") for i in range(30)] + [(3000, "z" * 90000, "fr"), (3004, "z" * 80000, "fr"), (4000, "q", "es"), (4001, "q" * 2000, "es"), (4003, None, "es"), (4004, "q", None)]
    drawn = {}
    for r in language.draw(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 20, 1000).orderBy("place").collect():
        drawn.setdefault(r["lang"], []).append(r["text"])
    assert len(drawn["en"]) == 20 and all(len(t) <= 1000 for t in drawn["en"])
    assert len(drawn["de"]) == 6 and [len(t) for t in drawn["de"]] == sorted(len(t) for t in drawn["de"]) and sum(map(len, drawn["de"])) <= 20000
    assert len(drawn["fr"]) == 1 and drawn["es"][0] in ("q", "q" * 2000)  # one at least, however long


def test_language(spark, folder, docs):
    rows = {r["doc_id"]: r for r in queries.op8_language(spark, folder).collect()}
    plain = [i for i in range(150) if len(ROWS[i][1]) > 40 and i % 11 != 7 and i % 13 != 5 and i % 10 != 4]
    assert np.mean([rows[i]["lang_pred"] == ROWS[i][2] for i in plain]) == 1
    assert {rows[i]["lang_pred"] for i in (200, 201, 202, 203)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_learns_every_drawn_document_whole(spark):
    r = random.Random(8)
    texts = {lang: ["".join(r.choice(letters) for _ in range(n)) for n in [30_000] + [1500] * 20] for lang, letters in (("x", "abcdef "), ("y", "abcdef "))}
    docs = spark.createDataFrame([(i, t, lang) for lang, own in texts.items() for i, t in enumerate(own)], "doc_id long, text string, lang string")
    parsers = language.learn(docs)
    train = {r["doc_id"] for r in docs.filter(language.split_of(F.col("doc_id"), language.FOLDS) != language.HELD_OUT).select("doc_id").collect()}
    assert 0 in train and len(train) > 12
    for lang, own in texts.items():
        column = parsers.langs.index(lang)
        for i in train - {0}:  # a text that was learnt whole is one phrase
            buf, off = language.simplify(np.frombuffer(own[i].encode(), np.uint8), np.array([0, len(own[i])]))
            assert parsers.phrases(buf, off)[0, column] == 1
    assert {x["n"] for x in language.draw(docs, 5).groupBy("lang").agg(F.count("*").alias("n")).collect()} == {5}


@pytest.mark.parametrize(("piece", "part"), [(3, 40), (7, 4 << 20), (2048, 4 << 20)])
def test_suffix_automaton_parses_by_longest_match(monkeypatch, piece, part):
    monkeypatch.setattr(language, "PIECE", piece)
    monkeypatch.setattr(language, "SLICE", part)
    r = random.Random(3)

    def phrases(text, sample):
        n = i = 0
        while i < len(text):
            j = i + 1
            while j < len(text) and text[i : j + 1] in sample:
                j += 1
            n, i = n + 1, j
        return n

    for turn in range(60):
        letters = r.choice(["ab ", "abc ", "abcdef "])
        samples = {lang: "".join(r.choice(letters) for _ in range(r.choice([1, 5, 60, 300]))).encode() for lang in "xyz"[: r.randint(1, 3)]}
        texts = [bytes(r.choice(letters.encode() + b"q") for _ in range(r.choice([0, 1, 7, 60, 300]))) for _ in range(r.randint(1, 5))] + [samples["x"] * 2]
        texts = texts[-1:] if turn % 3 == 0 else texts
        parsers = language.Parsers(samples)
        got = parsers.phrases(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
        assert got.tolist() == [[phrases(t, samples[lang]) for lang in parsers.langs] for t in texts]
    assert language.Parsers({"x": b"abcabcabc"}).phrases(np.frombuffer(b"abdcabdabdab", np.uint8), np.array([0, 4, 12])).tolist() == [[3], [5]]


def test_lattice(spark, folder, docs):
    names, logp = lattice.load_vocabulary()
    place = {n: i for i, n in enumerate(names)}
    model = lattice.Lattice(names)
    words = [b" the", " schöne".encode(), b" \xff\xfe", b" x", b" " + b"ab" * 30]
    buf, off = np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])])
    total, expected = model.run(buf, off, logp, np.ones(len(words)))

    def marginal(w):
        a = [1.0]
        for j in range(1, len(w) + 1):
            a.append(sum(a[i] * math.exp(logp[place[w[i:j]]]) for i in range(j) if w[i:j] in place) + a[j - 1] * math.exp(logp[len(names) + w[j - 1]]))
        return math.log(a[-1])

    assert np.allclose(total, [marginal(w) for w in words])
    assert np.bincount(np.zeros(len(expected), int), expected * [*map(len, names), *[1] * 256])[0] == pytest.approx(len(buf))
    want = brute.base_scores(PAIRS)
    got = {r["doc_id"]: r for r in lattice.score_texts(docs, piece_bytes=2000, per_shard=50, rounds=1).collect()}
    for i, (tokens, known, n, base) in want.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n) and r["base_score"] == pytest.approx(base) and r["score"] < 0
    one = {r["doc_id"]: r["score"] for r in lattice.score_texts(docs, rounds=1).collect()}
    assert all(one[i] == pytest.approx(got[i]["score"], rel=1e-5) for i in one)

    # A plain model: every segmentation of every training word, and two rounds of expectation-maximisation.
    split = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for i, t in PAIRS}
    training = [i for i in split if lattice.is_training(i)]
    counts = Counter(w for i in training for w in split[i])
    n, ends = sum(counts.values()) + len(training), len(training)
    new = (sum(c == 1 for c in counts.values()) + 1) / (n + 1)
    end = (ends + 1) / (n + 2)
    p = np.exp(logp)
    words = {w for ws in split.values() for w in set(ws)}
    for rounds in range(3):
        if rounds:
            total = np.full(len(p), lattice.FLOOR)
            for w, c in counts.items():
                arcs, a, b = paths(b" " + w, place, len(names), p)
                for i, j, k in arcs:
                    total[k] += c * a[i] * p[k] * b[j] / a[-1]
            p, end = total / (total.sum() + ends + 1), (ends + 1) / (total.sum() + ends + 1)
        own = {w: paths(b" " + w, place, len(names), p)[1][-1] for w in words}
        for r in lattice.score_texts(docs, rounds=rounds).collect():
            ws = split[r["doc_id"]]
            assert r["score"] == pytest.approx(sum(math.log10(own[w]) for w in ws) + math.log10(end), rel=1e-5)
            arc = sum(math.log10((1 - new) * counts[w] / n + new * own[w]) for w in ws) + math.log10((1 - new) * ends / n + new * end)
            assert r["word_score"] == pytest.approx(arc, rel=1e-5)


def paths(word, place, n, p):
    """Arcs (from, to, piece) of a word's lattice, and the summed probabilities of all ways up to and from each place."""
    arcs = [(i, j, place[word[i:j]]) for i in range(len(word)) for j in range(i + 1, len(word) + 1) if word[i:j] in place] + [(i, i + 1, n + word[i]) for i in range(len(word))]
    ahead, back = [1.0] + [0.0] * len(word), [0.0] * len(word) + [1.0]
    for j in range(1, len(word) + 1):
        ahead[j] = sum(ahead[i] * p[k] for i, t, k in arcs if t == j)
    for i in range(len(word) - 1, -1, -1):
        back[i] = sum(back[t] * p[k] for f, t, k in arcs if f == i)
    return arcs, ahead, back


def test_mixing_meets_targets(spark, folder, docs):
    rows = queries.op9_mix_sources(spark, folder).collect()
    per = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        s = per.setdefault(r["source"], [0, r["target"], r["source_size"]])
        s[0] += r["taken"]
    total = sum(s[2] for s in per.values())
    assert sum(s[1] for s in per.values()) == pytest.approx(total)
    for taken, target, size in per.values():
        assert target <= 3 * size + 1e-6 and abs(taken - target) <= 1
    assert sorted(map(repr, mixing.mix_sources(docs.repartition(5), table(spark, folder, "labels")).collect())) == sorted(map(repr, rows))


def test_html_model_on_pages_it_has_not_seen():
    model = html_extract.trained()
    wrong = total = 0
    for page in html_pages.labelled_pages(150, seed=77):
        blocks = html_extract.read_blocks(page)
        gold = [any(html_extract.element_features(*e)[1] for e in b.path) for b in blocks]
        wrong += sum(a != b for a, b in zip(model.label(blocks), gold))
        total += len(blocks)
    assert wrong / total < 0.01


def test_html_reader():
    page = "<!-- x --><title>No</title><body><p>A <b>b&amp;c<br>d<p>E\n f</b><script>var t='</p>'</script><ul><li>one<li>two</ul>tail<!-- open"
    assert [b.text for b in html_extract.read_blocks(page)] == ["A b&c d", "E f", "one", "two", "tail"]
    assert html_extract.read_blocks("") == [] and html_extract.read_blocks("<script>x") == []
    assert [b.text for b in html_extract.read_blocks("a < b <p title='>'>c</p></div>d")] == ["a < b", "c", "d"]


def test_html_reader_against_a_plain_one():
    r = random.Random(4)
    parts = ["<p>", "</p>", '<div class="a">', "</div>", "<a href='x>y'>", "</a>", "<a ", "'x' ", '"', "'", "=", "<", "<!", "<!--", "-->", "<svg/>", "<svg a=b/>", "</svg>", "<script>", "</script>", "<br/>", "<li>", "<ul>", "</ul>", "text ", "w&amp;x ", "<td>", "<tr>", "<table>", "</b>", "<b>", "\n", ">", "/", "<h1>", "</", "<?x", "<span hidden>", "<math />", "<object>"]
    for _ in range(4000):
        page = "".join(r.choice(parts) for _ in range(r.randint(1, 25)))
        got = [(b.text, b.path, b.linked, b.container) for b in html_extract.read_blocks(page)]
        assert got == brute.page_blocks(page), page


def test_html_extraction_against_a_plain_one():
    import pyarrow.parquet as pq

    model = html_extract.trained()
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    assert all(model.extract(p) == brute.main_text(p, model, html_extract) for p in [*pages, *html_pages.labelled_pages(60, seed=5), None, ""])


@pytest.mark.parametrize(
    "page",
    ["<p>text <a " + "'x' " * 100_000, "<a" * 500_000, "<a " * 300_000, "<!" * 500_000, '<a ="> <a " ' * 80_000, "<b>" * 150_000 + "x</i>" * 50_000, "<h1>x" * 100_000, "<p " + "class=" * 150_000 + '">x', "&#" + "9" * 1_000_000 + ";", "<script" * 100_000, "word " * 2_000_000, "<svg " + "=a" * 200_000 + " x/>t"],
    ids=["unclosed quotes", "a in a", "a without end", "declarations", "quotes that hide ends", "deep", "deep headings", "attributes", "digits", "scripts", "10 MB of text", "values"],
)
def test_html_reader_takes_time_in_proportion(page):
    import time

    began = time.process_time()
    html_extract.trained().label(html_extract.read_blocks(page))
    assert time.process_time() - began < 10


def test_html_references_of_many_digits():
    assert [b.text for b in html_extract.read_blocks("<p>&#" + "0" * 5000 + "65; &#x" + "f" * 5000 + "; &#00000038;lt;")] == ["A \ufffd &lt;"]


def test_html_reader_goes_on_after_unseen_elements_without_end():
    def texts(html):
        return [b.text for b in html_extract.read_blocks(html)]

    for empty in ("<svg/>", '<svg width="2" a="b=c" />', '<SVG class="i"/>', "<math/>", "<svg>", "<video src=a>", "<canvas>", "<object>", "<template>"):
        assert texts(f"<p>one</p>{empty}<p>two</p>{empty}<p>three</p>") == ["one", "two", "three"]
    assert texts("<p>one</p><svg/><p>two</p><svg><text>no</text></svg><p>three</p>") == ["one", "two", "three"]
    assert texts("<p>one</p><svg width=2/><text>no</text></svg><p>two</p>") == ["one", "two"]
    for tag in ("script", "style", "title", "iframe", "noscript"):
        assert texts(f"<p>one</p><{tag}>a<p>two</p>") == ["one"] and texts(f"<p>one</p><{tag}/>a<p>two</p>") == ["one"]


def test_viterbi_is_the_best_path():
    from itertools import product

    model = html_extract.trained()
    for page in html_pages.labelled_pages(12, seed=31):
        blocks = html_extract.read_blocks(page)[:9]
        unary = [model.score(b, i / len(blocks)) for i, b in enumerate(blocks)]

        def worth(y):
            return sum(u for u, t in zip(unary, y) if t) + sum(model.pairs[int(blocks[i].container == blocks[i - 1].container)][int(y[i - 1]), int(y[i])] for i in range(1, len(y)))

        best = max(worth(y) for y in product([False, True], repeat=len(blocks)))
        assert worth(model.label(blocks)) == pytest.approx(best)


def test_html_query(spark, folder):
    rows = queries.op4_html_extract(spark, folder).collect()
    assert len(rows) == 20 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert {r["text"] for r in rows if r["page_id"] in (21, 22)} == {""}


def test_line_dedup_drops_a_sites_common_lines(spark, folder):
    rows = {r["page_id"]: r for r in line_dedup.line_dedup(table(spark, folder, "pages")).collect()}
    assert rows[3]["text"] == "Text number 3" and rows[3]["host"] == "site1.example" and rows[3]["n_dropped"] == 2
    assert rows[20]["text"] == "" and rows[20]["n_dropped"] == 1 and rows[21]["n_lines"] == 0  # on 2 of the 3 pages without host
    assert rows[30]["host"] == "two.example" and rows[30]["text"] == "page 0\nlast < 0" and rows[40]["text"] == "" and rows[41]["text"] == "Alone\na <b c"


def test_line_dedup_takes_time_in_proportion(spark):
    import time

    hard = ["<!--" * 200_000, "<script " * 100_000, "<a " * 200_000, "<" * 500_000, "<b" * 300_000, " " * 500_000 + "x", "\n" * 500_000]
    rows = spark.createDataFrame([(i, "http://h", x) for i, x in enumerate(hard)], "page_id long, url string, html string")
    began = time.perf_counter()
    assert line_dedup.line_dedup(rows).count() == len(hard)
    assert time.perf_counter() - began < 60


def test_every_query_takes_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "benchmark", "labels", "pages"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name, f in queries.queries().items():
        assert f(spark, str(tmp_path)).count() == 0, name


def test_names_of_the_queries():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()] == list(range(1, 14))


def plain_quality(spark, rows, labels):
    """Scores by id: features word by word, and a learner over dictionaries."""
    hasher, bits, rule = quality.kernel.Hasher(quality.SEED), quality.BITS, quality.Ftrl()

    def hashed(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        return hasher.words(raw, np.array([0]), np.array([len(raw)]))

    def features(text):
        words = [hashed(w) for w in brute.SPACED.findall((text or "").translate(brute.LOWER))]
        pairs = [int(quality.REPEAT) if a == b else int(hasher.grams(np.concatenate([a, b]), np.array([0]), 2)[0]) for a, b in zip(words, words[1:])]
        return Counter(h >> (64 - bits) for h in [*(int(w[0]) for w in words), *pairs])

    known = {}
    for i, y in labels:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            known[i] = max(known.get(i, 0), y)
    order_of = {r["i"]: r["h"] for r in spark.createDataFrame([(i,) for i in known], "i long").select("i", F.xxhash64("i").alias("h")).collect()}
    train = sorted(((order_of[r[0]], r[0], r[1] or "") for r in rows if r[0] in known), key=lambda x: x)
    counts, labels_ = [features(t) for _, _, t in train], [known[i] for _, i, _ in train]
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= rule.l1 else -(z[i] - math.copysign(rule.l1, z[i])) / ((rule.beta + math.sqrt(n[i])) / rule.alpha + rule.l2)

    shuffled, share = np.random.default_rng(quality.SEED), {y: labels_.count(y) / len(labels_) for y in (0, 1)}
    for _ in range(quality.EPOCHS):
        for d in shuffled.permutation(len(train)):
            x = {i: c / math.sqrt(max(sum(counts[d].values()), 1)) for i, c in counts[d].items()} | {"bias": 1.0}
            w = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x))) - labels_[d]
            for i, v in x.items():
                step = g * v * 0.5 / share[labels_[d]]
                z[i] += step - (math.sqrt(n[i] + step * step) - math.sqrt(n[i])) / rule.alpha * w[i]
                n[i] += step * step
    scores = {}
    for r in rows:
        own = features(r[1])
        dot = weight("bias") + (sum(weight(i) * c for i, c in own.items()) / math.sqrt(sum(own.values())) if own else 0.0)
        scores[r[0]] = 1 / (1 + math.exp(-dot))
    return scores


def test_quality_and_pipeline_against_plain_versions_of_every_stage(spark, folder):
    import corpus_pipeline as pipeline

    labels = [(r["doc_id"], r["quality"]) for r in table(spark, folder, "labels").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, folder, "benchmark").collect()]
    scores = plain_quality(spark, ROWS, labels)
    got = {r["doc_id"]: r["score"] for r in queries.op5_quality(spark, folder).collect()}
    assert all(math.isclose(got[i], s, abs_tol=1e-4) for i, s in scores.items()) and len(got) == len(scores)
    kept = [r for r in ROWS if scores[r[0]] >= 0.5]
    assert 0 < len(kept) < len(ROWS)
    last = {r[1] or "": r[0] for r in sorted(kept)}  # of equal texts the largest id stays
    kept = [r for r in kept if last[r[1] or ""] == r[0]]
    near = brute.near([(r[0], r[1]) for r in kept], 5, 80)
    kept = [r for r in kept if near[r[0]][2]]
    hits = brute.contamination([(r[0], r[1]) for r in kept], items)
    kept = [r for r in kept if not hits[r[0]][4]]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", kept)
    con.execute(f"CREATE VIEW labels AS SELECT * FROM '{folder}/labels.parquet/*.parquet'")
    found = con.execute(mixing.ORACLE_SQL.replace("{docs}", "documents"))
    names = [d[0] for d in found.description]
    want = sorted(tuple(row[names.index(c)] for c in ("doc_id", "size", "source_size", "taken")) for row in found.fetchall())
    rows = pipeline.run(spark, folder)
    assert sorted(tuple(r[c] for c in ("doc_id", "size", "source_size", "taken")) for r in rows.collect()) == want


def test_pipeline_on_empty_tables(spark, folder, tmp_path):
    import corpus_pipeline as pipeline

    for name in ("documents", "labels", "benchmark"):
        table(spark, folder, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_keeps_clean_documents(spark, folder):
    import corpus_pipeline as pipeline

    docs, before = table(spark, folder, "documents"), None
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        docs = pipeline.materialise(out, "test")
        before = docs
    left = {r["doc_id"]: r["text"] for r in before.collect()}
    texts = list(left.values())
    assert len(set(texts)) == len(texts)
    final = {r["doc_id"] for r in pipeline.run(spark, folder).collect()}
    assert final == set(left)
