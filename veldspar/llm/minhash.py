"""Near-duplicates by min-max hashing.

A document's set is its distinct runs of SHINGLE words.  Under each of HALF hash functions both the least and the greatest value
are kept, which gives 2 * HALF signature places for HALF evaluations; bands of some places put documents into buckets.  A band has as many places as let a pair at the
threshold miss all bands with probability MISS at most: 5 from 0.85 on (4e-7), 4 at 0.8 (8e-8); below 0.11 not even single places do, and the threshold is refused.

1. Documents with equal sets form a class, of which the smallest id goes on: copies are never compared.
2. The smallest member of a bucket is its hub.  Each document goes to one place first, under the least of its buckets' hubs, in blocks of about BLOCK_SHINGLES
   shingles; within a block all intersections are counted as products of incidence matrices on full sets, together with the hub, and a spanning
   forest of the links is kept.
3. Only buckets whose members are not yet all linked go on; of buckets with the same members one does.  Buckets of one hub are taken together where they are nearly the same
   documents, else each by itself.  There the documents outside the largest linked group are compared with all others: in one block, or, if there are more, block by block
   with those of a compatible set size.  A document meets no other than those it shares a bucket with.
4. Components of the confirmed links name each document's group.

No pair is emitted unless it is a link of a spanning forest, a bucket of any size costs one row per member, and no task holds more than two blocks.
docs is read more than once, so it must be repeatable, as a table is.

Cases: null and wordless texts have the empty set and are linked with nothing; fewer words than SHINGLE make one shingle of them all; ids are integers;
rows with a null id keep a null group; rows repeated with one id are one document of that id; an empty table gives
an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import free_name, materialise, possible, quoted, ready, without
from .components import components

SHINGLE = 5
SIMILARITY = 80
HALF = 63


#: Probability at most that a pair at the threshold shares no bucket.
MISS = 1e-6


def band_shape(similarity: int) -> tuple[int, int]:
    """Bands, and signature places in each: as many places as the threshold allows."""
    t = similarity / 100
    fit = [r for r in range(1, 13) if (1 - t**r) ** (2 * HALF // r) <= MISS]
    if not fit or similarity > 100:
        raise ValueError(f"a similarity of {similarity} hundredths is out of what {2 * HALF} signature places can find, 11 to 100")
    return 2 * HALF // fit[-1], fit[-1]


BLOCK_SHINGLES = 1 << 17
BLOCK_DOCS = 512
COLUMNS_AT_ONCE = 4096
SEED = 3


def shingles(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per slice: distinct shingle hashes of its documents, ascending within each, and their offsets."""
    hasher = kernel.Hasher(SEED)
    for _, _, buf, off in kernel.slices(column):
        low = kernel.LOWER[buf]
        start, end, woff = kernel.find_words(low, off, kernel.SPACE)
        hashes = hasher.words(low, start, end)
        at, goff = kernel.gram_starts(woff, k)
        grams = hasher.grams(hashes, at, k)
        n = np.diff(woff)
        doc = np.repeat(np.arange(len(n)), np.diff(goff))
        for few in range(1, k):  # a short document is one shingle of all its words
            docs = np.flatnonzero(n == few)
            grams = np.concatenate([grams, hasher.grams(hashes, woff[docs], few) ^ kernel.U64(few)])
            doc = np.concatenate([doc, docs])
        order = np.lexsort((grams, doc))
        grams, doc = grams[order], doc[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
        yield grams[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def signature(grams: np.ndarray, off: np.ndarray, n_bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (documents x n_bands) and a 128-bit digest of each set; all documents must have a shingle."""
    rng = np.random.default_rng(SEED)
    factors = rng.integers(2**40, 2**63, HALF, dtype=np.uint64) * kernel.U64(2) + kernel.U64(1)
    places = np.empty((2 * HALF, len(off) - 1), np.uint64)
    for i, factor in enumerate(factors):
        x = grams * factor
        x ^= x >> kernel.U64(29)
        places[2 * i] = np.minimum.reduceat(x, off[:-1])
        places[2 * i + 1] = np.maximum.reduceat(x, off[:-1])
    # Neighbouring places are the two ends of one function; a band takes places of different functions.
    places = np.concatenate([places[::2], places[1::2]])[: n_bands * rows].reshape(n_bands, rows, -1)
    weights = rng.integers(2**40, 2**63, rows, dtype=np.uint64) * kernel.U64(2) + kernel.U64(1)
    bands = kernel.mix((places * weights[None, :, None]).sum(axis=1, dtype=np.uint64) + np.arange(n_bands, dtype=np.uint64)[:, None])
    digest = np.stack([np.add.reduceat(kernel.mix(grams), off[:-1]), np.add.reduceat(kernel.mix(grams ^ kernel.U64(0x5555555555555555)), off[:-1])])
    return bands.T, digest


def _sets(docs: DataFrame, k: int, n_bands: int, width: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest; null if empty), bands."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for grams, off in shingles(batch.column(1), k):
                n = np.diff(off)
                some = np.flatnonzero(n)
                d = np.zeros((2, len(n)), np.int64)
                bands = np.zeros((0, n_bands), np.uint64)
                if len(some):
                    bands, digest = signature(grams, np.append(off[:-1][some], off[-1]), n_bands, width)
                    d[:, some] = digest.view(np.int64)
                boff = np.concatenate([[0], np.cumsum(np.where(n > 0, n_bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(boff), pa.array(np.ascontiguousarray(bands).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), pa.array(n), pa.array(d[0], mask=n == 0), pa.array(d[1], mask=n == 0), lists], schema=arrow)
                at += len(n)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """rep, family, n, grams of the documents whose id is a rep of wanted."""
    arrow = pa.schema([("rep", pa.int64()), ("family", pa.int64()), ("n", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for grams, off in shingles(batch.column(2), k):
                n = len(off) - 1
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(np.diff(off)), lists], schema=arrow)
                at += n

    texts = possible(docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")), "rep", wanted.select("rep"))
    return texts.join(wanted.hint("shuffle_hash"), "rep").select("rep", "family", "text").mapInArrow(run, "rep long, family long, n long, grams array<long>")


def linked(grams: list[np.ndarray], similarity: int, left: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets with 100 * intersection >= similarity * union; with left, of the first `left` against the rest only.

    Intersections are products of 0/1 matrices over the shingles that occur in two sets at least, some thousands of shingles at a time.
    """
    size = np.array([len(g) for g in grams])
    doc = np.repeat(np.arange(len(grams)), size)
    values, place, counts = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    shared = counts[place] > 1
    doc, column = doc[shared], (np.cumsum(counts > 1) - 1)[place[shared]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    rows = slice(0, left) if left is not None else slice(0, len(grams))
    cols = slice(left, len(grams)) if left is not None else slice(0, len(grams))
    both = np.zeros((rows.stop - rows.start, cols.stop - cols.start), np.float32)
    last = column[-1] + 1 if len(column) else 0
    for c in range(0, last, COLUMNS_AT_ONCE):
        part = slice(*np.searchsorted(column, [c, c + COLUMNS_AT_ONCE]))
        x = np.zeros((len(grams), min(COLUMNS_AT_ONCE, last - c)), np.float32)
        x[doc[part], column[part] - c] = 1
        both += x[rows] @ x[cols].T
    common = np.rint(both).astype(np.int64)
    union = size[rows][:, None] + size[cols][None, :] - common
    i, j = np.nonzero(100 * common >= similarity * union)
    i, j = i + rows.start, j + cols.start
    return i[i != j], j[i != j]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the links, for each of n."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


EDGES = "u long, v long"


def _confirm(table: pa.Table, similarity: int) -> pa.Table:
    """Edges of a spanning forest of the links among a task's documents; with a side column, links cross sides."""
    reps = table["rep"].to_numpy()
    order = np.lexsort((reps, table["side"].to_numpy()))
    table = table.take(pa.array(order))
    reps, side = table["rep"].to_numpy(), table["side"].to_numpy()
    column = table["grams"].combine_chunks()
    flat, off = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets.to_numpy()[0]
    grams = [flat[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
    left = int((side == 0).sum())
    crossing = left < len(side)
    if crossing and left == 0:
        i = j = np.zeros(0, np.int64)
    else:
        i, j = linked(grams, similarity, left if crossing else None)
    names, place = np.unique(reps, return_inverse=True)  # a document may stand on both sides
    label = _forest(len(names), place[i], place[j])
    moved = np.flatnonzero(label != np.arange(len(names)))
    return pa.table({"u": names[moved], "v": names[label[moved]]})


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs.  similarity is in hundredths."""
    ready(docs.sparkSession)
    sets = materialise(_sets(docs, shingle, *band_shape(similarity)), "minhash-sets")
    some = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialise(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "minhash-classes")
    edges = _links(docs, some, classes, shingle, similarity)
    group = components(edges)
    named = classes.join(group.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    rows = sets.drop("bands").join(named, ["d1", "d2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def _blocks_of(n: Column, members: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK_SHINGLES), F.ceil(members / BLOCK_DOCS)).cast("int")


def _links(docs: DataFrame, some: DataFrame, classes: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """Confirmed links (u, v) between representatives, enough to connect whatever is linked."""
    reps = classes.select(F.col("rep").alias("doc_id"))
    # A repeated row with one id may stand twice here; that ties nothing new.
    bands = some.join(reps, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), F.explode("bands").alias("bucket"))
    least = bands.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub < last").select("bucket", "hub")
    shared = materialise(bands.join(materialise(least, "minhash-hubs"), "bucket").select("bucket", "hub", "rep"), "minhash-shared")
    homes = materialise(shared.groupBy("rep").agg(F.min("hub").alias("family")), "minhash-homes")
    full = materialise(_full_sets(docs, homes, shingle).dropDuplicates(["rep"]), "minhash-full")

    def confirm(table: pa.Table) -> pa.Table:
        return _confirm(table.select(["rep", "side", "grams"]), similarity)

    # Everyone at home, with the hub.
    guests = full.filter("rep <> family")
    load = materialise(guests.groupBy("family").agg(_blocks_of(F.sum("n"), F.count(F.lit(1))).alias("blocks")), "minhash-blocks")
    dealt = guests.join(load, "family").select("family", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), "rep", F.lit(0).alias("side"), "grams")
    hubs = full.select("rep", "grams").join(load, F.col("rep") == F.col("family"))
    hubs = hubs.select("family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rep", F.lit(0).alias("side"), "grams")
    first = materialise(dealt.unionByName(hubs).groupBy("family", "block").applyInArrow(confirm, EDGES), "minhash-links")
    group = components(first).withColumnRenamed("node", "rep")

    # Buckets that are not yet of one group, one of those with the same members.
    named = full.select("rep", "n").join(group, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = materialise(shared.join(materialise(named, "minhash-groups"), "rep"), "minhash-placed")
    marks = [F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"x{i}") for i in (0, 1)]
    several = placed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("members"), *marks).filter("a <> b")
    open_ = materialise(several.groupBy("members", "x0", "x1").agg(F.min("bucket").alias("bucket")).select("bucket", "members"), "minhash-open")
    if open_.isEmpty():
        return first
    rows = placed.join(open_, "bucket")
    most = rows.groupBy("hub").agg(F.max("members").alias("largest"))
    together = rows.select("hub", "rep").distinct().groupBy("hub").agg(F.count(F.lit(1)).alias("all"))
    merged = most.join(together, "hub").filter(F.col("all") <= F.greatest(F.lit(BLOCK_DOCS), 4 * F.col("largest"))).select("hub", F.lit(True).alias("merged"))
    rows = rows.join(materialise(merged, "minhash-merged"), "hub", "left")
    unit = F.when(F.col("merged"), F.struct(F.lit(0).alias("kind"), F.col("hub").alias("at"))).otherwise(F.struct(F.lit(1).alias("kind"), F.col("bucket").alias("at")))
    rows = materialise(rows.select(unit.alias("unit"), "rep", "n", "component").distinct(), "minhash-units")

    # The largest group of each stays on one side; the others, and all in what fits one block, meet everyone.
    sizes = rows.groupBy("unit", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    main = sizes.groupBy("unit").agg(F.max(F.struct("c", "component"))["component"].alias("main"), _blocks_of(F.sum("s"), F.sum("c")).alias("blocks"))
    step = F.floor(F.log("n") / F.lit(np.log(100.0 / similarity) if similarity < 100 else 1.0)).cast("int")  # sets that link differ by one step at most
    rows = rows.join(materialise(main, "minhash-main"), "unit").withColumn("loose", F.col("component") != F.col("main")).withColumn("step", step)
    whole = rows.filter("blocks = 1").select("unit", "rep", *[F.lit(-1).alias(c) for c in ("s", "i", "t", "j")], F.lit(0).alias("side"))
    large = materialise(rows.filter("blocks > 1").select("unit", "rep", "n", "loose", "step"), "minhash-large")
    per = large.groupBy("unit", "step").agg(
        _blocks_of(F.sum("n"), F.count(F.lit(1))).alias("every"),
        _blocks_of(F.sum(F.when(F.col("loose"), F.col("n")).otherwise(0)), F.sum(F.col("loose").cast("int"))).alias("loose_blocks"),
    )
    near = F.explode(F.array(*[F.col("step") + d for d in (-1, 0, 1)])).alias("other")
    deal = F.xxhash64("rep", F.lit(1))
    spread = large.join(per, ["unit", "step"])
    there = per.select("unit", F.col("step").alias("other"), F.col("every").alias("other_every"), F.col("loose_blocks").alias("other_loose"))
    spread = spread.select("unit", "rep", "loose", "step", F.pmod(deal, F.col("every")).cast("int").alias("own"), F.when(F.col("loose"), F.pmod(deal, F.greatest("loose_blocks", F.lit(1)))).cast("int").alias("own_loose"), near).join(there, ["unit", "other"])
    left = spread.filter("loose").select("unit", "rep", F.col("step").alias("s"), F.col("own_loose").alias("i"), F.col("other").alias("t"), F.explode(F.sequence(F.lit(0), F.col("other_every") - 1)).alias("j"), F.lit(0).alias("side"))
    right = spread.filter("other_loose > 0").select("unit", "rep", F.col("other").alias("s"), F.explode(F.sequence(F.lit(0), F.col("other_loose") - 1)).alias("i"), F.col("step").alias("t"), F.col("own").alias("j"), F.lit(1).alias("side"))
    tasks = materialise(whole.unionByName(left).unionByName(right), "minhash-tasks").join(full.select("rep", "grams"), "rep")
    second = tasks.groupBy("unit", "s", "i", "t", "j").applyInArrow(confirm, EDGES)
    return first.unionByName(second)


def keep_one(docs: DataFrame, *, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of docs that are the first of their group, with all their columns."""
    key = free_name(docs.columns, "_doc")
    gone = near_duplicates(docs, shingle=shingle, similarity=similarity).filter("NOT kept").select(F.col("doc_id").alias(key)).distinct()
    rows = docs.withColumn(key, quoted("doc_id").cast("long"))
    return without(rows, key, materialise(gone, "minhash-gone")).select(*map(quoted, docs.columns))
