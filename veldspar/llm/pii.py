"""Personal data: patterns, and information-theoretic sanitisation of the terms that give them away.

Base: e-mail addresses, IP addresses, card and phone numbers by pattern, each searched for by itself in time linear in the text.  Their values (an address in lower case, a
number's digits) are the protected entities.

A term reveals an entity if the corpus uses it beside that entity far more than by chance.  A context is the words of one document within REACH words of the entity's
mentions there, those of entities themselves left out.  With N words in the corpus, n(t) of them the term outside of mentions, c(e) words in contexts of e and n(e, t) of those the term,

    IC(e) = -log2(c(e) / N)          what is to be learnt of e,
    PMI(e; t) = log2((n(e, t) / n(t)) / (c(e) / N))      what t tells of it,

and PMI / IC is the share of e that t discloses.  Where e is mentioned, its terms are generalised to their kind of word from a share of GENERALISE on and removed from REMOVE on, at every place
in the document.  A term counts only if it stands in SUPPORT contexts of e that differ, so that copies of one document are no evidence.

1. One pass finds base spans; the rows are written with them, and all later steps read that table.
2. Contexts of the entities that have SUPPORT different ones are written, one row per document and entity; pairs (entity, term) are pre-aggregated before they are shuffled, and one
   document gives as many pairs as it has words beside entities.
3. The words of the corpus that are a candidate by a bitmap of at most 8 MB are counted per task, then summed, then joined with the candidates.
4. Terms go back to the documents they stand in by a join on the row; rows without any are not shuffled.

Cases: null texts count as empty; empty texts have no spans; overlapping patterns of different kinds are all reported; words are
runs of letters and digits, lower-cased A-Z; repeated rows are judged each; a null id is returned; an empty table gives an empty result; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import SIEVE_BITS, materialise, ready, with_few

KINDS = ("email", "ip", "card", "phone")
REACH = 10
SUPPORT = 3
GENERALISE, REMOVE = 0.85, 0.95
SEED = 13

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
NUMBERS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
NOT_DIGIT = re.compile(r"[^0-9]")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of a local part, @ and a domain of two labels at least: from each @ the local part is read backwards, at most to the last match or @."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        head = text[done:at]
        size = len(head) - len(head.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if size else None
        done = at + 1
        if domain:
            out.append((at - size, domain.end()))
            done = domain.end()
        at = text.find("@", done)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Four numbers joined by dots, each 255 at most; a longer chain is read four numbers at a time."""
    out = []
    for m in DOTTED.finditer(text):
        chain = m.group()
        if chain.count(".") < 3:
            continue
        parts, begin = chain.split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((begin, begin + size))
            begin += size + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in NUMBERS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15] if "+" in text else []


FINDERS = (emails, addresses, cards, phones)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of kind, start, end) in code points, by kind, then start."""
    return [(kind, a, b) for kind, find in enumerate(FINDERS) for a, b in find(text)]


def entity(text: str, kind: int, start: int, end: int) -> str:
    value = text[start:end]
    return f"{KINDS[kind]}:{value.translate(LOWER) if kind < 2 else NOT_DIGIT.sub('', value)}"


def joined(spans: list[tuple[int, int, int]], names: tuple[str, ...] = (*KINDS, "term")) -> str:
    return ",".join(f"{names[k]}:{a}:{b}" for k, a, b in spans)


def _bare_words(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Words that no base span touches."""
    edges = sorted((a, b) for _, a, b in spans)
    merged: list[list[int]] = []
    for a, b in edges:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [m[0] for m in merged]
    out = []
    for m in TERM.finditer(text):
        i = bisect_left(starts, m.end()) - 1  # the last span that begins before the word ends
        if i < 0 or merged[i][1] <= m.start():
            out.append(m.span())
    return out


def contexts(text: str, spans: list[tuple[int, int, int]], reach: int) -> dict[str, list[str]]:
    """For each entity the words within reach of one of its mentions, in order, each place once."""
    words = _bare_words(text, spans)
    starts = [a for a, _ in words]
    near: dict[str, set[int]] = {}
    for kind, a, b in spans:
        i, j = bisect_left(starts, a), bisect_left(starts, b)
        near.setdefault(entity(text, kind, a, b), set()).update(range(max(0, i - reach), min(len(words), j + reach)))
    return {e: [text[slice(*words[i])].translate(LOWER) for i in sorted(at)] for e, at in near.items()}


def _lists(column: pa.Array) -> list[list[tuple[int, int, int]]]:
    return [[tuple(x[i : i + 3]) for i in range(0, len(x), 3)] for x in column.to_pylist()]


def find(docs: DataFrame) -> DataFrame:
    """row, doc_id, text, n_words, spans (kind, start, end one after another): every row of docs with its base spans."""
    ready(docs.sparkSession)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = [np.zeros(0, np.int64)]
            for _, _, buf, off in kernel.slices(batch.column(2)):
                n_words.append(np.diff(kernel.find_words(kernel.LOWER[buf], off, kernel.NOT_ALNUM)[2]))
            spans = [[x for s in base_spans(text) for x in s] if text else [] for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.concatenate(n_words)), pa.array(spans, pa.list_(pa.int32()))], schema=schema)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return materialise(rows.mapInArrow(run, "row long, doc_id long, text string, n_words long, spans array<int>"), "pii-spans")


def _contexts(found: DataFrame, reach: int) -> DataFrame:
    """row, entity, mark (digest of the context), words: one row per document and entity."""
    schema = pa.schema([("row", pa.int64()), ("entity", pa.string()), ("mark", pa.string()), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = batch.column(0).to_pylist(), []
            for row, text, spans in zip(rows, batch.column(1).to_pylist(), _lists(batch.column(2))):
                for name, words in contexts(text, spans, reach).items():
                    out.append({"row": row, "entity": name, "mark": hashlib.md5(" ".join(words).encode()).hexdigest(), "words": words})
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return found.filter("size(spans) > 0").select("row", "text", "spans").mapInArrow(run, "row long, entity string, mark string, words array<string>")


def _term_counts(found: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: how often each of terms stands in the corpus outside of base spans.

    Words are looked up in a bitmap of the terms' hashes, of a size bounded whatever their number; those that pass are counted exactly by their text.
    """
    spark = found.sparkSession

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = kernel.Hasher(SEED)
        for batch in batches:
            buf, off = kernel.string_buffer(batch.column(0))
            at = np.unique(hasher.words(buf, off[:-1], off[1:]) >> kernel.U64(64 - bits))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64) + 1)], ["at"])  # Spark's buckets begin at 1

    bits = min(SIEVE_BITS, max(15, (16 * terms.count()).bit_length()))
    marks = terms.select("term").mapInArrow(places, "at long")
    marks = marks.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("marks")).collect()  # 2**bits bits at most
    bitmap = np.zeros((1 << bits) + (1 << 15), bool)
    for bucket, packed in marks:
        first = (bucket - 1) * 32768
        bitmap[first : first + 32768] = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")[: len(bitmap) - first]
    given = spark.sparkContext.broadcast(np.packbits(bitmap))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sieve = kernel.Hasher(SEED), np.unpackbits(given.value).astype(bool)
        held: Counter = Counter()
        for batch in batches:
            bare = [" ".join(text[a:b] for a, b in _bare_words(text, spans)) if spans else text for text, spans in zip(batch.column(0).to_pylist(), _lists(batch.column(1)))]
            for _, _, buf, off in kernel.slices(pa.array(bare, pa.string())):
                low = kernel.LOWER[buf]
                start, end, _ = kernel.find_words(low, off, kernel.NOT_ALNUM)
                hashes = hasher.words(low, start, end)
                some = np.flatnonzero(sieve[hashes >> kernel.U64(64 - bits)])
                first, place = kernel.exact_groups(hashes[some], low, start[some], (end - start)[some])
                for i, n in zip(some[first].tolist(), np.bincount(place, minlength=len(first)).tolist()):
                    held[low[start[i] : end[i]].tobytes().decode()] += n
            if len(held) > 1 << 17:
                yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], ["term", "n"])
                held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["term", "n"])

    counted = found.select("text", "spans").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return counted.join(terms, "term", "left_semi")


def disclosing(found: DataFrame, context: DataFrame, *, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame | None:
    """entity, term, share: the pairs by which at least the given share of an entity is disclosed; None if no entity has enough contexts."""
    total = found.agg(F.sum("n_words").alias("n")).first()["n"] or 0
    sizes = context.groupBy("entity", "mark").agg(F.sum(F.size("words")).alias("c")).groupBy("entity").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("marks"))
    sizes = materialise(sizes.filter(F.col("marks") >= support).select("entity", "c"), "pii-entities")
    each = context.join(sizes.select("entity"), "entity", "left_semi").select("entity", "mark", F.explode("words").alias("term"))
    pairs = each.groupBy("entity", "term", "mark").agg(F.count(F.lit(1)).alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("marks"))
    pairs = materialise(pairs.filter(F.col("marks") >= support).join(sizes, "entity"), "pii-pairs")
    if pairs.isEmpty():
        return None
    # A word may stand beside an entity in no more places than it has, so only its count decides what is rare.
    counts = materialise(_term_counts(found, materialise(pairs.select("term").distinct(), "pii-terms")), "pii-counts")
    chance = F.col("c") / F.lit(float(total))
    share = F.log2((F.col("both") / F.col("n")) / chance) / -F.log2(chance)
    return pairs.join(counts, "term").withColumn("share", share).filter(F.col("share") >= least).select("entity", "term", "share")


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_term long, base_sha256 string, spans string, text string"


def _general(word: str) -> str:
    return "[NUMBER]" if word[0].isdigit() else "[NAME]" if word[0].isupper() else "[WORD]"


def _sanitised(text: str, spans: list[tuple[int, int, int]], shares: list[float], remove: float) -> str:
    """Base spans by their kind, terms by a general word or by nothing; of overlapping spans the first goes, and what the others add to it."""
    out, at = [], 0
    for (kind, a, b), share in sorted(zip(spans, shares), key=lambda x: (x[0][1], x[0][2])):
        if b <= at:
            continue
        out.append(text[at:a])
        if a >= at:
            out.append(f"[{KINDS[kind].upper()}]" if kind < len(KINDS) else _general(text[a:b]) if share < remove else "")
        at = b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, *, reach: int = REACH, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans, text: one row per row of docs, text being the sanitised text."""
    found = find(docs)
    context = materialise(_contexts(found, reach), "pii-contexts")
    pairs = disclosing(found, context, support=support, least=generalise)
    names = [x.split()[0] for x in FOUND.split(", ")]
    arrow = pa.schema([(n, pa.string() if n in names[-3:] else pa.int64()) for n in names])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            told = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * len(batch)
            for doc_id, text, base, terms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _lists(batch.column(2)), told):
                spans, shares = list(base), [1.0] * len(base)
                if terms:
                    share_of = {t["term"]: t["share"] for t in terms}
                    for a, b in _bare_words(text, base):
                        share = share_of.get(text[a:b].translate(LOWER))
                        if share is not None:
                            spans.append((len(KINDS), a, b))
                            shares.append(share)
                count = Counter(k for k, _, _ in spans)
                row = [doc_id, *[count[k] for k in range(5)], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), _sanitised(text, spans, shares, remove)]
                for column, x in zip(columns, row):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    plain = found.select("row", "doc_id", "text", "spans")
    if pairs is None:
        return plain.drop("row").mapInArrow(finish, FOUND)
    # What a document's own entities are revealed by, of the words that stand beside them there.
    own = context.select("row", "entity", F.explode(F.array_distinct("words")).alias("term")).join(pairs, ["entity", "term"])
    own = own.groupBy("row", "term").agg(F.max("share").alias("share")).groupBy("row").agg(F.collect_list(F.struct("term", "share")).alias("terms"))
    return with_few(plain, "row", materialise(own, "pii-own")).select("doc_id", "text", "spans", "terms").mapInArrow(finish, FOUND)
