"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text is built.  A document is parsed
against each: a phrase is the longest match that occurs in the sample, the next phrase starts where it ends,
and the language whose parse needs the fewest bits, phrases * log2(sample length) / length, wins.

Text is read as bytes of UTF-8: a-z after lower-casing A-Z and all bytes from 128 up stand for
themselves, any run of other bytes is one gap.  A byte that the sample does not have is a phrase of its own.  Automata are tables whose entry holds the next
state and whether a phrase starts, so many pieces of text step through them side by side; only states with several ways on have a row of their own,
the others, most of them, are one number.

Texts are parsed whole.  A text of more than PIECE bytes is read by several lanes at once, each from its piece's border.  Then the parse that comes out of each piece, in
the middle of a phrase, is followed into the next one until it starts a phrase where that piece's own parse does, from where on the two are the same; a piece in which they
never meet goes to the parse that came in, and if it leaves in another state than before its successor is looked at again, until nothing changes.  So the phrases
are those of one parse from the text's first byte.

The sample is a documented bound, the parameters sample_docs and doc_bytes: that many training documents a language, or all if there
are fewer, by hash of the id, of at most so many bytes each as long as there are enough of them.  Every drawn document is learnt whole.  So a language's sample has sample_docs * doc_bytes bytes at most, 1 MB, or is
one document; the automata, at most two states a byte drawn, are built one after another on the driver and are what is broadcast.

Cases: null texts and texts without a letter are `und` with score 0, as is everything if no language can be learnt;
equal lengths of parse go to the first language by code point; a null id hashes as the empty text; repeated rows are predicted each; an
empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .common import ready, split_of

SAMPLE_DOCS = 64
#: Bytes of a text that the sample takes before longer ones.
DOC_BYTES = 16 << 10
#: Bytes that one lane reads; of a text that is read at one time.
PIECE = 2048
SLICE = 4 << 20
FOLDS, HELD_OUT = 4, 2
#: Bits a byte by which a language must be better for its share of the score to be e times another's.
SHARPNESS = 8.0
UND = "und"
#: In the low bits of a state's number: it has no single way on, but a row of the table.
BITS = 9
SEVERAL = (1 << BITS) - 1
_OWN = np.zeros(256, bool)
_OWN[0x61:0x7B] = True
_OWN[0x80:] = True


def simplify(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with each run of bytes that are no letters as one space, and their offsets."""
    low = kernel.LOWER[buf]
    own = _OWN[low]
    keep = own.copy()
    keep[1:] |= own[:-1]
    if len(off) == 2:  # one text, perhaps a very long one
        at = np.array([0, np.count_nonzero(keep)])
    else:
        at = np.concatenate([[0], np.cumsum(keep)])[off]
    low[~own] = 0x20
    return low[keep], at


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the start.  Every path spells a substring of text."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = clone
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
        last = cur
    return nxt


class Parsers:
    """Automata of all languages over the bytes seen in any sample.

    A state with one way on is the number of the state there and its byte's place; any other is the number of its row in the table.
    """

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        seen = sorted(set(b"".join(samples.values())))
        self.place = np.full(256, len(seen), np.int16)  # the last place: bytes in no sample
        self.place[seen] = np.arange(len(seen))
        self.width = len(seen) + 1
        place = self.place.tolist()
        rows, numbers, self.start, self.miss, self.bits = [], [], [], [], []
        base = first = 0
        for lang in self.langs:
            states = suffix_automaton(samples[lang])
            many = [s for s, out in enumerate(states) if len(out) > 1 or s == 0]
            # Where no way goes on a phrase ends, and its successor starts with the byte at hand; a byte that is in no sample leads back to the start.
            ended = np.ones(self.width, np.int64)
            for c, to in states[0].items():
                ended[place[c]] = to * 2 + 1
            own = np.repeat(ended[None, :], len(many) + 1, axis=0)  # row 0: of states that cannot go on
            number = np.fromiter(((base + next(iter(out.values()))) << BITS | place[next(iter(out))] if len(out) == 1 else first << BITS | SEVERAL for out in states), np.int64, len(states))
            for r, s in enumerate(many, 1):
                number[s] = (first + r) << BITS | SEVERAL
                for c, to in states[s].items() if s else ():  # every byte read in the start begins a phrase
                    own[r, place[c]] = to * 2
            rows.append((own + 2 * base).astype(np.int32))
            numbers.append(number)
            self.start.append(base)
            self.miss.append(first)
            self.bits.append(np.log2(max(len(samples[lang]), 2)))
            base += len(states)
            first += len(own)
        self.table = np.concatenate(rows).ravel() if rows else np.zeros(0, np.int32)
        self.number = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        self.misses = np.array(self.miss, np.int64)

    def _step(self, lang: np.ndarray, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Twice the next state of each lane, plus one if a phrase starts with this byte."""
        number = self.number[state]
        single, to = number & SEVERAL, number >> BITS
        row = np.where(single == SEVERAL, to, self.misses[lang])
        return np.where(single == byte, to * 2, self.table[row * self.width + byte])

    def _count(self, place: np.ndarray, off: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that start in each text, by language, parsed on from the states `enter` (languages x texts), and the states at their ends."""
        docs, n = len(off) - 1, len(self.langs)
        per = -(-np.diff(off) // PIECE)
        doc = np.repeat(np.arange(docs), per)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        first = off[:-1][doc] + nth * PIECE
        last = np.minimum(first + PIECE, off[1:][doc])
        if not len(doc):
            return np.zeros((docs, n), np.int64), enter
        marks = np.zeros((len(place), n), bool)
        # All pieces side by side, longest first.
        order = np.argsort(first - last, kind="stable")
        size, at = (last - first)[order], first[order]
        came = np.where(nth == 0, enter[:, doc], np.array(self.start, np.int64)[:, None])
        state = came[:, order]
        langs = np.arange(n)[:, None]
        live = np.searchsorted(-size, -np.arange(size[0]), side="left")
        for t, k in enumerate(live):
            where = at[:k] + t
            step = self._step(langs, state[:, :k], place[where])
            marks[where] = (step & 1).T
            state[:, :k] = step >> 1
        left = np.empty_like(state)
        left[:, order] = state
        came, left = came.ravel(), left.ravel()  # lanes of all languages, one after another
        lang, begin, stop = np.repeat(np.arange(n), len(doc)), np.tile(first, n), np.tile(last, n)
        inner = np.flatnonzero(np.tile(nth, n) > 0)
        while True:
            change = inner[left[inner - 1] != came[inner]]
            if not len(change):
                break
            came[change] = left[change - 1]
            state, here = came[change], begin[change]
            lane = np.arange(len(change))
            while len(lane):
                of = lang[change[lane]]
                step = self._step(of, state[lane], place[here[lane]])
                starts = (step & 1).astype(bool)
                own = marks[here[lane], of]
                marks[here[lane], of] = starts
                meets = starts & own
                state[lane] = step >> 1
                here[lane] += 1
                through = ~meets & (here[lane] >= stop[change[lane]])
                left[change[lane[through]]] = state[lane[through]]
                lane = lane[~meets & ~through]
        some = np.flatnonzero(np.diff(off))
        count = np.zeros((docs, n), np.int64)
        count[some] = np.add.reduceat(marks, off[:-1][some], axis=0, dtype=np.int64)
        end = np.array(enter)
        tail = np.flatnonzero(np.append(doc[1:] != doc[:-1], True))
        end[:, doc[tail]] = left.reshape(n, -1)[:, tail]
        return count, end

    def phrases(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Phrases of each document in each language."""
        docs, n = len(off) - 1, len(self.langs)
        if not n or not docs:
            return np.zeros((docs, n), np.int64)
        state = np.repeat(np.array(self.start, np.int64)[:, None], docs, axis=1)
        if docs > 1 or off[-1] <= SLICE:
            return self._count(self.place[buf], off, state)[0]
        total = np.zeros((1, n), np.int64)
        for at in range(0, int(off[1]), SLICE):  # a very long text, slice by slice, in the state that the slice before left
            part = self.place[buf[at : at + SLICE]]
            count, state = self._count(part, np.array([0, len(part)]), state)
            total += count
        return total

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place of the best language and its share of the score, per row."""
        best, share = [np.zeros(0, np.int64)], [np.zeros(0)]
        for i, j, buf, off in kernel.slices(column, SLICE):
            buf, off = simplify(buf, off)
            bits = self.phrases(buf, off) * np.array(self.bits) / np.maximum(np.diff(off), 1)[:, None]
            worse = np.exp(-SHARPNESS * (bits - bits.min(axis=1, keepdims=True)))
            best.append(bits.argmin(axis=1))
            share.append(1 / worse.sum(axis=1))
        return np.concatenate(best), np.concatenate(share)


def draw(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, doc_bytes: int = DOC_BYTES) -> DataFrame:
    """lang, text, place: sample_docs rows a language with text and lang outside the held-out fold, by hash of the id.

    Texts of more than doc_bytes are drawn only where shorter ones do not fill the sample, the shortest first, while all together have no more bytes than a full sample of
    short ones; a language of long texts alone is learnt from one of them at least.
    """
    known = docs.filter("text IS NOT NULL AND lang IS NOT NULL").filter(split_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    size = F.octet_length(F.col("text").cast("string"))
    known = known.select("lang", "text", "doc_id", size.cast("long").alias("bytes"), (size > doc_bytes).alias("long"))
    counts = {r["lang"]: r["n"] for r in known.filter("NOT long").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(1.0)
    for lang, n in sorted(counts.items()):
        # More than are wanted, so that enough hash below; the smallest of them are kept.
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, (2 * sample_docs + 32) / n))).otherwise(share)
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = known.withColumn("key", key).filter((F.col("key") < share) & ~F.col("long"))
    few = [lang for lang, n in counts.items() if n < sample_docs]
    wanting = known.filter("long").filter(F.col("lang").isin(few) | ~F.col("lang").isin(list(counts))).withColumn("key", F.col("bytes").cast("double"))
    # The first of each task go on, so no task sees all long texts.
    order = Window.partitionBy("lang").orderBy("long", "key", "doc_id", "text")
    placed = rows.unionByName(wanting).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= sample_docs)
    placed = placed.withColumn("upto", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return placed.filter((F.col("upto") <= sample_docs * doc_bytes) | (F.col("place") == 1)).select("lang", "text", "place")


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Parsers:
    """Parsers of the drawn rows' whole texts."""
    samples: dict[str, bytes] = {}
    for lang, own in draw(docs, sample_docs).toPandas().sort_values(["lang", "place"]).groupby("lang"):
        raw = np.frombuffer("\n".join(own["text"]).encode(), np.uint8)
        samples[lang] = simplify(raw, np.array([0, len(raw)]))[0].tobytes()
    return Parsers({k: v for k, v in samples.items() if v.strip()})


def identify(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of docs."""
    model = ready(docs.sparkSession).sparkContext.broadcast(learn(docs, sample_docs))
    rows = docs.select(
        "doc_id",
        (split_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
        F.col("text").cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsers = model.value
        names = np.array([*parsers.langs, UND], dtype=object)
        for batch in batches:
            lettered = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if parsers.langs:
                best, share = parsers.predict(batch.column(3))
            else:
                best, share, lettered = np.zeros(len(lettered), np.int64), np.zeros(len(lettered)), np.zeros_like(lettered)
            best, share = np.where(lettered, best, len(names) - 1), np.where(lettered, share, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[best], pa.string()), pa.array(share)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
