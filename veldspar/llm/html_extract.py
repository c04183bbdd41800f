"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks, the runs of text between tags that end a line, in page order, each
with the path of elements around it.  A block's features are its ancestors' tags and the words of their class, id and role, and
measures of its text: length, punctuation, share of links, digits, place on the page.  The field scores
each block's label (main text or not) and each pair of neighbouring labels, the latter by whether both stand in the
same element; weights are fitted by maximum likelihood on labelled pages (html_pages), and the Viterbi path decides.

The model is a table of a few hundred weights, trained on the driver from a fixed number of pages.
Every page is read whole, alone, in one pass whose time grows in proportion to the page, whatever stands in it; nothing is shuffled.

Cases: null and blank html give the empty text; unclosed and stray tags are mended as browsers do for paragraphs, lists and tables; a tag ends at the first > outside
quoted values, a quote that opens no value or is never closed is no quote, and a < with no > after it is text; a comment, script,
style, title, iframe or noscript without end runs to the page's end, any other unseen element without end is passed over as its start tag alone;
a self-closed svg or math is empty; character references are decoded; repeated rows are read each;
an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready
from .html_pages import labelled_pages

TRAINING_PAGES = 900
STEPS = 120
L2 = 2e-4

# HTML's elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template svg math iframe object noscript title canvas audio video".split())
#: Of these, what holds text only, which runs to the page's end if it has no end; and what is empty where it closes itself.
RAW_TEXT = frozenset("script style title iframe noscript".split())
FOREIGN = frozenset(["svg", "math"])
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag of the key ends an open element of the value, if none of the stops stands between.
_TEXT_BLOCKS = "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
CLOSES = {**{t: ("p",) for t in _TEXT_BLOCKS}, "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
STOPS = frozenset("html body table ul ol dl div section article aside main nav header footer form blockquote button td th".split())
INNER_STOPS = {"li": frozenset("ul ol menu".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset("table tr".split()), "th": frozenset("table tr".split()), "option": frozenset(["select"])}
#: Parts of class and id words that tell a part of a page however they are joined.
STEMS = "advert sponsor promo banner cookie consent notice comment respon repl discuss sidebar related recommend popular trending share social newsletter subscri login search menu navi breadcrumb header masthead footer copyright article content story entry post".split()

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: Inside a start tag: its end, or the quote that opens a value.
IN_TAG = re.compile(r">|=\s*[\"']")
#: A name and its value, each looked at once.
ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s]*+))?+")
#: The attributes that features are taken from.
READ = frozenset(["class", "id", "role", "hidden", "aria-hidden", "style", "data-y"])
#: Numeric references with more digits than any character's number has.
LONG_REFERENCE = re.compile(r"&#(?:([xX])([0-9a-fA-F]{8,})|([0-9]{8,}));?")
SPACES = re.compile(r"\s+")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Attributes longer than this are not remembered from page to page.
REMEMBERED = 512


class Element:
    """An open element, which knows the one around it."""

    __slots__ = ("around", "attributes", "tag")

    def __init__(self, around: Element | None, tag: str, attributes: str):
        self.around, self.tag, self.attributes = around, tag, attributes


@dataclass
class Block:
    text: str
    inner: Element | None  # the innermost element around it
    container: int  # number of the element that holds the block's own
    linked: int  # letters inside links

    @property
    def path(self) -> list[tuple[str, str]]:
        """Tag and attributes of the elements around it, from the outermost."""
        out, element = [], self.inner
        while element is not None:
            out.append((element.tag, element.attributes))
            element = element.around
        return out[::-1]


@lru_cache(maxsize=1 << 14)
def _remembered_features(tag: str, attributes: str) -> tuple[tuple[str, ...], str | None]:
    return _element_features(tag, attributes)


def element_features(tag: str, attributes: str) -> tuple[tuple[str, ...], str | None]:
    """Features that an element gives all blocks inside it, and its training label."""
    return (_remembered_features if len(attributes) <= REMEMBERED else _element_features)(tag, attributes)


def _element_features(tag: str, attributes: str) -> tuple[tuple[str, ...], str | None]:
    out, label = ["t:" + tag], None
    for name, value in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        name = name.lower()
        if name not in READ:
            continue
        value = value.strip("\"'")
        if name == "data-y":
            label = value
        elif name in ("hidden", "aria-hidden") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            out.append("hidden")
        elif name != "style":
            words = {w.lower() for w in NAME_WORD.findall(value)}
            out += ["c:" + w for w in sorted(words)]
            low = value.lower()
            out += ["s:" + s for s in STEMS if s in low]
    return tuple(out), label


def decoded(text: str) -> str:
    """text with its character references decoded, however many digits they have."""

    def short(m: re.Match) -> str:
        digits = (m[2] or m[3]).lstrip("0") or "0"
        return "\ufffd" if len(digits) > 7 else f"&#{m[1] or ''}{digits};"

    return unescape(LONG_REFERENCE.sub(short, text) if "&#" in text else text)


class Tags:
    """Tags of a page, each found in one step to the right: (start, end, closing, name, attributes), name None for what is no element.

    A start or end tag ends at the first > outside quoted values; a value is quoted if its quote follows = and is closed somewhere.  Should
    quoted values leave a tag without an end, quotes mean nothing from there on.  A < without any > after it is text.
    """

    def __init__(self, html: str):
        self.html = html
        self.last_end = html.rfind(">")
        self.last_quote = {q: html.rfind(q) for q in "\"'"}
        self.quotes = True

    def _end(self, at: int) -> int:
        """Place of the > that ends the tag whose name ends at `at`; there is a > from here on."""
        begin = at
        while self.quotes:
            m = IN_TAG.search(self.html, at)
            if m is None:
                self.quotes = False
                break
            at = m.end()
            if m[0] == ">":
                return m.start()
            quote = m[0][-1]
            if self.last_quote[quote] >= at:
                at = self.html.index(quote, at) + 1
        return self.html.index(">", begin)

    def next(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        html = self.html
        while True:
            start = html.find("<", at)
            if start < 0:
                return None
            if html.startswith("<!--", start):
                stop = html.find("-->", start + 4)
                return start, len(html) if stop < 0 else stop + 3, False, None, ""
            if start > self.last_end:
                at = html.find("<!--", start)  # nothing but a comment can begin any more
                if at < 0:
                    return None
                continue
            closing = html.startswith("/", start + 1)
            name = NAME.match(html, start + 1 + closing)
            if name is not None:
                end = self._end(name.end())
                return start, end + 1, closing, name[0].lower(), html[name.end() : end]
            if html[start + 1 : start + 2] in ("!", "?", "/"):
                return start, html.index(">", start) + 1, False, None, ""
            at = start + 1


def closes_itself(attributes: str) -> bool:
    """Whether the slash before a start tag's end is the tag's own and not the end of an unquoted value."""
    if not attributes.endswith("/"):
        return False
    before = attributes[:-1]
    word = before.rsplit(None, 1)[-1] if before and not before[-1].isspace() and before[-1] not in "\"'" else ""
    return "=" not in word and not before[: len(before) - len(word)].rstrip().endswith("=")


class Reader:
    """Leaf blocks of a page.  Every step takes time that does not depend on how many elements are open."""

    def __init__(self, html: str):
        self.html, self.out = html, []
        self.tags: list[str] = []
        self.elements: list[Element] = []
        self.numbers: list[int] = [0]
        self.places: dict[str, list[int]] = {}  # of open elements, by tag
        self.blocks: list[int] = []  # of open elements that end a line
        self.text: list[str] = []
        self.linked = self.number = 0

    def end_block(self) -> None:
        if self.text:
            joined = SPACES.sub(" ", decoded("".join(self.text))).strip()
            if joined:
                holder = self.blocks[-1] if self.blocks else -1
                self.out.append(Block(joined, self.elements[-1] if self.elements else None, self.numbers[holder] if holder >= 0 else 0, self.linked))
            self.text.clear()
        self.linked = 0

    def add(self, piece: str) -> None:
        if piece:
            self.text.append(piece)
            if self.places.get("a"):
                self.linked += len(piece)

    def open(self, tag: str, attributes: str) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag not in INLINE:
            self.blocks.append(len(self.tags))
        self.elements.append(Element(self.elements[-1] if self.elements else None, tag, attributes))
        self.tags.append(tag)
        self.number += 1
        self.numbers.append(self.number)

    def close(self, to: int) -> None:
        while len(self.tags) > to:
            tag = self.tags.pop()
            self.elements.pop()
            self.numbers.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def end_implied(self, tag: str) -> None:
        """Close what a start tag ends: the outermost element of its kinds inside the innermost stop."""
        stop = max((self.places[t][-1] for t in INNER_STOPS.get(tag, STOPS) if self.places.get(t)), default=-1)
        inside = [p[i] for t in CLOSES[tag] if (p := self.places.get(t)) and (i := bisect_right(p, stop)) < len(p)]
        if inside:
            self.close(min(inside))

    def read(self) -> list[Block]:
        html, found, n, at = self.html, Tags(self.html), len(self.html), 0
        endless: set[str] = set()
        while at < n:
            token = found.next(at)
            if token is None:
                self.add(html[at:])
                break
            start, end, closing, tag, attributes = token
            self.add(html[at:start])
            at = end
            if tag is None:
                continue
            if closing:
                if not self.places.get(tag):
                    if tag == "p" or tag not in INLINE:
                        self.end_block()
                    continue
                if tag not in INLINE:
                    self.end_block()
                self.close(self.places[tag][-1])
            elif tag in UNSEEN:
                if tag in endless or (tag in FOREIGN and closes_itself(attributes)):
                    continue
                stop = _END_TAG[tag].search(html, at)
                if stop is not None:
                    at = stop.end()
                elif tag in RAW_TEXT:
                    at = n
                else:
                    endless.add(tag)  # none of its further start tags has an end either
            elif tag in VOID:
                if tag == "br":
                    self.text.append(" ")
                elif tag == "hr":
                    self.end_block()
            else:
                if tag not in INLINE:
                    self.end_block()
                    if tag in CLOSES:
                        self.end_implied(tag)
                self.open(tag, attributes)
        self.end_block()
        return self.out


_END_TAG = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in UNSEEN}


def read_blocks(html: str) -> list[Block]:
    return Reader(html).read()


_SIZES = (1, 2, 4, 8, 16, 32, 64)


def text_features(block: Block, place: float) -> tuple[str, ...]:
    """Features of the block's own text and place."""
    text = block.text
    n = text.count(" ") + 1
    size = sum(n >= s for s in _SIZES)
    link = min(block.linked / len(text), 1.0)
    out = ["bias", f"n:{size}", f"link:{int(link * 3.99)}", f"at:{min(int(place * 5), 4)}"]
    out.append("stop" if text[-1] in ".!?…\"'”:" else "open")
    if "©" in text:
        out.append("copyright")
    if "|" in text or "·" in text or "»" in text:
        out.append("bar")
    if text.count(",") * 12 > n > 3:
        out.append("commas")
    parent = block.inner.tag if block.inner is not None else ""
    out.append(f"own:{parent}")
    out.append(f"own:{parent}:{'long' if n >= 10 else 'short'}")
    return tuple(out)


class Field:
    """Weights of features (main text against not) and of pairs of labels: [same element][before][after]."""

    def __init__(self, weights: dict[str, float], pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs
        self._elements: dict[tuple[str, str], float] = {}

    def _element(self, element: Element | None, known: dict[Element, float]) -> float:
        """Sum of the weights of an element and all around it; known are those of the page."""
        todo = []
        while element is not None and element not in known:
            todo.append(element)
            element = element.around
        total = known[element] if element is not None else 0.0
        for e in reversed(todo):
            key = (e.tag, e.attributes)
            s = self._elements.get(key)
            if s is None:
                s = sum(self.weights.get(f, 0.0) for f in element_features(*key)[0])
                if len(self._elements) < 1 << 16 and len(e.attributes) <= REMEMBERED:
                    self._elements[key] = s
            total += s
            known[e] = total
        return total

    def score(self, block: Block, place: float, known: dict[Element, float] | None = None) -> float:
        total = self._element(block.inner, {} if known is None else known)
        for f in text_features(block, place):
            total += self.weights.get(f, 0.0)
        return total

    def label(self, blocks: list[Block]) -> list[bool]:
        """The best labels of a page's blocks (Viterbi); on a tie, not main text."""
        if not blocks:
            return []
        pairs = self.pairs.tolist()
        known: dict[Element, float] = {}
        zero, one = 0.0, self.score(blocks[0], 0.0, known)
        back = []
        for i in range(1, len(blocks)):
            t = pairs[blocks[i].container == blocks[i - 1].container]
            s = self.score(blocks[i], i / len(blocks), known)
            a0, a1, b0, b1 = zero + t[0][0], one + t[1][0], zero + t[0][1], one + t[1][1]
            back.append((a1 > a0, b1 > b0))
            zero, one = max(a0, a1), max(b0, b1) + s
        y = one > zero
        out = [y]
        for step in reversed(back):
            y = step[y]
            out.append(y)
        return out[::-1]

    def extract(self, html: str | None) -> str:
        blocks = read_blocks(html) if html else []
        return "\n\n".join(b.text for b, y in zip(blocks, self.label(blocks)) if y)


def train(pages: list[str], *, steps: int = STEPS, l2: float = L2) -> Field:
    """Maximum likelihood by full-batch Adam; forward and backward sums run over all pages side by side."""
    sequences = [read_blocks(p) for p in pages]
    sequences = [s for s in sequences if s]
    names: dict[str, int] = {}
    width = max(map(len, sequences))
    shape = (len(sequences), width)
    gold, same, mask = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool)
    block_of, feature_of = [], []
    for p, blocks in enumerate(sequences):
        for i, b in enumerate(blocks):
            mask[p, i] = True
            same[p, i] = i > 0 and blocks[i - 1].container == b.container
            found = list(text_features(b, i / len(blocks)))
            for e in b.path:
                features, label = element_features(*e)
                found += features
                if label is not None:
                    gold[p, i] = 1
            block_of += [p * width + i] * len(found)
            feature_of += [names.setdefault(f, len(names)) for f in found]
    block_of, feature_of = np.array(block_of), np.array(feature_of)
    w, pairs = np.zeros(len(names)), np.zeros((2, 2, 2))
    m, v = np.zeros(len(w) + 8), np.zeros(len(w) + 8)
    rows = np.arange(len(sequences))
    for step in range(1, steps + 1):
        unary = np.bincount(block_of, w[feature_of], shape[0] * width).reshape(shape)
        potential = np.stack([np.zeros(shape), unary], axis=2)
        forward = np.zeros((*shape, 2))
        forward[:, 0] = potential[:, 0]
        for i in range(1, width):
            t = pairs[same[:, i]]
            nxt = np.logaddexp(forward[:, i - 1, 0, None] + t[:, 0], forward[:, i - 1, 1, None] + t[:, 1]) + potential[:, i]
            forward[:, i] = np.where(mask[:, i, None], nxt, forward[:, i - 1])
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        backward = np.zeros((*shape, 2))
        gradient = np.zeros((2, 2, 2))
        for i in range(width - 1, 0, -1):
            t = pairs[same[:, i]]
            inner = t + (potential[:, i] + backward[:, i])[:, None, :]
            here = mask[:, i]
            share = np.exp(forward[:, i - 1, :, None] + inner - total[:, None, None]) * here[:, None, None]
            truth = np.zeros_like(share)
            truth[rows, gold[:, i - 1], gold[:, i]] = here
            np.add.at(gradient, same[:, i], truth - share)
            backward[:, i - 1] = np.where(here[:, None], np.logaddexp(inner[:, :, 0], inner[:, :, 1]), backward[:, i])
        marginal = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])
        error = np.where(mask, gold - marginal, 0).ravel()
        g = np.concatenate([np.bincount(feature_of, error[block_of], len(w)), gradient.ravel()]) / len(sequences)
        g -= l2 * np.concatenate([w, pairs.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, pairs = w + move[: len(w)], pairs + move[len(w) :].reshape(2, 2, 2)
    return Field({f: float(w[k]) for f, k in names.items() if abs(w[k]) > 1e-6}, pairs)


@lru_cache(maxsize=1)
def trained(pages: int = TRAINING_PAGES) -> Field:
    return train(labelled_pages(pages))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages."""
    model = ready(pages.sparkSession).sparkContext.broadcast((trained().weights, trained().pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*model.value)
        for batch in batches:
            html = batch.column(2)
            texts = [field.extract(html[i].as_py()) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
