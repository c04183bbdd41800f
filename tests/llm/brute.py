"""Plain versions of the operators, one document after another."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def substring(rows, k=20):
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = SPACED.findall(text or "")
        gone = [False] * len(words)
        for s in range(len(words) - k + 1):
            gram = tuple(words[s : s + k])
            if gram in seen:
                gone[s : s + k] = [True] * k
            seen.add(gram)
        out[i] = (len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone) if not g)))
    return out


def near(rows, k, percent):
    sets = {}
    for i, text in rows:
        words = SPACED.findall((text or "").translate(LOWER))
        sets[i] = frozenset(tuple(words[j : j + k]) for j in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])
    group = {i: i for i in sets}
    changed = True
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            low = min(group[a], group[b])
            changed |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    return {i: (len(s), group[i], group[i] == i) for i, s in sets.items()}


def contamination(rows, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        n = min(13, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i : i + n])].add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for i, text in rows:
        words = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for j in range(len(words) - n + 1):
                w = tuple(words[j : j + n])
                if w in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[w]
        out[i] = (len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(words))
    return out


def base_scores(rows):
    tokens, counts = {}, collections.Counter()
    for i, text in rows:
        tokens[i] = [*SPACED.findall((text or "").translate(LOWER)), None]
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(tokens[i])
    n, v = sum(counts.values()), len(counts)
    return {i: (len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)) for i, t in tokens.items()}


def page_tokens(html):
    """(text) and (closing, name, attributes) of a page, one character after another."""
    quotes, i, text, out = True, 0, "", []

    def end_of_tag(j, quotes):
        while j < len(html):
            if html[j] == ">":
                return j
            if quotes and html[j] == "=":
                k = j + 1
                while k < len(html) and html[k].isspace():
                    k += 1
                if k < len(html) and html[k] in "\"'" and html[k] in html[k + 1 :]:
                    j = html.index(html[k], k + 1)
            j += 1
        return -1

    while i < len(html):
        if html[i] == "<":
            j = i + 1
            if html[j : j + 3] == "!--":
                end = html.find("-->", j + 3)
                out += [text]
                text, i = "", len(html) if end < 0 else end + 3
                continue
            closing = html[j : j + 1] == "/"
            k = j + closing
            if ">" in html[i:] and html[k : k + 1].isascii() and html[k : k + 1].isalpha():
                name = ""
                while html[k] not in "/>" and not html[k].isspace():
                    name, k = name + html[k], k + 1
                end = end_of_tag(k, quotes)
                if end < 0:
                    quotes = False
                    end = end_of_tag(k, False)
                out += [text, (closing, name.lower(), html[k:end])]
                text, i = "", end + 1
                raw = name.lower()
                if not closing and raw in UNSEEN:
                    m = re.compile(rf"</{raw}\s*>", re.I).search(html, i)
                    if raw in ("svg", "math") and re.search(r"(?<!=)\s/$|^/$|[\"']\s*/$|(?:^|\s)[^\s=\"']+/$", out[-1][2]) and not re.search(r"=\s*[^\s\"']*/$", out[-1][2]):
                        pass
                    elif m:
                        i = m.end()
                    elif raw in ("script", "style", "title", "iframe", "noscript"):
                        i = len(html)
                    out.pop()
                continue
            if html[j : j + 1] in ("!", "?", "/") and html[j : j + 1] and ">" in html[i:]:
                out += [text]
                text, i = "", html.index(">", i) + 1
                continue
        text, i = text + html[i], i + 1
    return [*out, text]


# How HTML reads these elements.
UNSEEN = set("script style template svg math iframe object noscript title canvas audio video".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
ANY_STOP = set("html body table ul ol dl div section article aside main nav header footer form blockquote button td th".split())


def page_blocks(html):
    """(text, [(tag, attributes)], linked letters, number of the element around its own) of each block, over a plain list of open elements."""
    import html as entities

    out, opened, numbers, text, linked, number = [], [], [], "", 0, 0

    def end():
        nonlocal text, linked
        clean = " ".join(re.sub(r"\s+", " ", entities.unescape(text)).split(" ")).strip()
        if clean:
            own = max((i for i, (t, _) in enumerate(opened) if t not in INLINE), default=0)
            out.append((clean, list(opened), linked, numbers[own - 1] if own else 0))
        text, linked = "", 0

    for token in page_tokens(html):
        if isinstance(token, str):
            text += token
            linked += len(token) * any(t == "a" for t, _ in opened)
            continue
        closing, tag, attributes = token
        if closing:
            if tag not in INLINE:
                end()
            names = [t for t, _ in opened]
            if tag in names:
                cut = len(names) - 1 - names[::-1].index(tag)
                del opened[cut:], numbers[cut:]
        elif tag in VOID:
            if tag == "br":
                text += " "
            elif tag == "hr":
                end()
        else:
            if tag not in INLINE:
                end()
                ends = ENDS.get(tag, {"p"} if tag in ENDS_P else set())
                cut = len(opened)
                for i in range(len(opened) - 1, -1, -1):
                    if opened[i][0] in ends:
                        cut = i
                    elif opened[i][0] in WITHIN.get(tag, ANY_STOP):
                        break
                del opened[cut:], numbers[cut:]
            number += 1
            opened.append((tag, attributes))
            numbers.append(number)
    end()
    return out


def main_text(html, model, module):
    """The main text by the best of all label sequences, kept as the best sequence for each last label."""
    blocks = []
    for text, path, linked, holder in page_blocks(html or ""):
        inner = None
        for tag, attributes in path:
            inner = module.Element(inner, tag, attributes)
        blocks.append(module.Block(text, inner, holder, linked))
    best = None
    for i, block in enumerate(blocks):
        own = [f for e in block.path for f in module.element_features(*e)[0]] + list(module.text_features(block, i / len(blocks)))
        score = sum(model.weights.get(f, 0.0) for f in own)
        if best is None:
            best = [(0.0, [False]), (score, [True])]
            continue
        t = model.pairs[int(block.container == blocks[i - 1].container)]
        ways = [[(best[x][0] + t[x][y], -x, best[x][1]) for x in (0, 1)] for y in (0, 1)]
        best = [(max(w)[0] + (score if y else 0.0), [*max(w)[2], bool(y)]) for y, w in enumerate(ways)]
    labels = [] if best is None else best[1][1] if best[1][0] > best[0][0] else best[0][1]
    return "\n\n".join(b.text for b, y in zip(blocks, labels) if y)
