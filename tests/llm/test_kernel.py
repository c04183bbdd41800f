import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from veldspar.llm import kernel, pieces

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b\x1fñ0.", max_size=30)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_words_match_the_pattern(texts):
    buf, off = kernel.string_buffer(pa.array(texts, pa.string()))
    start, end, woff = kernel.find_words(buf, off, kernel.SPACE)
    for i, text in enumerate(texts):
        got = [buf[a:b].tobytes().decode() for a, b in zip(start[woff[i] : woff[i + 1]], end[woff[i] : woff[i + 1]])]
        assert got == re.findall(r"[^\x20\x09-\x0D]+", text or "")


@settings(max_examples=100, deadline=None)
@given(TEXT, st.integers(1, 4))
def test_equal_grams_have_equal_hashes_and_others_differ(texts, k):
    hasher = kernel.Hasher(1)
    seen: dict = {}
    for _, _, buf, off in kernel.slices(pa.array(texts, pa.string()), 8):
        start, end, woff = kernel.find_words(buf, off, kernel.SPACE)
        hashes = hasher.words(buf, start, end)
        at, _ = kernel.gram_starts(woff, k)
        for i, h in zip(at, hasher.grams(hashes, at, k).tolist()):
            gram = tuple(buf[a:b].tobytes() for a, b in zip(start[i : i + k], end[i : i + k]))
            assert seen.setdefault(gram, h) == h
    assert len(set(seen.values())) == len(seen)


def doubled(n, a="a", b="b"):
    """A word of n letters in which every half is the other with a and b exchanged; sums of powers of any base cannot tell it from its complement."""
    out, other = a, str.maketrans({a: b, b: a})
    while len(out) < n:
        out += out.translate(other)
    return out


def test_doubled_words_and_words_of_zero_bytes_differ():
    words = [doubled(n, *ab) for n in (8, 64, 1024, 4096, 65536) for ab in ("ab", "ba")] + ["a\0", "a\0\0", "a", "a" * 8, "a" * 8 + "\0"]
    for seed in range(5):
        for _, _, buf, off in kernel.slices(pa.array(words), 1 << 20):
            start, end, _ = kernel.find_words(buf, off, kernel.SPACE)
            assert len(set(kernel.Hasher(seed).words(buf, start, end).tolist())) == len(words)


def test_groups_of_one_hash_are_told_apart_by_bytes():
    words = ["x", "yy", "x", "yy", "z" * 100, "z" * 99 + "y", "z" * 100, "q", "x"]
    buf, off = kernel.string_buffer(pa.array(words))
    size = np.diff(off)
    for hashes in ([5, 5, 5, 5, 5, 5, 5, 5, 5], [2, 2, 2, 2, 1, 1, 1, 1, 2], [4, 3, 4, 3, 2, 1, 2, 0, 4]):
        hashes = np.array(hashes, np.uint64)
        first, place = kernel.exact_groups(hashes, buf, off[:-1], size)
        assert [words[i] for i in first[place]] == words and len(first) == len(set(words))
        assert (np.diff(hashes[first].astype(np.int64)) >= 0).all()


def test_slices_of_a_sliced_column_and_long_documents():
    column = pa.array(["x" * 10, None, "y" * 5000, "", "z"], pa.string()).slice(1)
    parts = list(kernel.slices(column, 100))
    assert [(i, j) for i, j, _, _ in parts][-1][1] == 4
    assert b"".join(b.tobytes() for _, _, b, _ in parts) == b"y" * 5000 + b"z"


def test_packing_round_trip():
    arrays = [np.arange(300, dtype=np.uint32), np.zeros(0, np.uint64), np.array([-1, 2**40]), np.array([1.5], np.float32)]
    for a, b in zip(arrays, pieces.unpack(pieces.pack(*arrays))):
        assert a.dtype == b.dtype and (a == b).all()


def test_cover():
    assert kernel.cover(6, np.array([1, 2, 2]), np.array([2, 1, 2])).tolist() == [False, True, True, True, False, False]
