"""Words and their hashes against bytes.split, with odd bytes, long words and rows that are cut out of a column."""

import random

import numpy as np
import pyarrow as pa

from factloom.llm.words import LONG, Words, shingles


def test_words_equal_split():
    r = random.Random(1)
    alphabet = ["a", "B", "\x00", " ", "\t", "\n", "\x0b", "\x0c", "\r", "é", " ", " ", "中", "x" * 9, "y" * 17, "z" * (LONG + 3), "."]
    texts = [None, "", " ", "a", "a\x00", "a\x00\x00", "\x00"] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(400)]
    column = pa.array(["before", *texts, "behind"]).slice(1, len(texts))
    for lower in (False, True):
        w, seen = Words(column, lower=lower), {}
        for k, t in enumerate(texts):
            want = (t or "").encode()
            want = (want.lower() if lower else want).split()
            at = slice(w.first[k], w.first[k + 1])
            assert [bytes(w.data[a:b]) for a, b in zip(w.starts[at], w.ends[at])] == want
            for word, h in zip(want, w.row(k).tolist()):
                assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)
    empty = Words(pa.array([], pa.string()))
    assert not len(empty.hashes) and list(empty.first) == [0]


def test_stripped_words():
    w = Words(pa.array(['"Hello," (world)... -- !x! a-b', None, "***"]), lower=True, strip=True)
    assert [bytes(w.data[a:b]) for a, b in zip(w.starts, w.ends)] == [b"hello", b"world", b"--", b"x", b"a-b", b"***"] and list(w.first) == [0, 5, 5, 6]


def test_shingles_hang_on_the_order():
    h = np.arange(1, 9, dtype=np.uint64)
    assert len(shingles(h, 5)) == 4 and len(shingles(h[:4], 5)) == 0
    assert shingles(h[:5], 5)[0] != shingles(h[:5][::-1], 5)[0] != shingles(h[[1, 0, 2, 3, 4]], 5)[0]
