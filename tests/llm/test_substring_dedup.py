"""Suffix grouping against sorted suffixes; substring dedup against brute force."""

import random

import numpy as np
import pytest

from trueline.llm import substring_dedup
from trueline.llm.substring_dedup import dedupe_substrings
from trueline.llm.suffix_groups import suffix_arrays


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_suffix_arrays_of_many_texts(letters):
    rng = random.Random(letters)
    texts = [[rng.randint(1, letters) for _ in range(rng.randint(0, 60))] + [0] for _ in range(80)]
    ends = np.cumsum([len(t) for t in texts])
    order = suffix_arrays(np.array([x for t in texts for x in t]), ends)
    for text, end in zip(texts, ends):
        begin = end - len(text)
        assert list(order[begin:end] - begin) == sorted(range(len(text)), key=lambda k: text[k:])


def brute(rows, length):
    """Removed positions of every row, by a dictionary of all strings."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in raw:
        for p in range(len(b) - length + 1):
            if i is not None:
                w = b[p:p + length]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            k = least.get(b[p:p + length])
            if k is not None and (i is None or k < i):
                gone[p:p + length] = [True] * length
        turns = [p for p in range(len(b) + 1)
                 if (p > 0 and gone[p - 1]) != (p < len(b) and gone[p])]
        out.append((i, len(b), bytes(x for x, g in zip(b, gone) if not g),
                    [list(x) for x in zip(turns[::2], turns[1::2])]))
    return out


def run(spark, rows, length=50):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return [(r.doc_id, r.n_bytes, bytes(r.kept), [list(s) for s in r.spans])
            for r in dedupe_substrings(docs, length).collect()]


def key(row):
    return (row[0] is None, row[0] or 0, row[2], row[3])


@pytest.mark.parametrize("length", [8, 50])
def test_equals_brute_force(spark, length, monkeypatch):
    monkeypatch.setattr(substring_dedup, "ANCHOR", min(20, length))
    rng = random.Random(length)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [sentence(30) for _ in range(5)]
    rows = [(k, sentence(rng.randint(0, 60))) for k in range(60)]
    rows += [(100 + k, sentence(9) + shared[k % 5] + sentence(7)) for k in range(40)]
    rows += [(200 + k, shared[k % 5]) for k in range(30)]
    rows += [(5, shared[1] + shared[1])]
    rows += [(300, None), (301, ""), (302, "a" * 400), (303, "a" * 300), (304, "ab" * 200), (305, "x" + "ab" * 90)]
    rows += [(None, shared[0]), (None, shared[0]), (400, sentence(20)), (400, shared[2] + "!")]
    rows += [(500, shared[3][:length]), (501, "y" + shared[3][:length - 1]), (502, sentence(3000))]
    rows += [(503, rows[-1][1][2000:9000])]
    assert sorted(run(spark, rows, length), key=key) == sorted(brute(rows, length), key=key)


def test_a_label_over_many_tiles(spark, monkeypatch):
    """Hundreds of texts around one passage: its windows lie in many tiles."""
    monkeypatch.setattr(substring_dedup, "TILE", 256)
    monkeypatch.setattr(substring_dedup, "BATCH", 4096)
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(70))
    noise = lambda: "".join(rng.choice("ijklmnop ") for _ in range(rng.randint(0, 90)))
    rows = [(k, noise() + passage + noise()) for k in range(400)]
    assert sorted(run(spark, rows), key=key) == sorted(brute(rows, 50), key=key)


def test_clashing_names_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a" * 60, 3, b"x", 9), (2, "a" * 60, 4, b"y", 9)],
                                 "doc_id long, text string, unit int, payload binary, bucket int")
    got = {r.doc_id: bytes(r.kept) for r in dedupe_substrings(docs).collect()}
    assert got == {1: b"a" * 60, 2: b""}
    assert dedupe_substrings(docs.where("doc_id > 5")).collect() == []
