"""Lexical search against a plain scorer of all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from trueline.llm import lexical_search
from trueline.llm.lexical_search import masks, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=10):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    for item, terms in wanted.items():
        scored = []
        for i, b in bags:
            m = 10 + (90 * sum(b.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in terms if t in b)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return out


def run(spark, docs, items, k=10):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    return [tuple(r) for r in search(d, q, k).collect()]


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("block,stride,terms", [(8192, 64, 1_000_000), (7, 1, 30)])
def test_equals_brute_force(spark, monkeypatch, block, stride, terms):
    for name, value in (("BLOCK", block), ("STRIDE", stride), ("ITEM_TERMS", terms)):
        monkeypatch.setattr(lexical_search, name, value)
    rng = random.Random(block)
    words = [f"w{k}" for k in range(90)] + ["é", "Über", "naïve", "x1"]
    text = lambda n: rng.choice([" ", ", ", "\n", "-"]).join(rng.choice(words) for _ in range(n))
    docs = [(k, text(rng.randint(0, 80))) for k in range(150)]
    docs += [(200 + k, docs[3][1]) for k in range(25)] + [(7, text(30)), (None, text(9)), (None, docs[3][1])]
    docs += [(300, None), (301, ""), (302, " .,\x7f_"), (303, "W1 w1 W1 Ünder"), (304, text(3000))]
    items = [(k, text(rng.randint(1, 75))) for k in range(12)]
    items += [(50, docs[3][1]), (51, None), (52, ""), (53, "absent words only"), (None, text(9)), (1, text(4))]
    assert sorted(run(spark, docs, items), key=key) == sorted(brute(docs, items), key=key)


def test_masks_group_equal_columns():
    rng = np.random.default_rng(1)
    for n_terms in (1, 8, 64, 65, 200):
        present = rng.random((n_terms, 6))[:, rng.integers(0, 6, 300)] < 0.5
        kinds, group = masks(present)
        assert (kinds[:, group] == present).all()
        assert len({c.tobytes() for c in kinds.T}) == kinds.shape[1]


def test_empty_tables_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "some words", 5, 6, "x")], "doc_id long, text string, item_id long, rank int, terms string")
    items = spark.createDataFrame([(9, "words", 1, 2)], "item_id long, text string, doc_id long, score int")
    assert [(r.item_id, r.doc_id, r["rank"]) for r in search(docs, items).collect()] == [(9, 1, 1)]
    assert search(docs.where("doc_id > 3"), items).collect() == []
    assert search(docs, items.where("item_id > 10")).collect() == []
