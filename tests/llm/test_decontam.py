import numpy as np
import pytest

from brute import contained, edge_docs, edge_rows, shingles
from trueline.llm import decontam


def pairs(df):
    return sorted(((r.doc_id, r.item_id) for r in df.collect()), key=str)


def case(seed):
    rng = np.random.default_rng(seed)
    vocab = [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(rng.choice(vocab, n))
    items = [(k, text(rng.integers(6, 60))) for k in range(25)] + [(90, "three word item"), (91, None), (92, "?!"),
                                                                  (93, "w1"), (None, text(20)), (0, text(12))]
    docs = []
    for k in range(60):
        base = items[rng.integers(0, 25)][1].split()
        for _ in range(rng.integers(0, 4)):
            base[rng.integers(0, len(base))] = "changed"
        docs.append((k, f"{text(rng.integers(0, 400))}, {' '.join(base).upper()}! {text(rng.integers(0, 50))}"))
    return docs + [(100, "Three word ITEM."), (101, "three word item and more"), (102, None), (103, "")], items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [32_000_000, 400])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", block)
    docs, items = case(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(contained(docs, items), key=str)
    assert len(want) > 20
    assert pairs(decontam.contained_items(d, i)) == want
    hit = {a for a, _ in want}
    kept = decontam.decontaminate(d, i)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == [a for a, _ in docs if a not in hit]


def test_bottom_k_sketch_finds_an_item_at_the_threshold():
    rng = np.random.default_rng(0)
    words = [f"x{k}" for k in range(50)]
    for cut in range(1, 12):
        text = words[:]
        for p in rng.choice(50, cut, replace=False):
            text[p] = f"y{p}"
        block = decontam.ItemBlock([1], [" ".join(words)], 5, 0.8)
        share = len(shingles(" ".join(words)) & shingles(" ".join(text))) / 46
        assert bool(block.search(" ".join(text))) == (share >= 0.8 - 1e-9)


def test_edges_and_empty_tables(spark):
    rows = [(d, t) for d, t, *_ in edge_rows()]
    items = [(1, "the house is a house and it is red"), (2, None), (3, "Der die das ist ein Haus!")]
    i = spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, doc_id string")
    assert pairs(decontam.contained_items(edge_docs(spark), i)) == sorted(contained(rows, items), key=str)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contained_items(edge_docs(spark), none).collect() == []
    assert decontam.contained_items(edge_docs(spark, []), i).collect() == []
    assert decontam.decontaminate(edge_docs(spark), none).count() == len(rows)
