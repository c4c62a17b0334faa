from collections import Counter

import numpy as np
import pytest

from brute import edge_docs, edge_rows, line_dedup
from trueline.llm import line_dedup as ld


def rows_of(df):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect())


def test_edges(spark):
    want = Counter(line_dedup([(d, t) for d, t, *_ in edge_rows()]))
    assert rows_of(ld.dedupe_lines(edge_docs(spark))) == want
    carried = ld.dedupe_lines(edge_docs(spark), carry=("lang", "source"))
    assert carried.columns == ["lang", "source", "doc_id", "n_lines", "n_dropped", "text"]
    assert carried.count() == len(edge_rows())


def test_empty_table(spark):
    assert ld.dedupe_lines(edge_docs(spark, [])).collect() == []


def split(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def fuzz(seed, n=120):
    rng = np.random.default_rng(seed)
    lines = [f"shared line number {k}" for k in range(15)] + ["short", "", "  SHARED LINE number 3 "]
    return [(int(k), "\n".join(rng.choice(lines, rng.integers(1, 8)))) for k in rng.permutation(n)]


def test_increments_equal_one_insertion(spark, monkeypatch):
    monkeypatch.setattr(ld, "KEYS_PER_SHARD", 4)
    rows = fuzz(1)
    index = ld.LineIndex(spark)
    for lo in range(0, len(rows), 50):
        index.insert(split(spark, rows[lo:lo + 50]))
    want = Counter(line_dedup(rows))
    assert rows_of(index.dedupe(split(spark, rows))) == want
    again = ld.LineIndex.open(spark, index.root)
    assert (again.gen, again.n_shards) == (index.gen, index.n_shards)
    assert rows_of(again.dedupe(split(spark, rows))) == want


def test_deletion_is_reversible(spark, monkeypatch):
    monkeypatch.setattr(ld, "KEYS_PER_SHARD", 4)
    rows = fuzz(2)
    gone = [r for r in rows if r[0] % 3 == 0]
    left = [r for r in rows if r[0] % 3]
    index = ld.LineIndex(spark)
    index.insert(split(spark, rows))
    index.delete(split(spark, gone).select("doc_id"))
    assert rows_of(index.dedupe(split(spark, left))) == Counter(line_dedup(left))
    filters = {r.shard: ld._load(_frame(r)) for r in index._filters().collect()}
    live = {(r.k1, r.k2) for r in index.refs().select("k1", "k2").distinct().collect()}
    for k1, k2 in live:  # a filter never forgets a live key
        assert filters[k1 % index.n_shards].contains(np.array([k2]).view(np.uint64))[0]
    index.insert(split(spark, gone))
    assert rows_of(index.dedupe(split(spark, rows))) == Counter(line_dedup(rows))


def _frame(r):
    import pandas as pd
    return pd.DataFrame([r.asDict()])


@pytest.mark.parametrize("n", [0, 1, 5, 1000, 60_000])
def test_cuckoo_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n, dtype=np.int64).view(np.uint64)
    f = ld.build_filter(keys)
    assert f.contains(keys).all() if n else True
    other = rng.integers(0, 2**63, 20_000, dtype=np.int64).view(np.uint64)
    assert f.contains(other).mean() < 0.01
    f.delete(keys[: n // 2])
    assert f.contains(keys[n // 2:]).all() if n else True
    if n:
        assert f.contains(keys[: n // 2]).mean() < 0.01 if n > 1000 else True
    f.delete(keys[n // 2:])
    assert not f.table.any()


def test_same_key_many_times_fits():
    keys = np.full(3, 12345, dtype=np.uint64)
    assert ld.build_filter(keys).contains(keys).all()


def state(index):
    """Live counts, and that the filters know every live key."""
    live = index.counts().where("n_docs > 0").collect()
    filters = {r.shard: ld._load(_frame(r)) for r in index._filters().collect()}
    assert index.n_keys == len(live)
    for r in live:
        assert filters[r.k1 % index.n_shards].contains(np.array([r.k2]).view(np.uint64))[0]
    return Counter((r.k1, r.k2, r.n_docs, r.min_doc) for r in live)


def test_batches_of_new_lines_grow_the_index(spark, monkeypatch):
    """Equal batches without a common line, and a first batch without a key,
    end in the state of one insertion."""
    monkeypatch.setattr(ld, "KEYS_PER_SHARD", 50)
    batch = lambda b: [(1000 * b + k, f"line {k} of the batch number {b}\nshared by batch {b} and its rows") for k in range(150)]
    batches = [[(-1, "short"), (-2, "")], batch(1), batch(2), batch(3), batch(4) + [(9000, "one more line, a single one")]]
    index = ld.LineIndex(spark)
    shards = []
    for rows in batches:
        index.insert(split(spark, rows))
        shards.append(index.n_shards)
    rows = [r for b in batches for r in b]
    one = ld.LineIndex(spark)
    one.insert(split(spark, rows))
    assert shards[0] == 1 and shards == sorted(shards) and shards[-1] >= 6
    assert state(index) == state(one)
    assert rows_of(index.dedupe(split(spark, rows))) == rows_of(one.dedupe(split(spark, rows))) == Counter(line_dedup(rows))
    index.delete(split(spark, batches[2]).select("doc_id"))
    again = ld.LineIndex.open(spark, index.root)
    again.insert(split(spark, batches[2]))
    assert state(again) == state(one)
