import zlib
from collections import Counter, defaultdict

import pytest

from brute import edge_docs, edge_rows
from trueline.llm import sharding


def check(rows, texts, sources, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    per = defaultdict(list)
    for r in rows:
        per[r.shard].append(r.slot)
    n = [len(per[s]) for s in range(shards)]
    assert set(per) <= set(range(shards)) and max(n) - min(n) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    # The mixture: a source's rows in each shard are within two of its share.
    for source, total in Counter(sources).items():
        for s in range(shards):
            have = sum(r.source == source for r in rows if r.shard == s)
            assert abs(have - total * n[s] / max(1, len(rows))) <= 2


@pytest.mark.parametrize("shards", [1, 3, 16, 40])
def test_edges(spark, shards):
    rows = sharding.interleave(edge_docs(spark), shards).collect()
    check(rows, [(d, t) for d, t, *_ in edge_rows()], [s for *_, s in edge_rows()], shards)


def test_hot_source_and_repeats(spark):
    texts = [(k, f"text {k % 7}") for k in range(900)] + [(5, "same")] * 30
    sources = ["hot" if k % 3 else f"s{k % 5}" for k in range(900)] + [None] * 30
    df = spark.createDataFrame([(*t, "en", s) for t, s in zip(texts, sources)],
                               "doc_id long, text string, lang string, source string").repartition(5)
    rows = sharding.interleave(df, 16).collect()
    check(rows, texts, sources, 16)
    again = sharding.interleave(df.repartition(2), 16).collect()
    key = lambda r: (str(r.doc_id), r.size, r.shard, r.slot)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    other = sharding.interleave(df, 16, seed=7).collect()
    assert sorted(map(key, rows)) != sorted(map(key, other))


def test_empty_table(spark):
    assert sharding.interleave(edge_docs(spark, [])).collect() == []


def test_fraction_is_the_rank_within_the_source(spark):
    rows = sharding.interleave(edge_docs(spark), 4).collect()
    for source, total in Counter(s for *_, s in edge_rows()).items():
        got = sorted(r.fraction for r in rows if r.source == source)
        assert got == [(2 * k + 1) / (2 * total) for k in range(total)]
    order = [r.fraction for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
