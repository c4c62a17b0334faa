import zlib
from collections import defaultdict

import numpy as np
import pytest

from brute import LONG, edge_docs, edge_rows
from trueline.llm import packing
from trueline.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def check(rows, docs, tok, capacity):
    """Pieces rebuild the documents; sequences are gapless; returns their number."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc, texts in docs.items():
        ids = [tok.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
        want = []
        for x in ids:
            raw = np.array(x, dtype="<u4").tobytes()
            want += [(k, s, n, zlib.crc32(raw[4 * s:4 * s + 4 * n]))
                     for k, (s, n) in enumerate(packing.cut_pieces(len(x), capacity))]
            assert all(n == capacity or k == 0 for k, (_, n) in enumerate(packing.cut_pieces(len(x), capacity)))
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc]) == sorted(want)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


def test_edges_round_trip(spark, tok):
    docs = defaultdict(list)
    for doc, text, *_ in edge_rows():
        docs[doc].append(text)
    rows = packing.pack_documents(edge_docs(spark), tokenizer_path(), capacity=512).collect()
    total = sum(r.length for r in rows)
    assert check(rows, docs, tok, 512) <= -(-total // 512) + 2


def test_empty_table(spark):
    assert packing.pack_documents(edge_docs(spark, []), tokenizer_path()).collect() == []


def test_word_cache_equals_whole_text(tok):
    texts = ["a  b", "foo   bar", "x \n\n y", " lead", "trail ", "trail \n ", "a\n b", "<|endoftext|> x", "", "  ",
             "　 x", "ñ  ", "a \n", " ", "tab\t end", LONG[:5000], "it's I'll we've he'd 'tis x's.\n\nNew 12th 3.14%",
             "Ünïcödé ß çà ñandú Łódź, (q)uoted \"text\" -- and...more!!\n\tIndented", "日本語 text 中 😀x é́ \x1c \x85a \xa0b",
             "a\x00b \x7f c", "y" * 500 + " " + "é" * 500, "²³ ½ Ⅷ ٣ a²"]
    coder = packing.TokenBytes(tokenizer_path())
    whole = [np.asarray(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert coder.batch(texts) == whole
    assert coder.batch(texts) == whole


def test_token_cache_generations(tok, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    coder = packing.TokenBytes(tokenizer_path())
    for text in ("a b c d e f g", "c d x y z", "a b c d e f g", "z y x"):
        want = np.asarray(tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert coder.batch([text]) == [want]


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_histogram_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(2048, 1 + (rng.lognormal(5.5, 1.2, 20_000)).astype(int))
    hist = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True))}
    plan = packing.plan_sequences(hist)
    got = defaultdict(int)
    for pattern, n in plan:
        assert sum(s * a for s, a in pattern.items()) <= 2048
        for s, a in pattern.items():
            got[s] += a * n
    assert dict(got) == hist
    bound = -(-sum(s * n for s, n in hist.items()) // 2048)
    assert sum(n for _, n in plan) <= bound * 1.002 + 2


@pytest.mark.parametrize("hist", [{}, {2048: 3}, {1: 1}, {1500: 10}, {1025: 4, 1023: 4}, {700: 1_000_000_000}])
def test_plan_special_histograms(hist):
    plan = packing.plan_sequences(hist)
    got = defaultdict(int)
    for pattern, n in plan:
        for s, a in pattern.items():
            got[s] += a * n
    assert dict(got) == hist
    assert sum(n for _, n in plan) == {1500: 10, 1025: 4, 2048: 3, 1: 1, 700: 500_000_000}.get(next(iter(hist), 0), 0)


def test_hot_length_is_ranked_in_buckets(spark, tok):
    rows = [(k, "same text") for k in range(400)] + [(1000 + k, "word " * (k % 50)) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.pack_documents(df, tokenizer_path(), capacity=64).collect()
    check(out, {d: [t] for d, t in rows}, tok, 64)
