"""The pipeline's stages against brute force, and as a whole."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from brute import CLASHING, components, contained, edge_docs, edge_rows, line_dedup, simhash
from trueline.llm import packing
from trueline.llm.queries import QUERIES, tokenizer_path

ITEM = "one test item that is long enough to have several shingles of five words in it"
MORE = [(20, f"A text about things.\n{ITEM}.\nAnd more of the text.", "en", "a"),
        (21, "the cat sat on the mat and looked at the dog for a long time " * 3, "en", "a"),
        (22, "the cat sat on the mat and looked at the dog for a long time " * 3, "en", "b"),
        (23, "ein haus ist ein haus und das ist gut so " * 5, "de", "b"), (24, "日本 日本", "en", "a")]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    edge_docs(spark, edge_rows() + MORE).drop("doc_id2").write.parquet(f"{path}/documents.parquet")
    return path


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages_return_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, step in cp.STAGES[:-1]:
        assert tuple(step(spark, docs, sf).columns) == cp.COLUMNS
    assert [n for n, _ in cp.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "benchmark decontamination",
                                        "best-fit packing"]


def test_language_stage_rejects_only_what_has_none(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in cp.identify_language(spark, docs, sf).collect()}
    assert kept.isdisjoint({3, 4, 5, 6, 12})
    assert {1, 2, 10, 11, 13, 20, 21, 22, 23} <= kept


def test_line_stage(spark, sf):
    rows = [(d, t) for d, t, *_ in edge_rows() + MORE]
    out = cp.dedupe_lines(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert pairs(out) == sorted(((d, t) for d, _, _, t in line_dedup(rows)), key=str)
    assert out.where("n_chars <> char_length(text)").count() == 0


def test_near_duplicate_stage(spark, sf):
    rows = [r for r in edge_rows() + MORE if r[0] is not None]
    fps = [simhash(t) for _, t, *_ in rows]
    roots = components(len(rows), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    first = {r: min(rows[k][0] for k in range(len(rows)) if roots[k] == r) for r in set(roots)}
    docs = edge_docs(spark, rows)
    out = cp.drop_near_duplicates(spark, docs, sf)
    want = [(d, t) for k, (d, t, *_) in enumerate(rows) if first[roots[k]] == d]
    assert pairs(out) == sorted(want, key=str)


def test_near_duplicate_stage_keeps_one_document_per_component(spark, sf):
    """Null ids, and an id that several rows with different texts share."""
    one, two, three = (f"{w} " * 3 + " ".join(f"{w}{k}" for k in range(40)) for w in ("red", "green", "blue"))
    rows = [(5, one), (5, two), (3, two.upper()), (None, one), (None, three), (None, f" {three}"), (5, f"{one} "),
            (None, "quite another text that nobody else has written so far")]
    docs = edge_docs(spark, [(d, t, "en", "a") for d, t in rows])
    out = pairs(cp.drop_near_duplicates(spark, docs, sf))
    fps = [simhash(t) for _, t in rows]
    roots = components(len(rows), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert len(set(roots)) == 4
    kept = [[k for k, r in enumerate(rows) if r == x] for x in out]
    assert all(len(k) == 1 for k in kept) and sorted(roots[k[0]] for k in kept) == sorted(set(roots))
    assert [d for d, _ in out if d is not None] == [3, 5] and (5, two) not in out


def test_decontamination_stage(spark, sf):
    rows = [(d, t) for d, t, *_ in edge_rows() + MORE]
    hit = {d for d, _ in contained(rows, [(1, ITEM)])}
    assert hit == {20}
    out = cp.drop_contaminated(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert pairs(out) == sorted(((d, t) for d, t in rows if d not in hit), key=str)


def test_whole_run_equals_the_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, step in cp.STAGES[:-1]:
        docs = step(spark, docs, sf)
    ids = sorted(r.doc_id for r in docs.collect() if r.doc_id is not None)
    rows = cp.run(spark, sf).collect()
    assert sorted({r.doc_id for r in rows if r.doc_id is not None}) == sorted(set(ids))
    assert 20 not in ids and (21 in ids) != (22 in ids)
    tokens = packing.token_pieces(docs, tokenizer_path()).agg(F.sum("length")).first()[0]
    assert sum(r.length for r in rows) == tokens


def test_empty_documents(spark, sf, tmp_path):
    edge_docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert len(CLASHING) > 10
