import pytest

from brute import LONG, base_spans, edge_docs, edge_rows, luhn
from trueline.llm import pii

TEXTS = ["a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0000001.2.3.4 256.1.1.1 255.255.255.255", "9" * 50,
         "+1 (212) 555-1234 1.2.3.4", "4111 1111 1111 1111 42 \x01 me@x.org", "mail x (at) y.com +12 34", "", None,
         "é𝒳 a@b.cd 😀 +49 30 1234567", "4111-1111-1111-1111", "4111111111111111", "5500 0000 0000 0004x", "+1",
         "a" * 200_000, "1" * 200_000, "1 " * 100_000, "a@" * 2_000, "1." * 4_000, "+1" * 4_000, "a@b" + ".c" * 50_000,
         "+1(" + "(" * 50_000, "x@y.z " * 1_000, LONG, "$1 \\1 $0 a@b.cd"]


def spans(df):
    return {r.doc_id: [(pii.KINDS[s.kind], s.start, s.end) for s in r.spans if s.base]
            for r in pii.per_document(pii.find_spans(df)).collect()}


def test_base_spans_equal_the_plain_patterns(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(4)
    got = spans(df)
    for k, text in enumerate(TEXTS):
        assert got[k] == base_spans(text if len(text or "") < 60_000 or "@" in text or "." in text else ""), k


@pytest.mark.parametrize("k", range(3))
def test_base_spans_of_random_texts(spark, k):
    import numpy as np
    rng = np.random.default_rng(k)
    parts = ["a", "b.c", "@", "x@y.zz", ".", "1", "12", "255", "256", "1.2.3.4", "+", "+49", "(", ")", " ", "-", "_",
             "4111111111111111", "5555", "1234", "é", "\n", "😀", "%"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 30))) for _ in range(300)]
    got = spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert all(got[i] == base_spans(t) for i, t in enumerate(texts))


def test_rows_and_edges(spark):
    out = pii.per_document(pii.find_spans(edge_docs(spark))).collect()
    assert len(out) == len(edge_rows()) and all(r.spans == [] for r in out)
    assert pii.find_spans(edge_docs(spark, [])).collect() == []


def test_number_beside_a_number_is_added(spark):
    card, phone = "4111 1111 1111 1111", "+1 (212) 555-1234"
    other = "5500 0000 0000 0004"
    rows = [(k, f"pay with card {card} now") for k in range(60)] + [(100 + k, f"call {phone} today") for k in range(60)]
    rows += [(300 + k, f"number 4111 1111 1111 {1112 + k} is no card") for k in range(60)
             if not luhn(f"411111111111{1112 + k}")]
    rows += [(500, f"cards {card} {other} here"), (501, f"call {phone} 4111111111111112 now")]
    found = {r.doc_id: [(pii.KINDS[s.kind], s.start, s.end, s.base) for s in r.spans]
             for r in pii.per_document(pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert [s[0] for s in found[500]] == ["card", "card"] and not any(s[3] for s in found[500])
    assert ("phone", 5, 22, False) in found[501]
    assert all(not s for d, s in found.items() if 300 <= d < 400)


def test_redaction(spark):
    rows = [(1, "mail a@b.cd or +1 (212) 555-1234."), (2, "clean"), (3, None), (1, "mail a@b.cd or +1 (212) 555-1234."),
            (4, "é a@b.cd😀")]
    out = sorted(((r.doc_id, r.text) for r in pii.redact(edge_docs(spark, [(*r, "en", "a") for r in rows])).collect()),
                 key=str)
    assert out == sorted([(1, "mail [email] or [phone].")] * 2 + [(2, "clean"), (3, None), (4, "é [email]😀")], key=str)


def test_plan_has_no_python(spark, capsys):
    pii.per_document(pii.find_spans(edge_docs(spark))).explain()
    plan = capsys.readouterr().out
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_boosting_separates_the_grid():
    grid = [dict(kind=k % 4, shape=v, digits=d, separators=0, left=1, right=1, told=0, beside=0, second=0, n=50,
                 pos=50 * (v and d > 2)) for k in range(4) for v in (0, 1) for d in range(6)]
    trees = pii.boost(grid)
    limits = pii.thresholds(grid, trees)
    for r in grid:
        score = pii.RATE * sum(t.score(r) for t in trees)
        assert (score >= limits[r["kind"]]) == bool(r["pos"])
    assert pii.boost([]) == [] and pii.thresholds([], []) == {}


PLANTED = {
    "email": ["jane.doe (at) host (dot) com", "ann[at]mail.example.org", "bob (AT) uni-x (DOT) edu"],
    "card": ["4111 1111 1111 1111", "5500 0000 0000 0004", "4012888888881881"],
    "phone": ["+1 (212) 555-1234", "(415) 555-0199", "+44 20 7946 0958"],
}


def planted(spark):
    """Documents with spans that the base rule cannot isolate (ids from 1000),
    plain ones, and look-alikes that are none."""
    rows, want = [], {}

    def add(doc, text, *spans):
        rows.append((doc, text))
        want[doc] = [(kind, text.index(m), text.index(m) + len(m)) for kind, m in spans]

    for k in range(90):
        card, phone, mail = PLANTED["card"][k % 3], PLANTED["phone"][k % 3], PLANTED["email"][k % 3]
        add(k, f"please charge card {card} in week {k}")
        add(100 + k, f"call {PLANTED['phone'][2 * (k % 2)]} before noon")
        add(200 + k, f"number 4111 1111 1111 {1112 + k} is no card" if not luhn(f"411111111111{1112 + k}") else "none")
        add(300 + k, f"mail a{k}@b.example.com today")
        add(1000 + k, f"cards {card} {PLANTED['card'][(k + 1) % 3]} were lost", ("card", card),
            ("card", PLANTED["card"][(k + 1) % 3]))
        add(1100 + k, f"call {phone} 4111111111111112 now", ("phone", phone))
        add(1200 + k, f"write to {mail} for more, item {k}", ("email", mail))
        add(1300 + k, f"rows 1234 5678 9012 {3456 + k} 1234 5678 9012 {7456 + k} and see b (at) c.{k}{k} there")
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), want


def test_planted_spans_are_found_and_look_alikes_are_not(spark):
    docs, want = planted(spark)
    got = {r.doc_id: {(pii.KINDS[s.kind], s.start, s.end) for s in r.spans if not s.base}
           for r in pii.per_document(pii.find_spans(docs)).collect()}
    added = {(d, *x) for d, xs in got.items() for x in xs}
    true = {(d, *x) for d, xs in want.items() for x in xs}
    for kind in ("email", "card", "phone"):
        mine = {x for x in true if x[1] == kind}
        assert len(mine & added) >= 0.95 * len(mine), kind
    assert len(added & true) >= 0.95 * len(added)


def test_added_spans_equal_a_plain_scoring(spark):
    """Thresholds and added spans against their definitions, row by row."""
    docs, _ = planted(spark)
    docs = docs.coalesce(1)
    marked = pii.featured(pii.candidates(docs)).selectExpr("*", "pmod(xxhash64(row, start), 2) as fold").collect()
    assert not {"valid", "ok", "label"} & set(pii.FEATURES)

    def grid(fold):
        cells = {}
        for r in marked:
            if r.fold == fold and r.label is not None:
                cell = cells.setdefault(tuple(r[c] for c in ("kind", *pii.FEATURES)), [0, 0])
                cell[0], cell[1] = cell[0] + 1, cell[1] + r.label
        return [dict(zip(("kind", *pii.FEATURES), c), n=n, pos=pos) for c, (n, pos) in sorted(cells.items())]

    trees = pii.boost(grid(0))
    score = {id(r): pii.RATE * sum(t.score(r.asDict()) for t in trees) for r in marked}
    held = [r for r in marked if r.fold == 1 and r.label is not None]
    limits = {}
    for kind in range(4):
        for limit in {score[id(r)] for r in held}:
            above = [r for r in held if score[id(r)] >= limit]
            own = [r for r in above if r.kind == kind and r.second == 1]
            share = sum(r.label for r in above) / len(above)
            if sum(r.label for r in own) + pii.PRIOR * share >= pii.PRECISION * (len(own) + pii.PRIOR):
                limits[kind] = min(limit, limits.get(kind, limit))
    want = {(r.doc_id, r.kind, r.start, r.end) for r in marked if r.second == 1 and not r.taken and not r.crossed
            and r.kind in limits and score[id(r)] >= limits[r.kind] - 1e-6}
    got = {(r.doc_id, r.kind, r.start, r.end) for r in pii.find_spans(docs).where("not base").collect()}
    assert got == want and len(got) > 200


def test_labels_of_second_candidates(spark):
    rows = [(1, "x (at) y (dot) com"), (2, "x (at) y.99"), (3, "see version 1.2.3.4.5"), (4, "+1 (212) 555-1234 9 1.2.3.4"),
            (5, "or (212) 555-1234"), (6, "call (212) 555-1234"), (7, "4111 1111 1111 1111 4111 1111 1111 1112"),
            (8, "call +49 1234567 4012888888881881")]
    got = {}
    for r in pii.featured(pii.candidates(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        if r.second == 1:
            got.setdefault(r.doc_id, []).append((pii.KINDS[r.kind], r.start, r.label, r.beside))
    assert got[1] == [("email", 0, 1, 0)] and got[2] == [("email", 0, 0, 0)]
    assert got[5] == [("phone", 3, None, 0)] and got[6] == [("phone", 5, 1, 0)]
    assert sorted(got[7]) == [("card", 0, 1, 1), ("card", 20, 0, 1)]


def test_few_labelled_rows_use_the_precision_of_all_kinds():
    one = dict(shape=0, digits=1, separators=0, left=1, right=1, told=0, beside=0, second=1)
    grid = [dict(one, kind=0, n=500, pos=500), dict(one, kind=2, n=1, pos=1)]
    assert set(pii.thresholds(grid, pii.boost(grid))) == {0, 1, 2, 3}
    grid[1] = dict(one, kind=2, n=3, pos=0)
    assert 2 not in pii.thresholds(grid, [])
