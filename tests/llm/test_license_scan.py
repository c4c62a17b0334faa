import math
import posixpath
from collections import Counter

import pytest

from brute import CLASHING, LONG
from pyspark.sql import functions as F
from trueline.llm import license_scan as ls

MIT = ls.TEMPLATES["MIT"][1]
ROWS = [
    (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "# Licensed under CC BY-NC 4.0.\ncode"),
    (3, "a/b/y.py", "just code"), (4, "a/b/c/z.py", None), (5, "a/b/COPYING.txt", LONG), (6, "q/r.py", "nothing"),
    (7, "w/LICENSE", "no licence in here"), (8, "w/v/f", ""), (9, None, "Released under the MIT License."),
    (10, None, "text"), (11, "f", "text at the root"), (12, "a/b/y.py", "just code"), (12, "a/b/y.py", "just code"),
    (13, "t/LICENSE", "Licensed under the Apache License, Version 2.0."), (14, "t/licence.md", MIT),
    (15, "t/u/f", "text"), (16, "a/b/c/d/LICENSE", "* " + MIT.replace(" to ", "\n * to ")), (17, "a/b/c/d/e/f", "x"),
    (18, "ab/f", "not under a"),
]


def files(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    return df.select("*", *[F.lit("extra").alias(c) for c in (*CLASHING, "own", "dir", "from_dir", "near", "how")])


def test_own_and_inherited(spark):
    got = {r.doc_id: (r.licence, r.how, r.from_dir) for r in ls.scan(files(spark, ROWS), carry=("doc_id",)).collect()}
    none = (None, "none", None)
    assert got == {
        1: ("MIT", "own", None), 2: ("CC-BY-NC-4.0", "own", None), 3: ("MIT", "inherited", "a"),
        4: ("MIT", "inherited", "a"), 5: ("MIT", "inherited", "a"), 6: none, 7: none, 8: none,
        9: ("MIT", "own", None), 10: none, 11: none, 12: ("MIT", "inherited", "a"),
        13: ("Apache-2.0", "own", None), 14: ("MIT", "own", None), 15: ("Apache-2.0", "inherited", "t"),
        16: ("MIT", "own", None), 17: ("MIT", "inherited", "a/b/c/d"), 18: none}


def test_rows_stay_rows(spark):
    assert ls.scan(files(spark, ROWS)).count() == len(ROWS)
    assert ls.scan(files(spark, [])).collect() == []


@pytest.mark.parametrize("name", sorted(ls.TEMPLATES))
def test_each_template_finds_itself(name):
    m = ls.Matcher(ls.TEMPLATES, 1000, {w: 50 for w in ("the", "of", "a", "is", "and", "or")}, ls.THRESHOLD)
    for text in ls.TEMPLATES[name]:
        assert m.scan(f"some code here\n# {text}\nand other code\n")[1] == name


def test_prose_has_no_licence():
    m = ls.Matcher(ls.TEMPLATES, 1000, {"the": 900, "of": 900, "is": 700, "under": 300}, ls.THRESHOLD)
    for text in ("the software of the house is under the table", "Version 2.0 of the plan", "license", LONG, "",
                 "He was licensed to drive under the law of the land and he did so"):
        found = m.scan(text)
        assert found is None or text == "license", (text, found)


def test_inheritance_equals_a_walk_up(spark):
    rows = []
    for k in range(300):
        steps = [f"s{k % 3}", f"d{k % 7}", f"e{k % 2}"][: 1 + k % 3]
        is_licence = k % 11 == 0
        text = (ls.TEMPLATES[sorted(ls.TEMPLATES)[k % 15]][0] if k % 2 else "no") if is_licence else "code"
        rows.append((k, "/".join([*steps, "LICENSE" if is_licence else f"f{k}"]), text))
    out = ls.scan(files(spark, rows), carry=("doc_id",)).collect()
    held = {}
    for r in out:
        if r.how == "own" and posixpath.basename(r.path) == "LICENSE":
            key, value = posixpath.dirname(r.path), (-r.score, r.path, r.licence)
            held[key] = min(held.get(key, value), value)
    assert len(held) > 5
    for r in out:
        if r.how != "own":
            up = posixpath.dirname(r.path)
            while up and up not in held:
                up = posixpath.dirname(up)
            assert (r.licence, r.from_dir) == ((held[up][2], up) if up in held else (None, None))


def test_scores_are_tf_idf_over_the_corpus(spark):
    """Words of no template weigh by the files that hold them, and by how
    often a unit holds them."""
    head = "foo.c - reads frames, frames\nCopyright 2019 Jane Doe\n"
    rows = [(k, f"s/f{k}", head + "\n" + f"word{k} of file") for k in range(200)]
    rows += [(1000 + k, f"t/f{k}", head + ls.TEMPLATES[name][-1].replace(" of ", "\nof "))
             for k, name in enumerate(["GPL-3.0", "Apache-2.0", "MIT", "ISC"])]
    rows += [(2000, "u/f", "rarely seen " * 9 + ls.TEMPLATES["MIT"][1]), (2000, "u/f", None)]
    n = len(rows)
    held = Counter(w for _, _, t in rows for w in set(ls.words_of(t or "")))

    def vector(words):
        return {w: c * (math.log((1 + n) / (1 + held[w])) + 1) for w, c in Counter(words).items()}

    def cosine(a, b):
        length = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        return sum(x * b.get(w, 0) for w, x in a.items()) / length

    made = [(name, vector(ls.words_of(t))) for name, texts in ls.TEMPLATES.items() for t in texts]
    want = []
    for d, _, text in rows:
        best = max(((cosine(vector(u), v), name) for u in ls.units_of(text or "") for name, v in made), default=(0, None))
        want.append((d, best[1] if best[0] >= ls.THRESHOLD else None, round(best[0], 6) if best[0] >= ls.THRESHOLD else None))
    got = [(r.doc_id, r.own, r.score and round(r.score, 6)) for r in ls.detect(files(spark, rows), carry=("doc_id",)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[1] for r in want if 1000 <= r[0] < 2000} == {"GPL-3.0", "Apache-2.0", "MIT", "ISC"}


NOTICE = {"BSD-2-Clause": [ls.BSD_OPENING, ls.BSD_SOURCE, ls.BSD_BINARY, ls.BSD_DISCLAIMER],
          "BSD-3-Clause": [ls.BSD_OPENING, ls.BSD_SOURCE, ls.BSD_BINARY, ls.BSD_NAMES.replace("the copyright holder", "Acme"),
                           ls.BSD_DISCLAIMER],
          "LGPL-2.1": [ls.TEMPLATES["LGPL-2.1"][1]], "LGPL-3.0": [ls.TEMPLATES["LGPL-3.0"][1]],
          "GPL-3.0": [ls.TEMPLATES["GPL-3.0"][1]], "GPL-2.0": [ls.TEMPLATES["GPL-2.0"][1]]}


def wrapped(text, start=""):
    words, lines = text.split(), [""]
    for w in words:
        if len(lines[-1]) + len(w) > 70:
            lines.append("")
        lines[-1] += f" {w}"
    return "\n".join(start + line for line in lines)


def test_near_relatives_are_told_apart(spark):
    """Licence files, headers over code and single lines of licences that share
    most of their words; files below inherit the right one."""
    rows, want = [], {}
    for k, (name, parts) in enumerate(sorted(NOTICE.items())):
        held = "Copyright (c) 2021, Jane Doe\nAll rights reserved.\n\n" + "\n\n".join(map(wrapped, parts))
        header = "/*\n" + "\n *\n".join(wrapped(p, " *") for p in parts) + "\n */\n\n" + "int frames(int x);\n\n" * 400
        rows += [(10 * k, f"{name}/LICENSE", held), (10 * k + 1, f"{name}/src/a.c", header),
                 (10 * k + 2, f"{name}/src/b.c", "int b;"), (10 * k + 3, "one/line", " ".join(parts))]
        want.update({10 * k: name, 10 * k + 1: name, 10 * k + 2: name, 10 * k + 3: name})
    rows += [(1000 + k, f"o/f{k}", f"the plain file of word{k} and of the others, see frames") for k in range(100)]
    got = {r.doc_id: r.licence for r in ls.scan(files(spark, rows), carry=("doc_id",)).collect()}
    assert {d: got[d] for d in want} == want and all(got[1000 + k] is None for k in range(100))


def test_scan_of_a_text_equals_the_spark_run(spark):
    rows = [(k, f"d/f{k}", "\n\n".join(["some words before", *parts, "int x;"])) for k, parts in enumerate(NOTICE.values())]
    held = Counter(w for _, _, t in rows for w in set(ls.words_of(t)))
    matcher = ls.Matcher(ls.TEMPLATES, len(rows), held, ls.THRESHOLD)
    for r in ls.detect(files(spark, rows), carry=("doc_id",)).collect():
        score, name = matcher.scan(rows[r.doc_id][2])
        assert r.own == name and abs(r.score - score) < 1e-8


def test_whole_text_is_a_unit():
    assert ls.units_of("a b\n\nc") == [["a", "b"], ["c"], ["a", "b", "c"]]
    assert ls.units_of("a\nb") == [["a"], ["b"], ["a", "b"]] and ls.units_of("a") == [["a"]] and ls.units_of("\n") == []
