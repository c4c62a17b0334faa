"""Conversation repair against a plain search over all edit strings."""

import hashlib
import random
import re
import zlib

import pytest

from trueline.llm import conversation_repair as cr

SPACE = " \t\n\v\f\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """Table over (row, initials so far as a state) with whole weights: every
    edit of every row, up to three insertions before each and at the end."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    name = {"u": "user", "a": "assistant"}

    def insertions(table):
        for _ in range(3):
            for state, (cost, audit, turns) in list(table.items()):
                for x in "ua":
                    if x in step[state]:
                        new = (cost + 5, audit + "I", (*turns, f"{name[x]}:"))
                        table[x] = min(table.get(x, new), new)
        return table

    table = insertions({"": (0, "", ())})
    for role, text, fault in rows:
        new = {}
        for state, (cost, audit, turns) in table.items():
            options = [(state, 2, "D", turns)]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if role[:1] in step[state] and role[:1] in ("s", "u", "a"):
                    options.append((step[state][role[:1]], extra, "K", (*turns, f"{role}:{text}")))
                for x in "ua":
                    if x in step[state]:
                        options.append((x, 1 + extra, "R", (*turns, f"{name[x]}:{text}")))
            for q, more, edit, said in options:
                w = (cost + more, audit + edit, said)
                new[q] = min(new.get(q, w), w)
        table = insertions(new)
    return min(table[s] for s in ("", "a") if s in table)


def brute(rows):
    after = damaged(rows)
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, r, x) for c, t, r, x in after if c == conv))
        seen, faults, illegal = set(), [], 0
        for k, (_, _, role, text) in enumerate(mine):
            core = text.strip(SPACE)
            faults.append("blank" if not core else "duplicate" if (role, text) in seen
                          else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
            illegal += k > 0 and mine[k - 1][2][:1] + role[:1] not in ("su", "ua", "au")
        turns = {t for some, t, _, _ in mine if some}
        cost, audit, said = cheapest([(r, x, f) for (_, _, r, x), f in zip(mine, faults)]) if mine else (0, "", ())
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"),
                    faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                    hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    return [tuple(r) for r in cr.repair(cr.damage(df), df.select("conv_id").distinct()).collect()]


def key(row):
    return row[0] is None, row[0] or 0


def conversation(rng, conv, n):
    roles = ["system", "user", "assistant", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "", "  \n", "open end", "Why?", "ok", "a.\t", None, "x" * 100 + "."]
    return [(conv, k, rng.choice(roles) if rng.random() < 0.5 else ("user", "assistant")[k % 2],
             rng.choice(texts) if rng.random() < 0.4 else f"Text {k}.") for k in range(n)]


@pytest.mark.parametrize("piece", [256, 2])
def test_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(cr, "PIECE", piece)
    rng = random.Random(piece)
    rows = [r for c in range(60) for r in conversation(rng, c, rng.randint(1, 9))]
    rows += conversation(rng, 100, 300) + [(101, k * 3, "user", "Same.") for k in range(40)]
    rows += [(None, k, "user", f"T{k}.") for k in range(5)] + [(102, None, r, t) for r, t in (("user", "Q?"), ("assistant", "A."))]
    rows += [(103, 5, "assistant", "Late."), (103, 5, "user", "Early."), (103, 9, "user", "End")]
    rows += [r for r in rows if r[0] == 7] * 3
    drop = next(c for c in range(200, 400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(drop, 0, "user", "Gone.")]
    assert sorted(run(spark, rows), key=key) == sorted(brute(rows), key=key)


def test_a_conversation_over_many_tasks(spark):
    """One conversation with most rows is cut by ranges and joined again."""
    rng = random.Random(5)
    rows = conversation(rng, 1, 900) + conversation(rng, 2, 6) + conversation(rng, 0, 6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(run(spark, rows), key=key) == sorted(brute(rows), key=key)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_weights_are_superior():
    """Popped weights never fall, for random steps."""
    rng = random.Random(2)
    for _ in range(50):
        steps = [cr.row_step(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3, rng.randint(1, 3)) for _ in range(8)]
        whole = cr.lightest(steps, cr.START, insert=True)
        first = {p: [(q, *w) for q, w in cr.lightest(steps[:3], p, insert=True).items()] for p in cr.STATES}
        second = {p: [(q, *w) for q, w in cr.lightest(steps[3:], p, insert=True).items()] for p in cr.STATES}
        assert {q: (c, a) for q, c, a in cr.join_steps(first, second)[cr.START]} == whole


def test_clashing_names_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", 3, "x", 7), (1, 1, "assistant", "Yes.", 4, "y", 8)],
                               "conv_id long, turn long, role string, text string, cost int, audit string, n int")
    assert [(r.conv_id, r.cost, r.audit) for r in cr.repair(df).collect()] == [(1, 0, "KK")]
    assert cr.repair(df.where("conv_id > 3")).collect() == []
    assert [r.audit for r in cr.repair(df.where("turn > 3"), df.select("conv_id")).collect()] == [""]
