"""Conversation structure repair by a lightest-derivation agenda.

``repair`` finds for every conversation the cheapest edits that leave the role
initials ``(s?(ua)+)?``, ``repaired`` gives the repaired turns.  A row is
blank (no character but white space), a duplicate (role and text stand
earlier), truncated (its last character that is no white space is none of
``.!?``) or sound.  Edits: Keep 0, Rerole (to user or assistant) 1, Delete 2
(required for blank and duplicate rows), Insert (an empty user or assistant
turn, anywhere) 5; a truncated row that stays adds 5.  Among equal costs the
ASCII-least string of edit initials wins.

The repair is a search for the lightest derivation in a weighted hypergraph:
the item (row, state of the pattern) is deduced from its predecessor by an
edit, its weight is (cost, audit).  Appending an edit never makes a weight
smaller and keeps the order of weights, so the functions are superior and an
item popped from the agenda is final; the search stops at the goal item.

Rows are range-partitioned by conversation and turn, so a conversation that
holds a large part of all rows spreads over many tasks.  A task derives its
stretch of a conversation in pieces of ``PIECE`` rows, from every state that
the stretch may begin in, and joins pieces, and stretches of other tasks, by
the same agenda over their (state, state) items.  Copies of a row within a turn
are counted before they move.  The repaired turns are streamed, conversation
by conversation; a task holds the audit of one conversation at a time (which
is a field of the result), never its rows.

Defined results: a null role or text is one space; rows are in order of turn
(nulls first), rows that share a turn by role, text up to its 64th character
and a hash; a null conv_id is a conversation like others; repeated rows are
duplicates; other columns are ignored; conversations without rows have zeros
and an empty audit; empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trueline.llm.common import stage

# States are nothing, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
GOAL = (START, ASSISTANT)
# Edit costs.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Where a turn of this initial leads to from the states in which it may stand.
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The user or assistant turn that may follow a state.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
#: Rows of a piece.
PIECE = 256


def row_step(initial: str, forced: bool, truncated: bool, copies: int) -> dict:
    """Deductions over one row and its copies: state → [(state, cost, edits)]."""
    rest, more = "D" * (copies - 1), DELETE * (copies - 1)
    step = {p: [(p, DELETE + more, "D" + rest)] for p in STATES}
    if not forced:
        extra = more + (TRUNCATED if truncated else 0)
        for p, q in KEEP.get(initial, {}).items():
            step[p].append((q, extra, "K" + rest))
        for p, q in NEXT.items():
            step[p].append((q, REROLE + extra, "R" + rest))
    return step


def lightest(steps: list[dict], start: int, insert: bool, goal: tuple | None = None) -> dict:
    """Lightest weights (cost, audit) of the items behind the last step, from
    ``start``; with ``goal`` only of the lightest goal item."""
    agenda = [(0, "", 0, start)]
    final: set = set()
    out: dict = {}
    while agenda:
        cost, audit, k, state = heapq.heappop(agenda)
        if (k, state) in final:
            continue
        final.add((k, state))
        if k == len(steps):
            if goal is None:
                out[state] = (cost, audit)
            elif state in goal:
                return {state: (cost, audit)}
        else:
            for q, more, edits in steps[k].get(state, ()):
                if (k + 1, q) not in final:
                    heapq.heappush(agenda, (cost + more, audit + edits, k + 1, q))
        if insert and (k, NEXT[state]) not in final:
            heapq.heappush(agenda, (cost + INSERT, audit + "I", k, NEXT[state]))
    return out


def join_steps(first: dict, second: dict) -> dict:
    """Items of two neighbouring stretches joined: start state → [(state, cost, audit)]."""
    return {p: [(q, *w) for q, w in sorted(lightest([{p: first[p]}, second], p, insert=False).items())] for p in first}


class _Stretch:
    """The rows of a conversation that one task has."""

    def __init__(self, conv, starts: tuple):
        self.conv, self.starts = conv, starts
        self.items = None
        self.steps: list[dict] = []
        self.illegal, self.first, self.last = 0, None, None

    def add(self, initial: str, forced: bool, truncated: bool, copies: int) -> None:
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += copies - 1
        self.last = initial
        self.steps.append(row_step(initial, forced, truncated, copies))
        if len(self.steps) == PIECE:
            self._join()

    def _join(self) -> None:
        starts = self.starts if self.items is None else STATES
        piece = {p: [(q, *w) for q, w in sorted(lightest(self.steps, p, insert=True).items())] for p in starts}
        self.items = piece if self.items is None else join_steps(self.items, piece)
        self.steps = []

    def row(self, task: int, whole: bool):
        """``whole``: no other task has rows of the conversation."""
        if whole and self.items is None:            # straight to the goal
            found = lightest(self.steps, START, insert=True, goal=GOAL)
        else:
            if self.steps:
                self._join()
            found = lightest([self.items], START, insert=False, goal=GOAL) if whole else {}
        items = [(START, q, *w) for q, w in found.items()] if whole else [(p, *x) for p in self.items for x in self.items[p]]
        return (self.conv, task, [list(x) for x in zip(*items)], self.illegal, self.first, self.last, whole)


_STRETCH = ("conv_id long, task int, p array<int>, q array<int>, cost array<long>, audit array<string>, "
            "illegal long, first string, last string, whole boolean")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    task = TaskContext.get().partitionId()
    now, out = None, []

    def flush(rows):
        names = ("conv_id", "task", "p", "q", "cost", "audit", "illegal", "first", "last", "whole")
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()),
                 pa.list_(pa.string()), pa.int64(), pa.string(), pa.string(), pa.bool_())
        columns = [[r[0] for r in rows], [r[1] for r in rows], *[[r[2][k] for r in rows] for k in range(4)],
                   *[[r[k] for r in rows] for k in (3, 4, 5, 6)]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))

    n_seen = 0
    for batch in batches:
        for conv, initial, forced, truncated, copies in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if now is None or now.conv != conv:
                if now is not None:
                    out.append(now.row(task, whole=n_seen > 1))
                # only a task's first conversation may have begun, and only its last may go on, elsewhere
                now, n_seen = _Stretch(conv, STATES if n_seen == 0 else (START,)), n_seen + 1
            now.add(initial, forced, truncated, copies)
        if out:
            yield flush(out)
            out = []
    if now is not None:
        yield flush([now.row(task, whole=False)])


def _goal(parts: pd.DataFrame) -> pd.DataFrame:
    """A conversation's stretches joined to the goal."""
    parts = parts.sort_values("task")
    steps, illegal, last = [], 0, None
    for row in parts.itertuples():
        step: dict = {}
        for p, q, cost, audit in zip(row.p, row.q, row.cost, row.audit):
            step.setdefault(int(p), []).append((int(q), int(cost), audit))
        steps.append(step)
        illegal += int(row.illegal) + (last is not None and last + row.first not in LEGAL)
        last = row.last
    (cost, audit), = lightest(steps, START, insert=False, goal=GOAL).values()
    return pd.DataFrame({"conv_id": parts.conv_id.iloc[:1], "illegal": illegal, "cost": cost, "audit": audit})


def _space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) damaged by crc32 of ``conv_id:turn`` modulo
    20: 0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats
    it in its turn, 4 sets the role to user; nulls are one space."""
    kind = F.crc32(F.concat(_space("conv_id"), F.lit(":"), _space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(_space("text"), ".!?", "")).otherwise(_space("text"))
    return (rows.where(kind != 0)
            .select("conv_id", "turn", F.when(kind == 4, "user").otherwise(_space("role")).alias("role"),
                    text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("__n"))
            .drop("__n"))


_ORDER = ("no_turn", "turn", "role", "head", "h1", "h2")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the columns that order and identify them."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       _space("role").alias("role"), _space("text").alias("text"))
    return rows.select("*", F.col("turn").isNotNull().alias("no_turn"), F.substring("text", 1, 64).alias("head"),
                       F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "role", "text").alias("h2"))


def _faults(rows: DataFrame) -> DataFrame:
    """Distinct rows of a turn: copies, blank, repeated (its role and text
    stand earlier), truncated."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    found = rows.select("conv_id", *_ORDER, F.substring("role", 1, 1).alias("initial"),
                        (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"))
    found = found.groupBy("conv_id", *_ORDER, "initial", "blank", "open").agg(F.count(F.lit(1)).alias("copies"))
    key = F.struct("conv_id", "h1", "h2").alias("key")
    at = F.struct("no_turn", "turn")
    first = found.groupBy(key).agg(F.min(at).alias("earliest"))
    found = found.withColumn("key", key).join(first, "key")
    # ``open`` rows whose role and text stand earlier in the conversation are duplicates first
    return found.withColumn("repeated", at != F.col("earliest")).drop("key", "earliest")


def _summary(found: DataFrame) -> DataFrame:
    """Per conversation: gaps and the number of rows of each fault."""
    sound = ~F.col("blank")
    again = F.when(F.col("repeated"), F.col("copies")).otherwise(F.col("copies") - 1)
    turns = found.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(sound, again).otherwise(0)).alias("duplicate"),
        F.sum((sound & ~F.col("repeated") & F.col("open")).cast("long")).alias("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    return turns.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])


def _audits(found: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit) of every conversation with rows."""
    order = [F.asc_nulls_first("conv_id"), *_ORDER]
    ready = found.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "initial", (F.col("blank") | F.col("repeated")).alias("forced"), "open", "copies")
    stretches = stage(ready.mapInArrow(_stretches, _STRETCH), "stretches")
    parts = stretches.where("not whole").groupBy("conv_id").applyInPandas(
        _goal, "conv_id long, illegal long, cost long, audit string")
    return stretches.where("whole").select("conv_id", "illegal", F.col("cost")[0].alias("cost"),
                                           F.col("audit")[0].alias("audit")).unionByName(parts)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, its audit first → repaired turns."""
    conv, audit, at, state, n, begun = None, "", 0, START, 0, False
    out: list = []

    def put(role, text):
        nonlocal n
        out.append((conv, n, role, text))
        n += 1

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = NEXT[state]
            put(ROLE[state], "")
            at += 1

    for batch in batches:
        for owner, header, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if header is not None:
                if begun:
                    inserts()
                conv, audit, at, state, n, begun = owner, header, 0, START, 0, True
                continue
            inserts()
            edit = audit[at]
            at += 1
            if edit == "K":
                state = KEEP[role[:1]][state]
                put(role, text)
            elif edit == "R":
                state = NEXT[state]
                put(ROLE[state], text)
            if len(out) >= 4096:
                yield _turns(out)
                out.clear()
        if out:
            yield _turns(out)
            out.clear()
    if begun:
        inserts()
    if out:
        yield _turns(out)


def _turns(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                                      names=["conv_id", "n", "role", "text"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of ``role:text`` lines, of turns that come in order."""
    now, sha, ids, digests = None, None, [], []
    for batch in batches:
        for conv, n, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if sha is None or conv != now:
                if sha is not None:
                    ids.append(now)
                    digests.append(sha.hexdigest())
                now, sha = conv, hashlib.sha256()
            sha.update((("\n" if n else "") + f"{role}:{text}").encode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())],
                                         names=["conv_id", "digest"])
        ids, digests = [], []
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([sha.hexdigest()], pa.string())],
                                         names=["conv_id", "digest"])


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, n, role, text): the turns after the edits of ``audits``
    (conv_id, audit), each partition in order."""
    rows = _keyed(rows)
    none = F.lit(None)
    headers = audits.select("conv_id", F.col("audit").alias("header"), *[none.cast(t).alias(c) for c, t in rows.dtypes if c != "conv_id"])
    both = headers.unionByName(rows.withColumn("header", none.cast("string")))
    order = [F.asc_nulls_first("conv_id"), F.col("header").isNull(), *_ORDER]
    return both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "header", "role", "text").mapInArrow(
        _walk, "conv_id long, n long, role string, text string")


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256) of every conversation of ``rows`` (conv_id, turn, role,
    text), and of every conv_id of ``conversations``."""
    found = stage(_faults(_keyed(rows)), "faults")
    audits = stage(_audits(found), "audits")
    digests = repaired(rows, audits).mapInArrow(_digest, "conv_id long, digest string")
    key = F.struct("conv_id").alias("key")
    named = (conversations if conversations is not None else found).select(F.col("conv_id").cast("long").alias("conv_id"))
    out = named.distinct().select("conv_id", key)
    for part in (_summary(found), audits, digests):
        out = out.join(part.select(key, *[c for c in part.columns if c != "conv_id"]), "key", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
