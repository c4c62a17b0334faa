"""Personal data by candidate generation and gradient boosting (DataFrame only).

1. Generators: for each kind the base pattern and a second, high-recall or
   more strictly bounded pattern propose spans, which may overlap.  Patterns
   run in the JVM: matches are fenced with a control character and the text
   is split at the fences, which gives positions in code points.
2. Every candidate gets format features (shape, digits, separators) and
   context features (characters around it, a telling word before it, a span of
   its kind right beside it).  No feature is a check's verdict.  All are small
   integers, so the training table over *all* candidates is a count per
   feature combination: a bounded grid.
3. Labels come from checks that the trees do not see.  Base matches: the base
   rule's verdict.  Second candidates: the check that fits them, after
   obfuscation is undone (an address with a lettered last label; octets, not
   after a version word; Luhn; 8 to 15 digits); across an accepted span of
   another kind they are negative.  A bracketed number without a country code
   is positive after a telling word, else unlabelled.  Boosted trees (logistic
   loss) are fitted to one half of the labelled candidates; on the second
   candidates of the other half each kind gets the lowest score threshold at
   which its precision, with ``PRIOR`` rows of the precision of all kinds
   added, is at least ``PRECISION``.
4. All accepted base spans stay.  Second candidates are added if they reach
   their kind's threshold and overlap no accepted base span.

The trees are column expressions; nothing leaves the JVM but the counted
grid.  Base patterns are written with possessive quantifiers and start
conditions that give the same leftmost matches without quadratic scans.
Null text is empty text.  Every row gets its result, repeated rows too;
``doc_id`` is carried as it is.  U+0001 in a text counts as a character that
is part of no span.  Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trueline.llm.common import stage

KINDS = ("email", "ip", "card", "phone")
#: Base patterns (fixed by the task, made possessive).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Second generators: obfuscated or spaced addresses; spans bounded so that a
#: number is found inside a longer run of numbers that the base rule rejects.
MORE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?|@)"
             r"[A-Za-z0-9-]++(?:(?:\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})|(?<![0-9A-Za-z(])\([0-9]{3}\))"
             r"[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}(?![0-9])",
}
#: A text without it has no match of the kind.
TRIGGER = {"email": r"@|[\[(]\x20?(?:at|AT)", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]",
           "phone": r"\+[0-9]|\([0-9]{3}\)"}
#: Words that tell a kind when they stand shortly before a span.
TELLING = {"email": r"mail|contact|write", "ip": r"\bip\b|host|server|addr", "card": r"card|visa|credit|pay|account",
           "phone": r"phone|call|tel|fax|mobile|cell"}
#: How an obfuscated address writes its signs, and words before a version number.
AT, DOT = (rf"\x20?[\[(]\x20?(?:{w.lower()}|{w})\x20?[\])]\x20?" for w in ("AT", "DOT"))
VERSION = r"(?i)(?:\bv|\bver|version|release|build)[\s.:]*$"
CONTEXT = 48
FENCE = "\u0001"
FEATURES = ("shape", "digits", "separators", "left", "right", "told", "beside", "second")
ROUNDS, RATE, DEPTH, PRECISION, PRIOR = 30, 0.3, 3, 0.98, 20


# --- candidates -------------------------------------------------------------

def _fenced(kind: str, pattern: str, second: int) -> Column:
    """Pieces of the text between fences as structs; odd pieces are matches.
    Empty when nothing matches."""
    fenced = F.when(F.col("t").rlike(TRIGGER[kind]), F.regexp_replace("t", pattern, f"{FENCE}$0{FENCE}"))
    pieces = F.split(fenced, FENCE)

    def piece(p: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), F.lit(second).alias("second"), i.alias("i"),
            F.char_length(p).alias("n"), F.when(odd, p).alias("match"),
            F.right(p, F.lit(CONTEXT)).alias("tail"), F.when(~odd, F.left(p, F.lit(1))).alias("head"))

    return F.when(F.size(pieces) > 1, F.transform(pieces, piece))


def candidates(docs: DataFrame) -> DataFrame:
    """(row, doc_id, kind, second, start, end, match, before, after, beside); one
    line with a null kind for every row of ``docs``.  ``before`` reaches over the
    match before, ``beside`` tells a match at most two characters away."""
    text = F.translate(F.coalesce("text", F.lit("")), FENCE, "\u0004")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("t"))
    found = [_fenced(k, BASE[k], 0) for k in KINDS] + [_fenced(k, MORE[k], 1) for k in KINDS]
    kind = "array<struct<kind:int,second:int,i:int,n:int,match:string,tail:string,head:string>>"
    none = F.expr("array(named_struct('kind', cast(null as int), 'second', 0, 'i', 1, 'n', 0, 'match', '',"
                  " 'tail', '', 'head', ''))").cast(kind)
    parts = F.flatten(F.filter(F.array(none, *[f.cast(kind) for f in found]), lambda x: x.isNotNull()))
    w = Window.partitionBy("row", "kind", "second").orderBy("i")
    before = F.right(F.concat(*[F.coalesce(F.lag("tail", k).over(w), F.lit("")) for k in (3, 2, 1)]), F.lit(CONTEXT))
    beside = F.lit(0)
    for near in (F.lag, F.lead):
        beside = F.when(near("i", 2).over(w).isNotNull() & (near("n").over(w) <= 2), 1).otherwise(beside)
    return (rows.select("row", "doc_id", F.inline(parts))
            .withColumns({"end": F.sum("n").over(w), "before": before, "after": F.lead("head").over(w), "beside": beside})
            .withColumn("start", F.col("end") - F.col("n")).where("i % 2 = 1").drop("i", "n", "tail", "head"))


def _digits(m: str = "match") -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    places = F.sequence(F.lit(1), F.char_length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = 2 * d
        return total + F.when(i % 2 == 1, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def accepted() -> Column:
    """The base rule's check of a match."""
    octets = F.forall(F.split("match", r"\."), lambda x: (
        lambda z: (F.char_length(z) < 3) | ((F.char_length(z) == 3) & (z <= "255")))(F.regexp_replace(x, "^0+", "")))
    d = _digits()
    return (F.when(F.col("kind") == 0, F.lit(True))
            .when(F.col("kind") == 1, octets)
            .when(F.col("kind") == 2, F.char_length(d).between(16, 19)
                  & F.coalesce(F.when(F.char_length(d).between(16, 19), _luhn(d)), F.lit(False)))
            .otherwise(F.char_length(d).between(8, 15)))


def _char_class(c: Column) -> Column:
    return (F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^\p{L}"), 2).when(c.rlike("^[0-9]"), 3)
            .otherwise(4))


def _shape() -> Column:
    """How a match is written, by kind."""
    m = F.col("match")

    def bits(*tests: Column) -> Column:
        return sum((F.when(t, 2 ** k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))

    return (F.when(F.col("kind") == 0, bits(F.contains(m, F.lit("@")), m.rlike(r"[A-Za-z]{2}$")))
            .when(F.col("kind") == 1, bits(m.rlike(r"(?:^|\.)0[0-9]"), m.rlike(r"[0-9]{3}$"), m.rlike(r"^[0-9]{3}")))
            .when(F.col("kind") == 2, bits(m.rlike(r"^[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"), m.rlike("^[3-6]")))
            .otherwise(bits(m.startswith("+"), F.contains(m, F.lit("(")))))


def fitting(told: Column) -> Column:
    """The check of a second candidate; null where it settles nothing."""
    plain = F.regexp_replace(F.regexp_replace("match", AT, "@"), DOT, ".")
    address = plain.rlike(r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9]") & plain.rlike(r"\.[A-Za-z]{2,}+$")
    return (F.when(F.col("kind") == 0, address)
            .when(F.col("kind") == 1, accepted() & ~F.col("before").rlike(VERSION))
            .when(F.col("kind") == 2, accepted())
            .when(~accepted(), F.lit(False)).when(F.col("match").startswith("+") | told, F.lit(True)))


def featured(found: DataFrame) -> DataFrame:
    """Add the features, ``ok`` (an accepted base span) and ``label``."""
    told = F.lit(False)
    for k, name in enumerate(KINDS):
        told = F.when(F.col("kind") == k, F.lower("before").rlike(TELLING[name])).otherwise(told)
    out = found.where("kind is not null").withColumns({
        "shape": _shape().cast("int"),
        "digits": F.least(F.floor(F.char_length(_digits()) / 4), F.lit(5)).cast("int"),
        "separators": F.least(F.char_length(F.regexp_replace("match", "[0-9A-Za-z]", "")), F.lit(4)).cast("int"),
        "left": _char_class(F.right("before", F.lit(1))), "right": _char_class(F.col("after")),
        "told": told.cast("int"), "fits": F.when(F.col("second") == 1, fitting(told))})
    ok = (F.col("second") == 0) & accepted()
    out = out.withColumn("ok", ok).drop("before", "after", "match")
    # The same span from both generators is one candidate, the base one.
    same = Window.partitionBy("row", "kind", "start", "end").orderBy("second")
    out = out.withColumn("__k", F.row_number().over(same)).where("__k = 1").drop("__k")

    def across(keys: list[str], mine: Column) -> Column:
        """Does another candidate with ``mine`` overlap this one?"""
        w = Window.partitionBy(*keys).orderBy("start", "end", "kind", "second")
        ends = F.max(F.when(mine, F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
        starts = F.min(F.when(mine, F.col("start"))).over(w.rowsBetween(1, Window.unboundedFollowing))
        return F.coalesce(ends > F.col("start"), F.lit(False)) | F.coalesce(starts < F.col("end"), F.lit(False))

    out = out.withColumn("taken", across(["row", "kind"], F.col("ok")))
    out = out.withColumn("crossed", across(["row"], F.col("ok")) & ~F.col("taken"))
    label = (F.when(F.col("ok"), 1).when(F.col("second") == 0, 0).when(~F.col("taken") & F.col("crossed"), 0)
             .when(~F.col("taken"), F.col("fits").cast("int")))
    return out.withColumn("label", label).drop("fits")


# --- boosted trees over the counted grid ------------------------------------

class Node:
    """A split ``feature <= value`` or a leaf."""

    def __init__(self, value: float = 0.0, split: tuple[str, int] | None = None, sides: tuple = ()):
        self.value, self.split, self.sides = value, split, sides

    def score(self, row: dict) -> float:
        node = self
        while node.split:
            node = node.sides[0 if row[node.split[0]] <= node.split[1] else 1]
        return node.value

    def column(self) -> Column:
        if not self.split:
            return F.lit(self.value)
        name, value = self.split
        return F.when(F.col(name) <= value, self.sides[0].column()).otherwise(self.sides[1].column())


def grow(rows: list[dict], depth: int) -> Node:
    """Regression tree on gradients ``g`` and hessians ``h`` (Newton leaves)."""
    g, h = sum(r["g"] for r in rows), sum(r["h"] for r in rows)
    leaf = Node(g / (h + 1.0))
    if not depth or len(rows) < 2:
        return leaf
    best, split = 1e-6, None
    for name in ("kind", *FEATURES):
        sums: dict[int, list[float]] = {}
        for r in rows:
            s = sums.setdefault(r[name], [0.0, 0.0])
            s[0] += r["g"]
            s[1] += r["h"]
        gl = hl = 0.0
        for value in sorted(sums)[:-1]:
            gl, hl = gl + sums[value][0], hl + sums[value][1]
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > best:
                best, split = gain, (name, value)
    if not split:
        return leaf
    name, value = split
    return Node(split=split, sides=(grow([r for r in rows if r[name] <= value], depth - 1),
                                    grow([r for r in rows if r[name] > value], depth - 1)))


def boost(grid: list[dict]) -> list[Node]:
    """Logistic boosting on combinations with ``n`` rows, ``pos`` positive."""
    rows = [dict(r, f=0.0) for r in grid]
    trees: list[Node] = []
    for _ in range(ROUNDS if rows else 0):
        for r in rows:
            p = 1 / (1 + math.exp(-r["f"]))
            r["g"], r["h"] = r["pos"] - r["n"] * p, r["n"] * p * (1 - p)
        tree = grow(rows, DEPTH)
        trees.append(tree)
        for r in rows:
            r["f"] += RATE * tree.score(r)
    return trees


def thresholds(grid: list[dict], trees: list[Node]) -> dict[int, float]:
    """Per kind the lowest score at which the precision of its second
    candidates on ``grid``, with ``PRIOR`` rows of the precision of all
    labelled candidates at that score added, is at least ``PRECISION``."""
    rows = sorted(((RATE * sum(t.score(r) for t in trees), r) for r in grid), key=lambda x: -x[0])
    sums = {kind: [0, 0] for kind in range(len(KINDS))}
    n = pos = 0
    out: dict[int, float] = {}
    for k, (score, r) in enumerate(rows):
        n, pos = n + r["n"], pos + r["pos"]
        if r["second"]:
            mine = sums[r["kind"]]
            mine[0], mine[1] = mine[0] + r["n"], mine[1] + r["pos"]
        if k + 1 < len(rows) and rows[k + 1][0] == score:
            continue
        for kind, (own, good) in sums.items():
            if good + PRIOR * pos / n >= PRECISION * (own + PRIOR):
                out[kind] = score
    return out


def find_spans(docs: DataFrame) -> DataFrame:
    """(row, doc_id, kind, start, end, base, score): one line per span, and
    one with a null kind for every row of ``docs``."""
    found = stage(candidates(docs), "candidates")
    marked = stage(featured(found), "features")
    fold = F.pmod(F.xxhash64("row", "start"), F.lit(2)).alias("fold")
    grid = [r.asDict() for r in marked.where("label is not null").groupBy(fold, "kind", *FEATURES).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).collect()]
    grid.sort(key=lambda r: tuple(r[c] for c in ("fold", "kind", *FEATURES)))
    trees = boost([r for r in grid if r["fold"] == 0])
    limits = thresholds([r for r in grid if r["fold"] == 1], trees)
    score = F.lit(0.0)
    for t in trees:
        score = score + RATE * t.column()
    reached = F.lit(False)
    for kind, limit in limits.items():  # the column adds up in another order: allow for rounding
        reached = reached | ((F.col("kind") == kind) & (F.col("score") >= limit - 1e-6))
    # Added spans of a kind come from one generator, so they do not overlap.
    spans = (marked.withColumn("score", score)
             .where(F.col("ok") | ((F.col("second") == 1) & ~F.col("taken") & ~F.col("crossed") & reached))
             .select("row", "doc_id", "kind", "start", "end", F.col("ok").alias("base"), "score"))
    return spans.unionByName(found.where("kind is null").select("row", "doc_id"), allowMissingColumns=True)


def per_document(spans: DataFrame) -> DataFrame:
    """(doc_id, spans: array of (kind, start, end, base) by kind and start),
    one row per row of the documents."""
    span = F.when(F.col("kind").isNotNull(), F.struct("kind", "start", "end", "base"))
    return spans.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans")).drop("row")


def listing(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[{kind}]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind's mark
    (overlapping spans of different kinds as one, by the first's kind)."""
    same = F.xxhash64(F.coalesce("text", F.lit("")))
    spans = per_document(find_spans(docs.select(F.struct("doc_id", same.alias("h")).alias("doc_id"), "text")))
    spans = spans.where(F.size("spans") > 0).dropDuplicates(["doc_id"]).select(
        F.col("doc_id").alias("__key"), F.array_sort(F.transform("spans", lambda s: F.struct(
            s["start"], s["end"], s["kind"]))).alias("__spans"))
    marks = F.array(*[F.lit(mark.format(kind=k)) for k in KINDS])
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        between = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], between, F.get(marks, s["kind"])))
                        .alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.char_length("text")))

    joined = docs.withColumn("__key", F.struct("doc_id", same.alias("h"))).join(spans, "__key", "left")
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.aggregate("__spans", zero, step, finish))
    return joined.withColumn("text", text).select(*docs.columns)
