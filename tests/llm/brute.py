"""Brute-force versions and edge-case tables for the operator tests."""
import re
from collections import defaultdict

SPACES = " \t\n\x0b\x0c\r"
LONG = "lorem ipsum dolor sit amet " * 40_000
#: Names that the operators use inside; an extra column must not disturb them.
CLASHING = ("fp", "keys", "rank", "k1", "bucket", "start", "label", "score", "t", "row", "kind", "i", "n", "position",
            "held_out", "__text", "__n", "shard", "length", "piece", "first", "root", "value")


def edge_rows():
    """(doc_id, text, lang, source): nulls, empty and long texts, copies,
    repeated rows."""
    line = "A line that several documents share"
    return [
        (1, f"{line}\nfirst own line of text", "en", "a"),
        (2, f"  {line.upper()}\t\nsecond own line of text", "en", None),
        (2, f"  {line.upper()}\t\nsecond own line of text", "en", None),
        (3, "", None, "a"), (4, None, "de", "b"), (5, " \t\n ", "en", "a"), (6, "12 34 !?", "fr", "b"),
        (None, f"{line}\nno id here at all", "en", "a"), (7, LONG, "en", "a"), (8, LONG, "en", "a"),
        (9, "x" * 300_000, "en", "b"), (10, "der die das ist ein haus", "de", "b"),
        (11, "der die das ist ein haus", "de", "b"), (12, "\n\n\n", "de", "a"),
        (13, "the house is a house and it is red", "en", "a"),
    ]


def edge_docs(spark, rows=None):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(edge_rows() if rows is None else rows,
                               "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.char_length("text").cast("long"))
    return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING])


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def line_dedup(docs):
    """[(doc_id, n_lines, n_dropped, text)] for (doc_id, text) rows."""
    order = lambda d: float("inf") if d is None else d
    key = lambda line: ascii_lower(line.strip(SPACES))
    held = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                held[key(line)].add(order(doc))
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == order(doc)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def simhash(text, words=4):
    import xxhash
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", ascii_lower(text or "")) if x]
    shingles = [" ".join(w[k:k + words]) for k in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, linked):
    """Smallest reachable index per index."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def shingles(text, words=5):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} - {()}


def contained(docs, items, words=5, threshold=0.8):
    """{(doc_id, item_id)} by shingle sets."""
    sets = [(i, shingles(t, words)) for i, t in items]
    out = []
    for doc, text in docs:
        have = shingles(text, words)
        out += [(doc, i) for i, s in sets if s and len(s & have) >= threshold * len(s) - 1e-9]
    return out


BASE_PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE_PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else None,
                  "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out
