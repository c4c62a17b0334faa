"""Best-fit packing of token sequences (configuration LP).

Documents become pieces of at most ``capacity`` tokens; pieces are packed
into as few sequences of ``capacity`` tokens as possible.

* Tokenising is the only pass over the texts; its result (one small row per
  piece: position, length, checksum) is staged.
* The packing plan depends on the *length histogram* alone: at most
  ``capacity`` counts, whatever the number of documents, so it is the one
  thing that goes to the driver.  The configuration linear program
  (min sum x_p, sum_p a_ps x_p >= n_s over patterns p) is solved by
  multiplicative weights: prices per length, the best pattern by an
  unbounded-knapsack dynamic program, prices decayed by what the pattern
  covers.  The fractional pattern counts are rounded down and the rest is
  packed by bulk best-fit decreasing, again on counts.
* Pieces find their place by their rank among pieces of the same length
  (:func:`trueline.llm.common.running_rank`): the plan's runs say which
  ranks of a length belong to which pattern copy, slot and offset.  The run
  table is bounded by the number of patterns of the plan, not by the data.

Null text is an empty text (one piece, the separator alone).  A null
``doc_id`` is carried as null.  Repeated rows are packed like any other
rows.  An empty table gives an empty result.  Columns other than ``doc_id``
and ``text`` are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trueline.llm.common import buckets_for, running_rank, stage

CAPACITY = 2048
#: Rounds of multiplicative weights, the decay rate of prices and the share
#: of a length's demand that one round may move; the share of a fractional
#: pattern count that rounding keeps (best fit packs the rest).
ROUNDS, RATE, STEP, KEEP = 40, 0.5, 0.25, 0.9
#: Words, and pieces of words, in a worker's token caches.
CACHE_WORDS, CACHE_PIECES = 300_000, 100_000
# Fixed value: signs that are no part of 's and its like.
ENDS = tuple(",.!?;:")
#: Longer words are always encoded by the whole tokenizer.
LONG_WORD = 200
#: Characters of text that are split into words at once.
CHUNK_CHARS = 1_000_000

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Words(dict):
    """Words (each with its space) of one lookup, filled on a miss, in two
    generations of CACHE_WORDS entries."""

    def __init__(self, coder: "TokenBytes"):
        super().__init__()
        self.coder, self.old = coder, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        value = self.old.get(word)
        if value is not None:
            self[word] = value
            return value
        coder = self.coder
        if word.isalpha() and len(word) < LONG_WORD and coder.PLAIN.fullmatch(word):
            value = coder.letters(word)
        elif word[-1:] in ENDS and word[:-1].isalpha():      # the sign is a piece of its own
            value = self[word[:-1]] + coder.piece(word[-1])
        else:
            value = coder.word(" " + word)
        self[word] = value
        return value


class TokenBytes:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    The byte-level pre-tokeniser never joins a non-space character with a
    following space, and a lone space always opens the next token, so a text
    without double spaces is the concatenation of its space-separated words,
    each encoded with its space.  Words are encoded once per worker and
    cached, in one lookup a word.  Within a word of plain Latin characters the
    pre-tokeniser's pattern gives the pieces, and the tokenizer's model encodes
    each distinct piece; other words go through the whole tokenizer.  Texts
    where the split does not hold (runs of white space with spaces, added
    tokens) are encoded whole.
    """

    # Fixed value: the pre-tokeniser's pattern, its letters and digits being
    # those of PLAIN.
    LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
    PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+")
    PLAIN = re.compile("[\t\n\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.words = _Words(self)
        self.heads: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.model = self.tok.model.tokenize
        self.raw = [struct.pack("<I", k) for k in range(self.tok.get_vocab_size(with_added_tokens=True))]
        # The byte-level alphabet: printable Latin-1 bytes stand for themselves,
        # the others are numbered from 256.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.space = self.alphabet[32]

    def letters(self, word: str) -> bytes:
        """A word of plain letters, with its space: one piece."""
        raw = self.raw
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([raw[t.id] for t in self.model(self.space + word)])

    def piece(self, piece: str) -> bytes:
        value = self.pieces.get(piece)
        if value is None:
            raw, shown = self.raw, piece.encode().decode("latin-1").translate(self.alphabet)
            value = b"".join([raw[t.id] for t in self.model(shown)])
            if len(self.pieces) >= CACHE_PIECES:
                self.pieces.clear()
            self.pieces[piece] = value
        return value

    def word(self, word: str) -> bytes:
        if len(word) < LONG_WORD and self.PLAIN.fullmatch(word):
            return b"".join(map(self.piece, self.PIECES.findall(word)))
        return self._encode(word)

    def _head(self, word: str) -> bytes:
        value = self.heads.get(word)
        if value is None:
            if len(self.heads) >= CACHE_PIECES:
                self.heads.clear()
            value = self.heads[word] = self.word(word)
        return value

    def _encode(self, text: str) -> bytes:
        ids = self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, dtype="<u4").tobytes()

    def _split(self, text: str) -> bool:
        return not ("  " in text or (text.endswith(" ") and text[:-1][-1:].isspace())
                    or any(a in text for a in self.added))

    def batch(self, texts: list[str]) -> list[bytes]:
        of, out = self.words.__getitem__, []
        for text in texts:
            if self._split(text):
                head, *tail = text.split(" ")
                out.append(self._head(head) + b"".join(map(of, tail)))
            else:
                out.append(self._encode(text))
        return out


@lru_cache(maxsize=2)
def token_bytes(path: str) -> TokenBytes:
    """The worker process's coder; its cache outlives a task."""
    return TokenBytes(path)


def chunks(column: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts): runs of rows of about ``limit`` bytes, one row at least."""
    total = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(column):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield lo, column.slice(lo, hi - lo).to_pylist()
        lo = hi


def cut_pieces(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n_tokens``: whole if
    it fits, else full pieces with the shorter one first."""
    if n_tokens <= capacity:
        return [(0, n_tokens)]
    head = n_tokens % capacity
    cuts = [(0, head)] if head else []
    return cuts + [(s, capacity) for s in range(head, n_tokens, capacity)]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
                 separator: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    tail = np.array([separator], dtype="<u4").tobytes()

    def run(batches):
        coder = token_bytes(tokenizer_path)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[list] = [[], [], [], [], []]
            for lo, texts in chunks(batch.column(1)):
                for doc, raw in zip(ids[lo:lo + len(texts)], coder.batch(texts)):
                    raw += tail
                    for k, (s, n) in enumerate(cut_pieces(len(raw) // 4, capacity)):
                        for col, v in zip(out, (doc, k, s, n, zlib.crc32(raw[4 * s:4 * (s + n)]))):
                            col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return source.mapInArrow(run, PIECE_SCHEMA)


# --- the plan: everything below works on counts per length ------------------

def knapsack(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value within each room 0..capacity, and
    the index of the last size put in (-1: none)."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        k = upto[c]
        if k:
            v = best[c - sizes[:k]] + price[:k]
            j = int(v.argmax())
            if v[j] > 0:
                best[c], pick[c] = v[j], j
    return best, pick


def pattern_with(first: int, sizes: np.ndarray, pick: np.ndarray, capacity: int) -> dict[int, int]:
    """The most valuable pattern that holds size index ``first``."""
    pattern = {first: 1}
    c = capacity - int(sizes[first])
    while c > 0 and pick[c] >= 0:
        j = int(pick[c])
        pattern[j] = pattern.get(j, 0) + 1
        c -= int(sizes[j])
    return pattern


def fractional_plan(sizes: np.ndarray, demand: np.ndarray, capacity: int,
                    rounds: int = ROUNDS) -> list[tuple[dict[int, int], float]]:
    """Approximate solution of the configuration LP by multiplicative weights.

    Prices start at the volume price s / capacity (a feasible dual) and fall
    exponentially with the covered share of a length's demand.  Each round
    solves one knapsack at the current prices.  Its table holds the best
    pattern *containing* each length, so all lengths move in one round, by
    a fraction ``STEP`` of their own demand and never past the demand of
    another length in the pattern.
    """
    covered = np.zeros(len(sizes))
    base = sizes / capacity
    plan: dict[tuple, float] = {}
    for _ in range(rounds):
        share = covered / demand
        price = np.where(share < 1, base * np.exp(-RATE * share), 0.0)
        if not price.any():
            break
        best, pick = knapsack(sizes, price, capacity)
        worth = np.where(share < 1, price + best[capacity - sizes], -1.0)
        for first in np.argsort(-worth, kind="stable"):
            if covered[first] >= demand[first]:
                continue
            pattern = pattern_with(int(first), sizes, pick, capacity)
            step = min((demand[j] - covered[j]) / a for j, a in pattern.items())
            step = min(step, STEP * demand[first])
            if step <= 0:
                continue
            key = tuple(sorted(pattern.items()))
            plan[key] = plan.get(key, 0.0) + step
            for j, a in pattern.items():
                covered[j] = min(demand[j], covered[j] + a * step)
    return [(dict(k), x) for k, x in plan.items()]


def best_fit(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing in bulk: all items of a length at once, on groups
    of equal bins.  Returns (pattern, number of bins)."""
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}
    open_rooms: list[int] = []

    def put(room: int, pattern: dict[int, int], bins: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(open_rooms, room)
        groups[room].append((pattern, bins))

    for j in range(len(sizes) - 1, -1, -1):
        size, left = int(sizes[j]), int(counts[j])
        while left:
            k = bisect_left(open_rooms, size)
            if k < len(open_rooms):
                room = open_rooms[k]
                pattern, bins = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    open_rooms.pop(k)
            else:
                room, pattern, bins = capacity, {}, left
            per = room // size
            full = min(bins, left // per)
            if full:
                put(room - per * size, {**pattern, j: per}, full)
                left -= full * per
            if full < bins and 0 < left < per:
                put(room - left * size, {**pattern, j: left}, 1)
                full, left = full + 1, 0
            if pattern and full < bins:
                put(room, pattern, bins - full)
    return [(p, n) for room in groups for p, n in groups[room]]


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY,
                   rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """(pattern {length: copies}, number of sequences), covering the
    histogram exactly."""
    out: list[tuple[dict[int, int], int]] = []
    full = histogram.get(capacity, 0)
    if full:
        out.append(({capacity: 1}, full))
    items = sorted((s, n) for s, n in histogram.items() if n and s < capacity)
    if not items:
        return out
    sizes = np.array([s for s, _ in items], dtype=np.int64)
    left = np.array([n for _, n in items], dtype=np.int64)
    chosen = fractional_plan(sizes, left.astype(float), capacity, rounds)
    room = lambda p: capacity - sum(int(sizes[j]) * a for j, a in p.items())
    for pattern, x in sorted(chosen, key=lambda c: (room(c[0]), -c[1])):
        n = min(int(x * KEEP + 1e-9), *(int(left[j]) // a for j, a in pattern.items()))
        if n > 0 and room(pattern) == 0:
            out.append(({int(sizes[j]): a for j, a in pattern.items()}, n))
            for j, a in pattern.items():
                left[j] -= a * n
    out += [({int(sizes[j]): a for j, a in p.items()}, n) for p, n in best_fit(sizes, left, capacity)]
    return out


def plan_runs(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, copies per sequence, first sequence,
    offset of the first copy), sorted by (length, first rank)."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in plan:
        offset = 0
        for size in sorted(pattern, reverse=True):
            a = pattern[size]
            rows.append((size, taken.get(size, 0), a, sequence, offset))
            taken[size] = taken.get(size, 0) + a * n
            offset += a * size
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


#: A run's key is length << RANK_BITS | first rank.
RANK_BITS = 44


def place(ranked: DataFrame, runs: np.ndarray) -> DataFrame:
    """Add sequence_id and offset to pieces with their ``rank`` by length."""
    keys = (runs[:, 0] << RANK_BITS) | runs[:, 1]

    def run(batches):
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            r = runs[np.searchsorted(keys, (length << RANK_BITS) | rank, side="right") - 1]
            copy = rank - r[:, 1]
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(r[:, 3] + copy // r[:, 2]), pa.array(r[:, 4] + (copy % r[:, 2]) * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        run, PIECE_SCHEMA + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
                   separator: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """Pack all documents; returns one row per piece with doc_id, piece,
    start, length, ids_crc32, sequence_id, offset (see the module text)."""
    pieces = stage(token_pieces(docs, tokenizer_path, capacity, separator), "pieces")
    counts = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    histogram = {int(r["length"]): int(r["count"]) for r in counts}
    runs = plan_runs(plan_sequences(histogram, capacity, rounds))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets_for(sum(histogram.values()))))
    ranked = running_rank(pieces.withColumn("bucket", bucket), ["length"], "bucket",
                          [F.col("doc_id"), F.col("piece")], "rank")
    return place(ranked, runs)
