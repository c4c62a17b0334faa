"""Exact substring dedup: bytes of long strings that a smaller document holds.

``dedupe_substrings`` removes each byte covered by a string of ``length`` bytes
that also starts in a document with a smaller id.  Matches never cross
documents; strings are judged on the input, not on what is left.

Plan, all on whole texts:

1. Texts are packed into units of some MB (compressed, staged), the grain at
   which tasks read texts and get decisions back.
2. A window of ``length`` bytes is labelled with the smallest hash of its
   ``ANCHOR``-byte substrings.  Neighbouring windows with one label form a run
   of at most ``RUN`` windows.  Equal windows have equal labels, so runs are
   shuffled by label; copies within a unit travel once, with the smallest and
   the largest document.
3. A task takes the labels of a bucket.  Labels that one document holds alone
   go.  The texts of the others' runs are laid out in tiles of at most
   about ``TILE`` symbols, whose suffix arrays are built by the linear grouping of
   :mod:`suffix_groups`.  Neighbouring suffixes that agree on ``length`` bytes
   are one window, held by the smallest of its documents; windows of a label
   that spans several tiles are merged by their bytes.
4. Every unit gets back the windows that a smaller document holds than the
   largest one of the run, and marks its documents.

Defined results: a null text is empty; a null id counts as larger than all
ids, and rows with equal or null ids never take from one another; repeated
rows get the same result; texts shorter than ``length`` keep all; other
columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trueline.llm.common import stage
from trueline.llm.suffix_groups import suffix_arrays

#: Bytes of text in a unit (a longer text is a unit of its own).
UNIT = 1 << 20
#: Bytes hashed for a label, and most windows in a run.
ANCHOR, RUN = 20, 48
#: Labels, and runs with their texts, that a bucket receives on average.
LABELS, BUCKET = 2_000_000, 150_000
#: Symbols of a tile, and of the tiles that are sorted together.
TILE, BATCH = 512, 1 << 20
NO_ID = np.iinfo(np.int64).max

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of (doc_id, text) rows."""
    part = TaskContext.get().partitionId()
    squeeze = zstandard.ZstdCompressor(level=3)
    ids, texts, held, n = [], [], 0, 0

    def unit():
        lengths = np.array([len(t) for t in texts], np.int64)
        return pa.RecordBatch.from_pydict({
            "unit": pa.array([(part << 33) + n], pa.int64()), "n_bytes": pa.array([held], pa.int64()),
            "ids": pa.array([pa.array(ids, pa.int64())], pa.list_(pa.int64())),
            "lengths": pa.array([lengths], pa.list_(pa.int64())),
            "texts": pa.array([squeeze.compress(b"".join(texts))], pa.binary())})

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            if held and held + len(raw) > UNIT:
                yield unit()
                ids, texts, held, n = [], [], 0, n + 1
            ids.append(doc_id)
            texts.append(raw)
            held += len(raw)
    if ids:
        yield unit()


_SPREAD = np.random.default_rng(13).integers(0, 1 << 63, 256, dtype=np.uint64)      # a number for every byte


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _substring_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` bytes, by joining hashes of halves."""
    joined, length, power = data.astype(np.uint64) + np.uint64(1), 1, np.array([_MULTIPLIER])
    total, covered = None, 0
    while True:
        if size & length:
            if total is None:
                total, covered = joined, length
            else:
                n = len(data) - covered - length + 1
                total = total[:n] * power + joined[covered:covered + n]
                covered += length
        if 2 * length > size:
            return _mix(total)
        n = len(data) - 2 * length + 1
        joined, power, length = joined[:n] * power + joined[length:length + n], power * power, 2 * length


@functools.lru_cache(maxsize=1)
def _powers_up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(_MULTIPLIER) ^ 6
    steps = [np.full(n, x, np.uint64) for x in (base, pow(base, -1, 1 << 64))]
    for x in steps:
        x[0] = 1
    return np.cumprod(steps[0]), np.cumprod(steps[1])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    power, inverse = _powers_up_to(max(2 * UNIT, 1 << n.bit_length()))
    return power[:n], inverse[:n]


def _window_least(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours."""
    n, span = len(h) - width + 1, 1
    while 2 * span <= width:
        h, span = np.minimum(h[:-span], h[span:]), 2 * span
    return np.minimum(h[:n], h[width - span:width - span + n])


class Runs:
    """Runs of a unit, and its entries: distinct (label, text of the run),
    in one order that every recomputation gives again."""

    def __init__(self, ids, lengths, texts: bytes, length: int):
        self.data = np.frombuffer(texts, np.uint8)
        self.ids = np.array([NO_ID if x is None else x for x in ids], np.int64)
        self.ends = np.cumsum(np.asarray(lengths, np.int64))
        self.length = length
        anchor = min(ANCHOR, length)
        n = len(self.data) - length + 1
        if n <= 0:
            self.start = self.count = self.doc = np.zeros(0, np.int64)
            self.label = np.zeros(0, np.uint64)
            return
        label = _window_least(_substring_hashes(self.data, anchor), length - anchor + 1)[:n]
        new = np.ones(n, bool)
        new[1:] = label[1:] != label[:-1]
        begins = self.ends[:-1]
        new[begins[begins < n]] = True
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, n))
        pieces = -(-size // RUN)                                      # a long run is several
        part = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(start, pieces) + RUN * part
        doc = np.searchsorted(self.ends, start, "right")
        # windows over a text's end are the last of their run
        count = np.minimum(np.diff(np.append(start, n)), self.ends[doc] - length + 1 - start)
        keep = count > 0
        self.start, self.count, self.doc = start[keep], count[keep], doc[keep]
        self.label = _mix(label[self.start] + _MULTIPLIER)            # least values crowd near 0

    def enter(self) -> "Runs":
        """Number the entries."""
        if not len(self.start):
            self.entry = self.entry_run = self.least = self.most = self.start
            self.entry_label = self.label
            return self
        # texts of runs are compared by a second hash of their bytes, from sums of powers
        power, inverse = _powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_SPREAD[self.data] * power[:-1], out=sums[1:])
        end = self.start + self.count + self.length - 1
        digest = _mix((sums[end] - sums[self.start]) * inverse[self.start])
        by = np.lexsort((self.start, self.count, digest, self.label))
        same = np.zeros(len(by), bool)
        for x in (self.label, digest, self.count):
            y = x[by]
            same[1:] |= y[1:] != y[:-1]
        same[0] = True
        head = np.flatnonzero(same)
        self.entry = np.empty(len(by), np.int64)
        self.entry[by] = np.cumsum(same) - 1
        self.entry_run = by[head]
        self.entry_label = self.label[self.entry_run]
        owner = self.ids[self.doc[by]]
        self.least, self.most = np.minimum.reduceat(owner, head), np.maximum.reduceat(owner, head)
        return self

    def texts_of(self, entries: np.ndarray) -> tuple[np.ndarray, bytes]:
        run = self.entry_run[entries]
        size = self.count[run] + self.length - 1
        before = np.cumsum(size) - size
        at = np.repeat(self.start[run] - before, size) + np.arange(int(size.sum()))
        return size, self.data[at].tobytes()


def _unit_runs(row: dict, length: int) -> Runs:
    return Runs(row["ids"], row["lengths"], zstandard.ZstdDecompressor().decompress(row["texts"]), length)


def _ranges_of(labels: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal ranges begins in sorted labels, and the end."""
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(labels, edges), [len(labels)]])


def _short(label: np.ndarray, bits: int) -> np.ndarray:
    return label >> np.uint64(64 - bits)


def _send_labels(length: int, buckets: int, bits: int):
    """(bucket, unit, base, payload): the distinct shortened labels of a unit,
    ascending, as differences."""
    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for row in batch.to_pylist():
                short = np.unique(_short(_unit_runs(row, length).label, bits))
                cut = _ranges_of(short << np.uint64(64 - bits), buckets)
                rows = [(k, row["unit"], int(cut[k]), squeeze.compress(
                    np.diff(short[cut[k]:cut[k + 1]], prepend=np.uint64(0)).tobytes()))
                    for k in range(buckets) if cut[k] < cut[k + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], kind) for k, kind in
                     enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["bucket", "unit", "base", "payload"])
    return run


def _met(table: pa.Table) -> pa.Table:
    """Per unit: which of its labels another unit has too, as bits."""
    parts = [np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint64), dtype=np.uint64)
             for x in table.column("payload").to_pylist()]
    _, which, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    shared = (count > 1)[which]
    ends = np.cumsum([len(x) for x in parts])
    return pa.table({"unit": table.column("unit"), "base": table.column("base"),
                     "n": pa.array([len(x) for x in parts], pa.int64()),
                     "bits": pa.array([np.packbits(x).tobytes() for x in np.split(shared, ends[:-1])], pa.binary()),
                     "shared": pa.array([int(x.sum()) for x in np.split(shared, ends[:-1])], pa.int64())})


def _candidates(runs: Runs, met: list[dict], bits: int) -> np.ndarray:
    """Entries whose label another unit or another document of the unit has."""
    short = np.unique(_short(runs.entry_label, bits))
    flag = np.zeros(len(short), bool)
    for part in met:
        flag[part["base"]:part["base"] + part["n"]] = np.unpackbits(
            np.frombuffer(part["bits"], np.uint8), count=part["n"]).view(bool)
    wanted = flag[np.searchsorted(short, _short(runs.entry_label, bits))]
    if len(wanted):
        head = np.flatnonzero(np.concatenate([[True], np.diff(runs.entry_label) != 0]))
        several = np.minimum.reduceat(runs.least, head) < np.maximum.reduceat(runs.most, head)
        wanted |= np.repeat(several, np.diff(np.append(head, len(wanted))))
    return np.flatnonzero(wanted)


def _send(length: int, buckets: int, bits: int):
    """(bucket, unit, payload): a unit's candidate entries by ranges of labels."""
    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for row in batch.to_pylist():
                runs = _unit_runs(row, length).enter()
                chosen = _candidates(runs, row["met"] or [], bits)
                cut = _ranges_of(runs.entry_label[chosen], buckets)
                rows = []
                for k in range(buckets):
                    entries = chosen[cut[k]:cut[k + 1]]
                    if len(entries):
                        size, texts = runs.texts_of(entries)
                        rows.append((k, row["unit"], squeeze.compress(b"".join(
                            [np.int64(len(entries)).tobytes(), runs.entry_label[entries].tobytes(),
                             runs.least[entries].tobytes(), runs.most[entries].tobytes(), size.astype(np.int32).tobytes(),
                             entries.astype(np.int32).tobytes(), texts]))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], kind) for k, kind in
                     enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "unit", "payload"])
    return run


def _receive(payloads: list[bytes]):
    """(label, least, most, size, entry, texts, number of entries of each payload)."""
    parts = []
    for payload in payloads:
        body = zstandard.ZstdDecompressor().decompress(payload)
        n = int(np.frombuffer(body, np.int64, 1)[0])
        at, fields = 8, []
        for kind in (np.uint64, np.int64, np.int64, np.int32, np.int32):
            fields.append(np.frombuffer(body, kind, n, at))
            at += n * np.dtype(kind).itemsize
        parts.append((*fields, np.frombuffer(body, np.uint8, offset=at), n))
    *fields, n = zip(*parts)
    return (*map(np.concatenate, fields), np.array(n))


def _windows_equal(texts: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes from a and from b agree."""
    wide = 8 if length >= 8 else 1
    words = np.lib.stride_tricks.as_strided(texts[:1].view(np.uint8), (len(texts) - wide + 1, wide), (1, 1))
    words = words.view(np.uint64)[:, 0] if wide == 8 else texts
    left = np.arange(len(a))
    for k in sorted({*range(0, length - wide + 1, wide), length - wide}, reverse=True):
        left = left[words[a[left] + k] == words[b[left] + k]]
    same = np.zeros(len(a), bool)
    same[left] = True
    return same


def _least_by_window(label, least, size, texts, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of every run (distinct, sorted by label): where the
    run's windows begin, and the smallest document that holds the window."""
    n_windows = size - length + 1
    offset = np.cumsum(n_windows) - n_windows
    found = np.repeat(least, n_windows)
    text_at = np.cumsum(size) - size
    # a run alone under its label has no other text that could hold its windows
    other = np.zeros(len(label), bool)
    other[1:] = label[1:] == label[:-1]
    other[:-1] |= other[1:]
    runs = np.flatnonzero(other)
    label, least, size, text_at, first = label[runs], least[runs], size[runs], text_at[runs], offset[runs]
    # tiles: neighbouring runs, with a separator after each and a last symbol
    tile = (np.cumsum(size + 1) - size - 1) // TILE
    heads = np.flatnonzero(np.concatenate([[True], np.diff(tile) != 0])) if len(runs) else runs
    spread = []
    begin = 0
    while begin < len(heads):
        stop = int(np.searchsorted(tile[heads], tile[heads[begin]] + BATCH // TILE))
        lo, hi = heads[begin], heads[stop] if stop < len(heads) else len(size)
        starts = heads[begin:stop] - lo
        spread.append(_sort_tiles(slice(lo, hi), starts, label, least, size, texts, text_at, first, length, found))
        begin = stop
    # labels in several tiles: the classes of all tiles meet by their bytes
    at, windows = (np.concatenate(x) for x in zip(*spread)) if spread else (runs, runs)
    if len(at):
        rows = np.lib.stride_tricks.sliding_window_view(texts, length)[at]
        key = np.ascontiguousarray(rows).view(np.dtype((np.void, length))).ravel()
        _, which = np.unique(key, return_inverse=True)
        lowest = np.full(int(which.max()) + 1, NO_ID, np.int64)
        np.minimum.at(lowest, which, found[windows])
        found[windows] = lowest[which]
    return offset, found


def _sort_tiles(part: slice, starts, label, least, size, texts, text_at, offset, length, found):
    """Fill ``found`` for the runs of ``part``; returns (place in ``texts``,
    window) of the windows whose label spans tiles."""
    sizes = size[part].astype(np.int64)
    n = len(sizes)
    last = np.zeros(n, bool)
    last[np.append(starts[1:], n) - 1] = True
    room = sizes + 1 + last
    at = np.cumsum(room) - room
    symbols = np.ones(int(room.sum()), np.int64)               # separators
    before, within = np.cumsum(sizes) - sizes, np.arange(int(sizes.sum()))
    body = np.repeat(text_at[part] - before, sizes) + within
    place = np.repeat(at - before, sizes) + within
    symbols[place] = texts[body].astype(np.int64) + 2
    ends = np.append(at[starts[1:]], len(symbols))
    symbols[ends - 1] = 0
    order = suffix_arrays(symbols, ends)
    # windows only: positions at which ``length`` symbols of a run start
    run_of = np.repeat(np.arange(n), room)
    inside = np.arange(len(symbols)) - at[run_of]
    starts_window = inside <= (sizes - length)[run_of]
    order = order[starts_window[order]]
    tile_of = np.cumsum(np.concatenate([[False], last[:-1]]))
    a, b = order[:-1], order[1:]
    joined = (label[part][run_of[a]] == label[part][run_of[b]]) & (tile_of[run_of[a]] == tile_of[run_of[b]])
    pairs = np.flatnonzero(joined)
    byte_at = text_at[part][run_of[order]] + inside[order]
    joined[pairs] = _windows_equal(texts, byte_at[pairs], byte_at[pairs + 1], length)
    head = np.flatnonzero(np.concatenate([[True], ~joined]))
    owner = least[part][run_of[order]]
    lowest = np.minimum.reduceat(owner, head)
    spans = np.diff(np.append(head, len(order)))
    window = offset[part][run_of[order]] + inside[order]
    found[window] = np.repeat(lowest, spans)
    # does the label go on in a neighbouring tile?
    tags = label[part]
    cut = part.start + starts
    shared = [label[k] for k in cut if k and label[k - 1] == label[k]]
    if part.stop < len(label) and label[part.stop] == label[part.stop - 1]:
        shared.append(label[part.stop])
    if not shared:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = np.isin(tags[run_of[order]], np.array(shared, np.uint64))
    return byte_at[wide], window[wide]


def _decide(length: int):
    """Per bucket: for every unit, (entry, first window, windows, smallest
    document) of the windows that a document smaller than the entry's largest holds."""
    def run(table: pa.Table) -> pa.Table:
        label, least, most, size, place, texts, sent = _receive(table.column("payload").to_pylist())
        by = np.argsort(label, kind="stable")
        new = np.concatenate([[True], label[by][1:] != label[by][:-1]])
        head = np.flatnonzero(new)
        several = np.minimum.reduceat(least[by], head) < np.maximum.reduceat(most[by], head)
        chosen = by[np.repeat(several, np.diff(np.append(head, len(by))))]
        units, payloads = [], []
        if len(chosen):
            # copies from other units are one text, held by the smallest document
            begins = np.cumsum(size.astype(np.int64)) - size
            raw, known = texts.tobytes(), {}
            text_of = np.array([known.setdefault(raw[x:x + n], len(known))
                                for x, n in zip(begins[chosen].tolist(), size[chosen].tolist())], np.int64)
            head = np.unique(text_of, return_index=True)[1]
            lowest = np.full(len(head), NO_ID, np.int64)
            np.minimum.at(lowest, text_of, least[chosen])
            own = np.frombuffer(b"".join(known), np.uint8)
            offset, least_of = _least_by_window(label[chosen[head]], lowest, size[chosen[head]].astype(np.int64), own, length)
            n_windows = size[chosen].astype(np.int64) - length + 1
            first = np.cumsum(n_windows) - n_windows
            entry_of = np.repeat(np.arange(len(chosen)), n_windows)
            found = least_of[np.repeat(offset[text_of] - first, n_windows) + np.arange(len(entry_of))]
            taken = found < most[chosen][entry_of]
            new = np.concatenate([[True], (entry_of[1:] != entry_of[:-1]) | (found[1:] != found[:-1])])
            head = np.flatnonzero(new)
            count = np.diff(np.append(head, len(found)))
            head, count = head[taken[head]], count[taken[head]]
            entry = chosen[entry_of[head]]
            source = np.repeat(np.arange(len(sent)), sent)
            unit = np.array(table.column("unit").to_pylist(), np.int64)
            where = source[entry]
            rows = np.stack([place[entry], head - first[entry_of[head]], count, found[head]])
            for k in np.unique(where):
                units.append(int(unit[k]))
                payloads.append(rows[:, where == k].tobytes())
        return pa.table({"unit": pa.array(units, pa.int64()), "found": pa.array(payloads, pa.binary())})
    return run


def _apply(length: int):
    """Kept bytes and removed spans of every document of the units."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                runs = _unit_runs(row, length)
                edge = np.zeros(len(runs.data) + 1, np.int32)
                if row["found"]:
                    runs.enter()
                    entry, first, count, least = np.concatenate(
                        [np.frombuffer(x, np.int64).reshape(4, -1) for x in row["found"]], axis=1)
                    by = np.argsort(entry, kind="stable")
                    entry, first, count, least = entry[by], first[by], count[by], least[by]
                    a = np.searchsorted(entry, runs.entry, "left")
                    hits = np.searchsorted(entry, runs.entry, "right") - a
                    run_of = np.repeat(np.arange(len(hits)), hits)
                    k = np.repeat(a - (np.cumsum(hits) - hits), hits) + np.arange(int(hits.sum()))
                    own = least[k] < runs.ids[runs.doc[run_of]]
                    run_of, k = run_of[own], k[own]
                    begin = runs.start[run_of] + first[k]
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + count[k] + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                out = {"doc_id": row["ids"], "n_bytes": row["lengths"], "kept": [], "spans": []}
                begin = 0
                for end in runs.ends.tolist():
                    mine = gone[begin:end]
                    if mine.any():
                        turns = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                        out["kept"].append(runs.data[begin:end][~mine].tobytes())
                        out["spans"].append(turns.reshape(-1, 2).tolist())
                    else:
                        out["kept"].append(runs.data[begin:end].tobytes())
                        out["spans"].append([])
                    begin = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["doc_id"], pa.int64()), pa.array(out["n_bytes"], pa.int64()),
                     pa.array(out["kept"], pa.binary()), pa.array(out["spans"], pa.list_(pa.list_(pa.int64())))],
                    names=list(out))
    return run


def dedupe_substrings(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, n_bytes, kept binary, spans array of [start, end)) per row of
    ``docs`` (doc_id long, text)."""
    units = stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _pack, "unit long, n_bytes long, ids array<long>, lengths array<long>, texts binary"), "units")
    total = units.agg(F.sum("n_bytes")).first()[0] or 0
    labels = max(1, 2 * total // max(2, length - ANCHOR))             # about two runs per window length without an anchor
    bits, buckets = min(63, labels.bit_length() + 8), max(8, labels // LABELS)
    sent = units.select("unit", "ids", "lengths", "texts").mapInArrow(
        _send_labels(length, buckets, bits), "bucket int, unit long, base long, payload binary")
    met = stage(sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(
        _met, "unit long, base long, n long, bits binary, shared long"), "labels")
    met_of = met.groupBy("unit").agg(F.collect_list(F.struct("base", "n", "bits")).alias("met"))
    buckets = max(8, (met.agg(F.sum("shared")).first()[0] or 0) // BUCKET)
    sent = units.join(met_of, "unit", "left").mapInArrow(
        _send(length, buckets, bits), "bucket int, unit long, payload binary")
    found = stage(sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(
        _decide(length), "unit long, found binary"), "repeats")
    replies = found.groupBy("unit").agg(F.collect_list("found").alias("found"))
    return units.join(replies, "unit", "left").mapInArrow(
        _apply(length), "doc_id long, n_bytes long, kept binary, spans array<array<long>>")
