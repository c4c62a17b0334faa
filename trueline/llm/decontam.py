"""Benchmark decontamination: size-partitioned MinHash containment search.

A text's words are the runs of word characters of its lower-cased form; its
shingles are the distinct sequences of ``words`` consecutive words (a text
with fewer words has one shingle, its whole sequence; none, no shingles).
An item is contained in a document if at least ``threshold`` of the item's
shingles are shingles of the document, whatever the document's length.

* Items are partitioned by size (powers of two of their shingle count).  An
  item's sketch is the bottom k of its shingles by hash, with
  k = n - ceil(threshold * n) + 1: a document that misses all of them
  misses more than the item may lack, so the search loses nothing.
* A document looks up its shingles in the sketches of the partitions whose
  items it is long enough to contain; items with a hit are candidates and are
  verified by the exact share of their shingles in the document.
* The benchmark is the query set.  It is taken in blocks of about
  ``BLOCK_CHARS`` characters; each block goes to the tasks and the documents
  stream past it, so no document text is ever shuffled and what is shipped
  does not grow with the corpus or the benchmark.  Shingles are compared as
  tuples of word numbers of the block, never by hash alone.

Null texts (documents or items) have no words and match nothing.  Each row
of a repeated ``doc_id`` or ``item_id`` gives its own rows; null ids are
carried.  Other columns are ignored (or kept, in :func:`decontaminate`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil, floor, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS, THRESHOLD = 5, 0.8
BLOCK_CHARS = 32_000_000
WORD = re.compile(r"\w+")


class ItemBlock:
    """A block of items: vocabulary, shingles, size partitions, sketches."""

    def __init__(self, ids: list, texts: list[str], words: int, threshold: float):
        self.words, self.threshold = words, threshold
        self.vocabulary: dict[str, int] = {}
        self.ids, self.need, self.shingles = [], [], []
        self.sketches: dict[int, dict[bytes, list[int]]] = {}
        for item, text in zip(ids, texts):
            tokens = WORD.findall(text.lower())
            numbers = np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in tokens], dtype=np.int32)
            found = {numbers[k:k + words].tobytes() for k in range(max(1, len(tokens) - words + 1))} - {b""}
            if not found:
                continue
            n = len(found)
            need = ceil(threshold * n - 1e-9)
            sketch = sorted(found, key=lambda s: (xxhash.xxh64_intdigest(s), s))[:n - need + 1]
            part = self.sketches.setdefault(floor(log2(n)), {})
            for s in sketch:
                part.setdefault(s, []).append(len(self.ids))
            self.ids.append(item)
            self.need.append(need)
            self.shingles.append(found)

    def document_shingles(self, text: str) -> set[bytes]:
        """The document's shingles made of the block's words only (no other
        can be an item's)."""
        tokens = WORD.findall(text.lower())
        numbers = np.fromiter(map(self.vocabulary.get, tokens, [-1] * len(tokens)), dtype=np.int32, count=len(tokens))
        w = self.words
        if len(tokens) < w:
            return {numbers.tobytes()} if len(tokens) and (numbers >= 0).all() else set()
        unknown = np.concatenate([[0], np.cumsum(numbers < 0)])
        return {numbers[k:k + w].tobytes() for k in np.flatnonzero(unknown[w:] == unknown[:-w]).tolist()}

    def search(self, text: str) -> list[tuple[int, int]]:
        """(item, shared shingles) of the contained items."""
        if not self.ids:
            return []
        doc = self.document_shingles(text)
        candidates: set[int] = set()
        for size, sketch in self.sketches.items():
            if len(doc) >= ceil(self.threshold * 2 ** size - 1e-9):
                for s in doc & sketch.keys():
                    candidates.update(sketch[s])
        shared = [(i, len(self.shingles[i] & doc)) for i in sorted(candidates)]
        return [(i, n) for i, n in shared if n >= self.need[i]]


def item_blocks(items: DataFrame, words: int, threshold: float) -> Iterator[ItemBlock]:
    """The benchmark in blocks of bounded size, one at a time."""
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        rows = items.where(number == k).orderBy("item_id").collect()
        yield ItemBlock([r["item_id"] for r in rows], [r["text"] for r in rows], words, threshold)


def contained_items(docs: DataFrame, items: DataFrame, words: int = WORDS,
                    threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): every document and
    item it contains."""
    sc = docs.sparkSession.sparkContext
    kind = items.schema["item_id"].dataType.simpleString()
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, item_id {kind}, n_item int, n_shared int, containment double"
    out = None
    for block in item_blocks(items, words, threshold):
        shipped = sc.broadcast(block)

        def run(batches, shipped=shipped):
            items = shipped.value
            for b in batches:
                hits = [(row, i, n) for row, t in enumerate(b.column(1).to_pylist()) for i, n in items.search(t)]
                sizes = [len(items.shingles[i]) for _, i, _ in hits]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column(0).take(pa.array([h[0] for h in hits], pa.int64())),
                    "item_id": [items.ids[h[1]] for h in hits],
                    "n_item": sizes, "n_shared": [h[2] for h in hits],
                    "containment": [h[2] / s for h, s in zip(hits, sizes)]}, schema=target)

        target = pa.schema([("doc_id", _arrow(docs, "doc_id")), ("item_id", _arrow(items, "item_id")),
                            ("n_item", pa.int32()), ("n_shared", pa.int32()), ("containment", pa.float64())])
        part = source.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(df.schema[name].dataType)


def decontaminate(docs: DataFrame, items: DataFrame, words: int = WORDS,
                  threshold: float = THRESHOLD) -> DataFrame:
    """The documents (all columns) that contain no item.  Each block filters
    the rows as they stream past; nothing is shuffled."""
    sc = docs.sparkSession.sparkContext
    at = docs.columns.index("text")
    for block in item_blocks(items, words, threshold):
        shipped = sc.broadcast(block)

        def run(batches, shipped=shipped):
            items = shipped.value
            for b in batches:
                keep = [not (t and items.search(t)) for t in b.column(at).to_pylist()]
                yield b.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
