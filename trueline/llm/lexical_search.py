"""Ranked lexical search by presence-mask grouping.

``search`` ranks all documents for every item of a query set and returns each
item's ``k`` best, ties by smaller doc_id.  Terms are maximal runs of ASCII
letters and digits and of characters beyond ASCII; only A-Z are lower-cased.

With N documents that have a term, L terms in them, n terms in one document,
document frequency df and term frequency tf, the score of a document sums
``w * ((1000000000 * tf) div (1000 * tf + 8 * m))`` over the item's distinct
terms, where ``w = floor(1000 ln((2N + 2) / (2 df + 1)))`` and
``m = 10 + (90 n N) div L``; all but the logarithm is 64-bit integer.

Plan: one pass keeps of every document its length and the counts of the
items' terms (staged); document frequencies, N and L are sums over that
table.  A second pass takes blocks of documents.  In a block, each of an
item's terms is a bitmap over the documents; the bitmaps group the documents
by the mask of terms present.  A mask's maximum score adds the largest weight
that each present term has in the block.  Masks are evaluated by descending
maximum score until the k-th best score found exceeds what is left; the
blocks' best meet in one ranking per item.

Items are searched in groups of at most about ``ITEM_TERMS`` terms, so what
a task holds of them is bounded; every group is one more pass over the
documents.

Defined results: null texts have no terms; such documents count in nothing
and are not found, such items have no rows; items that share an id (null is
an id) are one item with the terms of all; repeated documents are ranked one
by one, null doc_ids after all others; other columns are ignored; empty
tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trueline.llm.common import stage

#: Terms of the items that one pass searches for.
ITEM_TERMS = 1_000_000
#: Documents of a block.
BLOCK = 8192
#: Masks evaluated at once.
STRIDE = 64

#: Bytes of UTF-8 text: A-Z to a-z; what is no letter, digit or part of a
#: character beyond ASCII to a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _count_terms(vocabulary):
    """(doc_id, n, terms, counts) of every document that has a term."""
    def run(batches):
        known = vocabulary.value
        for batch in batches:
            ids, lengths, terms, counts = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(text.as_buffer().to_pybytes()) if text.is_valid else ()
                if not words:
                    continue
                found = [(known[t], n) for t, n in Counter(words).items() if t in known]
                ids.append(doc_id)
                lengths.append(len(words))
                terms.append([t for t, _ in found])
                counts.append([n for _, n in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "counts"])
    return run


def _frequencies(size: int):
    """Per task: (term, documents that hold it)."""
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())],
                                         names=["term", "n"])
    return run


def masks(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group columns of a boolean (term, document) matrix: the distinct masks
    as columns, and each document's mask."""
    bits = np.packbits(present, axis=0)
    words = np.zeros((-(-len(bits) // 8) * 8, bits.shape[1]), np.uint8)
    words[:len(bits)] = bits
    words = np.ascontiguousarray(words.T).view(np.uint64)
    if words.shape[1] == 1:
        _, first, group = np.unique(words.ravel(), return_index=True, return_inverse=True)
    else:
        key = np.ascontiguousarray(words).view(np.dtype((np.void, 8 * words.shape[1]))).ravel()
        _, first, group = np.unique(key, return_index=True, return_inverse=True)
    return present[:, first], group.ravel()


class Block:
    """Postings of a block of documents, by term."""

    def __init__(self, ids, lengths, owners, terms, counts, documents: int, total: int):
        by = np.argsort(terms, kind="stable")
        self.terms, self.docs, tf = terms[by], owners[by], counts[by]
        m = 10 + (90 * lengths * documents) // total
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.docs])
        self.ids = ids

    def postings(self, term: int) -> slice:
        return slice(*np.searchsorted(self.terms, [term, term + 1]))

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[int | None, int]]:
        """The block's k best (doc_id, score) for an item, unordered."""
        rows = [self.postings(t) for t in terms]
        used = [j for j, r in enumerate(rows) if r.stop > r.start]
        if not used:
            return []
        bitmaps = np.zeros((len(used), len(self.ids)), bool)
        value = np.zeros((len(used), len(self.ids)), np.int64)
        top = np.zeros(len(used), np.int64)
        for i, j in enumerate(used):
            docs, part = self.docs[rows[j]], weights[j] * self.impact[rows[j]]
            bitmaps[i, docs], value[i, docs], top[i] = True, part, part.max()
        some = np.flatnonzero(bitmaps.any(axis=0))
        kinds, group = masks(bitmaps[:, some])
        most = top @ kinds
        members = np.argsort(group, kind="stable")
        edge = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(most)))])
        found: list[tuple[int, int, int | None]] = []
        order = np.argsort(-most, kind="stable")
        for begin in range(0, len(order), STRIDE):
            part = order[begin:begin + STRIDE]
            if len(found) == k and most[part[0]] < found[-1][0]:
                break
            docs = some[np.concatenate([members[edge[g]:edge[g + 1]] for g in part])]
            score = value[:, docs].sum(axis=0)
            if len(found) == k:
                keep = score >= found[-1][0]
                docs, score = docs[keep], score[keep]
            found += [(int(s), d) for s, d in zip(score, docs) if s > 0]
            found = sorted(found, key=lambda x: (-x[0], *self._rank(x[1])))[:k]
        return [(self.ids[d], s) for s, d in found]

    def _rank(self, doc: int) -> tuple[bool, int]:
        doc_id = self.ids[doc]
        return doc_id is None, doc_id or 0


def _search_blocks(items, k: int, documents: int, total: int):
    def run(batches):
        keys, terms, weights = items.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                lists = part.column(2)
                sizes = np.diff(lists.offsets.to_numpy())
                block = Block(part.column(0).to_pylist(), part.column(1).to_numpy(zero_copy_only=False),
                              np.repeat(np.arange(part.num_rows), sizes),
                              lists.flatten().to_numpy(zero_copy_only=False),
                              part.column(3).flatten().to_numpy(zero_copy_only=False), documents, total)
                out = [(i, *x) for i in range(len(keys)) for x in block.best(terms[i], weights[i], k)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()),
                     pa.array([x[2] for x in out], pa.int64())], names=["item", "doc_id", "score"])
    return run


def _item_terms(batches):
    for batch in batches:
        ids, out = [], []
        for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if text.is_valid:
                ids.append(item_id)
                out.append(sorted(set(terms_of(text.as_buffer().to_pybytes()))))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.binary()))],
                                         names=["item_id", "terms"])


def _search_group(docs: DataFrame, items: list, k: int) -> DataFrame:
    spark = docs.sparkSession
    context = spark.sparkContext
    number = {t: j for j, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    vocabulary = context.broadcast(number)
    counted = stage(docs.mapInArrow(_count_terms(vocabulary), "doc_id long, n long, terms array<int>, counts array<long>"),
                    "terms")
    documents, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = counted.select("terms").mapInArrow(_frequencies(len(number)), "term int, n long").groupBy("term").agg(
        F.sum("n").alias("df"))
    weight = np.zeros(len(number), np.int64)
    for row in held.toLocalIterator():
        weight[row["term"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * row["df"] + 1)))
    terms = [np.array([number[t] for t in own], np.int64) for _, own in items]
    found = context.broadcast(([key for key, _ in items], terms, [weight[t] for t in terms]))
    local = counted.mapInArrow(_search_blocks(found, k, documents, max(1, total)), "item int, doc_id long, score long")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    keys = spark.createDataFrame([(j, key) for j, (key, _) in enumerate(items)], "item int, item_id long")
    ranked = local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(keys), "item").select("item_id", F.col("rank").cast("int").alias("rank"),
                                                         "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank from 1, doc_id, score): the k documents of ``docs``
    (doc_id, text) that score highest, above 0, for each item (item_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = stage(items.select(F.col("item_id").cast("long").alias("item_id"), "text")
                   .mapInArrow(_item_terms, "item_id long, terms array<binary>")
                   .select("item_id", F.explode("terms").alias("term")).distinct(), "items")
    n_groups = max(1, -(-wanted.count() // ITEM_TERMS))
    out = None
    for g in range(n_groups):
        mine = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(n_groups)) == g)
        by_item: dict = {}
        for row in mine.toLocalIterator():
            by_item.setdefault(row["item_id"], []).append(bytes(row["term"]))
        if by_item:
            part = _search_group(docs, sorted(by_item.items(), key=lambda x: (x[0] is None, x[0] or 0)), k)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
