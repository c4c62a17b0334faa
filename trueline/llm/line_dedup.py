"""Incremental, reversible line dedup (exact reference counts + cuckoo filters).

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at both
ends and with A-Z lower-cased; keys of at least ``MIN_KEY`` code points
count.  A key is stored as its 128-bit hash (two longs).

State, all Parquet under one root folder in the shared storage:

* ``refs``   (k1, k2, doc_id): which document holds which key, one folder per
  insertion; ``gone`` lists deleted documents with their generation.
* ``counts`` (k1, k2, n_docs, min_doc, gen): exact reference counts,
  one folder per change.  A row is the key's value as of its generation, the
  newest row of a key counts.
* ``filters`` (shard, n_buckets, n_keys, slots, gen): a cuckoo filter per shard
  holding the keys with a positive count.

``insert`` probes the filters first: a key they do not know is new for
certain and its batch count is its count, so only possibly known keys are
looked up in the exact table.  ``delete`` recounts the keys of the deleted
documents from the references and takes vanished keys out of the filters;
after it the index equals one that never saw them.  Filters only save work:
every decision comes from the exact counts.

The number of shards grows with the keys: when an insertion leaves a filter
too full, or has more keys than the shards are meant for, all filters are built
anew from the exact counts, with more shards, in the same generation (a batch
that large is looked up in the exact table without probing).

Shards are by key hash and counts are aggregated per key before anything is
grouped by shard, so a line held by a third of all documents costs one row
per shard step.  A null ``text`` is one empty line.  A null ``doc_id``
counts as one document ordered after all others.  Repeated rows of a
``doc_id`` are one document for counting, and each row loses the same lines.
Columns other than ``doc_id``, ``text`` and those in ``carry`` are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trueline.llm.common import work_dir

MIN_KEY = 10
STRIPPED = " \t\n\x0b\x0c\r"
#: Distinct keys a shard is meant for; shards are added from ``GROW`` times as
#: many, or when a filter's slots are filled to more than ``FULL``.
KEYS_PER_SHARD, GROW, FULL = 16_384, 2, 0.85
NULL_DOC = 2**63 - 1


# --- cuckoo filter, vectorised over numpy arrays ----------------------------

SLOTS = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    """Four 16-bit fingerprints per bucket; two buckets per key by partial-key
    cuckoo hashing.  Supports insertion, lookup and deletion of 64-bit hashes."""

    def __init__(self, n_buckets: int, table: np.ndarray | None = None):
        self.n = n_buckets  # a power of two
        self.table = np.zeros((n_buckets, SLOTS), dtype=np.uint16) if table is None else table

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, n) / (0.8 * SLOTS) + 1)))))

    def _parts(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = hashes.astype(np.uint64)
        mark = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        return mark, (h & np.uint64(self.n - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        jump = ((mark.astype(np.uint64) * _MIX) >> np.uint64(32)) & np.uint64(self.n - 1)
        return bucket ^ jump.astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, a = self._parts(hashes)
        b = self._other(a, mark)
        return ((self.table[a] == mark[:, None]) | (self.table[b] == mark[:, None])).any(axis=1)

    def _fill(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Put marks into free slots of their buckets; returns who got one."""
        done = np.zeros(len(mark), dtype=bool)
        for slot in range(SLOTS):
            todo = np.flatnonzero(~done)
            if not len(todo):
                break
            free = todo[self.table[bucket[todo], slot] == 0]
            _, first = np.unique(bucket[free], return_index=True)
            won = free[first]
            self.table[bucket[won], slot] = mark[won]
            done[won] = True
        return done

    def insert(self, hashes: np.ndarray, kicks: int = 500) -> bool:
        """Insert all; False if the filter is too full (the caller rebuilds
        it larger from the exact table)."""
        mark, bucket = self._parts(hashes)
        rng = np.random.default_rng(7)
        for _ in range(kicks):
            done = self._fill(bucket, mark)
            mark, bucket = mark[~done], bucket[~done]
            bucket = self._other(bucket, mark)
            done = self._fill(bucket, mark)
            mark, bucket = mark[~done], bucket[~done]
            if not len(mark):
                return True
            # One homeless mark per bucket takes a slot; the evicted one moves on.
            _, first = np.unique(bucket, return_index=True)
            slot = rng.integers(0, SLOTS, len(first))
            out = self.table[bucket[first], slot].copy()
            self.table[bucket[first], slot] = mark[first]
            mark[first] = out
            bucket[first] = self._other(bucket[first], out)
        return False

    def delete(self, hashes: np.ndarray) -> None:
        """Remove one copy per hash (only hashes that were inserted)."""
        mark, a = self._parts(hashes)
        for m, x, y in zip(mark, a, self._other(a, mark)):
            for bucket in (x, y):
                hit = np.flatnonzero(self.table[bucket] == m)
                if len(hit):
                    self.table[bucket, hit[0]] = 0
                    break


def build_filter(hashes: np.ndarray) -> CuckooFilter:
    """A filter that holds all hashes, doubled until they fit."""
    f = CuckooFilter.for_keys(len(hashes))
    while not f.insert(hashes):
        f = CuckooFilter(f.n * 2)
    return f


# --- lines ------------------------------------------------------------------

def line_keys(lines: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """(does the line count, the 16-byte key hashes of those that do)."""
    keys = pc.ascii_lower(pc.ascii_trim(lines, characters=STRIPPED))
    counts = pc.greater_equal(pc.utf8_length(keys), MIN_KEY)
    digests = list(map(xxhash.xxh3_128_digest, keys.filter(counts).to_pylist()))
    return counts.to_numpy(zero_copy_only=False), digests


def split_lines(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines of all texts, and the row each comes from."""
    parts = pc.split_pattern(text, "\n")
    return parts.flatten(), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)


def document_keys(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id): the distinct counting keys of each document row."""
    def run(batches):
        for b in batches:
            lines, row = split_lines(b.column(1))
            counts, digests = line_keys(lines)
            key = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            doc = b.column(0).to_numpy(zero_copy_only=False)[row[counts]]
            out = pd.DataFrame({"k1": key[:, 0], "k2": key[:, 1], "doc_id": doc}).drop_duplicates()
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return _texts(docs).mapInArrow(run, "k1 long, k2 long, doc_id long")


def _texts(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_DOC)).alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"), *carry)


def kept_lines(docs: DataFrame, drops: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rebuild each text without the lines whose key is in the document's
    row of ``drops`` (doc_id, keys: array of (k1, k2))."""
    joined = _texts(docs, carry).join(drops, "doc_id", "left")
    schema = StructType([*(docs.schema[c] for c in carry)])
    schema = schema.add("doc_id", "long").add("n_lines", "long").add("n_dropped", "long").add("text", "string")

    def run(batches):
        for b in batches:
            text = b.column("text")
            n_lines = pc.add(pc.count_substring(text, "\n"), 1).to_numpy(zero_copy_only=False).astype(np.int64)
            n_dropped = np.zeros(len(n_lines), dtype=np.int64)
            where = np.flatnonzero(b.column("keys").is_valid().to_numpy(zero_copy_only=False))
            if len(where):
                out = text.to_pylist()
                lists = b.column("keys").take(pa.array(where))
                flat = lists.flatten()
                raw = np.column_stack([flat.field(0).to_numpy(), flat.field(1).to_numpy()]).astype("<i8").tobytes()
                ends = np.cumsum(pc.list_value_length(lists).to_numpy()).tolist()
                begin = 0
                for i, end in zip(where.tolist(), ends):
                    gone = {raw[16 * k:16 * k + 16] for k in range(begin, end)}
                    begin = end
                    lines = out[i].split("\n")
                    counts, digests = line_keys(pa.array(lines, pa.string()))
                    drop = np.zeros(len(lines), dtype=bool)
                    drop[counts] = [d in gone for d in digests]
                    out[i] = "\n".join([x for x, d in zip(lines, drop.tolist()) if not d])
                    n_dropped[i] = drop.sum()
                text = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in carry), b.column("doc_id"), pa.array(n_lines), pa.array(n_dropped), text],
                schema.names)

    out = joined.mapInArrow(run, schema)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_DOC)))


# --- the index --------------------------------------------------------------

KEY = ["k1", "k2"]
FILTER_SCHEMA = "shard long, n_buckets long, n_keys long, slots binary"


def _load(row: pd.DataFrame) -> CuckooFilter | None:
    if not len(row):
        return None
    n = int(row["n_buckets"].iloc[0])
    return CuckooFilter(n, np.frombuffer(row["slots"].iloc[0], dtype=np.uint16).reshape(n, SLOTS).copy())


def _dump(shard: int, f: CuckooFilter) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "n_buckets": [f.n], "n_keys": [int((f.table != 0).sum())],
                         "slots": [f.table.tobytes()]})


def _probe(keys: pd.DataFrame, row: pd.DataFrame) -> pd.DataFrame:
    f = _load(row)
    keys["known"] = False if f is None else f.contains(keys["k2"].to_numpy().view(np.uint64))
    return keys[["k1", "k2", "n_docs", "min_doc", "known"]]


def _change(keys: pd.DataFrame, row: pd.DataFrame) -> pd.DataFrame:
    """Apply a shard's arrivals (n > 0) and departures (n < 0) to its filter."""
    f = _load(row)
    shard = int((keys if len(keys) else row)["shard"].iloc[0])
    if len(keys):
        hashes, up = keys["k2"].to_numpy().view(np.uint64), keys["n"].to_numpy() > 0
        new = hashes[up]
        if f is None:
            f = build_filter(new)
        else:
            f.delete(hashes[~up])
            if not f.insert(new):
                raise RuntimeError(f"filter of shard {shard} is full: rebuild the index with more shards")
    return _dump(shard, f)


class LineIndex:
    """The state under ``root``; see the module text."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or work_dir(spark, "line-index")
        self.gen, self.n_shards, self.n_keys, self.deletions = 0, 0, 0, False

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> LineIndex:
        """An existing index, as of its last finished change."""
        index = cls(spark, root)
        last = spark.read.parquet(f"{root}/manifest").orderBy(F.desc("gen")).first()
        index.gen, index.n_shards, index.deletions = last["gen"], last["n_shards"], last["deletions"]
        index.n_keys = last["n_keys"]
        return index

    def _write(self, df: DataFrame, table: str) -> DataFrame:
        path = f"{self.root}/{table}/gen={self.gen + 1}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _commit(self) -> None:
        row = self.spark.range(1).select(F.lit(self.n_shards).cast("long").alias("n_shards"),
                                         F.lit(self.n_keys).cast("long").alias("n_keys"),
                                         F.lit(self.deletions).alias("deletions"))
        self._write(row, "manifest")
        self.gen += 1

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}").where(F.col("gen") <= self.gen)

    def refs(self) -> DataFrame:
        """(k1, k2, doc_id) of all live documents."""
        refs = self._read("refs")
        if self.deletions:
            gone = self._read("gone").groupBy("doc_id").agg(F.max("gen").alias("gone_gen"))
            refs = refs.join(gone, "doc_id", "left").where("gone_gen is null or gone_gen < gen")
        return refs.select(*KEY, "doc_id")

    def counts(self, gen: int | None = None) -> DataFrame:
        """(k1, k2, n_docs, min_doc): exact counts of all keys ever seen."""
        gen = self.gen if gen is None else gen
        counts = self.spark.read.parquet(f"{self.root}/counts").where(F.col("gen") <= gen)
        if gen > 1:
            counts = (counts.groupBy(*KEY).agg(F.max_by(F.struct("n_docs", "min_doc"), "gen").alias("v"))
                      .select(*KEY, "v.n_docs", "v.min_doc"))
        return counts.select(*KEY, "n_docs", "min_doc")

    def _shard(self) -> Column:
        return F.pmod("k1", F.lit(self.n_shards).cast("long")).alias("shard")

    def _filters(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/filters/gen={self.gen}")

    def _write_filters(self, changes: DataFrame) -> None:
        """``changes``: (k1, k2, n) with n > 0 for new keys, n < 0 for gone ones."""
        keyed = changes.select("k2", "n", self._shard())
        self._write(keyed.groupBy("shard").cogroup(self._filters().groupBy("shard")).applyInPandas(
            _change, FILTER_SCHEMA), "filters")

    def _build_filters(self, live: DataFrame) -> None:
        """New filters over ``live`` (k1, k2), in as many shards as the keys need."""
        none = pd.DataFrame()
        self.n_shards = max(1, -(-self.n_keys // KEYS_PER_SHARD))
        self._write(live.select("k2", F.lit(1).alias("n"), self._shard()).groupBy("shard").applyInPandas(
            lambda keys: _change(keys, none), FILTER_SCHEMA), "filters")

    def _too_full(self, arrived: DataFrame) -> bool:
        """Would the new keys fill a shard's filter to more than ``FULL``?"""
        new = arrived.select(self._shard()).groupBy("shard").count()
        room = self._filters().select("shard", "n_keys", (SLOTS * F.col("n_buckets") * FULL).alias("most"))
        return not new.join(room, "shard").where(F.col("n_keys") + F.col("count") > F.col("most")).isEmpty()

    def insert(self, docs: DataFrame) -> None:
        """Add documents (not yet in the index) and their lines."""
        new = document_keys(docs).dropDuplicates()
        if self.gen:
            new = new.join(self.refs(), [*KEY, "doc_id"], "left_anti")
        refs = self._write(new, "refs")
        batch = refs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("min_doc"))
        if not self.gen:
            counts = self._write(batch, "counts")
            self.n_keys = counts.count()
            self._build_filters(counts)
        else:
            batch = self._write(batch, "batch")
            grow = self.n_keys + batch.count() > GROW * KEYS_PER_SHARD * self.n_shards
            probed = batch.withColumn("known", F.lit(True)) if grow else self._write(
                batch.select("*", self._shard()).groupBy("shard").cogroup(self._filters().groupBy("shard")).applyInPandas(
                    _probe, "k1 long, k2 long, n_docs long, min_doc long, known boolean"), "probed")
            known = probed.where("known").select(*KEY)
            old = self.counts().join(known, KEY, "left_semi").select(
                *KEY, F.col("n_docs").alias("o_n"), F.col("min_doc").alias("o_min"))
            merged = probed.join(old, KEY, "left").select(
                *KEY, (F.col("n_docs") + F.coalesce("o_n", F.lit(0))).alias("n_docs"),
                F.least("min_doc", F.when(F.col("o_n") > 0, F.col("o_min"))).alias("min_doc"),
                (F.coalesce("o_n", F.lit(0)) == 0).alias("arrived"))
            merged = self._write(merged, "merged")
            self._write(merged.drop("arrived"), "counts")
            arrived = merged.where("arrived")
            self.n_keys += arrived.count()
            if grow or self._too_full(arrived):
                self._build_filters(self.counts(self.gen + 1).where("n_docs > 0"))
            else:
                self._write_filters(arrived.select(*KEY, F.lit(1).alias("n")))
        self._commit()

    def delete(self, doc_ids: DataFrame) -> None:
        """Take documents (column ``doc_id``) and their lines out again."""
        ids = doc_ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_DOC)).alias("doc_id")).distinct()
        refs = self.refs()
        touched = refs.join(ids, "doc_id", "left_semi").select(*KEY).distinct()
        left = refs.join(ids, "doc_id", "left_anti").join(touched, KEY, "left_semi").groupBy(*KEY).agg(
            F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("min_doc"))
        counts = self._write(touched.join(left, KEY, "left").select(
            *KEY, F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "min_doc"), "counts")
        self._write(ids, "gone")
        vanished = counts.where("n_docs = 0")
        self.n_keys -= vanished.count()
        self._write_filters(vanished.select(*KEY, F.lit(-1).alias("n")))
        self.deletions = True
        self._commit()

    def drops(self) -> DataFrame:
        """(doc_id, keys): the keys whose lines each live document loses."""
        repeated = self.counts().where("n_docs > 1").select(*KEY, "min_doc")
        return (self.refs().join(repeated, KEY).where("doc_id <> min_doc")
                .groupBy("doc_id").agg(F.collect_list(F.struct(*KEY)).alias("keys")))

    def dedupe(self, docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
        """Inserted documents without their repeated lines: the ``carry``
        columns, doc_id, n_lines (before), n_dropped, text."""
        return kept_lines(docs, self.drops(), carry)


def dedupe_lines(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One-shot form: insert all documents into a new index and dedupe them."""
    index = LineIndex(docs.sparkSession)
    index.insert(docs)
    return index.dedupe(docs, carry)
