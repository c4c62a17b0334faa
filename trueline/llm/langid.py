"""Language identification with word-first backoff.

Training counts words per language over all labelled training documents and
character n-grams over the words so counted.  All of them are learned and stay
in tables keyed by entry.  What goes to the tasks is a cache of the most
frequent ones (``WORD_LIMIT``, ``GRAM_LIMIT``); words that are not in it are
looked up by joins, so the size of the cache has no influence on the result.

A text is scored word by word.  A known word adds its log frequency in each
language (relative to the language where it is most frequent, with a floor, and
counted from that floor).  An unseen word falls back to its character n-grams: the
longest order that has a known n-gram decides, by the mean log frequency of
its known n-grams; shorter orders are tried in turn, and a word without any
known n-gram adds nothing.  The score is the softmax of the sums, tempered
by the square root of the number of words so that long texts do not all
score 1.  Scores are whole multiples of 1 / ``UNIT``, so sums do not depend on
their order.

Words are runs of letters of the lower-cased text.  A null text or one
without a letter is ``und`` with score 0, as is every text if nothing could
be learned.  Ties go to the language that sorts first.  Repeated rows are
predicted alike; a null label is not learned from.  Prediction reads the
text only.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trueline.llm.common import stage

#: Entries in the tasks' caches.
WORD_LIMIT, GRAM_LIMIT = 100_000, 100_000
ORDERS = (4, 3, 2, 1)
#: Longer words are kept out of the workers' caches.
WORD_LENGTH = 40
FLOOR = 0.01
UNIT = 1 << 20
ENTRY = "array<struct<lang:int,v:bigint>>"
CACHE_WORDS = 200_000
#: Words counted up to so often share the counting of their n-grams.
ALIKE = 8
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


def grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>" if n > 1 else word
    return [padded[k:k + n] for k in range(len(padded) - n + 1)]


def held_out(doc_id: Column) -> Column:
    """True for the third of documents that nothing is learned from (a null
    id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def _by_entry(rows: DataFrame) -> DataFrame:
    """(word, langs array<struct<lang, n>>) from (lang, word, n) rows that the
    tasks have counted: one exchange, by word, serves both groupings."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(tasks, "word").groupBy("word", "lang").agg(F.sum("n").alias("n"))
            .groupBy("word").agg(F.collect_list(F.struct("lang", "n")).alias("langs")))


def _counted(counts: dict[str, Counter]) -> pa.RecordBatch:
    size = sum(map(len, counts.values()))
    words = pa.array((w for c in counts.values() for w in c), pa.string(), size=size)
    n = pa.array((n for c in counts.values() for n in c.values()), pa.int64(), size=size)
    langs = pa.DictionaryArray.from_arrays(
        pa.array(np.repeat(np.arange(len(counts)), [len(c) for c in counts.values()]), pa.int32()),
        pa.array(list(counts), pa.string())).cast(pa.string())
    return pa.RecordBatch.from_arrays([langs, words, n], ["lang", "word", "n"])


def _word_table(training: DataFrame) -> DataFrame:
    """(word, langs) over all rows of ``training`` (text, lang)."""
    def run(batches):
        for b in batches:
            counts: dict[str, Counter] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
            yield _counted(counts)

    rows = training.where("text is not null and lang is not null").select("text", "lang")
    return _by_entry(rows.mapInArrow(run, "lang string, word string, n long"))


def word_counts(training: DataFrame) -> DataFrame:
    """(lang, word, n) over all rows of ``training`` (text, lang)."""
    return _word_table(training).select(F.inline("langs"), "word").select("lang", "word", "n")


def gram_counts(words: DataFrame) -> DataFrame:
    """(word, langs) of the n-grams over the counted words, all orders."""
    def run(batches):
        for b in batches:
            counts: dict[str, Counter] = {}
            alike: dict[tuple[str, int], Counter] = {}       # words that count the same are counted together
            for word, langs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = [g for order in ORDERS for g in grams(word, order)]
                for x in langs:
                    if x["n"] <= ALIKE:
                        alike.setdefault((x["lang"], x["n"]), Counter()).update(own)
                    else:
                        c = counts.setdefault(x["lang"], Counter())
                        for g in own:
                            c[g] += x["n"]
            for (lang, n), same in alike.items():
                c = counts.setdefault(lang, Counter())
                for g, k in same.items():
                    c[g] += n * k
            yield _counted(counts)

    return _by_entry(words.mapInArrow(run, "lang string, word string, n long"))


def _entries(counts: DataFrame, languages: list[str], orders: bool) -> DataFrame:
    """(word, total, scores) of every counted entry.  A score is the log of the
    entry's relative frequency in a language, relative to the language where it
    is most frequent and counted from log(FLOOR), so neither the amount of text
    learned per language nor a single word decides; languages without the entry
    score 0 and are left out.  N-grams are relative to their own order."""
    kind = F.char_length("word") if orders else F.lit(0)
    counts = counts.withColumn("kind", kind)
    sums = {(r["kind"], r["lang"]): r["n"] for r in counts.select("kind", F.inline("langs")).groupBy("kind", "lang")
            .agg(F.sum("n").alias("n")).collect()}
    kinds = sorted({k for k, _ in sums})
    totals = F.create_map(*[x for k in kinds for x in (F.lit(k), F.create_map(*[
        y for j, lang in enumerate(languages) if (k, lang) in sums
        for y in (F.lit(lang), F.struct(F.lit(j).alias("at"), F.lit(sums[k, lang]).alias("of")))]))]) if sums else None
    if totals is None:
        return counts.sparkSession.createDataFrame([], f"word string, total long, scores {ENTRY}")
    of = lambda x: F.col("totals")[x["lang"]]
    shares = F.transform("langs", lambda x: F.struct(of(x)["at"].alias("lang"), (x["n"] / of(x)["of"]).alias("share")))
    total = F.aggregate("langs", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    per = (counts.withColumn("totals", totals[F.col("kind")]).select("word", total.alias("total"), shares.alias("langs"))
           .withColumn("best", F.array_max(F.transform("langs", lambda x: x["share"]))))
    score = lambda x: F.log(x["share"] / F.col("best") / FLOOR + 1) * UNIT
    scores = F.transform("langs", lambda x: F.struct(x["lang"].alias("lang"), F.round(score(x)).cast("long").alias("v")))
    return stage(per.select("word", "total", scores.alias("scores")), "entries")


def _cache(entries: DataFrame, limit: int, width: int) -> tuple[dict[str, int], np.ndarray, bool]:
    """The most frequent entries with their scores, and whether these are all:
    all entries of at most WORD_LENGTH characters whose total reaches the
    smallest bound that at most ``limit`` entries reach.  Bounds are eighths of
    powers of two, so the driver reads a histogram of a few hundred rows, then
    at most ``limit`` entries."""
    short = F.char_length("word") <= WORD_LENGTH
    step = F.floor(8 * F.log2("total")).cast("int")
    left, least, whole = limit, None, True
    for r in sorted(entries.groupBy(short.alias("short"), step.alias("step")).count().collect(),
                    key=lambda r: (r["short"], r["step"]), reverse=True):
        left -= r["count"]
        if left < 0 or not r["short"]:
            whole = False
            break
        least = r["step"]
    rows = [] if least is None else entries.where(short & (step >= least)).collect()
    scores = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        for x in r["scores"]:
            scores[i, x["lang"]] = x["v"]
    return {r["word"]: i for i, r in enumerate(rows)}, scores, whole


@dataclass
class Model:
    """Scores per language: caches of frequent entries, bounded by WORD_LIMIT
    and GRAM_LIMIT, and the tables of all entries where the caches do not hold
    all of them."""

    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray
    tables: tuple[DataFrame, DataFrame] | None = None

    def cached_order(self, word: str) -> tuple[int, list[int]]:
        """The longest order with a cached n-gram (0 if none has) and its
        cached n-grams."""
        for n in ORDERS:
            rows = [i for i in map(self.grams.get, grams(word, n)) if i is not None]
            if rows:
                return n, rows
        return 0, []

    def backoff(self, word: str) -> np.ndarray | None:
        rows = self.cached_order(word)[1]
        return self.gram_scores[rows].sum(axis=0) // len(rows) if rows else None


def train(training: DataFrame) -> Model:
    """Learn from (text, lang)."""
    words = stage(_word_table(training), "word-counts")
    languages = sorted(r["lang"] for r in words.select(F.inline("langs")).select("lang").distinct().collect())
    parts = stage(gram_counts(words), "gram-counts")
    tables = _entries(words, languages, False), _entries(parts, languages, True)
    *word_cache, all_words = _cache(tables[0], WORD_LIMIT, len(languages))
    *gram_cache, all_grams = _cache(tables[1], GRAM_LIMIT, len(languages))
    return Model(languages, *word_cache, *gram_cache, None if all_words and all_grams else tables)


class Predictor:
    """Scores texts; remembers the backoff of unseen words up to a bound."""

    def __init__(self, model: Model):
        self.model, self.unseen = model, {}

    def _unseen(self, word: str) -> np.ndarray | None:
        if word not in self.unseen:
            if len(word) > WORD_LENGTH:
                return self.model.backoff(word)
            if len(self.unseen) >= CACHE_WORDS:
                self.unseen.clear()
            self.unseen[word] = self.model.backoff(word)
        return self.unseen[word]

    def cached(self, text: str | None) -> tuple[int, np.ndarray, list[tuple[str, int]]]:
        """Number of words (0 for a text without a letter), sum of the scores
        of cached words, and the other words with their counts."""
        m = self.model
        words = WORD.findall(text.lower()) if text else []
        total = np.zeros(len(m.languages), dtype=np.int64)
        if not m.languages or not any(w.isalpha() or any(map(str.isalpha, w)) for w in words):
            return 0, total, []
        counts = Counter(words)
        known = [(i, n) for i, n in zip(map(m.words.get, counts), counts.values()) if i is not None]
        if known:
            rows, n = zip(*known)
            total += np.array(n, dtype=np.int64) @ m.word_scores[list(rows)]
        return len(words), total, [(w, n) for w, n in counts.items() if w not in m.words]

    def decide(self, words: int, total: np.ndarray) -> tuple[str, float]:
        if not words:
            return UNKNOWN, 0.0
        z = np.exp((total - total.max()) / (UNIT * np.sqrt(words)))
        best = int(total.argmax())
        return self.model.languages[best], float(z[best] / z.sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        """For a model whose caches hold all entries."""
        words, total, others = self.cached(text)
        for w, n in others:
            s = self._unseen(w)
            if s is not None:
                total += n * s
        return self.decide(words, total)


def _backoff(words: DataFrame, shipped, grams_table: DataFrame) -> DataFrame:
    """(id, scores) of distinct words (word, id) by their n-grams.  Cached n-grams are
    summed in the tasks; those of the same or a longer order that are not
    cached are joined with the table of all."""
    entry = StructType.fromDDL(f"id long, kind int, gram string, times long, scores {ENTRY}")

    def run(batches):
        m = shipped.value
        for b in batches:
            rows = []
            for word, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                least, found = m.cached_order(word)
                if found:
                    total = m.gram_scores[found].sum(axis=0)
                    rows.append((key, least, None, len(found),
                                 [{"lang": int(k), "v": int(total[k])} for k in total.nonzero()[0]]))
                for order in ORDERS:
                    if order >= least:
                        rows += [(key, order, g, n, None) for g, n in Counter(grams(word, order)).items()
                                 if g not in m.grams]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(
                    (pa.int64(), pa.int32(), pa.string(), pa.int64(),
                     pa.list_(pa.struct([("lang", pa.int32()), ("v", pa.int64())]))))], entry.names)

    parts = stage(words.mapInArrow(run, entry), "gram-parts")
    looked = (parts.where("gram is not null").drop("scores")
              .join(grams_table.select(F.col("word").alias("gram"), "scores"), "gram")
              .select("id", "kind", "times", F.transform("scores", lambda x: F.struct(
                  x["lang"].alias("lang"), (x["v"] * F.col("times")).alias("v"))).alias("scores")))
    found = parts.where("gram is null").select("id", "kind", "times", "scores").unionByName(looked)
    # One row per language, and one without a language that counts the n-grams.
    one = F.struct(F.lit(-1).alias("lang"), F.col("times").alias("v"))
    sums = (found.select("id", "kind", F.explode(F.concat(F.array(one), "scores")).alias("x"))
            .groupBy("id", "kind", "x.lang").agg(F.sum("x.v").alias("v")))
    orders = sums.groupBy("id", "kind").agg(F.collect_list(F.struct("lang", "v")).alias("scores"))
    top = orders.groupBy("id").agg(F.max_by("scores", "kind").alias("scores"))
    times = F.filter("scores", lambda x: x["lang"] < 0)[0]["v"]
    top = top.select("id", "scores", times.alias("times"))
    mean = F.expr("transform(filter(scores, x -> x.lang >= 0), "
                  "x -> named_struct('lang', x.lang, 'v', x.v div times))")
    return top.select("id", mean.alias("scores"))


def _look_up(partial: DataFrame, shipped, tables: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(__row, __found: list of (lang, v)) sums for the words of ``partial`` that
    are not cached.  Words meet the table of learned ones once; what is not
    there is scored once per distinct word and joined again.  Hot words are
    split by AQE, for both sides of the joins are plain exchanges."""
    pairs = partial.select("__row", F.inline("__others").alias("word", "n"))
    met = stage(pairs.join(tables[0].select("word", "scores"), "word", "left")
                .select(F.when(F.col("scores").isNull(), F.col("word")).alias("word"), "__row", "n", "scores"), "met")
    unseen = met.where("word is not null").select("word", "__row", "n")
    words = stage(unseen.select("word").distinct().withColumn("id", F.monotonically_increasing_id()), "unseen")
    by_grams = words.join(_backoff(words, shipped, tables[1]), "id").select("word", "scores")
    found = met.where("scores is not null").select("__row", "n", "scores").unionByName(
        unseen.join(by_grams, "word").select("__row", "n", "scores"))
    one = found.select("__row", "n", F.inline("scores")).select("__row", "lang", (F.col("n") * F.col("v")).alias("v"))
    tasks = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (one.repartition(tasks, "__row").groupBy("__row", "lang").agg(F.sum("v").alias("v"))
            .groupBy("__row").agg(F.collect_list(F.struct("lang", "v")).alias("__found")))


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...]) -> DataFrame:
    """The ``carry`` columns with lang_pred and score of each row's text."""
    shipped = docs.sparkSession.sparkContext.broadcast(replace(model, tables=None))
    kept = StructType([docs.schema[c] for c in carry])
    schema = StructType([*kept.fields]).add("lang_pred", "string").add("score", "double")

    def answers(b, columns, found):
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array([f[0] for f in found], pa.string()),
             pa.array([f[1] for f in found], pa.float64())], schema.names)

    def run(batches):
        predictor = Predictor(shipped.value)
        for b in batches:
            yield answers(b, b.columns[1:], [predictor.predict(t) for t in b.column(0).to_pylist()])

    if model.tables is None:
        return docs.select(F.col("text").alias("__text"), *carry).mapInArrow(run, schema)

    own = StructType.fromDDL("__row long, __words int, __total array<bigint>, "
                             "__others array<struct<word:string,n:bigint>>")

    def first(batches):
        predictor = Predictor(shipped.value)
        for b in batches:
            found = [predictor.cached(t) for t in b.column(0).to_pylist()]
            others = pa.StructArray.from_arrays(
                [pa.array([w for f in found for w, _ in f[2]], pa.string()),
                 pa.array([n for f in found for _, n in f[2]], pa.int64())], ["word", "n"])
            ends = np.cumsum([0, *(len(f[2]) for f in found)])
            yield pa.RecordBatch.from_arrays(
                [b.column(1), pa.array([f[0] for f in found], pa.int32()),
                 pa.array([f[1] for f in found], pa.list_(pa.int64())),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), others), *b.columns[2:]],
                [*own.names, *kept.names])

    def last(batches):
        predictor = Predictor(shipped.value)
        for b in batches:
            if not len(b):
                continue
            totals = b.column(1).flatten().to_numpy().reshape(len(b), -1).copy()
            lang, v = b.column(2).flatten().flatten()
            row = pc.list_parent_indices(b.column(2)).to_numpy()
            np.add.at(totals, (row, lang.to_numpy()), v.to_numpy())
            found = [predictor.decide(w, t) for w, t in zip(b.column(0).to_pylist(), totals)]
            yield answers(b, b.columns[3:], found)

    # Row numbers are fixed by the staged files.
    partial = stage(docs.select(F.col("text").alias("__text"), F.monotonically_increasing_id().alias("__row"), *carry)
                    .mapInArrow(first, StructType([*own.fields, *kept.fields])), "cached-scores")
    looked = _look_up(partial, shipped, model.tables)
    return (partial.join(looked, "__row", "left")
            .select("__words", "__total", "__found", *carry).mapInArrow(last, schema))
