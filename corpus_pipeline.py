"""Corpus preparation: stages over ``documents``, each written as Parquet and
read back as the next stage's input.

Every stage but the last returns the columns of ``documents``; each works on
all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trueline.llm import decontam, langid, line_dedup, packing, simhash
from trueline.llm.common import stage
from trueline.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text scoring less in its best language is rejected.
MIN_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no letter at all, or words that no
    learned language explains (best score below MIN_SCORE)."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs, model, carry=COLUMNS)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in several documents stay in the smallest doc_id only;
    texts and n_chars change, no document goes."""
    kept = line_dedup.dedupe_lines(docs, carry=("lang", "source"))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component (4-word shingles, at most 4 differing bits) one
    document stays."""
    return simhash.keep_one(docs, COLUMNS, words=4, distance=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item (0.8 of its five-word
    shingles)."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.decontaminate(docs.select(*COLUMNS), items, words=5, threshold=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedupe_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: No stage can be written as SQL as a whole (learned language model,
#: fingerprints, tokenizer); the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"stage{k}")
    return docs
