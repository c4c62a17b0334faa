"""The thin ``opN_<name>`` queries: each applies its operator, with
production parameters, to the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trueline.llm import (conversation_repair, decontam, html_extract, knn, langid, lexical_search, license_scan,
                          line_dedup, packing, pii, sharding, simhash, substring_dedup)
from trueline.llm.oracles import ORACLE_SQL  # noqa: F401  (for the entry point)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def file_tree(docs: DataFrame) -> DataFrame:
    """Stand-in for a table of source files (doc_id, path, text): documents
    get a path from source and id; every 40th is named LICENSE and stands in a
    directory one to four levels deep.  Texts are used as they are."""
    level = lambda n: F.concat(F.lit("d"), F.floor(F.col("doc_id") / n).cast("string"))
    steps = F.array(F.col("source"), level(10_000), level(1_000), level(100))
    is_licence = F.col("doc_id") % 40 == 0
    depth = F.when(is_licence, 1 + F.floor(F.col("doc_id") / 40) % 4).otherwise(4).cast("int")
    name = F.when(is_licence, F.lit("LICENSE")).otherwise(F.concat(F.lit("f"), F.col("doc_id").cast("string")))
    return docs.select("doc_id", F.concat_ws("/", F.slice(steps, F.lit(1), depth), name).alias("path"), "text")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document as a file: its own or its nearest licensed
    ancestor directory's."""
    files = file_tree(_table(spark, sf_dir, "documents"))
    return license_scan.scan(files, carry=("doc_id",))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted into a new line index, then deduped by it."""
    kept = line_dedup.dedupe_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles over all documents, linked at 4 or
    fewer differing bits."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; counts and digest of the base spans,
    list of all spans."""
    found = pii.per_document(pii.find_spans(_table(spark, sf_dir, "documents")))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)],
                        F.sha2(pii.listing(base), 256).alias("base_sha256"),
                        pii.listing(F.col("spans")).alias("spans"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those not held out."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.train(docs.where("not held_out"))
    return langid.identify(docs, model, carry=("doc_id", "held_out"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every vector whose id is divisible by 20."""
    return knn.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose row counts differ by one at most."""
    return sharding.interleave(_table(spark, sf_dir, "documents"), shards=16, seed=42).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(_table(spark, sf_dir, "pages"), carry=("page_id", "url"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of whose five-word shingles it holds
    at least 0.8."""
    return decontam.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"),
                                    words=5, threshold=0.8)


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, their faults and their cheapest repair."""
    rows = _table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damage(rows), rows.select("conv_id").distinct())


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that a smaller document holds, removed."""
    found = substring_dedup.dedupe_substrings(_table(spark, sf_dir, "documents"), length=50)
    span = lambda s: s[1] - s[0]
    return found.select("doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + span(s)).alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_pii": op5_pii,
    "op6_language_id": op6_language_id,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_sharding": op8_sharding,
    "op9_html_extraction": op9_html_extraction,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_ranked_lexical_search": op11_ranked_lexical_search,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_suffix_array_dedup": op13_suffix_array_dedup,
}
