"""The queries opN_<name> and pipeline, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melder.llm import fill_middle, imatch, language_id, license_scan, minhash_dedup, mixing, packing, phrase_index, quality_knn, robust_quality, secret_scan, spelling, warc


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer() -> str:
    """The vocabulary file of the packing query; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's score by its labelled neighbours in a latent space."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_knn.classify(documents(spark, sf_dir).select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates, findings and the masked text of every document, as digests."""
    found = secret_scan.scan(documents(spark, sf_dir).select("doc_id", "text", "source"), path="source")
    return found.select(
        "doc_id",
        F.size("candidates").cast("long").alias("n_candidates"),
        F.size("findings").cast("long").alias("n_secrets"),
        F.coalesce(F.expr("array_max(transform(candidates, x -> x.score))"), F.lit(0.0)).alias("score"),
        F.array_join(F.array_sort(F.expr("transform(findings, x -> sha1(cast(x.secret as binary)))")), ",").alias("secrets_sha1"),
        F.expr("array_min(transform(findings, x -> x.at))").alias("first_at"),
        F.sha2(F.coalesce("redacted", F.lit("")).cast("binary"), 256).alias("redacted_sha256"),
    )


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen-path join on 4-word shingles at 0.8."""
    return minhash_dedup.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), width=4, percent=80)


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited one, with their likeness to each other and to the next."""
    return imatch.stability(documents(spark, sf_dir).select("doc_id", "text"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language whose learned text parses every text in the fewest phrases."""
    return language_id.identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives written from all pages and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return warc.round_trip(pages, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts of every text and whether rules and its group's spread keep it."""
    found = robust_quality.judge(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document's pieces in sequences of 2048 tokens."""
    return packing.pack(documents(spark, sf_dir).select("doc_id", "text"), tokenizer())


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of fixed phrases and labels of license texts in every document."""
    return license_scan.scan(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate draws them, shuffled."""
    return mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "lang", "source", "n_chars"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts with their forms among the words one edit away."""
    return spelling.variants(spelling.vocabulary(documents(spark, sf_dir).select("doc_id", "text")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rearranged texts and, from them, the texts they were made of, as digests."""
    done = fill_middle.rearrange(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    restored = fill_middle.restore(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark's windows that occur in them."""
    found = phrase_index.contamination(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated", "n_near")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five stages from documents to packed sequences."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_secret_scans": op2_secret_scans,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_language_id": op5_language_id,
    "op6_warc": op6_warc,
    "op7_quality_rules": op7_quality_rules,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_license_scans": op9_license_scans,
    "op10_mixing": op10_mixing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_decontamination": op13_decontamination,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {"op10_mixing": mixing.MIX_SQL}
