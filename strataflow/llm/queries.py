"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, hard_negatives, html_extraction, iblt_fingerprints, pii_surrogates, product_codes, sentencepieces, sharding, simhash_dedup, substring_dedup, toxicity, training_order, vector_packing
from .common import table


def op1_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = iblt_fingerprints.fingerprints(table(spark, sf_dir, "documents"))
    return got.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
        "n_paragraphs",
        "n_changed",
    )


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = training_order.new_folder(spark)
    n = training_order.write_shards(table(spark, sf_dir, "documents"), path, "epoch 0")
    if not n:
        return spark.createDataFrame([], "slot long, shard long, offset long, n_tokens long, tokens_sha256 string, intact boolean")
    return training_order.read_shards(spark, path).select("slot", "shard", "offset", "n_tokens", F.sha2("tokens", 256).alias("tokens_sha256"), "intact")


def op3_contiguous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 8)
    return got.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "position",
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, network).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.col("threshold").alias("lang_threshold"),
        F.col("toxic").cast("int").alias("predicted_by_lang"),
    )


def op5_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = sentencepieces.load()
    encoded = sentencepieces.encode(table(spark, sf_dir, "documents"), vocabulary)
    # the digest of the ids stands in for the key, so that decoding passes it through
    own = F.struct("doc_id", F.size("ids").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"))
    decoded = sentencepieces.decode(encoded.select(own.alias("own"), "ids"), vocabulary, key="own")
    return decoded.select("own.*", F.sha2("text", 256).alias("decoded_sha256"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), "intervals")


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii_surrogates.replace(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "text", F.col("_n_entities").alias("n_entities"), F.col("_kinds").alias("kinds"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, books = product_codes.compress(table(spark, sf_dir, "embeddings"))
    return got.select("vec_id", "code", "error", "label_error", F.lit(product_codes.digest(books)).alias("codebooks_sha256"), "label")


def op13_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = vector_packing.pack(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss", "padded")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_iblt_fingerprints": op1_iblt_fingerprints,
        "op2_training_order": op2_training_order,
        "op3_contiguous_shards": op3_contiguous_shards,
        "op4_toxicity": op4_toxicity,
        "op5_sentencepieces": op5_sentencepieces,
        "op6_simhash_dedup": op6_simhash_dedup,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_pii_surrogates": op8_pii_surrogates,
        "op9_html_extraction": op9_html_extraction,
        "op10_decontamination": op10_decontamination,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_vector_codes": op12_vector_codes,
        "op13_vector_packing": op13_vector_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {}
