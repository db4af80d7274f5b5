"""The corpus operators as queries over whole tables, with the columns that their results are compared by."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtline.llm import bpe, decontam, gif, jaccard, langid, quality, secrets, substrings, toxicity, warc

VOCABULARY = "word_bpe_49k.json"
#: Rows that cross to a Python worker at once, so that batches of long texts fit its memory.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), remainder(4) == 2
    out = quality.score_quality(docs, docs, table(spark, sf_dir, "labels").where(~held))
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
    stored = gif.store_payloads(docs, keep=["doc_id", "n_bytes"])
    stored = stored.select("doc_id", "n_bytes", F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    out = gif.read_gifs(stored, keep=["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    shown = F.transform("frames", lambda f: F.concat_ws(":", f["index"], f["start_ms"], f["delay_ms"], f["width"], f["height"], F.array_join(F.transform(f["histogram"], lambda n: n.cast("string")), ",")))
    return out.select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("bigint").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -64, 64)")).alias("tail_crc32"), "media_bytes", "media_sha256", F.array_join(shown, ";").alias("feature"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), remainder(5) == 0
    out = langid.identify_languages(docs, docs.where(~held))
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(warc.recrawl(table(spark, sf_dir, "pages")))
    merged = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.select("record_id", "canonical_url", "refers_to", "outcome", merged.alias("headers"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), remainder(5) == 0
    out = toxicity.score_toxicity(docs, docs, table(spark, sf_dir, "labels").where(~held))
    evidence = F.transform("evidence", lambda e: e["doc_id"])
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), evidence.alias("evidence"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["kind"] != "guess")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_benchmark_decontamination, op2_quality_classifier, op3_gif_media, op4_substring_dedup, op5_language_id,
        op6_warc_revisits, op7_toxicity, op8_secret_scan, op9_bpe_round_trip, op10_jaccard_join,
    )
    return {f.__name__: f for f in own}
