"""A corpus pipeline: toxicity filter, near-duplicate removal, benchmark decontamination, secret redaction, BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtline.llm import bpe, decontam, jaccard, secrets, toxicity
from courtline.llm.batches import written
from courtline.llm.queries import VOCABULARY, remainder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half. Learns from the labels outside the held-out fold and the whole corpus' texts."""
    labels = table(spark, sf_dir, "labels").where(remainder(5) != 0)
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "documents"), labels, keep=docs.columns)
    return scored.where("score < 0.5").select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id in each group of near duplicates; rows that repeat it go too, null ids stay."""
    groups = jaccard.near_duplicate_groups(docs)
    leaders = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(leaders, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than one in twenty lie in benchmark windows."""
    judged = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=docs.columns)
    return judged.where(~F.col("contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns])


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars counted anew."""
    clean = secrets.redact_secrets(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and a digest of the text that they decode to."""
    made = bpe.bpe_round_trip(docs, public_tokenizers.path(VOCABULARY), keep=["doc_id", "lang", "source"])
    ids = F.transform(F.filter(F.split("ids", " "), lambda x: x != ""), lambda x: x.cast("int"))
    return made.select("doc_id", "lang", "source", "n_tokens", ids.alias("token_ids"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("secrets", redact),
    ("bpe", tokenise),
]

#: Fitted models and tokenisation have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
