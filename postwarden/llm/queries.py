"""The queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline

from . import dialogue, language_model, pii, quality, toxicity
from .alignment import align_corpus
from .best_fit import best_fit
from .bpe import decode_ids, encode_texts
from .common import remainder, table, texts
from .embeddings import near_vectors
from .packing import pack_documents
from .simhash import near_copies
from .substrings import without_repeats
from .winnowing import digest, edited, likeness


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(table(spark, sf_dir, "documents"))
    found = toxicity.score_texts(docs, toxicity.trained(spark, docs, sf_dir), "score")
    predicted = (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted")
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", predicted)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(table(spark, sf_dir, "documents"))
    found = quality.score_quality(docs, quality.fit(docs), "score")
    return found.select("doc_id", "score", (F.col("score") >= quality.KEEP).alias("kept"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode_ids(encode_texts(table(spark, sf_dir, "documents")))
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(texts(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(7) == 2
    model = language_model.train(docs.filter(~held_out))
    return language_model.score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest("marks").alias("fingerprint"),
        digest("edited_marks").alias("edited_fingerprint"),
        likeness("hashes", "edited_hashes").alias("near_edited"),
        likeness("hashes", "next_hashes").alias("near_next"),
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in pii.KINDS],
        F.sha2(pii.listed(pii.KINDS).cast("binary"), 256).alias("base_sha256"),
        pii.listed(pii.KINDS, with_terms=True).alias("spans"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"), sf_dir)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align_corpus(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256"
    )


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, repaired = dialogue.repair(table(spark, sf_dir, "conversations"))
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    hashed = report.withColumn("conv", conv).join(dialogue.digests(repaired), "conv", "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return hashed.select(*report.columns, F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents")).drop("ids")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_embeddings": op2_embeddings,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_bpe": op5_bpe,
    "op6_substrings": op6_substrings,
    "op7_language_model": op7_language_model,
    "op8_winnowing": op8_winnowing,
    "op9_pii": op9_pii,
    "op10_packing": op10_packing,
    "op11_alignment": op11_alignment,
    "op12_conversations": op12_conversations,
    "op13_best_fit": op13_best_fit,
    "pipeline": corpus_pipeline.run,
}

#: SQL twins, for the queries that SQL can express.
ORACLES: dict[str, str] = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
