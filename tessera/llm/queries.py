"""The registered queries of the training-data operators: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import align, chat, cosine, decontaminate, fim, language, minhash, pii, piece_bpe, quality, token_file, topk, toxicity
from tessera.llm.common import held_out_bucket, read_table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(read_table(spark, sf_dir, "documents"))
    terms = F.transform("terms", lambda t: F.concat(F.lit("term:"), t["start"], F.lit(":"), t["end"]))
    return found.select(
        "doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2("base", 256).alias("base_sha256"),
        F.array_join(F.concat(F.filter(F.array("base"), lambda b: b != ""), terms), ",").alias("spans"),
        (sum((F.col(f"n_{k}") for k in pii.KINDS), F.size("terms"))).cast("long").alias("n_spans"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(read_table(spark, sf_dir, "conversations"))


def op4_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = held_out_bucket("doc_id", 3) == 1
    scored = toxicity.classify(docs, docs.filter(~held_out), labels.filter(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = held_out_bucket("doc_id", 4) == 2
    found = language.identify(docs, docs.filter(~held_out).select("text", "lang"))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "switches")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op11_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine.near_vectors(read_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(read_table(spark, sf_dir, "documents"), written=True)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii, op2_decontaminate, op3_chat, op4_piece_bpe, op5_topk, op6_quality, op7_toxicity, op8_language, op9_token_file, op10_minhash,
        op11_cosine, op12_align, op13_fim,
    )
}
ORACLE_SQL: dict[str, str] = {"op3_chat": chat.ORACLE_SQL, "op5_topk": topk.ORACLE_SQL, "op10_minhash": minhash.ORACLE_SQL, "op11_cosine": cosine.ORACLE_SQL, "op13_fim": fim.ORACLE_SQL}
