"""One registered query per operator, over whole tables with production parameters.

Each query only derives its contract's columns (digests, counts) from what its
operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cadence.llm import divergence, embeddings, extraction, lines, mixing, pieces, quality, rules, simhash, suffixes, toxicity, whitening, windows
from cadence.llm.common import pick, read

#: Name of the public SentencePiece model among the installed tokenizers.
PIECE_MODEL = "piece_bpe_32k.model"


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def sha(text: Column | str) -> Column:
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(read(spark, sf_dir, "documents"), "doc_id", "source", "text")
    d = mixing.plan_mix(docs)
    return d.select(
        F.col("c0_").alias("doc_id"),
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).cast("long").alias("taken"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return d.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "neighbours")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(read(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = windows.dedup_windows(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_removed", sha("kept").alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(read(spark, sf_dir, "documents"), "doc_id", "text")
    d = lines.dedup_lines(docs)
    return d.select(
        F.col("c0_").alias("doc_id"),
        F.col("ld_lines").alias("n_lines"),
        F.col("ld_dropped").alias("n_dropped"),
        sha("c1_").alias("kept_sha256"),
    )


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(read(spark, sf_dir, "embeddings"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pieces.encode_documents(read(spark, sf_dir, "documents"), piece_model_path())
    n = F.when(F.col("ids") == "", 0).otherwise(F.length("ids") - F.length(F.translate("ids", ",", "")) + 1)
    return d.select("doc_id", n.cast("long").alias("n_tokens"), sha("ids").alias("ids_sha256"), sha("decoded").alias("decoded_sha256"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffixes.dedup_suffixes(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents")).select("doc_id", "votes", "weak_label", "score", "kept")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(read(spark, sf_dir, "documents"), "doc_id", "text")
    d = rules.judge(docs, F.col("text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return d.select("doc_id", *[F.col(f"qr_{n}").alias(n) for n in names])


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(read(spark, sf_dir, "documents"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = extraction.extract_pages(read(spark, sf_dir, "pages"))
    return d.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_source_mixing": op1_source_mixing,
        "op2_toxicity": op2_toxicity,
        "op3_simhash": op3_simhash,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_line_dedup": op5_line_dedup,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_suffix_array": op8_suffix_array,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_quality_rules": op10_quality_rules,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_source_divergence": op12_source_divergence,
        "op13_html_extraction": op13_html_extraction,
        "pipeline": pipeline,
    }
