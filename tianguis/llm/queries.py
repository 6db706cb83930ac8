"""Registered queries of the subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, divergence, importance, licences, masked_lm, minhash, order, pii, pq, quality, suffixes, toxicity
from .common import read_table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity, threshold and decision of every document, over all its bytes."""
    return quality.classified(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), quality.BYTES).drop("text_key")


ORDER_END_ID = 50_256  # the end mark of the byte-level vocabulary


def tokenizer_path() -> str:
    """The public word-BPE file of the driver's contract."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every whole text under a network trained on all of them."""
    return masked_lm.scores(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole text."""
    return toxicity.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sequences in training order, read back from the written shards."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return order.manifest(order.shards(read_table(spark, sf_dir, "documents"), path, ORDER_END_ID))


def op5_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.95."""
    return pq.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every whole text, as digests."""
    docs, path = read_table(spark, sf_dir, "documents"), tokenizer_path()
    return bpe.digests(docs, path, bpe.build_lexicon(docs, path))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every whole text by sentence rules."""
    return licences.scan(read_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items found in every whole text, with their edits."""
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text, by anchor expansion."""
    return pii.report(read_table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates over 2-word shingles."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=2).drop("text_key")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and draw of every whole text, by nearness to the benchmark's texts."""
    return importance.resampled(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("text_key")


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every whole text that a repeated string of 200 bytes covers, as digests of the rest."""
    return suffixes.deduplicated(read_table(spark, sf_dir, "documents")).drop("text_key", "spans", "kept")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all sources of each language, and the terms that set them apart."""
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over documents."""
    import corpus_pipeline  # at the repository top; it imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_masked_lm": op2_masked_lm,
    "op3_toxicity": op3_toxicity,
    "op4_order": op4_order,
    "op5_pq": op5_pq,
    "op6_bpe": op6_bpe,
    "op7_licences": op7_licences,
    "op8_decontaminate": op8_decontaminate,
    "op9_pii": op9_pii,
    "op10_minhash": op10_minhash,
    "op11_importance": op11_importance,
    "op12_suffixes": op12_suffixes,
    "op13_divergence": op13_divergence,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op7_licences": licences.oracle(),
    "op11_importance": importance.oracle(),
    "op12_suffixes": suffixes.oracle(),
    "op13_divergence": divergence.oracle(),
}
