"""The registered query of each operator, with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemix.llm import ann, decontaminate, html_text, jaccard_join, lang_id, lattice_lm, mixing, oracles, pii, quality, token_count
from mnemix.llm.common import fold, pii_key, read


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = lang_id.predict(docs, lang_id.train(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"), html_text.train()).select("page_id", "url", "text", "n_chars")


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(read(spark, sf_dir, "documents"), pii_key(spark)).select("doc_id", "text", "n_values")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    found = token_count.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lattice_lm.score(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op3's result SQL can say: sizes and targets."""
    return op3_source_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op8's result SQL can say: sizes in bytes."""
    return op8_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


def lattice_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op9's result SQL can say: folds, counts and the word model's score."""
    return op9_lattice_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


OPERATORS = (op1_ann, op2_language_id, op3_source_mix, op4_jaccard_join, op5_quality, op6_main_text, op7_pseudonyms, op8_token_counts, op9_lattice_score, op10_decontaminate)
QUERIES = {f.__name__: f for f in (*OPERATORS, mix_targets, token_bytes, lattice_base)}

ORACLE = {"op4_jaccard_join": oracles.JACCARD, "mix_targets": oracles.MIX_TARGETS, "token_bytes": oracles.TOKEN_BYTES, "lattice_base": oracles.LATTICE_BASE}
