"""A corpus pipeline of five operators: language ID, near duplicates, decontamination, pseudonyms, source mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemix.llm import decontaminate, jaccard_join, lang_id, mixing, pii
from mnemix.llm.common import pii_key, read, saved

UNSURE = 0.3  # a pooled probability of the best language below this rejects a document


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language stay; those without letters or without a language above UNSURE go."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    found = lang_id.predict(rows, lang_id.train(docs))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= UNSURE)).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class stays; of rows that repeat its id, the least in the order of their columns.

    Rows without an id stay, as do texts without words, once for each id.
    """
    found = jaccard_join.classes(docs)
    first = found.filter(F.col("doc_id") == F.col("class_id")).groupBy("doc_id").agg(F.count("*").alias("n")).select(F.col("doc_id").alias("id"), "n")
    first = saved(first, "first")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("key"))
    kept = rows.filter("key is not null").join(first.hint("merge"), F.col("key") == F.col("id"))  # it grows with the documents: never broadcast
    once = kept.filter("n = 1").select("doc")
    again = kept.filter("n > 1").groupBy("key").agg(F.min("doc").alias("doc")).select("doc")
    return once.unionByName(again).unionByName(rows.filter("key is null").select("doc")).select("doc.*")


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontaminate.clean(docs, decontaminate.overlaps(docs, read(spark, sf_dir, "benchmark"))).select(*docs.columns)


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values in texts become pseudonyms; n_chars follows."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    out = pii.pseudonymize(rows, pii_key(spark))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


MIXED = ("size", "source_size", "target", "taken")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their words (size) and the words taken of each, repeats counted.

    Rows of one id, source and size take their shares in the order of their texts' hashes. Columns of documents with the
    names in MIXED are replaced.
    """
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by[:3]).orderBy(*by[3:]))
    mix = mixing.mix(docs).select(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), "size", F.struct(*MIXED).alias("mix"))
    mix = saved(mix.withColumn("m_nth", nth("m_id", "m_source", "size", F.desc("mix.taken"))).filter("mix.taken > 0"), "mix")
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in MIXED]).alias("doc"), "doc_id", "source", mixing.n_words(F.col("text")).alias("words"), F.xxhash64("text").alias("h"))
    rows = rows.withColumn("nth", nth("doc_id", "source", "words", "h"))
    same = F.col("doc_id").eqNullSafe(F.col("m_id")) & F.col("source").eqNullSafe(F.col("m_source")) & (F.col("words") == F.col("size")) & (F.col("nth") == F.col("m_nth"))
    return rows.join(mix.hint("merge"), same).select("doc.*", "mix.*")  # it grows with the documents: never broadcast


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmarks),
    ("pseudonyms", pseudonymize),
    ("source_mix", mix_sources),
]

ORACLE_SQL = None  # neither the trained network nor the hashed permutations are expressible in SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
