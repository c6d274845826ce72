"""The store's side: statistics, typed relations, resumable loads, page vectors, parity, routing, manifests."""

from __future__ import annotations

import sys
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

SCHEMA_VERSION = 1
# What each list of a record is called as a relation.
RELATIONS = {"data": "USES", "access": "GRANTS", "events": "EMITS"}
# The 64-bit FNV-1a offset basis and prime.
FNV64_START, FNV64_PRIME = 0xCBF29CE484222325, 0x100000001B3


def stats(memory, records: DataFrame, experience: DataFrame | None = None) -> DataFrame:
    """One row: schema_version, records, passages, nodes, edges, avg_len and dim, the length of stored vectors (null without any)."""
    r = records.agg(F.count("*").alias("records"), F.count_if(F.col("action") == "Passage").alias("passages"))
    n = memory.lengths.agg(F.count("*").alias("nodes"), F.round(F.coalesce(F.avg("len"), F.lit(0.0)), 6).alias("avg_len"))
    e = memory.links.agg(F.count("*").alias("edges"))
    dim = experience.agg(F.max(F.size("vec")).alias("dim")) if experience is not None else r.select(F.lit(None).cast("int").alias("dim"))
    return r.join(n).join(e).join(dim).withColumn("schema_version", F.lit(SCHEMA_VERSION))  # one row each


def relations(records: DataFrame, context: DataFrame | None = None, concepts: DataFrame | None = None) -> DataFrame:
    """(source, rel, target) of records: uses of data, grants of access, emitted events, links between records there are, mentions of concepts."""
    parts = [records.select(F.col("id").alias("source"), F.lit(rel).alias("rel"), F.explode(c).alias("target")) for c, rel in RELATIONS.items() if c in records.columns]
    ids = records.select(F.col("id")).distinct()
    if context is not None:
        both = context.join(ids.withColumnRenamed("id", "owner"), "owner", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
        parts.append(both.select(F.col("owner").alias("source"), F.lit("LINKS").alias("rel"), "target"))
    if concepts is not None:
        parts.append(concepts.join(ids, "id", "left_semi").select(F.col("id").alias("source"), F.lit("MENTIONS").alias("rel"), F.col("stem").alias("target")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def shared_frequencies(rel: DataFrame) -> DataFrame:
    """(rel, target, df): how many records share each vertex."""
    return rel.filter("rel <> 'LINKS'").groupBy("rel", "target").agg(F.count("*").alias("df"))


def load_pool(rows: DataFrame, key: str, path: str, batches: int) -> list[int]:
    """Writes rows in `batches` parts by a hash of key, each whole or not at all; gives the parts written by this call.

    A part that a former call finished is not written again, so a load that stopped goes on where it was.
    """
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    written = []
    part = F.pmod(F.xxhash64(key), F.lit(batches))
    for i in range(batches):
        at = f"{path.rstrip('/')}/batch={i}"
        done = jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            rows.filter(part == i).write.mode("overwrite").parquet(at)
            written.append(i)
    return written


def page_vectors(passages: DataFrame) -> DataFrame:
    """(page, seq, vec): one vector a page, of its first passage that begins with the title, else of its first. passages: page, seq, title, text, vec."""
    titled = F.col("text").startswith(F.col("title"))
    best = F.min_by(F.struct("seq", "vec"), F.struct((~titled).alias("no"), "seq")).alias("b")
    return passages.groupBy("page").agg(best).select("page", "b.seq", "b.vec")


def table_digest(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(n, digest): rows, and a sum of the first 32 bits of each row's MD5, which no order of rows changes."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long")), F.lit(0)).alias("digest"))


def parity(a: DataFrame, b: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(n_a, n_b, same): whether two tables hold the same rows in these columns, repeated ones counted."""
    columns = list(columns)
    x, y = table_digest(a, columns), table_digest(b, columns)
    return x.select(F.col("n").alias("n_a"), F.col("digest").alias("da")).join(y.select(F.col("n").alias("n_b"), F.col("digest").alias("db"))).select("n_a", "n_b", ((F.col("n_a") == F.col("n_b")) & (F.col("da") == F.col("db"))).alias("same"))  # one row by one row


def _fnv64(text: str) -> int:
    h = FNV64_START
    for x in text.encode("utf-8"):
        h = ((h ^ x) * FNV64_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def shard(namespace: Column, shards: int, placed: dict[str, int] | None = None) -> Column:
    """The shard of each namespace: where it is placed by name, else its 64-bit FNV-1a hash modulo the number of shards."""

    @F.pandas_udf(LongType())
    def hashed(names: pd.Series) -> pd.Series:
        return pd.Series([_fnv64(n or "") % shards for n in names], dtype=np.int64)

    out = hashed(namespace)
    for name, at in (placed or {}).items():
        out = F.when(namespace == name, F.lit(at).cast("long")).otherwise(out)
    return out


def manifest(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n, columns, digest) of each table: what a run was made from."""
    out = None
    for name, df in tables.items():
        d = table_digest(df, df.columns).select(F.lit(name).alias("table"), "n", F.lit(",".join(df.columns)).alias("columns"), "digest")
        out = d if out is None else out.unionByName(d)
    return out


def in_pool(ranked: DataFrame, pool: DataFrame) -> DataFrame:
    """(query_id, rank, id): the hits that are in the pool (id), ranked anew in their order."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return ranked.join(pool.select("id").distinct(), "id", "left_semi").withColumn("rank", F.row_number().over(w)).select("query_id", "rank", "id")


def checked_dim(vectors: DataFrame, dim: int) -> DataFrame:
    """vectors, each checked to be of the namespace's length when it is read."""
    return vectors.withColumn("vec", F.when(F.size("vec") == dim, F.col("vec")).otherwise(F.raise_error(F.concat(F.lit(f"a vector of length {dim} is wanted, not "), F.size("vec").cast("string")))))

# what runs on executors travels with the plan, so they need not hold this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
