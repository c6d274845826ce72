"""Retrieval beside the registered queries."""

import math
import os

import duckdb
import numpy as np
from pyspark.sql import functions as F

from mnemix.operators import retrieval as rank
from mnemix.plans.registry import ORACLE
from mnemix.sources.tables import shared_dir


def test_plain_bm25_counts_in_place(spark):
    """Words that nobody asks for stay in the scan; rows of one id are one document, a null id is counted only; few and many asked terms agree."""
    texts = [(1, "Red red blue, \u212aite"), (2, "blue green"), (3, None), (4, "a b c d e f g h red"), (5, "green green")]
    queries = spark.createDataFrame([(1, "red kite"), (2, "blue Green zzz")], "query_id long, q string")
    docs = spark.createDataFrame(texts, "node_id long, text string")
    some = rank.plain_bm25(docs, queries)
    got = [tuple(r) for r in some.orderBy("query_id", "rank").collect()]
    n, mean = 5, 17 / 5
    score = lambda tf, length, df: math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))
    assert [r[:3] for r in got if r[0] == 1] == [(1, 1, 1), (1, 2, 4)] and abs(got[0][3] - score(2, 4, 2) - score(1, 4, 1)) < 1e-8
    assert got == [tuple(r) for r in rank.plain_bm25(docs, queries, most_terms=0).orderBy("query_id", "rank").collect()]
    two = spark.createDataFrame([*texts, (5, "blue"), (None, "red blue")], "node_id long, text string")
    duck = duckdb.connect()
    duck.execute("create table documents (doc_id bigint, text varchar); create table benchmark (item_id bigint, text varchar)")
    duck.executemany("insert into documents values (?, ?)", [tuple(r) for r in two.collect()])
    duck.executemany("insert into benchmark values (?, ?)", [tuple(r) for r in queries.collect()])
    want = duck.execute(ORACLE["r25_plain_bm25"]).fetchall()
    again = [(r.query_id, r.rank, r.node_id, round(r.score, 6)) for r in rank.plain_bm25(two, queries).collect()]
    assert sorted(again) == sorted(want)
    words = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(300))) for i in range(40)], "node_id long, text string")
    asked = spark.createDataFrame([(1, "w7x3 w9x4")], "query_id long, q string")
    before = {p for p in os.listdir(shared_dir(spark)) if p.startswith("mnemix-plain")}
    assert [r.node_id for r in rank.plain_bm25(words, asked).orderBy("rank").collect()] == [7, 9]
    new = [p for p in os.listdir(shared_dir(spark)) if p.startswith("mnemix-plain") and p not in before]
    table = spark.read.parquet(f"{shared_dir(spark)}/{new[0]}")
    assert sum(len(r.terms) for r in table.collect()) == 2  # 12,000 words were written before


def exact(spark, vectors, queries, k):
    """The k nearest by the rounded cosine, ties to the smaller id."""
    v = np.array([x for _, x in vectors])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sims = {i: v @ (np.array(x) / np.linalg.norm(x)) for i, x in queries}
    return {i: sorted((-round(float(y), 9), n) for y, (n, _) in zip(s, vectors))[:k] for i, s in sims.items()}


def found(d):
    out = {}
    for r in d.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((-r.sim, r.node_id))
    return out


def test_dense_blocks_and_tiles(spark):
    """Any cut into blocks gives the same neighbours, ties included, and a block is as large as its components allow."""
    rng = np.random.default_rng(4)
    base = rng.integers(-2, 3, (300, 3)).astype(float)  # few directions, so many ties
    base[~base.any(axis=1)] = 1.0
    rows = [(i, x.tolist()) for i, x in enumerate(base)]
    d = spark.createDataFrame(rows, "node_id long, vec array<double>")
    q = d.filter("node_id % 3 = 0").withColumnRenamed("node_id", "query_id")
    want = exact(spark, rows, rows[::3], 7)
    near = lambda got: {i: [(round(s, 9), n) for s, n in x] for i, x in got.items()}
    for cells in ((1 << 22, 1 << 21), (120, 90), (3, 1 << 21)):
        assert near(found(rank.dense_top(d, q, 7, *cells))) == near(want)
    with_tiles = rank._top_of_blocks(
        d.select("node_id", rank.unit(F.col("vec")).alias("vec"), F.lit(0).alias("b")), q.select("query_id", rank.unit(F.col("vec")).alias("vec"), F.lit(0).alias("b")), ["b"], 7, ("bigint", "bigint"), rows=10, columns=9
    )
    assert near(found(with_tiles)) == near(want)


def test_cells_are_cut(spark, monkeypatch):
    """A cell holds a share of the table, so a task takes blocks of it: no more than so many components, and the same neighbours."""
    rng = np.random.default_rng(5)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(400, 4)))]
    d = spark.createDataFrame(rows, "node_id long, vec array<double>")
    q = d.filter("node_id % 4 = 0").withColumnRenamed("node_id", "query_id")
    index = rank.cell_index(d, 3)
    seen, top = [], rank._top_of_blocks

    def watched(v, a, keys, *rest):
        seen.append((v.groupBy(*keys).count().agg(F.max("count")).first()[0], a.groupBy(*keys).count().agg(F.max("count")).first()[0]))
        return top(v, a, keys, *rest)

    monkeypatch.setattr(rank, "_top_of_blocks", watched)
    want = exact(spark, rows, rows[::4], 5)
    got = found(rank.cell_search(index, q, 5, 3, 4 * 40, 4 * 20))
    assert {i: [n for _, n in x] for i, x in got.items()} == {i: [n for _, n in x] for i, x in want.items()}
    assert seen[0][0] < 80 and seen[0][1] < 45  # a whole cell holds over 130 of 400, and all 100 queries probe it
    one = rank.cell_search(index, q, 5, 1, 4 * 40, 4 * 20)
    assert one.count() == rank.cell_search(index, q, 5, 1).count() == 500


def test_dense_shuffles_few_copies(spark, monkeypatch):
    """Each vector is shuffled once for each block of queries: 9,000 of 64 components are one block."""
    d = spark.range(9000).select(F.col("id").alias("node_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(i * F.col("id"))).alias("vec"))
    seen = []
    monkeypatch.setattr(rank, "_top_of_blocks", lambda v, a, *rest: seen.append((v.count(), a.count())) or v)
    rank.dense_top(d, d.withColumnRenamed("node_id", "query_id"), 5)
    cores = spark.sparkContext.defaultParallelism
    assert seen == [(9000, 9000 * cores)]
