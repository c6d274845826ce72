"""Formats, blocks, density and experience through the engine."""

import pytest
from pyspark.sql import functions as F

from mnemix.engine import Engine
from mnemix.operators import evaluation as A
from mnemix.operators import memory as M
from mnemix.operators import scoring as S
from mnemix.operators import store, topology
from mnemix.sources import tables

ATF = """# Notes
An opening line about refunds.

## [ID: pay_out]
**Action:** Pay the customer
**Data_Connections:** [ledger], [invoice]
**Access:** Role_Clerk
**Context_Links:** [close_case]
## [ID: close_case]
**Action:** Close the case
**Data_Connections:** [ledger]
"""


def docs(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_seq long, text string, format string, source string")


def test_engine_reads_every_format(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.ingest_batch(docs(spark, (ATF, "auto", "kb"), ("(Component Shop) sells.\n\n(Function buy_now) takes (Data cart).", "entity_tags", "kb"), ("no tags here", "entity_tags", "kb"), ("# x\n\nplain (Block 4)", "text", "kb"), (None, "auto", "kb")))
    r = {x.id: x for x in e.table("records").collect()}
    assert {"pay_out", "close_case", "Shop", "buy_now"} <= set(r) and r["buy_now"].data == ["Shop", "cart"] and r["buy_now"].text == "buy now takes cart."
    assert {x.text for x in r.values() if x.action == "Passage"} == {"# x", "# Notes\nAn opening line about refunds.", "no tags here", "plain (Block 4)"}
    assert [tuple(x) for x in e.table("links").collect()] == [("pay_out", "close_case")]
    blocks = {x.node_id: x.block for x in e.blocks().collect()}
    assert blocks["D_ledger"] in {blocks["F_pay_out"], blocks["F_close_case"]}
    assert {x.block for x in e.call("search_blocks", q="LEDGER").collect()} == {blocks["D_ledger"]}
    assert e.call("topology_json").count() == len(set(blocks.values()))
    d = e.call("density")
    assert d["functions"] == len(r) and d["blocks"] == len(set(blocks.values())) and d["passes"] == (not d["violations"])
    assert {"blocks", "vocabulary"} <= set(e.stats()) and e.store_stats()["records"] == len(r)
    assert e.call("traverse", start="pay_out", hops=1).count() >= 4


def test_experience_in_the_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    cases = spark.createDataFrame([("q", i, [1.0, 0.01 * i] if i % 2 else [0.01 * i, 1.0], i % 2) for i in range(12)], "question string, seq long, vec array<double>, label int")
    assert e.learn(cases)["q"] == 1.0 and e.trust()["q"] == 1.0 and e.experience_size() == 12
    with pytest.raises(ValueError, match="length"):
        e.learn(spark.createDataFrame([("q", 99, [1.0], 0)], cases.schema))
    e.forget()
    assert e.experience_size() == 0


def louvain(edges, nodes):
    """One level of greedy moves on the whole graph, in plain Python."""
    m, near = len(edges), {n: [] for n in nodes}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    own = {n: i for i, n in enumerate(nodes)}
    for _ in range(20):
        moved = False
        for n in nodes:
            k = len(near[n])
            total = lambda c: sum(len(near[x]) for x in nodes if own[x] == c and x != n)  # noqa: B023, E731
            gain = lambda c: sum(own[x] == c and x != n for x in near[n]) / m - k * total(c) / (2 * m * m)  # noqa: B023, E731
            here, best, most = own[n], own[n], gain(own[n])
            for c in sorted({own[x] for x in near[n]}):
                if c != here and gain(c) > most + 1e-12:
                    best, most = c, gain(c)
            if best != here:
                own[n], moved = best, True
        if not moved:
            return own
    return own


def test_communities_brute_force(spark):
    import random

    r = random.Random(1)
    edges = [(f"n{g}_{a}", f"n{g}_{b}") for g in range(3) for a in range(8) for b in range(a) if r.random() < (0.9 if (a < 4) == (b < 4) else 0.1)]
    edges += edges[:5]
    nodes = list(dict.fromkeys(x for e in edges for x in e))
    want = louvain(edges, nodes)
    got = {x.node: x.community for x in topology.communities(spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "a string, b string, seq long")).collect()}
    assert set(got) == set(nodes)
    same = lambda o: {frozenset(n for n in nodes if o[n] == c) for c in set(o.values())}
    assert same(got) == same(want)
    assert [got[n] for n in nodes if got[n] not in [got[x] for x in nodes[: nodes.index(n)]]] == list(range(len(set(got.values()))))


def test_edge_list_keeps_order_and_repeats(spark):
    records = spark.createDataFrame([("a", 1, 0, ["x", "y"], ["r"]), ("b", 2, 0, ["x", "x"], [])], "id string, doc_seq long, passage_seq int, data array<string>, access array<string>")
    context = spark.createDataFrame([("b", "a"), ("a", "gone"), ("a", "a")], "owner string, target string")
    got = [(x.a, x.b) for x in M.edge_list(records, context).orderBy("seq").collect()]
    assert got == [("F_a", "D_x"), ("F_a", "D_y"), ("F_a", "A_r"), ("F_b", "D_x"), ("F_b", "D_x"), ("F_b", "F_a")]


def test_running_sums_and_hot_components(spark):
    d = spark.range(1000).withColumn("v", F.col("id") % 7).repartition(5)
    got = tables.running(d, [F.desc("id")], F.col("v"), "upto").collect()
    assert all(x.upto == sum(i % 7 for i in range(x.id, 1000)) for x in got) and len(got) == 1000
    star = spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).unionByName(spark.range(5000, 5040).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    roots = {x.node: x.root for x in tables.components(star).collect()}
    assert all(roots[i] == 0 for i in range(3000)) and all(roots[i] == 5000 for i in range(5000, 5041))
    assert tables.components(star.limit(0)).count() == 0


def test_only_changed_texts_are_embedded(spark):
    nodes = spark.createDataFrame([("F_a", "a", "one two"), ("F_b", "b", "three"), ("D_x", "x", "")], "node_id string, label string, text string")
    old = S.refreshed_embeddings(nodes, spark.createDataFrame([], "node_id string, hash long, vec array<double>"), S.HashEmbedder())
    now = nodes.withColumn("text", F.when(F.col("node_id") == "F_b", "four").otherwise(F.col("text")))

    class Counting(S.HashEmbedder):
        def embed(self, texts):
            if any("one two" in t for t in texts):
                raise AssertionError("embedded again")
            return super().embed(texts)

    new = {r.node_id: r.vec for r in S.refreshed_embeddings(now, tables.saved(old), Counting()).collect()}
    assert set(new) == {"F_a", "F_b"}


def test_mcnemar_of_many_pairs(spark):
    rows = [(0, 0, 0, 0), (5, 1, 8, 2), (0, 400_000, 401_000, 0), (1, 0, 3000, 1)]
    got = [r.p for r in A.mcnemar(spark.createDataFrame(rows, "both long, a_only long, b_only long, neither long")).collect()]
    assert got[0] == 1.0 and abs(got[1] - 2 * (1 + 9) / 2**9) < 1e-6 and 0.2 < got[2] < 0.3 and got[3] == 0.0


def test_vectors_of_another_length_are_refused(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, vec array<double>")
    assert store.checked_dim(v.filter("id = 1"), 2).count() == 1
    with pytest.raises(Exception, match="a vector of length 2"):
        store.checked_dim(v, 2).collect()
