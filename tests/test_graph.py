import pytest

from mnemix.operators import topology


def test_two_cliques_split(spark):
    e = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "x"), ("x", "y"), ("y", "z"), ("x", "z"), ("p", "q")]
    d = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(e)], "a string, b string, seq long")
    got = {r.node: r.community for r in topology.communities(d).collect()}
    assert got["a"] == got["b"] == got["c"] and got["x"] == got["y"] == got["z"] and got["a"] != got["x"] and got["p"] == got["q"]
    parts = spark.createDataFrame(list(got.items()), "node string, community int")
    assert topology.modularity(d, parts).first().modularity > 0.3


def test_components(spark):
    d = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9)], "a int, b int")
    assert {r.node: r.root for r in topology.components(d).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 9}


def test_traversal_is_bounded(spark):
    links = spark.createDataFrame([("F_a", "D_x"), ("D_x", "F_b"), ("F_b", "D_y"), ("D_y", "F_c")], "a string, b string")
    nodes = spark.createDataFrame([(n, 0 if n[0] == "F" else 1, 2) for n in ("F_a", "D_x", "F_b", "D_y", "F_c")], "node_id string, level_rank int, degree int")
    s = spark.createDataFrame([("F_a",)], "node_id string")
    t = topology.traverse(nodes, links, s, 2, 10).orderBy("ord").collect()
    assert [r.node_id for r in t] == ["F_a", "D_x", "F_b"]
    assert topology.traverse(nodes, links, s, 4, 2).count() == 2


def exchanges(d):
    return d._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_links_and_postings_of_unique_records_are_made_where_they_are(spark, tmp_path):
    from mnemix.operators import memory as M

    rows = [("r1", "Act", "alpha beta beta", ["B", "A", "A"], ["x", "x"]), ("r2", "Act", "beta", ["A"], [])]
    r = spark.createDataFrame(rows, "id string, action string, text string, data array<string>, access array<string>")
    concepts = spark.createDataFrame([("r1", "s"), ("r1", "s")], "id string, stem string")
    context = spark.createDataFrame([("r1", "r2"), ("r2", "r1")], "owner string, target string")
    plain, quick = M.typed_links(r, context, concepts), M.typed_links(r, context, concepts, unique=True)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, quick.collect()))
    assert exchanges(M.typed_links(r, unique=True)) == 0
    p = M.weighted_postings(M.node_table(r, M.typed_links(r)).localCheckpoint())
    assert exchanges(p) == 1
    assert {(x.term, x.tf, x.len) for x in p.filter("node_id = 'F_r2'").collect()} == {("2", 3.0, 7.0), ("act", 3.0, 7.0), ("beta", 1.0, 7.0)}


def test_scores_meet_asked_terms_by_broadcast(spark):
    from mnemix.operators import retrieval as R

    p = spark.createDataFrame([("t", f"F_{i}", 1.0, 2.0) for i in range(50)], "term string, node_id string, tf double, len double")
    lengths = spark.createDataFrame([(f"F_{i}", 2.0) for i in range(50)], "node_id string, len double")
    asked = spark.createDataFrame([(q, "t", 1.0) for q in range(9)], "query_id int, term string, weight double")
    s = R.bm25(p, lengths, asked)
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert s.count() == 450


def test_best_sums_keep_every_tie_and_match_all_sums(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from mnemix.operators import retrieval as R

    g = np.random.default_rng(3)
    parts = sorted({(f"F_{i}", f"k{j}", round(float(v), 1)) for i, j, v in zip(g.integers(0, 400, 3000), g.integers(0, 12, 3000), g.random(3000))})
    parts = list({p[:2]: p for p in parts}.values())
    asked = [(q, f"k{j}", 0.5 + 0.25 * (j % 3)) for q in range(30) for j in range(q % 12, min(12, q % 12 + 1 + q % 4))] + [(99, "none", 1.0)]
    p, a = spark.createDataFrame(parts, "node_id string, key string, value double"), spark.createDataFrame(asked, "query_id int, key string, weight double")
    every = p.join(a, "key").groupBy("query_id", "node_id").agg(F.round(F.sum(F.col("weight") * F.col("value")), 9).alias("s")).toPandas()
    want = {(r.query_id, r.node_id, r.s) for r in every[every.groupby("query_id").s.rank(method="min", ascending=False) <= 5].itertuples()}
    got = {(r.query_id, r.node_id, round(r.score, 9)) for r in R.best_sums(p, a, 5, block_parts=300, block_asked=20).collect()}
    assert {(q, n) for q, n, _ in got} == {(q, n) for q, n, _ in want} and np.isclose(sum(x[2] for x in got), sum(x[2] for x in want))


def test_a_stage_hands_on_its_best_and_not_every_pair(spark):
    from mnemix.operators import memory as M
    from mnemix.operators import retrieval as R

    rows = [(f"r{i}", "Act", "alpha " + "beta " * i, ["Alpha", f"B{i}"]) for i in range(300)]
    m = M.build(spark.createDataFrame(rows, "id string, action string, text string, data array<string>"))
    q = spark.createDataFrame([(1, "alpha"), (2, "alpha beta")], "query_id int, q string")
    hits = [(r.query_id, r.rank, r.id) for r in R.cascade(m, q, 5).orderBy("query_id", "rank").collect()]
    assert len(hits) == 10 and hits[0][2] == "F_r0"
    assert R.best_sums(*R.weighed(m.postings, m.lengths, R.query_terms(q).select("query_id", "term").selectExpr("*", "1d as weight")), 5).count() < 30


def test_hybrid_queries_build_one_memory(spark, monkeypatch):
    from mnemix.plans import registry, stores

    class Built(Exception):
        pass

    made = []
    monkeypatch.setattr(stores, "memory", lambda *a: made.append(1) or registry.M.Materialised(None))
    monkeypatch.setattr(stores, "embedded_memory", lambda *a: (None, None) if len(a) == 3 else made.append(2))
    monkeypatch.setattr(stores, "questions", lambda *a: spark.range(0))
    for name in ("hybrid", "hybrid_search"):
        monkeypatch.setattr(stores.R, name, lambda *a, **k: (_ for _ in ()).throw(Built))
    for q in (stores.r13_hybrid, stores.r21_hybrid_search):
        made.clear()
        with pytest.raises(Built):
            q(spark, "")
        assert made == [1]


def test_nodes_of_unique_records_need_no_join(spark):
    from mnemix.operators import memory as M

    rows = [("r1", "Act", "alpha", ["B", "A", "A"], ["x", "x"]), ("r2", "Act", "beta", ["A"], None), ("r3", "", "", [], [])]
    r = spark.createDataFrame(rows, "id string, action string, text string, data array<string>, access array<string>").localCheckpoint()
    links = M.typed_links(r, unique=True).localCheckpoint()
    plain, quick = M.node_table(r, links), M.node_table(r, links, unique=True)
    assert sorted(map(tuple, plain.select(*sorted(plain.columns)).collect())) == sorted(map(tuple, quick.select(*sorted(plain.columns)).collect()))
    assert "Join" not in quick._jdf.queryExecution().optimizedPlan().toString()


def test_communities_of_a_large_component_need_little_memory():
    import tracemalloc

    import numpy as np

    g = np.random.default_rng(1)
    a, b = g.integers(0, 400, 60_000) * 2, g.integers(0, 400, 60_000) * 2 + 1
    tracemalloc.start()
    nodes, own = topology._louvain(a, b, 60_000.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(nodes) == len(own) == len(set(a) | set(b)) and set(own) <= set(nodes)
    assert peak < 100 * 60_000  # bytes an edge
