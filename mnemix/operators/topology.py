"""Components, communities, modularity and bounded traversal of an undirected graph."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemix.sources.tables import checkpointed, components, running, saved


def _louvain(a: np.ndarray, b: np.ndarray, m: float) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, communities): one level of greedy modularity moves in node order, until a sweep moves nothing or twenty are done.

    Edges are arrays of both ends in their order; a node's neighbours are a slice of one array, in that order, so an edge
    costs some dozen bytes and not two list entries and a tuple.
    """
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = len(a)
    kind = np.int32 if len(nodes) < 2**31 else np.int64
    ends = ends.astype(kind)
    first = np.stack([ends[:n], ends[n:]], axis=1).ravel()
    near = np.stack([ends[n:], ends[:n]], axis=1).ravel()
    order = np.argsort(first, kind="stable")
    near = near[order]
    cut = np.searchsorted(first[order], np.arange(len(nodes) + 1))
    del first, ends, order
    own, size = list(range(len(nodes))), np.diff(cut).astype(float).tolist()
    cut = cut.tolist()
    for _ in range(20):
        moved = False
        for v in range(len(nodes)):
            mine = near[cut[v] : cut[v + 1]].tolist()
            k = len(mine)
            into: dict[int, float] = defaultdict(float)
            for u in mine:
                into[own[u]] += 1.0
            home = own[v]
            stay = into.get(home, 0.0) / m - k * (size[home] - k) / (2 * m * m)
            gain, best = max(((into[c] / m - k * size[c] / (2 * m * m) - stay, -c) for c in into if c != home), default=(0.0, 0))
            if gain > 0:
                size[home] -= k
                size[-best] += k
                own[v], moved = -best, True
        if not moved:
            break
    return nodes, nodes[np.array(own, np.int64)] if len(nodes) else nodes


def communities(edges: DataFrame) -> DataFrame:
    """(node, community) of edges (a, b, seq): nodes are numbered in the order edges first name them, repeated edges count.

    A component never looks at another, so each is one task with the number of all edges passed in; communities are
    numbered by their first node.
    """
    m = float(edges.count())
    ends = edges.select(F.col("a").alias("node"), (F.col("seq") * 2).alias("at")).unionByName(edges.select(F.col("b").alias("node"), (F.col("seq") * 2 + 1).alias("at")))
    number = checkpointed(ends.groupBy("node").agg(F.min("at").alias("idx")))
    e = edges.join(number.select(F.col("node").alias("a"), F.col("idx").alias("ia")), "a").join(number.select(F.col("node").alias("b"), F.col("idx").alias("ib")), "b")
    roots = components(e.select(F.col("ia").alias("a"), F.col("ib").alias("b")))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(part["seq"].to_numpy(), kind="stable")
        nodes, own = _louvain(part["ia"].to_numpy()[order], part["ib"].to_numpy()[order], m)
        return pd.DataFrame({"idx": nodes, "c": own})

    found = e.join(roots, F.col("ia") == F.col("node")).select("root", "seq", "ia", "ib").groupBy("root").applyInPandas(solve, "idx long, c long")  # numbers only
    found = saved(found, "louvain")
    first = found.groupBy("c").agg(F.min("idx").alias("first"))
    dense = running(first, ["first"], F.lit(1).cast("long"), "place").select("c", (F.col("place") - 1).alias("community"))
    return found.join(dense, "c").join(number, "idx").select("node", "community")


def modularity(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Sum over communities of inside / m less (total / 2m) squared."""
    p = parts.select("node", "community")
    d = edges.join(p.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(p.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    m = d.count()
    total = d.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.count("*").alias("t"))
    inside = d.filter("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.count("*").alias("i"))
    return total.join(inside, "c", "left").agg(F.round(F.sum(F.coalesce("i", F.lit(0)) / m - (F.col("t") / (2 * m)) ** 2), 6).alias("modularity"))


def traverse(nodes: DataFrame, links: DataFrame, starts: DataFrame, hops: int, limit: int) -> DataFrame:
    """(start, node_id, depth, ord): breadth-first from each start, neighbours by level, degree, id; at most limit a start."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = starts.select(F.col("node_id").alias("start"), "node_id", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("ord"))
    for depth in range(1, hops + 1):
        edge = seen.filter(F.col("depth") == depth - 1).join(both, F.col("node_id") == F.col("a")).select("start", "ord", F.col("b").alias("next"))
        new = edge.join(seen.select(F.col("start").alias("s"), F.col("node_id").alias("n")), (F.col("start") == F.col("s")) & (F.col("next") == F.col("n")), "left_anti")
        new = new.groupBy("start", "next").agg(F.min("ord").alias("parent")).join(nodes.select(F.col("node_id").alias("next"), "level_rank", "degree"), "next")
        w = Window.partitionBy("start").orderBy("parent", "level_rank", F.desc("degree"), "next")
        held = seen.groupBy("start").agg(F.max("ord").alias("held"))
        new = new.withColumn("rn", F.row_number().over(w)).join(held, "start").withColumn("ord", F.col("held") + F.col("rn")).filter(F.col("ord") <= limit)
        seen = checkpointed(seen.unionByName(new.select("start", F.col("next").alias("node_id"), F.lit(depth).alias("depth"), "ord")))
    return seen


def blocks(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """(node_id, block): the name of each node's block.

    A community with one record is named by it, one without records by its number as data, others by their number; a
    node outside all communities is a block of its own.
    """
    own = parts.select(F.col("node").alias("node_id"), "community")
    g = own.groupBy("community").agg(F.count_if(F.col("node_id").startswith("F_")).alias("n"), F.min(F.when(F.col("node_id").startswith("F_"), F.substr("node_id", F.lit(3)))).alias("one"))
    name = F.when(F.col("n") == 1, F.concat(F.lit("C - "), "one")).when(F.col("n") == 0, F.concat(F.lit("C - Data_"), F.col("community").cast("string"))).otherwise(F.concat(F.lit("C - Community_"), F.col("community").cast("string")))
    named = own.join(g, "community").select("node_id", name.alias("block"))
    return nodes.select("node_id").join(named, "node_id", "left").select("node_id", F.coalesce("block", F.concat(F.lit("C - "), F.substr("node_id", F.lit(3)))).alias("block"))


def search_blocks(named: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, block): blocks whose name, or the id of a member, contains the query, case aside."""
    names = named.select("block", F.lower("block").alias("low")).unionByName(named.select("block", F.lower("node_id").alias("low"))).distinct()
    return names.join(queries.select("query_id", F.lower("q").alias("lq")), F.contains("low", F.col("lq"))).select("query_id", "block").distinct()


def blocks_json(nodes: DataFrame, named: DataFrame, records: DataFrame) -> DataFrame:
    """(block, json): each block as a JSON object of its name and nodes; records carry their action and what they are linked to."""
    pre = lambda c, p: F.transform(c, lambda x: F.concat(F.lit(p), x))
    own = records.select(F.concat(F.lit("F_"), "id").alias("node_id"), "action", pre("data", "D_").alias("data"), pre("access", "A_").alias("access"), pre("events", "E_").alias("events"))
    d = named.join(nodes.select("node_id", "level"), "node_id").join(own, "node_id", "left")
    node = F.struct(F.col("node_id").alias("id"), F.coalesce("action", F.substr("node_id", F.lit(3))).alias("action"), F.initcap("level").alias("topology_level"), F.col("data").alias("data_connections"), "access", "events")
    g = d.groupBy("block").agg(F.array_sort(F.collect_list(node)).alias("nodes"))  # a block is shown whole
    return g.select("block", F.to_json(F.struct(F.col("block").alias("name"), F.lit(0).alias("depth"), F.lit("Component").alias("topology_level"), "nodes", F.array().cast("array<string>").alias("sub_blocks"))).alias("json"))


# The prefixes of node ids, in the order in which a bare id is looked for.
PREFIXES = ("", "F_", "D_", "K_", "A_", "E_")


def resolved(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(q, node_id) of asked (q): the node of that id, else of the first prefix under which there is one."""
    tries = F.transform(F.array(*[F.lit(p) for p in PREFIXES]), lambda p: F.concat(p, F.col("q")))
    d = asked.select("q").distinct().select("q", F.posexplode(tries).alias("at", "node_id")).join(nodes.select("node_id"), "node_id")
    return d.groupBy("q").agg(F.min_by("node_id", "at").alias("node_id"))
