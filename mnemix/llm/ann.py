"""Approximate nearest neighbours: one vantage-point tree per shard, with relaxed triangle-inequality pruning.

Largest inner product becomes smallest distance in one more dimension: with M the largest norm, x' = (x, sqrt(M^2 -
|x|^2)) and q' = (q / |q|, 0) give |q' - x'|^2 = M^2 + 1 - 2 <q, x> / |q|. A subtree is skipped when the bound the
triangle inequality gives, times a factor, exceeds the distance of the worst neighbour kept so far. Factor 1 is exact
search; a larger factor skips more.

Shards are cells around pivots, so the same bound also skips whole shards: a query first searches its nearest cell, and
the distance of its worst neighbour there decides which other cells it is sent to, and what they skip.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemix.llm.common import saved

HIT = "query_id long, vec_id long, score double"


class VantageTree:
    """A tree over the rows of `points`, built by distance to one vantage point a node and split at the median."""

    def __init__(self, points: np.ndarray, leaf: int = 128, seed: int = 0):
        self.points = points
        self.rng = np.random.default_rng([seed, len(points)])
        self.leaf = leaf
        self.half = 0.5 * (points**2).sum(axis=1)
        self.root = self._build(np.arange(len(points))) if len(points) else None

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        some = self.points[self.rng.choice(rows, min(8, len(rows)), replace=False)]
        seen = self.points[self.rng.choice(rows, min(64, len(rows)), replace=False)]
        spread = np.linalg.norm(some[:, None] - seen[None], axis=2).std(axis=1)
        vantage = some[int(spread.argmax())]
        d = np.linalg.norm(self.points[rows] - vantage, axis=1)
        mid = float(np.median(d))
        near = d < mid
        if not near.any() or near.all():
            return rows  # all at one distance: nothing to part
        return vantage, mid, self._build(rows[near]), self._build(rows[~near])

    def search(self, queries: np.ndarray, k: int, factor: float, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(distance, row) of the k nearest found of each query, unordered; rows are -1 where fewer than k are found.

        Only what is nearer than `within`, where it is given, is looked for.
        """
        best_d = np.full((len(queries), k), np.inf)
        if within is not None:
            best_d[:] = within[:, None]
        best_i = np.full((len(queries), k), -1)
        self.distances = 0
        if self.root is not None and len(queries):
            self._visit(self.root, np.arange(len(queries)), queries, best_d, best_i, factor)
        return best_d, best_i

    def _visit(self, node, who, q, best_d, best_i, factor) -> None:
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            self.distances += len(who) * len(node)
            square = self.half[node] + (0.5 * (q[who] ** 2).sum(1))[:, None] - q[who] @ self.points[node].T
            k = best_d.shape[1]
            better = square < 0.5 * best_d[who].max(axis=1)[:, None] ** 2
            hit = np.flatnonzero(better.any(axis=1))
            if not len(hit):
                return
            who, d = who[hit], np.sqrt(np.maximum(0.0, 2 * square[hit]))
            both_d = np.concatenate([best_d[who], d], axis=1)
            both_i = np.concatenate([best_i[who], np.broadcast_to(node, d.shape)], axis=1)
            keep = np.argpartition(both_d, k - 1, axis=1)[:, :k]
            best_d[who] = np.take_along_axis(both_d, keep, 1)
            best_i[who] = np.take_along_axis(both_i, keep, 1)
            return
        vantage, mid, inner, outer = node
        self.distances += len(who)
        d = np.sqrt(np.maximum(0.0, ((q[who] - vantage) ** 2).sum(1)))
        inside = d < mid
        for here, first, then in ((inside, inner, outer), (~inside, outer, inner)):
            some, gap = who[here], np.abs(d[here] - mid)
            self._visit(first, some, q, best_d, best_i, factor)
            open_ = gap * factor <= best_d[some].max(axis=1) + 1e-9
            self._visit(then, some[open_], q, best_d, best_i, factor)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64) if len(column) else np.zeros((0, 0))


def _search_shard(points: pd.DataFrame, queries: pd.DataFrame, k: int, factor: float, top_norm: float, block: int) -> Iterator[pd.DataFrame]:
    """Equal vectors are one point of the tree that holds their ids: ties go to smaller ids, and one may be the query's own."""
    pts = points.sort_values("vec_id")
    x = _matrix(pts["v"])
    ids = pts["vec_id"].to_numpy()
    uniq, where = np.unique(x, axis=0, return_inverse=True)
    where = where.ravel()
    order = np.argsort(where, kind="stable")
    starts = np.searchsorted(where[order], np.arange(len(uniq) + 1))
    tree = VantageTree(lifted(uniq, top_norm))
    for at in range(0, len(queries), block):
        part = queries.iloc[at : at + block]
        y = _matrix(part["v"])
        _, rows = tree.search(asked(y), min(k + 1, len(uniq)), factor, part["within"].to_numpy())
        own = part["vec_id"].to_numpy()
        out_q, out_v, out_s = [], [], []
        for j in range(len(part)):
            got = rows[j][rows[j] >= 0]
            score = (uniq[got] * y[j]).sum(axis=1)
            cand = [(-s, i) for s, g in zip(score, got) for i in ids[order[starts[g] : min(starts[g + 1], starts[g] + k + 1)]] if i != own[j]]
            cand.sort()
            out_q += [own[j]] * len(cand[:k])
            out_v += [i for _, i in cand[:k]]
            out_s += [-s for s, _ in cand[:k]]
        yield pd.DataFrame({"query_id": np.array(out_q, dtype="int64"), "vec_id": np.array(out_v, dtype="int64"), "score": np.array(out_s, dtype="float64")})


def lifted(x: np.ndarray, top_norm: float) -> np.ndarray:
    """Candidates in one more dimension, where all have one norm."""
    return np.column_stack([x, np.sqrt(np.maximum(0.0, top_norm**2 - (x**2).sum(1)))])


def asked(y: np.ndarray) -> np.ndarray:
    return np.column_stack([y / np.linalg.norm(y, axis=1, keepdims=True), np.zeros(len(y))])


FACTORS = (8.0, 6.0, 5.0, 4.0, 3.0, 2.5, 2.0, 1.6, 1.3, 1.1)


def measured_factor(x: np.ndarray, top_norm: float, k: int, recall: float, most_queries: int = 128) -> float:
    """The largest of FACTORS with which a tree over the sample x finds the wanted share of the k nearest of some of its rows; else 1."""
    q = x[:: max(1, len(x) // most_queries)]
    k = min(k, len(x))
    truth = np.argpartition(-(q @ x.T), k - 1, axis=1)[:, :k]
    tree = VantageTree(lifted(x, top_norm))
    for factor in FACTORS:
        _, rows = tree.search(asked(q), k, factor)
        if np.mean([len(np.intersect1d(a, b)) / k for a, b in zip(truth, rows)]) >= recall:
            return factor
    return 1.0


def chosen_pivots(x: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """n centers of the sample x: each start is farthest from those before, then means of the nearest rows."""
    c = x[[0]]
    far = np.full(len(x), np.inf)
    for _ in range(min(n, len(x)) - 1):
        far = np.minimum(far, ((x - c[-1]) ** 2).sum(1))
        c = np.vstack([c, x[[int(far.argmax())]]])
    for _ in range(rounds):
        own = _nearest_pivot(x, c)[0]
        c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * x @ c.T))


def _nearest_pivot(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = _distances(x, c)
    own = d.argmin(axis=1)
    return own, d[np.arange(len(x)), own]


def nearest(
    vectors: DataFrame, is_query, k: int = 20, factor: float | None = None, recall: float = 0.98, shard_rows: int = 16_384, most_cells: int = 512, query_block: int = 8192, block: int = 1024, sample_rows: int = 4096,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found of every row where the condition is_query holds.

    Candidates are all rows but the query's own. Pivots, at most most_cells, and the factor, unless given, come from a
    sample of sample_rows rows chosen by a hash: the factor is the largest that finds the share `recall` of the sample's
    own neighbours (measured_factor). Every row is indexed: cells hold about shard_rows rows, larger ones are dealt over
    several trees by a hash of the id, and queries of a cell are cut into blocks of query_block, so a task holds one tree
    and one block. factor 1 is exact, a larger one prunes more. Of equal vectors the k + 1 smallest ids can be answers,
    so only those are indexed. Vectors that are null, zero, of a null id, or hold null or non-finite components take no
    part; a query meets candidates of its own length only. Ties go to the smaller id; an id that stands for several
    vectors has the least of them. Fewer candidates than k give as many rows; an empty table none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    v = v.withColumn("norm", norm).filter((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    v = saved(v.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("is_query").alias("is_query"), F.min_by("norm", "v").alias("norm")), "vectors")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in v.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.count_if("is_query").alias("q")).orderBy("dim").collect():
        if r.q:
            out = out.unionByName(_nearest_of_length(v.filter(F.size("v") == r.dim), int(r.n), float(r.norm), k, factor, recall, shard_rows, most_cells, query_block, block, sample_rows))
    return out


def _nearest_of_length(v: DataFrame, n: int, top_norm: float, k: int, factor, recall, shard_rows, most_cells, query_block, block, sample_rows) -> DataFrame:
    spark = v.sparkSession
    some = np.array([r.v for r in v.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()])
    factor = factor or measured_factor(some, top_norm, k, recall)
    pivots = chosen_pivots(lifted(some, top_norm), max(1, min(most_cells, -(-n // shard_rows))))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own, far = _nearest_pivot(lifted(_matrix(b["v"]), top_norm), pivots) if len(b) else (np.zeros(0, int), np.zeros(0))
            yield b.assign(cell=own, far=far)

    same = Window.partitionBy("v").orderBy("vec_id")
    points = v.select("vec_id", "v").withColumn("rn", F.row_number().over(same)).filter(F.col("rn") <= k + 1).drop("rn")
    points = saved(points.mapInPandas(place, "vec_id long, v array<double>, cell int, far double"), "points")
    about = points.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("least"), F.max("far").alias("most")).collect()  # one row a cell
    trees = {r.cell: -(-r.n // shard_rows) for r in about}
    cells = np.array([r.cell for r in about])
    low, high = np.array([r.least for r in about]), np.array([r.most for r in about])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query with the nearest cell that holds points."""
        for b in batches:
            home = cells[_distances(asked(_matrix(b["v"])), pivots[cells]).argmin(axis=1)] if len(b) else np.zeros(0, int)
            yield b.assign(cell=home, within=np.inf)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query with every other cell that its worst neighbour so far leaves open."""
        for b in batches:
            if not len(b):
                continue
            y = _matrix(b["v"])
            d = _distances(asked(y), pivots[cells])
            worst = np.sqrt(np.maximum(0.0, top_norm**2 + 1 - 2 * b["worst"].to_numpy(float) / np.linalg.norm(y, axis=1)))
            within = np.where(np.isfinite(worst), worst * (1 + 1e-9) + 1e-9, np.inf)
            gap = np.maximum(np.maximum(d - high, low - d), 0.0)
            open_ = (gap * factor <= within[:, None] + 1e-9) & (cells[None] != b["cell"].to_numpy()[:, None])
            at, c = np.nonzero(open_)
            yield pd.DataFrame({"vec_id": b["vec_id"].to_numpy()[at], "v": b["v"].to_numpy()[at], "cell": cells[c], "within": within[at]})

    def search(pts: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if not len(pts) or not len(qs):
            return pd.DataFrame({"query_id": np.array([], "int64"), "vec_id": np.array([], "int64"), "score": np.array([], "float64")})
        return pd.concat(_search_shard(pts, qs, k, factor, top_norm, block), ignore_index=True)

    def found(queries: DataFrame) -> DataFrame:
        blocks = {r.cell: -(-r.n // query_block) for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a cell
        if not blocks:
            return spark.createDataFrame([], HIT)
        plan = F.broadcast(spark.createDataFrame([(int(c), int(trees[c]), int(b)) for c, b in blocks.items()], "cell int, trees int, blocks int"))  # at most most_cells rows
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        p = points.join(plan, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("trees")).cast("int").alias("tree"), each("blocks").alias("block"), "vec_id", "v")
        q = queries.join(plan, "cell").select("cell", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("blocks")).cast("int").alias("block"), each("trees").alias("tree"), "vec_id", "v", "within")
        return p.groupBy("cell", "tree", "block").cogroup(q.groupBy("cell", "tree", "block")).applyInPandas(search, HIT)

    asked_schema = "vec_id long, v array<double>, cell int, within double"
    queries = saved(v.filter("is_query").select("vec_id", "v").mapInPandas(ask, asked_schema), "queries")
    near = saved(found(queries), "near")
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if len(cells) > 1:
        worst = near.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("worst"))
        far = queries.select("vec_id", "v", "cell").join(worst, "vec_id", "left").fillna(float("-inf"), ["worst"])
        near = near.unionByName(found(saved(far.mapInPandas(route, asked_schema), "routed")))
    return near.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
