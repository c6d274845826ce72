"""Batched retrieval: BM25, typo-tolerant terms, the staged cascade, spreading, dense search, rank fusion, context text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemix.functions import text as T
from mnemix.operators.memory import Memory, both_ways, vocabulary_grams, vocabulary_of
from mnemix.sources.tables import few, saved

K1, B = 1.2, 0.75
POOL, RRF = 50, 60
BASE = {"exact": 1.0, "substring": 0.8, "stem": 0.75, "fuzzy": 0.5, "dense": 0.5, "hub": 0.05}
PLACES = 9  # scores are rounded before ranking, so that ties fall to the written order


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, place, term) of queries (query_id, q), repeats kept."""
    return queries.select("query_id", F.posexplode(T.terms(F.col("q"))).alias("place", "term"))


def weighed(postings: DataFrame, lengths: DataFrame, weighted: DataFrame, k1: float = K1, b: float = B, kind: str = "") -> tuple[DataFrame, DataFrame]:
    """parts (node_id, key, value) and asked (query_id, key, weight) for (query_id, term, weight): BM25 is the sum of weight * value over the keys.

    A key is a term after `kind`; N and the mean length are over all nodes. The asked terms' postings are taken out once.
    """
    stats = lengths.agg(F.count("*").alias("n_all"), F.avg("len").alias("avg_len")).first()  # one row
    asked = saved(weighted.select("query_id", "term", "weight"), "weights")
    held = postings.join(few(asked.select("term").distinct()), "term", "left_semi")
    held = saved(held if "len" in postings.columns else held.join(lengths, "node_id"), "asked")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((stats.n_all - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    key = F.concat(F.lit(kind), "term").alias("key")
    asked = saved(asked.join(df, "term").select("query_id", key, (F.col("weight") * idf).alias("weight")), "weights")
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(stats.avg_len)))
    return held.filter("node_id is not null").select("node_id", key, part.alias("value")), asked


def bm25(postings: DataFrame, lengths: DataFrame, weighted: DataFrame, k1: float = K1, b: float = B, k: int | None = None, places: int = PLACES) -> DataFrame:
    """(query_id, node_id, score) for (query_id, term, weight); N and the mean length are over all nodes.

    Of each query, all nodes that hold a term, or, with k, those that best_sums() keeps.
    """
    parts, asked = weighed(postings, lengths, weighted, k1, b)
    if k is not None:
        return best_sums(parts, asked, k, places)
    return parts.join(few(asked), "key").groupBy("query_id", "node_id").agg(F.sum(F.col("weight") * F.col("value")).alias("score"))


def best_sums(parts: DataFrame, asked: DataFrame, k: int, places: int = PLACES, block_parts: int = 400_000, block_asked: int = 200_000) -> DataFrame:
    """(query_id, node_id, score): sums of weight * value over shared keys, of each query at least all that are among the k largest
    when rounded to `places`, ties with the last included.

    parts (node_id, key, value), no key twice at a node; asked (query_id, key, weight). Every pair is summed, but where its node's
    parts are: nodes are dealt into blocks, a block adds each query's keys up in arrays, and only its best leave it. So what
    is shuffled are the parts, once for each block of queries, and never a row for each query and node.
    """
    import numpy as np
    import pandas as pd

    slack = 2 * 10.0**-places  # sums that round alike differ by less

    def search(ns: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if not len(ns) or not len(qs):
            return pd.DataFrame({"query_id": qs["query_id"][:0], "node_id": ns["node_id"][:0], "score": np.zeros(0)})
        node, names = pd.factorize(ns["node_id"])
        order = np.argsort(ns["key_no"].to_numpy(), kind="stable")
        key, node, value = ns["key_no"].to_numpy()[order], node[order], ns["value"].to_numpy()[order]
        query, ids = pd.factorize(qs["query_id"], sort=True)
        order = np.lexsort((qs["key_no"].to_numpy(), query))
        query, weight = query[order], qs["weight"].to_numpy()[order]
        lo, hi = (np.searchsorted(key, qs["key_no"].to_numpy()[order], side=s) for s in ("left", "right"))
        ends = np.searchsorted(query, np.arange(len(ids) + 1))
        total, who, which, scores = np.zeros(len(names)), [], [], []
        for q in range(len(ids)):
            mine = [i for i in range(ends[q], ends[q + 1]) if hi[i] > lo[i]]
            if not mine:
                continue
            for i in mine:
                total[node[lo[i] : hi[i]]] += weight[i] * value[lo[i] : hi[i]]
            met = np.concatenate([node[lo[i] : hi[i]] for i in mine])
            s, most = total[met], k * len(mine)  # a node is met once a key at most, so k nodes reach the value at that place
            if most < len(s):
                met = met[s >= np.partition(s, len(s) - most)[len(s) - most] - slack]
            met = np.unique(met)
            s = total[met]
            if k < len(s):
                keep = s >= np.partition(s, len(s) - k)[len(s) - k] - slack
                met, s = met[keep], s[keep]
            for i in mine:
                total[node[lo[i] : hi[i]]] = 0.0
            who.append(np.full(len(met), q))
            which.append(met)
            scores.append(s)
        if not who:
            return pd.DataFrame({"query_id": qs["query_id"][:0], "node_id": ns["node_id"][:0], "score": np.zeros(0)})
        return pd.DataFrame({"query_id": ids[np.concatenate(who)], "node_id": names[np.concatenate(which)], "score": np.concatenate(scores)})

    keys = saved(asked.select("key").distinct().withColumn("key_no", F.monotonically_increasing_id()), "keys")
    asked = saved(asked.join(few(keys), "key").select("query_id", "key_no", "weight"), "asked")
    parts = saved(parts.join(few(keys), "key").select("node_id", "key_no", "value"), "parts")
    cores = parts.sparkSession.sparkContext.defaultParallelism
    nq = max(1, -(-asked.count() // block_asked))
    nv = max(-(-parts.count() // block_parts), -(-cores // nq))
    cut = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    p = parts.select("node_id", "key_no", "value", block("node_id", nv).alias("vb"), cut(nq).alias("qb"))
    a = asked.select("query_id", "key_no", "weight", block("query_id", nq).alias("qb"), cut(nv).alias("vb"))
    kinds = dict(asked.dtypes)["query_id"], dict(parts.dtypes)["node_id"]
    found = p.groupBy("vb", "qb").cogroup(a.groupBy("vb", "qb")).applyInPandas(search, f"query_id {kinds[0]}, node_id {kinds[1]}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", places)))  # of the blocks' best, with ties
    return found.withColumn("at", F.rank().over(best)).filter(F.col("at") <= k).drop("at")


def similar_terms(vocab: DataFrame, words: DataFrame, least: float = 0.4, k: int | None = 3) -> DataFrame:
    """(word, term, sim, rank): the k vocabulary terms of largest gram Jaccard (all, without k), by an equi-join on grams."""
    asked = words.select("word").distinct().withColumn("grams", T.trigrams(F.col("word")))
    pairs = asked.select("word", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(vocabulary_grams(vocab), "gram")
    sims = pairs.groupBy("word", "term").agg((F.count("*") / (F.first("n") + F.first("ngrams") - F.count("*"))).alias("sim")).filter(F.col("sim") >= least)
    w = Window.partitionBy("word").orderBy(F.desc("sim"), "term")
    ranked_ = sims.withColumn("rank", F.row_number().over(w))
    return ranked_ if k is None else ranked_.filter(F.col("rank") <= k)


def substring_hits(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, node_id): the whole query, lower-case, within an id or label; for queries of content and three characters.

    A name that holds the query holds each of its three-character windows, so the names meet the query under the
    window that the fewest names have, by an equi-join, and only those are looked through.
    """
    q = queries.filter((F.size(T.terms(F.col("q"))) > 0) & (F.length(F.trim("q")) >= 3)).select("query_id", F.lower("q").alias("lq"))
    windows = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substr(c, i, F.lit(3))))
    asked = q.select("query_id", "lq", F.explode(windows(F.col("lq"))).alias("w"))
    names = nodes.select("node_id", F.explode(F.array_distinct(F.array(F.lower("node_id"), F.lower("label")))).alias("name"))
    held = saved(names.select("node_id", "name", F.explode(windows(F.col("name"))).alias("w")).join(asked.select("w").distinct(), "w", "left_semi"), "windows")
    few = asked.join(held.groupBy("w").agg(F.count("*").alias("n")), "w", "left").groupBy("query_id", "lq").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w")).alias("b"))
    found = held.join(few.filter("b.n > 0").select("query_id", "lq", F.col("b.w").alias("w")), "w")
    return found.filter(F.contains("name", F.col("lq"))).select("query_id", "node_id").distinct()


def spread(parts: DataFrame, asked: DataFrame, shared: DataFrame, memory: Memory, k: int) -> DataFrame:
    """(query_id, node_id, score): records keep their score; another node gives half of its own, over the root of its records, to each of them.

    parts and asked as in best_sums(), of records; shared (query_id, node_id, score) of other nodes, which are few a query.
    Of each query, what best_sums() keeps. A query none of whose scores reaches a record keeps its scores.
    """
    fdeg = memory.nodes.filter(~F.col("node_id").startswith("F_")).select("node_id", "fdeg")
    key = F.concat(F.lit("link:"), "node_id").alias("key")
    given = saved(shared.join(fdeg, "node_id").select("query_id", key, "node_id", (0.5 * F.col("score") / F.greatest(F.sqrt("fdeg"), F.lit(1.0))).alias("weight")), "given")
    fans = both_ways(memory.links).filter(F.col("b").startswith("F_")).join(few(given.select(F.col("node_id").alias("a"), "key").distinct()), "a")
    parts = parts.unionByName(fans.select(F.col("b").alias("node_id"), "key", F.lit(1.0).alias("value")))
    reached = saved(best_sums(parts, asked.unionByName(given.select("query_id", "key", "weight")), k), "reached")
    kept = shared.join(reached.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "node_id", "score")
    return reached.unionByName(kept)


def ranked(scores: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "level_rank", F.desc("degree"), "node_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))  # with ties; limited before it is shuffled
    some = scores.withColumn("score", F.round("score", PLACES)).withColumn("at", F.rank().over(best)).filter(F.col("at") <= k)
    d = some.drop("at").join(nodes.select("node_id", "level_rank", "degree"), "node_id")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "node_id", "score")


def hubs(nodes: DataFrame, k: int) -> DataFrame:
    """The k best linked records, or nodes if there is no record."""
    return nodes.orderBy(F.desc(F.col("level") == "function"), F.desc("degree"), "node_id").limit(k)


def stages(memory: Memory, queries: DataFrame, k: int, checkpoint=lambda d: d) -> tuple[DataFrame, DataFrame]:
    """(scores, verdicts): scores (query_id, node_id, score), spread, of each query's first stage that finds anything, its k
    best with ties at least, and (query_id, stage, coverage). Each stage sees the queries the ones before left; checkpoint materialises what is left."""
    qt = query_terms(queries)
    once = saved(qt.select("query_id", "term").distinct().withColumn("weight", F.lit(1.0)), "once")
    share = lambda hit: qt.join(hit, ["query_id", "term"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("coverage"))
    record = F.col("node_id").startswith("F_")
    direct = lambda d: (d.select("node_id", F.concat(F.lit("query:"), F.col("query_id").cast("string")).alias("key"), F.col("score").alias("value")), d.select("query_id", F.concat(F.lit("query:"), F.col("query_id").cast("string")).alias("key"), F.lit(1.0).alias("weight")).distinct())
    sums = lambda p, a: p.filter(~record).join(few(a), "key").groupBy("query_id", "node_id").agg(F.sum(F.col("weight") * F.col("value")).alias("score"))
    exact, asked = weighed(memory.postings, memory.lengths, once, kind="term:")
    sub = saved(substring_hits(memory.nodes, queries), "substring")
    named = saved(sub.select("query_id").distinct(), "named")
    first = asked.select("query_id").distinct()
    boosted = asked.join(few(named), "query_id", "left_semi")
    top = best_sums(exact, boosted, 1).groupBy("query_id").agg(F.max("score").alias("top"))
    boost = saved(sub.join(top, "query_id").select("query_id", "node_id", (0.25 * F.col("top")).alias("score")), "boost")
    held = vocabulary_of(memory).select("term").withColumn("hit", F.lit(1.0))
    verdicts = [share(once.join(held, "term").select("query_id", "term", "hit")).join(first, "query_id").withColumn("stage", F.lit("exact"))]
    scores = [(exact, asked), direct(boost)]
    left = checkpoint(queries.join(first, "query_id", "left_anti"))

    found = saved(sub.join(left.select("query_id"), "query_id", "left_semi").withColumn("score", F.lit(1.0)), "found")
    scores.append(direct(found))
    names = found.join(memory.nodes.select("node_id", F.lower(F.concat_ws("\n", "node_id", "label")).alias("name")), "node_id")
    hit = names.join(once, "query_id").filter(F.contains("name", F.col("term"))).select("query_id", "term").distinct().withColumn("hit", F.lit(1.0))
    verdicts.append(share(hit).join(found.select("query_id").distinct(), "query_id").withColumn("stage", F.lit("substring")))
    left = checkpoint(left.join(found.select("query_id").distinct(), "query_id", "left_anti"))

    here = once.join(left.select("query_id"), "query_id", "left_semi")
    stemmed = here.select("query_id", "term", T.stem(F.col("term")).alias("s"))
    meant = vocabulary_of(memory).select(F.col("term").alias("word"), T.stem(F.col("term")).alias("term")).join(stemmed.select(F.col("s").alias("term")).distinct(), "term", "left_semi")
    near = memory.postings.withColumnRenamed("term", "word").join(few(saved(meant, "meant")), "word")
    stems = saved(near.groupBy("term", "node_id").agg(F.sum("tf").alias("tf"), *([F.first("len").alias("len")] if "len" in near.columns else [])), "stems")
    scores.append(weighed(stems, memory.lengths, stemmed.select("query_id", F.col("s").alias("term")).distinct().withColumn("weight", F.lit(1.0)), kind="stem:"))
    found = scores[-1][1].select("query_id").distinct()
    hit = stemmed.join(stems.select(F.col("term").alias("s")).distinct(), "s").select("query_id", "term").withColumn("hit", F.lit(1.0))
    verdicts.append(share(hit).join(found, "query_id").withColumn("stage", F.lit("stem")))
    left = checkpoint(left.join(found, "query_id", "left_anti"))

    here = once.join(left.select("query_id"), "query_id", "left_semi")
    near = similar_terms(vocabulary_of(memory), here.select(F.col("term").alias("word")))
    used = saved(here.select("query_id", F.col("term").alias("word")).join(near, "word"), "fuzzy")
    scores.append(weighed(memory.postings, memory.lengths, used.groupBy("query_id", "term").agg(F.sum("sim").alias("weight")), kind="fuzzy:"))
    found = scores[-1][1].select("query_id").distinct()
    hit = used.select("query_id", F.col("word").alias("term")).distinct().withColumn("hit", F.lit(1.0))
    verdicts.append(share(hit).join(found, "query_id").withColumn("stage", F.lit("fuzzy")))
    left = checkpoint(left.join(found, "query_id", "left_anti"))
    verdicts.append(left.select("query_id", F.lit(0.0).alias("coverage"), F.lit("hub").alias("stage")))
    parts, asked = (reduce(DataFrame.unionByName, s) for s in zip(*scores))
    shared = saved(reduce(DataFrame.unionByName, [sums(p, a) for p, a in scores]).groupBy("query_id", "node_id").agg(F.sum("score").alias("score")), "shared")
    return spread(parts.filter(record), asked, shared, memory, k), reduce(DataFrame.unionByName, [v.select("query_id", "stage", "coverage") for v in verdicts])


def confidence(stage: Column, coverage: Column, dense_ok: Column, similarity: Column) -> Column:
    base = F.coalesce(*[F.when(stage == n, F.lit(v)) for n, v in BASE.items()], F.lit(0.0))
    lexical = base * (0.5 + 0.5 * F.greatest(coverage, F.when(dense_ok, 0.5).otherwise(0.0)))
    return F.least(F.when(stage == "dense", base * similarity).otherwise(lexical), F.lit(1.0))


def cascade(memory: Memory, queries: DataFrame, k: int = 5, checkpoint=lambda d: d) -> DataFrame:
    """One row a hit: query_id, stage, matched, handoff, coverage, confidence, rank, id, score (of the top score)."""
    scores, verdicts = stages(memory, queries, k, checkpoint)
    hits = ranked(scores, memory.nodes, k)
    last = hubs(memory.nodes, k).select("node_id", F.row_number().over(Window.orderBy(F.desc("degree"), "node_id")).alias("rank"), F.lit(0.0).alias("score"))
    lost = verdicts.filter("stage = 'hub'").select("query_id").join(F.broadcast(last))  # at most k rows
    hits = hits.unionByName(lost.select("query_id", "rank", "node_id", "score"))
    top = F.greatest(F.max("score").over(Window.partitionBy("query_id")), F.lit(1e-9))
    d = hits.join(verdicts, "query_id").withColumn("score", F.round(F.col("score") / top, 6))
    matched = F.col("stage") != "hub"
    return d.select(
        "query_id", "stage", matched.alias("matched"), (~matched | (F.col("coverage") < 0.5)).alias("handoff"), F.round("coverage", 6).alias("coverage"),
        F.round(confidence(F.col("stage"), F.col("coverage"), F.lit(False), F.lit(0.0)), 6).alias("confidence"), "rank", F.col("node_id").alias("id"), "score",
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def unit(v: Column) -> Column:
    """v over its length, which is bound by an outer lambda: inside the inner one it would be computed for each component."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.get(F.transform(F.array(norm), lambda n: F.transform(v, lambda x: x.cast("double") / n)), F.lit(0))


# Components of a block of vectors and of one of queries: a task holds one of each, and every block is shuffled once for each of the others.
VECTOR_CELLS, QUERY_CELLS = 1 << 22, 1 << 21


def _top_of_blocks(vectors: DataFrame, queries: DataFrame, keys: list[str], k: int, kinds: tuple[str, str], rows: int = 256, columns: int = 8192) -> DataFrame:
    """Vectors and queries of one block meet in numpy, each block keeps its own top k, and only those meet in the final ranking.

    Products are made a tile of rows x columns at a time; of a tile only what reaches a query's k-th value so far is held.
    """
    import numpy as np
    import pandas as pd

    def first(row, col, sim):
        """The k first of each row: larger sim, then smaller col."""
        order = np.lexsort((col, -sim, row))
        row, col, sim = row[order], col[order], sim[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[keep], col[keep], sim[keep]

    def best(a, m):
        held, edge = (np.zeros(0, int), np.zeros(0, int), np.zeros(0)), np.full((len(a), 1), -np.inf)
        for at in range(0, len(m), columns):
            s = a @ m[at : at + columns].T
            np.round(s, PLACES, out=s)
            if not at and k < s.shape[1]:
                edge = -np.partition(-s, k - 1, axis=1)[:, [k - 1]]
            row, col = np.nonzero(s >= edge)
            held = tuple(np.concatenate(x) for x in zip(held, (row, col + at, s[row, col])))
            if len(held[0]) > 4 * k * len(a):
                held = first(*held)
                full = np.flatnonzero(np.bincount(held[0], minlength=len(a)) == k)
                edge[full, 0] = held[2][np.searchsorted(held[0], full, side="right") - 1]
        return first(*held)

    def search(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if not len(vs) or not len(qs):
            return pd.DataFrame({"query_id": qs["query_id"][:0], "node_id": vs["node_id"][:0], "sim": np.zeros(0)})
        vs = vs.sort_values("node_id")
        m, ids, out = np.array(vs["vec"].tolist()), vs["node_id"].to_numpy(), []
        del vs
        for at in range(0, len(qs), rows):
            part = qs.iloc[at : at + rows]
            a = np.array(part["vec"].tolist())
            if k < len(ids):
                row, col, sim = best(a, m)
            else:
                sim = np.round(a @ m.T, PLACES).ravel()
                row, col = np.divmod(np.arange(sim.size), len(ids))
            out.append((part["query_id"].to_numpy()[row], ids[col], sim))
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("query_id", "node_id", "sim"), zip(*out))})

    hits = vectors.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(search, f"query_id {kinds[0]}, node_id {kinds[1]}, sim double")
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "node_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "node_id", "sim")


def dense_top(vectors: DataFrame, queries: DataFrame, k: int = POOL, vector_cells: int = VECTOR_CELLS, query_cells: int = QUERY_CELLS) -> DataFrame:
    """(query_id, rank, node_id, sim): exact search, blocks of vectors against blocks of queries.

    The numbers of blocks follow the tables' sizes, so a task holds about vector_cells and query_cells components whatever
    they are, and there are at least as many tasks as cores. Of n vectors and n queries the pairs are n * n and what is
    shuffled has n * n over a block's rows, so blocks are as large as a task can well hold.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    v = saved(vectors.select("node_id", unit(F.col("vec")).alias("vec")), "units")
    q = saved(queries.select("query_id", unit(F.col("vec")).alias("vec")), "asked")
    n, dim = v.agg(F.count("*"), F.max(F.size("vec"))).first()  # one row
    nq = max(1, -(-q.count() // max(1, query_cells // max(1, dim or 1))))
    nv = max(1, -(-n // max(1, vector_cells // max(1, dim or 1))), -(-cores // nq))
    cut = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = v.select("node_id", "vec", F.pmod(F.xxhash64("node_id"), F.lit(nv)).cast("int").alias("vb"), cut(nq).alias("qb"))
    q = q.select("query_id", "vec", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("qb"), cut(nv).alias("vb"))
    return _top_of_blocks(v, q, ["vb", "qb"], k, (dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["node_id"]))


def rrf(rankings: list[DataFrame], k: int, pool: int = POOL, offset: int = RRF) -> DataFrame:
    """(query_id, rank, node_id, score): reciprocal rank fusion of the first `pool` of each ranking (query_id, rank, node_id)."""
    all_ = rankings[0].select("query_id", "rank", "node_id")
    for r in rankings[1:]:
        all_ = all_.unionByName(r.select("query_id", "rank", "node_id"))
    fused = all_.filter(F.col("rank") <= pool).groupBy("query_id", "node_id").agg(F.round(F.sum(1.0 / (F.col("rank") + offset)), PLACES).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "node_id", "score")


def context(hits: DataFrame, budget: int) -> DataFrame:
    """(query_id, context): lines "- label: text" in rank order up to the first that would exceed the budget of bytes."""
    line = F.concat(F.lit("- "), "label", F.lit(": "), "text", F.lit("\n"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = hits.withColumn("line", line).withColumn("used", F.sum(F.octet_length("line")).over(w)).withColumn("fits", F.min((F.col("used") <= budget).cast("int")).over(w))
    g = d.groupBy("query_id").agg(F.sort_array(F.collect_list(F.when(F.col("fits") == 1, F.struct("rank", "line")))).alias("l"))
    return g.select("query_id", F.array_join(F.transform("l", lambda x: x["line"]), "").alias("context"))


def recall_at(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Mean share of each query's first k true neighbours that were found."""
    t = truth.filter(F.col("rank") <= k).select("query_id", "node_id")
    f = found.filter(F.col("rank") <= k).select("query_id", "node_id").withColumn("hit", F.lit(1))
    per = t.join(f, ["query_id", "node_id"], "left").groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("r"))
    return per.agg(F.round(F.avg("r"), 6).alias("recall"))


def hybrid(memory: Memory, queries: DataFrame, vectors: DataFrame, asked: DataFrame, k: int = 5, least_sim: float = 0.35, mode: str = "hybrid", fuzzy_requires_dense: bool = False, checkpoint=lambda d: d) -> DataFrame:
    """cascade() fused with dense search; vectors (node_id, vec) of records, asked (query_id, vec).

    mode lexical ignores the vectors; dense ranks by similarity alone, without a floor; hybrid fuses the first fifty of
    both, and where the lexical stage was hub but the best similarity reaches least_sim, the stage is dense.
    """
    if mode == "lexical":
        return cascade(memory, queries, k, checkpoint)
    dense = checkpoint(dense_top(vectors, asked, POOL))
    best = dense.filter("rank = 1").select("query_id", F.col("sim").alias("top_sim"))
    if mode == "dense":
        d = dense.filter(F.col("rank") <= k).join(best, "query_id")
        sure = F.col("top_sim") >= least_sim
        return d.select("query_id", F.lit("dense").alias("stage"), F.lit(True).alias("matched"), (~sure).alias("handoff"), F.lit(0.0).alias("coverage"), F.round(F.least(0.5 * F.col("top_sim"), F.lit(1.0)), 6).alias("confidence"), "rank", F.col("node_id").alias("id"), F.round(F.col("sim") / F.col("top_sim"), 6).alias("score"))
    scores, verdicts = stages(memory, queries, POOL, checkpoint)
    v = verdicts.join(best, "query_id", "left").withColumn("dense_ok", F.coalesce(F.col("top_sim") >= least_sim, F.lit(False)))
    v = checkpoint(v.withColumn("stage", F.when((F.col("stage") == "hub") & F.col("dense_ok"), "dense").otherwise(F.col("stage"))))
    lexical = ranked(scores, memory.nodes, POOL)
    found = v.filter("stage not in ('hub', 'dense')").select("query_id")
    fused = rrf([lexical, dense.join(found, "query_id", "left_semi")], k)
    alone = dense.join(v.filter("stage = 'dense'").select("query_id"), "query_id", "left_semi").filter(F.col("rank") <= k).select("query_id", "rank", "node_id", F.col("sim").alias("score"))
    last = hubs(memory.nodes, k).select("node_id", F.row_number().over(Window.orderBy(F.desc("degree"), "node_id")).alias("rank"), F.lit(0.0).alias("score"))
    lost = v.filter("stage = 'hub'").select("query_id").join(F.broadcast(last)).select("query_id", "rank", "node_id", "score")  # at most k rows
    hits = fused.unionByName(alone).unionByName(lost)
    hit_sim = hits.filter("rank = 1").join(dense.select("query_id", "node_id", "sim"), ["query_id", "node_id"]).select("query_id", F.col("sim").alias("hit_sim"))
    d = hits.join(v, "query_id").join(hit_sim, "query_id", "left")
    matched = F.col("stage") != "hub"
    guessed = F.lit(fuzzy_requires_dense) & (F.col("stage") == "fuzzy") & (F.coalesce("hit_sim", F.lit(-1.0)) < least_sim)
    top = F.greatest(F.max("score").over(Window.partitionBy("query_id")), F.lit(1e-9))
    return d.select(
        "query_id", "stage", matched.alias("matched"), (~matched | ((F.col("coverage") < 0.5) & ~F.col("dense_ok")) | guessed).alias("handoff"), F.round("coverage", 6).alias("coverage"),
        F.round(confidence(F.col("stage"), F.col("coverage"), F.col("dense_ok"), F.coalesce("top_sim", F.lit(0.0))), 6).alias("confidence"), "rank", F.col("node_id").alias("id"), F.round(F.col("score") / top, 6).alias("score"),
    )


def block_context(hits: DataFrame, blocks: DataFrame, nodes: DataFrame, most: int = 24) -> DataFrame:
    """(query_id, ord, block, members, size): the blocks of a query's hits in hit order, with up to `most` members by level and degree."""
    first = hits.join(blocks.select(F.col("node_id").alias("id"), "block"), "id").groupBy("query_id", "block").agg(F.min("rank").alias("ord"))
    w = Window.partitionBy("block").orderBy("level_rank", F.desc("degree"), "node_id")
    held = blocks.join(nodes.select("node_id", "level_rank", "degree"), "node_id").withColumn("rn", F.row_number().over(w))
    lists = held.groupBy("block").agg(F.count("*").alias("size"), F.sort_array(F.collect_list(F.when(F.col("rn") <= most, F.struct("rn", "node_id")))).alias("m"))
    return first.join(lists.select("block", "size", F.transform("m", lambda x: x["node_id"]).alias("members")), "block")


def corrected_terms(vocab: DataFrame, words: DataFrame, least: float = 0.4) -> DataFrame:
    """(word, term, sim): the most similar vocabulary term, the more used one on ties, where it is another word."""
    near = similar_terms(vocab, words, least, k=None).join(vocab.select("term", "df"), "term")
    w = Window.partitionBy("word").orderBy(F.desc("sim"), F.desc("df"), "term")
    return near.withColumn("rn", F.row_number().over(w)).filter("rn = 1 and term <> word").select("word", "term", "sim")


def hybrid_search(memory: Memory, queries: DataFrame, vectors: DataFrame, asked: DataFrame, k: int = 5, pool: int = POOL) -> DataFrame:
    """(query_id, rank, id, score, lexical, dense_sim): any of a query's terms and their corrections, and nearness, fused by rank.

    vectors (node_id, vec) and asked (query_id, vec); lexical says whether terms found the record, dense_sim its cosine
    where it is among the nearest.
    """
    qt = query_terms(queries).select("query_id", "term").distinct()
    fixed = corrected_terms(vocabulary_of(memory), qt.select(F.col("term").alias("word")))
    terms = qt.unionByName(qt.join(fixed.select(F.col("word"), F.col("term").alias("new")), F.col("term") == F.col("word")).select("query_id", F.col("new").alias("term"))).distinct()
    own = memory.postings.filter(F.col("node_id").startswith("F_"))
    found = bm25(own, memory.lengths.filter(F.col("node_id").startswith("F_")), terms.withColumn("weight", F.lit(1.0)), k=pool).withColumn("score", F.round("score", PLACES))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    lex = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= pool)
    dense = saved(dense_top(vectors, asked, pool), "dense")
    both = lex.select("query_id", "node_id", "rank", F.lit(True).alias("lexical"), F.lit(None).cast("double").alias("sim")).unionByName(dense.select("query_id", "node_id", "rank", F.lit(False).alias("lexical"), "sim"))
    g = both.groupBy("query_id", "node_id").agg(F.round(F.sum(1.0 / (F.col("rank") + RRF)), PLACES).alias("score"), F.max("lexical").alias("lexical"), F.max("sim").alias("dense_sim"))
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("node_id").alias("id"), "score", "lexical", "dense_sim")


def plain_bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, most_terms: int = 300_000) -> DataFrame:
    """(query_id, rank, node_id, score): the baseline over lower-case runs of ASCII letters and digits, no stop words, no stems.

    docs: node_id, text; queries: query_id, q. Every word counts towards its document's length, but only words that are
    asked for (all, where more than most_terms are) leave the scan, counted; so words are not shuffled. Rows of one
    node_id are one document, whose length counts once a row; a null one counts, but is not found.
    """
    from collections import Counter

    import pandas as pd

    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    asked = queries.select("query_id", F.explode(F.array_distinct(words(F.col("q")))).alias("term")).withColumn("weight", F.lit(1.0))
    some = asked.select("term").distinct().limit(most_terms + 1).collect()
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(r.term.encode() for r in some) if len(some) <= most_terms else None)
    kept = bytes(x if 48 <= x < 58 or 97 <= x < 123 else 32 for x in range(256))

    def counted(texts):
        of, lengths, terms, tfs = wanted.value, [], [], []
        for text in texts:
            found = (text or "").lower().encode("utf-8", "surrogatepass").translate(kept).split()
            held = Counter(found if of is None else filter(of.__contains__, found))
            lengths.append(float(len(found)))
            terms.append([t.decode() for t in held])
            tfs.append([float(n) for n in held.values()])
        return pd.DataFrame({"len": lengths, "terms": terms, "tfs": tfs})

    counted.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}  # written out, they would be strings in this module
    count = F.pandas_udf(counted, "len double, terms array<string>, tfs array<double>")
    rows = saved(docs.select("node_id", count("text").alias("c")).select("node_id", "c.*"), "plain")
    by_node = rows.groupBy("node_id").agg(F.sum("len").alias("len"), F.count("*").alias("rows"))
    lengths = saved(by_node.select("node_id", F.when(F.col("node_id").isNull(), F.lit(0.0)).otherwise(F.col("len") * F.col("rows")).alias("len"), "rows"), "lengths")
    postings = rows.select("node_id", "len", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("node_id", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"), "len")
    if not lengths.filter("rows > 1").isEmpty():
        postings = postings.groupBy("node_id", "term").agg(F.sum("tf").alias("tf")).join(lengths.drop("rows"), "node_id", "left")
    s = bm25(postings, lengths, asked, k1, b, k).withColumn("score", F.round("score", PLACES))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "node_id", "score")


def cell_index(vectors: DataFrame, lists: int, sample_rows: int = 20_000, rounds: int = 8, seed: int = 3):
    """(centers, table (node_id, vec, cell)): an inverted file. Centers come from a hashed sample of at most sample_rows
    unit vectors by k-means; every vector is put in the cell of its nearest center."""
    import numpy as np
    import pandas as pd

    v = saved(vectors.select("node_id", unit(F.col("vec")).alias("vec")), "units")
    some = np.array([r.vec for r in v.orderBy(F.xxhash64(F.lit(seed), "node_id"), "node_id").limit(sample_rows).collect()])
    c = some[np.linspace(0, len(some) - 1, min(lists, len(some))).astype(int)] if len(some) else np.zeros((0, 1))
    for _ in range(rounds):
        own = (some @ c.T).argmax(axis=1) if len(c) else np.zeros(0, int)
        c = np.array([some[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12) if len(c) else 1.0

    def place(batches):
        for b in batches:
            m = np.array(b["vec"].tolist()) if len(b) else np.zeros((0, c.shape[1]))
            yield pd.DataFrame({"node_id": b["node_id"], "vec": b["vec"], "cell": (m @ c.T).argmax(axis=1) if len(b) else []})

    return c, saved(v.mapInPandas(place, f"node_id {dict(vectors.dtypes)['node_id']}, vec array<double>, cell long"), "cells")


def cell_search(index, queries: DataFrame, k: int = POOL, probes: int = 10, vector_cells: int = VECTOR_CELLS, query_cells: int = QUERY_CELLS) -> DataFrame:
    """(query_id, rank, node_id, sim): exact search in each query's `probes` nearest cells.

    A cell, and the queries that probe it, are cut into blocks by their numbers, so a task holds no more of a larger table.
    """
    import numpy as np
    import pandas as pd

    centers, table = index
    q = queries.select("query_id", unit(F.col("vec")).alias("vec"))

    def route(batches):
        for b in batches:
            if len(b):
                near = np.argsort(-(np.array(b["vec"].tolist()) @ centers.T), axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"query_id": b["query_id"], "vec": b["vec"], "cells": list(near)})

    kinds = dict(queries.dtypes)["query_id"], dict(table.dtypes)["node_id"]
    asked = saved(q.mapInPandas(route, f"query_id {kinds[0]}, vec array<double>, cells array<long>"), "routed").select("query_id", "vec", F.explode("cells").alias("cell"))
    dim = max(1, centers.shape[1])
    blocks = lambda d, cells, name: d.groupBy("cell").agg(F.ceil(F.count("*") / max(1, cells // dim)).cast("int").alias(name))
    sizes = F.broadcast(saved(blocks(table, vector_cells, "nv").join(blocks(asked.select("cell"), query_cells, "nq"), "cell"), "sizes"))  # a row a cell
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    cut = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    v = table.join(sizes, "cell").select("node_id", "vec", "cell", own("node_id", "nv").alias("vb"), cut("nq").alias("qb"))
    a = asked.join(sizes, "cell").select("query_id", "vec", "cell", own("query_id", "nq").alias("qb"), cut("nv").alias("vb"))
    return _top_of_blocks(v, a, ["cell", "vb", "qb"], k, kinds)


def pages_of(hits: DataFrame, page_of: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, page): the distinct pages of hits in hit order."""
    g = hits.join(page_of, "id").groupBy("query_id", "page").agg(F.min("rank").alias("first"))
    w = Window.partitionBy("query_id").orderBy("first", "page")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "page")
