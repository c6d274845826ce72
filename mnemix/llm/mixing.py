"""Mixing sources to target weights: cube-method balanced sampling.

A source's target over its size is the rate at which each of its documents is to be taken. The whole part of the rate
is taken from every document; the fraction is an inclusion probability. The cube method moves the probabilities of a
block of documents through the null space of two constraints, expected words and expected documents, until each is 0
or 1 but for two and a small reserve of all sizes; what is left of a source's blocks is gathered and moved again,
until a landing problem of at most sixteen documents a source is decided by trying all its subsets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemix.llm.common import looked_up, saved

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3.0
EPS = 1e-9
RESERVE, LARGEST = 14, 6
LEFT = RESERVE + 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank, from 0, by code point, null last: ranges of sources are ranked apart, then moved by the rows of the ranges before."""
    last = F.col("source").asc_nulls_last()
    ranged = sources.repartitionByRange(last).withColumn("part", F.spark_partition_id())
    ranged = saved(ranged.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(last)) - 1), "sources")
    moved, at = [], 0
    for r in ranged.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # one row a partition
        moved.append((r.part, at))
        at += r.n
    before = F.broadcast(sources.sparkSession.createDataFrame(moved, "part int, before long"))
    return ranged.join(before, "part").withColumn("rank", F.col("place") + F.col("before")).drop("part", "place", "before")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size).

    Sources by code point, null last, weigh weights in turn. Each target is weight times one common level, but at most
    `most` times the source's size; the level is where the targets add up to all sizes. The level rises from one where
    none is held back: sources above their cap leave their excess to the others, until no further one is above.
    """
    turn = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    d = saved(ranked(sizes.select("source", "source_size")).select("source", "source_size", turn.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")), "weights")
    total = float(d.agg(F.sum("source_size")).first()[0] or 0)
    level, held = 0.0, -1
    while True:
        over = F.col("cap") <= F.col("weight") * F.lit(level)
        r = d.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("cap"), F.sum(F.when(~over, F.col("weight"))).alias("free")).first()
        if r.n == held or not r.free:
            break
        held, level = r.n, (total - (r.cap or 0.0)) / r.free
    return d.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def flight(pi: np.ndarray, balance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Cube flight: probabilities after moving through the null space of the columns of balance.

    Three undecided units always have a direction that keeps two sums; each step goes along it to a face of the cube,
    to either side with the probability that keeps the expectation, and decides at least one unit.
    """
    p = pi.astype(float).copy()
    live = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    p[p <= EPS], p[p >= 1 - EPS] = 0.0, 1.0
    draw = rng.random(len(live) + 8)
    pick, held, k = iter(live), [], 0
    x0, x1 = balance[:, 0], balance[:, 1]
    while True:
        while len(held) < 3 and (i := next(pick, None)) is not None:
            held.append(i)
        if len(held) < 3:
            return p
        a, b, c = held
        u = (x0[b] * x1[c] - x0[c] * x1[b], x0[c] * x1[a] - x0[a] * x1[c], x0[a] * x1[b] - x0[b] * x1[a])
        if max(map(abs, u)) < 1e-12:  # the three are proportional: any direction that keeps the first sum
            u = (x0[b], -x0[a], 0.0) if x0[a] or x0[b] else (1.0, 0.0, 0.0)
        up = min((1 - p[i]) / v if v > 0 else -p[i] / v for i, v in zip(held, u) if v)
        down = min(p[i] / v if v > 0 else (p[i] - 1) / v for i, v in zip(held, u) if v)
        step = up if draw[k % len(draw)] * (up + down) < down else -down
        k += 1
        for i, v in zip(held, u):
            p[i] += step * v
        for i in held:
            if p[i] <= EPS:
                p[i] = 0.0
            elif p[i] >= 1 - EPS:
                p[i] = 1.0
        held = [i for i in held if 0 < p[i] < 1]


def land(pi: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Decides the last few units: of all their subsets, the one whose words come nearest to the expected ones; within half
    a word of it, the one whose number of documents does."""
    live = [i for i in range(len(pi)) if EPS < pi[i] < 1 - EPS]
    sums, units = np.zeros(1), np.zeros(1)
    for i in live:
        sums, units = np.concatenate([sums, sums + words[i]]), np.concatenate([units, units + 1])
    off = np.abs(sums - sum(pi[i] * words[i] for i in live))
    near = np.flatnonzero(off <= off.min() + 0.5)
    best = int(near[np.abs(units[near] - sum(pi[i] for i in live)).argmin()])
    out = np.where(pi >= 0.5, 1.0, 0.0)
    for j, i in enumerate(live):
        out[i] = best >> j & 1
    return out


def _fly(block: pd.DataFrame, last: bool, seed: int) -> pd.DataFrame:
    b = block.sort_values(["size", "doc_id"], ascending=[False, True], na_position="last", kind="stable").reset_index(drop=True)
    size, pi = b["size"].to_numpy(float), b["pi"].to_numpy()
    rng = np.random.default_rng([seed, len(b), int(size.sum()) & 0x7FFFFFFF])
    # sum over taken of size, and their number, must keep their expectation: those are the two balancing columns
    p, open_ = pi.copy(), np.flatnonzero((pi > EPS) & (pi < 1 - EPS))
    spread = np.linspace(0, len(open_) - 1, min(RESERVE - LARGEST, len(open_))).astype(int)
    kept = open_[np.unique(np.concatenate([np.arange(min(LARGEST, len(open_))), spread]))]  # the largest and some of all sizes, for landing
    fly = rng.permutation(np.setdiff1d(open_, kept))
    p[fly] = flight(pi[fly], np.column_stack([size[fly] / max(size.max(), 1.0), np.ones(len(fly))]), rng)
    if last:
        p = land(p, size)
    p[p <= EPS], p[p >= 1 - EPS] = 0.0, 1.0
    b["pi"] = p
    return b


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST, block_rows: int = 2000, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of docs.

    taken is a multiple of size, at most ceil(most) times it. Rows of one id, source and size (repeated rows, or several
    without an id) cannot be told apart: of their common expectation the whole part is so many of them, and only the
    rest is drawn. Blocks are cut by a hash of the id, so a source with a third of all rows becomes as many more blocks.
    A null text has size 0; a row of size 0 takes 0, a source of size 0 has target 0; a null source is a source of its
    own, ranked last. An empty table gives an empty result. Other columns of docs are ignored. Reruns agree.
    """
    units = docs.select("doc_id", "source", n_words(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("times"))
    named = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))  # a null source has a key, too
    units = saved(units.withColumn("key", named), "units")
    totals = saved(units.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.count("*").alias("n_rows")), "totals")
    goal = targets(totals.select("source", "source_size"), weights, most).select(named.alias("key"), "target")
    d = looked_up(units, totals.drop("source").join(goal, "key"), ["key"], "inner").drop("key")
    rate = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    d = d.withColumn("rate", rate).withColumn("base", F.floor(F.col("rate") + F.lit(EPS)))
    expected = F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)) * F.col("times")
    d = d.withColumn("more", F.floor(expected + F.lit(EPS))).withColumn("pi", F.greatest(expected - F.col("more"), F.lit(0.0))).drop("rate")
    d = d.withColumn("blocks", F.ceil(F.col("n_rows") / block_rows)).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("blocks")))
    schema = d.schema

    def stage(last: bool):
        def fly(block: pd.DataFrame) -> pd.DataFrame:
            return _fly(block, last, seed)

        return fly

    flown = saved(d.groupBy("source", "block").applyInPandas(stage(False), schema), "flown")
    open_ = (F.col("pi") > 0) & (F.col("pi") < 1)
    done, rest = [flown.filter(~open_)], flown.filter(open_)
    most_blocks = totals.agg(F.max("n_rows")).first()[0] or 0
    left = -(-most_blocks // block_rows) * LEFT
    while left > block_rows:  # LEFT undecided documents a block at most, gathered into blocks of their own
        cut = rest.withColumn("blocks", F.ceil(F.col("blocks") * LEFT / block_rows)).withColumn("block", F.pmod(F.col("block"), F.col("blocks")))
        flown = saved(cut.groupBy("source", "block").applyInPandas(stage(False), schema), "flown")
        done.append(flown.filter(~open_))
        rest = flown.filter(open_)
        left = -(-left // block_rows) * LEFT
    done.append(rest.groupBy("source").applyInPandas(stage(True), schema))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return _as_rows(out.withColumn("more", F.col("more") + F.col("pi").cast("long")))


def _as_rows(units: DataFrame, piece: int = 1000) -> DataFrame:
    """Each unit as the rows it stands for, `more` of them with one more copy; units of many rows are cut and dealt out first."""
    cols = ["doc_id", "source", "size", "source_size", "target"]
    one = units.filter("times = 1").select(*cols, ((F.col("base") + F.col("more")) * F.col("size")).cast("long").alias("taken"))
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / piece)))
    many = units.filter("times > 1").withColumn("at", cut).withColumn("at", F.col("at") * piece).repartition("doc_id", "source", "size", "at")
    each = F.explode(F.sequence(F.col("at"), F.least(F.col("at") + piece, F.col("times")) - 1))
    many = many.withColumn("i", each).select(*cols, ((F.col("base") + (F.col("i") < F.col("more")).cast("long")) * F.col("size")).cast("long").alias("taken"))
    return one.unionByName(many)
