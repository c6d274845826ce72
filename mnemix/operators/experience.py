"""Experience memory: nearest labelled cases, leave-one-out trust, and the choice of k and temperature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemix.operators.retrieval import dense_top

KS, TEMPERATURES = (1, 2, 4, 8, 16, 32), (0.02, 0.05, 0.1, 0.2, 1.0)
PROBES = 2000


def loo_probes(cases: DataFrame, most: int = PROBES) -> DataFrame:
    """At most `most` cases at even steps of their order (seq from 0): the places i * n / most."""
    n = cases.count()
    if n <= most:
        return cases
    # seq is a place i * n // most exactly where i = ceil(seq * most / n) leads back to it
    i = F.floor((F.col("seq") * most + n - 1) / n)
    return cases.filter((F.floor(i * n / most) == F.col("seq")) & (i < most))


def neighbours(cases: DataFrame, probes: DataFrame, k: int = 32, leave_out: bool = True) -> DataFrame:
    """(probe, truth, rank, seq, label, sim): the k nearest cases of each probe by cosine; ties to the earlier case."""
    found = dense_top(cases.select(F.col("seq").alias("node_id"), "vec"), probes.select(F.col("seq").alias("query_id"), "vec"), k + 1)
    if leave_out:
        found = found.filter("node_id <> query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "node_id")
    found = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    d = found.join(cases.select(F.col("seq").alias("node_id"), "label"), "node_id")
    return d.join(probes.select(F.col("seq").alias("query_id"), F.col("label").alias("truth")), "query_id").select(F.col("query_id").alias("probe"), "truth", "rank", F.col("node_id").alias("seq"), "label", "sim")


def distribution(near: DataFrame, k: int, temperature: float) -> DataFrame:
    """(probe, label, p): weights exp((sim - largest) / temperature) of the first k, normalised."""
    d = near.filter(F.col("rank") <= k)
    top = F.max("sim").over(Window.partitionBy("probe"))
    w = d.withColumn("w", F.exp((F.col("sim") - top) / temperature))
    g = w.groupBy("probe", "label").agg(F.sum("w").alias("w"))
    return g.select("probe", "label", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("probe")), 6).alias("p"))


def votes(near: DataFrame, k: int) -> DataFrame:
    return near.filter(F.col("rank") <= k).groupBy("probe", "label").agg(F.count("*").alias("votes"))


def loo_vote_accuracy(near: DataFrame, k: int) -> DataFrame:
    """Share of probes whose commonest neighbour label, lowest on ties, is their own."""
    best = votes(near, k).groupBy("probe").agg(F.max(F.struct("votes", (-F.col("label")).alias("l"))).alias("b"))
    truth = near.select("probe", "truth").distinct()
    return best.join(truth, "probe").agg(F.round(F.avg((-F.col("b.l") == F.col("truth")).cast("double")), 6).alias("accuracy"))


def grid_accuracy(near: DataFrame, ks: tuple = KS, temperatures: tuple = TEMPERATURES) -> DataFrame:
    """(k, temperature, accuracy) of every cell: neighbours are ranked once, each cell is an aggregate over them."""
    cells = [F.struct(F.lit(k).alias("k"), F.lit(t).alias("t"), F.lit(i).alias("i")) for i, (k, t) in enumerate((k, t) for k in ks for t in temperatures)]
    top = F.max("sim").over(Window.partitionBy("probe"))
    d = near.withColumn("gap", F.col("sim") - top).withColumn("cell", F.explode(F.array(*cells))).filter(F.col("rank") <= F.col("cell.k"))
    g = d.groupBy("probe", "truth", "cell", "label").agg(F.round(F.sum(F.exp(F.col("gap") / F.col("cell.t"))), 9).alias("w"))
    best = g.groupBy("probe", "truth", "cell").agg(F.max(F.struct("w", (-F.col("label")).alias("l"))).alias("b"))
    return best.groupBy("cell").agg(F.round(F.avg((-F.col("b.l") == F.col("truth")).cast("double")), 6).alias("accuracy")).select("cell.k", F.col("cell.t").alias("temperature"), "accuracy", F.col("cell.i").alias("cell"))


def best_cell(grid: DataFrame) -> DataFrame:
    return grid.orderBy(F.desc("accuracy"), "cell").limit(1).select("k", "temperature", "accuracy")


def trust(cases: DataFrame, near: DataFrame) -> DataFrame:
    """How far leave-one-out accuracy (k 8, temperature 0.2, highest label on ties) exceeds the commonest label's share, within 0 and 1."""
    top = F.max("sim").over(Window.partitionBy("probe"))
    d = near.filter("rank <= 8").withColumn("w", F.exp((F.col("sim") - top) / 0.2)).groupBy("probe", "truth", "label").agg(F.round(F.sum("w"), 9).alias("w"))
    best = d.groupBy("probe", "truth").agg(F.max(F.struct("w", "label")).alias("b"))
    loo = best.agg(F.avg((F.col("b.label") == F.col("truth")).cast("double")).alias("loo"))
    maj = cases.groupBy("label").agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("maj"), F.sum("n").alias("n"))
    value = F.when((F.col("n") < 4) | (F.col("maj") >= 1), F.lit(0.0)).otherwise(F.least(F.greatest((F.col("loo") - F.col("maj")) / (1 - F.col("maj")), F.lit(0.0)), F.lit(1.0)))
    return loo.join(maj).select(F.round(value, 6).alias("trust"))  # one row by one row
