"""Decisions after scoring: temperatures, confidence, decoding, gates, pooling, shortlists, grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def temperature_bucket(kind: Column, n: Column) -> Column:
    size = F.when(n <= 2, "2").when(n <= 5, "3-5").when(n <= 10, "6-10").otherwise("11+")
    return F.concat_ws(":", kind, size)


def softmax(logits: DataFrame, temperature: Column | float = 1.0) -> DataFrame:
    """(query_id, option, p) of (query_id, option, logit); temperatures are kept within 0.5 and 5."""
    t = F.least(F.greatest(F.lit(temperature) if not isinstance(temperature, Column) else temperature, F.lit(0.5)), F.lit(5.0))
    w = Window.partitionBy("query_id")
    d = logits.withColumn("e", F.exp((F.col("logit") - F.max("logit").over(w)) / t))
    return d.select("query_id", "option", (F.col("e") / F.sum("e").over(w)).alias("p"))


def entropy_confidence(probs: DataFrame) -> DataFrame:
    """(query_id, confidence): one less the entropy over that of equal options; 1 for a single option."""
    h = F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log("p")).otherwise(F.lit(0.0)))
    n = F.count("*")
    return probs.groupBy("query_id").agg(F.when(n < 2, F.lit(1.0)).otherwise(F.least(F.greatest(1 - h / F.log(n.cast("double")), F.lit(0.0)), F.lit(1.0))).alias("confidence"))


def decode_choice(probs: DataFrame) -> DataFrame:
    """(query_id, answer, p): the likeliest option, the last one on ties."""
    g = probs.groupBy("query_id").agg(F.max(F.struct("p", "option")).alias("b"))
    return g.select("query_id", F.col("b.option").alias("answer"), F.col("b.p").alias("p"))


def decode_score(probs: DataFrame) -> DataFrame:
    """(query_id, score): the expected level."""
    return probs.groupBy("query_id").agg(F.sum(F.col("option") * F.col("p")).alias("score"))


def decode_noul(probs: DataFrame) -> DataFrame:
    """(query_id, p_yes, confidence) of two-option questions."""
    g = probs.groupBy("query_id").agg(F.sum(F.when(F.col("option") == 1, F.col("p")).otherwise(0.0)).alias("p_yes"))
    return g.withColumn("confidence", F.greatest("p_yes", 1 - F.col("p_yes")))


def pooled(probs: DataFrame, memory: DataFrame, margin: float = 0.5, weight: float = 2.0) -> DataFrame:
    """(query_id, option, p): where the first two options are closer than margin, the log-linear pool with the memory's."""
    w = Window.partitionBy("query_id")
    order = w.orderBy(F.desc("p"), "option")
    d = probs.join(memory.select("query_id", "option", F.col("p").alias("pm")), ["query_id", "option"], "left").fillna(0.0, ["pm"])
    d = d.withColumn("rn", F.row_number().over(order))
    gap = F.max(F.when(F.col("rn") == 1, F.col("p"))).over(w) - F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("p"))).over(w), F.lit(0.0))
    raw = F.exp(F.log(F.greatest("p", F.lit(1e-12))) + weight * F.log(F.col("pm") + 1e-3))
    d = d.withColumn("gap", gap).withColumn("raw", raw)
    return d.select("query_id", "option", F.when(F.col("gap") < margin, F.col("raw") / F.sum("raw").over(w)).otherwise(F.col("p")).alias("p"))


def agreement_override(probs: DataFrame, votes: DataFrame, loo: float, least: int = 6, loo_least: float = 0.6) -> DataFrame:
    """Where enough of the nearest cases agree and the memory is good at it, vote shares answer."""
    w = Window.partitionBy("query_id")
    d = probs.join(votes.select("query_id", "option", "votes"), ["query_id", "option"], "left").fillna(0, ["votes"])
    use = (F.max("votes").over(w) >= least) & F.lit(loo >= loo_least)
    return d.select("query_id", "option", F.when(use, F.col("votes") / F.sum("votes").over(w)).otherwise(F.col("p")).alias("p"))


def out_of_scope(answers: DataFrame, sims: DataFrame, least_sim: float, least_p: float) -> DataFrame:
    """answers with out_of_scope: no label is near enough, or the top probability is too small."""
    top = sims.groupBy("query_id").agg(F.max("sim").alias("top_sim"))
    return answers.join(top, "query_id", "left").withColumn("out_of_scope", (F.coalesce("top_sim", F.lit(-1.0)) < least_sim) | (F.col("p") < least_p))


def tournament_groups(options: DataFrame, size: int = 16) -> DataFrame:
    """options (query_id, option from 0) with the group each meets in: ceil(n / size) groups of equal width."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    rounds = F.ceil(n / size)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("option")) - 1
    return options.withColumn("group", F.floor(place / F.ceil(n / rounds)).cast("int"))


def finalists(scored: DataFrame, keep: int = 3) -> DataFrame:
    w = Window.partitionBy("query_id", "group").orderBy(F.desc("p"), "option")
    return scored.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep).select("query_id", "option")


def plain_state(turns: DataFrame) -> DataFrame:
    """(conv_id, state): the texts of a conversation's turns in order, one a line."""
    g = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    return g.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("state"))


def grounded(state: Column, context: Column) -> Column:
    """A JSON state with its context first; untouched without context."""
    return F.when(F.coalesce(context, F.lit("")) == "", state).otherwise(F.to_json(F.struct(context.alias("context"), state.alias("input"))))
