"""Batched decisions: every (state, question) is a row, every round of scoring one pass over all rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemix.functions import text as T
from mnemix.operators import scoring
from mnemix.operators.decision import temperature_bucket
from mnemix.operators.questions import Question, answered_index, grounded
from mnemix.sources.tables import saved


@dataclass
class Options:
    """What decide() may be told; the defaults answer by the model alone."""

    most_options: int = 16
    finalists: int = 3
    permute: bool = False
    permute_below: float = 0.0
    min_confidence: float = 0.0
    margin: float = 0.5
    agree_votes: int = 6
    agree_loo: float = 0.6
    candidates: int = 3
    shortlist: int = 0
    shortlist_union: bool = True
    oos_similarity: float | None = None
    oos_probability: float | None = None
    script_gate: bool = True
    temperatures: dict[str, float] = field(default_factory=dict)
    most_rounds: int = 8


@dataclass
class Experience:
    """cases' answers for the states at hand: table (state_id, qid, pm, votes, first) of arrays over options, and each
    question's weight in the pool and leave-one-out accuracy. first, where not null, answers before the model."""

    table: DataFrame
    weight: dict[str, float] = field(default_factory=dict)
    loo: dict[str, float] = field(default_factory=dict)


def _by_question(values: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for qid, v in values.items():
        out = F.when(F.col("qid") == qid, F.lit(float(v))).otherwise(out)
    return out


def _softmax(x: Column, t: Column) -> Column:
    """exp((x - max) / t), normalised; max and sum are bound by outer lambdas."""
    parts = F.get(F.transform(F.array(F.array_max(x)), lambda m: F.transform(x, lambda v: F.exp((v - m) / t))), F.lit(0))
    return F.get(F.transform(F.array(parts), lambda e: F.get(F.transform(F.array(_sum(e)), lambda s: F.transform(e, lambda v: v / s)), F.lit(0))), F.lit(0))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def entropy_confidence(p: Column) -> Column:
    """One less the entropy over that of equal options, within 0 and 1; 1 for a single one."""
    h = F.aggregate(p, F.lit(0.0), lambda acc, v: acc + F.when(v > 0, -v * F.log(v)).otherwise(F.lit(0.0)))
    n = F.size(p)
    return F.when(n < 2, F.lit(1.0)).otherwise(F.least(F.greatest(1 - h / F.log(n.cast("double")), F.lit(0.0)), F.lit(1.0)))


def _job_table(states: DataFrame, questions: list[Question]) -> DataFrame:
    """A row for each (state, question); questions are a fixed short list, written into the plan."""
    each = [
        F.struct(F.lit(q.id).alias("qid"), F.lit(i).alias("qpos"), F.lit(q.kind).alias("kind"), F.lit(q.instructions).alias("instructions"), F.array(*map(F.lit, q.labels)).alias("labels"), F.array(*map(F.lit, q.options)).alias("options"))
        for i, q in enumerate(questions)
    ]
    return states.select("state_id", "state", F.explode(F.array(*each)).alias("q")).select("state_id", "state", "q.*")


def _groups(alive: Column, most: int, cut: Column) -> Column:
    """Equal slices of at most `most` options, in order; one where they need not be cut."""
    n = F.size(alive)
    width = F.ceil(n / F.ceil(n / most)).cast("int")
    slices = F.transform(F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), lambda i: F.slice(alive, i * width + 1, width))
    return F.when(cut & (n > most), slices).otherwise(F.array(alive))


def decide(states: DataFrame, questions: list[Question], scorer, options: Options | None = None, experience: Experience | None = None, embedder=None) -> DataFrame:
    """state_id, qid, kind, answer, value, confidence, probabilities, alive, rounds, strategy, handoff, out_of_scope, cached of each state and question.

    states: state_id, state. Equal states, of equal experience where it is given, are scored once; the others are marked cached. More options
    than most_options meet in groups whose finalists, with the memory's and the embedder's candidates, meet again until
    one group is left. States in another script than the model reads get no answer and are handed off.
    """
    o = options or Options()
    if o.oos_similarity is not None and embedder is None:
        raise ValueError("a least similarity needs an embedder")
    alike = ["state"]
    if experience is not None:
        known = experience.table.groupBy("state_id").agg(F.array_sort(F.collect_list(F.struct("qid", "pm", "votes", "first"))).alias("known"))  # one a question
        states = states.select("state_id", "state").join(known, "state_id", "left").withColumn("known", F.coalesce("known", F.array()))
        alike = ["state", "known"]
    same = states.groupBy(*alike).agg(F.min("state_id").alias("first_id"))
    unique = saved(same.select(F.col("first_id").alias("state_id"), "state"), "states")
    jobs = _job_table(unique, questions)
    asked = " ".join(q.instructions for q in questions)
    gate = F.lit(o.script_gate) & T.unreadable_for_english(F.concat_ws(" ", "state", F.lit(asked)))
    jobs = jobs.withColumn("gated", gate).withColumn("many", (F.col("kind") == "choice") & (F.size("options") > o.most_options))
    none = F.lit(None).cast("array<double>")
    if experience is not None:
        jobs = jobs.join(experience.table.select("state_id", "qid", "pm", "votes", "first"), ["state_id", "qid"], "left")
    else:
        jobs = jobs.withColumns({"pm": none, "votes": F.lit(None).cast("array<int>"), "first": none})
    weight = _by_question(experience.weight if experience else {}, 1.0)
    loo = _by_question(experience.loo if experience else {}, 0.0)
    sims = none
    for q in questions:
        if embedder is not None and q.kind == "choice" and (o.shortlist or o.oos_similarity is not None):
            sims = F.when(F.col("qid") == q.id, F.struct(scoring.similarities(F.col("state"), list(q.options), embedder).alias("s"), scoring.similarities(F.col("state"), list(q.labels), embedder).alias("l"))).otherwise(sims if sims is not none else F.lit(None))
    if sims is none:
        jobs = jobs.withColumns({"near": F.array().cast("array<int>"), "max_similarity": F.lit(None).cast("double")})
    else:
        jobs = saved(jobs.withColumn("sims", sims), "similar")
        order = F.array_sort(F.transform(F.col("sims.s"), lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
        near = F.array_sort(F.transform(F.slice(order, 1, max(1, o.shortlist)), lambda x: x["i"]))
        jobs = jobs.withColumn("near", F.when(F.lit(o.shortlist > 0) & F.col("many"), near).otherwise(F.array().cast("array<int>"))).withColumn("max_similarity", F.array_max("sims.l")).drop("sims")
    every = F.sequence(F.lit(0), F.size("options") - 1)
    alive = every if o.shortlist_union else F.when(F.size("near") > 0, F.col("near")).otherwise(every)
    jobs = saved(jobs.withColumn("alive", alive), "jobs")
    gated, left, done = jobs.filter("gated"), jobs.filter("not gated"), []
    for number in range(1, o.most_rounds + 1):
        last = number == o.most_rounds  # options that candidates keep bringing back meet in one last group
        rows = left.withColumn("groups", F.array("alive") if last else _groups(F.col("alive"), o.most_options, F.col("many")))
        rows = rows.withColumn("final", F.size("groups") == 1)
        rows = saved(_scored(rows.select("*", F.posexplode("groups").alias("g", "group")).drop("groups"), scorer, o), "round")
        done.append(rows.filter("final").withColumn("rounds", F.lit(number)))
        open_ = rows.filter("not final")
        if last or open_.isEmpty():
            break
        kept = F.transform(F.slice(F.array_sort(F.transform(F.arrays_zip("p", "group"), lambda x: F.struct((-x["p"]).alias("p"), x["group"].alias("o")))), 1, o.finalists), lambda x: x["o"])
        met = open_.groupBy("state_id", "qid").agg(F.flatten(F.collect_list(kept)).alias("kept"))  # a few options a group
        proposed = F.transform(F.slice(F.array_sort(F.transform("pm", lambda v, i: F.struct((-v).alias("v"), i.alias("i")))), 1, o.candidates), lambda x: F.when(x["v"] < 0, x["i"]))
        extra = F.when(F.col("pm").isNotNull() & (weight > 0), F.filter(proposed, lambda x: x.isNotNull())).otherwise(F.array().cast("array<int>"))
        left = left.join(met, ["state_id", "qid"]).withColumn("alive", F.array_sort(F.array_distinct(F.concat("kept", "near", extra)))).drop("kept")
    scored = done[0]
    for d in done[1:]:
        scored = scored.unionByName(d)
    answers = _answers(scored, o, weight, loo).unionByName(_unread(gated))
    pairs = states.join(same, alike).select(F.col("state_id").alias("of"), F.col("first_id").alias("state_id"))
    out = pairs.join(answers, "state_id").withColumn("cached", F.col("of") != F.col("state_id"))
    return out.drop("state_id").withColumnRenamed("of", "state_id")


def _scored(rows: DataFrame, scorer, o: Options) -> DataFrame:
    """rows with p, the probabilities of each row's group; with the reversed order averaged in where the options ask for it."""
    given = F.transform("group", lambda i: F.get(F.col("options"), i))
    bucket, t = temperature_bucket(F.col("kind"), F.size("group")), F.lit(1.0)
    for name, v in o.temperatures.items():
        t = F.when(bucket == name, F.lit(min(max(v, 0.5), 5.0))).otherwise(t)
    ask = lambda opts: scoring.logits(F.col("kind"), F.col("instructions"), opts, F.col("state"), scorer)
    rows = rows.withColumn("t", t).withColumn("logits", ask(given)).withColumn("p", _softmax(F.col("logits"), F.col("t"))).withColumn("permuted", F.lit(False)).drop("logits")
    if not o.permute:
        return rows.drop("t")
    rows = saved(rows, "ordered")
    sure = F.when(F.col("kind") == "noul", F.array_max("p")).otherwise(entropy_confidence(F.col("p")))
    again = F.col("final") & (F.size("group") > 1) & (F.lit(o.permute_below <= 0) | (sure < o.permute_below))
    twin = rows.filter(again).withColumn("logits", ask(F.reverse(given))).withColumn("back", F.reverse(_softmax(F.col("logits"), F.col("t")))).drop("logits")
    twin = twin.withColumn("p", F.zip_with("p", "back", lambda a, b: (a + b) / 2)).withColumn("permuted", F.lit(True)).drop("back")
    return rows.filter(~again).unionByName(twin).drop("t")


def _answers(d: DataFrame, o: Options, weight: Column, loo: Column) -> DataFrame:
    full = F.transform(F.sequence(F.lit(0), F.size("options") - 1), lambda i: F.coalesce(F.get(F.col("p"), (F.array_position("group", i) - 1).cast("int")), F.lit(0.0)))
    d = d.withColumn("full", full).withColumn("order", F.reverse(F.array_sort("p"))).withColumn("weight", weight).withColumn("loo", loo)
    gap = F.get("order", F.lit(0)) - F.coalesce(F.get("order", F.lit(1)), F.lit(0.0))
    mixed = F.transform("full", lambda v, i: F.when(F.array_contains("group", i), F.exp(F.log(F.greatest(v, F.lit(1e-12))) + F.col("weight") * F.log(F.get(F.col("pm"), i) + 1e-3))).otherwise(F.lit(0.0)))
    d = d.withColumn("mixed", mixed)
    total = F.greatest(_sum(F.col("mixed")), F.lit(1e-300))
    d = d.withColumn("total", total).withColumn("full", F.when(F.col("pm").isNotNull() & (gap < o.margin), F.transform("mixed", lambda v: v / F.col("total"))).otherwise(F.col("full")))
    agree = F.lit(o.agree_votes > 0) & (F.col("loo") >= o.agree_loo) & (F.coalesce(F.array_max("votes"), F.lit(0)) >= o.agree_votes)
    cast = F.greatest(F.aggregate("votes", F.lit(0), lambda a, v: a + v), F.lit(1))
    source = F.when(F.col("first").isNotNull(), F.lit("memory_first")).when(agree, F.lit("votes")).otherwise(F.lit("model"))
    d = d.withColumn("cast", cast).withColumn("by", source)
    p = F.when(F.col("by") == "memory_first", F.col("first")).when(F.col("by") == "votes", F.transform("votes", lambda v: v / F.col("cast"))).otherwise(F.col("full"))
    d = d.withColumn("probabilities", p)
    joined = F.array_sort(F.array_distinct(F.concat("group", F.filter(F.sequence(F.lit(0), F.size("options") - 1), lambda i: F.get(F.col("probabilities"), i) > 0))))
    d = d.withColumn("alive", F.when(F.col("by") == "model", F.col("group")).otherwise(joined))
    inside = F.when(F.col("many"), F.transform("alive", lambda i: F.get(F.col("probabilities"), i))).otherwise(F.col("probabilities"))
    confidence = F.when(F.col("kind") == "noul", F.array_max("probabilities")).otherwise(entropy_confidence(inside))
    d = d.withColumn("confidence", confidence).withColumn("at", answered_index(F.col("kind"), F.col("probabilities")))
    expected = F.aggregate(F.transform("probabilities", lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)
    value = F.when(F.col("kind") == "score", expected).when(F.col("kind") == "noul", F.get("probabilities", F.lit(1))).otherwise(F.array_max("probabilities"))
    scope = F.lit(False)
    if o.oos_similarity is not None:
        scope = scope | F.coalesce(F.col("max_similarity") < o.oos_similarity, F.lit(False))
    if o.oos_probability is not None:
        scope = scope | (F.array_max("probabilities") < o.oos_probability)
    d = d.withColumn("out_of_scope", scope & (F.col("kind") == "choice"))
    hand = (F.lit(o.min_confidence > 0) & (F.col("confidence") < o.min_confidence)) | F.col("out_of_scope")
    strategy = F.when(F.col("by") != "model", F.col("by")).when(F.col("many"), F.lit("tournament")).otherwise(F.lit("direct"))
    return d.select("state_id", "qid", "kind", F.get(F.col("labels"), F.col("at")).alias("answer"), value.alias("value"), "confidence", "probabilities", "alive", "rounds", strategy.alias("strategy"), "permuted", hand.alias("handoff"), "out_of_scope")


def _unread(d: DataFrame) -> DataFrame:
    """Answers of states that the model cannot read: none, handed off, all options alike."""
    n = F.size("options")
    alike = F.transform("options", lambda _: F.lit(1.0) / n)
    return d.select("state_id", "qid", "kind", F.lit(None).cast("string").alias("answer"), F.lit(None).cast("double").alias("value"), F.lit(0.0).alias("confidence"), alike.alias("probabilities"), "alive", F.lit(0).alias("rounds"), F.lit("script_gate").alias("strategy"), F.lit(False).alias("permuted"), F.lit(True).alias("handoff"), F.lit(False).alias("out_of_scope"))


def predict(states: DataFrame, questions: list[Question], scorer) -> DataFrame:
    """The model's plain answers: one pass, all options, no gates."""
    return decide(states, questions, scorer, Options(most_options=1 << 20, script_gate=False))


def context_vectors(states: DataFrame, questions: list[Question], scorer) -> DataFrame:
    """(state_id, qid, vec): the model's pooled vector of each state and question."""
    jobs = _job_table(states, questions)
    return jobs.select("state_id", "qid", scoring.pooled_vectors(F.col("kind"), F.col("instructions"), F.col("options"), F.col("state"), scorer).alias("vec"))


def recalled(near: DataFrame, qid: str, n_options: int, k: int = 8, temperature: float = 0.2, first: tuple[int, float] | None = None) -> DataFrame:
    """The table of Experience for one question from its nearest cases (state_id, rank, label, sim).

    pm weighs the first k by exp((sim - largest) / temperature), votes counts them; first is the same under the k and
    temperature that calibration chose, or null.
    """

    def weighed(k_: int, t: float) -> Column:
        top = F.max("sim")
        held = F.collect_list(F.when(F.col("rank") <= k_, F.struct("label", "sim")))  # k at the most
        share = F.get(F.transform(F.array(F.struct(held.alias("h"), top.alias("m"))), lambda x: F.transform(F.sequence(F.lit(0), F.lit(n_options - 1)), lambda o: F.aggregate(x["h"], F.lit(0.0), lambda a, c: a + F.when(c["label"] == o, F.exp((c["sim"] - x["m"]) / t)).otherwise(F.lit(0.0))))), F.lit(0))
        return F.get(F.transform(F.array(share), lambda e: F.transform(e, lambda v: v / _sum(e))), F.lit(0))

    votes = F.array(*[F.count_if((F.col("rank") <= k) & (F.col("label") == i)).cast("int") for i in range(n_options)])
    chosen = weighed(*first) if first else F.lit(None).cast("array<double>")
    most = max(k, first[0] if first else 0)
    return near.filter(F.col("rank") <= most).groupBy("state_id").agg(weighed(k, temperature).alias("pm"), votes.alias("votes"), chosen.alias("first")).withColumn("qid", F.lit(qid))


def calibrated(answers: DataFrame, gold: DataFrame, memory_accuracy: float, memory_k: int, memory_temperature: float, margin: float = 0.2) -> DataFrame:
    """One row: the model's accuracy on labelled cases beside the memory's, and whether the memory answers first.

    answers (state_id, kind, probabilities) of decisions without memory; gold (state_id, label) as option indices.
    """
    hit = (answered_index(F.col("kind"), F.col("probabilities")) == F.col("label")).cast("double")
    d = answers.join(gold.select("state_id", "label"), "state_id").agg(F.count("*").alias("cases"), F.avg(hit).alias("model_accuracy"))
    return d.select("cases", "model_accuracy", F.lit(float(memory_accuracy)).alias("memory_accuracy"), F.lit(memory_k).alias("k"), F.lit(float(memory_temperature)).alias("temperature"), (F.lit(float(memory_accuracy)) - F.col("model_accuracy") >= margin).alias("memory_first"))


def strided(cases: DataFrame, most: int) -> DataFrame:
    """At most `most` cases at even steps of their order (seq from 0)."""
    from mnemix.operators.experience import loo_probes

    return loo_probes(cases, most)


def decide_with_memory(states: DataFrame, hits: DataFrame, questions: list[Question], scorer, options: Options | None = None, top: int = 1, most_bytes: int = 2000, key: str = "memory", first: bool = False, **more) -> DataFrame:
    """decide() over states that carry what the memory found for them.

    hits: query_id (the state's), rank, id, text, stage, matched, handoff, confidence, as the cascade gives them. The
    texts of the first `top` hits, up to most_bytes, become the context; where retrieval hands off there is none.
    Answers carry used, memory_stage, memory_handoff and hit_ids.
    """
    g = hits.groupBy("query_id").agg(F.first("stage").alias("memory_stage"), F.first("handoff").alias("memory_handoff"), F.array_sort(F.collect_list(F.struct("rank", "id", "text"))).alias("h"))  # k hits at the most

    def add(a: Column, x: Column) -> Column:
        fits = a["open"] & ((a["c"] == "") | (F.octet_length(a["c"]) + F.octet_length(x) + 2 <= most_bytes))
        new = F.when(a["c"] == "", x).otherwise(F.concat(a["c"], F.lit("\n\n"), x))
        return F.struct(F.when(fits, new).otherwise(a["c"]).alias("c"), fits.alias("open"))

    texts = F.slice(F.filter(F.transform("h", lambda x: x["text"]), lambda t: F.coalesce(t, F.lit("")) != ""), 1, top)
    context = F.aggregate(texts, F.struct(F.lit("").alias("c"), F.lit(True).alias("open")), add)["c"]
    g = g.select(F.col("query_id").alias("state_id"), "memory_stage", "memory_handoff", F.transform("h", lambda x: x["id"]).alias("hit_ids"), F.when(F.col("memory_handoff"), F.lit("")).otherwise(context).alias("context"))
    told = saved(states.join(g, "state_id", "left").withColumn("context", F.coalesce("context", F.lit(""))), "told")
    answers = decide(told.select("state_id", grounded(F.col("state"), F.col("context"), key, first).alias("state")), questions, scorer, options, **more)
    about = told.select("state_id", (F.col("context") != "").alias("used"), "memory_stage", F.coalesce("memory_handoff", F.lit(True)).alias("memory_handoff"), "hit_ids")
    return answers.join(about, "state_id")
