"""Registered queries of the evaluation analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemix.functions import text as T
from mnemix.operators import decision as D
from mnemix.operators import evaluation as A
from mnemix.operators import experience as E
from mnemix.plans import duck
from mnemix.plans.registry import NEAR_SQL, PROBS_SQL, cases, logits, query, read

def drawn(key: str, of: str) -> str:
    """Rows of a table with replicate b and weight w, arithmetic step by step to keep the expressions short."""
    steps = f"d0 AS (SELECT t.*, b, (({key})::BIGINT * 48271 + b * 69621 + 12345) % 2147483647 AS x FROM {of} t CROSS JOIN reps)"
    for i, add in enumerate((7, 11, 13)):
        steps += f", d{i + 1} AS (SELECT * REPLACE ((x * x + {add}) % 2147483647 AS x) FROM d{i})"
    w = " + ".join(f"(x::DOUBLE / 2147483647 >= {p!r}::DOUBLE)::INT" for p in A.POISSON)
    return steps + f", drawn AS (SELECT *, {w} AS w FROM d3)"


@query(f"WITH reps AS (SELECT range AS b FROM range(1, 101)), {drawn('o_orderkey', 'orders')}, g AS (SELECT o_orderpriority, b, sum(w * (o_orderstatus = 'F')::INT)::DOUBLE / sum(w) AS m FROM drawn GROUP BY 1, 2 HAVING sum(w) > 0), m AS (SELECT o_orderpriority, avg((o_orderstatus = 'F')::INT) AS mean FROM orders GROUP BY 1) SELECT o_orderpriority, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi FROM m JOIN (SELECT o_orderpriority, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM g GROUP BY 1) USING (o_orderpriority)")
def a3_bootstrap(spark, sf):
    return A.resampled_mean(read(spark, sf, "orders"), "o_orderpriority", F.col("o_orderkey"), F.col("o_orderstatus") == "F", 100)


@query(f"""WITH reps AS (SELECT range AS b FROM range(1, 41)), ev AS (SELECT event_id, event_type, value FROM events WHERE event_type IS NOT NULL), {drawn('event_id', 'ev')},
v AS (SELECT event_type, b, value, sum(w) AS w FROM drawn WHERE w > 0 GROUP BY 1, 2, 3), c AS (SELECT *, sum(w) OVER (PARTITION BY event_type, b ORDER BY value) AS upto, sum(w) OVER (PARTITION BY event_type, b) AS total FROM v),
p AS (SELECT event_type, b, min(value) AS v FROM c WHERE upto >= 0.5 * total GROUP BY 1, 2), i AS (SELECT event_type, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM p GROUP BY 1)
SELECT a.event_type AS a, c.event_type AS b, a.lo, a.hi, CASE WHEN a.hi < c.lo THEN 'faster' WHEN a.lo > c.hi THEN 'slower' ELSE 'tie' END AS verdict FROM i a JOIN i c ON a.event_type < c.event_type""")
def a27_speed_verdict(spark, sf):
    i = A.resampled_percentile(read(spark, sf, "events").filter("event_type is not null"), "event_type", F.col("event_id"), F.col("value"), 0.5, 40)
    c = i.select(F.col("event_type").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    d = i.withColumnRenamed("event_type", "a").join(c, F.col("a") < F.col("b"))  # a handful of kinds
    return d.select("a", "b", "lo", "hi", A.speed_verdict(F.col("lo"), F.col("hi"), F.col("lo_b"), F.col("hi_b")).alias("verdict"))


HITS = "h AS (SELECT DISTINCT l_orderkey AS query_id, l_linenumber AS rank, l_suppkey % 10 AS id, l_orderkey % 4 = 0 AS handoff FROM lineitem), gold AS (SELECT o_orderkey AS query_id, o_custkey % 10 AS gold, o_orderpriority AS suite FROM orders)"


@query(f"""WITH {HITS}, per AS (SELECT query_id, bool_or(id = gold AND rank = 1) AS first, bool_or(id = gold AND rank <= 5) AS five, bool_or(handoff) AS off FROM h JOIN gold USING (query_id) GROUP BY 1),
d AS (SELECT suite, coalesce(first, false) AS first, coalesce(five, false) AS five, coalesce(off, true) AS off FROM gold LEFT JOIN per USING (query_id))
SELECT suite, count(*) AS n, round(avg(first::INT), 6) AS recall_1, round(avg(five::INT), 6) AS recall_5, round(avg(off::INT), 6) AS handoff, round(avg((NOT first AND NOT off)::INT), 6) AS confidently_wrong, round(avg((first AND NOT off)::INT), 6) AS answered_right, round(avg((first AND off)::INT), 6) AS handed_off_right FROM d GROUP BY 1""")
def a8_retrieval_report(spark, sf):
    l = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), (F.col("l_suppkey") % 10).alias("id"), (F.col("l_orderkey") % 4 == 0).alias("handoff"))
    g = read(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") % 10).alias("gold"), F.col("o_orderpriority").alias("suite"))
    return A.retrieval_report(l, g, "suite")


@query("""WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.5) FILTER (pos > n // 2), 6) AS p50_late FROM e GROUP BY 1""")
def a9_second_half(spark, sf):
    return A.latency(read(spark, sf, "events"), "value", "event_type", "event_id")


@query("""WITH g AS (SELECT p_name, l_suppkey, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), t AS (SELECT p_name, min(p_partkey) AS id FROM part WHERE p_partkey % 3 = 0 GROUP BY 1),
b AS (SELECT p_name, l_suppkey FROM g WHERE l_suppkey % 5 = 0 QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY n DESC, l_suppkey) = 1)
SELECT m.p_name AS mention, coalesce(b.l_suppkey, t.id) AS answer, CASE WHEN b.l_suppkey IS NOT NULL THEN 'alias' WHEN t.id IS NOT NULL THEN 'title' ELSE 'none' END AS "by" FROM (SELECT DISTINCT p_name FROM g) m LEFT JOIN b USING (p_name) LEFT JOIN t USING (p_name)""")
def a10_alias_answers(spark, sf):
    d = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    pool = read(spark, sf, "supplier").filter("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("target"))
    titles = read(spark, sf, "part").filter("p_partkey % 3 = 0").select(F.col("p_name").alias("title"), F.col("p_partkey").alias("id"))
    return A.alias_answers(d, "p_name", "l_suppkey", pool, titles)


@query(f"""WITH {NEAR_SQL}, d AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY sim DESC, seq) AS rn FROM near WHERE (probe + label) % 2 = 0),
g AS (SELECT probe, label, round(sum(exp(sim / 0.1)), 6) AS w FROM d WHERE rn <= 6 GROUP BY 1, 2) SELECT probe, label FROM g QUALIFY row_number() OVER (PARTITION BY probe ORDER BY w DESC, label) = 1""")
def a12_pool_votes(spark, sf):
    c = cases(spark, sf)
    labels = [r.label for r in c.select("label").distinct().collect()]
    pool = c.select(F.col("seq").alias("probe"), F.explode(F.array(*map(F.lit, labels))).alias("label")).filter("(probe + label) % 2 = 0")
    return A.pool_votes(E.neighbours(c, c), pool, 6, 0.1)


@query("""WITH g AS (SELECT DISTINCT o_custkey AS id, 0 AS o FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 10 = 1), n AS (SELECT DISTINCT o_custkey AS id, 1 AS o FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) WHERE rk <= 8),
h AS (SELECT id, min(o) AS o FROM (SELECT * FROM g UNION ALL SELECT * FROM n) GROUP BY 1), f AS (SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT id FROM h) ORDER BY md5('pool' || c_custkey), c_custkey LIMIT (SELECT greatest(0, 120 - count(*)) FROM h))
SELECT id, CASE o WHEN 0 THEN 'gold' ELSE 'hard' END AS why FROM h UNION ALL SELECT id, 'fill' FROM f""")
def a15_build_pool(spark, sf):
    o = read(spark, sf, "orders")
    gold = o.filter("o_orderpriority = '1-URGENT' and o_orderkey % 10 = 1").select(F.col("o_custkey").alias("id"))
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    negatives = o.select("o_orderpriority", F.col("o_custkey").alias("id"), F.row_number().over(w).alias("rank"))
    return A.build_pool(gold, negatives, read(spark, sf, "customer").select(F.col("c_custkey").alias("id")), 8, 120)


@query("SELECT sum(n)::BIGINT AS n, round(sum(n) FILTER (n > 1) / sum(n), 6) AS duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY md5(lower(coalesce(text, ''))))")
def a15_duplicate_rate(spark, sf):
    return A.duplicate_rate(read(spark, sf, "documents"), F.md5(F.lower(F.coalesce("text", F.lit("")))))


@query("""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), u AS (SELECT * FROM d WHERE doc_id % 4 = 0)
SELECT doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM u) AND t NOT IN (SELECT t FROM u) ORDER BY md5('fresh' || doc_id), doc_id LIMIT 100""")
def a16_fresh_sample(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "text")
    return A.fresh_sample(d, d.filter("doc_id % 4 = 0"), "doc_id", F.lower(F.coalesce("text", F.lit(""))), 100).select("doc_id")


@query(f"""WITH b AS (SELECT item_id AS doc_id, text, {duck.sentences('text')} AS s, list_distinct({duck.terms('text')}) AS w FROM benchmark), t AS (SELECT doc_id, unnest(w) AS term FROM b), v AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
r AS (SELECT doc_id, t.term, row_number() OVER (PARTITION BY doc_id ORDER BY df, t.term) AS rn FROM t JOIN v ON v.term = t.term)
SELECT doc_id, 'title' AS kind, 'item ' || doc_id AS q FROM b UNION ALL SELECT doc_id, 'sentence', s[-1] FROM b WHERE len(s) > 1 UNION ALL SELECT doc_id, 'keywords', string_agg(term, ' ' ORDER BY rn) FROM r WHERE rn <= 3 GROUP BY 1""")
def a17_query_synthesis(spark, sf):
    b = read(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    words = T.terms(F.col("text"))
    vocab = b.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return A.synthesized_queries(b, vocab, T.sentences(F.col("text")), words, F.concat(F.lit("item "), F.col("doc_id").cast("string")))


@query("""WITH d AS (SELECT lang, doc_id AS id, source AS own FROM documents WHERE lang IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 15), l AS (SELECT DISTINCT source AS label FROM documents WHERE source IS NOT NULL),
p AS (SELECT lang, id, own, label FROM d CROSS JOIN l QUALIFY row_number() OVER (PARTITION BY lang, id ORDER BY coalesce(label = own, false) DESC, md5('lang' || id || ':' || label)) <= 4)
SELECT lang, id, row_number() OVER (PARTITION BY lang, id ORDER BY md5('langshown' || id || ':' || label)) AS place, label, label = own AS gold FROM p""")
def a18_language_set(spark, sf):
    d = read(spark, sf, "documents").filter("lang is not null").select("lang", F.col("doc_id").alias("id"), F.col("source").alias("label"))
    out = A.language_set(d, d.filter("label is not null"), 15, 3)
    return out.withColumn("place", F.col("place").cast("long"))


GRID = f"""{PROBS_SQL}, g AS (SELECT query_id % 3 AS suite, query_id, option, p, 1.0 / (1 + abs(option - (query_id % 4 + 1))) AS pm, query_id % 4 + 1 AS gold, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, option) AS rn FROM probs),
gaps AS (SELECT *, max(p) FILTER (rn = 1) OVER w - coalesce(max(p) FILTER (rn = 2) OVER w, 0) AS gap FROM g WINDOW w AS (PARTITION BY query_id)),
cells AS (SELECT w, m, row_number() OVER (ORDER BY wi, mi) - 1 AS cell FROM (VALUES (0.5::DOUBLE, 1), (2.0, 2)) a(w, wi), (VALUES (0.0::DOUBLE, 1), (0.3, 2), (0.8, 3)) b(m, mi)),
raw AS (SELECT *, CASE WHEN gap < m THEN exp(ln(greatest(p, 1e-12)) + w * ln(pm + 1e-3)) ELSE p END AS raw FROM gaps CROSS JOIN cells),
best AS (SELECT w, m, cell, suite, query_id, max(gold) AS gold, arg_min(option, (-round(raw, 9), option)) AS o, max(round(raw, 9)) / sum(raw) AS top FROM raw GROUP BY ALL),
grid AS (SELECT w AS weight, m AS margin, cell, suite, round(avg((o = gold)::INT), 6) AS accuracy, round(avg((o = gold)::INT) - avg((o <> gold AND top >= 0.8)::INT), 6) AS objective FROM best GROUP BY ALL)"""


def grid(spark, sf):
    p = D.softmax(logits(spark, sf), 1.5)
    gold = F.col("query_id") % 4 + 1
    p = p.select((F.col("query_id") % 3).alias("suite"), "query_id", "option", "p", (1.0 / (1 + F.abs(F.col("option") - gold))).alias("pm"), gold.alias("gold"))
    return A.grid_scores(p, [0.5, 2.0], [0.0, 0.3, 0.8])


@query(f"WITH {GRID}, f AS (SELECT suite, accuracy - 0.02 AS floor FROM grid WHERE cell = 0), c AS (SELECT weight, margin, cell, bool_and(accuracy >= floor) AS ok, round(avg(accuracy), 6) AS mean FROM grid JOIN f USING (suite) GROUP BY 1, 2, 3) SELECT weight, margin, mean FROM c WHERE ok ORDER BY mean DESC, cell LIMIT 1")
def a21_grid_choice(spark, sf):
    g = grid(spark, sf)
    return A.best_cell_no_suite_worse(g, g.filter("cell = 0").select("suite", (F.col("accuracy") - 0.02).alias("floor")))


@query(f"WITH {GRID} SELECT weight, margin, suite, accuracy, objective FROM grid")
def a29_gate_sweep(spark, sf):
    return grid(spark, sf).select("weight", "margin", "suite", "accuracy", "objective")


RUNS = """g AS (SELECT o_custkey % 50 AS query_id, o_orderkey % 400 AS item, max(o_totalprice)::DOUBLE AS p, sum(o_totalprice)::DOUBLE AS s FROM orders GROUP BY 1, 2),
a AS (SELECT query_id, item, p AS score, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, item) AS rank FROM g), b AS (SELECT query_id, item, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item) AS rank FROM g)"""


@query(f"""WITH {RUNS}, d AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, a.rank AS ra, b.rank AS rb, a.score AS sa, b.score AS sb FROM (SELECT * FROM a WHERE rank <= 10) a FULL JOIN (SELECT * FROM b WHERE rank <= 10) b ON a.query_id = b.query_id AND a.item = b.item)
SELECT query_id, bool_and(coalesce(ra = rb, false)) AS same, round(count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) / 10.0, 6) AS overlap, round(coalesce(max(abs(sa - sb)), 0), 2) AS top_delta FROM d GROUP BY 1""")
def a22_compared_runs(spark, sf):
    g = read(spark, sf, "orders").groupBy((F.col("o_custkey") % 50).alias("query_id"), (F.col("o_orderkey") % 400).alias("item")).agg(F.max("o_totalprice").cast("double").alias("p"), F.sum("o_totalprice").cast("double").alias("s"))
    run = lambda c: g.select("query_id", "item", F.col(c).alias("score"), F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), "item")).alias("rank"))
    return A.compared_runs(run("p"), run("s"), 10).withColumn("top_delta", F.round("top_delta", 2))


@query("WITH a AS (SELECT l_orderkey, arg_min(l_suppkey, (l_partkey, l_linenumber)) AS a, arg_max(l_suppkey, (l_partkey, l_linenumber)) AS b FROM lineitem GROUP BY 1) SELECT count(*) AS n, round(avg((a <> b)::INT), 6) AS flips FROM a")
def a26_flip_rate(spark, sf):
    l = read(spark, sf, "lineitem")
    key = F.struct("l_partkey", "l_linenumber")
    return A.flip_rate(l.groupBy("l_orderkey").agg(F.min_by("l_suppkey", key).alias("x")), l.groupBy("l_orderkey").agg(F.max_by("l_suppkey", key).alias("x")), "l_orderkey", "x")


@query("""WITH d AS (SELECT CASE WHEN l_returnflag = 'N' THEN 'handoff' WHEN l_linestatus = 'F' THEN 'hit' ELSE 'wrong passage' END AS outcome, (l_discount > 0.05)::INT AS answer, (l_tax > 0.04)::INT AS gold, 1 - l_discount AS confidence FROM lineitem)
SELECT outcome, count(*) AS n, round(avg((answer = gold)::INT), 6) AS accuracy, round(avg((answer <> gold AND confidence >= 0.95)::INT), 6) AS confidently_wrong, round(avg((gold = 1)::INT), 6) AS always_yes FROM d GROUP BY 1""")
def a28_grounding_report(spark, sf):
    l = read(spark, sf, "lineitem")
    outcome = A.retrieval_outcome(F.col("l_returnflag") == "N", F.col("l_linestatus") == "F")
    d = l.select(outcome.alias("outcome"), (F.col("l_discount") > 0.05).cast("int").alias("answer"), (F.col("l_tax") > 0.04).cast("int").alias("gold"), (1 - F.col("l_discount")).alias("confidence"))
    return A.grounding_report(d, 0.95)


@query("""WITH g AS (SELECT o_custkey, avg((o_orderstatus = 'O')::INT) AS acc, count(*) FILTER (o_totalprice > 150000 AND NOT o_orderstatus = 'O') AS a_only, count(*) FILTER (o_orderstatus = 'O' AND NOT o_totalprice > 150000) AS b_only FROM orders GROUP BY 1)
SELECT count(*) AS groups, round(avg(acc), 6) AS macro, count(*) FILTER (acc > 3 * 0.25) AS above, sum(a_only)::BIGINT AS a_only, sum(b_only)::BIGINT AS b_only FROM g""")
def a25_group_report(spark, sf):
    return A.group_report(read(spark, sf, "orders"), "o_custkey", F.col("o_orderstatus") == "O", F.lit(4.0), F.col("o_totalprice") > 150000, F.col("o_orderstatus") == "O")


@query("""WITH c AS (SELECT l_suppkey % 7 AS k, avg((l_discount > 0.05)::INT) AS a, avg((l_tax > 0.04)::INT) AS b, count(*) FILTER (l_discount > 0.05 AND NOT l_tax > 0.04) AS x, count(*) FILTER (l_tax > 0.04 AND NOT l_discount > 0.05) AS y FROM lineitem GROUP BY 1),
p AS (SELECT *, least(1.0, 2 * list_sum(list_transform(range(0, least(x, y) + 1), lambda i: exp(lgamma(x + y + 1) - lgamma(i + 1) - lgamma(x + y - i + 1) - (x + y) * ln(2.0))))) AS p FROM c)
SELECT k, CASE WHEN p < 0.05 AND a > b THEN 'beat' WHEN p < 0.05 AND a < b THEN 'loss' ELSE 'tie' END AS verdict FROM p""")
def a27_paired_verdict(spark, sf):
    l = read(spark, sf, "lineitem").withColumn("k", F.col("l_suppkey") % 7)
    d = A.mcnemar(A.paired_counts(l, F.col("l_discount") > 0.05, F.col("l_tax") > 0.04, "k"))
    n = F.col("both") + F.col("a_only") + F.col("b_only") + F.col("neither")
    return d.select("k", A.verdict((F.col("both") + F.col("a_only")) / n, (F.col("both") + F.col("b_only")) / n, F.col("p")).alias("verdict"))
