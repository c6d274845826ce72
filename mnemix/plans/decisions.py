"""Registered queries of the decision layer: batched decisions with stand-in models over conversation turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemix.functions import text as T
from mnemix.operators import deciding as D
from mnemix.operators import questions as Q
from mnemix.operators import scoring as S
from mnemix.plans import duck
from mnemix.plans.registry import memory, query, read, saved

ASKED = {
    "topic": {"type": "choice", "instructions": "Which topic?", "criteria": {"billing": "money owed", "travel": "trips", "health": "body and mind", "code": "programs", "other": None}},
    "mood": {"type": "score", "instructions": "How heated?", "criteria": ["calm", "tense", "angry", "furious"]},
    "well": {"type": "noul", "instructions": "Does it end well?", "labels": {"false": "badly", "true": "well"}},
}
MANY = {"shelf": {"type": "choice", "instructions": "Which shelf?", "criteria": [f"shelf {i}" for i in range(40)]}}
QUESTIONS, SHELVES = Q.parse_questions(ASKED), Q.parse_questions(MANY)


def states(spark, sf):
    c = read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("state_id"), F.coalesce("text", F.lit("")).alias("state"))
    return c.groupBy("state_id").agg(F.min("state").alias("state"))


STATES = "st AS (SELECT conv_id * 1000 + turn AS state_id, min(coalesce(text, '')) AS state FROM conversations GROUP BY 1)"


def _options(questions) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rows = [f"({q(x.id)}, {q(x.kind)}, {q(x.instructions)}, {i}, {q(l)}, {q(t)})" for x in questions for i, (l, t) in enumerate(zip(x.labels, x.options))]
    return f"qo AS (SELECT * FROM (VALUES {', '.join(rows)}) v(qid, kind, ins, o, label, opt))"


HASHED = "4 * ('0x' || substr(md5(kind || '|' || ins || '|' || opt || '|' || state), 1, 4))::INT::DOUBLE / 65535"


def direct(questions) -> str:
    """One pass over all options: pr (state_id, qid, kind, o, label, p) and ans (state_id, qid, o, confidence, ...)."""
    return f"""{STATES}, {_options(questions)},
lo AS (SELECT state_id, qid, kind, o, label, {HASHED} + 0.05 * o AS l FROM st CROSS JOIN qo),
pr AS (SELECT state_id, qid, kind, o, label, exp(l - m) / sum(exp(l - m)) OVER (PARTITION BY state_id, qid) AS p FROM (SELECT *, max(l) OVER (PARTITION BY state_id, qid) AS m FROM lo))"""


def answers(pr: str = "pr") -> str:
    return f"""SELECT state_id, qid, any_value(kind) AS kind,
  CASE any_value(kind) WHEN 'choice' THEN arg_max(label, (p, o)) WHEN 'score' THEN arg_max(label, (p, -o)) ELSE CASE WHEN max(p) FILTER (o = 1) >= 0.5 THEN max(label) FILTER (o = 1) ELSE max(label) FILTER (o = 0) END END AS answer,
  CASE any_value(kind) WHEN 'choice' THEN max(p) WHEN 'score' THEN sum(o * p) ELSE max(p) FILTER (o = 1) END AS value,
  CASE any_value(kind) WHEN 'noul' THEN max(p) ELSE least(greatest(1 + sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(count(*)), 0), 1) END AS confidence FROM {pr} GROUP BY 1, 2"""


def shown(d, *more):
    return d.select("state_id", "qid", "answer", F.round("value", 6).alias("value"), F.round("confidence", 6).alias("confidence"), *more)


@query(f"WITH {direct(QUESTIONS)}, a AS ({answers()}) SELECT state_id, qid, answer, round(value, 6) AS value, round(confidence, 6) AS confidence FROM a")
def x8_predict(spark, sf):
    return shown(D.predict(states(spark, sf), QUESTIONS, S.HashScorer()))


@query(f"WITH {direct(QUESTIONS)}, a AS ({answers()}), f AS (SELECT state, min(state_id) AS first FROM st GROUP BY 1) SELECT state_id, qid, answer, confidence < 0.3 AS handoff, state_id <> first AS cached FROM a JOIN st USING (state_id) JOIN f USING (state)")
def x19_decide_batch(spark, sf):
    return D.decide(states(spark, sf), QUESTIONS, S.HashScorer(), D.Options(min_confidence=0.3)).select("state_id", "qid", "answer", "handoff", "cached")


@query(f"""WITH {direct(QUESTIONS)}, a AS ({answers()}), c AS (SELECT state_id, qid, kind, confidence < 0.2 OR (kind = 'noul' AND confidence < 0.2) AS again FROM a),
lb AS (SELECT state_id, qid, kind, o, label, {HASHED} + 0.05 * (max(o) OVER (PARTITION BY state_id, qid) - o) AS l FROM st CROSS JOIN qo),
pb AS (SELECT state_id, qid, kind, o, label, exp(l - m) / sum(exp(l - m)) OVER (PARTITION BY state_id, qid) AS p FROM (SELECT *, max(l) OVER (PARTITION BY state_id, qid) AS m FROM lb)),
av AS (SELECT pr.state_id, pr.qid, pr.kind, pr.o, pr.label, CASE WHEN c.again THEN (pr.p + pb.p) / 2 ELSE pr.p END AS p FROM pr JOIN pb USING (state_id, qid, o) JOIN c USING (state_id, qid)), b AS ({answers('av')})
SELECT state_id, qid, answer, round(value, 6) AS value, round(b.confidence, 6) AS confidence, again AS permuted FROM b JOIN c USING (state_id, qid)""")
def x10_order_ensemble(spark, sf):
    d = D.decide(states(spark, sf), QUESTIONS, S.HashScorer(), D.Options(permute=True, permute_below=0.2))
    return shown(d, "permuted")


@query(f"""WITH {STATES}, {_options(SHELVES)},
h AS (SELECT state_id, o, label, {HASHED} AS h, o // 14 AS g, o % 14 AS pos FROM st CROSS JOIN qo),
f AS (SELECT state_id, o, label, h FROM (SELECT *, row_number() OVER (PARTITION BY state_id, g ORDER BY h + 0.05 * pos DESC, o) AS rn FROM h) WHERE rn <= 3),
l AS (SELECT *, h + 0.05 * (row_number() OVER (PARTITION BY state_id ORDER BY o) - 1) AS l FROM f),
p AS (SELECT *, exp(l - m) / sum(exp(l - m)) OVER (PARTITION BY state_id) AS p FROM (SELECT *, max(l) OVER (PARTITION BY state_id) AS m FROM l))
SELECT state_id, arg_max(label, (p, o)) AS answer, round(1 + sum(p * ln(p)) / ln(count(*)), 6) AS confidence, string_agg(o::VARCHAR, ',' ORDER BY o) AS alive, 2 AS rounds FROM p GROUP BY 1""")
def x9_tournament(spark, sf):
    d = D.decide(states(spark, sf), SHELVES, S.HashScorer())
    return d.select("state_id", "answer", F.round("confidence", 6).alias("confidence"), F.array_join("alive", ",").alias("alive"), "rounds")


def remembered(spark, sf):
    """A stand-in of what nearest cases say: shares and votes by arithmetic; every third state is answered by memory."""
    every = F.sequence(F.lit(0), F.lit(4))
    raw = F.transform(every, lambda o: ((F.col("state_id") * (o + 3)) % 5 + 1).cast("double"))
    d = states(spark, sf).select("state_id", raw.alias("raw"), F.transform(every, lambda o: ((F.col("state_id") * (o + 1)) % 8).cast("int")).alias("votes"))
    pm = F.transform("raw", lambda v: v / F.aggregate("raw", F.lit(0.0), lambda a, x: a + x))
    return d.select("state_id", F.lit("topic").alias("qid"), pm.alias("pm"), "votes", F.when(F.col("state_id") % 3 == 0, pm).alias("first"))


@query(f"""WITH {direct(QUESTIONS[:1])},
m AS (SELECT state_id, o, ((state_id * (o + 3)) % 5 + 1)::DOUBLE AS raw, (state_id * (o + 1)) % 8 AS votes FROM pr),
n AS (SELECT state_id, o, raw / sum(raw) OVER (PARTITION BY state_id) AS pm, votes, max(votes) OVER (PARTITION BY state_id) AS top, sum(votes) OVER (PARTITION BY state_id) AS cast_ FROM m),
r AS (SELECT pr.*, pm, votes, top, cast_, row_number() OVER (PARTITION BY state_id ORDER BY p DESC) AS rn FROM pr JOIN n USING (state_id, o)),
s AS (SELECT *, max(p) FILTER (rn = 1) OVER w - max(p) FILTER (rn = 2) OVER w AS gap, exp(ln(greatest(p, 1e-12)) + 1.5 * ln(pm + 1e-3)) AS mix FROM r WINDOW w AS (PARTITION BY state_id)),
t AS (SELECT state_id, qid, kind, o, label, CASE WHEN state_id % 3 = 0 THEN pm WHEN top >= 7 THEN votes / cast_ WHEN gap < 0.5 THEN mix / sum(mix) OVER (PARTITION BY state_id) ELSE p END AS p, CASE WHEN state_id % 3 = 0 THEN 'memory_first' WHEN top >= 7 THEN 'votes' ELSE 'direct' END AS strategy FROM s),
a AS ({answers('t')}), g AS (SELECT state_id, any_value(strategy) AS strategy FROM t GROUP BY 1)
SELECT state_id, round(value, 6) AS value, round(confidence, 6) AS confidence, strategy FROM a JOIN g USING (state_id)""")
def x13_memory_first(spark, sf):
    known = D.Experience(remembered(spark, sf), {"topic": 1.5}, {"topic": 0.7})
    d = D.decide(states(spark, sf), QUESTIONS[:1], S.HashScorer(), D.Options(agree_votes=7), known)
    return d.select("state_id", F.round("value", 6).alias("value"), F.round("confidence", 6).alias("confidence"), "strategy")


def vectors_sql(table: str, key: str, text: str, name: str, dim: int = 16) -> str:
    """name (key, i, v): components of the hashing embedder's unit vectors of a table's texts, zeros left out."""
    return f"""{name}_w AS (SELECT {key}, md5(w) AS h FROM (SELECT {key}, unnest(string_split(lower({text}), ' ')) AS w FROM {table}) WHERE w <> ''),
{name}_s AS (SELECT {key}, ('0x' || substr(h, 1, 4))::INT % {dim} AS i, sum(CASE WHEN substr(h, 5, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0 END) AS v FROM {name}_w GROUP BY 1, 2),
{name} AS (SELECT {key}, i, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY {key})), 1e-12) AS v FROM {name}_s)"""


@query(f"WITH {STATES}, {vectors_sql('st', 'state_id', 'state', 'e')} SELECT state_id, i, round(v, 6) AS v FROM e WHERE round(v, 6) <> 0")
def x23_embedder(spark, sf):
    d = states(spark, sf).select("state_id", F.posexplode(S.embedded(F.col("state"), S.HashEmbedder())).alias("i", "v"))
    return d.select("state_id", "i", F.round("v", 6).alias("v")).filter("v <> 0")


@query(f"WITH {STATES}, sq AS (SELECT state_id, qid, 'x' || state_id || qid AS k, ins || ' ' || state AS t FROM st CROSS JOIN (VALUES ('topic', 'Which topic?'), ('well', 'Does it end well?')) q(qid, ins)), {vectors_sql('sq', 'k', 't', 'e')} SELECT state_id, qid, i, round(v, 6) AS v FROM e JOIN sq USING (k) WHERE round(v, 6) <> 0")
def x24_context_vectors(spark, sf):
    d = D.context_vectors(states(spark, sf), [QUESTIONS[0], QUESTIONS[2]], S.HashScorer())
    return d.select("state_id", "qid", F.posexplode("vec").alias("i", "v")).select("state_id", "qid", "i", F.round("v", 6).alias("v")).filter("v <> 0")


SHORT = f"""{STATES}, {_options(SHELVES)}, {vectors_sql('st', 'state_id', 'state', 'e')}, {vectors_sql('qo', 'o', 'opt', 'f')},
sim AS (SELECT st.state_id, q.o, coalesce(sum(e.v * f.v), 0) AS s FROM st CROSS JOIN qo q LEFT JOIN f ON f.o = q.o LEFT JOIN e ON e.state_id = st.state_id AND e.i = f.i GROUP BY 1, 2)"""


@query(f"WITH {SHORT}, r AS (SELECT state_id, o, row_number() OVER (PARTITION BY state_id ORDER BY round(s, 9) DESC, o) AS rn FROM sim) SELECT state_id, string_agg(o::VARCHAR, ',' ORDER BY o) AS alive, 1 AS rounds FROM r WHERE rn <= 10 GROUP BY 1")
def x14_embedding_shortlist(spark, sf):
    d = D.decide(states(spark, sf), SHELVES, S.HashScorer(), D.Options(shortlist=10, shortlist_union=False), embedder=S.HashEmbedder())
    return d.select("state_id", F.array_join("alive", ",").alias("alive"), "rounds")


@query(f"WITH {direct(QUESTIONS[:1])}, {vectors_sql('st', 'state_id', 'state', 'e')}, lab AS (SELECT o, label FROM qo), {vectors_sql('lab', 'o', 'label', 'f')}, m AS (SELECT state_id, max(s) AS s FROM (SELECT st.state_id, lab.o, coalesce(sum(e.v * f.v), 0) AS s FROM st CROSS JOIN lab LEFT JOIN f ON f.o = lab.o LEFT JOIN e ON e.state_id = st.state_id AND e.i = f.i GROUP BY 1, 2) GROUP BY 1), t AS (SELECT state_id, max(p) AS p FROM pr GROUP BY 1) SELECT state_id, s < 0.21 OR p < 0.4 AS out_of_scope, s < 0.21 OR p < 0.4 AS handoff FROM m JOIN t USING (state_id)")
def x15_scope_gate(spark, sf):
    d = D.decide(states(spark, sf), QUESTIONS[:1], S.HashScorer(), D.Options(oos_similarity=0.21, oos_probability=0.4), embedder=S.HashEmbedder())
    return d.select("state_id", "out_of_scope", "handoff")


@query(f"WITH {STATES}, w AS (SELECT state_id, CASE WHEN state_id % 3 = 0 THEN repeat('Привет мир ', 200) ELSE '' END || state AS state FROM st) SELECT state_id, state_id % 3 = 0 AND length(regexp_replace(state, '[^\\p{{L}}]', '', 'g')) > 0 AND round(1 - length(regexp_replace(state || ' Does it end well?', '[^A-Za-z\\x{{C0}}-\\x{{24F}}]', '', 'g')) / length(regexp_replace(state || ' Does it end well?', '[^\\p{{L}}]', '', 'g')), 4) >= 0.2 AS handoff FROM w")
def x16_script_gate(spark, sf):
    s = states(spark, sf).select("state_id", F.concat(F.when(F.col("state_id") % 3 == 0, F.repeat(F.lit("Привет мир "), 200)).otherwise(F.lit("")), "state").alias("state"))
    return D.decide(s, QUESTIONS[2:], S.HashScorer()).select("state_id", (F.col("handoff") & F.col("answer").isNull()).alias("handoff"))


@query(f"WITH {STATES}, f AS (SELECT left(state, 1) AS s, min(state_id) AS first, count(*) AS n FROM st GROUP BY 1) SELECT state_id, state_id <> first AS cached FROM st JOIN f ON left(state, 1) = s")
def x18_answer_cache(spark, sf):
    s = states(spark, sf).select("state_id", F.substring("state", 1, 1).alias("state"))
    return D.decide(s, QUESTIONS[2:], S.HashScorer()).select("state_id", "cached")


@query("""WITH c AS (SELECT conv_id, turn, min(coalesce(text, '')) AS t FROM conversations GROUP BY 1, 2)
SELECT conv_id * 1000 + turn AS state_id, CASE turn % 3 WHEN 0 THEN to_json({'input': t, 'memory': 'told before'}) WHEN 1 THEN to_json({'memory': 'told before', 'a': t}) ELSE to_json([{'role': 'user', 'content': 'x'}, {'role': 'system', 'content': 'memory: told before'}, {'role': 'user', 'content': t}]) END AS state,
CASE WHEN turn % 3 = 2 THEN 'x' || chr(10) || t WHEN turn % 3 = 1 THEN t || chr(10) || 'old' ELSE t END AS plain FROM c""")
def x20_ground_states(spark, sf):
    c = read(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("t"))
    kind = F.col("turn") % 3
    user = lambda t: F.struct(F.lit("user").alias("role"), t.alias("content"))
    state = F.when(kind == 0, F.col("t")).when(kind == 1, F.to_json(F.struct(F.col("t").alias("a"), F.lit("old").alias("memory")))).otherwise(F.to_json(F.array(user(F.lit("x")), user(F.col("t")))))
    c = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("state_id"), "turn", state.alias("s"))
    said = F.lit("told before")
    return c.select("state_id", F.when(F.col("turn") % 3 == 1, Q.grounded(F.col("s"), said, first=True)).otherwise(Q.grounded(F.col("s"), said)).alias("state"), Q.state_text(F.col("s")).alias("plain"))


@query(f"""WITH {duck.CASCADE}, hd AS (SELECT query_id, stage = 'hub' OR coverage < 0.5 AS handoff, stage FROM verdict),
told AS (SELECT q.query_id AS state_id, hd.handoff, hd.stage, CASE WHEN hd.handoff OR coalesce(n.text, '') = '' THEN q.q ELSE to_json({{'passage': n.text, 'input': q.q}})::VARCHAR END AS state, NOT hd.handoff AND coalesce(n.text, '') <> '' AS used
  FROM queries q JOIN hd USING (query_id) LEFT JOIN hits h ON h.query_id = q.query_id AND h.rank = 1 LEFT JOIN nodes n ON n.node_id = h.node_id),
{_options(QUESTIONS[2:])}, lo AS (SELECT state_id, qid, kind, o, label, {HASHED} + 0.05 * o AS l FROM told CROSS JOIN qo),
pr AS (SELECT state_id, qid, kind, o, label, exp(l - m) / sum(exp(l - m)) OVER (PARTITION BY state_id, qid) AS p FROM (SELECT *, max(l) OVER (PARTITION BY state_id, qid) AS m FROM lo)), a AS ({answers()})
SELECT state_id, answer, round(value, 6) AS value, used, stage AS memory_stage, handoff AS memory_handoff FROM a JOIN told USING (state_id)""")
def x21_decide_with_memory(spark, sf):
    from mnemix.operators import retrieval as R
    from mnemix.plans.registry import checkpointed, questions

    m, asked = memory(spark, sf), checkpointed(questions(spark, sf))
    hits = saved(R.cascade(m, asked, checkpoint=checkpointed).join(m.nodes.select(F.col("node_id").alias("id"), "text"), "id"), "hits")
    s = asked.select(F.col("query_id").alias("state_id"), F.col("q").alias("state"))
    d = D.decide_with_memory(s, hits, QUESTIONS[2:], S.HashScorer(), D.Options(script_gate=False), key="passage", first=True)
    return d.select("state_id", "answer", F.round("value", 6).alias("value"), "used", "memory_stage", "memory_handoff")


@query(f"SELECT i AS qid, o, opt FROM ({' UNION ALL '.join(f'''SELECT '{x.id}' AS i, {k} AS o, '{t}' AS opt''' for x in QUESTIONS for k, t in enumerate(['billing: money owed', 'travel: trips', 'health: body and mind', 'code: programs', 'other'] if x.id == 'topic' else ['level 0: calm', 'level 1: tense', 'level 2: angry', 'level 3: furious'] if x.id == 'mood' else ['badly: no, the statement does not hold', 'well: yes, the statement holds']))})")
def x2_options(spark, sf):
    return spark.createDataFrame([(q.id, i, o) for q in Q.parse_questions(ASKED) for i, o in enumerate(q.options)], "qid string, o int, opt string")


@query("""WITH t AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'travel' WHEN 1 THEN 'Travel' WHEN 2 THEN (p_size % 7)::VARCHAR ELSE 'TRUE' END AS l FROM part)
SELECT p_partkey, CASE WHEN l = 'travel' THEN 1 END AS topic, CASE WHEN l IN ('0', '1', '2', '3') THEN l::INT END AS mood, CASE WHEN l IN ('TRUE', '1') THEN 1 WHEN l = '0' THEN 0 END AS well FROM t""")
def e11_label_index(spark, sf):
    n = F.col("p_size") % 4
    l = F.when(n == 0, "travel").when(n == 1, "Travel").when(n == 2, (F.col("p_size") % 7).cast("string")).otherwise("TRUE")
    p = read(spark, sf, "part").select("p_partkey", l.alias("l"))
    return p.select("p_partkey", *[Q.label_column(q, F.col("l")).alias(q.id) for q in QUESTIONS])


@query(f"""WITH {direct(QUESTIONS[:1])}, a AS (SELECT state_id, arg_max(o, (p, o)) AS o FROM pr GROUP BY 1), n AS (SELECT state_id, o, row_number() OVER (ORDER BY state_id) - 1 AS seq, count(*) OVER () AS n FROM a),
s AS (SELECT * FROM n WHERE n <= 60 OR seq IN (SELECT i * n // 60 FROM range(0, 60) r(i), (SELECT DISTINCT n FROM n)))
SELECT count(*) AS cases, round(avg((o = state_id % 5)::INT), 6) AS model_accuracy, 0.9 - avg((o = state_id % 5)::INT) >= 0.2 AS memory_first FROM s""")
def e9_calibrate(spark, sf):
    ids = states(spark, sf)
    seq = ids.select("state_id").orderBy("state_id").rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])).toDF("state_id long, seq long")
    some = D.strided(saved(seq, "order"), 60)
    d = D.decide(ids.join(some.select("state_id"), "state_id"), QUESTIONS[:1], S.HashScorer())
    g = D.calibrated(d, some.select("state_id", (F.col("state_id") % 5).alias("label")), 0.9, 8, 0.2)
    return g.select("cases", F.round("model_accuracy", 6).alias("model_accuracy"), "memory_first")


@query("SELECT l_orderkey, l_linenumber, '{\"price\": ' || CASE WHEN contains(l_extendedprice::VARCHAR, '.') THEN l_extendedprice::VARCHAR ELSE l_extendedprice::VARCHAR || '.0' END || ', \"mode\": \"' || l_returnflag || '\"}' AS js FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_extendedprice::DOUBLE AS l_extendedprice, l_returnflag FROM lineitem)")
def t13_py_json(spark, sf):
    d = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("p"), "l_returnflag").distinct()
    return d.select("l_orderkey", "l_linenumber", Q.py_json_column(F.to_json(F.struct(F.col("p").alias("price"), F.col("l_returnflag").alias("mode")))).alias("js"))


@query("""WITH n AS (SELECT 'F_' || c_custkey AS node_id, c_name || chr(10) || c_mktsegment AS t, c_custkey FROM customer) SELECT node_id, c_custkey % 3 <> 0 OR c_custkey % 5 = 0 AS renewed FROM n""")
def i7_incremental_embedding(spark, sf):
    """A third of the customers have a vector of their present text, some of those of an older one, and one is gone."""
    c = read(spark, sf, "customer").select(F.concat(F.lit("F_"), "c_custkey").alias("node_id"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("text"), "c_custkey")
    stamp = F.xxhash64(F.concat_ws("\n", "label", "text"))
    old = c.filter("c_custkey % 3 = 0").select("node_id", F.when(F.col("c_custkey") % 5 == 0, F.lit(0).cast("long")).otherwise(stamp).alias("hash"), F.array(F.lit(9.0)).alias("vec"))
    old = old.unionByName(spark.createDataFrame([("F_gone", 1, [9.0])], "node_id string, hash long, vec array<double>"))
    return S.refreshed_embeddings(c, old, S.HashEmbedder()).select("node_id", (F.size("vec") > 1).alias("renewed"))


@query("SELECT item_id, length(text) > 0 AND (CASE WHEN item_id % 2 = 0 THEN length(regexp_replace(text, '[^\\p{L}]', '', 'g')) < 4 * 18 * 5 ELSE false END) AS unreadable FROM benchmark")
def t12_unreadable(spark, sf):
    t = F.when(F.col("item_id") % 2 == 0, F.concat(F.repeat(F.lit("слово"), 18), "text")).otherwise(F.col("text"))
    return read(spark, sf, "benchmark").select("item_id", T.unreadable_for_english(t).alias("unreadable"))


@query("""SELECT item_id, '日本,本語,' || lower(regexp_replace(substr(t, 1, 3), '[^A-Za-z]', '', 'g')) || ',ไท,ทย,語' AS words FROM (SELECT item_id, 'abc' AS t FROM benchmark)""")
def t2_unspaced(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", F.array_join(T.split_words(F.lit("日本語abcไทย 語")), ",").alias("words"))


