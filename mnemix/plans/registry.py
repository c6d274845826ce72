"""The library's registered queries over the driver's tables, each with its DuckDB counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemix.functions import text as T
from mnemix.operators import decision as D
from mnemix.operators import evaluation as A
from mnemix.operators import experience as E
from mnemix.operators import memory as M
from mnemix.operators import retrieval as R
from mnemix.plans import duck
from mnemix.sources import ingest
from mnemix.sources.tables import checkpointed, read, running, saved, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def joined(c):
    return F.array_join(c, " ")


# text -----------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5(array_to_string({duck.words('text')}, ' ')) AS words, len({duck.words('text')}) AS n FROM documents")
def t1_split_words(spark, sf):
    w = T.split_words(F.col("text"))
    return spread(read(spark, sf, "documents")).select("doc_id", w.alias("w")).select("doc_id", F.md5(joined("w")).alias("words"), F.size("w").cast("long").alias("n"))


@query(f"SELECT doc_id, md5(array_to_string({duck.terms('text')}, ' ')) AS terms, len({duck.terms('text')}) AS n FROM documents")
def t4_terms(spark, sf):
    return spread(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", T.terms(F.col("text")).alias("t")).select("doc_id", F.md5(joined("t")).alias("terms"), F.size("t").cast("long").alias("n"))


def term_table(spark, sf):
    return spread(read(spark, sf, "documents").select("text")).select(F.explode(T.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("uses"))


TERMS_SQL = f"WITH t AS (SELECT term, count(*) AS uses FROM (SELECT unnest({duck.terms('text')}) AS term FROM documents) GROUP BY 1)"


@query(f"{TERMS_SQL} SELECT term, uses, {duck.stem('t.term')} AS stem FROM t")
def t5_stem(spark, sf):
    return term_table(spark, sf).select("term", "uses", T.stem(F.col("term")).alias("stem"))


@query(f"{TERMS_SQL} SELECT term, array_to_string(list_sort({duck.grams('term')}), ' ') AS grams, len({duck.grams('term')}) AS n FROM t")
def t6_trigrams(spark, sf):
    g = term_table(spark, sf).select("term", T.trigrams(F.col("term")).alias("g"))
    return g.select("term", joined(F.array_sort("g")).alias("grams"), F.size("g").cast("long").alias("n"))


@query(f"""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), g AS (SELECT w, {duck.grams('w')} AS g FROM w)
SELECT a.w AS a, b.w AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS jaccard FROM g a JOIN g b ON a.w < b.w WHERE len(list_intersect(a.g, b.g)) > 0""")
def t7_jaccard(spark, sf):
    w = read(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct().withColumn("g", T.trigrams(F.col("w")))
    e = w.select("w", "g", F.explode("g").alias("gram"))
    a, b = (e.select(F.col("w").alias(n), F.col("g").alias(n + "g"), "gram") for n in "ab")
    pairs = a.join(b, "gram").filter("a < b").groupBy("a", "b").agg(F.first("ag").alias("ag"), F.first("bg").alias("bg"))
    return pairs.select("a", "b", F.round(T.jaccard(F.col("ag"), F.col("bg")), 6).alias("jaccard"))


@query(f"SELECT doc_id, len({duck.sentences('text')}) AS n, md5(array_to_string({duck.sentences('text')}, '|')) AS digest FROM documents")
def t8_sentences(spark, sf):
    d = spread(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query(f"SELECT item_id, {duck.FNV} AS hash FROM (SELECT item_id, hex(encode(text)) AS hx FROM benchmark)")
def t10_fnv(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", T.fnv32(F.col("text")).alias("hash"))


@query("""SELECT doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters,
round(CASE WHEN length(regexp_replace(text, '[^\\p{L}]', '', 'g')) = 0 THEN 0.0 ELSE 1 - length(regexp_replace(text, '[^A-Za-z\\x{C0}-\\x{24F}\\x{1E00}-\\x{1EFF}\\x{2C60}-\\x{2C7F}\\x{A720}-\\x{A7FF}\\x{FF21}-\\x{FF3A}\\x{FF41}-\\x{FF5A}]', '', 'g')) / length(regexp_replace(text, '[^\\p{L}]', '', 'g')) END, 4) AS non_latin, 'latin' AS script FROM documents""")
def t11_script(spark, sf):
    d = spread(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", T.script_profile(F.col("text")).alias("p"))
    return d.select("doc_id", F.col("p.letters").cast("long").alias("letters"), F.col("p.non_latin_fraction").alias("non_latin"), F.col("p.script").alias("script"))


@query("SELECT conv_id, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, coalesce(text, ''))) AS state FROM conversations GROUP BY 1")
def t14_plain_state(spark, sf):
    return D.plain_state(read(spark, sf, "conversations")).select("conv_id", F.md5("state").alias("state"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_type, ' ') AS w, p_size FROM part)
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN array_to_string(w, '+') WHEN 1 THEN array_to_string(list_transform(w, lambda x: x || '_a'), '+') ELSE array_to_string(list_prepend('x1', w), '+') END AS items FROM w""")
def t15_list_items(spark, sf):
    w = F.split("p_type", " ")
    one = F.concat(F.lit("["), F.array_join(w, "], ["), F.lit("]"))
    two = F.concat(F.lit("{`"), F.array_join(F.transform(w, lambda x: F.concat(x, F.lit(" a"))), "'; \""), F.lit("`} | --- ;"))
    three = F.concat(F.lit(" (x1)|;, "), F.array_join(w, " | "))
    v = F.when(F.col("p_size") % 3 == 0, one).when(F.col("p_size") % 3 == 1, two).otherwise(three)
    return read(spark, sf, "part").select("p_partkey", F.array_join(T.list_items(v), "+").alias("items"))


@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(CASE p_size % 3 WHEN 0 THEN p_name || '  (a Part)' WHEN 1 THEN '(x) ' || p_name || ' (' || p_size || ') End' ELSE replace(p_name, ' ', '   ') || ' (open' END), '\\([^)]*\\)', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM part""")
def t16_normalized_title(spark, sf):
    n = F.upper("p_name")
    t = F.when(F.col("p_size") % 3 == 0, F.concat(n, F.lit("  (a Part)"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("(x) "), n, F.lit(" ("), F.col("p_size").cast("string"), F.lit(") End"))).otherwise(F.concat(F.replace(n, F.lit(" "), F.lit("   ")), F.lit(" (open")))
    return read(spark, sf, "part").select("p_partkey", T.normalized_title(t).alias("title"))


@query(f"""WITH b AS (SELECT item_id, list_distinct({duck.terms('text')}) AS t FROM benchmark), r AS (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, w) AS rn FROM (SELECT item_id, unnest(t) AS w FROM b))
SELECT item_id, string_agg({duck.typo('w')}, ' ' ORDER BY rn) AS asked FROM r WHERE rn <= 3 GROUP BY 1""")
def t17_typo_keywords(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", joined(F.transform(T.keywords(F.col("text"), 3), T.typo)).alias("asked"))


@query("SELECT item_id, 'item ' || item_id || ': ' || array_to_string(list_slice(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), 1, 8), ' ') AS option FROM benchmark")
def t18_option_text(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", T.option_text(F.concat(F.lit("item "), F.col("item_id").cast("string")), F.col("text"), 8).alias("option"))


@query(f"SELECT doc_id, md5(array_to_string({duck.loader_terms('text')}, ' ')) AS terms FROM documents")
def t19_loader_terms(spark, sf):
    return spread(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.md5(joined(T.loader_terms(F.col("text")))).alias("terms"))


# ingest ---------------------------------------------------------------------------------------------------------------


def passages(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("doc_seq"), "text", "source")
    return ingest.passages(spread(docs))


@query(f"WITH {duck.PASSAGES} SELECT doc_id, passage_seq, id, md5(text) AS digest FROM passages")
def d5_passages(spark, sf):
    return passages(spark, sf).select(F.col("doc_seq").alias("doc_id"), F.col("passage_seq").cast("long").alias("passage_seq"), "id", F.md5("text").alias("digest"))


@query(f"WITH {duck.PASSAGES}, d AS (SELECT DISTINCT id, {duck.CAPITAL} || term[2:] AS t FROM record_terms) SELECT id, count(*) AS n, md5(string_agg(t, ' ' ORDER BY encode(t))) AS data FROM d GROUP BY 1")
def d6_passage_data(spark, sf):
    p = ingest.content_records(passages(spark, sf)).filter(F.size("data") > 0)
    return p.select("id", F.size("data").cast("long").alias("n"), F.md5(joined("data")).alias("data"))


@query("SELECT 'P' || p_partkey AS id, p_name AS action, list_sort([replace(p_brand, ' ', '_'), replace(p_type, ' ', '_')])[1] AS first_data, 2 AS n_data, 'Role_' || p_size AS access FROM part")
def d3_parse_atf(spark, sf):
    c = lambda n: F.col(n).cast("string")
    text = F.concat(
        F.lit("intro line\n# Catalogue\nnot a record\n## [ID: P"), c("p_partkey"), F.lit("]\n**Action:** "), c("p_name"), F.lit("\n**Data_Connections:** ["), c("p_brand"), F.lit("], ["), c("p_type"), F.lit("]\n**Access:** Role_"), c("p_size"), F.lit("\nfree text\n")
    )
    docs = read(spark, sf, "part").select(F.col("p_partkey").alias("doc_seq"), text.alias("text"))
    p = ingest.parse_atf(docs)
    return p.select("id", "action", F.get("data", F.lit(0)).alias("first_data"), F.size("data").alias("n_data"), F.array_join("access", ",").alias("access"))


@query("SELECT s_suppkey, 'S' || s_suppkey AS fn, 'N' || s_nationkey AS component FROM supplier")
def d7_entity_tags(spark, sf):
    text = F.concat(F.lit("(Component N"), F.col("s_nationkey").cast("string"), F.lit(") runs\n\nthen (Function S"), F.col("s_suppkey").cast("string"), F.lit(") works"))
    t = ingest.entity_tags(read(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_seq"), text.alias("text")))
    return t.filter("kind = 'function'").select(F.col("doc_seq").alias("s_suppkey"), F.col("name").alias("fn"), "component")


@query("SELECT user_id AS id, max(event_id) AS doc_seq, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def s3_newest_wins(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("doc_seq"), "event_type", "value")
    return ingest.newest_wins(e, "id", ("doc_seq",)).select("id", "doc_seq", "event_type", "value")


@query("""WITH old AS (SELECT DISTINCT o_custkey AS owner, o_custkey % 50 + 1 AS target FROM orders), new AS (SELECT c_custkey AS owner, c_nationkey + 1 AS target FROM customer WHERE c_custkey % 3 = 0)
SELECT 'link' AS kind, owner::VARCHAR AS a, target::VARCHAR AS b FROM old WHERE owner NOT IN (SELECT owner FROM new) UNION SELECT 'link', owner::VARCHAR, target::VARCHAR FROM new
UNION SELECT 'concept', c_custkey::VARCHAR, lower(c_mktsegment) FROM customer WHERE c_custkey % 3 <> 0""")
def s3_links_and_concepts(spark, sf):
    """Records defined again lose the links they own and their concepts; links that point at them stay."""
    c = read(spark, sf, "customer")
    again = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"))
    old = read(spark, sf, "orders").select(F.col("o_custkey").alias("owner"), (F.col("o_custkey") % 50 + 1).alias("target")).distinct()
    new = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("owner"), (F.col("c_nationkey") + 1).alias("target"))
    links = ingest.upsert_links(old, new, again).select(F.lit("link").alias("kind"), F.col("owner").cast("string").alias("a"), F.col("target").cast("string").alias("b"))
    concepts = c.select(F.col("c_custkey").alias("id"), F.lower("c_mktsegment").alias("stem")).join(again, "id", "left_anti")
    return links.unionByName(concepts.select(F.lit("concept").alias("kind"), F.col("id").cast("string").alias("a"), F.col("stem").alias("b")))


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 0.0 FROM orders WHERE o_orderstatus = 'F'")
def s8_upsert(spark, sf):
    o = read(spark, sf, "orders")
    new = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.lit(0.0).alias("price"))
    return ingest.upsert(o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")), new)


@query("""WITH ids AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0), l AS (SELECT o_custkey AS owner, o_custkey % 97 + 1 AS target FROM orders)
SELECT owner, target, count(*) AS n FROM l WHERE owner IN (SELECT id FROM ids) AND target IN (SELECT id FROM ids) GROUP BY 1, 2""")
def s12_hydrate(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    links = read(spark, sf, "orders").select(F.col("o_custkey").alias("owner"), (F.col("o_custkey") % 97 + 1).alias("target"))
    return ingest.hydrate(c, links, c.filter("c_acctbal > 0"))[1].groupBy("owner", "target").agg(F.count("*").alias("n"))


@query("""SELECT item_id, CASE WHEN item_id % 2 = 0 THEN substr(t, greatest(1, instr(t, '[START_ENT]') - 20), instr(t, '[END_ENT]') + 9 + 20 - greatest(1, instr(t, '[START_ENT]') - 20)) ELSE substr(text, 1, 40) END AS state
FROM (SELECT item_id, text, substr(text, 1, 50) || '[START_ENT]' || substr(text, 51, 5) || '[END_ENT]' || substr(text, 56) AS t FROM benchmark)""")
def s14_mention_window(spark, sf):
    t = F.concat(F.substring("text", 1, 50), F.lit("[START_ENT]"), F.substring("text", 51, 5), F.lit("[END_ENT]"), F.substr("text", F.lit(56)))
    b = read(spark, sf, "benchmark").withColumn("t", F.when(F.col("item_id") % 2 == 0, t).otherwise(F.col("text")))
    return b.select("item_id", ingest.mention_window(F.col("t"), 20, 40).alias("state"))


# graph and index ------------------------------------------------------------------------------------------------------


SHARED: dict | None = None  # where it is a dict, queries of one session share the tables of a memory, as the tests do


def memory(spark, sf):
    if SHARED is None:
        return M.passage_memory(ingest.content_records(passages(spark, sf)))
    key = spark.sparkContext.applicationId, sf
    if key not in SHARED:
        SHARED[key] = M.passage_memory(ingest.content_records(passages(spark, sf)))
    return SHARED[key]


@query(f"WITH {duck.GRAPH} SELECT a, b FROM links")
def g1_links(spark, sf):
    return memory(spark, sf).links.select("a", "b")


@query(f"WITH {duck.GRAPH} SELECT node_id, label, degree, fdeg, level_rank FROM nodes")
def g5_nodes(spark, sf):
    n = memory(spark, sf).nodes
    return n.select("node_id", "label", "degree", "fdeg", "level_rank")


@query("""WITH c AS (SELECT DISTINCT o_custkey AS owner, o_custkey % 50 + 1 AS target FROM orders), e AS (SELECT 'F_' || owner AS x, 'F_' || target AS y FROM c WHERE owner IN (SELECT c_custkey FROM customer) AND target IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'F_' || c_custkey, 'D_' || c_mktsegment FROM customer)
SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM e WHERE x <> y""")
def g2_context_links(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.array("c_mktsegment").alias("data"))
    ctx = read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("owner"), (F.col("o_custkey") % 50 + 1).cast("string").alias("target")).distinct()
    return M.typed_links(c, ctx).select("a", "b")


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), d AS (SELECT p, count(*) AS n FROM s GROUP BY 1),
seeds AS (SELECT s_suppkey AS s FROM supplier WHERE s_nationkey < 5), n AS (SELECT DISTINCT a.s AS seed, b.s AS id FROM s a JOIN d USING (p) JOIN s b USING (p) WHERE n <= 25 AND a.s IN (SELECT s FROM seeds) AND b.s NOT IN (SELECT s FROM seeds))
SELECT seed::VARCHAR AS seed, id::VARCHAR AS id FROM n QUALIFY row_number() OVER (PARTITION BY seed ORDER BY 'F_' || id) <= 200""")
def g9_neighbourhood(spark, sf):
    s = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("id")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("data"))
    seeds = read(spark, sf, "supplier").filter("s_nationkey < 5").select(F.col("s_suppkey").cast("string").alias("id"))
    return M.neighbourhood(M.typed_links(s), seeds)


@query(f"WITH {duck.INDEX} SELECT term, node_id, tf FROM postings")
def i1_postings(spark, sf):
    return memory(spark, sf).postings.select("term", "node_id", "tf")


@query(f"WITH {duck.INDEX} SELECT term, node_id, sum(tf) AS tf FROM (SELECT {duck.stem('p.term')} AS term, node_id, tf FROM postings p) GROUP BY 1, 2")
def i2_stem_postings(spark, sf):
    return M.stem_postings(memory(spark, sf).postings)


@query(f"WITH {duck.INDEX} SELECT n_all, round(avg_len, 6) AS avg_len, (SELECT count(*) FROM vocab) AS vocabulary, (SELECT max(df) FROM vocab) AS top_df FROM stats")
def i3_statistics(spark, sf):
    m = memory(spark, sf)
    v = M.vocabulary_of(m).agg(F.count("*").alias("vocabulary"), F.max("df").alias("top_df"))
    return m.lengths.agg(F.count("*").alias("n_all"), F.round(F.avg("len"), 6).alias("avg_len")).join(v)  # one row by one row


@query(f"WITH {duck.INDEX} SELECT gram, count(*) AS terms FROM (SELECT unnest({duck.grams('term')}) AS gram FROM vocab) GROUP BY 1")
def i5_gram_index(spark, sf):
    return M.vocabulary_grams(M.vocabulary_of(memory(spark, sf))).groupBy("gram").agg(F.count("*").alias("terms"))


# retrieval ------------------------------------------------------------------------------------------------------------


def questions(spark, sf):
    w = F.slice(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), 1, 5)
    b = read(spark, sf, "benchmark").select("item_id", w.alias("w"))
    kinds = F.array(joined("w"), joined(F.transform("w", T.typo)), F.lit("zzxqq"))
    return b.select("item_id", F.posexplode(kinds).alias("v", "q")).select((F.col("item_id") * 3 + F.col("v")).alias("query_id"), "q")


@query(f"WITH {duck.INDEX}, {duck.QUERIES}, s AS ({duck.bm25('postings', 'qd')}), r AS (SELECT query_id, node_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, node_id) AS rank FROM s) SELECT query_id, rank, node_id, score FROM r WHERE rank <= 10")
def r1_bm25(spark, sf):
    m = memory(spark, sf)
    terms = R.query_terms(questions(spark, sf)).select("query_id", "term").distinct().withColumn("weight", F.lit(1.0))
    s = R.bm25(m.postings, m.lengths, terms, k=10, places=6).withColumn("score", F.round("score", 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return s.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 10").select("query_id", "rank", "node_id", "score")


@query(f"""WITH {duck.INDEX}, {duck.QUERIES}, asked AS (SELECT DISTINCT term AS word FROM qd), ag AS (SELECT word, unnest({duck.grams('word')}) AS gram FROM asked), vg AS (SELECT term, unnest({duck.grams('term')}) AS gram FROM vocab),
sims AS (SELECT word, vg.term, count(*) / (len({duck.grams('word')}) + len({duck.grams('vg.term')}) - count(*)) AS sim FROM ag JOIN vg USING (gram) GROUP BY 1, 2)
SELECT word, term, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY sim DESC, term) AS rank FROM sims WHERE sim >= 0.4) WHERE rank <= 3""")
def r5_similar_terms(spark, sf):
    m = memory(spark, sf)
    words = R.query_terms(questions(spark, sf)).select(F.col("term").alias("word"))
    return R.similar_terms(M.vocabulary_of(m), words).select("word", "term", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {duck.GRAPH} SELECT node_id, degree FROM nodes WHERE level_rank = 0 ORDER BY degree DESC, node_id LIMIT 10")
def r6_hubs(spark, sf):
    return R.hubs(memory(spark, sf).nodes, 10).select("node_id", "degree")


@query(f"""WITH {duck.CASCADE}
SELECT h.query_id, v.stage, v.stage <> 'hub' AS matched, (v.stage = 'hub' OR v.coverage < 0.5) AS handoff, round(v.coverage, 6) AS coverage,
round(CASE v.stage WHEN 'exact' THEN 1.0 WHEN 'substring' THEN 0.8 WHEN 'stem' THEN 0.75 WHEN 'fuzzy' THEN 0.5 ELSE 0.05 END * (0.5 + 0.5 * v.coverage), 6) AS confidence,
h.rank, h.node_id AS id, round(h.score / greatest(max(h.score) OVER (PARTITION BY h.query_id), 1e-9), 6) AS score FROM hits h JOIN verdict v USING (query_id)""")
def r7_cascade(spark, sf):
    d = R.cascade(memory(spark, sf), checkpointed(questions(spark, sf)), checkpoint=checkpointed)
    return d.withColumn("rank", F.col("rank").cast("long"))


VECTORS_SQL = "v AS (SELECT vec_id AS node_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS vec FROM embeddings)"


def vectors(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vec"), "label")


@query(f"WITH {VECTORS_SQL} SELECT query_id, rank, node_id, round(sim, 6) AS sim FROM (SELECT q.node_id AS query_id, v.node_id, round(list_dot_product(q.vec, v.vec), 9) AS sim, row_number() OVER (PARTITION BY q.node_id ORDER BY round(list_dot_product(q.vec, v.vec), 9) DESC, v.node_id) AS rank FROM v q CROSS JOIN v) WHERE rank <= 10")
def r11_dense_top(spark, sf):
    v = vectors(spark, sf)
    return R.dense_top(v, v.select(F.col("node_id").alias("query_id"), "vec"), 10).select("query_id", F.col("rank").cast("long").alias("rank"), "node_id", F.round("sim", 6).alias("sim"))


@query("""WITH a AS (SELECT l_orderkey % 100 AS query_id, l_partkey AS node_id, row_number() OVER (PARTITION BY l_orderkey % 100 ORDER BY max(l_extendedprice) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1, 2),
b AS (SELECT l_orderkey % 100 AS query_id, l_partkey AS node_id, row_number() OVER (PARTITION BY l_orderkey % 100 ORDER BY sum(l_quantity) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1, 2),
f AS (SELECT query_id, node_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM a WHERE rank <= 50 UNION ALL SELECT * FROM b WHERE rank <= 50) GROUP BY 1, 2)
SELECT query_id, rank, node_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM f) WHERE rank <= 20""")
def r12_rank_fusion(spark, sf):
    g = read(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("query_id"), F.col("l_partkey").alias("node_id")).agg(F.max("l_extendedprice").alias("p"), F.sum("l_quantity").alias("q"))
    w = lambda c: Window.partitionBy("query_id").orderBy(F.desc(c), "node_id")
    rankings = [g.withColumn("rank", F.row_number().over(w(c))).select("query_id", "rank", "node_id") for c in ("p", "q")]
    return R.rrf(rankings, 20).select("query_id", F.col("rank").cast("long").alias("rank"), "node_id", "score")


@query("""WITH l AS (SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, '- ' || o_orderkey || ': ' || o_orderpriority || chr(10) AS line FROM orders),
u AS (SELECT *, sum(strlen(line)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM l) SELECT query_id, coalesce(string_agg(line, '' ORDER BY rank) FILTER (used <= 60), '') AS context FROM u GROUP BY 1""")
def r19_context(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    h = read(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.row_number().over(w).alias("rank"), F.col("o_orderkey").cast("string").alias("label"), F.col("o_orderpriority").alias("text"))
    return R.context(h, 60)


@query(f"WITH {duck.GRAPH}, sized AS (SELECT 'x' AS k) SELECT count(*) FILTER (level_rank = 0) AS functions, count(*) AS nodes, (SELECT count(*) FROM links) AS edges, count(*) FILTER (degree = 0) AS isolated, min(degree) FILTER (level_rank = 0) AS min_links, round(2 * (SELECT count(*) FROM links) / count(*), 6) AS avg_degree FROM nodes")
def q4_density_report(spark, sf):
    from mnemix.operators import density

    return density.report(memory(spark, sf))


@query(f"""WITH {duck.INDEX}, t AS (SELECT DISTINCT node_id, term FROM postings WHERE starts_with(node_id, 'F_') AND NOT regexp_matches(term, '^[0-9]+$'))
SELECT node_id, term, df FROM (SELECT node_id, t.term, df, row_number() OVER (PARTITION BY node_id ORDER BY df, t.term) AS rn FROM t JOIN vocab USING (term)) WHERE rn = 1""")
def q1_probe_terms(spark, sf):
    from mnemix.operators import density

    return density.probe_terms(memory(spark, sf))


# experience -----------------------------------------------------------------------------------------------------------


NEAR_SQL = f"""{VECTORS_SQL}, c AS (SELECT node_id AS seq, vec, label FROM v JOIN embeddings ON vec_id = node_id),
near AS (SELECT * FROM (SELECT p.seq AS probe, p.label AS truth, c.seq, c.label, round(list_dot_product(p.vec, c.vec), 9) AS sim, row_number() OVER (PARTITION BY p.seq ORDER BY round(list_dot_product(p.vec, c.vec), 9) DESC, c.seq) AS rank FROM c p JOIN c ON p.seq <> c.seq) WHERE rank <= 32)"""


def cases(spark, sf):
    return vectors(spark, sf).withColumnRenamed("node_id", "seq")


@query(f"WITH {NEAR_SQL}, w AS (SELECT probe, label, sum(exp((sim - top) / 0.2)) AS w FROM (SELECT *, max(sim) OVER (PARTITION BY probe) AS top FROM near WHERE rank <= 8) GROUP BY 1, 2) SELECT probe, label, round(w / sum(w) OVER (PARTITION BY probe), 6) AS p FROM w")
def e2_distribution(spark, sf):
    c = cases(spark, sf)
    return E.distribution(E.neighbours(c, c), 8, 0.2)


@query(f"WITH {NEAR_SQL}, g AS (SELECT probe, truth, label, count(*) AS n FROM near WHERE rank <= 8 GROUP BY 1, 2, 3), b AS (SELECT probe, truth, label FROM g QUALIFY row_number() OVER (PARTITION BY probe ORDER BY n DESC, label) = 1) SELECT round(avg((label = truth)::INT), 6) AS accuracy FROM b")
def e5_loo_accuracy(spark, sf):
    c = cases(spark, sf)
    return E.loo_vote_accuracy(E.neighbours(c, c), 8)


@query(f"""WITH {NEAR_SQL}, grid AS (SELECT k, t FROM (VALUES (1), (2), (4), (8), (16), (32)) a(k), (VALUES (0.02::DOUBLE), (0.05), (0.1), (0.2), (1.0)) b(t)),
g AS (SELECT k, t, probe, truth, label, round(sum(exp((sim - top) / t)), 9) AS w FROM (SELECT *, max(sim) OVER (PARTITION BY probe) AS top FROM near) JOIN grid ON rank <= k GROUP BY ALL),
b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY k, t, probe ORDER BY w DESC, label) = 1) SELECT k, t AS temperature, round(avg((label = truth)::INT), 6) AS accuracy FROM b GROUP BY 1, 2""")
def e6_loo_grid(spark, sf):
    c = cases(spark, sf)
    return E.grid_accuracy(E.neighbours(c, c)).select("k", "temperature", "accuracy")


# decisions ------------------------------------------------------------------------------------------------------------


def logits(spark, sf):
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("option"), (F.col("l_quantity") / 10).alias("logit")).groupBy("query_id", "option").agg(F.max("logit").alias("logit"))


PROBS_SQL = "l AS (SELECT l_orderkey AS query_id, l_linenumber AS option, max(l_quantity / 10) AS logit FROM lineitem GROUP BY 1, 2), probs AS (SELECT query_id, option, exp((logit - m) / 1.5) / sum(exp((logit - m) / 1.5)) OVER (PARTITION BY query_id) AS p FROM (SELECT *, max(logit) OVER (PARTITION BY query_id) AS m FROM l))"


@query(f"WITH {PROBS_SQL} SELECT query_id, option, round(p, 6) AS p FROM probs")
def x5_softmax(spark, sf):
    return D.softmax(logits(spark, sf), 1.5).select("query_id", "option", F.round("p", 6).alias("p"))


@query(f"WITH {PROBS_SQL} SELECT query_id, round(CASE WHEN count(*) < 2 THEN 1.0 ELSE least(greatest(1 + sum(p * ln(p)) / ln(count(*)), 0), 1) END, 6) AS confidence FROM probs GROUP BY 1")
def x6_entropy_confidence(spark, sf):
    return D.entropy_confidence(D.softmax(logits(spark, sf), 1.5)).select("query_id", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {PROBS_SQL} SELECT query_id, arg_max(option, (round(p, 9), option)) AS answer, round(sum(option * p), 6) AS score FROM probs GROUP BY 1")
def x7_decode(spark, sf):
    p = D.softmax(logits(spark, sf), 1.5).withColumn("p", F.round("p", 9))
    exact = D.softmax(logits(spark, sf), 1.5)
    return D.decode_choice(p).join(D.decode_score(exact), "query_id").select("query_id", "answer", F.round("score", 6).alias("score"))


@query(f"""WITH {PROBS_SQL}, m AS (SELECT query_id, option, 1.0 / option AS pm FROM probs), d AS (SELECT p.*, pm, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, option) AS rn FROM probs p JOIN m USING (query_id, option)),
g AS (SELECT *, max(p) FILTER (rn = 1) OVER w - coalesce(max(p) FILTER (rn = 2) OVER w, 0) AS gap, exp(ln(greatest(p, 1e-12)) + 2 * ln(pm + 1e-3)) AS raw FROM d WINDOW w AS (PARTITION BY query_id))
SELECT query_id, option, round(CASE WHEN gap < 0.5 THEN raw / sum(raw) OVER (PARTITION BY query_id) ELSE p END, 6) AS p FROM g""")
def x11_pooled(spark, sf):
    p = D.softmax(logits(spark, sf), 1.5)
    return D.pooled(p, p.select("query_id", "option", (1.0 / F.col("option")).alias("p"))).select("query_id", "option", F.round("p", 6).alias("p"))


@query("""WITH n AS (SELECT l_suppkey AS query_id, l_partkey AS option, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) - 1 AS place, count(*) OVER (PARTITION BY l_suppkey) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem))
SELECT query_id, option, floor(place::DOUBLE / ceil(n::DOUBLE / ceil(n::DOUBLE / 16)))::INT AS "group" FROM n""")
def x9_tournament_groups(spark, sf):
    o = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("option")).distinct()
    return D.tournament_groups(o).select("query_id", "option", "group")


@query(f"WITH {PROBS_SQL}, b AS (SELECT query_id, max(round(p, 9)) AS p FROM probs GROUP BY 1), s AS (SELECT l_orderkey AS query_id, max(l_discount * 10) AS top FROM lineitem GROUP BY 1) SELECT query_id, (top < 0.4 OR p < 0.5) AS out_of_scope FROM b JOIN s USING (query_id)")
def x15_out_of_scope(spark, sf):
    p = D.decode_choice(D.softmax(logits(spark, sf), 1.5).withColumn("p", F.round("p", 9)))
    sims = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_discount") * 10).alias("sim"))
    return D.out_of_scope(p, sims, 0.4, 0.5).select("query_id", "out_of_scope")


# evaluation -----------------------------------------------------------------------------------------------------------


WILSON = "(k / n + 1.96 * 1.96 / (2 * n) {s} 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)"


@query(f"WITH g AS (SELECT l_shipdate::DATE AS day, count(*)::DOUBLE AS n, (count(*) FILTER (l_returnflag = 'R'))::DOUBLE AS k FROM lineitem GROUP BY 1) SELECT day, n::BIGINT AS n, k::BIGINT AS k, round({WILSON.format(s='-')}, 4) AS lo, round({WILSON.format(s='+')}, 4) AS hi FROM g")
def a1_wilson(spark, sf):
    return A.wilson_table(read(spark, sf, "lineitem").withColumn("day", F.to_date("l_shipdate")), "day", F.col("l_returnflag") == "R")


PAIRED = '''c AS (SELECT l_suppkey, count(*) FILTER (l_discount > 0.05 AND l_tax > 0.04) AS "both", count(*) FILTER (l_discount > 0.05 AND NOT l_tax > 0.04) AS a_only, count(*) FILTER (l_tax > 0.04 AND NOT l_discount > 0.05) AS b_only, count(*) FILTER (NOT l_tax > 0.04 AND NOT l_discount > 0.05) AS neither FROM lineitem GROUP BY 1)'''


def paired(spark, sf):
    return A.paired_counts(read(spark, sf, "lineitem"), F.col("l_discount") > 0.05, F.col("l_tax") > 0.04, "l_suppkey")


@query(f"""WITH {PAIRED} SELECT l_suppkey, a_only, b_only, CASE WHEN a_only + b_only = 0 THEN 1.0 ELSE round(least(1.0, 2 * list_sum(list_transform(range(0, least(a_only, b_only) + 1), lambda i: exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2.0))))), 6) END AS p FROM c""")
def a2_mcnemar(spark, sf):
    return A.mcnemar(paired(spark, sf)).select("l_suppkey", "a_only", "b_only", "p")


def _w(k, s):
    return f"(({k}) / n + 1.96 * 1.96 / (2 * n) {s} 1.96 * sqrt(({k}) / n * (1 - ({k}) / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)"


@query(f"""WITH {PAIRED}, d AS (SELECT l_suppkey, "both"::DOUBLE AS a, a_only::DOUBLE AS b, b_only::DOUBLE AS c, neither::DOUBLE AS d, ("both" + a_only + b_only + neither)::DOUBLE AS n FROM c),
e AS (SELECT *, (a + b) / n AS p1, (a + c) / n AS p2, {_w('a + b', '-')} AS l1, {_w('a + b', '+')} AS u1, {_w('a + c', '-')} AS l2, {_w('a + c', '+')} AS u2, CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) > 0 THEN (a * d - b * c) / sqrt((a + b) * (c + d) * (a + c) * (b + d)) ELSE 0 END AS phi FROM d)
SELECT l_suppkey, round(p1 - p2, 4) AS diff, round(greatest(-1.0, p1 - p2 - sqrt(greatest(0, (p1 - l1) ** 2 - 2 * phi * (p1 - l1) * (u2 - p2) + (u2 - p2) ** 2))), 4) AS lo, round(least(1.0, p1 - p2 + sqrt(greatest(0, (u1 - p1) ** 2 - 2 * phi * (u1 - p1) * (p2 - l2) + (p2 - l2) ** 2))), 4) AS hi FROM e""")
def a4_newcombe(spark, sf):
    return A.newcombe(paired(spark, sf)).select("l_suppkey", "diff", "lo", "hi")


@query("WITH b AS (SELECT ceil(round(l_discount * 10 * 15, 9)) AS bin, count(*) AS n, avg(l_discount * 10) AS c, avg((l_returnflag = 'R')::INT) AS y FROM lineitem WHERE l_discount * 10 > 0 GROUP BY 1) SELECT round(sum(n * abs(y - c)) / (SELECT count(*) FROM lineitem), 6) AS ece FROM b")
def a5_ece(spark, sf):
    return A.ece(read(spark, sf, "lineitem"), F.col("l_discount") * 10, F.col("l_returnflag") == "R")


@query("WITH r AS (SELECT l_returnflag = 'R' AS y, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r FROM lineitem) SELECT round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auroc FROM r")
def a7_auroc(spark, sf):
    return A.auroc(read(spark, sf, "lineitem"), F.col("l_quantity"), F.col("l_returnflag") == "R")


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def a9_latency(spark, sf):
    return A.latency(read(spark, sf, "events"), "value", "event_type")


@query("""WITH g AS (SELECT p_name, l_suppkey, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT p_name AS mention, l_suppkey AS target, n, round(n / a, 6) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY p_name) AS a, row_number() OVER (PARTITION BY p_name ORDER BY n DESC, l_suppkey) AS rn FROM g) WHERE rn = 1""")
def a10_alias_prior(spark, sf):
    d = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return A.alias_prior(d, "p_name", "l_suppkey")


@query("""WITH c AS (SELECT l_orderkey AS query_id, l_linenumber AS cand, max(l_discount * 10) AS share, max(l_tax * 10 + 0.01) AS p FROM lineitem GROUP BY 1, 2),
s AS (SELECT query_id, cand, CASE WHEN max(share) OVER (PARTITION BY query_id) >= 0.9 THEN share ELSE ln(greatest(p, 1e-12)) + 0.5 * ln(share + 0.01) END AS s FROM c)
SELECT query_id, cand FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, cand) = 1""")
def a11_prior_times_context(spark, sf):
    c = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("cand")).agg(F.max(F.col("l_discount") * 10).alias("share"), F.max(F.col("l_tax") * 10 + 0.01).alias("p"))
    return A.prior_times_context(c.withColumn("place", F.col("cand")), 0.9, 0.5)


@query("""WITH g AS (SELECT o_custkey % 40 AS query_id, o_orderkey % 500 AS item, max(o_totalprice) AS p, min(o_orderdate) AS d FROM orders GROUP BY 1, 2),
u AS (SELECT query_id, item, 2 * row_number() OVER (PARTITION BY query_id ORDER BY p DESC, item) AS o FROM g UNION ALL SELECT query_id, item, 2 * row_number() OVER (PARTITION BY query_id ORDER BY d, item) + 1 FROM g),
m AS (SELECT query_id, item, min(o) AS o FROM u WHERE item <> query_id GROUP BY 1, 2)
SELECT query_id, rank, item FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o, item) AS rank FROM m) WHERE rank <= 20""")
def a14_interleave(spark, sf):
    g = read(spark, sf, "orders").groupBy((F.col("o_custkey") % 40).alias("query_id"), (F.col("o_orderkey") % 500).alias("item")).agg(F.max("o_totalprice").alias("p"), F.min("o_orderdate").alias("d"))
    rank = lambda *o: g.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*o)))
    gold = g.select("query_id", F.col("query_id").alias("item")).distinct()
    return A.interleave(rank(F.desc("p"), "item"), rank("d", "item"), gold, 20).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT count(*) AS n, sha256(string_agg(c_custkey::VARCHAR, chr(10) ORDER BY encode(c_custkey::VARCHAR))) AS digest FROM customer")
def a19_id_digest(spark, sf):
    return A.id_set_digest(read(spark, sf, "customer"), "c_custkey")


@query("SELECT doc_id, bool_or(source = 'src0') OVER (PARTITION BY md5(lower(text))) AS out FROM documents")
def a23_duplicate_exclusion(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "text", "source")
    return A.exclude_with_duplicates(d, F.md5(F.lower("text")), F.col("source") == "src0").select("doc_id", "out")


@query("SELECT count(*) FILTER (l_returnflag <> 'R') AS in_scope, count(*) FILTER (l_returnflag = 'R') AS oos, round(count(*) FILTER (l_returnflag = 'R' AND l_discount > 0.05) / count(*) FILTER (l_returnflag = 'R'), 6) AS recall, round(count(*) FILTER (l_returnflag = 'R' AND l_discount > 0.05) / count(*) FILTER (l_discount > 0.05), 6) AS precision FROM lineitem")
def a24_label_slices(spark, sf):
    oos, flag = F.col("l_returnflag") == "R", F.col("l_discount") > 0.05
    return read(spark, sf, "lineitem").agg(F.count_if(~oos).alias("in_scope"), F.count_if(oos).alias("oos"), F.round(F.count_if(oos & flag) / F.count_if(oos), 6).alias("recall"), F.round(F.count_if(oos & flag) / F.count_if(flag), 6).alias("precision"))


@query("WITH g AS (SELECT o_custkey, avg((o_orderstatus = 'O')::INT) AS acc FROM orders GROUP BY 1) SELECT count(*) AS groups, round(avg(acc), 6) AS macro, round(min(acc), 6) AS worst FROM g")
def a25_macro_accuracy(spark, sf):
    return A.macro_accuracy(read(spark, sf, "orders"), "o_custkey", F.col("o_orderstatus") == "O")


# more of the graph, the memory and the decisions ------------------------------------------------------------------------


@query()
def l1_communities(spark, sf):
    from mnemix.operators import topology

    e = read(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("d"), F.date_format("l_shipdate", "yyyyMM"), F.lit("_"), (F.col("l_suppkey") % 7).cast("string")).alias("b")).distinct()
    return topology.communities(running(e, ["a", "b"], F.lit(1).cast("long"), "seq").select("a", "b", "seq"))


@query("""WITH e AS (SELECT o_custkey % 10 AS ca, o_custkey % 3 AS cb FROM orders), t AS (SELECT c, count(*) AS t FROM (SELECT ca AS c FROM e UNION ALL SELECT cb FROM e) GROUP BY 1), i AS (SELECT ca AS c, count(*) AS i FROM e WHERE ca = cb GROUP BY 1)
SELECT round(sum(coalesce(i, 0) / (SELECT count(*) FROM e)::DOUBLE - (t / (2.0 * (SELECT count(*) FROM e))) ** 2), 6) AS modularity FROM t LEFT JOIN i USING (c)""")
def l3_modularity(spark, sf):
    from mnemix.operators import topology

    e = read(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("o"), "o_orderkey").alias("b"), "o_custkey")
    parts = e.select(F.col("a").alias("node"), (F.col("o_custkey") % 10).alias("community")).distinct().unionByName(e.select(F.col("b").alias("node"), (F.col("o_custkey") % 3).alias("community")))
    return topology.modularity(e.select("a", "b"), parts)


@query(f"WITH {duck.PASSAGES}, t AS (SELECT id, unnest({duck.terms("id || ' Passage ' || text")}) AS w FROM records), s AS (SELECT id, {duck.stem('t.w')} AS stem FROM t) SELECT id, stem, count(*) AS tf FROM s WHERE NOT regexp_matches(stem, '^[0-9]+$') GROUP BY 1, 2")
def i6_body_stems(spark, sf):
    from mnemix.operators import density

    return density.body_stems(memory(spark, sf).records)


@query(f"""WITH {NEAR_SQL}, w AS (SELECT probe, truth, label, round(sum(exp((sim - top) / 0.2)), 9) AS w FROM (SELECT *, max(sim) OVER (PARTITION BY probe) AS top FROM near WHERE rank <= 8) GROUP BY 1, 2, 3),
b AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY probe ORDER BY w DESC, label DESC) = 1), l AS (SELECT avg((label = truth)::INT) AS loo FROM b), m AS (SELECT max(n) / sum(n) AS maj FROM (SELECT count(*) AS n FROM embeddings GROUP BY label))
SELECT round(least(greatest((loo - maj) / (1 - maj), 0), 1), 6) AS trust FROM l CROSS JOIN m""")
def e4_trust(spark, sf):
    c = cases(spark, sf)
    return E.trust(c, E.neighbours(c, c))


@query(f"""WITH {PROBS_SQL}, grid AS (SELECT exp(ln(0.25) + i * (ln(8.0) - ln(0.25)) / 60) AS t FROM range(0, 61) r(i)), g AS (SELECT t, query_id, sum(pow(p, 1 / t)) AS z, sum(CASE WHEN option = 1 THEN pow(p, 1 / t) ELSE 0 END) AS g FROM probs CROSS JOIN grid GROUP BY 1, 2)
SELECT round(t, 6) AS t, round(-avg(ln(greatest(g / z, 1e-12))), 6) AS nll FROM g GROUP BY g.t ORDER BY 2, 1 LIMIT 1""")
def a6_refit_temperature(spark, sf):
    p = D.softmax(logits(spark, sf), 1.5).withColumn("gold", F.lit(1))
    return A.refit_temperature(p).select("t", F.round("nll", 6).alias("nll"))


@query(f"""WITH {PROBS_SQL}, v AS (SELECT l_orderkey AS query_id, l_linenumber AS option, max(l_quantity)::BIGINT // 10 AS votes FROM lineitem GROUP BY 1, 2), d AS (SELECT *, max(votes) OVER (PARTITION BY query_id) AS top, sum(votes) OVER (PARTITION BY query_id) AS all_ FROM probs JOIN v USING (query_id, option))
SELECT query_id, option, round(CASE WHEN top >= 4 THEN votes / all_ ELSE p END, 6) AS p FROM d""")
def x12_agreement_override(spark, sf):
    v = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("option")).agg(F.floor(F.max("l_quantity") / 10).alias("votes"))
    return D.agreement_override(D.softmax(logits(spark, sf), 1.5), v, 0.7, least=4).select("query_id", "option", F.round("p", 6).alias("p"))


@query("SELECT conv_id, to_json({'context': min(text), 'input': count(*)::VARCHAR}) AS state FROM conversations GROUP BY 1")
def x20_grounded(spark, sf):
    g = read(spark, sf, "conversations").groupBy("conv_id").agg(F.min("text").alias("t"), F.count("*").cast("string").alias("n"))
    return g.select("conv_id", D.grounded(F.col("n"), F.col("t")).alias("state"))


# the rest of the catalogue registers itself
from mnemix.plans import decisions as decisions  # noqa: E402
from mnemix.plans import evaluations as evaluations  # noqa: E402
from mnemix.plans import stores as stores  # noqa: E402
