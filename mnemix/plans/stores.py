"""Registered queries of ingest in every format, the engine, the store, hybrid retrieval and the density guard."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemix.engine import Engine
from mnemix.functions import text as T
from mnemix.operators import density, store, topology
from mnemix.operators import experience as E
from mnemix.operators import memory as M
from mnemix.operators import retrieval as R
from mnemix.operators import scoring as S
from mnemix.plans import duck
from mnemix.plans.decisions import vectors_sql
from mnemix.plans.registry import NEAR_SQL, VECTORS_SQL, cases, memory, query, questions, read, vectors
from mnemix.sources import ingest
from mnemix.sources.tables import checkpointed, saved, shared_dir

BENCH = "SELECT item_id AS doc_id, text, 'bench' AS source FROM benchmark"


def bench_docs(spark, sf):
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("doc_seq"), "text", F.lit("auto").alias("format"), F.lit("bench").alias("source"))


def engine(spark, sf) -> Engine:
    e = Engine(spark, f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}", "bench")
    e.ingest_batch(bench_docs(spark, sf))
    return e


RECORDS = f"WITH {duck.passages_of(BENCH)}"


@query(f"{RECORDS} SELECT id, md5(text) AS digest, 'Passage' AS action FROM records")
def s2_ingest_batch(spark, sf):
    return engine(spark, sf).table("records").select("id", F.md5("text").alias("digest"), "action")


@query(f"{RECORDS} SELECT (SELECT count(*) FROM records) AS records, true AS same")
def s4_snapshot_restore(spark, sf):
    e = engine(spark, sf)
    at = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    e.snapshot(at)
    other = Engine(spark, e.path, "other")
    other.restore(at)
    p = store.parity(e.table("records"), other.table("records"), ["id", "text", "doc_seq"])
    return p.select(F.col("n_b").alias("records"), "same")


@query(f"WITH {duck.INDEX.replace(duck.PASSAGES, duck.passages_of(BENCH))} SELECT (SELECT count(*) FROM records) AS atfs, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM links) AS edges, 0 AS experience, (SELECT count(*) FROM vocab) AS vocabulary, 0 AS after_clear")
def s6_stats_clear(spark, sf):
    e = engine(spark, sf)
    s = e.stats()
    e.clear()
    names = ("atfs", "nodes", "edges", "experience", "vocabulary")
    return spark.createDataFrame([(*[s[n] for n in names], e.table("records").count())], ", ".join(f"{n} long" for n in (*names, "after_clear")))


@query(f"WITH {duck.INDEX.replace(duck.PASSAGES, duck.passages_of(BENCH))} SELECT 1 AS schema_version, (SELECT count(*) FROM records) AS records, (SELECT count(*) FROM records) AS passages, n_all AS nodes, (SELECT count(*) FROM links) AS edges, round(avg_len, 6) AS avg_len FROM stats")
def s10_store_stats(spark, sf):
    e = engine(spark, sf)
    return store.stats(e.memory(), e.table("records"), e.table("experience")).drop("dim")


@query("""SELECT 'C' || c_custkey AS source, 'USES' AS rel, c_mktsegment AS target FROM customer UNION ALL SELECT 'C' || c_custkey, 'GRANTS', 'nation' || c_nationkey FROM customer
UNION ALL SELECT DISTINCT 'C' || o_custkey, 'LINKS', 'C' || (o_custkey % 50 + 1) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) AND o_custkey % 50 + 1 IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'C' || c_custkey, 'MENTIONS', lower(c_mktsegment) FROM customer WHERE c_custkey % 7 = 0""")
def s11_relations(spark, sf):
    name = lambda c: F.concat(F.lit("C"), c.cast("string"))
    c = read(spark, sf, "customer")
    records = c.select(name(F.col("c_custkey")).alias("id"), F.array("c_mktsegment").alias("data"), F.array(F.concat(F.lit("nation"), "c_nationkey")).alias("access"), F.array().cast("array<string>").alias("events"))
    context = read(spark, sf, "orders").select(name(F.col("o_custkey")).alias("owner"), name(F.col("o_custkey") % 50 + 1).alias("target")).distinct()
    concepts = c.filter("c_custkey % 7 = 0").select(name(F.col("c_custkey")).alias("id"), F.lower("c_mktsegment").alias("stem"))
    return store.relations(records, context, concepts)


@query("SELECT 'USES' AS rel, c_mktsegment AS target, count(*) AS df FROM customer GROUP BY 2 UNION ALL SELECT 'GRANTS', 'nation' || c_nationkey, count(*) FROM customer GROUP BY 2")
def g10_shared_frequencies(spark, sf):
    return store.shared_frequencies(s11_relations(spark, sf).filter("rel <> 'MENTIONS'"))


@query("""WITH p AS (SELECT item_id, list_transform(string_split(replace(text, chr(10), '. '), '. '), lambda x, i: CASE WHEN i % 3 = 0 THEN 'Section::::x' WHEN i % 3 = 1 THEN 'BULLET::::- ' || x ELSE x END) AS p FROM benchmark),
k AS (SELECT item_id, list_transform(list_filter(p, lambda x: NOT starts_with(x, 'Section::::')), lambda x: trim(regexp_replace(x, '^BULLET::::-?', ''))) AS p FROM p),
c AS (SELECT item_id, p, list_transform(range(1, len(p) + 1), lambda i: length(array_to_string(p[1:i], ' '))) AS n FROM k)
SELECT item_id, substr(CASE WHEN len(list_filter(n, lambda x: x <= 120)) = 0 THEN p[1] ELSE array_to_string(p[1:len(list_filter(n, lambda x: x <= 120))], ' ') END, 1, 120) AS abstract FROM c""")
def s13_page_prep(spark, sf):
    parts = F.split(F.replace("text", F.lit("\n"), F.lit(". ")), r"\. ")
    marked = F.transform(parts, lambda x, i: F.when(i % 3 == 2, F.lit("Section::::x")).when(i % 3 == 0, F.concat(F.lit("BULLET::::- "), x)).otherwise(x))
    return read(spark, sf, "benchmark").select("item_id", ingest.strip_prefix_page(marked, 120).alias("abstract"))


@query("SELECT count(*) AS n, 4 AS first_written, 0 AS second_written, true AS same FROM customer")
def s15_resumable_load(spark, sf):
    c, at = read(spark, sf, "customer"), f"{shared_dir(spark)}/pool-{uuid.uuid4().hex}"
    first, second = store.load_pool(c, "c_custkey", at, 4), store.load_pool(c, "c_custkey", at, 4)
    p = store.parity(c, spark.read.parquet(at), ["c_custkey", "c_name"])
    return p.select(F.col("n_b").alias("n"), F.lit(len(first)).alias("first_written"), F.lit(len(second)).alias("second_written"), "same")


@query("""WITH p AS (SELECT l_orderkey AS page, l_linenumber AS seq, 'R' AS title, l_returnflag || l_linestatus AS text, row_number() OVER (PARTITION BY l_orderkey ORDER BY NOT starts_with(l_returnflag || l_linestatus, 'R'), l_linenumber) AS rn, l_quantity FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2))
SELECT page, seq, l_quantity::DOUBLE AS v FROM p WHERE rn = 1""")
def s16_page_vectors(spark, sf):
    l = read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s"), F.min("l_quantity").cast("double").alias("q"))
    p = l.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("seq"), F.lit("R").alias("title"), F.concat("f", "s").alias("text"), F.array("q").alias("vec"))
    return store.page_vectors(p).select("page", "seq", F.get("vec", F.lit(0)).alias("v"))


@query("SELECT CASE WHEN c_custkey = 7 THEN 99 ELSE list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(0, length(c_name)), lambda i: ascii(c_name[i + 1])::HUGEINT)), lambda a, x: (xor(a, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) % 16 END::BIGINT AS shard, count(*) AS n FROM customer GROUP BY 1")
def s19_shards(spark, sf):
    c = read(spark, sf, "customer")
    at = {r.c_name: 99 for r in c.filter("c_custkey = 7").select("c_name").collect()}
    return c.select(store.shard(F.col("c_name"), 16, at).alias("shard")).groupBy("shard").agg(F.count("*").alias("n"))


@query("""SELECT 'nation' AS "table", count(*) AS n, 'n_nationkey,n_name' AS columns, sum(('0x' || substr(md5(n_nationkey || '|' || n_name), 1, 8))::BIGINT)::BIGINT AS digest FROM nation
UNION ALL SELECT 'customer', count(*), 'c_custkey,c_mktsegment', sum(('0x' || substr(md5(c_custkey || '|' || c_mktsegment), 1, 8))::BIGINT)::BIGINT FROM customer""")
def s20_manifest(spark, sf):
    return store.manifest(spark, {"nation": read(spark, sf, "nation").select("n_nationkey", "n_name"), "customer": read(spark, sf, "customer").select("c_custkey", "c_mktsegment")})


@query("WITH r AS (SELECT l_suppkey AS query_id, l_partkey AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1, 2) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, id FROM r WHERE id IN (SELECT p_partkey FROM part WHERE p_size < 20)")
def f5_in_pool(spark, sf):
    g = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("q"))
    ranked = g.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("q"), "id")))
    out = store.in_pool(ranked, read(spark, sf, "part").filter("p_size < 20").select(F.col("p_partkey").alias("id")))
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "id")


# formats ---------------------------------------------------------------------------------------------------------------


def tagged(spark, sf):
    s = lambda c: F.col(c).cast("string")
    text = F.concat(
        F.lit("(Component N"), s("s_nationkey"), F.lit(") sells\n\nnothing here\n\nthen (Function F_"), s("s_suppkey"), F.lit(") uses (Data D"), s("s_nationkey"), F.lit(") and (Data A_b) for (Access Role_"), s("s_suppkey"), F.lit(")\n\n(Block B"), s("s_suppkey"), F.lit(") emits (Event E1)\n\nmore of it\n\n(Function F_"), s("s_suppkey"), F.lit(") again (Data Z9)")
    )
    return read(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_seq"), text.alias("text"))


@query("""WITH r AS (SELECT s_suppkey AS k, 'N' || s_nationkey AS n, s_nationkey::VARCHAR AS nk FROM supplier),
t AS (SELECT k, n AS id, '' AS data, '' AS access, '' AS events, n || ' sells nothing here' AS text FROM r
UNION ALL SELECT k, 'F_' || k, array_to_string(list_sort(['D' || nk, 'A_b', n, 'Z9', 'B' || k]), ','), 'Role_' || k, '', 'then F ' || k || ' uses D' || nk || ' and A b for Role ' || k || ' F ' || k || ' again Z9' FROM r
UNION ALL SELECT k, 'B' || k, n, '', 'E1', 'B' || k || ' emits E1 more of it' FROM r) SELECT k, id, data, access, events, text FROM t""")
def d7_tag_records(spark, sf):
    r = ingest.tag_records(tagged(spark, sf))
    j = lambda c: F.array_join(c, ",").alias(c)
    return r.select(F.col("doc_seq").alias("k"), "id", j("data"), j("access"), j("events"), "text")


def mixed(spark, sf):
    """Records that define an id twice, prose with headings around them, look-alike tags, and a heading alone."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("# Notes\n\n# Deep\n\nThis stays (Block 4) prose about it.\n\n## [ID: P"), k, F.lit("]\n**Action:** first\n**Data_Connections:** [b], [a]\n**Events:** e1\nfree one\n## [ID: P"), k, F.lit("]\n**Action:** second\n**Logic:** because\n**Data_Connections:** [c]\n# After\nTail of part "), k, F.lit(".")
    )
    some = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("# Only a heading "), k)).otherwise(text)
    return read(spark, sf, "part").select(F.col("p_partkey").alias("doc_seq"), some.alias("text"), F.lit("auto").alias("format"), F.lit("mix").alias("source"))


@query("""WITH p AS (SELECT p_partkey AS k FROM part) SELECT k, 'P' || k AS id, 'first' AS action, 'a,b,c' AS data, 'e1' AS events, 'first [b], [a] e1 free one second because [c]' AS text FROM p WHERE k % 5 <> 0
UNION ALL SELECT k, 'passage', 'Passage', '', '', 'Deep: This stays (Block 4) prose about it.' FROM p WHERE k % 5 <> 0
UNION ALL SELECT k, 'passage', 'Passage', '', '', '# After' || chr(10) || 'Tail of part ' || k || '.' FROM p WHERE k % 5 <> 0
UNION ALL SELECT k, 'passage', 'Passage', '', '', '# Only a heading ' || k FROM p WHERE k % 5 = 0""")
def d1_mixed_formats(spark, sf):
    r, _ = ingest.parsed(mixed(spark, sf))
    passage = F.col("action") == "Passage"
    data = F.when(passage, F.lit("")).otherwise(F.array_join("data", ","))
    return r.select(F.col("doc_seq").alias("k"), F.when(passage, F.lit("passage")).otherwise(F.col("id")).alias("id"), "action", data.alias("data"), F.array_join("events", ",").alias("events"), F.regexp_replace("text", r"# After[ \n]+", "# After\n").alias("text"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'B / C: body ' || p_partkey || '|plain' WHEN 1 THEN 'A: body ' || p_partkey || '|plain' ELSE 'body ' || p_partkey || '|plain' END AS folded FROM part")
def d4_headings(spark, sf):
    k = F.col("p_partkey").cast("string")
    head = F.when(F.col("p_partkey") % 3 == 0, F.lit("# A\n\n# B\n## C\n\n")).when(F.col("p_partkey") % 3 == 1, F.lit("# A\n\n\n\n")).otherwise(F.lit(""))
    text = F.concat(head, F.lit("body "), k, F.lit("\n\nplain\n\n# dropped"))
    return read(spark, sf, "part").select("p_partkey", F.array_join(ingest.fold_headings(F.split(text, "\n\n")), "|").alias("folded"))


# graph -----------------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT 'F_' || c_custkey AS x, 'D_' || c_mktsegment AS y, c_custkey::VARCHAR AS owner FROM customer UNION ALL SELECT 'F_' || c_custkey, 'K_' || lower(c_mktsegment), c_custkey::VARCHAR FROM customer WHERE c_custkey % 2 = 0),
p AS (SELECT least(x, y) AS a, greatest(x, y) AS b, min(owner) AS owner FROM c GROUP BY 1, 2) SELECT a, b, owner FROM p""")
def g3_concepts_and_owners(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.array("c_mktsegment").alias("data"), "c_mktsegment", "c_custkey")
    concepts = c.filter("c_custkey % 2 = 0").select("id", F.lower("c_mktsegment").alias("stem"))
    return M.typed_links(c.select("id", "data"), concepts=concepts)


@query("""WITH kept AS (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_custkey % 2 = 1), again AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEWSEG' ELSE c_mktsegment END AS seg FROM customer)
SELECT 'D_' || seg AS node_id, count(*) AS degree FROM again GROUP BY 1""")
def g7_orphans(spark, sf):
    """Records defined again with other data: the shared nodes that nothing holds any more are gone."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.array("c_mktsegment").alias("data"), F.lit("").alias("action"), F.lit("").alias("text"), "c_custkey")
    new = c.filter("c_custkey % 3 = 0").withColumn("data", F.array(F.lit("NEWSEG")))
    now = ingest.upsert(c, new).drop("c_custkey")
    m = M.build(now)
    return m.nodes.filter("level = 'data'").select("node_id", "degree")


@query(f"WITH {duck.GRAPH}, q AS (SELECT DISTINCT substr(node_id, 3) AS bare FROM nodes WHERE starts_with(node_id, 'F_')) SELECT n.node_id AS found, count(*) AS n FROM q JOIN nodes n ON n.node_id = 'F_' || q.bare GROUP BY 1")
def f2_exact_id(spark, sf):
    n = checkpointed(memory(spark, sf).nodes.select("node_id"))
    asked = n.filter(F.col("node_id").startswith("F_")).select(F.substr("node_id", F.lit(3)).alias("q"))
    return topology.resolved(n, asked).groupBy(F.col("node_id").alias("found")).agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS a, 'd' || strftime(o_orderdate, '%Y%m%d') AS b FROM orders), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(node, root) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM both_ GROUP BY a UNION SELECT b.a, min(r.root) FROM reach r JOIN both_ b ON b.b = r.node JOIN recurring.reach x ON x.node = b.a WHERE r.root < x.root GROUP BY b.a) SELECT node, root FROM reach""")
def l6_components(spark, sf):
    e = read(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("d"), F.date_format("o_orderdate", "yyyyMMdd")).alias("b"))
    return topology.components(e)


@query("""WITH c AS (SELECT c_custkey::VARCHAR AS id, c_mktsegment AS seg, 'n' || c_nationkey AS nat FROM customer), lk AS (SELECT DISTINCT 'F_' || id AS f, 'D_' || d AS d FROM (SELECT id, seg AS d FROM c UNION ALL SELECT id, nat FROM c)),
bw AS (SELECT f AS a, d AS b FROM lk UNION ALL SELECT d, f FROM lk), nd AS (SELECT a AS node_id, count(*) AS degree, CASE WHEN starts_with(a, 'F_') THEN 0 ELSE 1 END AS level_rank FROM bw GROUP BY 1),
s0 AS (SELECT node_id AS start, node_id, 0 AS depth, 1::BIGINT AS ord FROM nd WHERE starts_with(node_id, 'D_n')),
e1 AS (SELECT start, b AS next, min(ord) AS parent FROM s0 JOIN bw ON a = node_id GROUP BY 1, 2),
s1 AS (SELECT start, next AS node_id, 1 AS depth, 1 + row_number() OVER (PARTITION BY start ORDER BY parent, level_rank, degree DESC, next) AS ord FROM e1 JOIN nd ON nd.node_id = next QUALIFY ord <= 40),
s01 AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1), h AS (SELECT start, max(ord) AS held FROM s01 GROUP BY 1),
e2 AS (SELECT s1.start, b AS next, min(ord) AS parent FROM s1 JOIN bw ON a = node_id WHERE NOT EXISTS (SELECT 1 FROM s01 x WHERE x.start = s1.start AND x.node_id = b) GROUP BY 1, 2),
s2 AS (SELECT start, next AS node_id, 2 AS depth, held + row_number() OVER (PARTITION BY start ORDER BY parent, level_rank, degree DESC, next) AS ord FROM e2 JOIN nd ON nd.node_id = next JOIN h USING (start) QUALIFY ord <= 40)
SELECT * FROM s01 UNION ALL SELECT * FROM s2""")
def l7_traverse(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.array("c_mktsegment", F.concat(F.lit("n"), "c_nationkey")).alias("data"))
    links = checkpointed(M.typed_links(c))
    nodes = checkpointed(M.node_table(c.withColumn("action", F.lit("")).withColumn("text", F.lit("")), links))
    starts = nodes.filter("level = 'data' and node_id like 'D@_n%' escape '@'").select("node_id")
    return topology.traverse(nodes, links, starts, 2, 40)


PARTS = """n AS (SELECT 'F_' || c_custkey AS node_id, c_custkey % 10 AS community, c_custkey FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT 'D_' || n_name, CASE WHEN n_nationkey < 10 THEN n_nationkey ELSE n_nationkey + 90 END, NULL FROM nation),
alln AS (SELECT node_id FROM n UNION ALL SELECT 'F_' || c_custkey FROM customer WHERE c_custkey % 4 = 0),
g AS (SELECT community, count(*) FILTER (starts_with(node_id, 'F_')) AS n, min(substr(node_id, 3)) FILTER (starts_with(node_id, 'F_')) AS one FROM n GROUP BY 1),
named AS (SELECT a.node_id, coalesce(CASE WHEN g.n = 1 THEN 'C - ' || one WHEN g.n = 0 THEN 'C - Data_' || n.community WHEN g.n > 1 THEN 'C - Community_' || n.community END, 'C - ' || substr(a.node_id, 3)) AS block FROM alln a LEFT JOIN n USING (node_id) LEFT JOIN g USING (community))"""


def named_blocks(spark, sf):
    c, n = read(spark, sf, "customer"), read(spark, sf, "nation")
    parts = c.filter("c_custkey % 4 <> 0").select(F.concat(F.lit("F_"), "c_custkey").alias("node"), (F.col("c_custkey") % 10).cast("long").alias("community"))
    parts = parts.unionByName(n.select(F.concat(F.lit("D_"), "n_name").alias("node"), F.when(F.col("n_nationkey") < 10, F.col("n_nationkey")).otherwise(F.col("n_nationkey") + 90).cast("long").alias("community")))
    nodes = c.select(F.concat(F.lit("F_"), "c_custkey").alias("node_id"), (F.col("c_custkey") % 3).alias("level_rank"), (F.col("c_custkey") % 17).alias("degree"), F.lit("function").alias("level"))
    nodes = nodes.unionByName(n.select(F.concat(F.lit("D_"), "n_name").alias("node_id"), F.lit(1).cast("long").alias("level_rank"), F.col("n_nationkey").cast("long").alias("degree"), F.lit("data").alias("level")))
    return checkpointed(nodes), checkpointed(topology.blocks(nodes, parts))


@query(f"WITH {PARTS} SELECT node_id, block FROM named")
def l4_blocks(spark, sf):
    return named_blocks(spark, sf)[1]


@query(f"WITH {PARTS}, q AS (SELECT n_nationkey AS query_id, substr(n_name, 2, 4) AS q FROM nation) SELECT DISTINCT query_id, block FROM named JOIN q ON contains(lower(block), lower(q)) OR contains(lower(node_id), lower(q))")
def r20_search_blocks(spark, sf):
    q = read(spark, sf, "nation").select(F.col("n_nationkey").alias("query_id"), F.substring("n_name", 2, 4).alias("q"))
    return topology.search_blocks(named_blocks(spark, sf)[1], q)


@query(f"""WITH {PARTS}, h AS (SELECT o_custkey % 20 AS query_id, 'F_' || o_custkey AS id, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS rank FROM orders QUALIFY rank <= 5),
lv AS (SELECT 'F_' || c_custkey AS node_id, c_custkey % 3 AS level_rank, c_custkey % 17 AS degree FROM customer UNION ALL SELECT 'D_' || n_name, 1, n_nationkey FROM nation),
m AS (SELECT block, node_id, row_number() OVER (PARTITION BY block ORDER BY level_rank, degree DESC, node_id) AS rn, count(*) OVER (PARTITION BY block) AS size FROM named JOIN lv USING (node_id)),
s AS (SELECT block, any_value(size) AS size, string_agg(node_id, ',' ORDER BY rn) FILTER (rn <= 24) AS members FROM m GROUP BY 1)
SELECT query_id, min(rank) AS ord, block, any_value(members) AS members, any_value(size) AS size FROM h JOIN named ON node_id = id JOIN s USING (block) GROUP BY query_id, block""")
def r15_block_context(spark, sf):
    nodes, named = named_blocks(spark, sf)
    w = Window.partitionBy("query_id").orderBy("o_orderkey")
    o = read(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("query_id"), F.concat(F.lit("F_"), "o_custkey").alias("id"), "o_orderkey")
    hits = o.withColumn("rank", F.row_number().over(w)).filter("rank <= 5")
    return R.block_context(hits, named, nodes).select("query_id", F.col("ord").cast("long").alias("ord"), "block", F.array_join("members", ",").alias("members"), "size")


@query(f"WITH {PARTS} SELECT block, count(*) AS n, bool_and(starts_with(block, 'C - ')) AS component FROM named GROUP BY 1")
def s17_topology_json(spark, sf):
    nodes, named = named_blocks(spark, sf)
    none = F.array().cast("array<string>")
    records = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("action"), F.array("c_mktsegment").alias("data"), none.alias("access"), none.alias("events"))
    j = topology.blocks_json(nodes, named, records).select("block", F.from_json("json", "name string, topology_level string, nodes array<struct<id string>>").alias("j"))
    return j.select("block", F.size("j.nodes").cast("long").alias("n"), (F.col("j.topology_level") == "Component").alias("component"))


# retrieval -------------------------------------------------------------------------------------------------------------


PARTIAL = f"""words AS (SELECT item_id, list_filter({duck.words('text')}, lambda w: length(w) >= 7 AND regexp_matches(w, '^[a-z]+$'))[1] AS w FROM benchmark),
queries AS (SELECT item_id * 2 AS query_id, substr(w, 2, length(w) - 2) AS q FROM words WHERE w IS NOT NULL UNION ALL SELECT item_id * 2 + 1, w || 'ings' FROM words WHERE w IS NOT NULL),
qt AS (SELECT query_id, unnest({duck.terms('q')}) AS term FROM queries),
qd AS (SELECT DISTINCT query_id, term FROM qt)"""

SHOWN = """SELECT h.query_id, v.stage, (v.stage = 'hub' OR v.coverage < 0.5) AS handoff, round(v.coverage, 6) AS coverage, h.rank, h.node_id AS id, round(h.score / greatest(max(h.score) OVER (PARTITION BY h.query_id), 1e-9), 6) AS score FROM hits h JOIN verdict v USING (query_id)"""


@query(f"WITH {duck.cascade(PARTIAL)} {SHOWN}")
def r3_partial_words(spark, sf):
    """Parts of words and inflected words: stages substring and stem."""
    long_ = F.filter(T.split_words(F.col("text")), lambda w: (F.length(w) >= 7) & w.rlike("^[a-z]+$"))
    w = read(spark, sf, "benchmark").select("item_id", F.get(long_, F.lit(0)).alias("w")).filter("w is not null")
    kinds = F.array(F.substr("w", F.lit(2), F.length("w") - 2), F.concat("w", F.lit("ings")))
    q = w.select("item_id", F.posexplode(kinds).alias("v", "q")).select((F.col("item_id") * 2 + F.col("v")).alias("query_id"), "q")
    d = R.cascade(memory(spark, sf), checkpointed(q), checkpoint=checkpointed)
    return d.select("query_id", "stage", "handoff", "coverage", F.col("rank").cast("long").alias("rank"), "id", "score")


def embedded_memory(spark, sf, m):
    """(vectors of the records of memory m, vectors of questions) by the hashing embedder."""
    e = S.HashEmbedder()
    v = m.nodes.filter("level_rank = 0").select("node_id", S.embedded(F.col("text"), e).alias("vec"))
    q = questions(spark, sf).select("query_id", S.embedded(F.col("q"), e).alias("vec"))
    return saved(v, "vectors"), saved(q, "asked")


DENSE = f"""fn AS (SELECT node_id, text FROM nodes WHERE level_rank = 0), {vectors_sql('fn', 'node_id', 'text', 'nv')}, {vectors_sql('queries', 'query_id', 'q', 'qv')},
pairs AS (SELECT query_id, node_id, round(sum(nv.v * qv.v), 9) AS sim FROM nv JOIN qv USING (i) GROUP BY 1, 2),
dense AS (SELECT query_id, node_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, node_id) AS rank FROM pairs QUALIFY rank <= 50)"""


@query(f"""WITH {duck.CASCADE}, {DENSE}, best AS (SELECT query_id, sim AS top_sim FROM dense WHERE rank = 1),
vd AS (SELECT v.query_id, v.coverage, coalesce(top_sim >= 0.35, false) AS dense_ok, top_sim, CASE WHEN v.stage = 'hub' AND coalesce(top_sim >= 0.35, false) THEN 'dense' ELSE v.stage END AS stage FROM verdict v LEFT JOIN best USING (query_id)),
lex AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, level_rank, degree DESC, node_id) AS rank FROM spread JOIN nodes USING (node_id)),
un AS (SELECT query_id, node_id, rank FROM lex WHERE rank <= 50 UNION ALL SELECT query_id, node_id, rank FROM dense WHERE query_id IN (SELECT query_id FROM vd WHERE stage NOT IN ('hub', 'dense'))),
fu AS (SELECT query_id, node_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM un GROUP BY 1, 2),
al AS (SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM fu QUALIFY rank <= 5
  UNION ALL SELECT query_id, node_id, sim, rank FROM dense WHERE rank <= 5 AND query_id IN (SELECT query_id FROM vd WHERE stage = 'dense')
  UNION ALL SELECT query_id, node_id, 0.0, rank FROM (SELECT query_id FROM vd WHERE stage = 'hub') CROSS JOIN (SELECT node_id, row_number() OVER (ORDER BY degree DESC, node_id) AS rank FROM nodes WHERE level_rank = 0 QUALIFY rank <= 5)),
hs AS (SELECT a.query_id, d.sim AS hit_sim FROM al a JOIN dense d ON a.rank = 1 AND d.query_id = a.query_id AND d.node_id = a.node_id)
SELECT a.query_id, v.stage, v.stage = 'hub' OR (v.coverage < 0.5 AND NOT v.dense_ok) OR (v.stage = 'fuzzy' AND coalesce(hs.hit_sim, -1) < 0.35) AS handoff,
round(least(CASE v.stage WHEN 'dense' THEN 0.5 * coalesce(top_sim, 0) ELSE CASE v.stage WHEN 'exact' THEN 1.0 WHEN 'substring' THEN 0.8 WHEN 'stem' THEN 0.75 WHEN 'fuzzy' THEN 0.5 ELSE 0.05 END * (0.5 + 0.5 * greatest(v.coverage, CASE WHEN dense_ok THEN 0.5 ELSE 0 END)) END, 1), 6) AS confidence, a.rank, a.node_id AS id
FROM al a JOIN vd v USING (query_id) LEFT JOIN hs USING (query_id)""")
def r13_hybrid(spark, sf):
    m = memory(spark, sf)
    v, q = embedded_memory(spark, sf, m)
    d = R.hybrid(m, checkpointed(questions(spark, sf)), v, q, fuzzy_requires_dense=True, checkpoint=checkpointed)
    return d.select("query_id", "stage", "handoff", "confidence", F.col("rank").cast("long").alias("rank"), "id")


@query(f"WITH {duck.GRAPH}, {duck.QUERIES}, {DENSE} SELECT query_id, rank, node_id AS id, sim < 0.35 AS weak FROM dense WHERE rank <= 5")
def r18_dense_mode(spark, sf):
    m = memory(spark, sf)
    v, q = embedded_memory(spark, sf, m)
    d = R.hybrid(m, questions(spark, sf), v, q, mode="dense", checkpoint=checkpointed)
    best = Window.partitionBy("query_id")
    d = d.withColumn("top", F.max(F.when(F.col("rank") == 1, F.col("confidence") * 2)).over(best))
    return d.select("query_id", F.col("rank").cast("long").alias("rank"), "id", (F.round(F.col("score") * F.col("top"), 5) < 0.35).alias("weak"))


@query(f"""WITH {duck.INDEX}, {duck.QUERIES}, {DENSE},
asked AS (SELECT DISTINCT term AS word FROM qd), ag AS (SELECT word, unnest({duck.grams('word')}) AS gram FROM asked), vg AS (SELECT term, unnest({duck.grams('term')}) AS gram FROM vocab),
sims AS (SELECT word, vg.term, count(*) / (len({duck.grams('word')}) + len({duck.grams('vg.term')}) - count(*)) AS sim FROM ag JOIN vg USING (gram) GROUP BY 1, 2),
fixed AS (SELECT word, term FROM (SELECT s.word, s.term, row_number() OVER (PARTITION BY s.word ORDER BY sim DESC, df DESC, s.term) AS rn FROM sims s JOIN vocab v ON v.term = s.term WHERE sim >= 0.4) WHERE rn = 1 AND term <> word),
terms_ AS (SELECT query_id, term FROM qd UNION SELECT query_id, f.term FROM qd JOIN fixed f ON f.word = qd.term),
fp AS (SELECT * FROM postings WHERE starts_with(node_id, 'F_')), fl AS (SELECT * FROM lens WHERE starts_with(node_id, 'F_')), fs AS (SELECT count(*) AS n_all, avg(len) AS avg_len FROM fl),
lx AS (SELECT t.query_id, p.node_id, round(sum(ln((n_all - d.df + 0.5) / (d.df + 0.5) + 1) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.len / avg_len))), 9) AS score FROM terms_ t JOIN fp p ON p.term = t.term JOIN (SELECT term, count(*) AS df FROM fp GROUP BY 1) d ON d.term = t.term JOIN fl l ON l.node_id = p.node_id CROSS JOIN fs GROUP BY 1, 2),
lr AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM lx QUALIFY rank <= 50),
fu AS (SELECT query_id, node_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, bool_or(lexical) AS lexical, max(sim) AS dense_sim FROM (SELECT query_id, node_id, rank, true AS lexical, NULL AS sim FROM lr UNION ALL SELECT query_id, node_id, rank, false, sim FROM dense) GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank, node_id AS id, lexical, round(dense_sim, 6) AS dense_sim FROM fu QUALIFY rank <= 5""")
def r21_hybrid_search(spark, sf):
    m = memory(spark, sf)
    v, q = embedded_memory(spark, sf, m)
    d = R.hybrid_search(m, questions(spark, sf), v, q)
    return d.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "lexical", F.round("dense_sim", 6).alias("dense_sim"))


@query(f"""WITH {duck.INDEX}, {duck.QUERIES}, asked AS (SELECT DISTINCT term AS word FROM qd), ag AS (SELECT word, unnest({duck.grams('word')}) AS gram FROM asked), vg AS (SELECT term, unnest({duck.grams('term')}) AS gram FROM vocab),
sims AS (SELECT word, vg.term, count(*) / (len({duck.grams('word')}) + len({duck.grams('vg.term')}) - count(*)) AS sim FROM ag JOIN vg USING (gram) GROUP BY 1, 2)
SELECT word, term, round(sim, 6) AS sim FROM (SELECT s.word, s.term, sim, row_number() OVER (PARTITION BY s.word ORDER BY sim DESC, df DESC, s.term) AS rn FROM sims s JOIN vocab v ON v.term = s.term WHERE sim >= 0.4) WHERE rn = 1 AND term <> word""")
def r22_term_correction(spark, sf):
    m = memory(spark, sf)
    words = R.query_terms(questions(spark, sf)).select(F.col("term").alias("word"))
    return R.corrected_terms(M.vocabulary_of(m), words).select("word", "term", F.round("sim", 6).alias("sim"))


@query(f"WITH {VECTORS_SQL} SELECT query_id, rank, node_id, round(sim, 6) AS sim FROM (SELECT q.node_id AS query_id, v.node_id, round(list_dot_product(q.vec, v.vec), 9) AS sim, row_number() OVER (PARTITION BY q.node_id ORDER BY round(list_dot_product(q.vec, v.vec), 9) DESC, v.node_id) AS rank FROM v q CROSS JOIN v WHERE q.node_id % 5 = 0) WHERE rank <= 10")
def r23_cell_index(spark, sf):
    """An inverted file probed in all of its cells, which is exact search."""
    v = vectors(spark, sf)
    index = R.cell_index(v.select("node_id", "vec"), 12)
    q = v.filter("node_id % 5 = 0").select(F.col("node_id").alias("query_id"), "vec")
    return R.cell_search(index, q, 10, probes=12).select("query_id", F.col("rank").cast("long").alias("rank"), "node_id", F.round("sim", 6).alias("sim"))


@query("SELECT * FROM (VALUES (1, true), (3, true), (12, true)) t(probes, no_worse)")
def r24_recall_sweep(spark, sf):
    """Recall against exact search rises with the cells probed, to 1."""
    v = vectors(spark, sf)
    index = R.cell_index(v.select("node_id", "vec"), 12)
    q = v.filter("node_id % 5 = 0").select(F.col("node_id").alias("query_id"), "vec")
    truth, last, rows = saved(R.dense_top(v, q, 10), "truth"), 0.0, []
    for probes in (1, 3, 12):
        r = R.recall_at(R.cell_search(index, q, 10, probes), truth, 10).first().recall
        rows.append((probes, r >= last and (probes < 12 or r == 1.0)))
        last = r
    return spark.createDataFrame(rows, "probes int, no_worse boolean")


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM documents), p AS (SELECT term, doc_id, count(*)::DOUBLE AS tf FROM t GROUP BY 1, 2), l AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS len FROM documents d LEFT JOIN p USING (doc_id) GROUP BY 1), s AS (SELECT count(*) AS n_all, avg(len) AS avg_len FROM l),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(substr(text, 1, 60)), '[a-z0-9]+')) AS term FROM benchmark),
b AS (SELECT query_id, p.doc_id, sum(ln((n_all - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS score FROM q JOIN p USING (term) JOIN (SELECT term, count(*) AS df FROM p GROUP BY 1) USING (term) JOIN l ON l.doc_id = p.doc_id CROSS JOIN s GROUP BY 1, 2)
SELECT query_id, rank, doc_id AS node_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b) WHERE rank <= 10""")
def r25_plain_bm25(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "text")
    q = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 60).alias("q"))
    return R.plain_bm25(d, q).select("query_id", F.col("rank").cast("long").alias("rank"), "node_id", F.round("score", 6).alias("score"))


@query("""WITH h AS (SELECT l_suppkey AS query_id, l_partkey AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY max(l_extendedprice) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1, 2),
g AS (SELECT query_id, id % 37 AS page, min(rank) AS first FROM h GROUP BY 1, 2) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY first, page) AS rank, page FROM g QUALIFY rank <= 20""")
def r26_pages(spark, sf):
    l = read(spark, sf, "lineitem")
    g = l.groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("id")).agg(F.max("l_extendedprice").alias("p"))
    hits = g.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("p"), "id")))
    page = l.select(F.col("l_partkey").alias("id"), (F.col("l_partkey") % 37).alias("page")).distinct()
    return R.pages_of(hits, page).select("query_id", F.col("rank").cast("long").alias("rank"), "page")


# density ---------------------------------------------------------------------------------------------------------------


PROBED = f"""pt AS (SELECT DISTINCT node_id, term FROM postings WHERE starts_with(node_id, 'F_') AND NOT regexp_matches(term, '^[0-9]+$')),
pr AS (SELECT node_id, term, df FROM (SELECT node_id, pt.term, df, row_number() OVER (PARTITION BY node_id ORDER BY df, pt.term) AS rn FROM pt JOIN vocab USING (term)) WHERE rn = 1),
ps AS (SELECT node_id, term FROM (SELECT *, row_number() OVER (ORDER BY node_id) - 1 AS pos, count(*) OVER () AS n FROM pr) WHERE pos % greatest(1, n // 400) = 0 AND df <= 5)"""


@query(f"WITH {duck.INDEX}, {PROBED} SELECT node_id, term FROM ps")
def q2_probe_sample(spark, sf):
    return density.probe_sample(density.probe_terms(memory(spark, sf))).select("node_id", "term")


ASKING = f"""{PROBED}, queries AS (SELECT node_id AS query_id, term AS q FROM ps), qt AS (SELECT query_id, unnest({duck.terms('q')}) AS term FROM queries), qd AS (SELECT DISTINCT query_id, term FROM qt)"""


@query(f"WITH {duck.cascade(ASKING)} SELECT count(*) AS probes, round(avg((EXISTS (SELECT 1 FROM hits h WHERE h.query_id = q.query_id AND h.node_id = q.query_id AND q.query_id NOT IN (SELECT query_id FROM left4)))::INT), 6) AS recall FROM queries q")
def q3_probe_recall(spark, sf):
    return density.probe_recall(memory(spark, sf), checkpoint=checkpointed).select("probes", F.round("recall", 6).alias("recall"))


@query(f"WITH {duck.INDEX} SELECT count(*) FILTER (starts_with(node_id, 'K_')) AS concept_nodes, round(avg(degree) FILTER (level_rank = 0), 6) AS mean_links, (SELECT count(*) FROM vocab) AS vocabulary, count(*) FILTER (level_rank = 0 AND degree = 0) AS isolated_functions, count(*) FILTER (level_rank = 0 AND degree < 2) AS low_functions FROM nodes")
def q4_policy(spark, sf):
    return density.policy(memory(spark, sf))


def densified(needy: str) -> str:
    return f"""bt AS (SELECT id, unnest({duck.terms("id || ' Passage ' || text")}) AS w FROM records), bs AS (SELECT id, stem, count(*) AS tf FROM (SELECT id, {duck.stem('bt.w')} AS stem FROM bt) WHERE NOT regexp_matches(stem, '^[0-9]+$') GROUP BY 1, 2),
sd AS (SELECT stem, count(*) AS df FROM bs GROUP BY 1), nr AS (SELECT count(*) AS n FROM records), needy AS ({needy}),
c AS (SELECT bs.id, bs.stem, n >= 10 AND df / n > 0.5 AS common, df, tf FROM bs JOIN needy USING (id) JOIN sd USING (stem) CROSS JOIN nr),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY common, df <= 1, df, tf DESC, stem) AS rn, bool_or(NOT common) OVER (PARTITION BY id) AS other FROM c)
SELECT id, stem FROM r WHERE rn <= 4 AND (NOT common OR NOT other)"""


FEW = "SELECT substr(node_id, 3) AS id FROM nodes WHERE level_rank = 0 AND degree < 12"
FAILED = "SELECT substr(query_id, 3) AS id FROM (SELECT query_id FROM queries q WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = q.query_id AND h.node_id = q.query_id AND q.query_id NOT IN (SELECT query_id FROM left4)) ORDER BY query_id LIMIT 20)"


@query(f"WITH {duck.cascade(ASKING)}, {densified(f'{FEW} UNION {FAILED}')}")
def q5_densify(spark, sf):
    """The first round: records with fewer than twelve links or a failed probe."""
    m = memory(spark, sf)
    failing = density.failures(density.probed(m, checkpoint=checkpointed))
    return density.densify(m, m.records, spark.createDataFrame([], "id string, stem string"), 1, min_links=12, failing=failing)


@query(f"WITH {duck.INDEX}, {densified(FEW)}")
def q5_concepts(spark, sf):
    """The first round for records with fewer than twelve links, without probes."""
    m = memory(spark, sf)
    return density.densify(m, m.records, spark.createDataFrame([], "id string, stem string"), 1, min_links=12)


# experience --------------------------------------------------------------------------------------------------------------


@query(f"""WITH {NEAR_SQL}, grid AS (SELECT k, t, row_number() OVER (ORDER BY ki, ti) AS cell FROM (VALUES (1, 1), (2, 2), (4, 3), (8, 4), (16, 5), (32, 6)) a(k, ki), (VALUES (0.02::DOUBLE, 1), (0.05, 2), (0.1, 3), (0.2, 4), (1.0, 5)) b(t, ti)),
g AS (SELECT k, t, cell, probe, truth, label, round(sum(exp((sim - top) / t)), 9) AS w FROM (SELECT *, max(sim) OVER (PARTITION BY probe) AS top FROM near) JOIN grid ON rank <= k GROUP BY ALL),
b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY cell, probe ORDER BY w DESC, label) = 1) SELECT k, t AS temperature, round(avg((label = truth)::INT), 6) AS accuracy FROM b GROUP BY k, t, cell ORDER BY 3 DESC, cell LIMIT 1""")
def e6_best_cell(spark, sf):
    c = cases(spark, sf)
    return E.best_cell(E.grid_accuracy(E.neighbours(c, c)))


@query("SELECT DISTINCT i * n // 70 AS seq FROM range(0, 70) r(i), (SELECT count(*) AS n FROM embeddings)")
def e7_probe_places(spark, sf):
    return E.loo_probes(cases(spark, sf), 70).select("seq")


@query(f"""WITH {NEAR_SQL}, v8 AS (SELECT probe, truth, label, count(*) AS n FROM near WHERE rank <= 8 GROUP BY 1, 2, 3), vb AS (SELECT probe, truth, label FROM v8 QUALIFY row_number() OVER (PARTITION BY probe ORDER BY n DESC, label) = 1),
w AS (SELECT probe, truth, label, round(sum(exp((sim - top) / 0.2)), 9) AS w FROM (SELECT *, max(sim) OVER (PARTITION BY probe) AS top FROM near WHERE rank <= 8) GROUP BY 1, 2, 3),
b AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY probe ORDER BY w DESC, label DESC) = 1), l AS (SELECT avg((label = truth)::INT) AS loo FROM b), m AS (SELECT max(n) / sum(n) AS maj FROM (SELECT count(*) AS n FROM embeddings GROUP BY label))
SELECT (SELECT count(*) FROM embeddings) AS size, (SELECT round(avg((label = truth)::INT), 6) FROM vb) AS accuracy, round(least(greatest((loo - maj) / (1 - maj), 0), 1), 6) AS trust, 0 AS after_forget FROM l CROSS JOIN m""")
def e8_learn_and_forget(spark, sf):
    e = Engine(spark, f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}", "cases")
    c = cases(spark, sf).select(F.lit("which").alias("question"), F.col("seq").cast("long").alias("seq"), "vec", "label")
    accuracy = e.learn(c)["which"]
    row = (e.experience_size(), accuracy, e.trust()["which"])
    e.forget()
    return spark.createDataFrame([(*row, e.experience_size())], "size long, accuracy double, trust double, after_forget long")
