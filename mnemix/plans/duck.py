"""DuckDB expressions that the oracle strings are put together from."""

from __future__ import annotations

from mnemix.functions.text import LOADER_STOPWORDS, STEM_EXCEPTIONS, STOPWORDS, SUFFIXES


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def words(x: str) -> str:
    s = f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    for p in (r"(\p{Ll})(\p{Lu})", r"(\p{Lu})(\p{Lu}\p{Ll})", r"([0-9])([^0-9\s])", r"([^0-9\s])([0-9])"):
        s = f"regexp_replace({s}, '{p}', '\\1 \\2', 'g')"
    return f"list_filter(string_split_regex(lower({s}), ' +'), lambda w: w <> '')"


def terms(x: str) -> str:
    return f"list_filter({words(x)}, lambda w: w NOT IN ({quoted(STOPWORDS)}) AND (length(w) > 1 OR regexp_matches(w, '^[0-9]$')))"


def stem(w: str) -> str:
    cases = []
    for suffix, new, least in SUFFIXES:
        cond = f"ends_with({w}, '{suffix}') AND length({w}) - {len(suffix)} + {len(new)} >= {least}"
        if suffix == "es":
            cond += f" AND regexp_matches({w}, '(s|x|z|ch|sh)es$')"
        if suffix == "s":
            cond += f" AND NOT regexp_matches({w}, '(ss|us|is)$')"
        cases.append(f"WHEN {cond} THEN {w}[:-{len(suffix) + 1}] || '{new}'")
    base = f"(CASE WHEN strlen({w}) <= 3 OR strlen({w}) > length({w}) OR {w} IN ({quoted(STEM_EXCEPTIONS)}) THEN {w} || chr(1) {' '.join(cases)} ELSE {w} END)"
    # chr(1) marks what is left alone, so that it keeps a final e
    return f"(SELECT CASE WHEN ends_with(b, chr(1)) THEN b[:-2] WHEN length(b) > 4 AND ends_with(b, 'e') THEN b[:-2] ELSE b END FROM (SELECT {base} AS b))"


def grams(w: str) -> str:
    return f"list_distinct(list_transform(range(1, length({w}) + 1), lambda i: substr('#' || {w} || '#', i, 3)))"


def sentences(x: str) -> str:
    return (
        f"list_filter(list_transform(string_split(regexp_replace({x}, '([。！？]|[.!?\\n](?:\\s|$))', '\\1' || chr(1), 'g'), chr(1)), "
        "lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: regexp_matches(s, '[\\p{L}\\p{N}]'))"
    )


def loader_terms(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({quoted(LOADER_STOPWORDS)}))))"


def typo(w: str) -> str:
    return f"CASE WHEN length({w}) >= 5 THEN substr({w}, 1, length({w}) // 2) || substr({w}, length({w}) // 2 + 2) ELSE {w} END"


CHUNK = (
    "list_reduce(list_transform(ss, lambda s: {'done': []::VARCHAR[], 'cur': s, 'n': 1, 'b': strlen(s)}), lambda a, x: "
    "CASE WHEN a.n > 0 AND (a.n >= 3 OR a.b + x.b > 480) THEN {'done': list_append(a.done, a.cur), 'cur': x.cur, 'n': 1, 'b': x.b} "
    "ELSE {'done': a.done, 'cur': CASE WHEN a.n = 0 THEN x.cur ELSE a.cur || ' ' || x.cur END, 'n': a.n + 1, 'b': a.b + x.b} END, "
    "{'done': []::VARCHAR[], 'cur': '', 'n': 0, 'b': 0::BIGINT})"
)
FNV = "printf('%08x', list_reduce(list_transform(range(0, length(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT), lambda a, x: (xor(a, x) * 435) % 4294967296, 2216829733::BIGINT))"

CAPITAL = "CASE WHEN term[1:1] = 'ß' THEN 'SS' ELSE upper(term[1:1]) END"

PASSAGES = f"""
sents AS (SELECT doc_id, source, {sentences('text')} AS ss FROM documents WHERE text IS NOT NULL),
state AS (SELECT doc_id, source, {CHUNK} AS st FROM sents),
chunked AS (SELECT doc_id, source, CASE WHEN st.n > 0 THEN list_append(st.done, st.cur) ELSE st.done END AS ch FROM state),
placed AS (SELECT doc_id, source, unnest(ch) AS text, generate_subscripts(ch, 1) - 1 AS passage_seq FROM chunked),
hexed AS (SELECT *, hex(encode(text)) AS hx FROM placed),
passages AS (SELECT doc_id, passage_seq, array_to_string({words('source')}, '_') || '_' || {FNV} AS id, text FROM hexed),
records AS (SELECT id, max(text) AS text FROM passages GROUP BY id),
record_terms AS (SELECT id, unnest({terms('text')}) AS term FROM records)"""

GRAPH = f"""{PASSAGES},
links AS (SELECT DISTINCT 'D_' || {CAPITAL} || term[2:] AS a, 'F_' || id AS b FROM record_terms),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
degrees AS (SELECT a AS node_id, count(*) AS degree, count(*) FILTER (starts_with(b, 'F_')) AS fdeg FROM both_ways GROUP BY a),
nodes AS (
  SELECT n.*, coalesce(d.degree, 0) AS degree, coalesce(d.fdeg, 0) AS fdeg, CASE WHEN starts_with(n.node_id, 'F_') THEN 0 ELSE 1 END AS level_rank FROM (
    SELECT 'F_' || id AS node_id, id || ' Passage' AS label, text FROM records
    UNION ALL SELECT DISTINCT a, substr(a, 3), '' FROM links) n LEFT JOIN degrees d USING (node_id))"""

INDEX = f"""{GRAPH},
postings AS (SELECT term, node_id, sum(w) AS tf FROM (
    SELECT node_id, unnest({terms('label')}) AS term, 3.0::DOUBLE AS w FROM nodes
    UNION ALL SELECT node_id, unnest({terms('text')}), 1.0::DOUBLE FROM nodes) GROUP BY ALL),
lens AS (SELECT n.node_id, coalesce(sum(p.tf), 0) AS len FROM nodes n LEFT JOIN postings p USING (node_id) GROUP BY 1),
stats AS (SELECT count(*) AS n_all, avg(len) AS avg_len FROM lens),
vocab AS (SELECT term, count(*) AS df FROM postings GROUP BY 1)"""

QUERIES = f"""
base AS (SELECT item_id, list_slice(string_split(replace(text, chr(10), ' '), ' '), 1, 5) AS w FROM benchmark),
queries AS (
  SELECT item_id * 3 AS query_id, array_to_string(w, ' ') AS q FROM base
  UNION ALL SELECT item_id * 3 + 1, array_to_string(list_transform(w, lambda x: {typo('x')}), ' ') FROM base
  UNION ALL SELECT item_id * 3 + 2, 'zzxqq' FROM base),
qt AS (SELECT query_id, unnest({terms('q')}) AS term FROM queries),
qd AS (SELECT DISTINCT query_id, term FROM qt)"""


def bm25(postings: str, terms_: str, weight: str = "1.0") -> str:
    return f"""SELECT t.query_id, p.node_id, sum({weight} * ln((n_all - d.df + 0.5) / (d.df + 0.5) + 1) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.len / avg_len))) AS score
  FROM {terms_} t JOIN {postings} p ON p.term = t.term JOIN (SELECT term, count(*) AS df FROM {postings} GROUP BY 1) d ON d.term = t.term JOIN lens l ON l.node_id = p.node_id CROSS JOIN stats GROUP BY 1, 2"""


def cascade(asked: str, index: str = INDEX) -> str:
    """The staged search as CTEs, for the queries (query_id, q) that `asked` defines with their terms qt and qd."""
    return f"""{index}, {asked},
e0 AS ({bm25('postings', 'qd')}),
top AS (SELECT query_id, max(score) AS top FROM e0 GROUP BY 1),
okq AS (SELECT query_id, lower(q) AS lq FROM queries WHERE len({terms('q')}) > 0 AND length(trim(q)) >= 3),
sub AS (SELECT query_id, node_id FROM nodes JOIN okq ON contains(lower(node_id), lq) OR contains(lower(label), lq)),
s_exact AS (SELECT query_id, node_id, sum(score) AS score FROM (SELECT * FROM e0 UNION ALL SELECT sub.query_id, node_id, 0.25 * top FROM sub JOIN top USING (query_id)) GROUP BY 1, 2),
left1 AS (SELECT query_id FROM queries WHERE query_id NOT IN (SELECT query_id FROM top)),
s_sub AS (SELECT query_id, node_id, 1.0 AS score FROM sub WHERE query_id IN (SELECT query_id FROM left1)),
left2 AS (SELECT query_id FROM left1 WHERE query_id NOT IN (SELECT query_id FROM s_sub)),
stems AS (SELECT term, node_id, sum(tf) AS tf FROM (SELECT {stem('p.term')} AS term, node_id, tf FROM postings p) GROUP BY 1, 2),
q_stem AS (SELECT query_id, term AS word, {stem('qd.term')} AS term FROM qd WHERE query_id IN (SELECT query_id FROM left2)),
q_stem_once AS (SELECT DISTINCT query_id, term FROM q_stem),
s_stem AS ({bm25('stems', 'q_stem_once')}),
left3 AS (SELECT query_id FROM left2 WHERE query_id NOT IN (SELECT query_id FROM s_stem)),
asked AS (SELECT DISTINCT term AS word FROM qd WHERE query_id IN (SELECT query_id FROM left3)),
ag AS (SELECT word, unnest({grams('word')}) AS gram FROM asked),
vg AS (SELECT term, unnest({grams('term')}) AS gram FROM vocab),
sims AS (SELECT word, vg.term, count(*) / (len({grams('word')}) + len({grams('vg.term')}) - count(*)) AS sim FROM ag JOIN vg USING (gram) GROUP BY 1, 2),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY sim DESC, term) AS rk FROM sims WHERE sim >= 0.4) WHERE rk <= 3),
used AS (SELECT query_id, qd.term AS word, near.term, sim FROM qd JOIN near ON near.word = qd.term WHERE query_id IN (SELECT query_id FROM left3)),
q_fuzzy AS (SELECT query_id, term, sum(sim) AS weight FROM used GROUP BY 1, 2),
s_fuzzy AS ({bm25('postings', 'q_fuzzy', 't.weight')}),
left4 AS (SELECT query_id FROM left3 WHERE query_id NOT IN (SELECT query_id FROM s_fuzzy)),
verdict AS (
  SELECT query_id, 'exact' AS stage, avg((term IN (SELECT term FROM vocab))::INT) AS coverage FROM qt WHERE query_id IN (SELECT query_id FROM top) GROUP BY 1
  UNION ALL SELECT query_id, 'substring', avg(EXISTS (SELECT 1 FROM s_sub s JOIN nodes n USING (node_id) WHERE s.query_id = qt.query_id AND (contains(lower(n.node_id), qt.term) OR contains(lower(n.label), qt.term)))::INT) FROM qt WHERE query_id IN (SELECT query_id FROM s_sub) GROUP BY 1
  UNION ALL SELECT query_id, 'stem', avg(((query_id, term) IN (SELECT (query_id, word) FROM q_stem WHERE term IN (SELECT term FROM stems)))::INT) FROM qt WHERE query_id IN (SELECT query_id FROM s_stem) GROUP BY 1
  UNION ALL SELECT query_id, 'fuzzy', avg(((query_id, term) IN (SELECT (query_id, word) FROM used))::INT) FROM qt WHERE query_id IN (SELECT query_id FROM s_fuzzy) GROUP BY 1
  UNION ALL SELECT query_id, 'hub', 0.0 FROM left4),
scores AS (SELECT * FROM s_exact UNION ALL SELECT * FROM s_sub UNION ALL SELECT * FROM s_stem UNION ALL SELECT * FROM s_fuzzy),
reached AS (SELECT query_id, node_id, sum(score) AS score FROM (
    SELECT query_id, node_id, score FROM scores WHERE starts_with(node_id, 'F_')
    UNION ALL SELECT s.query_id, l.b, 0.5 * s.score / greatest(sqrt(n.fdeg), 1.0) FROM scores s JOIN nodes n USING (node_id) JOIN links l ON l.a = s.node_id) GROUP BY 1, 2),
spread AS (SELECT query_id, node_id, round(score, 9) AS score FROM reached UNION ALL SELECT query_id, node_id, round(score, 9) FROM scores WHERE query_id NOT IN (SELECT query_id FROM reached)),
hits AS (SELECT * FROM (SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, level_rank, degree DESC, node_id) AS rank FROM spread JOIN nodes USING (node_id)) WHERE rank <= 5
  UNION ALL SELECT query_id, node_id, 0.0, rank FROM left4 CROSS JOIN (SELECT node_id, row_number() OVER (ORDER BY degree DESC, node_id) AS rank FROM nodes WHERE level_rank = 0 QUALIFY rank <= 5))"""


CASCADE = cascade(QUERIES)


def passages_of(docs: str) -> str:
    """PASSAGES over other rows (doc_id, text, source) than the documents'."""
    return f"documents AS ({docs}), {PASSAGES}"
