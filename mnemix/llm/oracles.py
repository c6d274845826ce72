"""DuckDB SQL for what SQL can say of the operators' results."""

from __future__ import annotations

SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"

CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * length(k))), lambda a, i:
  xor((CASE WHEN i % 8 = 0 THEN xor(a, ascii(k[i // 8 + 1])::BIGINT) ELSE a END) >> 1, CASE WHEN (CASE WHEN i % 8 = 0 THEN xor(a, ascii(k[i // 8 + 1])::BIGINT) ELSE a END) % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""

MIX_TARGETS = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 3.0 * source_size AS cap FROM s),
c AS (SELECT *, cap / weight AS at_level, sum(source_size) OVER ()::DOUBLE AS total, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS held, sum(weight) OVER (ORDER BY cap / weight DESC, source DESC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS free FROM w),
l AS (SELECT min_by((total - held) / free, at_level) AS level FROM c WHERE at_level > (total - held) / free)
SELECT doc_id, size, source_size, round(least(cap, weight * level), 3) AS target FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source CROSS JOIN l"""

TOKEN_BYTES = "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents"

LATTICE_BASE = f"""WITH k AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
h AS (SELECT row_number() OVER () AS r, doc_id, {CRC32} % 5 = 1 AS held_out, regexp_extract_all(t, '{WORD}') AS w FROM k),
u AS (SELECT r, held_out, unnest(w) AS x FROM h), c AS (SELECT x, count(*) FILTER (NOT held_out) AS c FROM u GROUP BY 1), e AS (SELECT count(*) FILTER (NOT held_out) AS ends FROM h),
n AS (SELECT sum(c)::BIGINT + max(ends) AS n, count(*) FILTER (c > 0) + 1 AS v, max(ends) AS ends FROM c CROSS JOIN e),
p AS (SELECT r, count(*) AS m, count(*) FILTER (c > 0) AS known, sum(log10((c + 0.5) / (n + 0.5 * (v + 1)))) AS s FROM u JOIN c USING (x) CROSS JOIN n GROUP BY 1)
SELECT doc_id, held_out, coalesce(m, 0) + 1 AS n_tokens, coalesce(known, 0) + 1 AS n_known, n AS train_tokens, round(coalesce(s, 0) + log10((ends + 0.5) / (n + 0.5 * (v + 1))), 3) AS base_score FROM h LEFT JOIN p USING (r) CROSS JOIN n"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')) END) AS s FROM w),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY 1),
both_ AS (SELECT a.r AS a, b.r AS b, count(*) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.r <> b.r GROUP BY 1, 2),
link AS (SELECT a, b, da.doc_id AS ia, db.doc_id AS ib FROM both_ JOIN n x ON x.r = a JOIN n y ON y.r = b JOIN w da ON da.r = a JOIN w db ON db.r = b WHERE m / (x.n + y.n - m) >= 0.8),
reach(node, root) USING KEY (node) AS (SELECT a, min(least(ia, ib)) FROM link GROUP BY 1 UNION SELECT l.a, min(q.root) FROM reach q JOIN link l ON l.b = q.node JOIN recurring.reach x ON x.node = l.a WHERE q.root < x.root GROUP BY 1)
SELECT doc_id, coalesce(root, doc_id) AS class_id, coalesce(l.n, 0) AS n_links FROM w LEFT JOIN reach ON node = r LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY 1) l ON l.a = r"""
