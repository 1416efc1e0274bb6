"""DuckDB SQL of the operators that SQL can state."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT d, y FROM reach JOIN links ON x = r)
SELECT d AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n ON n.doc_id = d GROUP BY d"""

SUBSTRINGS = rf"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hits),
flat AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT f.doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM flat f WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = f.doc_id AND g.p = f.p) GROUP BY f.doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)"""

LINES = r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
ranks AS (SELECT doc_id, i, 0 AS k, nw AS own, nw AS words, md5(line) AS r FROM f
 UNION ALL SELECT a.doc_id, a.i, a.k + 1, a.own, a.words + b.words, md5(a.r || b.r) FROM ranks a JOIN ranks b ON b.doc_id = a.doc_id AND b.k = a.k AND b.i = a.i + (1 << a.k)),
placed AS (SELECT *, count(*) OVER (PARTITION BY k, r) AS many, first_value(doc_id) OVER w AS fd, first_value(i) OVER w AS fi FROM ranks WINDOW w AS (PARTITION BY k, r ORDER BY doc_id, i)),
chained AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, k, fd, fi - i ORDER BY i) AS chain FROM placed WHERE fd < doc_id OR fi < i),
runs AS (SELECT doc_id, min(i) AS i, max(i) + (1 << k) - 1 AS last, sum(own) + arg_max(words - own, i) AS words FROM chained GROUP BY doc_id, k, fd, fi - i, chain),
gone AS (SELECT doc_id, unnest(range(i, last + 1)) AS i FROM runs WHERE words >= 10 UNION SELECT doc_id, i FROM chained WHERE k = 0 AND many >= 20),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.p) AS t FROM l LEFT JOIN f ON f.doc_id = l.doc_id AND f.p = l.p WHERE f.i IS NULL OR NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = f.doc_id AND g.i = f.i) GROUP BY l.doc_id)
SELECT d.doc_id, (SELECT count(*) FROM f WHERE f.doc_id = d.doc_id) AS n_lines, (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256,
 (SELECT coalesce(max(last - i + 1), 0) FROM runs e WHERE e.doc_id = d.doc_id)::INT AS longest_copy FROM documents d LEFT JOIN kept USING (doc_id)"""

ORACLE = {"op2_jaccard_join": JACCARD, "op4_substrings": SUBSTRINGS, "op9_line_dedup": LINES}
