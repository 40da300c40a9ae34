"""SQL of the corpus queries that SQL can express, for another engine over the same tables.

It states the results by their definition, not by the operators' methods, and compares everything with everything where
that is what the definition says; it is meant for small tables.
"""

from __future__ import annotations

from .line_dedup import COPY, CUT, LONGEST, RECURS

SPACE = r"'[ \t-\r]+'"
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), {SPACE}), lambda w: w <> '')"


OP2 = f"""WITH w AS (SELECT row_number() OVER () AS rid, doc_id, {_words('text')} AS ws FROM documents),
 s AS (SELECT rid, i, array_to_string(ws[i:i + 34], ' ') AS k FROM w, unnest(range(1, len(ws) - 33)) t(i)),
 dup AS (SELECT rid, i FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)),
 gone AS (SELECT DISTINCT rid, i + j AS p FROM dup, unnest(range(0, 35)) t(j)),
 n AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid),
 kept AS (SELECT w.rid, string_agg(ws[p], ' ' ORDER BY p) AS txt FROM w, unnest(range(1, len(ws) + 1)) t(p) WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.rid = w.rid AND g.p = t.p) GROUP BY w.rid)
 SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256 FROM w LEFT JOIN n USING (rid) LEFT JOIN kept USING (rid)"""

OP10 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_words(f'translate(text, {UPPER}, {LOWER})')} AS ws FROM documents),
 sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 1, 2))) t(i) WHERE len(ws) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
 e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 85 * (x.n + y.n - both_n)),
 r AS (SELECT a AS doc_id, b FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.b = e.a),
 c AS (SELECT d.doc_id, least(d.doc_id, min(r.b)) AS component_id FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id)
 SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

OP6 = """WITH sz AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
 rate AS (SELECT source, sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () / n AS r FROM sz),
 j AS (SELECT source, r, j, sum(ln(greatest(j, 1)::DOUBLE)) OVER (PARTITION BY source ORDER BY j) AS lf FROM rate, unnest(range(0, ceil(r + 12 * sqrt(r) + 30)::BIGINT + 1)) t(j)),
 cdf AS (SELECT source, sum(exp(j * ln(r) - r - lf)) OVER (PARTITION BY source ORDER BY j) AS c FROM j),
 u AS (SELECT *, (('0x' || substr(md5(concat('17|', doc_id)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
 k AS (SELECT doc_id, text, lang, u.source, n_chars, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM u.source AND c <= u) AS k FROM u)
 SELECT doc_id, text, lang, source, n_chars, i::INT AS copy, md5(concat('shuffle 17|', doc_id, '|', i)) AS shuffle_key FROM k, unnest(range(1, k + 1)) t(i)"""

OP3 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
 l AS (SELECT DISTINCT text, i, ls[i] AS line FROM d, unnest(range(1, len(ls) + 1)) t(i) WHERE text IS NOT NULL),
 t AS (SELECT *, CASE WHEN 2 * len(list_filter(mk, lambda x: x = '<*>')) > len(mk) THEN raw ELSE mk END AS tok FROM (SELECT *, list_filter(string_split_regex(line, '[ \t\x0B\f\r]+'), lambda x: x <> '') AS raw,
  list_filter(string_split_regex(regexp_replace(line, '[^ \t\x0B\f\r]*[0-9][^ \t\x0B\f\r]*', '<*>', 'g'), '[ \t\x0B\f\r]+'), lambda x: x <> '') AS mk FROM l)),
 h AS (SELECT text, i, line, len(tok) AS n, tok FROM t WHERE len(tok) > 0), held AS (SELECT DISTINCT tok, text FROM h),
 wt AS (SELECT tok, len(tok) AS n, len(tok) // 5 AS a, count(*) AS w FROM held GROUP BY tok),
 pt AS (SELECT tok, w, n, [tok[a * j + 1:CASE WHEN j < 4 THEN a * j + a ELSE n END] for j in range(0, 5)] AS ps FROM wt WHERE n BETWEEN {CUT} AND {LONGEST}),
 pa AS (SELECT tok, w, {{'n': n, 'x': x, 'y': y, 'k': [p for p, j in ps if j <> x + 1 and j <> y + 1]}} AS tpl FROM pt, unnest(range(0, 4)) u(x), unnest(range(1, 5)) v(y) WHERE x < y
  UNION ALL SELECT tok, w, {{'n': n, 'x': x, 'y': -1, 'k': [tok[1:x], tok[x + 2:n]]}} FROM wt, unnest(range(0, n)) u(x) WHERE n >= 4 AND n < {CUT}),
 mb AS (SELECT tok, tpl FROM pa WHERE tpl IN (SELECT tpl FROM pa GROUP BY tpl HAVING sum(w) >= {RECURS} AND count(*) > 1) UNION ALL SELECT tok, {{'n': n, 'x': -1, 'y': -1, 'k': [tok]}} FROM wt WHERE w >= {RECURS}),
 sn AS (SELECT DISTINCT tpl, text FROM mb JOIN held USING (tok)), rw AS (SELECT DISTINCT text, line, n FROM h), sh AS (SELECT *, count(*) OVER (PARTITION BY line) > 1 AS shared FROM rw),
 cl AS (SELECT text, CASE WHEN sum(n) FILTER (WHERE shared) > {COPY} * sum(n) THEN arg_max(line, (n, line)) FILTER (WHERE shared) END AS longest FROM sh GROUP BY text),
 ct AS (SELECT DISTINCT tpl, longest, CASE WHEN longest IS NULL THEN text END AS own FROM sn LEFT JOIN cl USING (text)),
 ag AS (SELECT DISTINCT tok FROM mb WHERE tpl IN (SELECT tpl FROM ct GROUP BY tpl HAVING count(*) >= {RECURS})),
 gn AS (SELECT text, list(i) AS g FROM h WHERE tok IN (SELECT tok FROM ag) GROUP BY text)
 SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(g), 0)::BIGINT AS n_dropped,
 CASE WHEN g IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda p: NOT list_contains(g, p)), lambda p: ls[p]), chr(10)) END AS kept_text FROM d LEFT JOIN gn USING (text)"""

OP7 = f"""WITH dw AS (SELECT doc_id, {_words(f'translate(text, {UPPER}, {LOWER})')} AS ws FROM documents), iw AS (SELECT item_id, {_words(f'translate(text, {UPPER}, {LOWER})')} AS vs FROM benchmark),
 ds AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM dw, unnest(range(1, len(ws) - 3)) t(i)), si AS (SELECT item_id, array_to_string(vs[i:i + 4], ' ') AS g FROM iw, unnest(range(1, len(vs) - 3)) t(i)),
 sc AS (SELECT item_id, g, count(*) AS n FROM si GROUP BY ALL), hit AS (SELECT DISTINCT doc_id, item_id, i FROM ds JOIN sc USING (g)),
 sz AS (SELECT h.doc_id, h.item_id, h.i, least(len(vs), len(ws)) AS z, len(ws) AS nw FROM hit h JOIN dw USING (doc_id) JOIN iw USING (item_id)),
 st AS (SELECT DISTINCT doc_id, item_id, z, s FROM sz, unnest(range(greatest(i - z + 5, 1), least(i, nw - z + 1) + 1)) t(s)),
 win AS (SELECT st.doc_id, st.item_id, s, z, ds.g, count(*) AS n FROM st JOIN ds ON ds.doc_id = st.doc_id AND ds.i BETWEEN s AND s + z - 5 GROUP BY ALL),
 bo AS (SELECT win.doc_id, win.item_id, s, z, sum(least(win.n, coalesce(sc.n, 0))) AS both_n, sum(win.n) AS total FROM win LEFT JOIN sc ON sc.item_id = win.item_id AND sc.g = win.g GROUP BY ALL),
 sim AS (SELECT doc_id, bo.item_id, max(both_n / (total + len(vs) - 4 - both_n)) AS sim FROM bo JOIN iw ON iw.item_id = bo.item_id GROUP BY ALL HAVING max(both_n / (total + len(vs) - 4 - both_n)) >= 0.8),
 f AS (SELECT doc_id, list(item_id ORDER BY item_id) AS ids, max(sim) AS sim FROM sim GROUP BY doc_id)
 SELECT doc_id, ids IS NOT NULL AS contaminated, coalesce(ids, []::BIGINT[]) AS item_ids, round(sim, 9) AS similarity FROM documents LEFT JOIN f USING (doc_id)"""

OP11 = f"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
 w AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, {UPPER}, {LOWER}), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
 kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 3), g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL), m AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, kept.n AS nl FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
 p AS MATERIALIZED (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER s + count(*) OVER s)::HUGEINT AS p, 1 + 1000000000::HUGEINT * (nl + 1) // (sum(nl) OVER s + count(*) OVER s)::HUGEINT AS q FROM m WINDOW s AS (PARTITION BY lang, source)),
 pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
 tm AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tm))
 SELECT * FROM r WHERE part = 'pair' OR rank <= 200"""

SQL = {"op2_substring_dedup": OP2, "op3_line_dedup": OP3, "op6_mixing": OP6, "op7_decontaminate": OP7, "op10_near_dedup": OP10, "op11_source_divergence": OP11}
