"""SQL of the layout statistics, written apart from the operator: tokens by patterns, lines and blocks by windows. Scripts without spaces aren't covered, the tables have none."""

from __future__ import annotations

from . import quality as q

_SP = r"[\t\n\x0B\f\r \x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]"
_ALNUM, _LETTER, _JOIN = r"\p{L}\p{M}\p{N}", r"\p{L}\p{M}", r"''’ʼ\-‐‑\x{00AD}\x{200C}\x{200D}"
_END = "[.!?…؟।。！？]"
_BULLETS = ", ".join(f"'{x}'" for x in q.BULLETS + "[")


def layout() -> str:
    """`ly`: i (row), doc_id, text, LAYOUT."""
    strip = lambda x: f"regexp_replace(regexp_replace({x}, '^{_SP}+', ''), '{_SP}+$', '')"
    count = lambda x, c: f"(length({x}) - length(replace({x}, {c}, '')))"
    return rf"""
WITH dc AS MATERIALIZED (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS text FROM documents),
l0 AS (SELECT i, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM dc),
l1 AS MATERIALIZED (SELECT i, ln, raw, {strip('raw')} AS line FROM l0),
t0 AS (SELECT i, ln, unnest(list_filter(regexp_split_to_array(line, '{_SP}+'), lambda x: x <> '')) AS tok, generate_subscripts(list_filter(regexp_split_to_array(line, '{_SP}+'), lambda x: x <> ''), 1) AS tn FROM l1 WHERE line <> ''),
t1 AS (SELECT *, regexp_extract(tok, '(?s)[{_ALNUM}](?:.*[{_ALNUM}])?') AS core, regexp_extract(tok, '^[^{_ALNUM}]*') AS lead, regexp_extract(tok, '[^{_ALNUM}]*$') AS trail FROM t0),
t2 AS (SELECT *, length(tok) AS size, length(regexp_replace(core, '[^{_LETTER}]', '', 'g')) AS nl FROM t1),
tk AS MATERIALIZED (SELECT *, core <> '' AND nl > 0 AND nl <= {q.LONGEST} AND regexp_full_match(core, '[{_LETTER}{_JOIN}]+') AND regexp_full_match(lead || trail, '[\p{{P}}><~`+=]*') AS word, core <> '' AND nl > 0 AND regexp_matches(trail, '{_END}') AS ended FROM t2),
ls AS (SELECT i, ln, count(*) AS n, sum(size) AS ink, count(*) FILTER (WHERE word) AS w, coalesce(sum(nl) FILTER (WHERE word), 0) AS wc, count(*) FILTER (WHERE word AND nl <= 3) AS sh, count(*) FILTER (WHERE ended) AS en, coalesce(sum(size - nl) FILTER (WHERE word), 0) AS sg, arg_min(tok, tn) AS f, arg_max(ended, tn) AS fin FROM tk GROUP BY 1, 2),
lx AS (SELECT l1.i, l1.ln, raw, line, length(line) AS len, ls.* EXCLUDE (i, ln), greatest({count('line', "'|'")}, {count('line', 'chr(9)')}) >= {q.CELLS} OR ({count('line', "';'")} >= {q.CELLS} AND w < {q.FEW}) OR contains(line, '{'.' * q.LEADER}') AS cells,
  n > 1 AND ((length(f) = 1 AND f IN ({_BULLETS})) OR regexp_full_match(f, '\(?[0-9]{{1,3}}[.)]') OR regexp_full_match(f, '[a-z][.)]') OR regexp_full_match(f, '\[.\]')) AS marked FROM l1 LEFT JOIN ls ON ls.i = l1.i AND ls.ln = l1.ln),
fl AS (SELECT *, n IS NOT NULL AS filled, coalesce(n IS NOT NULL AND NOT marked AND NOT cells, false) AS flow FROM lx),
b0 AS (SELECT *, CASE WHEN flow AND lag(flow) OVER w THEN 0 ELSE 1 END AS nb, CASE WHEN filled AND NOT coalesce(lag(filled) OVER w, false) THEN 1 ELSE 0 END AS np FROM fl WINDOW w AS (PARTITION BY i ORDER BY ln)),
b1 AS MATERIALIZED (SELECT *, sum(nb) OVER w AS bl, sum(np) OVER w AS pa FROM b0 WINDOW w AS (PARTITION BY i ORDER BY ln)),
pf AS (SELECT i, bl, list(ln ORDER BY ln) AS lns, list(w ORDER BY ln) AS w, list(wc ORDER BY ln) AS wc, list(sh ORDER BY ln) AS sh, list(en ORDER BY ln) AS en, list(sg ORDER BY ln) AS sg, list(ink ORDER BY ln) AS ink FROM b1 WHERE flow GROUP BY 1, 2),
wi AS (SELECT *, unnest(lns) AS ln, generate_subscripts(lns, 1) AS k, len(lns) AS m FROM pf),
ws AS (SELECT *, coalesce(list_filter(range(0, {q.CONTEXT_WORDS}), lambda s: list_sum(w[greatest(k - s, 1) : least(k + s, m)]) >= {q.CONTEXT_WORDS})[1], {q.CONTEXT_WORDS - 1}) AS s FROM wi),
wn AS (SELECT i, ln, {", ".join(f"list_sum({c}[greatest(k - s, 1) : least(k + s, m)]) AS c{c}" for c in ("w", "wc", "sh", "en", "sg", "ink"))} FROM ws),
pr AS (SELECT b1.*, coalesce((flow AND w > 0 AND cw >= {q.LEAST_WORDS} AND (cen > 0 OR (cw >= {q.OPEN_WORDS} AND csh >= {q.SHORT_SHARE} * cw AND csg <= {q.SIGNS} * cw)) AND cwc >= {q.WORD_CHARS} * cink)
    OR (marked AND NOT cells AND (w >= {q.LONG_ITEM_WORDS} OR (w >= {q.ITEM_WORDS} AND fin)) AND wc >= {q.WORD_CHARS} * ink), false) AS prose,
  filled AND row_number() OVER (PARTITION BY b1.i, filled, lower(line) ORDER BY b1.ln) > 1 AS again FROM b1 LEFT JOIN wn ON wn.i = b1.i AND wn.ln = b1.ln),
p0 AS (SELECT i, pa, {strip("string_agg(raw, chr(10) ORDER BY ln)")} AS par, sum(len) AS len, min(ln) AS ln FROM b1 WHERE filled GROUP BY 1, 2),
p1 AS (SELECT *, row_number() OVER (PARTITION BY i, lower(par) ORDER BY ln) > 1 AS again FROM p0),
wd AS MATERIALIZED (SELECT i, ln, length(core) AS size, lower(core) AS c, row_number() OVER (PARTITION BY i ORDER BY ln, tn) AS pos, sum(length(core)) OVER (PARTITION BY i ORDER BY ln, tn) AS upto FROM tk WHERE word),
g0 AS (SELECT i, ln, pos, upto - size AS since, lead(upto, 2) OVER w AS till, lead(ln, 2) OVER w AS ln3, c || chr(10) || lead(c) OVER w || chr(10) || lead(c, 2) OVER w AS g FROM wd WINDOW w AS (PARTITION BY i ORDER BY pos)),
g1 AS (SELECT *, lag(pos) OVER (PARTITION BY i, g ORDER BY pos) AS before, lag(till) OVER (PARTITION BY i, g ORDER BY pos) AS past, lag(pos) OVER (PARTITION BY i, g, ln ORDER BY pos) AS near, lag(ln3) OVER (PARTITION BY i, g, ln ORDER BY pos) AS near3 FROM g0 WHERE g IS NOT NULL),
g2 AS (SELECT i, g, count(*) AS times, sum(till - CASE WHEN before + 3 > pos THEN past ELSE since END) AS cover FROM g1 GROUP BY 1, 2 HAVING count(*) > 1),
ww AS (SELECT i, sum(size) AS total FROM wd GROUP BY 1),
cv AS (SELECT i, max(cover) AS best FROM g2 GROUP BY 1),
fi AS (SELECT i, g FROM g2 JOIN ww USING (i) WHERE times > 2 AND cover >= {q.PHRASE_SHARE} * total),
mk AS (SELECT DISTINCT i, pos + unnest([0, 1, 2]) AS pos FROM g1 JOIN fi USING (i, g)),
h0 AS (SELECT wd.i, wd.ln, count(*) AS n, sum(size) AS size, coalesce(sum(size) FILTER (WHERE mk.pos IS NOT NULL), 0) AS marked FROM wd LEFT JOIN mk ON mk.i = wd.i AND mk.pos = wd.pos GROUP BY 1, 2),
o0 AS (SELECT i, ln, g, count(*) AS times, sum(CASE WHEN near + 3 > pos THEN pos - near ELSE 3 END) AS covers FROM (SELECT * FROM g1 WHERE ln = ln3) GROUP BY 1, 2, 3 HAVING count(*) > 1),
o1 AS (SELECT i, ln, max(covers) AS own FROM o0 GROUP BY 1, 2),
ho AS (SELECT i, ln FROM h0 LEFT JOIN o1 USING (i, ln) WHERE (marked > 0 AND 2 * marked >= size) OR (n >= {q.PHRASE_LINE} AND own >= {q.PHRASE_SHARE} * n)),
sl AS (SELECT i, greatest(sum(coalesce(len, 0)), 1) AS total, sum(len) FILTER (WHERE again) AS twice FROM pr GROUP BY 1),
sp AS (SELECT i, sum(len) FILTER (WHERE again) AS twice FROM p1 GROUP BY 1),
sh AS (SELECT sl.i, total, coalesce(sl.twice, 0) / total AS dl, coalesce(sp.twice, 0) / total AS dp FROM sl LEFT JOIN sp USING (i)),
ps AS (SELECT pr.i, sum(pr.len) AS prose FROM pr JOIN sh USING (i) LEFT JOIN p1 ON p1.i = pr.i AND p1.pa = pr.pa LEFT JOIN ho ON ho.i = pr.i AND ho.ln = pr.ln WHERE prose AND ho.i IS NULL AND NOT ((pr.again OR p1.again) AND greatest(dl, dp) >= {q.REPEATED_SHARE}) GROUP BY 1),
ly AS (SELECT dc.i, doc_id, text, dl AS duplicate_line_share, dp AS duplicate_paragraph_share, coalesce(CAST(best AS DOUBLE) / ww.total, 0.0) AS phrase_coverage, coalesce(prose / sh.total, 0.0) AS prose_share FROM dc JOIN sh USING (i) LEFT JOIN cv USING (i) LEFT JOIN ww USING (i) LEFT JOIN ps USING (i))"""
