"""SQL that gives the rows of the operators that SQL can express: plain counting and joining, all pairs of equal shingles
and exact sums of binomial terms, where the operators use sketches, hashes and series."""

from __future__ import annotations

from cuemill.llm import quality

_WORDS = r"""t AS (SELECT row_number() OVER () AS r, *, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents)"""

JACCARD = f"""WITH RECURSIVE {_WORDS},
s AS (SELECT DISTINCT r, CASE WHEN len(ws) >= 5 THEN array_to_string(ws[i:i + 4], ' ') ELSE array_to_string(ws, ' ') END AS s FROM (SELECT r, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM t WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
l AS (SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.r <> y.r GROUP BY x.r, y.r) JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 10 * c >= 8 * (na.n + nb.n - c)),
reach AS (SELECT r AS a, r AS b FROM t UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
SELECT t.doc_id, k.class_id, coalesce(d.n, 0) AS n_links FROM t JOIN (SELECT a, min(doc_id) AS class_id FROM reach JOIN t ON t.r = b GROUP BY a) k ON k.a = t.r LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) d ON d.a = t.r"""

#: The same grid as the operator's; levels, costs and rates as its defaults.
_GRID = ", ".join(f"('{rule}', {i}, {c}::DOUBLE)" for rule, cutoffs in quality.RULES.items() for i, c in enumerate(cutoffs))
_RATE, _LEVEL = quality.ALPHA / len(quality.RULES), f"{quality.DELTA}::DOUBLE / ((SELECT count(DISTINCT stratum) FROM g) * {len(quality.RULES)})"

QUALITY = rf"""WITH {_WORDS},
again AS (SELECT r, s FROM (SELECT r, array_to_string(ws[i:i + 7], chr(31)) AS s FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM t WHERE len(ws) > 7)) GROUP BY r, s HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, array_to_string(ws[i:i + 7], chr(31)) AS s FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM t WHERE len(ws) > 7)) JOIN again USING (r, s), generate_series(0, 7) AS g(k) GROUP BY r),
m AS (SELECT r, doc_id, coalesce(lang, '') AS stratum, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(covered.n, 0) AS n_repeat_words FROM t LEFT JOIN covered USING (r)),
d AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
v AS (SELECT r, doc_id, stratum, base_failed, unnest([{{'rule': 'symbol_rate', 'x': n_symbols / n_words}}, {{'rule': 'dup_line_rate', 'x': n_dup_lines / len(lines)}}, {{'rule': 'repeat_rate', 'x': n_repeat_words / n_words}}, {{'rule': 'word_length', 'x': word_chars / n_words}}], recursive := true) FROM d WHERE n_words > 0),
good AS (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
one AS (SELECT doc_id, min(struct_pack(stratum := stratum, a := n_symbols / n_words, b := n_dup_lines / len(lines), c := n_repeat_words / n_words, d := word_chars / n_words)) AS x FROM d WHERE NOT base_failed GROUP BY doc_id),
u AS (SELECT doc_id, x.stratum AS stratum, unnest([{{'rule': 'symbol_rate', 'x': x.a}}, {{'rule': 'dup_line_rate', 'x': x.b}}, {{'rule': 'repeat_rate', 'x': x.c}}, {{'rule': 'word_length', 'x': x.d}}], recursive := true) FROM one),
g AS (SELECT stratum, c.rule, c.i, c.cutoff, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND x > c.cutoff) AS k, count(*) FILTER (WHERE NOT good AND x > c.cutoff) AS caught FROM u JOIN good USING (doc_id) JOIN (VALUES {_GRID}) AS c(rule, i, cutoff) ON c.rule = u.rule GROUP BY ALL),
p AS (SELECT g.*, k < n * {_RATE} AND (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_RATE}) + (n - j) * ln(1 - {_RATE}))) FROM generate_series(0, k) AS e(j)) <= {_LEVEL} AS safe FROM g),
best AS (SELECT stratum, rule, arg_max(cutoff, (caught - {quality.COST} * k, cutoff)) AS cutoff FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.stratum = p.stratum AND q.rule = p.rule AND q.i <= p.i AND NOT q.safe) AND caught - {quality.COST} * k > 0 GROUP BY stratum, rule)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT EXISTS (SELECT 1 FROM v JOIN best USING (stratum, rule) WHERE v.r = d.r AND x > cutoff) AS kept FROM d"""

#: N-grams of up to three words counted over all documents; logarithms in rounded millionths, ln(0.4) among them.
BACKOFF = f"""WITH {_WORDS},
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
p AS (SELECT r, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS v, lag(w, 2) OVER (PARTITION BY r ORDER BY i) AS u FROM w),
c1 AS (SELECT w, count(*) AS n FROM w GROUP BY w), c2 AS (SELECT v, w, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY v, w), c3 AS (SELECT u, v, w, count(*) AS n FROM p WHERE u IS NOT NULL GROUP BY u, v, w),
k AS (SELECT p.*, c3.n AS n3, cuv.n AS nuv, c2.n AS n2, cv.n AS nv, c1.n AS n1, (SELECT count(*) FROM w) AS total
      FROM p JOIN c1 ON c1.w = p.w LEFT JOIN c1 cv ON cv.w = p.v LEFT JOIN c2 ON c2.v = p.v AND c2.w = p.w LEFT JOIN c2 cuv ON cuv.v = p.u AND cuv.w = p.v LEFT JOIN c3 ON c3.u = p.u AND c3.v = p.v AND c3.w = p.w),
s AS (SELECT r, sum(CASE WHEN n3 >= 1 THEN round(1e6::DOUBLE * ln(n3)) - round(1e6::DOUBLE * ln(nuv)) WHEN n2 >= 1 THEN CASE WHEN u IS NULL THEN 0 ELSE -916291 END + round(1e6::DOUBLE * ln(n2)) - round(1e6::DOUBLE * ln(nv))
      ELSE CASE WHEN v IS NULL THEN 0 WHEN u IS NULL THEN -916291 ELSE -2 * 916291 END + round(1e6::DOUBLE * ln(n1)) - round(1e6::DOUBLE * ln(total)) END) AS s FROM k GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_tokens, s / 1e6::DOUBLE AS log_score, s / 1e6::DOUBLE / len(ws) AS mean_log_score FROM t LEFT JOIN s USING (r)"""

#: Units and their borders; seeds from the digest of the id.
INFILL = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform(range(4), lambda i: CAST('0x' || substr(d, i * 8 + 1, 8) AS BIGINT)) AS h FROM t),
b AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM b)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

#: All pairs of sources over all kept terms, in whole numbers wide enough for any count.
DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
own AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM groups g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + s.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (s.total + s.v) AS q
      FROM own g JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
both_parts AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(value, 0) AS value FROM groups g JOIN groups o ON o.lang = g.lang AND o.source <> g.source LEFT JOIN pair ON pair.lang = g.lang AND pair.source = g.source AND pair.item = o.source
               UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""
