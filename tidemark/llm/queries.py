"""One registered query per operator, over its whole table."""

from __future__ import annotations

from tidemark.llm.base import query, table
from tidemark.llm.bpe import encode_digests
from tidemark.llm.fmdedup import substring_dedup
from tidemark.llm.html import extract_pages
from tidemark.llm.lexical import ranked_search
from tidemark.llm.license import scan_licenses
from tidemark.llm.merkle import tampered_proofs
from tidemark.llm.mixing import mix_sources
from tidemark.llm.multiindex import nearest
from tidemark.llm.quality import quality_rules
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.tokenfile import token_files
from tidemark.llm.toxicity import toxicity
from tidemark.llm.urlfilter import rule_table, url_verdicts


@query("op1_toxicity")
def op1(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_bpe_codec")
def op2(spark, sf_dir):
    return encode_digests(table(spark, sf_dir, "documents"))


@query("op3_token_files")
def op3(spark, sf_dir):
    return token_files(table(spark, sf_dir, "documents"))


@query("op4_substring_dedup", r"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
numbered AS (SELECT row_number() OVER () AS rid, * FROM w),
win AS (SELECT rid, doc_id, unnest(range(1, len(ws) - 11)) AS p, ws FROM numbered WHERE len(ws) >= 13),
txt AS (SELECT rid, doc_id, p, md5(array_to_string(ws[p:p + 12], ' ')) AS t FROM win),
first_doc AS (SELECT t, min(doc_id) AS least FROM txt GROUP BY t),
bad AS (SELECT DISTINCT rid, unnest(range(p, p + 13)) AS q FROM txt JOIN first_doc USING (t) WHERE least < doc_id),
word AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS q, unnest(ws) AS word FROM numbered),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY q) AS k, count(*) AS n FROM word ANTI JOIN bad USING (rid, q) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM numbered LEFT JOIN kept USING (rid)""")
def op4(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"))


@query("op7_simhash_groups")
def op7(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_quality_rules", r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 3)) AS p, ws FROM w WHERE len(ws) >= 5),
k AS (SELECT rid, p, array_to_string(ws[p:p + 4], ' ') AS s FROM g),
twice AS (SELECT rid, s FROM k GROUP BY rid, s HAVING count(*) > 1),
r AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + 5)) AS q FROM k JOIN twice USING (rid, s)) GROUP BY rid),
c AS (SELECT rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
v AS (SELECT rid, lang, source, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS rate,
  unnest([CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words END, CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words END,
          CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines END, CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words END]) AS v FROM c),
b AS (SELECT rid, lang, source, rate, v, (v >> CAST(greatest(length(bin(v)) - 6, 0) AS BIGINT)) << CAST(greatest(length(bin(v)) - 6, 0) AS BIGINT) AS low FROM v WHERE v IS NOT NULL),
own AS (SELECT lang, source, rate, count(*) AS n, quantile_disc(low, 0.25) AS a, quantile_disc(low, 0.75) AS z FROM b GROUP BY ALL),
bylang AS (SELECT lang, rate, count(*) AS n, quantile_disc(low, 0.25) AS a, quantile_disc(low, 0.75) AS z FROM b GROUP BY ALL),
every AS (SELECT rate, quantile_disc(low, 0.25) AS a, quantile_disc(low, 0.75) AS z FROM b GROUP BY ALL),
q AS (SELECT own.lang, own.source, own.rate, CASE WHEN own.n >= 200 THEN own.a WHEN bylang.n >= 200 THEN bylang.a ELSE every.a END AS a,
  CASE WHEN own.n >= 200 THEN own.z WHEN bylang.n >= 200 THEN bylang.z ELSE every.z END AS z
  FROM own JOIN bylang ON own.lang IS NOT DISTINCT FROM bylang.lang AND own.rate = bylang.rate JOIN every ON own.rate = every.rate),
slack(rate, base, chance) AS (VALUES ('word_length', 500, 15000.0), ('symbols', 100, 3000.0), ('dup_lines', 100, 3000.0), ('repeats', 50, 2000.0)),
bad AS (SELECT DISTINCT b.rid FROM b JOIN c USING (rid) JOIN q ON b.lang IS NOT DISTINCT FROM q.lang AND b.source IS NOT DISTINCT FROM q.source AND b.rate = q.rate JOIN slack ON slack.rate = b.rate
  WHERE b.v > z + 6 * (z - a) + base + floor(CAST(chance AS DOUBLE) / sqrt(CAST(CASE WHEN b.rate = 'dup_lines' THEN n_lines ELSE n_words END AS DOUBLE)))
     OR (b.rate = 'word_length' AND b.v < a - 6 * (z - a) - base - floor(CAST(chance AS DOUBLE) / sqrt(CAST(n_words AS DOUBLE))))),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.rid IS NULL AS kept FROM f LEFT JOIN bad USING (rid)""")
def op8(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


@query("op10_source_mix", r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s0),
o AS (SELECT *, row_number() OVER w AS k, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
  sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, (SELECT sum(size) FROM d) AS budget FROM s WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, source)),
l AS (SELECT k, CAST(budget - fixed AS DOUBLE) / CAST(rest AS DOUBLE) AS level, CAST(budget - fixed AS DOUBLE) / CAST(rest AS DOUBLE) * weight <= cap AS fits FROM o),
lev AS (SELECT level FROM l WHERE fits ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN level * weight > cap THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target FROM s, lev),
q AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id, size, rid) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(greatest(least(size, floor(target) - (upto - size)), 0) + greatest(least(size, floor(target) - (source_size + upto - size)), 0)
  + greatest(least(size, floor(target) - (2 * source_size + upto - size)), 0) AS BIGINT) AS taken FROM q""")
def op10(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"))


@query("op9_html_text", r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(?:p|h1)>'),
  lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
    '&quot;?', '"', 'g'), '&#(?:x27|39);', chr(39), 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t""")
def op9(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))


@query("op5_multi_index")
def op5(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"))


@query("op6_license_scan", r"""
WITH rule(kind, label, n, pattern) AS (VALUES
  ('base', 'mit', 4, 'under the mit license'), ('base', 'apache-2', 4, 'apache license version 2'), ('base', 'cc-by-nc', 3, 'cc by nc'),
  ('more', 'mit', 46, 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (?:[^ ]+ ){0,6}to deal in the (?:software|materials) without restriction including without limitation (?:on )?the rights to use copy modify merge publish distribute sublicense and or sell copies of the'),
  ('more', 'mit', 5, 'released under (?:the terms of )?the mit (?:license|licence)'),
  ('more', 'isc', 33, 'permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies'),
  ('more', 'bsd', 21, 'redistribution and use in source and binary forms with or without modification are permitted (?:subject to the limitations in the disclaimer below )?provided that the following conditions are met'),
  ('more', 'apache-2', 6, 'licensed under the apache license (?:version )?2'),
  ('more', 'gpl-2', 6, 'gnu general public (?:license|licence) (?:as published by the free software foundation )?(?:either )?(?:version|v) 2'),
  ('more', 'gpl-3', 6, 'gnu general public (?:license|licence) (?:as published by the free software foundation )?(?:either )?(?:version|v) 3'),
  ('more', 'lgpl', 5, 'gnu lesser general public (?:license|licence)'), ('more', 'agpl', 5, 'gnu affero general public (?:license|licence)'),
  ('more', 'mpl-2', 5, 'mozilla public license (?:(?:version|v) )?2 0'), ('more', 'unlicense', 11, 'this is free and unencumbered software released into the public domain'),
  ('more', 'cc0', 3, 'cc0 1 0'), ('more', 'cc-by-sa', 5, 'creative commons attribution share (?:a )?(?:alike|like)'),
  ('more', 'cc-by-nc', 4, 'creative commons attribution (?:non )?(?:noncommercial|commercial)')),
w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
l AS (SELECT *, ' ' || array_to_string(ws, ' ') || ' ' AS line FROM w),
p AS (SELECT rid, unnest(list_filter(range(1, len(ws) + 1), lambda i: array_to_string(ws[i:i + 3], ' ') IN ('under the mit license', 'apache license version 2') OR array_to_string(ws[i:i + 2], ' ') = 'cc by nc')) - 1 AS pos FROM l),
b AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM p GROUP BY rid),
h AS (SELECT rid, kind, label, n FROM l JOIN rule ON regexp_matches(line, ' ' || pattern || ' ')),
g AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE kind = 'base') AS base_labels, sum(n) AS m FROM h GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, 1 - 1 / (1 + CAST(coalesce(m, 0) AS DOUBLE)) AS score
FROM l LEFT JOIN b USING (rid) LEFT JOIN g USING (rid)""")
def op6(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op11_merkle_manifest", r"""
WITH RECURSIVE f AS (SELECT row_number() OVER () AS rid, doc_id, lang, n_chars, text, coalesce('=' || lang, '-') AS g,
  coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
  coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
  coalesce(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 0) AS crc FROM documents),
leaf AS (SELECT rid, doc_id, lang, g, sha256(head || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
  sha256(head || coalesce(length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) AS other, doc_id IS NOT NULL AND xor(crc, 4294967295) % 7 = 0 AS hit FROM f),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM leaf),
tree(l, g, p, n, h) AS (SELECT 0, g, p, n, leaf FROM placed UNION ALL SELECT l + 1, g, p // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM tree WHERE n > 1 GROUP BY l, g, p // 2),
sub AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g = '-' DESC, g) - 1 AS k, count(*) OVER () AS m FROM tree WHERE n = 1),
top(l, p, n, h) AS (SELECT 0, k, m, subroot FROM sub UNION ALL SELECT l + 1, p // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM top WHERE n > 1 GROUP BY l, p // 2),
inner_steps AS (SELECT rid, q.l, q.p, t.p AS other, t.h FROM (SELECT rid, g, s.l, p >> s.l AS p FROM placed JOIN (SELECT DISTINCT g, l FROM tree WHERE n > 1) s USING (g)) q
  LEFT JOIN tree t ON t.g = q.g AND t.l = q.l AND t.p = xor(q.p, 1::BIGINT)),
outer_steps AS (SELECT g, q.l, q.p, t.p AS other, t.h FROM (SELECT g, s.l, k >> s.l AS p FROM sub CROSS JOIN (SELECT DISTINCT l FROM top WHERE n > 1) s) q LEFT JOIN top t ON t.l = q.l AND t.p = xor(q.p, 1::BIGINT)),
steps AS (SELECT rid, l, p, other, h FROM inner_steps UNION ALL SELECT rid, o.l + 1000, o.p, o.other, o.h FROM placed JOIN outer_steps o USING (g)),
proof AS (SELECT rid, coalesce(string_agg(h, '' ORDER BY l), '') AS s, list(CASE WHEN h IS NULL THEN '-' WHEN other < p THEN 'L' || h ELSE 'R' || h END ORDER BY l) AS path FROM steps GROUP BY rid),
folded AS (SELECT rid, doc_id, g, leaf, sha256(coalesce(s, '')) AS proof_sha256,
  list_reduce(list_concat([CASE WHEN hit THEN other ELSE leaf END], coalesce(path, [])), lambda a, x: CASE x[1] WHEN 'L' THEN sha256(x[2:] || a) WHEN 'R' THEN sha256(a || x[2:]) ELSE sha256(a) END) AS folded_root FROM placed LEFT JOIN proof USING (rid))
SELECT doc_id, leaf, subroot, r.h AS root, proof_sha256, folded_root, folded_root = r.h AS verified FROM folded JOIN sub USING (g) CROSS JOIN (SELECT h FROM top WHERE n = 1) r""")
def op11(spark, sf_dir):
    return tampered_proofs(table(spark, sf_dir, "documents"))


@query("op12_lexical_search", r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
total AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0),
tf AS (SELECT rid, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT n FROM total) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf GROUP BY term),
q AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
len AS (SELECT rid, doc_id, 25 + (75 * CAST(len(ts) AS BIGINT) * n) // l AS m FROM d, total),
s AS (SELECT item_id, rid, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN len USING (rid) GROUP BY ALL HAVING score > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s QUALIFY rank <= 10""")
def op12(spark, sf_dir):
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The rules of the query: host, path, action.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query("op13_url_filter", r"""
WITH RECURSIVE rule(rh, rp, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p0 AS (SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
links AS (SELECT rid, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|<(?i:script).*?</(?i:script)', ' ', 'g'), '(?i)<link[^>]*>'), lambda t: regexp_matches(t, '(?i)rel\s*=\s*["'']?canonical')), lambda t: regexp_extract(t, '(?i)href\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(list_filter(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|<(?i:script).*?</(?i:script)', ' ', 'g'), '(?i)<meta[^>]*>'), lambda t: regexp_matches(t, '(?i)http-equiv\s*=\s*["'']?refresh')), lambda t: regexp_extract(t, '(?i)content\s*=\s*["'']?[^"''>]*?url\s*=\s*["'']?([^"''\s>]+)', 1)))) AS link
  FROM p0 WHERE regexp_matches(html, '(?i)canonical|http-equiv')),
rel AS (SELECT rid, replace(link, '&amp;', '&') AS link, url, regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme, regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) AS site, regexp_extract(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '(?s)^(.*/)', 1) AS folder FROM links JOIN p0 USING (rid)),
full_link AS (SELECT rid, CASE WHEN link = '' THEN NULL WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN NOT contains(url, '://') THEN NULL WHEN starts_with(link, '//') THEN scheme || ':' || link
    WHEN starts_with(link, '/') THEN scheme || '://' || site || link WHEN regexp_matches(link, '^(#|[A-Za-z][A-Za-z0-9+.-]*:)') THEN NULL ELSE scheme || '://' || site || CASE WHEN folder = '' THEN '/' ELSE folder END || link END AS url FROM rel),
every AS (SELECT rid, true AS own, url FROM p0 UNION ALL SELECT rid, false, url FROM full_link WHERE url IS NOT NULL),
cut AS (SELECT rid, own, url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
  array_to_string(list_filter(string_split(regexp_extract(regexp_extract(url, '(?s)^.*?://([^#]*)', 1), '(?s)\?(.*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_')), '&') AS asked FROM every),
named AS (SELECT rid, own, host, path, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '') || CASE WHEN asked = '' THEN '' ELSE '?' || asked END END AS node FROM cut),
edge AS (SELECT DISTINCT a.node AS a, b.node AS b FROM named a JOIN named b ON a.rid = b.rid AND a.own AND NOT b.own AND a.node <> b.node),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
class AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a),
fit AS (SELECT rid, rh || rp AS rule, action, row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC, length(rh) DESC, action) AS k FROM named JOIN rule ON own AND (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
told AS (SELECT n.*, rule, action, coalesce(root, node) AS root FROM named n LEFT JOIN fit ON fit.rid = n.rid AND k = 1 LEFT JOIN class USING (node) WHERE own),
mark AS (SELECT root, bool_or(action = 'allow') AS allows, bool_or(action = 'block') AS blocks FROM told WHERE root IS NOT NULL GROUP BY root)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN allows THEN 'allow' WHEN blocks THEN 'block' ELSE 'allow' END) AS verdict FROM told JOIN p0 USING (rid) LEFT JOIN mark USING (root)""")
def op13(spark, sf_dir):
    return url_verdicts(table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES)).drop("url_class")
