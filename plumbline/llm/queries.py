"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import forest, html_text, mixing, ngram_quality, packing, pii, prefix_trie, quality_rules, simhash, spelling, suffixes, token_store, url_filter
from .common import read_table
from .tokens import vocabulary


def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_prefix_forest(spark, sf_dir):
    return forest.nearest(read_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op3_personal_data(spark, sf_dir):
    return pii.find(read_table(spark, sf_dir, "documents"))


def op4_token_store(spark, sf_dir):
    folder, manifest = token_store.write(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)
    return token_store.read(folder, manifest)


def op5_kneser_ney_quality(spark, sf_dir):
    return ngram_quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_suffix_ranges(spark, sf_dir):
    return suffixes.remove_repeats(read_table(spark, sf_dir, "documents"), with_text=False)


def op7_site_templates(spark, sf_dir):
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op8_mix_sources(spark, sf_dir):
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_rules(spark, sf_dir):
    return quality_rules.apply_rules(read_table(spark, sf_dir, "documents"))


def op10_pack_hilbert(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)


#: Rules of the query, and words in names of hosts by which it makes its list from the pages.
RULES = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]
TERMS = ["adult", "ads", "bets", "casino", "pills", "porn", "spam", "xxx"]


def op11_url_filter(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    return url_filter.judge(pages, RULES, url_filter.named(pages, TERMS))


def op12_spelling_variants(spark, sf_dir):
    return spelling.variants(read_table(spark, sf_dir, "documents"), every=spelling.DAMAGE)


def op13_prefix_trie(spark, sf_dir):
    turns = prefix_trie.conversations(read_table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.shared_beginnings(turns))


def queries():
    return {n: f for n, f in globals().items() if n.startswith("op") and callable(f) and n[2].isdigit()}


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS MATERIALIZED (
  SELECT source, source_size, weight, 2.0::DOUBLE * source_size AS ceiling, 2.0::DOUBLE * source_size / weight AS full_at
  FROM (
    SELECT source, sum(size)::BIGINT AS source_size,
           ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight
    FROM d GROUP BY source
  )
), l AS MATERIALIZED (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ()) - coalesce(sum(ceiling) OVER w, 0))
            / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER w, 0)) AS level
  FROM s WINDOW w AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS MATERIALIZED (
  SELECT source, source_size,
         CASE WHEN full_at <= level THEN ceiling ELSE weight * (SELECT arg_min(level, full_at) FROM l WHERE full_at > level) END AS target
  FROM l
), c AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN upto <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""

OP11_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
         list_filter(string_split(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)')) AS q
  FROM pages
), k AS (
  SELECT page_id, host, path, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\.', '') AS site,
         regexp_replace(path, '/$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END AS rest FROM p
), listed AS (
  SELECT DISTINCT site, rest FROM k WHERE site <> '' AND list_has_any(string_split_regex(host, '[.:-]'), ['adult', 'ads', 'bets', 'casino', 'pills', 'porn', 'spam', 'xxx'])
), rules AS (
  SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS r(verdict, rule_host, rule_path)
), fits AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path
)
SELECT page_id, k.host, k.path, rule, coalesce(verdict, CASE WHEN l.site IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM k LEFT JOIN fits f ON k.host = f.host AND k.path = f.path LEFT JOIN listed l ON k.site = l.site AND k.rest = l.rest
"""

OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS MATERIALIZED (
  SELECT r, i, array_to_string(words[i:i + 7], ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM d)
), hit AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT i + j)::BIGINT AS n FROM hit, range(8) AS o(j) GROUP BY r
), m AS MATERIALIZED (
  SELECT doc_id, lang, source, len(words)::BIGINT AS n_words,
         (length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
  FROM d LEFT JOIN rep USING (r)
), f AS MATERIALIZED (
  SELECT *, CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS s1,
         CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS s2,
         CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS s3,
         CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS s4,
         (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed
  FROM m
), v AS (
  SELECT lang, source, unnest([1, 2, 3, 4]) AS sig, unnest([s1, s2, s3, s4]) AS x FROM f WHERE NOT base_failed
), k AS MATERIALIZED (
  SELECT lang, source, sig, (x >> greatest(length(bin(x)) - 6, 0)) << greatest(length(bin(x)) - 6, 0) AS b, count(*) AS n FROM v GROUP BY ALL
), u AS (
  SELECT 1 AS level, lang, source, sig, b, n FROM k
  UNION ALL SELECT 2, lang, NULL, sig, b, sum(n) FROM k GROUP BY lang, sig, b
  UNION ALL SELECT 3, NULL, NULL, sig, b, sum(n) FROM k GROUP BY sig, b
), run AS MATERIALIZED (
  SELECT *, sum(n) OVER w AS n1, sum(n * b::DOUBLE) OVER w AS s1, sum(n * b::DOUBLE * b) OVER w AS q1, sum(n) OVER p AS n_all, sum(n * b::DOUBLE) OVER p AS s_all, sum(n * b::DOUBLE * b) OVER p AS q_all
  FROM u WINDOW p AS (PARTITION BY level, lang, source, sig), w AS (PARTITION BY level, lang, source, sig ORDER BY b ROWS UNBOUNDED PRECEDING)
), cuts AS (
  SELECT *, s1 / n1 AS m1, (s_all - s1) / (n_all - n1) AS m2, q1 / n1 - (s1 / n1) * (s1 / n1) AS v1, (q_all - q1) / (n_all - n1) - ((s_all - s1) / (n_all - n1)) * ((s_all - s1) / (n_all - n1)) AS v2 FROM run WHERE n1 < n_all
), cut AS MATERIALIZED (
  SELECT level, lang, source, sig, arg_max(CASE WHEN (n_all - n1) * 5 <= n_all AND (n_all - n1) * 100 > n_all * CASE WHEN sig = 2 THEN 5 ELSE 1 END AND (m2 - m1) * (m2 - m1) >= 64 * (v1 + v2) THEN b END, (n1 * ((n_all - n1) * ((m2 - m1) * (m2 - m1))), -b)) AS top FROM cuts GROUP BY level, lang, source, sig
), q AS MATERIALIZED (
  SELECT level, lang, source, sig, any_value(n) AS n, 2 * min(b) FILTER (upto * 100 >= kept_n * 5) - min(b) FILTER (upto * 100 >= kept_n * 50) AS least,
         2 * min(b) FILTER (upto * 100 >= kept_n * CASE WHEN sig = 2 THEN 95 ELSE 99 END) - min(b) FILTER (upto * 100 >= kept_n * 50) AS most
  FROM (SELECT r.level, r.lang, r.source, r.sig, r.b, r.n1 AS upto, r.n_all AS n, max(r.n1) OVER (PARTITION BY r.level, r.lang, r.source, r.sig) AS kept_n
        FROM run r LEFT JOIN cut c ON r.level = c.level AND r.lang IS NOT DISTINCT FROM c.lang AND r.source IS NOT DISTINCT FROM c.source AND r.sig = c.sig WHERE top IS NULL OR b <= top)
  GROUP BY level, lang, source, sig
), fence AS MATERIALIZED (
  SELECT p.lang, p.source, s.sig, CASE WHEN g.n >= 200 THEN g.least WHEN gl.n >= 200 THEN gl.least ELSE ge.least END AS least,
         CASE WHEN g.n >= 200 THEN g.most WHEN gl.n >= 200 THEN gl.most ELSE ge.most END AS most
  FROM (SELECT DISTINCT lang, source FROM f) AS p CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS sig) AS s
  LEFT JOIN q AS g ON g.level = 1 AND g.lang IS NOT DISTINCT FROM p.lang AND g.source IS NOT DISTINCT FROM p.source AND g.sig = s.sig
  LEFT JOIN q AS gl ON gl.level = 2 AND gl.lang IS NOT DISTINCT FROM p.lang AND gl.sig = s.sig LEFT JOIN q AS ge ON ge.level = 3 AND ge.sig = s.sig
), wide AS MATERIALIZED (
  SELECT lang, source, max(least) FILTER (sig = 2) AS least, max(most) FILTER (sig = 1) AS f1, max(most) FILTER (sig = 2) AS f2,
         max(most) FILTER (sig = 3) AS f3, max(most) FILTER (sig = 4) AS f4
  FROM fence GROUP BY ALL
), o AS (
  SELECT f.*, (s1 >> greatest(length(bin(s1)) - 6, 0)) << greatest(length(bin(s1)) - 6, 0) <= f1
              AND (s2 >> greatest(length(bin(s2)) - 6, 0)) << greatest(length(bin(s2)) - 6, 0) BETWEEN least AND f2
              AND (s3 >> greatest(length(bin(s3)) - 6, 0)) << greatest(length(bin(s3)) - 6, 0) <= f3
              AND (s4 >> greatest(length(bin(s4)) - 6, 0)) << greatest(length(bin(s4)) - 6, 0) <= f4 AS inside
  FROM f JOIN wide ON f.lang IS NOT DISTINCT FROM wide.lang AND f.source IS NOT DISTINCT FROM wide.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND inside) AS kept FROM o
"""

#: The table of CRC-32, and the CRC of a list of bytes.
_CRC = r"""crc AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)
)"""


def _crc_of(b):
    return f"xor(list_reduce({b}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)"


OP12_SQL = f"""
WITH {_CRC}, runs AS MATERIALIZED (
  SELECT doc_id, w, count(*) AS c FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
  ) WHERE length(w) >= 5 GROUP BY doc_id, w
), bytes AS (
  SELECT w, c, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)) AS b FROM runs
), hashed AS (
  SELECT w, c, {_crc_of('b')} AS h FROM bytes, crc
), words AS MATERIALIZED (
  SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), cut AS MATERIALIZED (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS MATERIALIZED (
  SELECT w.word, w.n, count(other) AS n_near, arg_min(other, (-x.n, other)) AS other, max(x.n) AS other_n FROM words w LEFT JOIN near x ON w.word = x.word GROUP BY w.word, w.n
), forms AS MATERIALIZED (
  SELECT word, n, n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM best
), chain AS (
  WITH RECURSIVE up AS (SELECT word, word AS root FROM forms UNION ALL SELECT up.word, f.form FROM up JOIN forms f ON up.root = f.word WHERE f.form IS NOT NULL)
  SELECT up.word, up.root FROM up JOIN forms f ON up.root = f.word WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN chain USING (word)
"""

OP13_SQL = f"""
WITH {_CRC}, turns AS MATERIALIZED (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, role NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
  SELECT a.conv_id, a.own, b.own AS base, {_crc_of("list_transform(string_split(a.conv_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)")} % 6 AS h
  FROM crc, turns a LEFT JOIN turns b ON b.conv_id = a.conv_id - ((a.conv_id % 100) + 100) % 100
), built AS MATERIALIZED (
  SELECT conv_id, coalesce(base[1:h], []) || own[h + 1:] AS s FROM heads
), members AS MATERIALIZED (
  SELECT conv_id, len(s) AS size, d, s[1:d] AS p FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM built)
), nodes AS MATERIALIZED (
  SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(p[d].t) END AS own
  FROM members GROUP BY p, d
), kids AS (
  SELECT p[1:depth - 1] AS up, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up
), below AS (
  SELECT u.p[1:k] AS p, sum(u.own) AS saved, count(*) FILTER (kids.up IS NULL) AS n_leaves FROM (SELECT *, unnest(range(depth + 1)) AS k FROM nodes) u LEFT JOIN kids ON u.p = kids.up GROUP BY u.p[1:k]
)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n_children, 0) AS n_children, below.n_leaves, below.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below ON n.p = below.p LEFT JOIN kids ON n.p = kids.up LEFT JOIN nodes up ON n.depth > 0 AND up.p = n.p[1:n.depth - 1]
"""


def oracle_sql():
    return {"op8_mix_sources": OP8_SQL, "op9_quality_rules": OP9_SQL, "op11_url_filter": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_prefix_trie": OP13_SQL}
