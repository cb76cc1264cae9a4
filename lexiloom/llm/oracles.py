"""SQL (DuckDB) that gives the rows of the queries in ``queries``, for tests at small scale."""

from __future__ import annotations

_CLEAN_SETS = r"""
sets AS (
  SELECT doc_id, list_distinct(list_transform(list_filter(shingles, lambda x: x IS NOT NULL),
           lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g')))) AS s
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY built_at DESC NULLS LAST) AS k FROM shingles WHERE doc_id IS NOT NULL)
  WHERE k = 1
),
kept AS (SELECT doc_id, s, len(s) AS n FROM sets WHERE len(s) >= 8),
elements AS (SELECT doc_id, n, unnest(s) AS e FROM kept)
"""

_POSTINGS = r"""
raw AS (SELECT DISTINCT term, review_id, tf FROM postings
        WHERE tf >= 1 AND term IS NOT NULL AND trim(term, E' \t\r\n') <> '' AND review_id IN (SELECT review_id FROM reviews)),
tfs AS (SELECT review_id, lower(trim(term, E' \t\r\n')) AS term, CAST(sum(tf) AS BIGINT) AS tf FROM raw GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tfs GROUP BY term),
corpus AS (SELECT count(DISTINCT review_id) AS n FROM tfs)
"""

_RANKED = r"""
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY loaded_at DESC NULLS LAST) AS k FROM reviews WHERE review_id IS NOT NULL)
  WHERE k = 1),
scored AS (
  SELECT upper(trim(product_id, E' \t\r\n')) AS product_id, review_id, score, greatest(coalesce(helpfulness_num, 0), 0) AS help
  FROM latest WHERE product_id IS NOT NULL AND score BETWEEN 1 AND 5)
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[\p{L}\p{Nd}]+')"

_LOWERED = r"list_transform(regexp_extract_all(regexp_replace(text, '[\x{AD}\x{200B}]', '', 'g'), '[\p{L}\p{Nd}]+'), lambda w: lower(w))"

_FAULTS = r"""
base AS (
  SELECT doc_id, text, list_transform(regexp_extract_all(text, '[\p{L}\p{Nd}]+'), lambda w: lower(w)) AS words,
         list_filter(list_transform(string_split(text, chr(10)), lambda l: rtrim(l, E' \t\r')), lambda l: l <> '') AS lines
  FROM documents WHERE text IS NOT NULL),
common AS (SELECT list(DISTINCT lower(word)) AS c FROM common_words WHERE word IS NOT NULL),
stats AS (
  SELECT doc_id, len(words) AS n_words, list_sum(list_transform(words, lambda w: length(w))) AS letters,
         length(text) AS chars, length(regexp_replace(text, '[\p{L}\p{Nd} \t\r\n]', '', 'g')) AS symbols,
         len(lines) AS n_lines, len(list_filter(lines, lambda l: right(l, 1) IN ('.', '!', '?', '"'))) AS ended,
         len(list_filter(words, lambda w: list_contains(c, w))) AS n_common
  FROM base, common)
"""

ORACLES: dict[str, str] = {
    "p1_found": f"""
WITH {_CLEAN_SETS},
overlap AS (SELECT a.doc_id AS doc_lo, b.doc_id AS doc_hi, a.n AS na, b.n AS nb, count(*) AS c
         FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT doc_lo, doc_hi FROM overlap WHERE 2 * c >= na + nb - c
""",
    "p2_found": f"""
WITH {_POSTINGS},
w AS (SELECT review_id, term, round((1 + log10(tf)) * log10(CAST(n AS DOUBLE) / df), 6) AS weight FROM tfs JOIN dfs USING (term), corpus WHERE df >= 2)
SELECT review_id, term FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY weight DESC, term) AS k FROM w WHERE weight > 0) WHERE k <= 3
""",
    "p2_ppmi": f"""
WITH {_POSTINGS},
r AS (SELECT review_id, CAST(sum(tf) AS DOUBLE) AS len FROM tfs GROUP BY review_id),
z AS (SELECT sum(len) AS total, sum(pow(len, 0.75)) AS ctx FROM r),
w AS (SELECT review_id, term, tf, round(greatest(0, log2((tf / total) / ((cf / total) * (pow(len, 0.75) / ctx)))), 6) AS ppmi
      FROM tfs JOIN dfs USING (term) JOIN r USING (review_id), z WHERE df >= 2)
SELECT review_id, term, tf, ppmi, place FROM
  (SELECT *, CAST(row_number() OVER (PARTITION BY review_id ORDER BY ppmi DESC, term) AS INT) AS place FROM w WHERE ppmi > 0) WHERE place <= 3
""",
    "p3_found": r"""
WITH RECURSIVE last AS (
  SELECT doc_id, words FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC NULLS LAST) AS k FROM linedocs WHERE doc_id IS NOT NULL) WHERE k = 1),
bags AS (SELECT doc_id, list_filter(list_transform(list_filter(words, lambda w: w IS NOT NULL), lambda w: regexp_replace(lower(w), '[^\p{L}\p{Nd}]', '', 'g')), lambda w: w <> '') AS w FROM last),
kept AS (SELECT doc_id, w, len(w) AS n FROM bags WHERE len(w) >= 20),
counts AS (SELECT doc_id, n, e, count(*) AS c FROM (SELECT doc_id, n, unnest(w) AS e FROM kept) GROUP BY ALL),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, sum(least(x.c, y.c)) AS i
    FROM counts x JOIN counts y ON x.e = y.e AND x.doc_id <> y.doc_id AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n GROUP BY 1, 2)
  WHERE 5 * i >= 4 * (na + nb - i)),
reach AS (SELECT a AS doc_id, a AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT min(other) AS group_id, doc_id FROM reach GROUP BY doc_id
""",
    "p4_found": f"""
WITH {_RANKED}
SELECT product_id, CAST(place AS INT) AS place, review_id FROM
  (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, help DESC, review_id) AS place FROM scored) WHERE place <= 3
""",
    "p5_found": f"""
WITH {_POSTINGS}
SELECT term, 'rare' AS mark FROM dfs WHERE df = 1
UNION ALL SELECT term, 'common' AS mark FROM dfs, corpus WHERE 20 * df > n
""",
    "p5_terms": f"""
WITH {_POSTINGS}
SELECT term, df, cf, df = 1 AS rare, 20 * df > n AS common FROM dfs, corpus
""",
    "p6_found": r"""
WITH items AS (SELECT item_id, list_transform(regexp_extract_all(regexp_replace(text, '[\x{AD}\x{200B}]', '', 'g'), '[\p{L}\p{Nd}]+'), lambda w: lower(w)) AS w FROM eval_items WHERE text IS NOT NULL),
docs AS (SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(text, '[\x{AD}\x{200B}]', '', 'g'), '[\p{L}\p{Nd}]+'), lambda w: lower(w)) AS w FROM documents WHERE text IS NOT NULL),
i4 AS (SELECT DISTINCT item_id, g FROM (SELECT item_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) AS g FROM items WHERE len(w) >= 4)),
d4 AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) AS g FROM docs WHERE len(w) >= 4)),
i10 AS (SELECT DISTINCT item_id, g FROM (SELECT item_id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i+9], ' '))) AS g FROM items WHERE len(w) >= 10)),
d10 AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i+9], ' '))) AS g FROM docs WHERE len(w) >= 10)),
size AS (SELECT item_id, count(*) AS n FROM i4 GROUP BY 1)
SELECT item_id, doc_id FROM i10 JOIN d10 USING (g)
UNION
SELECT item_id, doc_id FROM (SELECT item_id, doc_id, count(*) AS c FROM i4 JOIN d4 USING (g) GROUP BY 1, 2) JOIN size USING (item_id) WHERE 2 * c >= n
""",
    "p6_matches": rf"""
WITH items AS (SELECT item_id, {_LOWERED} AS w FROM eval_items WHERE text IS NOT NULL),
docs AS (SELECT doc_id, {_LOWERED} AS w FROM documents WHERE text IS NOT NULL),
tok AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM docs),
cf AS (SELECT t, count(*) AS n FROM tok GROUP BY t),
win AS (SELECT item_id, i AS place, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS i FROM items WHERE len(w) >= 4)),
pt AS (SELECT g, k, x.t, coalesce(n, 0) AS n FROM (SELECT DISTINCT g, unnest(string_split(g, ' ')) AS t, unnest([1, 2, 3, 4]) AS k FROM (SELECT DISTINCT g FROM win)) x LEFT JOIN cf ON x.t = cf.t),
rare AS (SELECT g, k AS a, t FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n, k) AS r FROM pt) WHERE r = 1),
cand AS (SELECT g, doc_id, p - a AS s FROM rare JOIN tok USING (t)),
hits AS (SELECT c.g, c.doc_id, c.s, pt.k, bool_or(tok.p = c.s + pt.k) AS at_place FROM cand c JOIN pt ON pt.g = c.g JOIN tok ON tok.doc_id = c.doc_id AND tok.t = pt.t AND tok.p BETWEEN c.s + pt.k - 2 AND c.s + pt.k + 2 GROUP BY ALL),
m AS (SELECT g, doc_id, s, bool_and(at_place) AS exact FROM hits GROUP BY g, doc_id, s HAVING count(*) = 4),
held AS (SELECT item_id, doc_id, count(DISTINCT g) FILTER (WHERE exact) AS windows, count(DISTINCT g) AS near FROM win JOIN m USING (g) GROUP BY ALL),
dia AS (SELECT DISTINCT item_id, doc_id, place, s - place AS d FROM win JOIN m USING (g) WHERE exact),
runs AS (SELECT item_id, doc_id, count(*) + 3 AS n FROM (SELECT *, place - row_number() OVER (PARTITION BY item_id, doc_id, d ORDER BY place) AS r FROM dia) GROUP BY item_id, doc_id, d, r),
best AS (SELECT item_id, doc_id, max(n) AS longest FROM runs GROUP BY ALL),
size AS (SELECT item_id, count(DISTINCT g) AS of_windows FROM win GROUP BY 1),
j AS (SELECT item_id, doc_id, windows, near, of_windows, coalesce(longest, 0) AS longest,
  CASE WHEN longest >= 10 OR 2 * windows >= of_windows THEN 'phrase' WHEN 2 * near >= of_windows THEN 'proximity' END AS match
  FROM held JOIN size USING (item_id) LEFT JOIN best USING (item_id, doc_id))
SELECT * FROM j WHERE match IS NOT NULL
""",
    "p7_found": f"""
WITH t AS (SELECT lower(trim(source, E' \\t\\r\\n')) AS source, sum(target_share) AS share, max(max_repeats) AS cap FROM mix_targets WHERE source IS NOT NULL GROUP BY 1),
s AS (SELECT lower(trim(source, E' \\t\\r\\n')) AS source, sum(len({_WORDS})) AS size FROM documents GROUP BY 1),
j AS (SELECT source, share, cap, coalesce(size, 0) AS size FROM t LEFT JOIN s USING (source)),
k AS (SELECT *, share / sum(share) OVER () * sum(size) OVER () AS target FROM j)
SELECT source, CAST(CASE WHEN size = 0 OR share = 0 THEN 0 ELSE least(cap, ceil(target / size)) END AS INT) AS copies FROM k
""",
    "p8_found": f"""
WITH {_FAULTS}
SELECT doc_id, 'short' AS fault FROM stats WHERE n_words < 15
UNION ALL SELECT doc_id, 'wordlen' FROM stats WHERE n_words >= 15 AND (letters < 3 * n_words OR letters > 8 * n_words)
UNION ALL SELECT doc_id, 'symbols' FROM stats WHERE n_words >= 15 AND 5 * symbols > chars
UNION ALL SELECT doc_id, 'lineends' FROM stats WHERE n_words >= 15 AND n_lines >= 4 AND 5 * ended < 2 * n_lines
UNION ALL SELECT doc_id, 'common' FROM stats WHERE n_words >= 15 AND 20 * n_common < 3 * n_words
""",
    "p8_stats": f"""
WITH {_FAULTS}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, round(CASE WHEN n_words > 0 THEN letters / n_words END, 6) AS mean_word_length,
       round(CASE WHEN chars > 0 THEN symbols / chars END, 6) AS symbol_share, round(CASE WHEN n_lines > 0 THEN ended / n_lines END, 6) AS ended_share,
       round(CASE WHEN n_words > 0 THEN n_common / n_words END, 6) AS common_share, CAST(n_lines AS BIGINT) AS n_lines FROM stats
""",
}
