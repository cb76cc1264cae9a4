"""SQL (DuckDB) that gives the rows of the core queries, for tests at small scale."""

from __future__ import annotations

from ..operators.minhash import salt_words

_BLANK = r"E' \t\r\n'"

_REVIEWS = f"""
rv AS (
  SELECT review_id, upper(trim(product_id, {_BLANK})) AS product_id, greatest(coalesce(helpfulness_num, 0), 0) AS helpfulness_num,
         greatest(coalesce(helpfulness_den, 0), 0) AS helpfulness_den, CASE WHEN score BETWEEN 1 AND 5 THEN score END AS score, coalesce(text, '') AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY loaded_at DESC NULLS LAST) AS k FROM reviews WHERE review_id IS NOT NULL) WHERE k = 1)
"""
_INDEX = rf"""{_REVIEWS},
tok AS (SELECT review_id, lower(w) AS term FROM (SELECT review_id, unnest(string_split_regex(text, '\W')) AS w FROM rv) WHERE w <> ''),
pst AS (SELECT term, review_id, count(*) AS tf FROM tok GROUP BY ALL),
lex AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM pst GROUP BY term),
corp AS (SELECT (SELECT count(*) FROM rv) AS n, (SELECT count(*) FROM tok) AS tokens),
meta AS (SELECT rv.*, coalesce(c, 0) AS length FROM rv LEFT JOIN (SELECT review_id, count(*) AS c FROM tok GROUP BY 1) USING (review_id))
"""
_QUERIES = r"""
qw AS (SELECT item_id, list_transform(list_filter(string_split_regex(coalesce(text, ''), '\W'), lambda x: x <> ''), lambda x: lower(x)) AS w FROM eval_items),
qs AS (SELECT item_id AS query_id, unnest(list_concat(w, CASE WHEN item_id % 50 = 0 THEN ['qzxqueryword'] ELSE [] END)) AS term FROM qw),
qt AS (SELECT query_id, term, count(*) AS qtf FROM qs GROUP BY ALL)
"""
#: All tokens of every review whose id is divisible by 50, in the place of ``_QUERIES``.
_REVIEW_QUERIES = """
qs AS (SELECT review_id AS query_id, term FROM tok WHERE review_id % 50 = 0),
qt AS (SELECT query_id, term, count(*) AS qtf FROM qs GROUP BY ALL)
"""


def _weights(idf: str) -> str:
    return f"""
raw AS (SELECT query_id, term, (1 + log10(qtf)) * log10(CAST({idf} AS DOUBLE)) AS w FROM qt JOIN lex USING (term), corp),
wt AS (SELECT query_id, term, CASE WHEN norm = 0 THEN 0 ELSE w / norm END AS weight FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS norm FROM raw))
"""


_WT = _weights("n // df")
_VS = """
vss AS (SELECT query_id, review_id, round(sum(weight * (1 + log10(tf))), 6) AS score FROM pst JOIN wt USING (term) GROUP BY ALL),
vsr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, review_id) AS rank FROM vss)
"""


def _lm(lam: float, name: str) -> str:
    """The product term by term, over a table of candidates by query terms."""
    return f"""
{name}c AS (SELECT DISTINCT query_id, review_id FROM qt JOIN pst USING (term)),
{name}f AS (SELECT c.query_id, c.review_id, q.qtf, {lam} * coalesce(p.tf, 0) / m.length + (1 - {lam}) * coalesce(l.cf, 0) / tokens AS f
  FROM {name}c c JOIN qt q USING (query_id) JOIN meta m USING (review_id) LEFT JOIN lex l ON l.term = q.term LEFT JOIN pst p ON p.term = q.term AND p.review_id = c.review_id, corp),
{name}s AS (SELECT query_id, review_id, CASE WHEN min(f) > 0 THEN round(sum(qtf * log10(CASE WHEN f > 0 THEN f END)), 6) END AS score FROM {name}f GROUP BY ALL),
{name}r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, review_id) AS rank FROM {name}s)
"""


_QUALITY = """CASE WHEN helpfulness_den > 0 AND helpfulness_num / helpfulness_den > 0.33
  THEN score * (1 + CASE WHEN score >= 3 THEN helpfulness_num / helpfulness_den ELSE 1 - helpfulness_num / helpfulness_den END) ELSE CAST(score AS DOUBLE) END"""


def _product_rows(ranked: str) -> str:
    return f"""(SELECT r.query_id, r.rank, r.size, m.product_id, coalesce({_QUALITY.replace("score", "m.score")}, 0) AS q
  FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS size FROM {ranked} WHERE rank <= 20) r JOIN meta m USING (review_id) WHERE m.product_id IS NOT NULL)"""


_PRODUCTS = f"""
pv0 AS (SELECT *, row_number() OVER (PARTITION BY query_id, product_id ORDER BY rank) AS nth FROM {_product_rows("vsr")}),
pv1 AS (SELECT query_id, product_id, round(sum(CASE WHEN nth = 1 THEN (1 - (rank - 1) / size) * q ELSE q END), 6) AS score FROM pv0 GROUP BY ALL),
pv AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM pv1 QUALIFY rank <= 10)
"""
_PRODUCTS_LM = f"""
pl1 AS (SELECT query_id, product_id, round(sum(q), 6) AS score FROM {_product_rows("lmr")} GROUP BY ALL),
pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM pl1 QUALIFY rank <= 10)
"""
_RANK = "query_id, CAST(rank AS INT) AS rank"

_DOCS = rf"""
ld AS (
  SELECT doc_id, list_filter(list_transform(list_filter(words, lambda w: w IS NOT NULL), lambda w: trim(w, {_BLANK})), lambda w: w <> '') AS words
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC NULLS LAST) AS k FROM linedocs WHERE doc_id IS NOT NULL) WHERE k = 1)
"""
_WINDOWS = """
win AS (SELECT doc_id, i, array_to_string(words[i:i+3], ' ') AS shingle, words[i:i+3] AS ws FROM (SELECT doc_id, words, unnest(range(1, len(words) - 2)) AS i FROM ld WHERE len(words) >= 4)),
sh AS (SELECT doc_id, shingle, min(i) AS first, any_value(ws) AS ws FROM win GROUP BY ALL)
"""
_SIGNATURES = """
sg AS (SELECT doc_id, s0, s1, s2, s3 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY built_at DESC NULLS LAST) AS k FROM signatures WHERE doc_id IS NOT NULL)
       WHERE k = 1 AND s0 IS NOT NULL AND s1 IS NOT NULL AND s2 IS NOT NULL AND s3 IS NOT NULL)
"""
_HAM = "(" + " + ".join(f"CAST(bit_count(xor(a.s{k}, b.s{k})) AS INT)" for k in range(4)) + ")"
_ASKED = r"TRY_CAST(regexp_extract(%s, '(\d+)$', 1) AS BIGINT) %% 50 = 0"
def _similar(table: str, items: str, t: str, name: str, queries: str = "") -> str:
    """Pairs of lists, within a table or from a table of queries to it, by counting all their items in common."""
    num, den = {"0.8": (4, 5), "0.7": (7, 10), "0.5": (1, 2)}[t]
    count = lambda n, of: f"{n} AS (SELECT doc_id, n, item, count(*) AS c FROM (SELECT doc_id, len({items}) AS n, unnest({items}) AS item FROM {of}) GROUP BY ALL)"
    return f"""
{count(f"{name}i", table)}, {count(f"{name}q", queries or table)},
{name} AS (SELECT a, b, c / (na + nb - c) AS similarity FROM
  (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, CAST(sum(least(x.c, y.c)) AS BIGINT) AS c
   FROM {name}q x JOIN {name}i y ON x.item = y.item {"" if queries else "AND x.doc_id <> y.doc_id"} GROUP BY 1, 2) WHERE c * {den} >= (na + nb - c) * {num}),
{name}c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort({items})) AS class_id FROM {table})
"""


#: From all pairs of documents (both directions) and their classes: links between classes, links of each document, classes found by a query.
_LINKS = "SELECT x.class_id AS a, y.class_id AS b, round(any_value(similarity), 6) AS similarity, count(*) AS pairs FROM p JOIN pc x ON x.doc_id = p.a JOIN pc y ON y.doc_id = p.b WHERE x.class_id < y.class_id OR (x.class_id = y.class_id AND p.a < p.b) GROUP BY 1, 2"
_MEMBERS = "SELECT doc_id, class_id, coalesce(n, 0) AS links FROM pc LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM p GROUP BY 1) USING (doc_id)"
_FOUND = "SELECT a, class_id AS b, round(any_value(similarity), 6) AS similarity, count(*) AS records FROM p JOIN pc ON pc.doc_id = p.b GROUP BY 1, 2"


def _salts(k: int) -> str:
    return "salts AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{w}')" for i, w in enumerate(salt_words(k))) + ") AS t(k, salt))"


#: Sketches of every document with stored shingles.
_SKETCHES = rf"""
cs AS (SELECT DISTINCT doc_id, trim(regexp_replace(lower(shingle), '[ \t\r\n]+', ' ', 'g')) AS shingle FROM (SELECT doc_id, unnest(shingles) AS shingle
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY built_at DESC NULLS LAST) AS k FROM shingles WHERE doc_id IS NOT NULL) WHERE k = 1)),
{_salts(50)},
sk AS (SELECT doc_id, list(least) AS sketch FROM (SELECT doc_id, k, min(sha256(shingle || ' ' || salt)) AS least FROM cs, salts WHERE shingle <> '' GROUP BY ALL) GROUP BY doc_id)
"""
def _perturbed(words: str) -> str:
    return f"list_transform({words}, lambda w, i: CASE WHEN i <= greatest(0, CAST(ceil(round(len({words}) * (1 - 0.95) / (1 + 0.95), 9)) AS BIGINT) - 1) THEN '**' ELSE w END)"


#: The query set of near-duplicate searches: perturbed documents; shingles of their plain words; sketches of these.
_PROBES = rf"""
qd AS (SELECT doc_id, {_perturbed("words")} AS words FROM ld WHERE {_ASKED % 'doc_id'}),
qp AS (SELECT doc_id, list_filter(list_transform(words, lambda w: regexp_replace(lower(w), '[^\p{{L}}\p{{Nd}}]', '', 'g')), lambda w: w <> '') AS plain FROM ld WHERE {_ASKED % 'doc_id'}),
qc AS (SELECT doc_id, {_perturbed("plain")} AS words FROM qp),
qx AS (SELECT DISTINCT doc_id, array_to_string(words[i:i+3], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, len(words) - 2)) AS i FROM qc WHERE len(words) >= 4))
"""
_PROBE_SKETCHES = "qk AS (SELECT doc_id, list(least) AS sketch FROM (SELECT doc_id, k, min(sha256(shingle || ' ' || salt)) AS least FROM qx, salts GROUP BY ALL) GROUP BY doc_id)"


def _nibbles(shingles: str, name: str) -> str:
    """(doc_id, p, v): majority of the hexadecimal digits' bits over the sha256 of all shingles."""
    return f"""
{name}h AS (SELECT doc_id, p, strpos('0123456789abcdef', substring(h, p, 1)) - 1 AS v FROM (SELECT doc_id, sha256(shingle) AS h, unnest(range(1, 65)) AS p FROM {shingles})),
{name}o AS (SELECT doc_id, p, count(*) AS n, sum((v >> 3) & 1) AS b3, sum((v >> 2) & 1) AS b2, sum((v >> 1) & 1) AS b1, sum(v & 1) AS b0 FROM {name}h GROUP BY ALL),
{name} AS (SELECT doc_id, p, CAST((2 * b3 > n)::INT * 8 + (2 * b2 > n)::INT * 4 + (2 * b1 > n)::INT * 2 + (2 * b0 > n)::INT AS INT) AS v FROM {name}o)
"""


_PROBED = f"""
{_nibbles("qx", "qn")},
sn AS (SELECT doc_id, p, CAST(((CASE (p - 1) // 16 WHEN 0 THEN s0 WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END) >> (60 - 4 * ((p - 1) % 16))) & 15 AS INT) AS v FROM (SELECT *, unnest(range(1, 65)) AS p FROM sg)),
hm AS (SELECT a, b, 1 - h / 256 AS similarity, h FROM (SELECT x.doc_id AS a, y.doc_id AS b, CAST(sum(bit_count(xor(x.v, y.v))) AS BIGINT) AS h FROM qn x JOIN sn y USING (p) GROUP BY 1, 2)),
pc AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s0, s1, s2, s3) AS class_id FROM sg)
"""
#: All pairs of stored signatures within 25 bits, and the classes of equal ones.
_SIGNATURE_PAIRS = f"""
p AS (SELECT a.doc_id AS a, b.doc_id AS b, 1 - {_HAM} / 256 AS similarity FROM sg a JOIN sg b ON a.doc_id <> b.doc_id WHERE {_HAM} <= 25),
pc AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s0, s1, s2, s3) AS class_id FROM sg)
"""


def _minhash(function: str) -> str:
    return f"WITH {_DOCS}, {_WINDOWS}, {_salts(50)} SELECT doc_id, CAST(k AS BIGINT) AS k, min({function}(shingle || ' ' || salt)) AS least FROM sh, salts GROUP BY ALL"


_PERTURBED = """
pd AS (SELECT doc_id, words, len(words) AS n, greatest(0, CAST(ceil(round(len(words) * (1 - 0.8) / (1 + 0.8), 9)) AS BIGINT) - 1) AS r FROM ld),
pt AS (SELECT doc_id, r, words, list_transform(words, lambda w, i: CASE WHEN i <= r THEN '**' ELSE w END) AS changed FROM pd)
"""

_TRIALS = f"""
WITH {_DOCS}, {_salts(200)}, ts AS (SELECT * FROM (VALUES ('1', 1::DOUBLE), ('0.9', 0.9::DOUBLE), ('0.7', 0.7::DOUBLE), ('0.5', 0.5::DOUBLE), ('0.3', 0.3::DOUBLE)) AS v(t, tv)), ks AS (SELECT unnest([3, 10, 20, 50, 100, 200]) AS kk),
pd AS (SELECT doc_id, t, words, greatest(0, CAST(ceil(round(len(words) * (1 - tv) / (1 + tv), 9)) AS BIGINT) - 1) AS r FROM ld, ts),
pt AS (SELECT doc_id, t, list_transform(words, lambda w, i: CASE WHEN i <= r THEN '**' ELSE w END) AS w FROM pd UNION ALL SELECT doc_id, 'own', words FROM ld),
x AS (SELECT DISTINCT doc_id, t, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT doc_id, t, w, unnest(range(1, len(w) - 2)) AS i FROM pt WHERE len(w) >= 4)),
n AS (SELECT doc_id, t, count(*) AS n FROM x GROUP BY ALL),
i AS (SELECT a.doc_id, b.t, count(*) AS c FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.g = b.g AND a.t = 'own' AND b.t <> 'own' GROUP BY ALL),
truth AS (SELECT a.doc_id, b.t, coalesce(c, 0) / (a.n + b.n - coalesce(c, 0)) AS truth FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.t = 'own' AND b.t <> 'own' LEFT JOIN i ON i.doc_id = b.doc_id AND i.t = b.t),
m AS (SELECT doc_id, t, k, min(sha256(g || ' ' || salt)) AS h FROM x, salts GROUP BY ALL),
mc AS (SELECT doc_id, t, kk, h, count(*) AS c FROM m JOIN ks ON m.k < kk GROUP BY ALL),
est AS (SELECT a.doc_id, b.t, a.kk, CAST(sum(least(a.c, b.c)) AS BIGINT) AS m FROM mc a JOIN mc b ON a.doc_id = b.doc_id AND a.kk = b.kk AND a.h = b.h AND a.t = 'own' AND b.t <> 'own' GROUP BY ALL),
trials AS (SELECT truth.t, ks.kk AS k, truth, coalesce(m, 0) / (2 * ks.kk - coalesce(m, 0)) AS estimate
  FROM truth CROSS JOIN ks LEFT JOIN est ON est.doc_id = truth.doc_id AND est.t = truth.t AND est.kk = ks.kk)
"""

ORACLES: dict[str, str] = {
    "tokenize_lengths": f"WITH {_INDEX} SELECT review_id, length FROM meta",
    "cropped_terms": r"""
SELECT doc_id, CASE WHEN length(t) > 127 THEN substring(t, 1, 126) ELSE t END AS term FROM
  (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '\W', '', 'g')) AS t FROM documents) WHERE t <> ''
""",
    "review_blocks": r"""
WITH b AS (SELECT doc_id, unnest(string_split(text, 'product/productId: ')) AS v, generate_subscripts(string_split(text, 'product/productId: '), 1) - 1 AS block FROM documents WHERE contains(text, 'product/productId: ')),
f AS (SELECT doc_id, block, v, trim(regexp_extract(v, '(?m)^review/helpfulness: (.*)$', 1), E' \t\r') AS h, trim(regexp_extract(v, '(?m)^review/score: (.*)$', 1), E' \t\r') AS s FROM b WHERE block > 0)
SELECT doc_id, CAST(block AS INT) AS block, nullif(trim(regexp_extract(v, '\A([^\n]*)', 1), E' \t\r'), '') AS product_id,
  TRY_CAST(nullif(regexp_extract(h, '^\s*(\d+)\s*/\s*(\d+)\s*$', 1), '') AS INT) AS helpfulness_num, TRY_CAST(nullif(regexp_extract(h, '^\s*(\d+)\s*/\s*(\d+)\s*$', 2), '') AS INT) AS helpfulness_den,
  TRY_CAST(substring(s, 1, 1) AS INT) AS score, trim(regexp_replace(regexp_extract(v, '(?ms)^review/text: (.*)\z', 1), '\s*\n\s*', ' ', 'g')) AS text
FROM f
""",
    "sgml_bodies": r"""
WITH b AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?is)<body>(.*?)</body>', 1)) AS body, generate_subscripts(regexp_extract_all(text, '(?is)<body>(.*?)</body>', 1), 1) AS part FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, part, regexp_extract_all(lower(regexp_replace(body, '(?s)<[^>]*>', ' ', 'g')), '[\p{L}\p{N}_]+') AS words FROM b)
SELECT doc_id, CAST(part AS INT) AS part, CAST(len(words) AS BIGINT) AS n_words, coalesce(array_to_string(words, ' '), '') AS words FROM w
""",
    "line_documents": r"""
WITH l AS (SELECT line_no, doc_id, array_to_string(list_filter(words, lambda w: w IS NOT NULL), ' ') AS rest, len(list_filter(words, lambda w: w IS NOT NULL)) AS n
           FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS k FROM linedocs WHERE doc_id IS NOT NULL AND words IS NOT NULL) WHERE k = 1),
w AS (SELECT doc_id, CASE WHEN n = 0 THEN [] ELSE string_split(rtrim(rest, chr(13) || chr(10)), ' ') END AS words FROM l)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(array_to_string(words, ' '), '') AS words FROM w
""",
    "file_reviews": rf"""
WITH {_REVIEWS} SELECT nullif(product_id, '') AS product_id, helpfulness_num, helpfulness_den, coalesce(score, -1) AS score, trim(regexp_replace(text, '\s*\n\s*', ' ', 'g')) AS text FROM rv
""",
    "file_linedocs": f"""
WITH {_DOCS}, w AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE string_split(array_to_string(words, ' '), ' ') END AS words FROM ld)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(array_to_string(words, ' '), '') AS words FROM w
""",
    "file_sgml": rf"""
WITH {_DOCS}, w AS (SELECT regexp_extract_all(lower(regexp_replace(coalesce(array_to_string(words, ' '), ''), '(?s)<[^>]*>', ' ', 'g')), '[\p{{L}}\p{{N}}_]+') AS words FROM ld)
SELECT CAST(len(words) AS BIGINT) AS n_words, coalesce(array_to_string(words, ' '), '') AS words FROM w
""",
    "review_quality": f"WITH {_REVIEWS} SELECT review_id, round({_QUALITY}, 6) AS quality FROM rv",
    "perturb_docs": f"WITH {_DOCS}, {_PERTURBED} SELECT doc_id, CAST(len(list_filter(changed, lambda w: w = '**')) AS BIGINT) AS replaced, coalesce(array_to_string(changed, ' '), '') AS words FROM pt",
    "term_freqs": f"WITH {_INDEX} SELECT term, review_id, tf FROM pst",
    "lexicon": f"WITH {_INDEX} SELECT term, df, cf FROM lex",
    "corpus_stats": f"WITH {_INDEX} SELECT n AS n_reviews, tokens AS n_tokens FROM corp",
    "top_terms": f"WITH {_INDEX} SELECT term, df, cf FROM lex ORDER BY cf DESC, term LIMIT 20",
    "posting_blocks": f'WITH {_INDEX} SELECT term, review_id // 65536 AS block, count(*) AS n, min(review_id) AS "first", max(review_id) AS "last" FROM pst GROUP BY ALL',
    "postings_delta": f"""
WITH {_INDEX} SELECT term, review_id // 65536 AS block, CAST(row_number() OVER (PARTITION BY term, review_id // 65536 ORDER BY review_id) AS INT) AS seq,
  review_id - coalesce(lag(review_id) OVER (PARTITION BY term ORDER BY review_id), 0) AS gap, tf FROM pst
""",
    "postings_decode": f"WITH {_INDEX} SELECT term, review_id, tf FROM pst",
    "postings_varint": f"WITH {_INDEX} SELECT term, review_id, tf FROM pst",
    "product_runs": f"""
WITH {_REVIEWS}, f AS (SELECT review_id, product_id, CASE WHEN row_number() OVER (ORDER BY review_id) > 1 AND product_id IS NOT DISTINCT FROM lag(product_id) OVER (ORDER BY review_id) THEN 0 ELSE 1 END AS new FROM rv),
r AS (SELECT *, sum(new) OVER (ORDER BY review_id ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT any_value(product_id) AS product_id, min(review_id) AS first_review, max(review_id) AS last_review FROM r GROUP BY run
""",
    "segment_merge": f"WITH {_INDEX} SELECT term, df, cf FROM lex",
    "lexicon_merge": f"""
SELECT term, CAST(coalesce(sum(df), 0) AS BIGINT) AS df, CAST(coalesce(sum(cf), 0) AS BIGINT) AS cf FROM
  (SELECT lower(trim(term, {_BLANK})) AS term, df, cf FROM (SELECT DISTINCT chunk_id, term, df, cf FROM lexicon WHERE term IS NOT NULL AND chunk_id IS NOT NULL)) WHERE term <> '' GROUP BY term
""",
    "review_lookup": f"""
WITH {_INDEX}, p AS (SELECT review_id FROM postings WHERE review_id IS NOT NULL UNION SELECT 0 UNION SELECT -2)
SELECT review_id, product_id, coalesce(score, -1) AS score, coalesce(helpfulness_num, -1) AS helpfulness_num, coalesce(helpfulness_den, -1) AS helpfulness_den, coalesce(length, -1) AS length
FROM p LEFT JOIN meta USING (review_id)
""",
    "product_reviews": f"""
WITH {_REVIEWS} SELECT product_id, review_id FROM rv WHERE product_id IN (SELECT upper(trim(product_id, {_BLANK})) FROM documents WHERE product_id IS NOT NULL)
""",
    "posting_lookup": f"WITH {_INDEX}, {_QUERIES} SELECT term, review_id, tf FROM pst WHERE term IN (SELECT term FROM qs)",
    "stored_index_lookup": f"WITH {_INDEX}, {_QUERIES} SELECT term, review_id, tf FROM pst WHERE term IN (SELECT term FROM qs)",
    "stored_lexicon": f"WITH {_INDEX} SELECT term, df, cf FROM lex",
    "stored_reviews": f"WITH {_INDEX} SELECT review_id, product_id, helpfulness_num, helpfulness_den, coalesce(score, -1) AS score, length FROM meta",
    "index_sizes": f"""
WITH {_INDEX} SELECT 'reviews' AS name, count(*) AS rows, CAST(coalesce(sum(length(product_id)), 0) AS BIGINT) AS chars FROM meta
UNION ALL SELECT 'postings', count(*), CAST(coalesce(sum(length(term)), 0) AS BIGINT) FROM pst
UNION ALL SELECT 'lexicon', count(*), CAST(coalesce(sum(length(term)), 0) AS BIGINT) FROM lex
UNION ALL SELECT 'corpus', 1, 0
""",
    "df_lookup": f"WITH {_INDEX}, {_QUERIES} SELECT term, coalesce(df, 0) AS df FROM (SELECT DISTINCT term FROM qs) LEFT JOIN lex USING (term)",
    "cf_lookup": f"WITH {_INDEX}, {_QUERIES} SELECT term, coalesce(cf, 0) AS cf FROM (SELECT DISTINCT term FROM qs) LEFT JOIN lex USING (term)",
    "query_weights": f"WITH {_INDEX}, {_QUERIES}, {_WT} SELECT query_id, term, round(weight, 6) AS weight FROM wt",
    "query_weights_exact": f"WITH {_INDEX}, {_QUERIES}, {_weights('n / df')} SELECT query_id, term, round(weight, 6) AS weight FROM wt",
    "vector_space_topk": f"WITH {_INDEX}, {_QUERIES}, {_WT}, {_VS} SELECT {_RANK}, review_id, score FROM vsr WHERE rank <= 10",
    "language_model_topk": f"WITH {_INDEX}, {_QUERIES}, {_lm(0.5, 'lm')} SELECT {_RANK}, review_id, score FROM lmr WHERE rank <= 10",
    "product_topk_vs": f"WITH {_INDEX}, {_QUERIES}, {_WT}, {_VS}, {_PRODUCTS} SELECT {_RANK}, product_id, score FROM pv",
    "product_topk_lm": f"WITH {_INDEX}, {_QUERIES}, {_lm(0.2, 'lm')}, {_PRODUCTS_LM} SELECT {_RANK}, product_id, score FROM pl",
    "product_search": f"""
WITH {_INDEX}, {_QUERIES}, {_WT}, {_VS}, {_lm(0.2, 'lm')}, {_PRODUCTS}, {_PRODUCTS_LM},
m AS (SELECT query_id, least(v, l) AS most FROM (SELECT query_id, count(*) AS v FROM pv GROUP BY 1) JOIN (SELECT query_id, count(*) AS l FROM pl GROUP BY 1) USING (query_id)),
u AS (SELECT query_id, product_id, score FROM pv JOIN m USING (query_id) WHERE rank <= most UNION ALL SELECT query_id, product_id, score FROM pl JOIN m USING (query_id) WHERE rank <= most),
s AS (SELECT query_id, product_id, round(sum(score), 6) AS score FROM u GROUP BY ALL)
SELECT {_RANK}, product_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM s) JOIN m USING (query_id) WHERE rank <= most
""",
    "shingles": f"WITH {_DOCS}, {_WINDOWS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS pos, shingle FROM sh",
    "shingles_sorted": f"WITH {_DOCS}, {_WINDOWS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ws) - 1 AS pos, shingle FROM sh",
    "minhash_sha256": _minhash("sha256"),
    "minhash_md5": _minhash("md5"),
    "minhash_similar": f"WITH {_SKETCHES}, {_similar('sk', 'sketch', '0.8', 'p')} {_LINKS}",
    "minhash_members": f"WITH {_SKETCHES}, {_similar('sk', 'sketch', '0.8', 'p')} {_MEMBERS}",
    "minhash_search": f"WITH {_DOCS}, {_PROBES}, {_SKETCHES}, {_PROBE_SKETCHES}, {_similar('sk', 'sketch', '0.5', 'p', 'qk')} {_FOUND}",
    "word_jaccard": f"WITH {_DOCS}, {_similar('ld', 'words', '0.7', 'p')} {_LINKS}",
    "word_jaccard_members": f"WITH {_DOCS}, {_similar('ld', 'words', '0.7', 'p')} {_MEMBERS}",
    "simhash_bits": f"""
WITH {_DOCS}, {_WINDOWS}, {_nibbles("sh", "nb")}
SELECT doc_id, string_agg(substring('0123456789abcdef', v + 1, 1), '' ORDER BY p) AS signature FROM nb GROUP BY doc_id
""",
    "simhash_hamming_pairs": f"WITH {_DOCS}, {_PROBES}, {_SIGNATURES}, {_PROBED} SELECT a, b, round(similarity, 6) AS similarity FROM hm WHERE h <= 76",
    "simhash_block_search": f"WITH {_DOCS}, {_PROBES}, {_SIGNATURES}, {_PROBED}, p AS (SELECT * FROM hm WHERE h <= 25) {_FOUND}",
    "simhash_block_pairs": f"WITH {_SIGNATURES}, {_SIGNATURE_PAIRS} {_LINKS}",
    "simhash_block_members": f"WITH {_SIGNATURES}, {_SIGNATURE_PAIRS} {_MEMBERS}",
    "minhash_error": f"""
{_TRIALS} SELECT t, k, count(*) AS trials, round(avg(abs(truth - estimate)), 6) AS mean_error FROM trials GROUP BY ALL
""",
    "minhash_accuracy": f"""
{_TRIALS} SELECT t, k, count(*) AS trials, round(100 * avg(CASE WHEN estimate >= round(CAST(t AS DOUBLE) - 0.1, 9) THEN 1.0 ELSE 0.0 END), 2) AS percent FROM trials GROUP BY ALL
""",
    "sketch_over_threshold": f"""
WITH {_DOCS}, {_PROBES}, {_SKETCHES}, {_PROBE_SKETCHES},
i AS (SELECT doc_id, h, count(*) AS c FROM (SELECT doc_id, unnest(sketch) AS h FROM sk) GROUP BY ALL), q AS (SELECT doc_id, h, count(*) AS c FROM (SELECT doc_id, unnest(sketch) AS h FROM qk) GROUP BY ALL),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, CAST(sum(least(x.c, y.c)) AS BIGINT) AS m FROM q x JOIN i y ON x.h = y.h GROUP BY 1, 2)
SELECT a, b, round(m / (100 - m), 6) AS similarity FROM o WHERE m / (100 - m) >= 0.03
""",
    "streamed_lexicon": f"WITH {_INDEX} SELECT term, df, cf FROM lex",
    "recall_precision": f"""
WITH {_DOCS}, {_PROBES}, {_SKETCHES}, {_PROBE_SKETCHES}, {_similar('sk', 'sketch', '0.5', 'f', 'qk')}, {_similar('ld', 'words', '0.5', 't', 'qd')},
j AS (SELECT coalesce(f.a, t.a) AS a, f.a IS NOT NULL AS inf, t.a IS NOT NULL AS int_ FROM f FULL JOIN t ON f.a = t.a AND f.b = t.b),
c AS (SELECT a, count(*) FILTER (WHERE inf AND int_) AS true_positives, count(*) FILTER (WHERE inf AND NOT int_) AS false_positives, count(*) FILTER (WHERE NOT inf AND int_) AS false_negatives FROM j GROUP BY a)
SELECT *, round(CASE WHEN true_positives + false_negatives > 0 THEN true_positives / (true_positives + false_negatives) END, 6) AS recall,
  round(CASE WHEN true_positives + false_positives > 0 THEN true_positives / (true_positives + false_positives) END, 6) AS precision FROM c
""",
    "pearson": f"WITH {_INDEX} SELECT count(*) AS n, round(corr(CAST(length AS DOUBLE), CAST(score AS DOUBLE)), 6) AS r FROM meta WHERE score IS NOT NULL",
    "sample_docs": f"WITH {_DOCS} SELECT doc_id FROM ld ORDER BY md5('1-' || doc_id), doc_id LIMIT 100",
    "helpful_accuracy": f"WITH {_REVIEWS} SELECT count(*) AS trials, round(100 * avg(CASE WHEN 2 * helpfulness_num > helpfulness_den THEN 1.0 ELSE 0.0 END), 2) AS percent FROM rv WHERE helpfulness_den > 0",
}
ORACLES |= {f"{name}_reviews": sql.replace(_QUERIES, _REVIEW_QUERIES) for name, sql in ORACLES.items() if _QUERIES in sql}
