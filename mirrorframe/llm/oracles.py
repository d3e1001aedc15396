"""DuckDB SQL for the queries of this subpackage that SQL can express."""
from mirrorframe.llm import quality

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS winner FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN winner IS DISTINCT FROM page_id AND winner IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN winner IS DISTINCT FROM page_id THEN winner END AS refers_to
FROM m"""

_UNIFORM = "((('0x' || substr(md5({}), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"

MIXING = f"""
WITH s AS (SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY source),
w AS (SELECT *, pow(size::DOUBLE, 0.7) AS weight FROM s),
r AS (SELECT source, CASE WHEN size = 0 THEN 1.0
             ELSE weight / (SELECT sum(weight) FROM w) * (SELECT sum(size) FROM w) / size END AS rate FROM w),
k AS (SELECT source, rate, unnest(range(CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM r),
c AS (SELECT source, rate, list(p ORDER BY k) AS cdf FROM (
        SELECT source, rate, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p
        FROM k) GROUP BY source, rate),
o AS (SELECT d.*, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS own FROM documents d),
n AS (SELECT o.doc_id, o.source, o.text, o.own, rate,
             len(list_filter(cdf, lambda p: p < {_UNIFORM.format("'7:' || own")})) AS n_copies
      FROM o JOIN c ON o.source IS NOT DISTINCT FROM c.source),
e AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM n)
SELECT doc_id, source, copy, n_copies, round(rate, 9) AS rate,
       {_UNIFORM.format("'7/order:' || own || ':' || copy")} AS mix_key, text
FROM e"""

_LIMITS = ", ".join(f"({k}, {v})" for k, v in sorted(quality.NGRAM_LIMITS.items()))



def _windows(k: int) -> str:
    """The k-word windows of table wd as text (words hold no space)."""
    return f"""SELECT * FROM (
    SELECT doc_id, pos, {k} AS k, string_agg(word, ' ') OVER x AS key, count(*) OVER x AS n FROM wd
    WINDOW x AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)) WHERE n = {k}"""


_WD = f"""
b AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
wd AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM b)"""

QUALITY = rf"""
WITH {_WD},
n AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS chars FROM wd GROUP BY doc_id),
ln AS (SELECT doc_id, line, count(*) AS m, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS c
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM b) GROUP BY doc_id, line
       HAVING regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT doc_id, sum(m - 1) AS n_dup, sum((m - 1) * c) AS dup_chars FROM ln GROUP BY doc_id),
lim(k, most) AS (VALUES {_LIMITS}),
i AS ({" UNION ALL ".join(map(_windows, sorted({*quality.NGRAM_LIMITS, quality.REPEAT_WINDOW})))}),
g AS (SELECT doc_id, k, key FROM i GROUP BY ALL HAVING count(*) > 1),
h AS (SELECT DISTINCT doc_id, k, unnest(range(i.pos, i.pos + k)) AS pos FROM i SEMI JOIN g USING (doc_id, k, key)),
cv AS (SELECT doc_id, k, count(*) AS words, sum(length(word)) AS chars FROM h JOIN wd USING (doc_id, pos) GROUP BY ALL),
rp AS (SELECT doc_id, words FROM cv WHERE k = {quality.REPEAT_WINDOW}),
bad AS (SELECT DISTINCT cv.doc_id FROM cv JOIN lim USING (k) JOIN n USING (doc_id) WHERE cv.chars > lim.most * n.chars),
f AS (SELECT b.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n.chars, 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
             coalesce(rp.words, 0) AS n_repeat_words, coalesce(dup_chars, 0) AS dup_chars, bad.doc_id IS NOT NULL AS is_bad
      FROM b LEFT JOIN n USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN rp USING (doc_id)
      LEFT JOIN bad ON bad.doc_id = b.doc_id),
v AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT is_bad AND n_symbols <= {quality.SYMBOL_LIMIT}::DOUBLE * n_words
       AND dup_chars <= {quality.LINE_LIMIT}::DOUBLE * word_chars AS kept
FROM v"""

SUBSTRINGS = rf"""
WITH {_WD},
i AS ({_windows(20)}),
g AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS r FROM i),
h AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos, true AS gone FROM g WHERE r > 1),
x AS (SELECT doc_id, count(*) AS n_words, count(gone) AS n_removed,
             string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone IS NULL) AS kept
      FROM wd LEFT JOIN h USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM b LEFT JOIN x USING (doc_id)"""

_UPPER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 by its table (polynomial EDB88320), made by eight steps from each byte.
TRIE = r"""
WITH RECURSIVE steps(b, c, i) AS (
  SELECT range, range, 0 FROM range(256) UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM steps WHERE i < 8),
crc AS (SELECT list(c ORDER BY b) AS tab FROM steps WHERE i = 8),
t AS (SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS e,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(e ORDER BY pos) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
               string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
               lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h FROM o, crc),
b AS (SELECT h.conv_id, list_concat(coalesce(list_slice(p.own, 1, h), []), list_slice(h.own, h + 1, len(h.own))) AS path
      FROM h LEFT JOIN o p ON p.conv_id = h.conv_id - h.conv_id % 100),
m AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM b),
n AS (SELECT list_slice(path, 1, depth) AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(path) = depth), '') AS ends
      FROM m GROUP BY ALL),
u AS (SELECT *, list_slice(node, 1, depth - 1) AS up, CASE WHEN depth > 0 THEN length(node[-1].t) ELSE 0 END AS size FROM n),
k AS (SELECT up AS node, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY up),
l AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN k USING (node)),
a AS (SELECT list_slice(node, 1, d) AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved
      FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM l) GROUP BY 1)
SELECT l.conv_id, l.depth, p.conv_id AS parent_conv_id, l.n_convs, l.n_children, a.n_leaves,
       a.saved::BIGINT AS saved_tokens, sha256(l.ends) AS ends_sha256
FROM l JOIN a USING (node) LEFT JOIN n p ON l.depth > 0 AND p.node = l.up"""

_TERMS = r"regexp_extract_all(" + _UPPER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
i AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS w FROM benchmark),
q AS (SELECT i, item_id, term, count(*) AS qf FROM (SELECT i, item_id, unnest(w) AS term FROM i) GROUP BY ALL),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
wt AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
       FROM tf, s GROUP BY term),
sc AS (SELECT i, item_id, r, sum(qf * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(w) * n_docs) // n_terms))))::BIGINT AS score
       FROM q JOIN tf USING (term) JOIN wt USING (term) JOIN d USING (r), s GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
      FROM sc JOIN d USING (r) WHERE score > 0)
SELECT * FROM k WHERE rank <= 20"""

JACCARD = rf"""
WITH RECURSIVE b AS (SELECT row_number() OVER () AS r, doc_id,
                            regexp_extract_all({_UPPER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS grams FROM b),
x AS (SELECT r, len(grams) AS n, unnest(grams) AS gram FROM g),
e AS (SELECT a.r AS a, c.r AS b FROM x a JOIN x c ON a.gram = c.gram AND a.r <> c.r
      WHERE 100 * least(a.n, c.n) >= 80 * greatest(a.n, c.n)
      GROUP BY a.r, c.r HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(c.n) - count(*))),
reach AS (SELECT r, r AS o FROM b UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.o)
SELECT g.doc_id, len(grams)::BIGINT AS n_shingles, (SELECT min(c.doc_id) FROM reach JOIN b c ON c.r = reach.o WHERE reach.r = g.r) AS component_id
FROM g"""
