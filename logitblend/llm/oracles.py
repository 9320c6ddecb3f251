"""What SQL can say of the registered queries."""

from __future__ import annotations

from logitblend.llm.decontam import WINDOW
from logitblend.llm.licence_texts import templates
from logitblend.llm.licences import DIGITS, RUNS, THRESHOLD
from logitblend.llm.products import SCALE, TOP
from logitblend.llm.ranking import TOP as RANKED
from logitblend.llm.substring import WINDOW as STRETCH
from logitblend.llm.suffixes import LENGTH

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _folded(text: str) -> str:
    return (
        f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), "
        r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )


DECONTAMINATION = f"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, {_folded("text")} AS w FROM documents),
items AS (SELECT item_id, {_folded("text")} AS w FROM benchmark),
patterns AS (
  SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS k,
         array_to_string(w[i : i + least({WINDOW}, len(w)) - 1], ' ') AS gram
  FROM items, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS t(i)
  WHERE len(w) > 0),
lengths AS (SELECT DISTINCT k FROM patterns),
grams AS (
  SELECT n, i, k, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM docs, lengths, unnest(range(1, len(w) - k + 2)) AS t(i)
  WHERE len(w) >= k),
hits AS (SELECT n, i, k, item_id FROM grams JOIN patterns USING (k, gram)),
places AS (SELECT n, count(DISTINCT place) AS n_hit
           FROM (SELECT n, unnest(range(i, i + k)) AS place FROM hits) GROUP BY n),
found AS (
  SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT n, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN places USING (n) LEFT JOIN found USING (n)
"""

SUBSTRING_DEDUP = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
windows AS (
  SELECT n, doc_id, i, array_to_string(w[i : i + {STRETCH - 1}], ' ') AS gram
  FROM docs, unnest(range(1, len(w) - {STRETCH - 2})) AS t(i)
  WHERE len(w) >= {STRETCH}),
first AS (SELECT gram, min(doc_id) AS d FROM windows GROUP BY gram),
hits AS (SELECT n, i FROM windows JOIN first USING (gram) WHERE d < doc_id),
words AS (
  SELECT n, p, w[p] AS word FROM docs, unnest(range(1, len(w) + 1)) AS t(p)),
marked AS (
  SELECT words.n, p, word,
         bool_or(hits.i IS NOT NULL) OVER (PARTITION BY words.n ORDER BY p
                                           ROWS BETWEEN {STRETCH - 1} PRECEDING AND CURRENT ROW)
           AS gone
  FROM words LEFT JOIN hits ON hits.n = words.n AND hits.i = p),
result AS (
  SELECT n, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept
  FROM marked GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN result USING (n)
"""

SUFFIX_ARRAY_DEDUP = f"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
-- Pieces, as a substring of a long text takes time by the text's length.
pieces AS (
  SELECT n, doc_id, c * {LENGTH} AS start, substr(h, {2 * LENGTH} * c + 1, {4 * LENGTH}) AS piece
  FROM docs, unnest(range(0, (length(h) // 2 + {LENGTH - 1}) // {LENGTH})) AS t(c)),
bytes AS (
  SELECT n, doc_id, start + j AS p, substr(piece, 2 * j + 1, 2) AS b,
         CASE WHEN 2 * (j + {LENGTH}) <= length(piece)
              THEN md5(substr(piece, 2 * j + 1, {2 * LENGTH})) END AS gram
  FROM pieces, unnest(range(0, least({LENGTH}, length(piece) // 2))) AS t(j)),
first AS (
  SELECT gram, min(struct_pack(d := doc_id, p := p)) AS f
  FROM bytes WHERE gram IS NOT NULL AND doc_id IS NOT NULL GROUP BY gram),
starts AS (
  SELECT n, p, b,
         coalesce(f.d < doc_id OR (f.d = doc_id AND f.p < bytes.p), false) AS starts
  FROM bytes LEFT JOIN first USING (gram)),
marked AS (
  SELECT n, p, b,
         bool_or(starts) OVER (PARTITION BY n ORDER BY p
                               ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS gone
  FROM starts),
edges AS (
  SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY n ORDER BY p) AS opens FROM marked),
result AS (
  SELECT n, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
         string_agg(b, '' ORDER BY p) FILTER (WHERE NOT gone) AS kept
  FROM edges GROUP BY n)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM docs LEFT JOIN result USING (n)
"""

_TEMPLATES = ", ".join(
    "({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(templates())
)
_LOWERED = f"translate({{}}, '{_UPPER}', '{_LOWER}')"
_WORDS = f"regexp_extract_all({_LOWERED}, '[a-z0-9]+(?:[.-][a-z0-9]+)*')"
_RUNS = ", ".join(f"({k})" for k in RUNS)

LICENCES = f"""
WITH files AS (
  SELECT row_number() OVER () AS n, page_id,
         regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path,
         coalesce(regexp_replace(html, '<[^>]*>', chr(10), 'g'), '') AS text,
         regexp_matches(html, '(?i)<title>[^<]*licen[cs]e') AS speaks
  FROM pages),
templates(t, name, text) AS (VALUES {_TEMPLATES}),
template_words AS (
  SELECT t, word, count(*) AS c
  FROM (SELECT t, unnest({_WORDS.format("text")}) AS word FROM templates) GROUP BY ALL),
vocabulary AS (SELECT DISTINCT word FROM template_words),
total AS (SELECT count(*) AS files FROM files),
frequency AS (
  SELECT word, count(*) AS df
  FROM (SELECT DISTINCT n, unnest({_WORDS.format("text")}) AS word FROM files) GROUP BY word),
split AS (SELECT n, string_split(text, chr(10)) AS parts FROM files),
numbered AS (
  SELECT n, i, {_WORDS.format("parts[i]")} AS w FROM split, unnest(range(1, len(parts) + 1)) AS s(i)),
lines AS (
  SELECT n, row_number() OVER (PARTITION BY n ORDER BY i) - 1 AS line, w FROM numbered WHERE len(w) > 0),
heights AS (SELECT n, count(*) AS m FROM lines GROUP BY n),
runs AS (
  SELECT n, line, k AS length FROM lines JOIN heights USING (n), (VALUES {_RUNS}) AS r(k) WHERE line + k <= m
  UNION ALL SELECT n, 0, m FROM heights WHERE m NOT IN (SELECT k FROM (VALUES {_RUNS}) AS r(k))),
run_words AS (
  SELECT n, line, length, word, count(*) AS c
  FROM (SELECT r.n, r.line, r.length, unnest(l.w) AS word
        FROM runs r JOIN lines l ON l.n = r.n AND l.line >= r.line AND l.line < r.line + r.length)
  GROUP BY ALL),
weighed AS (
  SELECT n, line, length, word, c * (1 + ln((1 + files) / (1 + df))) AS x,
         word IN (SELECT word FROM vocabulary) AS known
  FROM run_words JOIN frequency USING (word), total),
-- A run is no nearer to a template than to the words of templates.
norms AS (
  SELECT n, line, length, sqrt(sum(x * x)) AS norm FROM weighed GROUP BY n, line, length
  HAVING sum(CASE WHEN known THEN x * x ELSE 0 END) >= 0.63 * sum(x * x)),
template_weights AS (
  SELECT t, word, c * (1 + ln((1 + files) / (1 + coalesce(df, 0)))) AS y
  FROM template_words LEFT JOIN frequency USING (word), total),
template_norms AS (SELECT t, sqrt(sum(y * y)) AS norm FROM template_weights GROUP BY t),
dots AS (
  SELECT n, line, length, t, sum(x * y) AS dot
  FROM weighed SEMI JOIN norms USING (n, line, length) JOIN template_weights USING (word)
  GROUP BY n, line, length, t),
cosines AS (
  SELECT n, line, length, name, round(dot / (r.norm * p.norm), {DIGITS}) AS cosine
  FROM dots JOIN norms r USING (n, line, length) JOIN template_norms p USING (t) JOIN templates USING (t)),
best AS (
  SELECT n, name, cosine FROM cosines WHERE cosine >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY cosine DESC, line, length, name) = 1),
own AS (
  SELECT files.*, string_split(path, '/') AS parts, cosine, name AS licence
  FROM files LEFT JOIN best USING (n)),
spoken AS (
  SELECT array_to_string(parts[1 : len(parts) - 1], '/') AS directory, licence AS theirs
  FROM own WHERE speaks AND licence IS NOT NULL
  QUALIFY row_number() OVER (
    PARTITION BY array_to_string(parts[1 : len(parts) - 1], '/')
    ORDER BY cosine DESC, licence) = 1),
above AS (
  SELECT n, k, array_to_string(parts[1 : k], '/') AS directory
  FROM own, unnest(range(0, len(parts))) AS t(k)
  WHERE licence IS NULL),
nearest AS (
  SELECT n, directory, theirs FROM above JOIN spoken USING (directory)
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY k DESC) = 1)
SELECT page_id, path, coalesce(licence, theirs) AS licence, cosine,
       directory AS inherited_from
FROM own LEFT JOIN nearest USING (n)
"""

PRODUCTS = f"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, max(list_dot_product(q.x, v.x))::BIGINT AS score
  FROM v AS q JOIN v ON v.vec_id <> q.vec_id AND len(v.x) = len(q.x)
  WHERE q.vec_id % 20 = 0 GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank,
       vec_id, score
FROM scored
QUALIFY rank <= {TOP}
"""

_TERMS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

RANKING = f"""
WITH items AS (
  SELECT row_number() OVER () AS i, item_id, list_distinct({_TERMS}) AS terms
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
item_terms AS (SELECT i, unnest(terms) AS term FROM items),
docs AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS terms FROM documents),
whole AS (
  SELECT count(*) AS documents, sum(len(terms))::BIGINT AS length FROM docs WHERE len(terms) > 0),
tf AS (
  SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs)
  SEMI JOIN item_terms USING (term) GROUP BY d, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, whole GROUP BY term, documents),
damping AS (
  SELECT d, doc_id, 100 - 90 + (90 * len(terms) * documents) // length AS m
  FROM docs, whole WHERE len(terms) > 0),
scored AS (
  SELECT i, d, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM item_terms JOIN tf USING (term) JOIN weights USING (term) JOIN damping USING (d)
  GROUP BY i, d),
best AS (
  SELECT i, doc_id, score,
         row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored JOIN docs USING (d) WHERE score > 0
  QUALIFY rank <= {RANKED})
SELECT item_id, rank, doc_id, score FROM best JOIN items USING (i)
"""
