"""SQL of the training-data queries that SQL can state."""

SUBSTRING_DEDUP = r"""
WITH cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
 word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM cut),
 run AS (SELECT doc_id, start, array_to_string(words[start:start + 19], ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS start FROM cut)),
 again AS (SELECT doc_id, start FROM run QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, start) > 1),
 covered AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS place FROM again),
 kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS kept FROM word ANTI JOIN covered USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM cut LEFT JOIN kept USING (doc_id)
"""

EXACT_TOP_K = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

LEXICAL_SEARCH = r"""
WITH cut AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
 total AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS terms FROM cut WHERE len(terms) > 0),
 asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
 held AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM cut)
  WHERE term IN (SELECT term FROM asked) GROUP BY row, term),
 weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, total GROUP BY term, docs),
 worth AS (SELECT row, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(c.terms) * docs) // total.terms))) AS score
  FROM held JOIN weight USING (term) JOIN cut c USING (row), total),
 summed AS (SELECT item_id, row, sum(score)::BIGINT AS score FROM asked JOIN worth USING (term) GROUP BY item_id, row HAVING sum(score) > 0)
SELECT item_id, (row_number() OVER best)::INTEGER AS rank, doc_id, score FROM summed JOIN cut USING (row)
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 50
"""
