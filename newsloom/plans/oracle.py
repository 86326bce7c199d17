"""The registered queries in DuckDB SQL, written from the semantics, not from the plans."""

from __future__ import annotations

from newsloom import fixed_values as fv

RAW = """raw AS (
  SELECT doc_id AS id, source || '/' || lang || '/' || doc_id AS title, 'doc://' || doc_id AS link,
    TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS published_at,
    text AS summary, source AS publisher, text AS content
  FROM documents)"""

METADATA = """metadata AS (
  SELECT event_id AS id, event_id AS news_id, event_type || ' ' || event_id AS title,
    ts AS published_at, 'u' || user_id AS publisher, event_type AS category
  FROM events)"""

WHITE = r"[\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

IN_RANGE = (
    "published_at >= TIMESTAMP '2024-01-05' AND published_at <= TIMESTAMP '2024-01-20 23:59:59.999999'"
)


def chunks(news_id: str = "vec_id") -> str:
    return f"""chunks AS (
  SELECT vec_id AS id, CAST({news_id} AS BIGINT) AS news_id,
    'vector ' || vec_id || ' of label ' || label AS chunk_text, embedding,
    '{{"news_id":' || {news_id} || ',"title":"vector ' || vec_id || '","publisher":"label ' || label || '"}}' AS metadata
  FROM embeddings)"""


def hashed(table: str, keys: str) -> str:
    """Tokens hashed into 64 buckets, every bucket of every text."""
    names = ", ".join(f"t.{k.strip()}" for k in keys.split(","))
    return f"""tokens AS (
  SELECT {keys}, unnest(string_split(text, ' ')) AS token FROM {table}),
counted AS (
  SELECT {keys}, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 64 AS dim, count(*) AS n
  FROM tokens WHERE token <> '' GROUP BY ALL),
grid AS (
  SELECT {names}, CAST(d.dim AS INTEGER) AS dim, coalesce(c.n, 0) AS n
  FROM {table} t CROSS JOIN (SELECT unnest(range(64)) AS dim) d
  LEFT JOIN counted c ON c.dim = d.dim AND {" AND ".join(f"c.{k.strip()} = t.{k.strip()}" for k in keys.split(","))})"""


QUESTIONS = f"""{hashed("benchmark", "item_id")},
questions AS (
  SELECT item_id AS query_id, list(CAST(n AS DOUBLE) ORDER BY dim) AS embedding FROM grid GROUP BY item_id)"""

SCORED = """
scored AS (
  SELECT q.query_id, c.id, c.news_id, c.chunk_text, c.metadata,
    CASE WHEN list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]) > 0
      AND list_dot_product(q.embedding, q.embedding) > 0
      THEN list_cosine_similarity(c.embedding::DOUBLE[], q.embedding) END AS similarity
  FROM questions q, chunks c WHERE c.embedding IS NOT NULL),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, id) AS INTEGER) AS rank
  FROM scored),
hits AS (SELECT * FROM ranked WHERE rank <= 5)"""


def hits(news_id: str = "vec_id") -> str:
    """Every question against every vector, the best five of each."""
    return f"""{chunks(news_id)}, {QUESTIONS}, {SCORED}"""


ENRICHED = f"""{RAW}, {hits("label")},
covered AS (SELECT query_id, count(DISTINCT news_id) AS articles FROM hits GROUP BY query_id),
enriched AS (
  SELECT h.*, CASE WHEN v.articles <= 2 THEN coalesce(r.content, '') ELSE '' END AS full_article, r.link
  FROM hits h JOIN covered v USING (query_id) LEFT JOIN raw r ON r.id = h.news_id)"""


def json_text(column: str) -> str:
    return f"CAST(to_json({column}) AS VARCHAR)"


CONTEXT = f"""{ENRICHED},
context AS (
  SELECT query_id, count(*) AS hits, '[' || string_agg(
    '{{"news_id":' || news_id
    || ',"similarity":' || CAST(CAST(round(similarity, 6) AS DECIMAL(9, 6)) AS VARCHAR)
    || ',"chunk_text":' || {json_text("chunk_text")}
    || ',"full_article":' || {json_text("full_article")}
    || ',"link":' || coalesce({json_text("link")}, 'null')
    || ',"meta_data":' || metadata || '}}', ',' ORDER BY rank) || ']' AS context
  FROM enriched GROUP BY query_id)"""

SENTENCES = rf"""pieces AS (
  SELECT doc_id AS news_id, unnest(string_split_regex(text, '[.!?]')) AS piece,
    generate_subscripts(string_split_regex(text, '[.!?]'), 1) AS spot
  FROM documents),
sentences AS (
  SELECT news_id, spot, regexp_replace(regexp_replace(piece, '^{WHITE}+', ''), '{WHITE}+$', '') AS sentence
  FROM pieces),
numbered AS (
  SELECT news_id, sentence, row_number() OVER (PARTITION BY news_id ORDER BY spot) AS n
  FROM sentences WHERE sentence <> '')"""

# One step per sentence: the running chunk, and the chunk closed by this step, if any.
CHUNKED = f"""{SENTENCES},
steps AS (
  SELECT news_id, n, sentence || '。' AS cur, CAST(NULL AS VARCHAR) AS closed
  FROM numbered WHERE n = 1 AND length(sentence) <= 300
  UNION ALL
  SELECT news_id, n, sentence, NULL FROM numbered WHERE n = 1 AND length(sentence) > 300
  UNION ALL
  SELECT s.news_id, s.n,
    CASE WHEN length(p.cur) + length(s.sentence) > 300 THEN right(p.cur, 50) || s.sentence
         ELSE p.cur || s.sentence || '。' END,
    CASE WHEN length(p.cur) + length(s.sentence) > 300 THEN p.cur END
  FROM steps p JOIN numbered s ON s.news_id = p.news_id AND s.n = p.n + 1),
finished AS (
  SELECT news_id, n, closed AS chunk_text FROM steps WHERE closed IS NOT NULL
  UNION ALL
  SELECT news_id, n + 1, cur FROM steps QUALIFY row_number() OVER (PARTITION BY news_id ORDER BY n DESC) = 1),
chunked AS (
  SELECT news_id, chunk_text, CAST(NULL AS VARCHAR) AS status,
    CAST(row_number() OVER (PARTITION BY news_id ORDER BY n) - 1 AS INTEGER) AS chunk_idx
  FROM finished
  UNION ALL
  SELECT doc_id, NULL, 'no_content', 0 FROM documents
  WHERE doc_id NOT IN (SELECT news_id FROM numbered))"""

# Paragraphs that are open at a text: the running count of <p> and </p>, never below none.
BODY = r"""article AS (
  SELECT page_id, regexp_extract_all(
    regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '(?s)<[^>]*>|[^<]+') AS tokens
  FROM pages),
tokens AS (
  SELECT page_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS spot FROM article),
moves AS (
  SELECT *, CASE WHEN regexp_matches(token, '^<p[ >]') THEN 1 WHEN token = '</p>' THEN -1 ELSE 0 END AS move
  FROM tokens),
summed AS (SELECT *, sum(move) OVER (PARTITION BY page_id ORDER BY spot) AS level FROM moves),
depths AS (
  SELECT *, level - least(0, min(level) OVER (PARTITION BY page_id ORDER BY spot)) AS depth FROM summed),
texts AS (
  SELECT page_id, string_agg(
    replace(replace(replace(replace(token, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'),
    '' ORDER BY spot) AS content
  FROM depths WHERE depth > 0 AND token NOT LIKE '<%' GROUP BY page_id)"""

BATCHED = f"""{RAW},
placed AS (
  SELECT id, id // 480 AS bucket, '標題：' || title || '; 摘要：' || summary AS line,
    (row_number() OVER (PARTITION BY id // 480 ORDER BY id) - 1) // 15 AS batch
  FROM raw),
batches AS (
  SELECT bucket, batch, CAST(count(*) AS INTEGER) AS articles,
    '[' || string_agg('{{"id":' || id || ',"summary":' || {json_text("line")} || '}}', ',' ORDER BY id)
      || ']' AS items
  FROM placed GROUP BY bucket, batch)"""

CATEGORY = """CASE WHEN contains(line, 'que') THEN '生活' WHEN contains(line, 'sch') THEN '國際'
    WHEN contains(line, 'the') THEN '科技' ELSE '社會' END"""


REFERENCES = f"""{RAW}, {hits("label")},
linked AS (
  SELECT h.query_id, CAST(h.rank - 1 AS INTEGER) AS place, h.news_id, 'vector ' || h.id AS title,
    'label ' || h.news_id AS publisher, coalesce(r.link, '#') AS link, h.chunk_text
  FROM hits h LEFT JOIN raw r ON r.id = h.news_id
  WHERE h.query_id IN (SELECT doc_id FROM documents))"""

ORACLE: dict[str, str] = {
    "read_query": f"""WITH {METADATA}
SELECT category, publisher, count(*) AS articles FROM metadata GROUP BY category, publisher""",
    "attach_pages": f"""WITH {RAW},
feed AS (SELECT title, link FROM raw UNION ALL SELECT 'page ' || page_id, url FROM pages)
SELECT f.title, f.link, CAST(length(p.html) AS VARCHAR) AS page_length
FROM feed f LEFT JOIN pages p ON p.url = f.link""",
    "full_articles": f"""WITH {RAW}
SELECT id, content FROM raw WHERE id IN (SELECT vec_id FROM embeddings)""",
    "read_feed": f"""WITH {RAW}
SELECT title || CASE WHEN id % 3 = 0 THEN chr(160) ELSE ' ' END || '& é中' AS title, link || '?a=1&b' AS link,
  published_at, content AS summary FROM raw""",
    "read_feed_files": f"""WITH {RAW}
SELECT title || ' <item> & ' AS title, link, published_at, content || '</item> <<!-- ' AS summary FROM raw""",
    "parse_feed_date": """SELECT event_id AS news_id, CASE event_id % 4 WHEN 1 THEN date_trunc('minute', ts)
  WHEN 3 THEN NULL ELSE date_trunc('second', ts) END AS published_at FROM events""",
    "append_new": f"""WITH {RAW}
SELECT id, link, title FROM raw WHERE link NOT IN (SELECT 'doc://' || doc_id FROM labels)""",
    "insert_if_absent": """WITH turns AS (
  SELECT CASE WHEN conv_id % 7 <> 3 THEN conv_id END AS news_id, turn, role, text FROM conversations)
SELECT * FROM turns WHERE news_id IS NULL
UNION ALL
(SELECT * FROM turns t
WHERE news_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.news_id)
QUALIFY row_number() OVER (PARTITION BY news_id ORDER BY turn) = 1)""",
    "update_by_key": f"""WITH {RAW},
latest AS (SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id)
SELECT r.id, r.title, CASE WHEN l.conv_id IS NULL THEN r.publisher ELSE l.text END AS publisher
FROM raw r LEFT JOIN latest l ON l.conv_id = r.id""",
    "append_new_table": f"""WITH {RAW}
SELECT 'doc://' || doc_id AS link, 'old' AS title, CAST(0 AS BIGINT) AS added_again FROM labels
UNION ALL SELECT link, title, 0 FROM raw WHERE link NOT IN (SELECT 'doc://' || doc_id FROM labels)""",
    "insert_if_absent_table": """SELECT doc_id AS news_id, 'label' AS role, CAST(NULL AS BIGINT) AS turn FROM labels
UNION ALL
(SELECT conv_id, role, turn FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1)""",
    "update_partitions": """WITH latest AS (SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id)
SELECT doc_id AS id, CASE WHEN l.conv_id IS NULL THEN source ELSE l.text END AS title, lang, source
FROM documents LEFT JOIN latest l ON l.conv_id = doc_id""",
    "ingest_stream": f"""WITH {RAW}
SELECT title, link, published_at, CASE WHEN id % 3 <> 1 THEN publisher END AS publisher,
  CASE WHEN id % 3 <> 1 THEN 'article ' || id END AS content FROM raw""",
    "check_constraints": """WITH metadata AS (SELECT user_id AS news_id, event_type AS category FROM events)
SELECT 'metadata.news_id repeated' AS violation, CAST(news_id AS VARCHAR) AS key, count(*) AS rows
FROM metadata GROUP BY news_id HAVING count(*) > 1
UNION ALL
SELECT 'metadata.news_id without article', CAST(news_id AS VARCHAR), count(*) FROM metadata
WHERE news_id NOT IN (SELECT doc_id FROM labels) GROUP BY news_id
UNION ALL
SELECT 'chunk.news_id without metadata', CAST(vec_id AS VARCHAR), count(*) FROM embeddings
WHERE vec_id NOT IN (SELECT news_id FROM metadata) GROUP BY vec_id
UNION ALL
SELECT 'chunk.embedding length', CAST(vec_id AS VARCHAR), 1 FROM embeddings WHERE len(embedding) <> 32
UNION ALL
SELECT 'metadata.category outside taxonomy', category, count(*) FROM metadata
WHERE category NOT IN ('click', 'view', 'purchase') GROUP BY category""",
    "unclassified_backlog": f"""WITH {RAW}
SELECT id AS news_id, title, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, publisher, summary
FROM raw WHERE id NOT IN (SELECT doc_id FROM labels)
ORDER BY raw.published_at DESC NULLS FIRST, id LIMIT 30""",
    "unclassified_backlog_all": f"""WITH {RAW}
SELECT id AS news_id, title, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, publisher, summary
FROM raw WHERE id NOT IN (SELECT doc_id FROM labels)""",
    "unembedded_backlog": f"""WITH {RAW}, {METADATA}
SELECT r.id AS news_id, r.content, m.title, strftime(m.published_at, '%Y-%m-%d %H:%M:%S') AS published_at,
  m.publisher, m.category
FROM raw r JOIN metadata m ON m.news_id = r.id
WHERE r.id NOT IN (SELECT vec_id FROM embeddings) ORDER BY r.id LIMIT 50""",
    "unembedded_backlog_all": f"""WITH {RAW}, {METADATA}
SELECT r.id AS news_id, r.content, m.title, strftime(m.published_at, '%Y-%m-%d %H:%M:%S') AS published_at,
  m.publisher, m.category
FROM raw r JOIN metadata m ON m.news_id = r.id
WHERE r.id NOT IN (SELECT vec_id FROM embeddings)""",
    "stringify_timestamp": """SELECT event_id AS news_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS published_at
FROM events""",
    "article_body": f"""WITH {BODY}
SELECT a.page_id, coalesce(t.content, '') AS content FROM article a LEFT JOIN texts t USING (page_id)""",
    "first_json_ld": """SELECT page_id, '{"creator":{"@type":"'
  || CASE WHEN url LIKE 'https%' THEN 'Organization' ELSE 'Person' END || '","name":"' || url
  || '"},"provider":{"@type":"Organization","name":"page ' || page_id || '"}}' AS json_ld FROM pages""",
    "extract_pages": f"""WITH {BODY}
SELECT page_id, CASE WHEN p.url LIKE 'https%' THEN p.url ELSE 'page ' || page_id END AS publisher,
  CASE WHEN page_id % 2 = 0 AND a.tokens IS NOT NULL THEN coalesce(t.content, '') ELSE p.url END AS content
FROM pages p LEFT JOIN article a USING (page_id) LEFT JOIN texts t USING (page_id)""",
    "classifier_text": f"""WITH {RAW}
SELECT id AS news_id, '標題：' || title || '; 摘要：' || summary AS summary FROM raw""",
    "make_batches": f"""WITH {BATCHED} SELECT bucket, batch, articles, items FROM batches""",
    "render_classify_prompt": f"""WITH {BATCHED}
SELECT bucket, batch, 'Categories: click, view, purchase. Articles: ' || items AS prompt FROM batches""",
    "classify_articles": f"""WITH {BATCHED} SELECT id, {CATEGORY} AS category FROM placed""",
    "classify_batches": f"""WITH {BATCHED},
asked AS (
  SELECT bucket, batch, length('Categories: click, view, purchase. Articles: ' || items) % 5 AS outcome FROM batches)
SELECT id, CASE outcome WHEN 4 THEN {CATEGORY} WHEN 2 THEN 'JSON_Parse_Error' ELSE 'API_Error' END AS category
FROM placed JOIN asked USING (bucket, batch)""",
    "classify_backlog": f"""WITH {BATCHED}
SELECT id AS news_id, title, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, publisher,
  {CATEGORY} AS category
FROM placed JOIN raw USING (id) WHERE id NOT IN (SELECT doc_id FROM labels)""",
    "join_back": f"""WITH {BATCHED}
SELECT id AS news_id, title, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, publisher,
  {CATEGORY} AS category
FROM placed JOIN raw USING (id)""",
    "split_sentences": f"""WITH {SENTENCES}
SELECT news_id, CAST(n - 1 AS INTEGER) AS place, sentence FROM numbered""",
    "chunk_articles": f"""WITH RECURSIVE {CHUNKED}
SELECT news_id, chunk_idx, chunk_text, status FROM chunked""",
    "no_content_marker": f"""WITH RECURSIVE {CHUNKED},
emptied AS (SELECT doc_id FROM documents WHERE lang IN ('fr', 'de', 'es'))
SELECT doc_id AS news_id, 'no_content' AS status, 1 AS markers, 0 AS last_chunk FROM emptied
UNION ALL
SELECT news_id, status, count(status), max(chunk_idx) FROM chunked
WHERE news_id NOT IN (SELECT doc_id FROM emptied) GROUP BY news_id, status""",
    "chunk_metadata": f"""WITH RECURSIVE {CHUNKED}, {RAW}
SELECT c.news_id, c.chunk_text, '{{"news_id":' || c.news_id || ',"title":"' || r.title
  || '","published_at":"' || strftime(r.published_at, '%Y-%m-%d %H:%M:%S')
  || '","publisher":"' || r.publisher || '","category":null,"chunk_idx":' || c.chunk_idx
  || CASE WHEN c.status IS NULL THEN '' ELSE ',"status":"no_content"' END || '}}' AS metadata
FROM chunked c JOIN raw r ON r.id = c.news_id""",
    "embed_chunks": f"""WITH {hashed("documents", "doc_id")},
lengths AS (SELECT doc_id, sqrt(sum(n * n)) AS length FROM grid GROUP BY doc_id)
SELECT g.doc_id AS news_id, g.dim, round(CAST(CAST(g.n / l.length AS FLOAT) AS DOUBLE), 6) AS value
FROM grid g JOIN lengths l USING (doc_id) WHERE l.length > 0""",
    "embed_backlog": f"""WITH RECURSIVE {CHUNKED},
waiting AS (
  SELECT news_id, chunk_idx, chunk_text AS text FROM chunked
  WHERE news_id IN (SELECT event_id FROM events) AND news_id NOT IN (SELECT vec_id FROM embeddings)),
{hashed("waiting", "news_id, chunk_idx")},
lengths AS (SELECT news_id, chunk_idx, sqrt(sum(n * n)) AS length FROM grid GROUP BY ALL)
SELECT g.news_id, g.chunk_idx, g.dim, round(CAST(CAST(g.n / l.length AS FLOAT) AS DOUBLE), 6) AS value
FROM grid g JOIN lengths l USING (news_id, chunk_idx) WHERE g.n > 0""",
    "embed_queries": f"""WITH {hashed("conversations", "conv_id, turn")}
SELECT conv_id, turn, dim, CAST(n AS DOUBLE) AS value FROM grid""",
    "cosine_similarity": """SELECT a.vec_id AS id,
  round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "search_top_k": f"""WITH {RAW}, {chunks()},
questions AS (
  SELECT vec_id AS query_id, embedding::DOUBLE[] AS embedding FROM embeddings
  WHERE vec_id = (SELECT min(vec_id) FROM embeddings)), {SCORED}
SELECT h.rank, h.id, h.news_id, round(h.similarity, 6) AS similarity, h.chunk_text, r.link, h.metadata
FROM hits h LEFT JOIN raw r ON r.id = h.news_id""",
    "search_top_k_batch": f"""WITH {RAW}, {hits()}
SELECT h.query_id, h.rank, h.id, h.news_id, round(h.similarity, 6) AS similarity, h.chunk_text, r.link, h.metadata
FROM hits h LEFT JOIN raw r ON r.id = h.news_id""",
    "enrich_full_article": f"""WITH {ENRICHED}
SELECT query_id, rank, news_id, full_article FROM enriched""",
    "build_context": f"""WITH {CONTEXT} SELECT query_id, CAST(hits AS INTEGER) AS hits, context FROM context""",
    "metadata_search": f"""WITH {RAW}, {METADATA}
SELECT m.title, m.publisher, r.link FROM metadata m LEFT JOIN raw r ON r.id = m.news_id
WHERE m.category = 'purchase' AND m.published_at BETWEEN TIMESTAMP '2024-01-05 06:00:00'
  AND TIMESTAMP '2024-01-20 18:00:00'""",
    "metadata_search_total": f"""WITH {METADATA}
SELECT count(*) AS total_count FROM metadata
WHERE publisher = 'u7' AND published_at <= TIMESTAMP '2024-01-20'""",
    "render_answer_prompt": f"""WITH {CONTEXT}
SELECT query_id, 'Question: ' || b.text || ' Articles: ' || context || ' Answer:' AS prompt
FROM context JOIN benchmark b ON b.item_id = query_id""",
    "parse_answer": f"""WITH {CONTEXT},
best AS (
  SELECT query_id, arg_min(chunk_text, rank) AS summary, string_agg(news_id, ',' ORDER BY rank) AS ids
  FROM hits GROUP BY query_id),
asked AS (
  SELECT query_id, length('Question: ' || b.text || ' Articles: ' || context || ' Answer:') % 7 AS outcome
  FROM context JOIN benchmark b ON b.item_id = query_id)
SELECT query_id, CASE outcome WHEN 0 THEN '{fv.CALL_ERROR_SUMMARY}' WHEN 1 THEN '{fv.EMPTY_ANSWER_SUMMARY}'
    WHEN 2 THEN '{fv.BAD_JSON_SUMMARY}' WHEN 3 THEN '{fv.BAD_JSON_SUMMARY}' ELSE summary END AS summary,
  CASE WHEN outcome > 3 THEN ids ELSE '' END AS "references",
  CASE outcome WHEN 0 THEN 'error' WHEN 1 THEN 'empty' WHEN 2 THEN 'bad_json' WHEN 3 THEN 'bad_json' ELSE 'ok' END AS status
FROM asked JOIN best USING (query_id)""",
    "answer_questions": f"""WITH {RAW},
{QUESTIONS},
doc_tokens AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents),
doc_counts AS (
  SELECT doc_id, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 64 AS dim, count(*) AS n
  FROM doc_tokens WHERE token <> '' GROUP BY ALL),
doc_grid AS (
  SELECT t.doc_id, d.dim, coalesce(c.n, 0) AS n
  FROM documents t CROSS JOIN (SELECT unnest(range(64)) AS dim) d
  LEFT JOIN doc_counts c ON c.dim = d.dim AND c.doc_id = t.doc_id),
lengths AS (SELECT doc_id, sqrt(sum(n * n)) AS length FROM doc_grid GROUP BY doc_id),
chunks AS (
  SELECT doc_id AS id, doc_id AS news_id, any_value(r.content) AS chunk_text, '' AS metadata,
    list(CAST(CAST(n / length AS FLOAT) AS DOUBLE) ORDER BY dim) AS embedding
  FROM doc_grid JOIN lengths USING (doc_id) JOIN raw r ON r.id = doc_id WHERE length > 0 GROUP BY doc_id), {SCORED}
SELECT query_id, CAST(count(*) AS INTEGER) AS hits, 'ok' AS status,
  arg_min(h.chunk_text, rank) || chr(10) || chr(10) || '**參考資料：**' || chr(10)
    || string_agg('- [' || title || '](' || link || ') - ' || publisher || chr(10), '' ORDER BY rank) AS text
FROM hits h JOIN raw r ON r.id = h.news_id GROUP BY query_id""",
    "resolve_references": f"""WITH {REFERENCES}
SELECT query_id, place, news_id, title, publisher, link FROM linked""",
    "render_answer": f"""WITH {REFERENCES},
lines AS (
  SELECT query_id, arg_min(chunk_text, place) || chr(10) || chr(10) || '**參考資料：**' || chr(10)
    || string_agg('- [' || title || '](' || link || ') - ' || publisher || chr(10), '' ORDER BY place) AS text
  FROM linked GROUP BY query_id)
SELECT d.doc_id AS query_id, CASE WHEN l.text IS NULL THEN 'no_hits' ELSE 'ok' END AS status,
  coalesce(l.text, '根據目前的新聞內容，無法準確回答此問題。') AS text
FROM documents d LEFT JOIN lines l ON l.query_id = d.doc_id""",
    "date_bounds": f"""WITH {METADATA} SELECT news_id, published_at FROM metadata WHERE {IN_RANGE}""",
    "top_categories": f"""WITH {METADATA}
SELECT category, count(news_id) AS count FROM metadata WHERE {IN_RANGE}
GROUP BY category ORDER BY count DESC, category LIMIT 3""",
    "top_publishers": f"""WITH {METADATA}
SELECT publisher, count(news_id) AS count FROM metadata WHERE {IN_RANGE}
GROUP BY publisher ORDER BY count DESC, publisher LIMIT 5""",
    "total_in_range": f"""WITH {METADATA} SELECT count(id) AS total FROM metadata WHERE {IN_RANGE}""",
    "trend_table": f"""WITH {METADATA},
counted AS (
  SELECT 'category' AS kind, category AS name, count(news_id) AS count FROM metadata WHERE {IN_RANGE} GROUP BY category
  UNION ALL
  SELECT 'publisher', publisher, count(news_id) FROM metadata WHERE {IN_RANGE} GROUP BY publisher
  UNION ALL
  SELECT 'total', NULL, count(id) FROM metadata WHERE {IN_RANGE})
SELECT kind, name, count, CAST(row_number() OVER (PARTITION BY kind ORDER BY count DESC, name NULLS LAST) AS INTEGER) AS rank
FROM counted QUALIFY rank <= 5""",
    "trend_report": f"""WITH {METADATA},
categories AS (
  SELECT 'category' AS kind, category AS name, count(news_id) AS count FROM metadata WHERE {IN_RANGE}
  GROUP BY category ORDER BY count DESC, name LIMIT 5),
publishers AS (
  SELECT 'publisher' AS kind, publisher AS name, count(news_id) AS count FROM metadata WHERE {IN_RANGE}
  GROUP BY publisher ORDER BY count DESC, name LIMIT 5)
SELECT * FROM categories UNION ALL SELECT * FROM publishers UNION ALL
SELECT 'sentence', count(id) || ' was published from 2024-01-05 to 2024-01-20.', count(id)
FROM metadata WHERE {IN_RANGE}""",
}
# The index changes what is read, not what is found.
ORACLE["search_pruned"] = ORACLE["search_top_k_batch"]
# Kept counts give what the articles give, and a log what the model gives.
ORACLE["daily_report"] = ORACLE["trend_report"]
ORACLE["embed_logged"] = ORACLE["embed_chunks"]
ORACLE["metadata_pages"] = ORACLE["metadata_search"]
