"""DuckDB SQL of the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op1_line_templates"] = r"""
WITH cut AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
           generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
    FROM documents
), parted AS (
    SELECT doc_id, line_no, list_filter(regexp_split_to_array(raw, '[\x20\x09-\x0D]+'), lambda t: t <> '') AS words
    FROM cut
), masked AS (
    SELECT *, len(words) AS n, len(words) < 5 OR len(list_filter(words, lambda t: NOT regexp_matches(t, '[0-9]'))) < 3 AS exact
    FROM parted WHERE len(words) > 0
), lines AS (
    SELECT doc_id, line_no, n, exact, CASE WHEN exact THEN words ELSE tokens END AS tokens,
           CASE WHEN exact THEN words ELSE tokens[1:3] END AS lead,
           array_to_string(CASE WHEN exact THEN words ELSE tokens END, ' ') AS line
    FROM (SELECT *, list_transform(words, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens
          FROM masked)
), texts AS (
    SELECT n, lead, line, any_value(tokens) AS tokens, count(*) AS c FROM lines WHERE NOT exact GROUP BY n, lead, line
), leaves AS (
    SELECT n, lead FROM lines WHERE NOT exact GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2 AND count(DISTINCT line) > 1
), ranked AS (
    SELECT t.*, first_value(tokens) OVER (PARTITION BY n, lead ORDER BY c DESC, encode(line) DESC) AS seed
    FROM texts t JOIN leaves USING (n, lead)
), compared AS (
    SELECT *, list_filter(list_zip(tokens, seed), lambda p: p[1] <> '<*>' OR p[2] <> '<*>') AS places,
           list_filter(list_zip(tokens, seed)[4:], lambda p: p[1] <> '<*>' OR p[2] <> '<*>') AS behind
    FROM ranked
), judged AS (
    SELECT n, lead, line, tokens, c,
           len(list_filter(places, lambda p: p[1] = p[2])) >= greatest(3, 0.7 * len(places))
           AND len(list_filter(behind, lambda p: p[1] = p[2])) >= 0.5 * len(behind) AS joins
    FROM compared
), tokens AS (
    SELECT n, lead, line, c, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM judged WHERE NOT joins
), supported AS (
    SELECT *, sum(c) OVER (PARTITION BY n, lead, i, token) >= 2 AS constant FROM tokens WHERE token <> '<*>'
), signed AS (
    SELECT n, lead, line, list({'i': i, 'token': token} ORDER BY i) FILTER (constant) AS signature
    FROM supported GROUP BY n, lead, line
    HAVING count(*) FILTER (constant) >= greatest(3, 0.7 * count(*))
       AND count(*) FILTER (constant AND i > 3) >= 0.5 * count(*) FILTER (i > 3)
), named AS (
    SELECT l.doc_id, l.line_no, l.n, l.lead,
           {'exact': exact, 'signature': s.signature, 'line': CASE WHEN s.line IS NULL AND coalesce(NOT j.joins, true) THEN l.line END} AS own
    FROM lines l LEFT JOIN judged j ON NOT exact AND l.n = j.n AND l.lead = j.lead AND l.line = j.line
    LEFT JOIN signed s ON NOT exact AND l.n = s.n AND l.lead = s.lead AND l.line = s.line
), counted AS (
    SELECT *, min((doc_id, line_no)) OVER same AS first, dense_rank() OVER (PARTITION BY n, lead, own ORDER BY doc_id) AS dr
    FROM named WINDOW same AS (PARTITION BY n, lead, own)
), dropped AS (
    SELECT doc_id, line_no FROM (SELECT *, max(dr) OVER (PARTITION BY n, lead, own) AS docs FROM counted)
    WHERE docs >= 2 AND (doc_id, line_no) <> first
), kept AS (
    SELECT c.doc_id, string_agg(raw, chr(10) ORDER BY c.line_no) FILTER (d.doc_id IS NULL) AS text,
           count(d.doc_id) AS n_dropped
    FROM cut c LEFT JOIN dropped d USING (doc_id, line_no) GROUP BY c.doc_id
)
SELECT doc_id, coalesce(n_dropped, 0) AS n_dropped,
       CASE WHEN o.text IS NOT NULL THEN length(coalesce(k.text, '')) END AS kept_chars,
       CASE WHEN o.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS kept_sha256
FROM documents o LEFT JOIN kept k USING (doc_id)
"""

SQL["op2_curriculum_mix"] = r"""
WITH sized AS (
    SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
    FROM documents
), totals AS (
    SELECT source, CAST(sum(size) AS DOUBLE) AS source_size,
           row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank
    FROM sized GROUP BY source
), weighed AS (
    SELECT *, [5.0, 2.0, 1.0][CAST(rank % 3 + 1 AS INTEGER)]::DOUBLE AS weight, 2 * source_size AS most,
           [1.5, 1.0, 0.5][CAST(rank % 3 + 1 AS INTEGER)]::DOUBLE AS a,
           [0.5, 1.0, 1.5][CAST(rank % 3 + 1 AS INTEGER)]::DOUBLE AS b
    FROM totals
), leveled AS (
    SELECT *, most / weight AS full_at,
           (sum(source_size) OVER () * 1.5
            - (sum(most) OVER (ORDER BY most / weight, rank ROWS UNBOUNDED PRECEDING) - most))
           / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed
), targets AS (
    SELECT *, least(most, (SELECT arg_min(level, full_at * 1e6 + rank) FROM leveled WHERE level <= full_at) * weight) AS target
    FROM leveled
), placed AS (
    SELECT s.doc_id, s.size, CAST(t.source_size AS BIGINT) AS source_size, t.target, t.a, t.b,
           CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS earlier,
           CAST(floor(t.target + 0.5) AS BIGINT) AS goal
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), taken AS (
    SELECT *, greatest(0, least(size, goal - earlier)) + greatest(0, least(size, goal - source_size - earlier)) AS taken,
           earlier / target AS part, (a + b) / 2 AS mean, (b - a) / 2 AS bend
    FROM placed
)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken > 0 THEN CASE WHEN part = 0 THEN 0.0
            ELSE 2 * mean * part / (a + sqrt(a * a + 4 * bend * mean * part)) END END AS first_position
FROM taken
"""

SQL["op5_bloom_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

SQL["op3_repetition_rules"] = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), windows AS (
    SELECT doc_id, n, i, words[i : i + n - 1] AS part
    FROM cut, (SELECT unnest(range(5, 11)) AS n), LATERAL (SELECT unnest(range(1, len(words) - n + 2)) AS i)
), marked AS (
    SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, part) AS often,
           row_number() OVER (PARTITION BY doc_id, n, part ORDER BY i) AS turn
    FROM windows
), inside AS (
    SELECT DISTINCT doc_id, n, turn > 1 AS later, unnest(range(i, i + n)) AS j FROM marked WHERE often > 1
), repeated AS (
    SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM inside WHERE n = 5 GROUP BY doc_id
), shares AS (
    SELECT doc_id, n, sum(length(words[j])) / list_sum(list_transform(any_value(words), lambda w: length(w))) AS share
    FROM inside JOIN cut USING (doc_id) WHERE later GROUP BY doc_id, n
), worst AS (
    SELECT doc_id, max(share) FILTER (n = 5) AS ngram_share,
           bool_or(share > [0.15, 0.14, 0.13, 0.12, 0.11, 0.10][n - 4]::DOUBLE) AS repetitive
    FROM shares GROUP BY doc_id
), lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS i FROM cut
), again AS (
    SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS turn
    FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
    SELECT doc_id, count(*) AS n_dup_lines, sum(length(line)) AS chars FROM again WHERE turn > 1 GROUP BY doc_id
), measured AS (
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
           CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
           CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
           coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
           coalesce(CAST(ngram_share AS DOUBLE), 0) AS ngram_share,
           coalesce(CAST(chars AS DOUBLE) / length(text), 0) AS line_share, coalesce(repetitive, false) AS repetitive
    FROM cut LEFT JOIN repeated USING (doc_id) LEFT JOIN worst USING (doc_id) LEFT JOIN dup USING (doc_id)
), judged AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ngram_share, line_share, base_failed,
       NOT (base_failed OR repetitive OR line_share > 0.2) AS kept
FROM judged
"""

SQL["op6_backoff_scores"] = r"""
WITH cut AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), placed AS (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM cut
), pairs AS (
    SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM placed
), counted AS (
    SELECT *, count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS others,
           count(*) OVER (PARTITION BY word) - count(*) OVER (PARTITION BY doc_id, word) AS one,
           count(*) OVER (PARTITION BY prev, word) - count(*) OVER (PARTITION BY doc_id, prev, word) AS two
    FROM pairs
), scored AS (
    SELECT doc_id, CASE WHEN prev IS NOT NULL AND two > 0
               THEN two / lag(one) OVER (PARTITION BY doc_id ORDER BY i)
               ELSE CASE WHEN prev IS NULL THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END * greatest(one, 1) / (others + 1) END AS score
    FROM counted
), summed AS (
    SELECT doc_id, count(*) AS n_words, sum(ln(score)) AS total FROM scored GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(total, 0), 6) AS log_score,
       round(total / n_words, 6) AS mean_log_score
FROM documents d LEFT JOIN summed USING (doc_id)
"""

SQL["op6_trigram_scores"] = r"""
WITH cut AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), placed AS (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM cut
), triples AS (
    SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS prev,
           lag(word, 2) OVER (PARTITION BY doc_id ORDER BY i) AS before
    FROM placed
), counted AS (
    SELECT *, count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS others,
           count(*) OVER (PARTITION BY word) - count(*) OVER (PARTITION BY doc_id, word) AS one,
           count(*) OVER (PARTITION BY prev, word) - count(*) OVER (PARTITION BY doc_id, prev, word) AS two,
           count(*) OVER (PARTITION BY before, prev, word) - count(*) OVER (PARTITION BY doc_id, before, prev, word) AS three
    FROM triples
), backed AS (
    SELECT *, lag(two) OVER (PARTITION BY doc_id ORDER BY i) AS two_known,
           CASE WHEN prev IS NOT NULL AND two > 0
               THEN two / lag(one) OVER (PARTITION BY doc_id ORDER BY i)
               ELSE CASE WHEN prev IS NULL THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END * greatest(one, 1) / (others + 1) END AS shorter
    FROM counted
), scored AS (
    SELECT doc_id, CASE WHEN before IS NULL THEN shorter WHEN three > 0 THEN three / two_known
               ELSE 0.4::DOUBLE * shorter END AS score
    FROM backed
), summed AS (
    SELECT doc_id, count(*) AS n_words, sum(ln(score)) AS total FROM scored GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(total, 0), 6) AS log_score,
       round(total / n_words, 6) AS mean_log_score
FROM documents d LEFT JOIN summed USING (doc_id)
"""

SQL["op11_prefix_trie"] = """
WITH RECURSIVE original AS (
    SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), bits(conv_id, decimal, step, state) AS (
    SELECT conv_id, conv_id::VARCHAR, 0, 4294967295::BIGINT FROM original
    UNION ALL
    SELECT conv_id, decimal, step + 1, CASE WHEN mixed & 1 = 1 THEN xor(mixed >> 1, 3988292384) ELSE mixed >> 1 END
    FROM (SELECT *, CASE WHEN step % 8 = 0 THEN xor(state, ascii(decimal[step // 8 + 1])) ELSE state END AS mixed
          FROM bits WHERE step < 8 * length(decimal))
), shares AS (
    SELECT conv_id, xor(state, 4294967295) % 9 AS h FROM bits WHERE step = 8 * length(decimal)
), rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.turns[1:h], []), c.turns[h + 1:]) AS turns
    FROM original c JOIN shares USING (conv_id) LEFT JOIN original b ON b.conv_id = c.conv_id - c.conv_id % 5
), prefixes AS (
    SELECT conv_id, depth, turns[1:depth] AS path, len(turns) = depth AS ends
    FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt)
), nodes AS (
    SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM prefixes GROUP BY depth, path
), children AS (
    SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2
), counted AS (
    SELECT n.*, coalesce(n_children, 0) AS n_children,
           CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(n.path[n.depth].text) END AS saved
    FROM nodes n LEFT JOIN children USING (depth, path)
), sums AS (
    SELECT up AS depth, path[1:up] AS path, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
    FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM counted) GROUP BY 1, 2
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
       saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM counted n JOIN sums USING (depth, path)
LEFT JOIN counted p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""

_INTEGERS = """
    SELECT {columns}, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
"""
_PRODUCT = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT"

SQL["op12_bitsliced_top_k"] = f"""
WITH whole AS ({_INTEGERS.format(columns='vec_id')}),
scored AS (
    SELECT a.vec_id AS query_id, b.vec_id, {_PRODUCT} AS score
    FROM whole a JOIN whole b ON a.vec_id IS DISTINCT FROM b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored)
WHERE rank <= 5
"""

SQL["op13_hard_negatives"] = f"""
WITH whole AS (
    {_INTEGERS.format(columns='vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label')}
    AND label IS NOT NULL
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, {_PRODUCT} AS score
    FROM whole a JOIN whole b ON a.vec_id IS DISTINCT FROM b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score
    FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id NULLS LAST) AS nth
          FROM scored WHERE same)
    WHERE nth <= 5
), negatives AS (
    SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id NULLS LAST) AS rank
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 10
"""
