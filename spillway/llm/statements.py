"""DuckDB statements with the rows of those queries that SQL can express."""

from __future__ import annotations

#: The production mix, as in ``queries.MIX``.
_MIX = r"""
WITH placed AS (
    SELECT doc_id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
        CASE TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4
            WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'forums' WHEN 3 THEN 'news'
            ELSE 'other' END AS domain,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens
    FROM documents),
leaf AS (
    SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply FROM placed GROUP BY ALL),
caps AS (SELECT *, supply * 2 AS cap FROM leaf),
total AS (SELECT least(sum(supply) * 1.0::DOUBLE, sum(cap)::DOUBLE) AS budget FROM caps),
d1 AS (
    SELECT domain, sum(cap) AS cap,
        CASE domain WHEN 'web' THEN 4.0 WHEN 'books' THEN 3.0 WHEN 'forums' THEN 1.0
            WHEN 'news' THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
    FROM caps GROUP BY domain),
d2 AS (
    SELECT *, row_number() OVER o AS place, sum(cap) OVER (o ROWS UNBOUNDED PRECEDING) - cap AS before,
        sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
    FROM (SELECT d1.*, cap / weight AS ratio, budget FROM d1, total)
    WINDOW o AS (ORDER BY ratio, domain)),
d3 AS (SELECT *, (budget - before) / rest AS level FROM d2),
domains AS (
    SELECT domain, CASE WHEN o.place IS NULL OR d3.place < o.place THEN cap::DOUBLE
        ELSE weight * o.level END AS budget
    FROM d3 LEFT JOIN (SELECT min(place) AS place, arg_min(level, place) AS level
        FROM d3 WHERE ratio > level) o ON true),
l1 AS (
    SELECT domain, lang, sum(cap) AS cap,
        CASE lang WHEN 'en' THEN 6.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
    FROM caps GROUP BY domain, lang),
l2 AS (
    SELECT *, row_number() OVER o AS place, sum(cap) OVER (o ROWS UNBOUNDED PRECEDING) - cap AS before,
        sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
    FROM (SELECT l1.*, cap / weight AS ratio, budget FROM l1 JOIN domains USING (domain))
    WINDOW o AS (PARTITION BY domain ORDER BY ratio, lang)),
l3 AS (SELECT *, (budget - before) / rest AS level FROM l2),
langs AS (
    SELECT domain, lang, CASE WHEN o.place IS NULL OR l3.place < o.place THEN cap::DOUBLE
        ELSE weight * o.level END AS budget
    FROM l3 LEFT JOIN (SELECT domain, min(place) AS place, arg_min(level, place) AS level
        FROM l3 WHERE ratio > level GROUP BY domain) o USING (domain)),
s2 AS (
    SELECT *, row_number() OVER o AS place, sum(cap) OVER (o ROWS UNBOUNDED PRECEDING) - cap AS before,
        count(*) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS rest
    FROM (SELECT caps.*, cap::DOUBLE AS ratio, budget FROM caps JOIN langs USING (domain, lang))
    WINDOW o AS (PARTITION BY domain, lang ORDER BY ratio, source)),
s3 AS (SELECT *, (budget - before) / rest AS level FROM s2),
plan AS (
    SELECT domain, lang, source, supply, floor(1e-6::DOUBLE +
        CASE WHEN o.place IS NULL OR s3.place < o.place THEN cap::DOUBLE ELSE o.level END)::BIGINT AS budget
    FROM s3 LEFT JOIN (SELECT domain, lang, min(place) AS place, arg_min(level, place) AS level
        FROM s3 WHERE ratio > level GROUP BY domain, lang) o USING (domain, lang)),
epochs AS (
    SELECT *, CASE WHEN supply = 0 THEN 0 ELSE budget // supply END AS whole FROM plan),
ordered AS (
    SELECT placed.*, whole, budget - whole * supply AS rest,
        md5(concat('42:', whole, ':', coalesce(doc_id::VARCHAR, ''))) AS key
    FROM placed JOIN epochs USING (domain, lang, source)),
begun AS (
    SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key
        RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        - sum(n_tokens) OVER (PARTITION BY domain, lang, source, key) AS start
    FROM ordered),
taken AS (
    SELECT *, whole + CASE WHEN rest > 0 AND start < rest THEN 1 ELSE 0 END AS times FROM begun)
SELECT doc_id, domain, lang, source, n_tokens, epoch::INT AS epoch
FROM (SELECT *, unnest(range(times::BIGINT)) AS epoch FROM taken WHERE times > 0)
"""

_NGRAMS = "".join(
    f""",
c{n} AS (
    SELECT doc_id, sum(size)::BIGINT AS chars_{n} FROM (
        SELECT doc_id, size, max(again) OVER (PARTITION BY doc_id ORDER BY pos
            ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside
        FROM (SELECT *, gram IS NOT NULL
                  AND row_number() OVER (PARTITION BY doc_id, gram ORDER BY pos) > 1 AS again
              FROM (SELECT doc_id, pos, size, CASE WHEN pos <= n_words - {n - 1}
                        THEN hash({', '.join(f'h{k}' for k in range(n))}) END AS gram FROM word)))
    WHERE inside GROUP BY doc_id)"""
    for n in (5, 6, 7, 8, 9, 10)
)
_JOINS = " ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in (5, 6, 7, 8, 9, 10))
_SHARES = ", ".join(f"coalesce(chars_{n}, 0) AS dup_{n}gram_chars" for n in (5, 6, 7, 8, 9, 10))
_FOLLOWING = ", ".join(f"lead(hash(word), {k}) OVER o AS h{k}" for k in range(1, 10))
_FAILS = " OR ".join(
    f"dup_{n}gram_chars - CASE WHEN n_dup_lines = 1 AND line_words BETWEEN {n} AND 20 THEN dup_line_chars ELSE 0 END"
    f" > {most} * word_chars"
    for n, most in {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}.items()
)

_REPETITION = rf"""
WITH listed AS (
    SELECT doc_id, coalesce(text, '') AS text,
        coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words
    FROM documents),
word AS (
    SELECT doc_id, pos, n_words, length(word) AS size, hash(word) AS h0, {_FOLLOWING}
    FROM (SELECT doc_id, generate_subscripts(words, 1) AS pos, unnest(words) AS word, len(words) AS n_words
          FROM listed)
    WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
lines AS (
    SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS nth
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM listed)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
line_counts AS (
    SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')))::BIGINT
        AS dup_line_chars, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')))::BIGINT AS line_words
    FROM lines WHERE nth > 1 GROUP BY doc_id),
repeated AS (
    SELECT doc_id, count(*) AS n_repeat_words FROM (
        SELECT doc_id, max(twice) OVER (PARTITION BY doc_id ORDER BY pos
            ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS inside
        FROM (SELECT *, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS twice
              FROM (SELECT doc_id, pos, CASE WHEN pos <= n_words - 2
                        THEN hash(h0, h1, h2) END AS gram FROM word)))
    WHERE inside GROUP BY doc_id)
{_NGRAMS},
base AS (
    SELECT doc_id, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM listed),
found AS (
    SELECT base.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(dup_line_chars, 0) AS dup_line_chars,
        coalesce(line_words, 0) AS line_words,
        coalesce(n_repeat_words, 0) AS n_repeat_words, {_SHARES}
    FROM base LEFT JOIN line_counts USING (doc_id) LEFT JOIN repeated USING (doc_id) {_JOINS})
SELECT * EXCLUDE (line_words), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
        OR dup_line_chars > 0.20 * word_chars OR {_FAILS}) AS kept
FROM found
"""

#: All pairs of a label: the rows of the index at full recall.
_VECTORS = """
WITH RECURSIVE sound AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS vector FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND list_count(embedding) = len(embedding)
        AND list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) < 'inf'::DOUBLE
        AND list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) > 0),
pairs AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b USING (label)
    WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.vector, b.vector) >= 0.98),
reached AS (
    SELECT vec_id, vec_id AS other FROM sound
    UNION SELECT vec_id, b FROM reached JOIN pairs ON other = a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
    vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings
LEFT JOIN (SELECT a AS vec_id, count(*) AS n_links FROM pairs GROUP BY a) USING (vec_id)
LEFT JOIN (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id) USING (vec_id)
"""

_NEGATIVES = """
WITH sound AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
        list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS vector
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND list_count(embedding) = len(embedding)
        AND len(list_filter(embedding::DOUBLE[], lambda x: NOT isfinite(x))) = 0),
met AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
        list_inner_product(a.vector, b.vector)::BIGINT AS score
    FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.vector) = len(b.vector)
    WHERE a.vec_id % 50 = 0),
positive AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM met WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
    SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
        row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
    FROM positive JOIN met USING (anchor_id)
    WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
WHERE rank <= 3
"""

STATEMENTS: dict[str, str] = {
    "op3_source_mix": _MIX,
    "op7_repetition_rules": _REPETITION,
    "op8_itq_near_dups": _VECTORS,
    "op13_hard_negatives": _NEGATIVES,
}
