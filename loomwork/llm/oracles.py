"""DuckDB SQL for the queries of this folder that SQL can express: by brute force, over the same rows."""

from __future__ import annotations

from loomwork.llm import licenses, minhash

_LOWER = "TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def near_dedup() -> str:
    """All pairs that share a shingle, then all documents that each one reaches."""
    k = minhash.WORDS
    return f"""WITH RECURSIVE d AS (SELECT doc_id, REGEXP_EXTRACT_ALL({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN LEN(w) >= {k} THEN LIST_DISTINCT(LIST_TRANSFORM(RANGE(1, LEN(w) - {k - 2}), LAMBDA i: ARRAY_TO_STRING(w[i:i + {k - 1}], ' '))) WHEN LEN(w) > 0 THEN [ARRAY_TO_STRING(w, ' ')] ELSE [] END AS g FROM d),
    sh AS (SELECT doc_id, LEN(g) AS n, UNNEST(g) AS g FROM s),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2, a.n, b.n HAVING 100 * COUNT(*) >= {minhash.PERCENT} * (a.n + b.n - COUNT(*))),
    edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
    c AS (SELECT a AS doc_id, MIN(b) AS component_id FROM reach GROUP BY 1)
    SELECT s.doc_id, CAST(LEN(g) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.doc_id = s.doc_id"""


def license_scan() -> str:
    """Every window against every template."""
    templates = ", ".join(f"('{label}', {licenses.half_of(t)}, [{', '.join(repr(w) for w in sorted(set(t.split())))}])" for label, t in licenses.TEMPLATES)
    halves = ", ".join(f"({h})" for h in sorted({licenses.half_of(t) for _, t in licenses.TEMPLATES}))
    finds = []
    for phrase, label in licenses.PHRASES.items():
        same = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split()))
        finds.append(f"LIST_TRANSFORM(LIST_FILTER(RANGE(1, LEN(w) + 1), LAMBDA i: {same}), LAMBDA i: {{'first': i - 1, 'label': '{label}'}})")
    places = " || ".join(finds)
    return f"""WITH d AS (SELECT doc_id, REGEXP_EXTRACT_ALL({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    p AS (SELECT doc_id, w, {places} AS places FROM d),
    b AS (SELECT doc_id, half, LIST_DISTINCT(w[i:i + 2 * half - 1]) AS block FROM (SELECT doc_id, w, half, UNNEST(RANGE(1, GREATEST(1, LEN(w) - half) + 1, half)) AS i FROM d, (VALUES {halves}) AS h(half)) AS x),
    m AS (SELECT doc_id, label, LEN(LIST_INTERSECT(block, t)) / LEN(t) AS containment FROM b JOIN (VALUES {templates}) AS v(label, size, t) ON v.size = b.half WHERE LEN(LIST_INTERSECT(block, t)) >= {licenses.THRESHOLD} * LEN(t) - 1e-9),
    f AS (SELECT doc_id, LIST(DISTINCT label) AS more, MAX(containment) AS best FROM m GROUP BY 1)
    SELECT p.doc_id, CAST(LEN(w) AS BIGINT) AS n_words, CAST(LEN(places) AS BIGINT) AS n_base, CAST(LIST_MIN(LIST_TRANSFORM(places, LAMBDA x: x.first)) AS BIGINT) AS first_word, CAST(LIST_MAX(LIST_TRANSFORM(places, LAMBDA x: x.first)) AS BIGINT) AS last_word,
        ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT(LIST_TRANSFORM(places, LAMBDA x: x.label))), ',') AS base_labels,
        ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT(LIST_TRANSFORM(places, LAMBDA x: x.label) || COALESCE(more, []))), ',') AS labels,
        CASE WHEN LEN(places) > 0 THEN 1.0::DOUBLE ELSE COALESCE(best, 0.0)::DOUBLE END AS score FROM p LEFT JOIN f ON f.doc_id = p.doc_id"""


def prefix_trie() -> str:
    """Every prefix as the joined marks of its turns; every node against all prefixes of its least member."""
    return r"""WITH RECURSIVE a AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    b AS (SELECT conv_id, turn, MD5(LENGTH(role) || ':' || role || text) AS mark, LEN(REGEXP_EXTRACT_ALL(text, '[^\x20\x09-\x0D]+')) AS words FROM a),
    t AS (SELECT conv_id, mark, words, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) AS place FROM b),
    own AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, COUNT(*) AS n FROM t GROUP BY conv_id),
    crc AS (SELECT conv_id, s, 4294967295::BIGINT AS v, 0 AS k FROM own
        UNION ALL SELECT conv_id, s, XOR(w >> 1, CASE WHEN w & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM (SELECT conv_id, s, k, CASE WHEN k % 8 = 0 THEN XOR(v, ASCII(s[k // 8 + 1])::BIGINT) ELSE v END AS w FROM crc WHERE k < 8 * LENGTH(s)) AS x),
    h AS (SELECT conv_id, conv_id - conv_id % 20 AS g, XOR(v, 4294967295) % 4 AS h FROM crc WHERE k = 8 * LENGTH(s)),
    p AS (SELECT h.*, own.n, LEAST(h, COALESCE(f.n, 0)) AS taken FROM h JOIN own USING (conv_id) LEFT JOIN own AS f ON f.conv_id = h.g),
    r AS (SELECT p.conv_id, t.place AS depth, mark, words FROM p JOIN t ON t.conv_id = p.g AND t.place <= p.h
        UNION ALL SELECT p.conv_id, taken + place - h, mark, words FROM p JOIN t ON t.conv_id = p.conv_id WHERE place > h),
    m AS (SELECT conv_id, depth, STRING_AGG(mark, ',') OVER (PARTITION BY conv_id ORDER BY depth) AS path, words FROM r UNION ALL SELECT conv_id, 0, '', 0 FROM p),
    n AS (SELECT depth, path, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, MIN(words) AS words FROM m GROUP BY depth, path),
    e AS (SELECT m.depth, path, SHA256(STRING_AGG(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id)) AS ends FROM m JOIN p ON p.conv_id = m.conv_id AND p.taken + GREATEST(p.n - p.h, 0) = m.depth GROUP BY m.depth, path),
    up AS (SELECT n.depth, n.path, q.conv_id AS parent_conv_id, q.path AS parent FROM n JOIN m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1 JOIN n AS q ON q.depth = m.depth AND q.path = m.path),
    kids AS (SELECT depth - 1 AS depth, parent AS path, COUNT(*) AS n_children FROM up GROUP BY 1, 2),
    one AS (SELECT n.*, COALESCE(n_children, 0) AS n_children FROM n LEFT JOIN kids ON kids.depth = n.depth AND kids.path = n.path),
    sub AS (SELECT m.depth, m.path, COUNT(*) FILTER (WHERE n_children = 0) AS n_leaves, SUM((n_convs - 1) * one.words) AS saved FROM one JOIN m ON m.conv_id = one.conv_id AND m.depth <= one.depth GROUP BY 1, 2)
    SELECT CAST(one.conv_id AS BIGINT) AS conv_id, CAST(one.depth AS BIGINT) AS depth, CAST(parent_conv_id AS BIGINT) AS parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, COALESCE(ends, SHA256('')) AS ends_sha256
    FROM one JOIN sub ON sub.depth = one.depth AND sub.path = one.path LEFT JOIN up ON up.depth = one.depth AND up.path = one.path LEFT JOIN e ON e.depth = one.depth AND e.path = one.path"""


def oracle_sql() -> dict[str, str]:
    return {"op6_minhash_near_dedup": near_dedup(), "op8_license_scan": license_scan(), "op12_prefix_trie": prefix_trie()}
