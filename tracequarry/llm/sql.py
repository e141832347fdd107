"""SQL of the queries of problems 5 to 10, as far as SQL can express them."""

_MESSAGES = """
    l AS (SELECT sessionId AS session_id, uuid, type AS role, message.content AS c,
                 regexp_replace("timestamp", '^\\s+|\\s+$', '', 'g') AS ts FROM claude_session_minimal
          WHERE sessionId IS NOT NULL AND type IN ('user', 'assistant') AND message.content IS NOT NULL),
    t AS (SELECT *, CASE WHEN regexp_full_match(ts, '\\d{11,14}') THEN CAST(ts AS BIGINT) * 1000
                         WHEN regexp_full_match(ts, '\\d{4}-\\d\\d-\\d\\d[Tt ]\\d\\d:\\d\\d.*') THEN epoch_us(TRY_CAST(ts AS TIMESTAMPTZ)) END AS us,
                 CASE WHEN json_valid(c) THEN CASE WHEN json_type(CAST(c AS JSON)) = 'ARRAY' THEN json_extract(c, '$[*]') END END AS b FROM l),
    m AS (SELECT session_id, uuid, min(us) AS us, bool_or(us IS NOT NULL) AS timed, min(role) AS role, any_value(b) AS b FROM t
          WHERE CASE WHEN b IS NULL THEN regexp_matches(c, '\\S')
                     ELSE len(list_filter(b, lambda x: coalesce(x ->> '$.type', '') <> 'text' OR regexp_matches(coalesce(x ->> '$.text', ''), '\\S'))) > 0 END
          GROUP BY 1, 2),
    tool AS (SELECT session_id, id, max(u) AS u, min(r) AS r FROM (
                 SELECT session_id, unnest(list_transform(list_filter(b, lambda x: x ->> '$.type' = 'tool_use'), lambda x: x ->> '$.id')) AS id, us AS u, NULL AS r FROM m
                 UNION ALL
                 SELECT session_id, unnest(list_transform(list_filter(b, lambda x: x ->> '$.type' = 'tool_result'), lambda x: x ->> '$.tool_use_id')), NULL, us FROM m) GROUP BY 1, 2),
    bad AS (SELECT session_id FROM tool WHERE u IS NULL OR r IS NULL OR r <= u
            UNION SELECT session_id FROM m WHERE us IS NULL
            UNION SELECT session_id FROM (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM m
                                          WINDOW w AS (PARTITION BY session_id ORDER BY us, role = 'assistant', uuid))
                  WHERE (before IS NULL AND role <> 'user') OR (after IS NULL AND role <> 'assistant') OR (before = 'user' AND role = 'user'))
"""

_LEAKS = """
    w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
    dg AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 12) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
    e AS (SELECT item_id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
    eg AS (SELECT DISTINCT item_id, list_slice(w, i, i + 12) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM e WHERE len(w) >= 13))
"""

SQL = {
    "p5_found": f"""
    WITH {_MESSAGES}
    SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY us, role = 'assistant', uuid) AS INTEGER) AS turn_no, uuid
    FROM m WHERE session_id NOT IN (SELECT session_id FROM bad)
    """,
    "p7_found": """
    WITH r AS (SELECT input_value, output_value, min(id) OVER (PARTITION BY trace_id, span_id) AS rid FROM spans),
    t AS (SELECT DISTINCT rid, t FROM (SELECT rid, input_value AS t FROM r UNION ALL SELECT rid, output_value FROM r) WHERE length(t) >= 120),
    w AS (SELECT DISTINCT rid, hash(substring(t, i, 120)) AS h, substring(t, i, 120) AS s FROM (SELECT rid, t, unnest(range(1, length(t) - 118)) AS i FROM t)),
    k AS (SELECT rid, s FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1))
    SELECT DISTINCT a.rid AS id_a, b.rid AS id_b FROM k a JOIN k b ON a.s = b.s AND a.rid < b.rid
    """,
    "p7_share": """
    WITH r AS (SELECT id, input_value, output_value, min(id) OVER (PARTITION BY trace_id, span_id) AS rid FROM spans),
    t AS (SELECT DISTINCT rid, t FROM (SELECT rid, input_value AS t FROM r UNION ALL SELECT rid, output_value FROM r) WHERE length(t) >= 120),
    w AS (SELECT DISTINCT rid, substring(t, i, 120) AS s FROM (SELECT rid, t, unnest(range(1, length(t) - 118)) AS i FROM t)),
    many AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
    o AS (SELECT id, 1 AS k, input_value AS t FROM r WHERE id = rid UNION ALL SELECT id, 2, output_value FROM r WHERE id = rid),
    h AS (SELECT id, k, i FROM (SELECT id, k, t, unnest(range(1, length(t) - 118)) AS i FROM o WHERE length(t) >= 120) x WHERE substring(t, i, 120) IN (SELECT s FROM many)),
    c AS (SELECT id, sum(least(coalesce(nxt - i, 120), 120)) AS n FROM (SELECT id, i, lead(i) OVER (PARTITION BY id, k ORDER BY i) AS nxt FROM h) GROUP BY 1),
    n AS (SELECT id, sum(coalesce(length(t), 0))::BIGINT AS n FROM o GROUP BY 1)
    SELECT n.id, n.n AS n_chars, coalesce(c.n, 0)::BIGINT AS shared_chars, CASE WHEN n.n > 0 THEN coalesce(c.n, 0) / n.n ELSE 0.0 END::DOUBLE AS share FROM n LEFT JOIN c USING (id)
    """,
    "p9_found": f"WITH {_LEAKS} SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)",
}
