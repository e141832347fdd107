"""Queries of problems 1 to 4 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.operators import hierarchy, nested, sessions
from tracequarry.session import table
from tracequarry.streaming import features


def _subagent_texts(spark: SparkSession, d: str) -> DataFrame:
    sub = table(spark, d, "claude_session_with_subagent")
    return nested.json_texts(sub, "claude_session_with_subagent", F.col("uuid"), {"message.content": F.col("message.content"), "toolUseResult": F.col("toolUseResult")})


def _span_texts(spark: SparkSession, d: str) -> DataFrame:
    return nested.json_texts(table(spark, d, "spans"), "spans", F.col("id"), {"raw_attributes": F.col("raw_attributes")})


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every span row counts; lines of a transcript that are stored again count once."""
    return nested.array_objects(_span_texts(spark, d)).unionByName(nested.array_objects(_subagent_texts(spark, d)).distinct())


def p1_nodes(spark: SparkSession, d: str) -> DataFrame:
    """All nodes of all texts with their interval labels."""
    return nested.json_nodes(_span_texts(spark, d).unionByName(_subagent_texts(spark, d).distinct()))


def p1_objects(spark: SparkSession, d: str) -> DataFrame:
    """The table of the objects; those of the other types are made likewise, by nested.node_tables()."""
    return nested.node_tables(p1_nodes(spark, d))["object"]


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """Every array with the object that contains it, by their intervals."""
    t = nested.node_tables(p1_nodes(spark, d))
    return nested.contained(t["object"], t["array"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, d, "spans"))


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.hierarchy(table(spark, d, "spans"), paths=True)
    return h.select("trace_id", "span_id", "root_id", "depth", F.array_join("path", "/").alias("path"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every span. Spans of a circle are above and below each other and above all that hangs below the circle."""
    return hierarchy.descendants(table(spark, d, "spans"), around=True)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    f = features.event_features(spark, f"{d}/session_events.parquet", table(spark, d, "tool_catalog"))
    return f.select("session_id", "event_key", "n_events", "last_us")


def p3_wide(spark: SparkSession, d: str) -> DataFrame:
    f = features.event_features(spark, f"{d}/session_events.parquet", table(spark, d, "tool_catalog"))
    w = features.wide(f)
    return w.select("session_id", F.to_json("n_events").alias("n_events"), F.to_json("last_us").alias("last_us"), F.to_json("duration_ms").alias("duration_ms"), "total_events", "session_last_us")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sessions.working_sessions(table(spark, d, "spans"))


QUERIES = {f.__name__: f for f in (p1_found, p1_nodes, p1_objects, p1_links, p2_found, p2_paths, p2_descendants, p3_found, p3_wide, p4_found)}

_TREE = """
    t AS (SELECT DISTINCT trace_id, span_id, parent_id FROM spans WHERE trace_id IS NOT NULL),
    e AS (SELECT t.trace_id, t.span_id, p.span_id AS parent_id
          FROM (SELECT trace_id, span_id, min(parent_id) AS parent_id FROM t GROUP BY 1, 2) t
          LEFT JOIN (SELECT DISTINCT trace_id, span_id FROM t) p ON p.trace_id = t.trace_id AND p.span_id = t.parent_id),
    down AS (
        SELECT trace_id, span_id, span_id AS root_id, 0 AS depth, span_id AS path FROM e WHERE parent_id IS NULL
        UNION ALL
        SELECT e.trace_id, e.span_id, d.root_id, d.depth + 1, d.path || '/' || e.span_id
        FROM down d JOIN e ON e.trace_id = d.trace_id AND e.parent_id = d.span_id),
    lost AS (SELECT * FROM e ANTI JOIN down USING (trace_id, span_id)),
    up AS (
        SELECT trace_id, span_id, parent_id AS above FROM lost
        UNION
        SELECT u.trace_id, u.span_id, l.parent_id FROM up u JOIN lost l ON l.trace_id = u.trace_id AND l.span_id = u.above),
    circle AS (SELECT DISTINCT trace_id, span_id FROM up WHERE span_id = above),
    bad AS (SELECT u.trace_id, u.span_id, min(u.above) AS root_id
            FROM up u JOIN circle c ON c.trace_id = u.trace_id AND c.span_id = u.above GROUP BY 1, 2)
"""

_GAPS = """
    SELECT user_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n_spans FROM (
        SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM (
            SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 1800000000 THEN 1 ELSE 0 END AS new FROM (
                SELECT user_id, trace_id, span_id, min(epoch_us(start_time)) AS t FROM spans
                WHERE user_id IS NOT NULL AND start_time IS NOT NULL GROUP BY 1, 2, 3)))
    GROUP BY user_id, g
"""

_EVENT_KEY = """
    SELECT e.session_id, e.event_id, e.timestamp, CASE WHEN duration_ms >= 0 THEN duration_ms END AS ms, CASE
        WHEN k IN ('user', 'human') THEN 'user' WHEN k = 'assistant' THEN k WHEN k = 'subagent' THEN k
        WHEN k IN ('compaction', 'compactboundary') THEN 'compaction'
        WHEN f IS NULL OR f = '' THEN 'tool:unknown' ELSE 'tool:' || coalesce(c.tool_name, trim(e.tool_name)) END AS event_key
    FROM (SELECT *, regexp_replace(lower(event_type), '[^a-z]', '', 'g') AS k,
                 regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(tool_name, '^\\s+|\\s+$', '', 'g')), '^(claude_code_tool_|tool_)', ''), '^mcp[^a-z0-9]+', ''), '[^a-z0-9]', '', 'g') AS f
          FROM session_events WHERE session_id IS NOT NULL) e
    LEFT JOIN (SELECT *, regexp_replace(regexp_replace(lower(tool_name), '^mcp[^a-z0-9]+', ''), '[^a-z0-9]', '', 'g') AS cf FROM tool_catalog) c ON c.cf = e.f
"""

SQL = {
    "p1_found": """
    WITH RECURSIVE texts AS (
        SELECT 'spans' AS src_table, CAST(id AS VARCHAR) AS row_key, 'raw_attributes' AS field, raw_attributes AS j FROM spans
        UNION ALL SELECT DISTINCT * FROM (
            SELECT 'claude_session_with_subagent', uuid, 'message.content', message.content FROM claude_session_with_subagent
            UNION ALL SELECT 'claude_session_with_subagent', uuid, 'toolUseResult', toolUseResult FROM claude_session_with_subagent)),
    n AS (
        SELECT src_table, row_key, field, CAST(j AS JSON) AS j, '' AS node_path, '' AS parent_path, '' AS up, FALSE AS listed FROM texts WHERE json_valid(j)
        UNION ALL
        SELECT src_table, row_key, field, c.j, n.node_path || '/' || c.k, CASE WHEN listed THEN n.node_path ELSE up END, CASE WHEN listed THEN n.node_path ELSE up END,
               json_type(n.j) = 'ARRAY' AND json_type(c.j) = 'OBJECT'
        FROM n, LATERAL (
            SELECT unnest(CASE json_type(n.j) WHEN 'ARRAY' THEN list_transform(range(CAST(json_array_length(n.j) AS BIGINT)), lambda i: {'k': CAST(i AS VARCHAR), 'j': json_extract(n.j, '/' || i)})
                   ELSE list_transform(json_keys(n.j), lambda x: {'k': replace(replace(x, '~', '~0'), '/', '~1'), 'j': json_extract(n.j, '/' || replace(replace(x, '~', '~0'), '/', '~1'))}) END) AS c)
        WHERE json_type(n.j) IN ('ARRAY', 'OBJECT'))
    SELECT src_table, row_key, field, node_path, parent_path FROM n WHERE listed
    """,
    "p2_found": f"WITH RECURSIVE {_TREE} SELECT trace_id, span_id, root_id, depth FROM down UNION ALL SELECT trace_id, span_id, root_id, -1 FROM bad",
    "p2_paths": f"WITH RECURSIVE {_TREE} SELECT trace_id, span_id, root_id, depth, path FROM down UNION ALL SELECT trace_id, span_id, root_id, -1, NULL FROM bad",
    "p2_descendants": f"""
    WITH RECURSIVE {_TREE}, over AS (
        SELECT trace_id, span_id AS descendant_id, parent_id AS above, 1 AS distance, [span_id] AS seen FROM e WHERE parent_id <> span_id
        UNION ALL
        SELECT o.trace_id, o.descendant_id, e.parent_id, o.distance + 1, list_append(o.seen, o.above) FROM over o JOIN e ON e.trace_id = o.trace_id AND e.span_id = o.above
        WHERE e.parent_id IS NOT NULL AND e.parent_id <> o.above AND NOT list_contains(o.seen, e.parent_id))
    SELECT trace_id, above AS span_id, descendant_id, distance FROM over
    """,
    "p3_found": f"SELECT session_id, event_key, count(DISTINCT event_id) AS n_events, epoch_us(max(timestamp)) AS last_us FROM ({_EVENT_KEY}) GROUP BY 1, 2",
    "p3_wide": f"""
    WITH o AS (SELECT session_id, event_key, event_id, epoch_us(max(timestamp)) AS us, max(ms) AS ms FROM ({_EVENT_KEY}) WHERE event_id IS NOT NULL GROUP BY 1, 2, 3),
    f AS (SELECT session_id, event_key, count(*) AS n, max(us) AS us, coalesce(sum(ms), 0)::BIGINT AS ms FROM o GROUP BY 1, 2)
    SELECT session_id, '{{' || string_agg('"' || event_key || '":' || n, ',' ORDER BY event_key) || '}}' AS n_events, '{{' || string_agg('"' || event_key || '":' || coalesce(us::VARCHAR, 'null'), ',' ORDER BY event_key) || '}}' AS last_us,
           '{{' || string_agg('"' || event_key || '":' || ms, ',' ORDER BY event_key) || '}}' AS duration_ms, sum(n)::BIGINT AS total_events, max(us) AS session_last_us FROM f GROUP BY 1
    """,
    "p4_found": _GAPS,
}
