"""Queries of the trace operators over the project's tables. Each is registered with @query and, where SQL can express it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracequarry.functions import classify as C
from tracequarry.functions import identity as I
from tracequarry.functions import text as T
from tracequarry.functions.literals import as_json
from tracequarry.functions.slim import slim
from tracequarry.functions.times import duration_ms, iso_week, parse_time
from tracequarry.operators import hierarchy, links, metrics, query, transcript, unify
from tracequarry.operators.sessions import gap_sessions
from tracequarry.plans import fragments as S
from tracequarry.session import scratch, table
from tracequarry.streaming import live

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """Queries and SQL by name, and the decorator that puts a query and, if it has one, its SQL into them."""
    queries: dict[str, Query] = {}
    sqls: dict[str, str] = {}

    def register(sql: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return put

    return queries, sqls, register


QUERIES, SQL, register = registry()


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "spans")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "session_events")


def _lines(spark: SparkSession, d: str, name: str = "claude_session_with_subagent") -> DataFrame:
    return transcript.lines(table(spark, d, name))


# Filters


@register("SELECT id, session_id, name, start_time FROM spans WHERE status_code = 'ERROR' AND start_time >= TIMESTAMPTZ '2026-10-05 00:00:00+00' AND start_time <= TIMESTAMPTZ '2026-10-12 00:00:00+00'")
def filter_errors_in_time(spark, d):
    df = query.filter_spans(_spans(spark, d), status="ERROR", start="2026-10-05 00:00:00", end="2026-10-12 00:00:00")
    return df.select("id", "session_id", "name", "start_time")


@register("SELECT id, llm_model_name FROM spans WHERE contains(lower(llm_model_name), 'sonnet')")
def filter_model(spark, d):
    return query.filter_spans(_spans(spark, d), model="Sonnet").select("id", "llm_model_name")


@register("SELECT id, name, status_code FROM spans WHERE contains(lower(name), 'tool_') AND status_code = 'OK'")
def filter_name_and_status(spark, d):
    return query.filter_spans(_spans(spark, d), name="tool_", status="OK").select("id", "name", "status_code")


@register("""
    SELECT id FROM spans WHERE regexp_matches(coalesce(input_value, ''), '(?i)retr(y|ies)\\b') OR regexp_matches(coalesce(output_value, ''), '(?i)retr(y|ies)\\b')
""")
def regex_search(spark, d):
    return query.filter_spans(_spans(spark, d), pattern=r"retr(y|ies)\b", fields=("input_value", "output_value")).select("id")


@register(r"""
    WITH f AS (SELECT id, 'input_value' AS field, input_value AS t FROM spans UNION ALL SELECT id, 'output_value', output_value FROM spans),
    m AS (SELECT id, field, t, string_split_regex(t, '(?:WARN|ERROR) \w+\[\d+\]') AS p, regexp_extract_all(t, '(?:WARN|ERROR) \w+\[\d+\]') AS m FROM f WHERE regexp_matches(t, '(?:WARN|ERROR) \w+\[\d+\]')),
    u AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m),
    x AS (SELECT id, field, t, m[i] AS match, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS a FROM u)
    SELECT id, field, a AS start, CAST(a + length(match) AS INTEGER) AS "end", match, CASE WHEN a > 20 THEN '...' ELSE '' END || substring(t, greatest(a - 20, 0) + 1, least(a, 20) + length(match) + 20) || CASE WHEN a + length(match) + 20 < length(t) THEN '...' ELSE '' END AS context FROM x
""".replace("\\\\", "\\"))
def regex_matches_with_context(spark, d):
    return query.matches(_spans(spark, d), r"(WARN|ERROR) (?P<what>\w+)\[\d+\]", fields=("input_value", "output_value"), around=20, ignore_case=False)


@register("""
    SELECT DISTINCT field, value FROM (
        SELECT 'input_value' AS field, unnest(regexp_extract_all(coalesce(input_value, ''), '[\\w/]+\\.(?:py|ts)')) AS value FROM spans
        UNION ALL SELECT 'output_value', unnest(regexp_extract_all(coalesce(output_value, ''), '[\\w/]+\\.(?:py|ts)')) FROM spans)
""")
def pattern_unique_values(spark, d):
    return query.extract(_spans(spark, d), r"[\w/]+\.(?:py|ts)", fields=("input_value", "output_value")).distinct()


@register("""
    SELECT value, count(*) AS n, count(DISTINCT session_id) AS sessions FROM (
        SELECT session_id, unnest(regexp_extract_all(coalesce(output_value, ''), '(INFO|WARN|ERROR|DEBUG) \\w+', 0)) AS value FROM spans) GROUP BY value
""")
def pattern_groups(spark, d):
    return query.extract(_spans(spark, d), r"(INFO|WARN|ERROR|DEBUG) \w+", fields=("output_value",), by=("session_id",)).groupBy("value").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"))


@register("""
    SELECT skill, count(*) AS n FROM (
        SELECT CASE WHEN json_valid(raw_attributes) THEN json_extract_string(raw_attributes, '$.attributes.input.value') END AS v FROM spans WHERE name = 'Claude_Code_Tool_Skill'),
        LATERAL (SELECT CASE WHEN json_valid(v) THEN nullif(json_extract_string(v, '$.input.skill'), '') END AS skill) GROUP BY skill
""")
def skill_use(spark, d):
    s = _spans(spark, d).filter(F.col("name") == query.SKILL_SPAN)
    return s.groupBy(query.skill_name(F.col("name"), F.col("raw_attributes")).alias("skill")).agg(F.count("*").alias("n"))


@register("""
    SELECT skill, count(*) AS calls, count(*) FILTER (upper(coalesce(status_code, '')) IN ('OK', 'SUCCESS', '')) AS successes FROM (
        SELECT status_code, CASE WHEN json_valid(raw_attributes) THEN json_extract_string(raw_attributes, '$.attributes.input.value') END AS v FROM spans WHERE name = 'Claude_Code_Tool_Skill'),
        LATERAL (SELECT CASE WHEN json_valid(v) THEN nullif(json_extract_string(v, '$.input.skill'), '') END AS skill) WHERE skill IS NOT NULL GROUP BY skill
""")
def skill_breakdown(spark, d):
    return metrics.skills(_spans(spark, d))


@register("""
    SELECT session_id, count(*) AS span_count, min(start_time) AS start_time, max(end_time) AS end_time FROM spans WHERE session_id IS NOT NULL GROUP BY 1
    HAVING count(*) >= 5 AND bool_or(contains(concat_ws(' ', input_value, output_value, name, raw_attributes), 'Bash')) AND bool_or(contains(concat_ws(' ', input_value, output_value, name, raw_attributes), 'Edit'))
""")
def sessions_with_tools(spark, d):
    return query.list_sessions(_spans(spark, d), min_spans=5, tools=("Bash", "Edit"))


@register(f"SELECT session_id, event_id FROM session_events WHERE {S.human('text')}")
def human_turns(spark, d):
    return _events(spark, d).filter(T.is_human_turn(F.col("text"))).select("session_id", "event_id")


@register(f"SELECT session_id, event_id FROM session_events WHERE lower(event_type) = 'user' AND {S.live('text')}")
def live_human_turns(spark, d):
    return _events(spark, d).filter((F.lower("event_type") == "user") & T.is_live_human_turn(F.col("text"))).select("session_id", "event_id")


@register("SELECT id FROM spans WHERE NOT contains(coalesce(raw_attributes, ''), 'redacted') AND NOT contains(coalesce(raw_attributes, ''), 'dal_trim') AND coalesce(lower(regexp_replace(output_value, '^\\s+|\\s+$', '', 'g')) NOT IN ('', 'none', 'nan', 'null', '[]', '{}'), false)")
def filter_unredacted_nonempty(spark, d):
    return _spans(spark, d).filter(~T.contains_any(F.col("raw_attributes"), ("redacted", "dal_trim")) & T.nonempty(F.col("output_value"))).select("id")


@register("SELECT session_id, event_id, order_idx FROM session_events WHERE lower(event_type) = 'tool' AND tool_name = 'Bash' AND tool_input ILIKE '%git diff%'")
def filter_events(spark, d):
    return _events(spark, d).filter((F.lower("event_type") == "tool") & (F.col("tool_name") == "Bash") & F.col("tool_input").ilike("%git diff%")).select("session_id", "event_id", "order_idx")


# Grouping and metrics


@register("SELECT session_id, count(*) AS span_count, min(start_time) AS start_time, max(end_time) AS end_time FROM spans WHERE session_id IS NOT NULL GROUP BY 1")
def session_listing(spark, d):
    return query.newest_first(query.sessions(_spans(spark, d)))


@register("""
    WITH p AS (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY start_time NULLS FIRST, id) - 1) // 100 AS part FROM spans WHERE session_id IS NOT NULL), n AS (SELECT session_id, count(*) AS span_count, min(start_time) AS start_time, max(end_time) AS end_time FROM spans GROUP BY 1)
    SELECT session_id, CAST(part AS INTEGER) AS part, any_value(n.span_count) AS span_count, any_value(n.start_time) AS start_time, any_value(n.end_time) AS end_time, string_agg(CAST(id AS VARCHAR), ',' ORDER BY p.start_time NULLS FIRST, id) AS span_ids FROM p JOIN n USING (session_id) GROUP BY 1, 2
""")
def sessions_nested(spark, d):
    s = query.nested_sessions(_spans(spark, d), part_spans=100)
    return s.select("session_id", "part", "span_count", "start_time", "end_time", F.array_join(F.transform("spans", lambda x: x["id"].cast("string")), ",").alias("span_ids"))


@register(f"SELECT category, confidence, count(*) AS n FROM ({S.CATEGORY}) GROUP BY 1, 2")
def span_categories(spark, d):
    return metrics.with_category(_spans(spark, d)).groupBy("category", "confidence").agg(F.count("*").alias("n"))


@register(f"SELECT c.category, count(s.category) AS spans FROM (SELECT unnest(['tools', 'haiku_holdover', 'main', 'internal', 'quota', 'unknown']) AS category) c LEFT JOIN ({S.CATEGORY}) s USING (category) GROUP BY 1")
def category_histogram(spark, d):
    return metrics.category_counts(_spans(spark, d))


@register(f"SELECT thread_type, count(*) AS n FROM ({S.THREAD}) GROUP BY 1")
def thread_types(spark, d):
    return _spans(spark, d).groupBy(C.thread_type().alias("thread_type")).agg(F.count("*").alias("n"))


@register(f"""
    SELECT session_id, count(*) FILTER (thread_type = 'main_thread') AS main_thread, count(*) FILTER (thread_type = 'ancillary') AS ancillary,
           count(*) FILTER (thread_type = 'sub_agent') AS sub_agent, count(*) FILTER (thread_type = 'unknown') AS unknown FROM ({S.THREAD}) WHERE session_id IS NOT NULL GROUP BY 1
""")
def thread_summary(spark, d):
    kinds = ("main_thread", "ancillary", "sub_agent", "unknown")
    s = _spans(spark, d).filter("session_id IS NOT NULL").withColumn("t", C.thread_type())
    return s.groupBy("session_id").agg(*(F.count_if(F.col("t") == k).alias(k) for k in kinds))


@register(f"SELECT doc_id, kind, confidence FROM ({S.COMPACTION}) WHERE kind IS NOT NULL")
def compactions(spark, d):
    c = C.compaction(F.col("text"), F.lit("litellm_request"))
    return table(spark, d, "documents").select("doc_id", c.alias("c")).filter("c IS NOT NULL").select("doc_id", "c.kind", F.round("c.confidence", 4).alias("confidence"))


@register(f"SELECT doc_id AS id, kind, confidence FROM ({S.SPAN_COMPACTION}) WHERE kind IS NOT NULL")
def span_compactions(spark, d):
    """The spans whose input is a compaction, by their input and name."""
    c = C.compaction(F.col("input_value"), F.col("name"))
    return _spans(spark, d).select("id", c.alias("c")).filter("c IS NOT NULL").select("id", "c.kind", F.round("c.confidence", 4).alias("confidence"))


@register(f"SELECT doc_id AS id, score FROM ({S.SPAN_COMPACTION}) WHERE score > 0")
def span_compaction_scores(spark, d):
    """The spans that show some sign of a compaction, with their points; from 55 on they are taken for one."""
    s = _spans(spark, d).select("id", C.compaction_score(F.col("input_value"), F.col("name")).alias("score"))
    return s.filter("score > 0")


@register(f"""
    SELECT session_id, count(*) AS span_count, count(*) FILTER (category = 'main' OR (category <> 'haiku_holdover' AND (contains(coalesce(name, ''), 'Internal_Prompt') OR contains(coalesce(name, ''), 'Final_Output')))) AS turn_count,
           count(*) FILTER (category = 'tools') AS tool_call_count, count(*) FILTER (upper(coalesce(status_code, '')) IN ('ERROR', 'FAILED', 'FAILURE')) AS failure_count,
           count(*) FILTER (category = 'main') AS main_model_calls, count(*) FILTER (category = 'haiku_holdover') AS haiku_calls,
           coalesce(sum(llm_token_count_prompt), 0)::BIGINT AS prompt_tokens, coalesce(sum(llm_token_count_completion), 0)::BIGINT AS completion_tokens,
           (CASE WHEN coalesce(sum(llm_token_count_total), 0) = 0 THEN coalesce(sum(llm_token_count_prompt), 0) + coalesce(sum(llm_token_count_completion), 0) ELSE sum(llm_token_count_total) END)::BIGINT AS total_tokens,
           least(min(start_time), min(end_time)) AS first_activity, greatest(max(start_time), max(end_time)) AS last_activity,
           coalesce((epoch_us(greatest(max(start_time), max(end_time))) - epoch_us(least(min(start_time), min(end_time)))) / 1e6, 0.0) AS duration_seconds
    FROM ({S.CATEGORY}) WHERE session_id IS NOT NULL GROUP BY 1
""")
def session_metrics(spark, d):
    return metrics.session_metrics(_spans(spark, d))


@register("""
    SELECT session_id, count(*) AS span_count, min(start_time) AS first_span_time, max(start_time) AS last_span_time, coalesce(sum(llm_token_count_prompt), 0)::BIGINT AS total_prompt_tokens,
           coalesce(sum(llm_token_count_completion), 0)::BIGINT AS total_completion_tokens, coalesce(sum(llm_token_count_total), 0)::BIGINT AS total_tokens,
           coalesce(string_agg(DISTINCT llm_model_name, ',' ORDER BY llm_model_name), '') AS models_used, coalesce(bool_or(status_code = 'ERROR'), false) AS has_errors
    FROM spans WHERE session_id IS NOT NULL GROUP BY 1
""")
def session_rows(spark, d):
    return metrics.session_rows(_spans(spark, d))


@register(f"""
    WITH m AS (SELECT session_id, count(*) AS n, count(*) FILTER (category = 'tools') AS tools, coalesce(sum(llm_token_count_prompt), 0) AS p, coalesce(sum(llm_token_count_completion), 0) AS c, coalesce(sum(llm_token_count_total), 0) AS t,
                      count(*) FILTER (category = 'main' OR (category <> 'haiku_holdover' AND (contains(coalesce(name, ''), 'Internal_Prompt') OR contains(coalesce(name, ''), 'Final_Output')))) AS turns,
                      count(*) FILTER (upper(coalesce(status_code, '')) IN ('ERROR', 'FAILED', 'FAILURE')) AS failures
               FROM ({S.CATEGORY}) WHERE session_id IS NOT NULL GROUP BY 1)
    SELECT count(*) AS sessions, sum(n)::BIGINT AS total_span_count, sum(turns)::BIGINT AS total_turn_count, sum(tools)::BIGINT AS total_tool_call_count, sum(failures)::BIGINT AS total_failure_count, sum(CASE WHEN t = 0 THEN p + c ELSE t END)::BIGINT AS total_total_tokens,
           round(avg(turns), 2) AS avg_turn_count, round(avg(tools), 2) AS avg_tool_call_count, round(avg(CASE WHEN t = 0 THEN p + c ELSE t END), 2) AS avg_total_tokens FROM m
""")
def all_session_totals(spark, d):
    return metrics.all_sessions(metrics.session_metrics(_spans(spark, d)))


@register(f"SELECT * FROM ({S.TOOL_STATS})")
def tool_statistics(spark, d):
    return metrics.tool_stats(_spans(spark, d))


@register(f"SELECT * FROM ({S.TOOL_STATS}) ORDER BY calls DESC, tool LIMIT 10")
def top_ten_tools(spark, d):
    return metrics.top_tools(metrics.tool_stats(_spans(spark, d)))


@register(f"SELECT * FROM ({S.TOOL_STATS}) WHERE avg_ms IS NOT NULL ORDER BY avg_ms DESC, tool LIMIT 10")
def slowest_ten_tools(spark, d):
    return metrics.slowest_tools(metrics.tool_stats(_spans(spark, d)))


@register(f"SELECT failure, count(*) AS n FROM ({S.FAILURES}) GROUP BY 1")
def failure_summary(spark, d):
    return metrics.failure_counts(metrics.failures(_spans(spark, d)))


@register(f"SELECT id, session_id, failure, context FROM ({S.FAILURES})")
def failures_with_context(spark, d):
    return metrics.failures(_spans(spark, d))


@register(f"""
    WITH s AS (SELECT id, {S.OPERATION} AS op, {S.FILE_PATH} AS file FROM spans),
    n AS (SELECT *, lead(op) OVER (PARTITION BY file ORDER BY id) AS nxt FROM s WHERE op IS NOT NULL AND file IS NOT NULL)
    SELECT file, count(*) FILTER (op = 'edit') AS edits, count(*) FILTER (op = 'write') AS writes, count(*) AS operations, coalesce(bool_or(op = 'write' AND nxt = 'edit'), false) AS write_then_edit,
           count(*) FILTER (op = 'edit') >= 3 AS multi_edit FROM n GROUP BY 1
""")
def file_churn(spark, d):
    return metrics.churn(_spans(spark, d))


@register(f"SELECT id, session_id, category, system_tokens, user_tokens, model_tokens, tool_tokens, raw_input_tokens, raw_output_tokens, raw_total_tokens FROM ({S.TOKENS})")
def token_breakdown(spark, d):
    return metrics.token_breakdown(_spans(spark, d))


@register(f"""
    SELECT session_id, sum(system_tokens)::BIGINT AS system_tokens, sum(user_tokens)::BIGINT AS user_tokens, sum(model_tokens)::BIGINT AS model_tokens, sum(tool_tokens)::BIGINT AS tool_tokens,
           sum(raw_input_tokens)::BIGINT AS raw_input_tokens, sum(raw_output_tokens)::BIGINT AS raw_output_tokens, sum(raw_total_tokens)::BIGINT AS raw_total_tokens, count(*) FILTER (category = 'tools') AS tool_spans,
           count(*) FILTER (category IN ('main', 'haiku_holdover')) AS llm_spans, count(*) FILTER (category = 'internal') AS internal_spans
    FROM ({S.TOKENS}) WHERE session_id IS NOT NULL GROUP BY 1
""")
def session_tokens(spark, d):
    return metrics.session_tokens(metrics.token_breakdown(_spans(spark, d)))


@register("""
    SELECT account_id, CAST(start_time AS DATE) AS day, sum(coalesce(llm_token_count_prompt, 0))::BIGINT AS prompt, sum(coalesce(llm_token_count_completion, 0))::BIGINT AS completion,
           round(sum(coalesce(llm_token_count_prompt, 0)) / 1e6 * 3.0 + sum(coalesce(llm_token_count_completion, 0)) / 1e6 * 15.0, 6) AS cost FROM spans GROUP BY 1, 2
""")
def cost_by_account_and_day(spark, d):
    s = _spans(spark, d).groupBy("account_id", F.to_date("start_time").alias("day")).agg(F.sum(F.coalesce("llm_token_count_prompt", F.lit(0))).alias("prompt"), F.sum(F.coalesce("llm_token_count_completion", F.lit(0))).alias("completion"))
    return s.withColumn("cost", metrics.cost(F.col("prompt"), F.col("completion")))


@register("SELECT iso_week, span_kind, count(*) AS n FROM (SELECT CASE WHEN start_time IS NULL THEN 'unknown' ELSE strftime(start_time, '%G-W%V') END AS iso_week, span_kind FROM spans) GROUP BY 1, 2")
def iso_week_counts(spark, d):
    return _spans(spark, d).groupBy(iso_week(F.col("start_time")).alias("iso_week"), "span_kind").agg(F.count("*").alias("n"))


@register("SELECT strftime(start_time, '%Y-%m') AS month, count(*) FILTER (span_kind = 'TOOL') AS tools, count(*) FILTER (span_kind = 'LLM') AS llm, round(count(*) FILTER (span_kind = 'TOOL') / nullif(count(*) FILTER (span_kind = 'LLM'), 0), 4) AS ratio FROM spans GROUP BY 1")
def autonomy_by_month(spark, d):
    g = _spans(spark, d).groupBy(F.date_format("start_time", "yyyy-MM").alias("month")).agg(F.count_if(F.col("span_kind") == "TOOL").alias("tools"), F.count_if(F.col("span_kind") == "LLM").alias("llm"))
    return g.withColumn("ratio", F.round(F.col("tools") / F.nullif("llm", F.lit(0)), 4))


@register("SELECT session_id, arg_min(input_value, id) FILTER (input_value IS NOT NULL) AS first_input, arg_max(output_value, id) FILTER (output_value IS NOT NULL) AS last_output FROM spans WHERE session_id IS NOT NULL GROUP BY 1")
def first_and_last_content(spark, d):
    return _spans(spark, d).filter("session_id IS NOT NULL").groupBy("session_id").agg(F.min_by("input_value", F.when(F.col("input_value").isNotNull(), F.col("id"))).alias("first_input"), F.max_by("output_value", F.when(F.col("output_value").isNotNull(), F.col("id"))).alias("last_output"))


@register("SELECT count(*) AS spans, count(DISTINCT session_id) AS sessions, count(DISTINCT trace_id) AS traces, min(start_time) AS first_time, max(start_time) AS last_time, count(*) FILTER (status_code = 'ERROR') AS errors FROM spans")
def span_totals(spark, d):
    return _spans(spark, d).agg(F.count("*").alias("spans"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("trace_id").alias("traces"), F.min("start_time").alias("first_time"), F.max("start_time").alias("last_time"), F.count_if(F.col("status_code") == "ERROR").alias("errors"))


@register("SELECT name, count(*) AS n FROM spans GROUP BY 1 ORDER BY n DESC, name LIMIT 15")
def top_span_names(spark, d):
    return _spans(spark, d).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(15)


@register("SELECT session_id, count(*) AS n FROM session_events WHERE event_type = 'subagent' AND session_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, session_id LIMIT 5")
def top_subagent_sessions(spark, d):
    return _events(spark, d).filter("event_type = 'subagent' AND session_id IS NOT NULL").groupBy("session_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "session_id").limit(5)


@register("SELECT regexp_extract(project_path, '/work/(\\w+)', 1) AS project, tool_name, count(*) AS n FROM session_events WHERE event_type = 'tool' GROUP BY 1, 2")
def tool_use_by_project(spark, d):
    return _events(spark, d).filter("event_type = 'tool'").groupBy(F.regexp_extract("project_path", r"/work/(\w+)", 1).alias("project"), "tool_name").agg(F.count("*").alias("n"))


@register("SELECT session_id, min(timestamp) AS first_mention FROM session_events WHERE text ILIKE '%flaky%' AND session_id IS NOT NULL GROUP BY 1")
def first_mentions(spark, d):
    return _events(spark, d).filter(F.col("text").ilike("%flaky%") & F.col("session_id").isNotNull()).groupBy("session_id").agg(F.min("timestamp").alias("first_mention"))


@register("""
    SELECT account_id, count(*) AS spans, max(start_time) AS last_seen, CASE WHEN bool_or(contains(coalesce(raw_attributes, ''), 'sandbox')) THEN 'sandbox' ELSE 'laptop' END AS surface FROM spans GROUP BY 1
""")
def account_roster(spark, d):
    box = F.bool_or(F.coalesce("raw_attributes", F.lit("")).contains("sandbox"))
    return _spans(spark, d).groupBy("account_id").agg(F.count("*").alias("spans"), F.max("start_time").alias("last_seen"), F.when(box, "sandbox").otherwise("laptop").alias("surface"))


@register("""
    SELECT session_id, coalesce(sum(llm_token_count_total), 0)::BIGINT AS tokens,
           array_to_string(list_sort(list_distinct(flatten(list(list_transform(regexp_extract_all(concat_ws(' ', input_value, output_value), '\\b([A-Z][A-Z0-9]+-\\d+)\\b', 1), lambda x: x))))), ',') AS tickets
    FROM spans WHERE session_id IS NOT NULL GROUP BY 1
""")
def session_context(spark, d):
    s = _spans(spark, d).filter("session_id IS NOT NULL")
    total = s.groupBy("session_id").agg(F.coalesce(F.sum("llm_token_count_total"), F.lit(0)).alias("tokens"))
    found = s.select("session_id", F.explode(T.tickets(F.concat_ws(" ", "input_value", "output_value"))).alias("ticket")).distinct()
    found = found.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list("ticket")), ",").alias("tickets"))  # a session's different tickets
    return total.join(found, "session_id", "left").withColumn("tickets", F.coalesce("tickets", F.lit("")))


@register(f"""
    WITH f AS (SELECT session_id, CASE failure WHEN 'error' THEN 'errors' WHEN 'back_to_back' THEN 'repeated_operations' ELSE 'rate_limits' END AS suggestion, count(*) AS n FROM ({S.FAILURES}) WHERE session_id IS NOT NULL AND failure IN ('error', 'back_to_back', 'rate_limit') GROUP BY 1, 2),
    o AS (SELECT id, session_id, {S.OPERATION} AS op, {S.FILE_PATH} AS file FROM spans WHERE session_id IS NOT NULL), p AS (SELECT *, lead(op) OVER (PARTITION BY session_id, file ORDER BY id) AS nxt FROM o WHERE op IS NOT NULL AND file IS NOT NULL),
    c AS (SELECT session_id, file, count(*) FILTER (op = 'edit') >= 3 AS multi, bool_or(op = 'write' AND nxt = 'edit') AS wte FROM p GROUP BY 1, 2),
    t AS (SELECT session_id, CASE WHEN coalesce(sum(llm_token_count_total), 0) = 0 THEN coalesce(sum(llm_token_count_prompt), 0) + coalesce(sum(llm_token_count_completion), 0) ELSE sum(llm_token_count_total) END::BIGINT AS n FROM spans WHERE session_id IS NOT NULL GROUP BY 1)
    SELECT session_id, suggestion, CASE WHEN suggestion = 'repeated_operations' THEN 'medium' ELSE 'high' END AS severity, n FROM f UNION ALL SELECT session_id, 'edit_churn', 'medium', count(*) FROM c WHERE multi GROUP BY 1
    UNION ALL SELECT session_id, 'write_then_edit', 'low', count(*) FROM c WHERE wte GROUP BY 1 UNION ALL SELECT session_id, 'many_tokens', 'medium', n FROM t WHERE n > 100000
""")
def suggestions(spark, d):
    return metrics.suggestions(_spans(spark, d))


# Identity and attribution


@register(f"SELECT id, {S.identity('user')} AS user_id, {S.identity('account')} AS account_id, coalesce({S.identity('session')}, trace_id, nullif(regexp_extract(input_value, 'session_([a-zA-Z0-9_-]+)', 1), '')) AS session_id FROM ({S.META})")
def identities(spark, d):
    s = I.with_identities(_spans(spark, d).select("id", "trace_id", "input_value", "raw_attributes"))
    return s.select("id", F.col("found_user").alias("user_id"), F.col("found_account").alias("account_id"), F.col("found_session").alias("session_id"))


@register(f"""
    SELECT s.id, coalesce(t.v, s.session_id) AS session_id FROM spans s LEFT JOIN (
        SELECT trace_id, arg_max(session_id, id) AS v FROM spans WHERE trace_id IS NOT NULL AND lower(trim(session_id)) NOT IN ('id', '', 'none', 'null', 'unknown') AND session_id <> trace_id GROUP BY 1) t USING (trace_id)
""")
def session_by_trace(spark, d):
    return unify.session_by_trace(_spans(spark, d)).select("id", "session_id")


@register(f"""
    SELECT s.id, CASE WHEN s.session_id = s.trace_id THEN coalesce(t.v, s.session_id) ELSE s.session_id END AS session_id FROM spans s LEFT JOIN (
        SELECT trace_id, arg_max(session_id, id) AS v FROM spans WHERE trace_id IS NOT NULL AND regexp_full_match(session_id, '{T.UUID}') AND session_id <> trace_id GROUP BY 1) t USING (trace_id)
""")
def session_by_trace_strict(spark, d):
    return unify.session_by_trace_strict(_spans(spark, d)).select("id", "session_id")


@register("""
    SELECT s.id, coalesce(t.u, s.user_id) AS user_id, coalesce(t.a, s.account_id) AS account_id FROM spans s LEFT JOIN (
        SELECT trace_id, arg_min(user_id, id) FILTER (user_id IS NOT NULL) AS u, arg_min(account_id, id) FILTER (account_id IS NOT NULL) AS a FROM spans WHERE trace_id IS NOT NULL GROUP BY 1) t USING (trace_id)
""")
def users_by_trace(spark, d):
    return unify.users_by_trace(_spans(spark, d)).select("id", "user_id", "account_id")


@register("""
    WITH p AS (SELECT lower(trim(account_id)) AS k, min(person_name) AS person, min(email) AS email FROM identity_map WHERE account_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT person_name) = 1)
    SELECT label, count(*) AS spans FROM (
        SELECT CASE WHEN coalesce(trim(s.account_id), '') = '' THEN '(unattributed)' WHEN p.k IS NULL THEN '(unclaimed:' || lower(trim(s.account_id))[1:8] || ')' ELSE coalesce(p.email, p.person) END AS label
        FROM spans s LEFT JOIN p ON p.k = lower(trim(s.account_id))) GROUP BY 1
""")
def spans_by_person(spark, d):
    return unify.with_identity(_spans(spark, d), table(spark, d, "identity_map")).groupBy("label").agg(F.count("*").alias("spans"))


@register()
def attributes_as_json(spark, d):
    """Attributes that are Python literals come out as JSON, unreadable ones are null."""
    return _spans(spark, d).select("id", as_json(F.col("raw_attributes")).alias("attributes"))


@register()
def slim_attributes(spark, d):
    """(source, spans, bytes_before, bytes_after): what attributes weigh with and without repeated and empty values."""
    s = _spans(spark, d).select("source", F.col("raw_attributes").alias("a"), slim(F.col("raw_attributes")).alias("b"))
    size = lambda c: F.coalesce(F.sum(F.octet_length(c)), F.lit(0))
    return s.groupBy("source").agg(F.count("*").alias("spans"), size("a").alias("bytes_before"), size("b").alias("bytes_after"))


@register("""
    WITH o AS (SELECT arg_min(user_id, (start_time, user_id)) FILTER (user_id IS NOT NULL) AS user_id, min(start_time) AS t FROM spans WHERE start_time IS NOT NULL GROUP BY trace_id, span_id),
    g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM o WHERE user_id IS NOT NULL), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM g)
    SELECT user_id, min(t) AS start_time, max(t) AS end_time, count(*) AS spans FROM n GROUP BY user_id, g HAVING max(t) + INTERVAL 30 MINUTE <= (SELECT max(t) - INTERVAL 1 DAY FROM o)
""")
def closed_stream_sessions(spark, d):
    """Working sessions by a stream with a watermark: those closed at the end of the data."""
    return live.stored_sessions(spark, f"{d}/spans.parquet", scratch(spark, "closed-sessions"))


# Deduplication and merges


def _halves(spark, d):
    s = _spans(spark, d)
    return s.filter("source <> 'arize-main'"), s.filter("source = 'arize-main'")


@register("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY span_id ORDER BY id DESC) AS r FROM spans) WHERE r = 1")
def dedupe_keep_last(spark, d):
    return unify.keep_last(_spans(spark, d).select("id", "span_id"), ["span_id"]).select("id")


@register("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY trace_id ORDER BY id) AS r FROM spans WHERE trace_id IS NOT NULL) WHERE r = 1")
def dedupe_keep_first(spark, d):
    return unify.keep_first(_spans(spark, d).select("id", "trace_id"), ["trace_id"]).select("id")


@register("SELECT id FROM (SELECT id, trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY id DESC) AS r FROM spans) WHERE r = 1 OR trace_id IS NULL")
def dedupe_keep_nulls(spark, d):
    return unify.keep_last(_spans(spark, d).select("id", "trace_id"), ["trace_id"], keep_null_keys=True).select("id")


@register("""
    SELECT id, span_id, session_id, CASE WHEN source <> 'arize-main' THEN name END AS name, CASE WHEN source = 'arize-main' THEN status_code END AS status_code FROM (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY source = 'arize-main' DESC, id DESC) AS r FROM spans) WHERE r = 1
""")
def unify_sources(spark, d):
    """Both halves with columns of their own, which the other lacks."""
    old, new = _halves(spark, d)
    return unify.unify(old.select("id", "span_id", "session_id", "name"), new.select("id", "span_id", "session_id", "status_code"))


@register("""
    WITH o AS (SELECT * FROM spans WHERE source <> 'arize-main'), n AS (SELECT * FROM spans WHERE source = 'arize-main'),
    s AS (SELECT session_id, bool_or(source <> 'arize-main') AS o, bool_or(source = 'arize-main') AS n FROM spans WHERE session_id IS NOT NULL GROUP BY 1)
    SELECT (SELECT count(*) FROM s WHERE n AND NOT o) AS new_sessions, (SELECT count(*) FROM s WHERE n AND o) AS continued_sessions, (SELECT count(*) FROM o) AS spans_before, (SELECT count(*) FROM n) AS spans_new,
           (SELECT count(*) - count(DISTINCT span_id) FROM spans) AS duplicates_removed, (SELECT count(DISTINCT span_id) FROM spans) AS spans_after
""")
def unify_report(spark, d):
    return unify.unify_report(*_halves(spark, d))


@register("SELECT id FROM spans WHERE source = 'arize-main' AND trace_id NOT IN (SELECT trace_id FROM spans WHERE source <> 'arize-main' AND trace_id IS NOT NULL) OR source = 'arize-main' AND trace_id IS NULL")
def only_new_traces(spark, d):
    old, new = _halves(spark, d)
    return unify.only_new(new, old, "trace_id").select("id")


@register("""
    WITH o AS (SELECT session_id, min(start_time) AS first_seen, max(end_time) AS last_seen, list_sort(list_distinct(list(llm_model_name))) AS models FROM spans WHERE source <> 'arize-main' AND session_id IS NOT NULL GROUP BY 1),
    n AS (SELECT session_id, min(start_time) AS first_seen, max(end_time) AS last_seen, list_sort(list_distinct(list(llm_model_name))) AS models FROM spans WHERE source = 'arize-main' AND session_id IS NOT NULL GROUP BY 1)
    SELECT session_id, least(o.first_seen, n.first_seen) AS first_seen, greatest(o.last_seen, n.last_seen) AS last_seen,
           array_to_string(list_sort(list_distinct(list_concat(coalesce(o.models, []), coalesce(n.models, [])))), ',') AS models FROM o FULL JOIN n USING (session_id)
""")
def upsert_sessions(spark, d):
    def s(df):
        return df.filter("session_id IS NOT NULL").groupBy("session_id").agg(F.min("start_time").alias("first_seen"), F.max("end_time").alias("last_seen"), F.collect_set("llm_model_name").alias("models"))

    old, new = _halves(spark, d)
    u = unify.upsert(s(old), s(new), "session_id", first=("first_seen",), last=("last_seen",), unions=("models",))
    return u.withColumn("models", F.array_join("models", ","))


@register("""
    SELECT strftime(start_time, '%G-W%V') AS week, span_kind, count(*) FILTER (source <> 'arize-main') AS old_spans, count(*) FILTER (source = 'arize-main') AS new_spans FROM spans WHERE start_time IS NOT NULL GROUP BY 1, 2
    HAVING count(*) FILTER (source <> 'arize-main') <> count(*) FILTER (source = 'arize-main')
""")
def reconcile_by_week(spark, d):
    def g(df, name):
        return df.filter("start_time IS NOT NULL").groupBy(iso_week(F.col("start_time")).alias("week"), F.coalesce("span_kind", F.lit("\0")).alias("span_kind")).agg(F.count("*").alias(name))

    old, new = _halves(spark, d)
    j = g(old, "old_spans").join(g(new, "new_spans"), ["week", "span_kind"], "full").fillna(0, ["old_spans", "new_spans"])
    return j.filter("old_spans <> new_spans").withColumn("span_kind", F.nullif("span_kind", F.lit("\0")))


@register("SELECT session_id FROM spans WHERE source <> 'arize-main' AND session_id IS NOT NULL INTERSECT SELECT session_id FROM spans WHERE source = 'arize-main' AND session_id IS NOT NULL")
def continued_sessions(spark, d):
    old, new = _halves(spark, d)
    return old.filter("session_id IS NOT NULL").select("session_id").intersect(new.filter("session_id IS NOT NULL").select("session_id"))


# Links and windows


@register("""
    SELECT p.name AS parent_name, c.name AS name, count(*) AS n FROM (SELECT DISTINCT trace_id, span_id, parent_id, name FROM spans) c
    JOIN (SELECT DISTINCT trace_id, span_id, name FROM spans) p ON p.trace_id = c.trace_id AND p.span_id = c.parent_id GROUP BY 1, 2
""")
def parent_child_names(spark, d):
    s = _spans(spark, d)
    c = s.select("trace_id", "span_id", "parent_id", "name").distinct()
    p = s.select("trace_id", F.col("span_id").alias("parent_id"), F.col("name").alias("parent_name")).distinct()
    return c.join(p, ["trace_id", "parent_id"]).groupBy("parent_name", "name").agg(F.count("*").alias("n"))


@register(f"""
    WITH RECURSIVE s AS (SELECT trace_id, span_id, min(parent_id) AS parent_id, min(name) AS name FROM spans WHERE trace_id IS NOT NULL GROUP BY 1, 2),
    up AS (SELECT trace_id, span_id, parent_id AS at, 1 AS depth FROM s WHERE name IN {S.LLM_NAMES}
           UNION ALL SELECT u.trace_id, u.span_id, s.parent_id, u.depth + 1 FROM up u JOIN s ON s.trace_id = u.trace_id AND s.span_id = u.at AND s.name <> 'Claude_Code_Tool_Task' WHERE u.depth < 15)
    SELECT u.trace_id, u.span_id, s.span_id AS task_id, u.depth AS distance FROM up u JOIN s ON s.trace_id = u.trace_id AND s.span_id = u.at AND s.name = 'Claude_Code_Tool_Task'
""")
def nearest_task_ancestor(spark, d):
    """The nearest Task at most 15 levels above each LLM request, circles or not."""
    s = _spans(spark, d).filter("trace_id IS NOT NULL")
    names = s.groupBy("trace_id", "span_id").agg(F.min("name").alias("name"))
    task = names.filter("name = 'Claude_Code_Tool_Task'")
    llm = names.filter(F.col("name").isin(*S.LLM_NAMES)).select("trace_id", "span_id")
    near = hierarchy.nearest_above(s, task, levels=15).join(llm, ["trace_id", "span_id"], "left_semi")
    return near.select("trace_id", "span_id", F.col("above_id").alias("task_id"), "distance")


@register("SELECT trace_id FROM spans WHERE trace_id IS NOT NULL GROUP BY 1 HAVING bool_and(coalesce(status_code, '') = 'OK')")
def traces_all_ok(spark, d):
    s = _spans(spark, d).filter("trace_id IS NOT NULL")
    return s.select("trace_id").distinct().join(s.filter("coalesce(status_code, '') <> 'OK'").select("trace_id"), "trace_id", "left_anti")


@register("""
    WITH s AS (SELECT *, start_time - lag(start_time) OVER (PARTITION BY session_id ORDER BY start_time, id) AS gap FROM spans WHERE session_id IS NOT NULL AND start_time IS NOT NULL),
    b AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start_time, id ROWS UNBOUNDED PRECEDING) AS block FROM s)
    SELECT session_id, CAST(block AS BIGINT) AS block, min(start_time) AS start_time, max(start_time) AS end_time, count(*) AS spans, coalesce(sum(llm_token_count_total), 0)::BIGINT AS tokens FROM b GROUP BY 1, 2 HAVING count(*) >= 4
""")
def idle_blocks(spark, d):
    s = _spans(spark, d).select("session_id", F.unix_micros("start_time").alias("us"), F.col("llm_token_count_total").alias("tokens"))
    g = gap_sessions(s, key="session_id", time_us="us", sums=("tokens",), numbered=True).filter("n >= 4")
    return g.select("session_id", "block", F.timestamp_micros("start_us").alias("start_time"), F.timestamp_micros("end_us").alias("end_time"), F.col("n").alias("spans"), "tokens")


@register("SELECT session_id, event_id, order_idx FROM (SELECT *, lag(order_idx) OVER (PARTITION BY session_id ORDER BY timestamp, event_id, order_idx, text, tool_name) AS before FROM session_events WHERE session_id IS NOT NULL) WHERE order_idx <= before")
def order_violations(spark, d):
    w = Window.partitionBy("session_id").orderBy(F.col("timestamp").asc_nulls_last(), "event_id", "order_idx", F.col("text").asc_nulls_last(), F.col("tool_name").asc_nulls_last())
    return _events(spark, d).filter("session_id IS NOT NULL").withColumn("before", F.lag("order_idx").over(w)).filter("order_idx <= before").select("session_id", "event_id", "order_idx")


@register("SELECT session_id, event_id FROM (SELECT *, lag(lower(event_type)) OVER w AS t, lag(text) OVER w AS x FROM session_events WHERE session_id IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY order_idx, event_id, text NULLS LAST, tool_name NULLS LAST)) WHERE lower(event_type) = 'tool' AND t = 'user' AND contains(x, 'flaky')")
def tools_after_user_text(spark, d):
    w = Window.partitionBy("session_id").orderBy("order_idx", "event_id", F.col("text").asc_nulls_last(), F.col("tool_name").asc_nulls_last())
    e = _events(spark, d).filter("session_id IS NOT NULL").withColumn("t", F.lag(F.lower("event_type")).over(w)).withColumn("x", F.lag("text").over(w))
    return e.filter((F.lower("event_type") == "tool") & (F.col("t") == "user") & F.col("x").contains("flaky")).select("session_id", "event_id")


@register("""
    SELECT session_id, event_id, last_assistant FROM (SELECT *, last_value(CASE WHEN lower(event_type) = 'assistant' THEN order_idx END IGNORE NULLS) OVER
        (PARTITION BY session_id ORDER BY timestamp NULLS LAST, event_id, order_idx ROWS UNBOUNDED PRECEDING) AS last_assistant FROM session_events WHERE session_id IS NOT NULL) WHERE lower(event_type) = 'tool'
""")
def assistant_as_of_tool(spark, d):
    w = Window.partitionBy("session_id").orderBy(F.col("timestamp").asc_nulls_last(), "event_id", "order_idx").rowsBetween(Window.unboundedPreceding, 0)
    e = _events(spark, d).filter("session_id IS NOT NULL").withColumn("last_assistant", F.last(F.when(F.lower("event_type") == "assistant", F.col("order_idx")), ignorenulls=True).over(w))
    return e.filter(F.lower("event_type") == "tool").select("session_id", "event_id", "last_assistant")


@register("""
    SELECT session_id, subagent_type, event_id, row_number() OVER (PARTITION BY session_id, subagent_type ORDER BY order_idx, event_id, text) AS n FROM session_events WHERE lower(event_type) = 'subagent' AND session_id IS NOT NULL
""")
def subagent_numbers(spark, d):
    w = Window.partitionBy("session_id", "subagent_type").orderBy("order_idx", "event_id", F.col("text").asc_nulls_last())
    return _events(spark, d).filter("lower(event_type) = 'subagent' AND session_id IS NOT NULL").select("session_id", "subagent_type", "event_id", F.row_number().over(w).alias("n"))


@register("""
    SELECT session_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, lower(regexp_replace(substring(text, 1, 500), '^\\s+|\\s+$', '', 'g')) ORDER BY order_idx, event_id, text) AS r
    FROM session_events WHERE session_id IS NOT NULL AND text IS NOT NULL) WHERE r = 1
""")
def first_message_occurrences(spark, d):
    w = Window.partitionBy("session_id", T.message_key(F.col("text"))).orderBy("order_idx", "event_id", "text")
    return _events(spark, d).filter("session_id IS NOT NULL AND text IS NOT NULL").withColumn("r", F.row_number().over(w)).filter("r = 1").select("session_id", "event_id")


@register("""
    WITH d AS (SELECT user_id AS k, start_time AS a, end_time AS b FROM spans WHERE user_id IS NOT NULL AND start_time <= end_time),
    r AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM r)
    SELECT k AS user_id, min(a) AS start_time, max(b) AS end_time FROM g GROUP BY k, g
""")
def busy_intervals(spark, d):
    return links.merge_intervals(_spans(spark, d).filter("user_id IS NOT NULL"), key="user_id", start="start_time", end="end_time")


@register("""
    WITH d AS (SELECT user_id AS k, start_time AS a, end_time AS b FROM spans WHERE user_id IS NOT NULL AND start_time <= end_time),
    r AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d)
    SELECT k AS user_id, reach AS gap_start, a AS gap_end FROM r WHERE a > reach
""")
def idle_intervals(spark, d):
    return links.interval_gaps(busy_intervals(spark, d), key="user_id", start="start_time", end="end_time")


@register()
def session_continuations(spark, d):
    return links.continuation_links(_spans(spark, d))


@register(f"""
    WITH c AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS chunk FROM documents),
    h AS (SELECT DISTINCT id, md5(lower(regexp_replace(chunk, '^\\s+|\\s+$', '', 'g'))) AS h FROM c WHERE length(regexp_replace(chunk, '^\\s+|\\s+$', '', 'g')) > 10),
    g AS (SELECT id, count(*) AS n, list_sort(list(h)) AS s FROM h GROUP BY 1), r AS (SELECT min(id) AS id, n FROM g GROUP BY s, n), x AS (SELECT h.id, h.h, r.n FROM h JOIN r USING (id))
    SELECT child, parent, overlap, CASE WHEN overlap >= 95 THEN 'complete' WHEN overlap >= 80 THEN 'review' ELSE 'keep_both' END AS relation FROM (
        SELECT a.id AS child, b.id AS parent, round(100.0 * count(*) / a.n, 2) AS overlap FROM x a JOIN x b ON a.h = b.h AND (a.n < b.n OR a.n = b.n AND a.id < b.id) GROUP BY a.id, b.id, a.n) WHERE overlap >= 50
""")
def contained_documents(spark, d):
    """Pairs of the representatives of classes; contained_document_classes has every document's class."""
    return links.containment(_document_lines(spark, d))


def _document_lines(spark, d):
    t = table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.explode(F.split("text", "\n")).alias("chunk"))
    return t.filter(F.length(T.strip(F.col("chunk"))) > 10)


@register("""
    WITH c AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS chunk FROM documents),
    h AS (SELECT DISTINCT id, lower(regexp_replace(chunk, '^\\s+|\\s+$', '', 'g')) AS h FROM c WHERE length(regexp_replace(chunk, '^\\s+|\\s+$', '', 'g')) > 10),
    g AS (SELECT id, count(*) AS n, list_sort(list(h)) AS s FROM h GROUP BY 1), m AS (SELECT id, n, min(id) OVER (PARTITION BY s) AS class_id FROM g),
    t AS (SELECT doc_id, CASE WHEN text IS NOT NULL THEN min(doc_id) OVER (PARTITION BY text) END AS text_id FROM documents)
    SELECT doc_id, class_id, text_id, coalesce(n, 0) AS chunks, CASE WHEN doc_id = class_id THEN 'representative' WHEN class_id IS NULL THEN NULL WHEN doc_id = text_id THEN 'complete' ELSE 'copy' END AS relation
    FROM t LEFT JOIN m ON m.id = t.doc_id
""")
def contained_document_classes(spark, d):
    """One row per document: its class, whose representative stands for it in contained_documents, and whether its text is a copy or differs."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return links.containment_classes(texts, _document_lines(spark, d)).withColumnRenamed("id", "doc_id")


@register("""
    WITH RECURSIVE r AS (SELECT session_id AS key, id AS ord, length(coalesce(input_value, '')) // 4 + length(coalesce(output_value, '')) // 4 + 50 AS size, row_number() OVER (PARTITION BY session_id ORDER BY id) AS i FROM spans WHERE session_id IS NOT NULL),
    b AS (SELECT key, ord, size, i, 0 AS batch_no, 1 AS held, size AS total FROM r WHERE i = 1
          UNION ALL SELECT r.key, r.ord, r.size, r.i, CASE WHEN held >= 100 OR total + r.size > 8000 THEN batch_no + 1 ELSE batch_no END, CASE WHEN held >= 100 OR total + r.size > 8000 THEN 1 ELSE held + 1 END,
                           CASE WHEN held >= 100 OR total + r.size > 8000 THEN r.size ELSE total + r.size END FROM b JOIN r ON r.key = b.key AND r.i = b.i + 1)
    SELECT key, ord, size, batch_no FROM b
""")
def packed_batches(spark, d):
    s = _spans(spark, d).filter("session_id IS NOT NULL").withColumn("size", T.token_estimate(F.col("input_value")) + T.token_estimate(F.col("output_value")) + 50)
    return links.batches(s, key="session_id", order="id", size="size")


@register("""
    WITH RECURSIVE r AS (SELECT session_id AS key, id AS ord, llm_token_count_prompt AS n, row_number() OVER (PARTITION BY session_id ORDER BY id) AS i FROM spans WHERE session_id IS NOT NULL AND llm_token_count_prompt IS NOT NULL),
    b AS (SELECT key, ord, n, i, n AS last, true AS kept FROM r WHERE i = 1
          UNION ALL SELECT r.key, r.ord, r.n, r.i, CASE WHEN r.n > last OR r.n < last / 2.0 AND r.n >= 1000 THEN r.n ELSE last END, r.n > last OR r.n < last / 2.0 AND r.n >= 1000 FROM b JOIN r ON r.key = b.key AND r.i = b.i + 1)
    SELECT key, ord, n FROM b WHERE kept
""")
def growing_contexts(spark, d):
    return links.growing(_spans(spark, d).filter("session_id IS NOT NULL"), key="session_id", order="id", count="llm_token_count_prompt", floor=1000)


# Transcripts


@register(f"WITH {S.LINES} SELECT c.session_id, c.tool_id, c.name, c.ts AS call_ts, r.ts AS result_ts, r.result FROM calls c LEFT JOIN results r USING (session_id, tool_id)")
def tool_calls_with_results(spark, d):
    return transcript.paired_tools(_lines(spark, d)).drop("input")


@register(f"""
    WITH {S.LINES}, m AS (SELECT session_id, uuid, ts, list_filter(CASE WHEN json_valid(c) THEN CASE WHEN json_type(CAST(c AS JSON)) = 'ARRAY' THEN json_extract(c, '$[*]') END END, lambda b: b ->> '$.type' = 'tool_use') AS b FROM l WHERE type = 'assistant')
    SELECT session_id, uuid, ts, len(b)::INTEGER AS calls, array_to_string(list_transform(b, lambda x: x ->> '$.name'), ',') AS tools, (SELECT count(*) FROM unnest(b) AS u(x) WHERE (m.session_id, x ->> '$.id') IN (SELECT session_id, tool_id FROM results)) AS answered FROM m WHERE len(b) > 1
""")
def parallel_calls(spark, d):
    return transcript.parallel_calls(_lines(spark, d))


@register()
def tool_calls_in_turn(spark, d):
    return transcript.paired_in_turn(_lines(spark, d, "claude_session_with_metadata"))


@register(f"WITH {S.EVENTS} SELECT * FROM e")
def transcript_events(spark, d):
    return transcript.events(_lines(spark, d))


@register(f"""
    WITH {S.EVENTS}, w AS (SELECT *, regexp_replace(regexp_replace(coalesce(text, ''), '(?s)<system-reminder>.*?</system-reminder>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS whole, event_type IN ('tool', 'subagent') AS tool FROM e)
    SELECT session_id, order_idx, CASE WHEN tool_name IS NOT NULL THEN '### ' || upper(event_type[1]) || event_type[2:] || ': `' || tool_name || '`' ELSE '## ' || upper(event_type[1]) || event_type[2:] END || chr(10) || chr(10)
        || CASE WHEN tool_name IS NOT NULL THEN '```' || chr(10) ELSE '' END || CASE WHEN tool AND length(whole) > 2000 THEN whole[1:1997] || '...' ELSE whole END || CASE WHEN tool_name IS NOT NULL THEN chr(10) || '```' ELSE '' END || chr(10) AS block,
        CASE WHEN tool AND length(whole) > 2000 THEN text END AS full_result FROM w
""")
def transcript_markdown(spark, d):
    return transcript.markdown(transcript.events(_lines(spark, d)))


@register(f"""
    WITH {S.LINES}, t AS (SELECT session_id, string_agg(DISTINCT ticket, ',' ORDER BY ticket) AS tickets FROM (SELECT session_id, unnest(regexp_extract_all(text, '\\b([A-Z][A-Z0-9]+-\\d+)\\b', 1)) AS ticket FROM lt) GROUP BY 1)
    SELECT lt.session_id, count(*) AS lines, count(*) FILTER (type = 'user') AS user_lines, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(cwd, (ts IS NULL, ts, uuid)) FILTER (cwd IS NOT NULL) AS cwd, arg_min(branch, (ts IS NULL, ts, uuid)) FILTER (branch IS NOT NULL) AS branch,
           arg_min(text, (ts IS NULL, ts, uuid)) FILTER (type = 'user' AND {S.human('text')}) AS first_prompt, coalesce(any_value(t.tickets), '') AS tickets FROM lt LEFT JOIN t USING (session_id) GROUP BY 1
""")
def transcript_summaries(spark, d):
    return transcript.summary(_lines(spark, d))


@register(f"""
    WITH {S.LINES}, n AS (SELECT session_id, name, count(*) AS k FROM calls GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY k DESC, name) AS r FROM n)
    SELECT session_id, string_agg(name || '=' || k, ',' ORDER BY r) AS tools FROM r WHERE r <= 8 GROUP BY 1
""")
def transcript_top_tools(spark, d):
    return transcript.top_tools(_lines(spark, d))


@register(f"SELECT uuid, {S.TIME} AS ts FROM claude_session_minimal")
def parsed_times(spark, d):
    return table(spark, d, "claude_session_minimal").select("uuid", parse_time(F.col("timestamp")).alias("ts"))


@register("SELECT id, (epoch_us(end_time) - epoch_us(start_time)) / 1000.0 AS ms FROM spans")
def span_durations(spark, d):
    return _spans(spark, d).select("id", duration_ms(F.col("start_time"), F.col("end_time")).alias("ms"))


@register("""
    SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS collapsed, CASE WHEN length(text) > 50 THEN text[1:47] || '...' ELSE text END AS short,
           CAST(length(coalesce(text, '')) // 4 AS BIGINT) AS tokens, regexp_replace(repo, '[^A-Za-z0-9._-]', '_', 'g')[1:120] AS safe, md5(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS hash FROM documents
""")
def text_functions(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.collapse(F.coalesce(t, F.lit(""))).alias("collapsed"), T.truncate(t, 50).alias("short"), T.token_estimate(t).alias("tokens"), T.safe_name(F.col("repo")).alias("safe"), T.content_hash(t).alias("hash"))


# Embeddings

CLUSTER_LEAST = 5


@register()
def embedding_clusters(spark, d):
    """(cluster, vectors, labels, outliers, silhouette): k-means over the embeddings, as sessions are clustered; a cluster of fewer than five vectors counts as outliers."""
    v = table(spark, d, "embeddings").select("vec_id", "label", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    n = v.count()
    if n < 2:
        return spark.createDataFrame([], "cluster int, vectors long, labels long, outliers boolean, silhouette double")
    out = KMeans(k=min(n, max(2, min(5, 10, n // CLUSTER_LEAST))), seed=42, maxIter=20).fit(v).transform(v)
    shape = ClusteringEvaluator(featuresCol="features").evaluate(out) if out.select("prediction").distinct().count() > 1 else None
    g = out.groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("vectors"), F.count_distinct("label").alias("labels"))
    return g.withColumns({"outliers": F.col("vectors") < CLUSTER_LEAST, "silhouette": F.lit(shape).cast("double")})
