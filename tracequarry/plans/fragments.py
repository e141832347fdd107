"""Pieces of SQL that several queries' SQL shares. They restate the rules and their fixed values on their own, so that a wrong value on one side shows."""

from __future__ import annotations


# Fixed values, as the functions should have them.
_ABORT = ("abort", "cancel", "interrupt", "sigint", "sigterm")
_COMPACTION_CONTINUED = "This session is being continued from a previous conversation"
_COMPACTION_SPANS = ("Claude_Code_Internal_Prompt", "litellm_request", "raw_gen_ai_request")
_COMPACTION_TASK = "Your task is to create a detailed summary"
_CONTINUATIONS = ("Let me check", "Let me examine", "Let me search", "Let me look", "Now let me", "Perfect! Now let me", "Perfect! Let me", "Excellent! Let me", "Great! Let me", "Great! I found")
_CONTINUED_WORDS = ("continued from", "previous conversation", "summarized below")
_FAILED = ("ERROR", "FAILED", "FAILURE")
_HAIKU_MODELS = "(?i)claude-.*haiku|claude-3-haiku|claude-haiku"
_INTERNAL_NAMES = "(?i)Claude_Code_Internal_.*|Claude_Code_Final_Output.*|raw_gen_ai_request|litellm_request"
_MAIN_MODELS = "(?i)claude-.*sonnet|claude-.*opus|claude-4|claude-sonnet|claude-opus"
_PROXY_NAMES = ("proxy_pre_call", "router", "Received Proxy Server Request")
_QUOTA = "(?i)quota|rate_limit|throttle"
_RATE_LIMIT = ("rate limit", "ratelimit", "429", "quota", "throttle")
_SUCCESS = ("OK", "SUCCESS", "")
_SUMMARY_HEADERS = ("## summary", "## context", "## background", "## previous conversation", "## conversation summary", "## session summary", "# summary", "# context")
_SUMMARY_WORDS = ("summary", "summarized", "summarize", "previous conversation", "continued from", "context window", "earlier discussion", "prior session")
_TASK_WORDS = ("create a", "generate a", "write a", "your task is")
_TIMEOUT = ("timeout", "timed out", "deadline exceeded")
_TOOL_NAMES = "(?i)Claude_Code_Tool_.*|tool_.*|.*_tool$"
_PARTS = {'user': (('device_id',), 'user_([a-zA-Z0-9]+)_account'), 'account': (('account_uuid', 'account_id'), 'account_([a-f0-9-]{36})'), 'session': (('session_id',), 'session_([a-zA-Z0-9_-]+)')}
_AGENT_PREFIXES = ("perform a web search for the query", "describe your most recent action", "the user stepped away", "the user has been idle", "[suggestion mode", "the date has changed", "caveat: the messages below were generated")
_LIVE_PREFIXES = ("<system", "Files modified by", "Caveat: The messages below", "Base directory for this skill")
_MACHINE_MARKERS = ("tool_use_id", "<system-reminder>", "<task-notification>", "<command-name>", "<local-command-stdout>", "[request interrupted by user]")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(column: str, words, how: str = "contains") -> str:
    return "(" + " OR ".join(f"{how}({column}, {_q(w)})" for w in words) + ")"


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def human(c: str) -> str:
    t = "lower(" + _STRIP.format(f"regexp_replace({c}, '\\s+', ' ', 'g')") + ")"
    return f"{c} IS NOT NULL AND length({t}) >= 12 AND NOT {_any(t, _MACHINE_MARKERS)} AND NOT {_any(t, _AGENT_PREFIXES, 'starts_with')}"


def live(c: str) -> str:
    t = _STRIP.format(c)
    return f"{c} IS NOT NULL AND length({t}) > 10 AND NOT (starts_with({t}, 'Command:') AND contains({t}, chr(10) || 'Output:')) AND NOT (starts_with({t}, '{{') AND ends_with({t}, '}}')) AND NOT {_any(t, _LIVE_PREFIXES, 'starts_with')}"


_N, _K, _M, _S = (f"coalesce({c}, '')" for c in ("name", "span_kind", "llm_model_name", "status_code"))
CATEGORY = f"""
    SELECT *, CASE WHEN r <= 2 THEN 'tools' WHEN r = 3 THEN 'haiku_holdover' WHEN r IN (4, 6) THEN 'main' WHEN r IN (5, 7) THEN 'internal' WHEN r = 8 THEN 'quota' ELSE 'unknown' END AS category,
           CAST(CASE r WHEN 1 THEN 1.0 WHEN 2 THEN 0.95 WHEN 3 THEN 1.0 WHEN 4 THEN 1.0 WHEN 5 THEN 0.8 WHEN 6 THEN 0.7 WHEN 7 THEN 0.9 WHEN 8 THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence
    FROM (SELECT *, CASE WHEN upper({_K}) = 'TOOL' THEN 1 WHEN regexp_matches({_N}, {_q(_TOOL_NAMES)}) THEN 2 WHEN regexp_matches({_M}, {_q(_HAIKU_MODELS)}) THEN 3 WHEN regexp_matches({_M}, {_q(_MAIN_MODELS)}) THEN 4
                 WHEN upper({_K}) = 'LLM' AND regexp_matches({_N}, {_q(_INTERNAL_NAMES)}) THEN 5 WHEN upper({_K}) = 'LLM' THEN 6 WHEN regexp_matches({_N}, {_q(_INTERNAL_NAMES)}) THEN 7
                 WHEN regexp_matches({_N}, {_q(_QUOTA)}) OR regexp_matches({_S}, {_q(_QUOTA)}) THEN 8 ELSE 9 END AS r FROM spans)
"""

_IN, _OUT = "coalesce(input_value, '')", "coalesce(output_value, '')"
_TXT = f"CASE WHEN starts_with({_IN}, '[{{') THEN coalesce(CASE WHEN json_valid({_IN}) THEN json_extract_string({_IN}, '$[0].text') END, {_IN}) ELSE {_IN} END"
THREAD = f"""
    SELECT *, CASE WHEN {_N} = 'Claude_Code_Tool_Task' THEN 'sub_agent'
        WHEN {_any(_N, ('Claude_Code_Internal_', 'Claude_Code_Final_', 'Claude_Code_Tool_'), 'starts_with')} OR {_N} IN {('litellm_request', 'raw_gen_ai_request', *_PROXY_NAMES)} THEN 'main_thread'
        WHEN {_STRIP.format('t')} = 'quota' OR starts_with(t, 'Command:') OR contains(t, '<policy_spec>') OR starts_with(t, 'Files modified by user:') OR contains(lower(t), 'write a 5-10 word title')
          OR contains(lower(t), 'title for the following conversation') OR contains(t, 'Web page content:') OR (contains({_IN}, '"tool_result"') AND contains({_IN}, '"tool_use_id"')) OR contains({_IN}, '<system-reminder>')
          OR (contains({_IN}, '"Warmup"') AND contains({_IN}, '"cache_control"')) OR contains({_OUT}, '<is_displaying_contents>') OR contains({_OUT}, '"isNewTopic"') OR contains({_OUT}, '"is_displaying_contents"')
          OR {_STRIP.format(_OUT)} IN ('#', '{{') OR contains({_OUT}, 'command_injection_detected') OR starts_with({_OUT}, 'Hello! I''m Claude Code') OR starts_with({_OUT}, 'I''m ready to help! I''m Claude Code')
          OR ({_STRIP.format(_IN)} = '' AND {_any(_OUT, _CONTINUATIONS, 'starts_with')}) THEN 'ancillary' ELSE 'unknown' END AS thread_type
    FROM (SELECT *, {_TXT} AS t FROM spans)
"""

_LOW = "lower(coalesce(text, ''))"
_WORDS = " + ".join(f"CAST(contains({_LOW}, {_q(w)}) AS INTEGER)" for w in _SUMMARY_WORDS)
COMPACTION = f"""
    SELECT doc_id, score, CASE WHEN contains(text, {_q(_COMPACTION_TASK)}) THEN 'compaction_task' WHEN contains(text, {_q(_COMPACTION_CONTINUED)}) THEN 'post_compaction'
                        WHEN score >= 55 AND {_any(_LOW, _CONTINUED_WORDS)} THEN 'post_compaction_structural' WHEN score >= 55 AND {_any(_LOW, _TASK_WORDS)} THEN 'compaction_task_structural'
                        WHEN score >= 55 THEN 'compaction_structural' END AS kind,
           CAST(CASE WHEN contains(text, {_q(_COMPACTION_TASK)}) OR contains(text, {_q(_COMPACTION_CONTINUED)}) THEN 0.99 ELSE least(score / 100.0, 0.85) END AS DOUBLE) AS confidence
    FROM (SELECT doc_id, text, CASE WHEN {_any(_LOW, _SUMMARY_HEADERS)} THEN 35 ELSE 0 END + CASE WHEN {_WORDS} >= 2 THEN 25 WHEN {_WORDS} = 1 THEN 10 ELSE 0 END
                 + CASE WHEN length(text) >= 5000 THEN 20 WHEN length(text) >= 2500 THEN 10 ELSE 0 END + 10 AS score FROM documents)
"""
# the same over spans, whose name counts
SPAN_COMPACTION = COMPACTION.replace(" + 10 AS score FROM documents", f" + CASE WHEN {_any(_N, _COMPACTION_SPANS)} THEN 10 ELSE 0 END AS score FROM (SELECT id AS doc_id, coalesce(input_value, '') AS text, name FROM spans)")

_MS = "(epoch_us(end_time) - epoch_us(start_time)) / 1000.0"
TOOL_STATS = f"""
    SELECT tool, count(*) AS calls, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures, count(ms) AS timed_calls, round(coalesce(sum(ms), 0.0), 3) AS total_ms, round(avg(ms), 3) AS avg_ms,
           round(count(*) FILTER (ok) / count(*), 4) AS success_rate
    FROM (SELECT coalesce(nullif(regexp_replace({_N}, '^(Claude_Code_Tool_|tool_)', ''), ''), 'unknown') AS tool, upper({_S}) IN {_SUCCESS} AS ok, {_MS} AS ms FROM ({CATEGORY}) WHERE category = 'tools') GROUP BY 1
"""

_SAID = f"lower({_N} || ' ')"
FAILURES = f"""
    SELECT id, session_id, unnest(list_filter([f, CASE WHEN b2b THEN 'back_to_back' END], lambda x: x IS NOT NULL)) AS failure, context FROM (
        SELECT id, session_id, CASE WHEN upper({_S}) IN {_FAILED} THEN 'error' WHEN {_any(_SAID, _TIMEOUT)} THEN 'timeout' WHEN {_any(_SAID, _RATE_LIMIT)} THEN 'rate_limit' WHEN {_any(_SAID, _ABORT)} THEN 'user_abort' END AS f,
               lag(id) OVER w IS NOT NULL AND name IS NOT DISTINCT FROM lag(name) OVER w AND (coalesce(input_value <> '' AND input_value = lag(input_value) OVER w, false)
                   OR coalesce(category = lag(category) OVER w AND raw_attributes <> '' AND raw_attributes = lag(raw_attributes) OVER w, false)) AS b2b,
               coalesce(array_to_string(list(id) OVER (PARTITION BY session_id ORDER BY id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ','), '') AS context
        FROM ({CATEGORY}) WINDOW w AS (PARTITION BY session_id ORDER BY id))
"""

OPERATION = f"CASE WHEN {_any(f'lower({_N})', ('edit', 'modify', 'update'))} THEN 'edit' WHEN {_any(f'lower({_N})', ('write', 'create'))} THEN 'write' END"
_RAW = "CASE WHEN json_valid(raw_attributes) THEN raw_attributes END"
_INNER = f"json_extract_string({_RAW}, '$.attributes.input.value')"
FILE_PATH = f"""coalesce(nullif(coalesce(json_extract_string({_RAW}, '$.file_path'), json_extract_string({_RAW}, '$.attributes.tool.parameters.file_path'),
    json_extract_string(CASE WHEN json_valid({_INNER}) THEN {_INNER} END, '$.input.file_path')), ''), nullif(regexp_extract(input_value, '((?:/[\\w.-]+)+(?:\\.\\w+)?)', 1), ''))"""

_MSGS = "CASE WHEN json_valid(input_messages) THEN CASE WHEN json_type(CAST(input_messages AS JSON)) = 'ARRAY' THEN json_extract(input_messages, '$[*]') END END"
_ROLE = "lower(coalesce(nullif(m ->> '$.\"message.role\"', ''), m ->> '$.role', ''))"
_SIZE = "length(coalesce(nullif(m ->> '$.\"message.content\"', ''), m ->> '$.content', ''))"
TOKENS = f"""
    SELECT id, session_id, category, CAST(sys AS BIGINT) AS system_tokens, CAST(tool AS BIGINT) AS tool_tokens, CAST(CASE WHEN category = 'tools' THEN 0 ELSE o END AS BIGINT) AS model_tokens,
           CAST(CASE WHEN category IN ('tools', 'internal') THEN 0 ELSE p - sys - tool END AS BIGINT) AS user_tokens, p AS raw_input_tokens, o AS raw_output_tokens, CASE WHEN llm_token_count_total > 0 THEN llm_token_count_total ELSE p + o END AS raw_total_tokens
    FROM (SELECT *, CASE WHEN category IN ('main', 'haiku_holdover') AND len(b) > 0 THEN CASE WHEN chars > 0 AND p > 0 THEN p * sc // chars ELSE 0 END
                         WHEN category IN ('main', 'haiku_holdover') AND contains(lower({_IN}[1:500]), 'system') THEN p WHEN category = 'internal' THEN p ELSE 0 END AS sys,
                    CASE WHEN category = 'tools' THEN p + o WHEN category IN ('main', 'haiku_holdover') AND len(b) > 0 AND chars > 0 AND p > 0 THEN p * tc // chars ELSE 0 END AS tool
          FROM (SELECT *, coalesce(list_sum(list_transform(b, lambda m: {_SIZE})), 0)::BIGINT AS chars, coalesce(list_sum(list_transform(b, lambda m: CASE WHEN {_ROLE} = 'system' THEN {_SIZE} ELSE 0 END)), 0)::BIGINT AS sc,
                       coalesce(list_sum(list_transform(b, lambda m: CASE WHEN {_ROLE} IN ('tool', 'function') THEN {_SIZE} ELSE 0 END)), 0)::BIGINT AS tc
                FROM (SELECT *, coalesce(llm_token_count_prompt, 0) AS p, coalesce(llm_token_count_completion, 0) AS o, {_MSGS} AS b FROM ({CATEGORY}))))
"""

META = f"""
    SELECT id, trace_id, input_value, [json_extract_string(j, '$.attributes.metadata'), json_extract_string(j, '$."attributes.metadata"'),
        CASE WHEN json_type(j, '$.attributes.llm') = 'OBJECT' THEN list_filter(list_transform(json_keys(j, '$.attributes.llm'), lambda k: json_extract_string(j, '$.attributes.llm."' || k || '".metadata')), lambda x: x IS NOT NULL)[1] END,
        json_extract_string(j, '$.metadata')] AS metas FROM (SELECT *, {_RAW} AS j FROM spans)
"""


def identity(part: str) -> str:
    keys, pattern = _PARTS[part]

    def one(v: str) -> str:
        obj = f"json_valid({v}) AND json_type(CASE WHEN json_valid({v}) THEN {v} END) = 'OBJECT'"
        return f"CASE WHEN {obj} THEN coalesce({', '.join(f'nullif(json_extract_string({v}, {_q(chr(36) + chr(46) + k)}), {_q("")})' for k in keys)}) ELSE nullif(regexp_extract({v}, {_q(pattern)}, 1), '') END"

    values = []
    for i in range(1, 5):
        m = f"metas[{i}]"
        safe = f"CASE WHEN json_valid({m}) THEN {m} END"
        values += [f"json_extract_string({safe}, '$.user_api_key_end_user_id')", f"json_extract_string({safe}, '$.requester_metadata.user_id')", m]
    return "coalesce(" + ", ".join(one(v) for v in values) + ")"


LLM_NAMES = ("litellm_request", "raw_gen_ai_request")

_TS = r"""regexp_replace("timestamp", '^\s+|\s+$', '', 'g')"""
TIME = rf"""CASE WHEN regexp_full_match({_TS}, '\d{{4}}-\d{{2}}-\d{{2}}([T ]\d{{2}}:\d{{2}}(:\d{{2}}.*)?)?') THEN TRY_CAST({_TS} AS TIMESTAMPTZ)
    WHEN regexp_full_match({_TS}, '\d{{11,14}}') THEN make_timestamptz(CAST({_TS} AS BIGINT) * 1000) END"""

_FLAT = "CASE WHEN json_valid({0}) THEN CASE WHEN json_type(CAST({0} AS JSON)) = 'ARRAY' THEN array_to_string(list_filter(list_transform(json_extract({0}, '$[*]'), lambda x: CASE WHEN x ->> '$.type' = 'text' THEN x ->> '$.text' END), lambda x: x IS NOT NULL), chr(10)) ELSE {0} END ELSE {0} END"
LINES = f"""
    raw AS (SELECT sessionId AS session_id, uuid, type, subtype, {TIME} AS ts, message.content AS c, cwd, gitBranch AS branch FROM claude_session_with_subagent WHERE sessionId IS NOT NULL),
    l AS (SELECT session_id, uuid, min(ts) AS ts, min(type) AS type, min(subtype) AS subtype, min(c) AS c, min(cwd) AS cwd, min(branch) AS branch FROM raw GROUP BY 1, 2),
    lt AS (SELECT *, {_FLAT.format('c')} AS text FROM l),
    bl AS (SELECT session_id, uuid, type, ts, unnest(CASE WHEN json_valid(c) THEN CASE WHEN json_type(CAST(c AS JSON)) = 'ARRAY' THEN json_extract(c, '$[*]') END END) AS b FROM l),
    calls AS (SELECT session_id, b ->> '$.id' AS tool_id, arg_min(b ->> '$.name', (ts, uuid)) AS name, arg_min(b ->> '$.input', (ts, uuid)) AS input, min(ts) AS ts FROM bl WHERE type = 'assistant' AND b ->> '$.type' = 'tool_use' GROUP BY 1, 2),
    rs AS (SELECT session_id, b ->> '$.tool_use_id' AS tool_id, uuid, ts, b ->> '$.content' AS content FROM bl WHERE type = 'user' AND b ->> '$.type' = 'tool_result'),
    results AS (SELECT session_id, tool_id, arg_min(uuid, (ts, uuid)) AS uuid, arg_min(ts, (ts, uuid)) AS ts, arg_min({_FLAT.format('content')}, (ts, uuid)) AS result FROM rs GROUP BY 1, 2)
"""

EVENTS = f"""
    {LINES},
    n AS (SELECT *, coalesce(type = 'system' AND subtype = 'compact_boundary', false) AS b FROM lt), o AS (SELECT *, lead(type) OVER o AS next_type, lead(text) OVER o AS next_text, coalesce(lag(b) OVER o AND type = 'user', false) AS eaten FROM n WINDOW o AS (PARTITION BY session_id ORDER BY ts NULLS LAST, uuid)),
    u AS (SELECT session_id, uuid, ts, type AS event_type, text, NULL AS tool_name, '' AS part FROM o WHERE type IN ('user', 'assistant') AND NOT eaten AND regexp_matches(text, '\\S')
          UNION ALL SELECT session_id, uuid, ts, 'compaction', CASE WHEN next_type = 'user' THEN next_text END, NULL, '' FROM o WHERE b
          UNION ALL SELECT r.session_id, r.uuid, r.ts, CASE WHEN c.name = 'Task' THEN 'subagent' ELSE 'tool' END, r.result, c.name, r.tool_id FROM results r JOIN calls c USING (session_id, tool_id)),
    e AS (SELECT session_id, sha256(concat_ws('|', session_id, uuid, event_type, part)) AS event_id,
                 CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts NULLS LAST, CASE event_type WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 WHEN 'tool' THEN 2 WHEN 'subagent' THEN 3 ELSE 4 END, uuid, part) - 1 AS INTEGER) AS order_idx, ts, event_type, text, tool_name FROM u)
"""
