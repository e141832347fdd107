"""Queries of conversations, their documents, batches, coverage and checks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequarry.functions import classify as C
from tracequarry.functions import text as T
from tracequarry.operators import dialogue, links, metrics, query, render, reports, transcript
from tracequarry.plans import fragments as S
from tracequarry.plans.reference import registry
from tracequarry.session import table, written


QUERIES, SQL, register = registry()


def _spans(spark, d):
    return table(spark, d, "spans")


_J = "CASE WHEN json_valid(raw_attributes) THEN raw_attributes END"
_GIVEN = f"coalesce(nullif(input_value, ''), json_extract_string({_J}, '$.attributes.input.value'), '')"
_OUT = f"coalesce(nullif(output_value, ''), json_extract_string({_J}, '$.attributes.output.value'), '')"
_MODEL = f"coalesce(nullif(llm_model_name, ''), json_extract_string({_J}, '$.attributes.llm.model_name'), '')"
_BARE = "regexp_replace(o, '^\\s+|\\s+$', '', 'g')"
_FLAGS = f"""
    SELECT id, session_id, start_time, (starts_with(n, 'Claude_Code_Internal_Prompt_') OR starts_with(n, 'Claude_Code_Final_Output_') OR starts_with(n, 'litellm_request') OR starts_with(n, 'raw_gen_ai_request'))
               AND NOT contains(g, '<policy_spec>') AND NOT contains(g, 'Claude Code Code Bash command prefix detection')
               AND NOT contains(o, '"isNewTopic"') AND NOT contains(o, '"is_displaying_contents"') AND NOT contains(o, '<is_displaying_contents>') AND {_BARE} NOT IN ('#', '{{', '[{{"type": "text", "text": "{{"}}]')
               AND NOT (contains(lower(m), 'haiku') AND length({_BARE}) < 50 AND NOT starts_with(o, '[')) AS main_thread,
           regexp_matches(sys, 'file search specialist|READ-ONLY exploration task|READ-ONLY MODE - NO FILE MODIFICATIONS|You excel at thoroughly navigating and exploring codebases|general-purpose agent|research complex questions') AS subagent,
           NOT contains(g, 'This session is being continued from a previous conversation') AND CASE WHEN json_valid(g) AND starts_with(ltrim(g), '[')
               THEN len(list_filter(json_extract(CASE WHEN json_valid(g) THEN g END, '$[*]'), lambda b: b ->> '$.type' = 'text' AND length(trim(b ->> '$.text')) > 10)) > 0
               ELSE length(regexp_replace(g, '^\\s+|\\s+$', '', 'g')) > 10 END AS meaningful, o <> '' AND {_BARE} <> '' AS answered
    FROM (SELECT id, session_id, start_time, coalesce(name, '') AS n, {_GIVEN} AS g, {_OUT} AS o, {_MODEL} AS m, coalesce(json_extract_string({_J}, '$.attributes.llm.None.system'), '') AS sys FROM spans)
"""


def _flagged(spark, d):
    return _spans(spark, d).select("id", "session_id", "start_time", C.is_main_thread().alias("main_thread"), C.is_subagent_request().alias("subagent"), C.is_meaningful_input(C.input_text()).alias("meaningful"), C.output_text().rlike(r"\S").alias("answered"))


@register(f"SELECT id, main_thread, subagent, meaningful FROM ({_FLAGS})")
def span_flags(spark, d):
    return _flagged(spark, d).select("id", "main_thread", "subagent", "meaningful")


@register(f"""
    SELECT session_id FROM (SELECT session_id, arg_min(start_time, (start_time, id)) FILTER (main_thread AND answered AND start_time IS NOT NULL) AS o, arg_min(start_time, (start_time, id)) FILTER (main_thread AND meaningful AND start_time IS NOT NULL) AS i,
        bool_or(main_thread AND answered) AS answers, bool_or(main_thread AND meaningful) AS asks FROM ({_FLAGS}) WHERE session_id IS NOT NULL GROUP BY 1) WHERE answers AND (NOT asks OR o < i)
""")
def mid_stream_sessions(spark, d):
    """Sessions that begin with an answer: no question, or none before the first answer, among the spans of the conversation itself."""
    f = _flagged(spark, d).filter("session_id IS NOT NULL AND main_thread")
    first = lambda c: F.min(F.when(F.col(c), F.col("start_time")))
    g = f.groupBy("session_id").agg(first("answered").alias("o"), first("meaningful").alias("i"), F.bool_or("answered").alias("answers"), F.bool_or("meaningful").alias("asks"))
    return g.filter("answers AND (NOT asks OR o < i)").select("session_id")


@register("""
    SELECT id, CASE WHEN k = 'TOOL' THEN 'tools' WHEN contains(g, 'tool_result') OR contains(g, 'tool_use') OR contains(o, 'tool_use') THEN 'tools'
        WHEN contains(lower(g), 'quota') AND length(g) < 50 OR contains(lower(im), 'quota') AND contains(lower(o), 'quota') AND length(o) < 10 THEN 'quota' WHEN contains(lower(m), 'haiku') THEN 'haiku_holdover'
        WHEN contains(lower(g || o || im || om), 'test') AND contains(lower(g || o || im || om), 'litellm') THEN 'litellm_system_overhead'
        WHEN contains(lower(g || o || im || om), 'new topic') OR contains(lower(g || o || im || om), 'is_new_topic') THEN 'is_new_topic'
        WHEN k = 'LLM' AND contains(n, 'litellm') AND g <> '' AND regexp_replace(o, '\\s', '', 'g') = '' THEN 'incomplete' WHEN contains(g, 'policy_spec') AND contains(g, 'Claude Code Code Bash') THEN 'safety'
        WHEN contains(g, 'Please write a 5-10 word title') THEN 'summarization' ELSE 'main' END AS category
    FROM (SELECT id, coalesce(name, '') AS n, coalesce(span_kind, '') AS k, coalesce(llm_model_name, '') AS m, coalesce(input_value, '') AS g, coalesce(output_value, '') AS o, coalesce(input_messages, '') AS im, coalesce(output_messages, '') AS om FROM spans)
""")
def legacy_categories(spark, d):
    return _spans(spark, d).select("id", C.legacy_category().alias("category"))


@register(f"""
    SELECT id, thread_type, CASE WHEN thread_type = 'unknown' THEN 0.5 WHEN coalesce(name, '') IN ('proxy_pre_call', 'router', 'Received Proxy Server Request') THEN 0.9 WHEN going_on THEN 0.95 ELSE 1.0 END::DOUBLE AS confidence, c.kind IS NOT NULL AS is_compaction, c.kind AS compaction
    FROM (SELECT *, thread_type = 'ancillary' AND trim(coalesce(input_value, '')) = '' AND NOT regexp_matches(coalesce(output_value, ''), '<is_displaying_contents>|"is_displaying_contents"|"isNewTopic"|command_injection_detected|^#$|^\\{{$') AND NOT contains(coalesce(output_value, ''), 'I''m Claude Code') AS going_on FROM ({S.THREAD})) t
    LEFT JOIN ({S.SPAN_COMPACTION}) c ON c.doc_id = t.id
""")
def thread_annotations(spark, d):
    t, c = C.thread(), C.compaction(F.col("input_value"), F.col("name"))
    return _spans(spark, d).select("id", t.alias("t"), c.alias("c")).select("id", F.col("t.type").alias("thread_type"), F.col("t.confidence").alias("confidence"), F.col("c").isNotNull().alias("is_compaction"), F.col("c.kind").alias("compaction"))


@register(f"""
    WITH a AS (SELECT id, coalesce(nullif(json_extract({_J}, '$."llm.input_messages"')::VARCHAR, '[]'), json_extract({_J}, '$.attributes.llm.input_messages')::VARCHAR) AS a FROM spans),
    i AS (SELECT id, unnest(CASE WHEN json_type(a::JSON) = 'ARRAY' THEN json_extract(a::JSON, '$[*]') END) AS i FROM a WHERE a IS NOT NULL),
    m AS (SELECT id, CASE WHEN json_type(i, '$.message') IN ('OBJECT', 'VARCHAR', 'ARRAY') THEN json_extract(i, '$.message') ELSE i END AS m FROM i)
    SELECT id, count(*) AS messages, count(*) FILTER (m ->> '$.role' = 'user') AS users, count(*) FILTER (m ->> '$.role' = 'assistant') AS assistants, sum(length(coalesce(m ->> '$.content', '')))::BIGINT AS chars FROM m WHERE m ->> '$.role' IS NOT NULL GROUP BY 1
""")
def input_messages(spark, d):
    """Messages that requests carry in their attributes, by request."""
    m = _spans(spark, d).select("id", F.explode(dialogue.messages("input_messages")).alias("m"))
    return m.groupBy("id").agg(F.count("*").alias("messages"), F.count_if(F.col("m.role") == "user").alias("users"), F.count_if(F.col("m.role") == "assistant").alias("assistants"), F.sum(F.length("m.content")).alias("chars"))


@register(f"""
    WITH t AS (SELECT id, name, {_J} AS j FROM spans WHERE starts_with(name, 'Claude_Code_Tool_')),
    v AS (SELECT *, CASE WHEN json_valid(json_extract_string(j, '$.attributes.input.value')) THEN json_extract_string(j, '$.attributes.input.value') END AS v FROM t WHERE j IS NOT NULL),
    c AS (SELECT *, coalesce(v ->> '$.type' = 'tool_use', false) AS is_call FROM v)
    SELECT id, name[18:] AS tool, CASE WHEN is_call THEN coalesce(v ->> '$.id', '') ELSE '' END AS tool_use_id, coalesce(CASE WHEN is_call THEN v ->> '$.input' ELSE v END, '{{}}') AS input FROM c WHERE name <> 'Claude_Code_Tool_Task' OR is_call
""")
def tool_span_calls(spark, d):
    return dialogue.tool_spans(_spans(spark, d)).select("id", "tool", "tool_use_id", "input")


_FACTS = f"""
    f AS (SELECT session_id, arg_min(u, id) FILTER (u <> '') AS uuid, arg_min(h, id) FILTER (h <> '') AS user_hash, min(start_time) AS a, max(end_time) AS b, count(*) AS n, coalesce(sum(llm_token_count_total), 0) AS t,
                 count(*) FILTER (contains(input_value, 'Your task is to create a detailed summary')) AS k
          FROM (SELECT *, regexp_extract(raw_attributes, 'session_({T.UUID})', 1) AS u, regexp_extract(raw_attributes, 'user_([a-zA-Z0-9]+)_account', 1) AS h FROM spans) WHERE session_id IS NOT NULL GROUP BY 1),
    m AS (SELECT *, row_number() OVER w - 1 AS session_index, first_value(session_id) OVER w AS chain_id FROM f WHERE uuid IS NOT NULL WINDOW w AS (PARTITION BY uuid ORDER BY a NULLS FIRST, session_id)),
    ch AS (SELECT chain_id, max(uuid) AS claude_session_id, arg_min(user_hash, session_index) FILTER (user_hash IS NOT NULL) AS user_hash, string_agg(session_id, ',' ORDER BY session_index) AS session_ids, count(*) AS sessions, sum(n)::BIGINT AS spans,
                  sum(t)::BIGINT AS tokens, sum(k)::BIGINT AS compactions, min(a) AS start_time, max(b) AS end_time FROM m GROUP BY 1)
"""


@register(f"WITH {_FACTS} SELECT * FROM ch")
def conversation_chains(spark, d):
    return dialogue.chains(_spans(spark, d))


@register(f"WITH {_FACTS} SELECT CASE WHEN sessions <= 3 THEN sessions::VARCHAR WHEN sessions <= 5 THEN '4-5' WHEN sessions <= 10 THEN '6-10' ELSE '11+' END AS bucket, count(*) AS chains FROM ch GROUP BY 1")
def chain_length_histogram(spark, d):
    return links.chain_lengths(dialogue.chains(_spans(spark, d)))


@register(f"WITH {_FACTS} SELECT count(*) AS chains, sum(sessions)::BIGINT AS sessions, round(avg(sessions), 2) AS avg_length, max(sessions) AS max_length, sum(compactions)::BIGINT AS compactions FROM ch")
def chain_summary(spark, d):
    return dialogue.chain_summary(dialogue.chains(_spans(spark, d)))


@register(f"WITH {_FACTS} SELECT chain_id, sessions, spans FROM ch WHERE sessions >= 1")
def longest_chains(spark, d):
    return dialogue.longest_first(dialogue.chains(_spans(spark, d))).select("chain_id", "sessions", "spans")


_TURNS = f"""
    p AS (SELECT s.*, m.chain_id, m.session_index, s.name[29:] AS suffix FROM spans s JOIN m USING (session_id) WHERE starts_with(s.name, 'Claude_Code_Internal_Prompt_')),
    l AS (SELECT chain_id, session_index, session_id, suffix, arg_max(id, (start_time IS NOT NULL, start_time, id)) AS id, min((start_time IS NOT NULL, start_time, id)) AS first_at FROM p GROUP BY 1, 2, 3, 4),
    t AS (SELECT l.*, s.span_id, s.parent_id, {_GIVEN} AS input, {_OUT} AS output, {_MODEL} AS model, s.llm_token_count_prompt AS tokens_prompt, s.llm_token_count_completion AS tokens_completion FROM l JOIN spans s ON s.id = l.id),
    k AS (SELECT * FROM t WHERE NOT contains(input, 'This session is being continued from a previous conversation') AND NOT contains(input, 'Your task is to create a detailed summary'))
"""


@register(f"""
    WITH {_FACTS}, {_TURNS}
    SELECT chain_id, row_number() OVER (PARTITION BY chain_id ORDER BY session_index, CASE WHEN regexp_full_match(suffix, '\\d+') THEN suffix::BIGINT ELSE 0 END, first_at) - 1 AS turn_index, session_id, session_index, suffix AS turn_suffix, id, span_id, parent_id,
           'main_thread' AS thread_type, model, tokens_prompt, tokens_completion, input, output FROM k
""")
def turn_records(spark, d):
    s = _spans(spark, d)
    return dialogue.turns(s, dialogue.chain_members(s)).select("chain_id", "turn_index", "session_id", "session_index", "turn_suffix", "id", "span_id", "parent_id", "thread_type", "model", "tokens_prompt", "tokens_completion", "input", "output")


@register(f"""
    WITH {_FACTS}, {_TURNS}, c AS (SELECT chain_id, model, count(*) AS n FROM k WHERE model <> '' GROUP BY 1, 2), x AS (SELECT chain_id, string_agg(model || '=' || n, ',' ORDER BY model) AS models FROM c GROUP BY 1)
    SELECT chain_id, count(*) AS turns, count(*) AS main_thread_turns, 0 AS ancillary_turns, 0 AS subagent_turns, coalesce(sum(tokens_prompt), 0)::BIGINT AS prompt_tokens, coalesce(sum(tokens_completion), 0)::BIGINT AS completion_tokens, coalesce(any_value(x.models), '') AS models
    FROM k LEFT JOIN x USING (chain_id) GROUP BY 1
""")
def turn_metrics(spark, d):
    s = _spans(spark, d)
    return dialogue.turn_metrics(dialogue.turns(s, dialogue.chain_members(s), ancillary=True))


def _events(spark, d):
    s = _spans(spark, d)
    m = written(dialogue.chain_members(s), "members")
    return s, m, dialogue.chain_events(s, m)


@register(f"""
    WITH {_FACTS}, k AS (SELECT s.*, m.chain_id FROM spans s JOIN m USING (session_id)), task AS (SELECT DISTINCT chain_id, trace_id FROM k WHERE name = 'Claude_Code_Tool_Task' AND trace_id IS NOT NULL),
    main AS (SELECT * FROM k WHERE trace_id IS NULL OR chain_id NOT IN (SELECT chain_id FROM task) OR (chain_id, trace_id) IN (SELECT chain_id, trace_id FROM task)),
    v AS (SELECT *, {_J} AS j, CASE WHEN json_valid(json_extract_string({_J}, '$.attributes.input.value')) THEN json_extract_string({_J}, '$.attributes.input.value') END AS v FROM main WHERE starts_with(name, 'Claude_Code_Tool_') AND name <> 'Claude_Code_Tool_Task' AND {_J} IS NOT NULL),
    tools AS (SELECT chain_id, id, 'tool' AS event_type, start_time AS timestamp, coalesce(json_extract_string(j, '$.attributes.output.value'), '') AS text, '' AS tool_use_id, name[18:] AS tool, coalesce(v, '{{}}') AS input, 0 AS pos FROM v),
    p AS (SELECT chain_id, id, start_time, coalesce(end_time, start_time) AS end_at, {_GIVEN} AS g, {_OUT} AS o FROM main WHERE starts_with(name, 'Claude_Code_Internal_Prompt_') AND start_time IS NOT NULL),
    said AS (SELECT chain_id, id, 'user' AS event_type, start_time AS timestamp, regexp_replace(g, '^\\s+|\\s+$', '', 'g') AS text FROM p UNION ALL SELECT chain_id, id, 'assistant', end_at, regexp_replace(o, '^\\s+|\\s+$', '', 'g') FROM p),
    kept AS (SELECT *, row_number() OVER (PARTITION BY chain_id, event_type, text[1:100] ORDER BY id) AS r FROM said WHERE CASE event_type WHEN 'user' THEN length(text) > 10 AND NOT (starts_with(text, 'Command:') AND contains(text, chr(10) || 'Output:'))
             AND NOT (starts_with(text, '{{') AND ends_with(text, '}}')) AND NOT regexp_matches(text, '^(<system|Files modified by|Explore the ~/|Search for and read)') ELSE length(text) >= 5 END),
    ev AS (SELECT chain_id, id, event_type, timestamp, text, tool_use_id, tool, input, 0.5 AS idx FROM tools UNION ALL SELECT chain_id, id, event_type, timestamp, text, NULL, NULL, NULL, NULL FROM kept WHERE r = 1),
    n AS (SELECT *, coalesce(idx, CASE WHEN count(idx) OVER (PARTITION BY chain_id) > 0 THEN coalesce(max(idx) OVER (PARTITION BY chain_id ORDER BY timestamp NULLS FIRST RANGE UNBOUNDED PRECEDING), 0) + 0.1 END)::DOUBLE AS order_idx FROM ev)
    SELECT chain_id, CAST(row_number() OVER (PARTITION BY chain_id ORDER BY coalesce(order_idx, 1), CASE event_type WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END, timestamp NULLS FIRST, id) - 1 AS INTEGER) AS event_no,
           event_type, order_idx, timestamp, text, tool_use_id, tool, input, NULL AS subagent_type, NULL AS description, NULL AS prompt FROM n
""")
def chain_events(spark, d):
    """The events of each chain in order."""
    return _events(spark, d)[2]


@register()
def chain_markdown(spark, d):
    """The documents of all chains, in pieces."""
    s, m, e = _events(spark, d)
    return render.markdown(e, render.heads_of(dialogue.chains(s), s, m))


@register()
def chain_export_check(spark, d):
    """Of the events of each chain, how many stand in its document."""
    s, m, e = _events(spark, d)
    e = written(e, "events")
    return reports.export_check(e, render.markdown(e, render.heads_of(dialogue.chains(s), s, m)))


@register(f"""
    WITH a AS (SELECT id, session_id, start_time, coalesce(nullif(json_extract({_J}, '$."llm.input_messages"')::VARCHAR, '[]'), json_extract({_J}, '$.attributes.llm.input_messages')::VARCHAR) AS a FROM spans WHERE session_id IS NOT NULL AND NOT contains(lower({_MODEL}), 'haiku')),
    i AS (SELECT id, session_id, start_time, generate_subscripts(l, 1) AS pos, unnest(l) AS i FROM (SELECT *, CASE WHEN json_type(a::JSON) = 'ARRAY' THEN json_extract(a::JSON, '$[*]') END AS l FROM a WHERE a IS NOT NULL)),
    m AS (SELECT *, CASE WHEN json_type(i, '$.message') = 'OBJECT' THEN json_extract(i, '$.message') ELSE i END AS m FROM i), t AS (SELECT *, m ->> '$.content' AS text FROM m WHERE m ->> '$.role' = 'user')
    SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY start_time IS NOT NULL, start_time NULLS FIRST, id, pos) - 1 AS INTEGER) AS event_no, 'user' AS event_type, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, NULL AS tool, NULL AS input
    FROM t WHERE NOT contains(text, 'This session is being continued from a previous conversation') AND NOT contains(text, 'Your task is to create a detailed summary') AND {S.live('text')}
""")
def live_events(spark, d):
    return dialogue.live_events(_spans(spark, d))


@register(f"""
    WITH x AS (SELECT *, starts_with(coalesce(name, ''), 'Claude_Code_Tool_Task') AS is_task FROM spans WHERE session_id IS NOT NULL), t AS (SELECT DISTINCT session_id, trace_id FROM spans WHERE name = 'Claude_Code_Tool_Task' AND trace_id IS NOT NULL)
    SELECT id FROM spans s WHERE session_id IS NOT NULL AND (trace_id IS NULL OR session_id NOT IN (SELECT session_id FROM t WHERE session_id IS NOT NULL) OR (session_id, trace_id) IN (SELECT session_id, trace_id FROM t WHERE session_id IS NOT NULL))
""")
def spans_of_main_traces(spark, d):
    """The spans of each session that lie in traces that launch tasks; all where it launches none."""
    s = _spans(spark, d)
    return dialogue.main_spans(s, s.filter("session_id IS NOT NULL").select("session_id").distinct().withColumn("chain_id", F.col("session_id"))).select("id")


@register(f"""
    WITH {S.LINES}, r AS (SELECT bl.session_id, b ->> '$.tool_use_id' AS tool_id, (ts IS NULL, ts, uuid) AS place,
        CASE WHEN json_type(b, '$.content') = 'ARRAY' THEN array_to_string(list_filter(list_transform(json_extract(b, '$.content[*]'), lambda x: CASE WHEN x ->> '$.type' = 'text' THEN x ->> '$.text' END), lambda x: x IS NOT NULL), chr(10)) ELSE b ->> '$.content' END AS result
        FROM bl WHERE type = 'user' AND b ->> '$.type' = 'tool_result')
    SELECT session_id, tool_id, arg_max(result, place) AS result FROM r WHERE result <> '' GROUP BY 1, 2
""")
def last_tool_results(spark, d):
    return dialogue.last_tool_results(transcript.lines(table(spark, d, "claude_session_with_subagent")))


# Batches, coverage, statistics, checks

_SIZE = "length(coalesce(input_value, '')) // 4 + length(coalesce(output_value, '')) // 4 + 50"


@register(f"""
    WITH c AS (SELECT session_id, string_agg(category || '=' || n, ',' ORDER BY category) AS v FROM (SELECT session_id, category, count(*) AS n FROM ({S.CATEGORY}) GROUP BY 1, 2) GROUP BY 1),
    m AS (SELECT session_id, string_agg(llm_model_name || '=' || n, ',' ORDER BY llm_model_name) AS v FROM (SELECT session_id, llm_model_name, count(*) AS n FROM spans WHERE llm_model_name <> '' GROUP BY 1, 2) GROUP BY 1),
    g AS (SELECT session_id, count(*) AS span_count, sum({_SIZE})::BIGINT AS token_estimate, coalesce(bool_or(status_code = 'ERROR'), false) AS has_errors FROM spans WHERE session_id IS NOT NULL GROUP BY 1)
    SELECT session_id, 'session_' || session_id AS batch_id, span_count, token_estimate, coalesce(c.v, '') AS categories, coalesce(m.v, '') AS models, has_errors FROM g LEFT JOIN c USING (session_id) LEFT JOIN m USING (session_id)
""")
def session_batches(spark, d):
    return reports.session_batches(_spans(spark, d))


@register()
def span_records(spark, d):
    """Spans as JSON for a model."""
    return reports.span_records(_spans(spark, d)).select("id", "record")


@register(f"""
    WITH m AS (SELECT session_id, count(*) AS n, coalesce((epoch_us(greatest(max(start_time), max(end_time))) - epoch_us(least(min(start_time), min(end_time)))) / 6e7, 0.0) AS mins,
        count(*) FILTER (category = 'main' OR (category <> 'haiku_holdover' AND (contains(coalesce(name, ''), 'Internal_Prompt') OR contains(coalesce(name, ''), 'Final_Output')))) AS turns,
        coalesce(string_agg(DISTINCT CASE WHEN contains(name, 'Tool') THEN replace(replace(name, 'Claude_Code_Tool_', ''), 'Claude_Code_', '') END, ', ' ORDER BY CASE WHEN contains(name, 'Tool') THEN replace(replace(name, 'Claude_Code_Tool_', ''), 'Claude_Code_', '') END), 'none') AS tools,
        coalesce(string_agg(DISTINCT nullif(llm_model_name, ''), ', ' ORDER BY nullif(llm_model_name, '')), 'unknown') AS models, count(*) FILTER (status_code = 'ERROR') AS errors FROM ({S.CATEGORY}) WHERE session_id IS NOT NULL GROUP BY 1),
    f AS (SELECT session_id, string_agg(coalesce(name, 'unknown'), ', ' ORDER BY id) AS ops FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS r FROM spans WHERE span_kind = 'TOOL' AND session_id IS NOT NULL) WHERE r <= 5 GROUP BY 1)
    SELECT session_id, 'Session with ' || n || ' spans. Duration: ' || printf('%.1f', mins) || ' minutes. Turns: ' || turns || '. Tools used: ' || tools || '. Models: ' || models || '. Errors: ' || errors || coalesce('. Sample operations: ' || ops, '') AS text
    FROM m LEFT JOIN f USING (session_id)
""")
def session_texts(spark, d):
    return reports.session_texts(_spans(spark, d))


_CHUNKS = """
    c AS (SELECT session_id AS id, unnest([input_value, output_value] || coalesce(CASE WHEN json_valid(input_messages) THEN list_transform(json_extract(input_messages, '$[*]'), lambda m: coalesce(nullif(m ->> '$."message.content"', ''), m ->> '$.content')) END, [])
            || coalesce(CASE WHEN json_valid(output_messages) THEN list_transform(json_extract(output_messages, '$[*]'), lambda m: coalesce(nullif(m ->> '$."message.content"', ''), m ->> '$.content')) END, [])) AS chunk FROM spans WHERE session_id IS NOT NULL),
    h AS (SELECT DISTINCT id, lower(regexp_replace(chunk, '^\\s+|\\s+$', '', 'g')) AS h FROM c WHERE length(regexp_replace(chunk, '^\\s+|\\s+$', '', 'g')) > 10),
    g AS (SELECT id, count(*) AS n, list_sort(list(h)) AS s FROM h GROUP BY 1), cl AS (SELECT id, n, min(id) OVER (PARTITION BY s) AS rep FROM g), x AS (SELECT h.id, h.h, cl.n FROM h JOIN cl ON cl.id = h.id AND cl.rep = cl.id),
    pr AS (SELECT a.id AS child, b.id AS parent, round(100.0 * count(*) / a.n, 2) AS o FROM x a JOIN x b ON a.h = b.h AND (a.n < b.n OR a.n = b.n AND a.id < b.id) GROUP BY a.id, b.id, a.n),
    kin AS (SELECT child, parent, o >= 95 AS whole FROM pr WHERE o >= 50 UNION ALL SELECT id, rep, true FROM cl WHERE id <> rep)
"""


@register(f"""
    WITH {_CHUNKS}, n AS (SELECT session_id AS id, count(*) AS n FROM spans WHERE session_id IS NOT NULL GROUP BY 1), k AS (SELECT child AS id, bool_or(whole) AS whole, count(*) FILTER (whole) AS times FROM kin GROUP BY 1)
    SELECT count(*) AS sessions, sum(n)::BIGINT AS spans, count(*) FILTER (whole IS NULL) AS complete, count(*) FILTER (whole) AS subsets, count(*) FILTER (NOT whole) AS partial, count(*) FILTER (whole IS NULL AND id NOT IN (SELECT parent FROM kin)) AS "unique",
           coalesce(sum(n * times) FILTER (whole), 0)::BIGINT AS deletable_spans FROM n LEFT JOIN k USING (id)
""")
def session_coverage(spark, d):
    return reports.coverage(_spans(spark, d))


@register(f"WITH {_CHUNKS} SELECT child AS session_id, min(parent) AS kept_in FROM kin WHERE whole GROUP BY 1")
def deletable_sessions(spark, d):
    return reports.deletable(_spans(spark, d))


@register(f"WITH {_CHUNKS} SELECT child, parent, o AS overlap, CASE WHEN o >= 95 THEN 'complete' WHEN o >= 80 THEN 'review' ELSE 'keep_both' END AS relation FROM pr WHERE o >= 50")
def contained_sessions(spark, d):
    """Pairs of sessions of which one's texts lie, wholly or for the most part, in the other; of sessions with the same texts one stands for all, as in session_classes."""
    return links.containment(reports.session_chunks(_spans(spark, d)))


@register(f"WITH {_CHUNKS} SELECT id AS session_id, rep AS class_id, n AS chunks FROM cl")
def session_classes(spark, d):
    """Every session that has texts with the session that stands for its class."""
    s = _spans(spark, d)
    ids = s.filter("session_id IS NOT NULL").select(F.col("session_id").alias("id"), F.lit(None).cast("string").alias("text")).distinct()
    c = links.containment_classes(ids, reports.session_chunks(s)).filter("class_id IS NOT NULL")
    return c.select(F.col("id").alias("session_id"), "class_id", "chunks")


def _top(column: str, k: int, of: str) -> str:
    return f"SELECT * FROM (SELECT '{column}' AS statistic, {column} AS value, count(*) AS n FROM {of} WHERE {column} IS NOT NULL GROUP BY 2 ORDER BY n DESC, value LIMIT {k})"


@register(f"SELECT 'rows' AS statistic, NULL AS value, count(*) AS n FROM spans UNION ALL {_top('status_code', 1000, 'spans')} UNION ALL {_top('name', 15, 'spans')} UNION ALL {_top('llm_model_name', 10, 'spans')}")
def span_statistics(spark, d):
    return reports.top_counts(_spans(spark, d), {"status_code": 1000, "name": 15, "llm_model_name": 10})


@register(f"SELECT 'rows' AS statistic, NULL AS value, count(*) AS n FROM session_events UNION ALL {_top('event_type', 1000, 'session_events')} UNION ALL {_top('tool_name', 10, 'session_events')}")
def event_statistics(spark, d):
    return reports.top_counts(table(spark, d, "session_events"), {"event_type": 1000, "tool_name": 10})


@register("""
    WITH g AS (SELECT bool_or(l AND n(input_value) AND NOT contains(coalesce(input_value, ''), 'redacted-by-litellm')) AS a, bool_or(l AND (n(output_messages) OR n(output_value))) AS b, bool_or(l AND coalesce(llm_token_count_prompt, 0) > 0) AS c, bool_or(l) AS l FROM (SELECT *, upper(coalesce(span_kind, '')) = 'LLM' AS l FROM spans))
    SELECT 'llm_input_content_populated' AS "check", a AS passed FROM g WHERE l UNION ALL SELECT 'llm_output_content_populated', b FROM g WHERE l UNION ALL SELECT 'llm_token_counts_populated', c FROM g WHERE l
""".replace("n(input_value)", "coalesce(lower(trim(input_value)) NOT IN ('', 'none', 'nan', 'null', '[]', '{}'), false)").replace("n(output_messages)", "coalesce(lower(trim(output_messages)) NOT IN ('', 'none', 'nan', 'null', '[]', '{}'), false)").replace("n(output_value)", "coalesce(lower(trim(output_value)) NOT IN ('', 'none', 'nan', 'null', '[]', '{}'), false)"))
def content_checks(spark, d):
    return reports.content_checks(_spans(spark, d))


@register(f"""
    SELECT llm_model_name, CASE WHEN regexp_matches(p, '"thinking":\\s*\\{{"type":\\s*"adaptive"') THEN 'adaptive' WHEN regexp_matches(p, '"thinking":\\s*\\{{"type":\\s*"disabled"') THEN 'disabled' WHEN contains(p, 'budget_tokens') THEN 'budget' ELSE 'absent' END AS thinking, count(*) AS n
    FROM (SELECT llm_model_name, coalesce(json_extract_string({_J}, '$.attributes.llm.invocation_parameters'), '') AS p FROM spans WHERE name = 'litellm_request') GROUP BY 1, 2
""")
def thinking_modes(spark, d):
    return _spans(spark, d).filter("name = 'litellm_request'").groupBy("llm_model_name", reports.thinking_mode().alias("thinking")).agg(F.count("*").alias("n"))


@register("""
    WITH m AS (SELECT session_id, id, CASE WHEN json_valid(input_messages) THEN list_transform(json_extract(input_messages, '$[*]'), lambda x: x::VARCHAR) END AS m FROM spans WHERE session_id IS NOT NULL), b AS (SELECT *, lag(m) OVER (PARTITION BY session_id ORDER BY id) AS b FROM m WHERE m IS NOT NULL)
    SELECT session_id, id, len(b)::INTEGER AS previous, len(m)::INTEGER AS current, len(list_filter(b, lambda x: list_contains(m, x)))::INTEGER AS repeated, len(list_filter(m, lambda x: NOT list_contains(b, x)))::INTEGER AS "new",
           CASE WHEN len(m) > 0 THEN round(100.0 * len(list_filter(b, lambda x: list_contains(m, x))) / len(m), 2) ELSE 0.0 END AS overlap FROM b WHERE b IS NOT NULL
""")
def message_changes(spark, d):
    return reports.message_changes(_spans(spark, d))


@register("""
    WITH l AS (SELECT session_id, max(id) AS last_id FROM spans WHERE session_id IS NOT NULL GROUP BY 1), t AS (SELECT l.session_id, concat_ws(chr(10), input_value, output_value, input_messages, output_messages) AS later FROM l JOIN spans s ON s.id = l.last_id),
    p AS (SELECT session_id, id, list_filter(list_transform([input_value, output_value], lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM spans WHERE session_id IS NOT NULL)
    SELECT session_id, id, len(p)::INTEGER AS chunks, len(list_filter(p, lambda x: contains(later, x)))::INTEGER AS contained, round(100.0 * len(list_filter(p, lambda x: contains(later, x))) / len(p), 2) AS share
    FROM p JOIN l USING (session_id) JOIN t USING (session_id) WHERE len(p) > 0 AND id <> last_id
""")
def contained_in_last(spark, d):
    return reports.contained_in_last(_spans(spark, d))


@register("SELECT session_id, min(source) AS source, arg_min(n, source) AS spans FROM (SELECT session_id, source, count(*) AS n FROM spans WHERE session_id IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def first_sources(spark, d):
    return reports.first_source(_spans(spark, d))


@register("SELECT id, start_time FROM spans ORDER BY start_time NULLS LAST, id LIMIT 50 OFFSET 100")
def span_page(spark, d):
    return reports.page(_spans(spark, d).select("id", "start_time"), "start_time", "id", limit=50, offset=100)


@register("SELECT session_id, count(*) AS spans FROM spans WHERE session_id IS NOT NULL GROUP BY 1 ORDER BY spans DESC, session_id LIMIT 5")
def top_sessions(spark, d):
    return _spans(spark, d).filter("session_id IS NOT NULL").groupBy("session_id").agg(F.count("*").alias("spans")).orderBy(F.desc("spans"), "session_id").limit(5)


@register("""
    SELECT s.day, s.spans, coalesce(e.events, 0) AS events FROM (SELECT CAST(start_time AS DATE) AS day, count(*) AS spans FROM spans WHERE start_time IS NOT NULL GROUP BY 1) s
    LEFT JOIN (SELECT CAST(timestamp AS DATE) AS day, count(DISTINCT event_id) AS events FROM session_events WHERE timestamp IS NOT NULL GROUP BY 1) e USING (day)
""")
def days_on_both_surfaces(spark, d):
    """Spans beside events of the other surface, by day."""
    s = _spans(spark, d).filter("start_time IS NOT NULL").groupBy(F.to_date("start_time").alias("day")).agg(F.count("*").alias("spans"))
    e = table(spark, d, "session_events").filter("timestamp IS NOT NULL").groupBy(F.to_date("timestamp").alias("day")).agg(F.count_distinct("event_id").alias("events"))
    return s.join(e, "day", "left").select("day", "spans", F.coalesce("events", F.lit(0)).alias("events"))


@register(f"SELECT count(*) AS texts, count(*) FILTER ({S.human('text')}) AS kept, round(1 - count(*) FILTER ({S.human('text')}) / count(*), 4) AS drop_rate FROM session_events WHERE text IS NOT NULL")
def human_turn_share(spark, d):
    e = table(spark, d, "session_events").filter("text IS NOT NULL").agg(F.count("*").alias("texts"), F.count_if(T.is_human_turn(F.col("text"))).alias("kept"))
    return e.withColumn("drop_rate", F.when(F.col("texts") > 0, F.round(1 - F.col("kept") / F.col("texts"), 4)))


@register("SELECT id FROM spans WHERE contains(lower(coalesce(input_value, '')), 'pending cache') OR contains(lower(coalesce(output_value, '')), 'pending cache')")
def literal_search(spark, d):
    return query.literal(_spans(spark, d), "Pending Cache").select("id")


@register("SELECT ticket, count(DISTINCT session_id) AS sessions, min(session_id) AS first_session FROM (SELECT session_id, unnest(regexp_extract_all(concat_ws(' ', input_value, output_value), '\\b([A-Z][A-Z0-9]+-\\d+)\\b', 1)) AS ticket FROM spans WHERE session_id IS NOT NULL) GROUP BY 1")
def sessions_by_ticket(spark, d):
    s = _spans(spark, d).filter("session_id IS NOT NULL").select("session_id", F.explode(T.tickets(F.concat_ws(" ", "input_value", "output_value"))).alias("ticket"))
    return s.groupBy("ticket").agg(F.count_distinct("session_id").alias("sessions"), F.min("session_id").alias("first_session"))


@register("SELECT session_id, count(*) AS span_count, count(DISTINCT trace_id) AS traces, (epoch_us(max(end_time)) - epoch_us(min(start_time))) / 1000.0 AS duration_ms FROM spans WHERE session_id IS NOT NULL GROUP BY 1")
def session_traces(spark, d):
    g = _spans(spark, d).filter("session_id IS NOT NULL").groupBy("session_id").agg(F.count("*").alias("span_count"), F.count_distinct("trace_id").alias("traces"), F.min("start_time").alias("a"), F.max("end_time").alias("b"))
    return g.select("session_id", "span_count", "traces", ((F.unix_micros("b") - F.unix_micros("a")) / 1000.0).alias("duration_ms"))


@register(f"""
    WITH s AS (SELECT {S.OPERATION} AS op, {S.FILE_PATH} AS file FROM spans) SELECT count(DISTINCT file) AS files, count(*) FILTER (op = 'edit') AS edits, count(*) FILTER (op = 'write') AS writes, round(count(*) FILTER (op = 'edit') / count(DISTINCT file), 4) AS churn_ratio
    FROM s WHERE op IS NOT NULL AND file IS NOT NULL
""")
def churn_summary(spark, d):
    return metrics.churn_summary(metrics.churn(_spans(spark, d)))


@register("SELECT id, epoch_us(start_time) // 1000 AS start_ms, epoch_us(end_time) // 1000 AS end_ms FROM spans")
def millisecond_times(spark, d):
    return _spans(spark, d).select("id", F.unix_millis("start_time").alias("start_ms"), F.unix_millis("end_time").alias("end_ms"))


@register("""
    SELECT session_id, count(*) AS spans, min(start_time) AS first_seen, max(start_time) AS last_seen, coalesce(string_agg(DISTINCT llm_model_name, ',' ORDER BY llm_model_name), '') AS models, arg_min(account_id, id) FILTER (account_id IS NOT NULL) AS account_id FROM spans WHERE session_id IS NOT NULL GROUP BY 1
""")
def archive_sessions(spark, d):
    first = F.min_by("account_id", F.when(F.col("account_id").isNotNull(), F.col("id")))
    return _spans(spark, d).filter("session_id IS NOT NULL").groupBy("session_id").agg(F.count("*").alias("spans"), F.min("start_time").alias("first_seen"), F.max("start_time").alias("last_seen"), F.array_join(F.array_sort(F.collect_set("llm_model_name")), ",").alias("models"), first.alias("account_id"))


@register("""
    WITH t AS (SELECT session_id, event_id, tool_name AS n, CASE WHEN json_valid(tool_input) THEN tool_input END AS j FROM session_events WHERE tool_name IS NOT NULL),
    g AS (SELECT *, coalesce(j ->> '$.file_path', '') AS f, coalesce(j ->> '$.command', '') AS c, coalesce(j ->> '$.pattern', '') AS p, coalesce(j ->> '$.path', '.') AS w, coalesce(j ->> '$.subagent_type', '') AS s, coalesce(j ->> '$.description', '') AS d,
                 coalesce(j ->> '$.args', '') AS a, coalesce(j ->> '$.skill', 'unknown') AS k, coalesce(json_array_length(j, '$.questions'), 0) AS q, coalesce(j ->> '$.questions[0].header', '') AS h, coalesce(j ->> '$.questions[0].question', '') AS x,
                 CASE WHEN json_type(j::JSON) = 'OBJECT' THEN j ->> ('$."' || list_sort(json_keys(j))[1] || '"') END AS r FROM t)
    SELECT session_id, event_id, n AS tool_name, CASE WHEN n IN ('Read', 'Write', 'Edit') THEN CASE WHEN length(f) > 60 THEN '...' || f[-57:] ELSE f END WHEN n = 'Bash' THEN CASE WHEN length(c) > 50 THEN c[1:47] || '...' ELSE c END
        WHEN n IN ('Grep', 'Glob') THEN '`' || p || '` in `' || w || '`' WHEN n = 'Task' THEN s || ': ' || CASE WHEN length(d) > 30 THEN d[1:27] || '...' ELSE d END WHEN n = 'Skill' THEN k || CASE WHEN a <> '' THEN ' ' || CASE WHEN length(a) > 30 THEN a[1:27] || '...' ELSE a END ELSE '' END
        WHEN n = 'AskUserQuestion' THEN CASE WHEN q < 1 THEN 'question' ELSE CASE WHEN h <> '' THEN h WHEN length(x) > 40 THEN x[1:37] || '...' ELSE x END || CASE WHEN q > 1 THEN ' (+' || (q - 1) || ')' ELSE '' END END
        ELSE coalesce(CASE WHEN length(r) > 50 THEN r[1:47] || '...' ELSE r END, '') END AS target FROM g
""")
def tool_targets(spark, d):
    """What the events' tool calls are about."""
    return table(spark, d, "session_events").filter("tool_name IS NOT NULL").select("session_id", "event_id", "tool_name", T.tool_target(F.col("tool_name"), F.col("tool_input")).alias("target"))
