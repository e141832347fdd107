"""Queries that write through a sink and read back through a reader, or go through a backend's layout, and their SQL: what comes back must be what was there."""

from __future__ import annotations

import sqlite3

from pyspark.sql import functions as F

from tracequarry.functions import identity as I
from tracequarry.functions import text as T
from tracequarry.functions.times import parse_time
from tracequarry.plans import fragments as S
from tracequarry.plans.reference import registry
from tracequarry.session import scratch, table
from tracequarry.sources import readers, sinks

QUERIES, SQL, register = registry()


def _spans(spark, d):
    return table(spark, d, "spans")


_LAST = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(trace_id, ''), span_id ORDER BY id DESC) AS r FROM spans) WHERE r = 1
"""


@register(f"SELECT trace_id, span_id, session_id, name, start_time, end_time, status_code, llm_token_count_total, input_value, 'one' AS source, CASE WHEN start_time IS NULL THEN 'unknown' ELSE strftime(start_time, '%G-W%V') END AS week FROM ({_LAST})")
def stored_spans(spark, d):
    """Spans written by week, twice, and read back: the second run adds none."""
    root = scratch(spark, "stored-spans")
    s = _spans(spark, d).orderBy("id").drop("id")
    sinks.write_spans(s, root, "one")
    sinks.write_spans(s, root, "one")
    week = spark.read.parquet(readers.find_sources(spark, root)["one"]).select("trace_id", "span_id", "week")
    back = readers.read_source(spark, root, "one").withColumn("_s", F.coalesce("span_id", F.lit("")))
    week = week.select(F.coalesce("trace_id", F.lit("")).alias("_t"), F.coalesce("span_id", F.lit("")).alias("_s"), "week")
    j = back.withColumn("_t", F.coalesce("trace_id", F.lit(""))).join(week, ["_t", "_s"])
    return j.select("trace_id", "span_id", "session_id", "name", "start_time", "end_time", "status_code", "llm_token_count_total", "input_value", "source", "week")


@register("SELECT source, count(*) AS spans, count(DISTINCT session_id) AS sessions FROM spans WHERE source IS NOT NULL GROUP BY 1")
def all_sources(spark, d):
    """Each source as a flat file of its own, found and read as one."""
    root = scratch(spark, "all-sources")
    names = [r["source"] for r in _spans(spark, d).select("source").filter("source IS NOT NULL").distinct().collect()]  # a handful of sources
    for n in names:
        _spans(spark, d).filter(F.col("source") == n).drop("source").write.parquet(f"{root}/{n}_spans.parquet")
    return readers.read_all(spark, root).groupBy("source").agg(F.count("*").alias("spans"), F.count_distinct("session_id").alias("sessions"))


@register("SELECT session_id, span_id, name, start_time, status_code, input_value, output_value FROM spans WHERE session_id IS NOT NULL")
def stored_nested_sessions(spark, d):
    """Sessions as JSON lines with their spans, read back as spans."""
    path = scratch(spark, "nested") + "/sessions.jsonl"
    sinks.write_nested_sessions(_spans(spark, d), path)
    return readers.read_nested_sessions(spark, path).select("session_id", "span_id", "name", "start_time", "status_code", "input_value", "output_value")


@register("""
    SELECT session_id, 'one' AS source, count(*) AS span_count, min(start_time) AS first_span_time, max(start_time) AS last_span_time, coalesce(sum(llm_token_count_prompt), 0)::BIGINT AS total_prompt_tokens,
           coalesce(sum(llm_token_count_completion), 0)::BIGINT AS total_completion_tokens, coalesce(sum(llm_token_count_total), 0)::BIGINT AS total_tokens,
           coalesce(string_agg(DISTINCT llm_model_name, ',' ORDER BY llm_model_name), '') AS models_used, coalesce(bool_or(status_code = 'ERROR'), false) AS has_errors FROM spans WHERE session_id IS NOT NULL GROUP BY 1
""")
def stored_session_rows(spark, d):
    """Session rows, first those of one half of the sessions, then what is new."""
    root = scratch(spark, "session-rows")
    s = _spans(spark, d)
    first = s.filter("session_id < '8'")
    sinks.append_sessions(first, root, "one")
    sinks.append_sessions(s, root, "one")
    return spark.read.parquet(f"{root}/sessions/source=one").withColumn("source", F.lit("one"))


@register("SELECT session_id, event_id, order_idx, timestamp, event_type, text, tool_name, 'ann' AS source FROM session_events")
def stored_events(spark, d):
    path = scratch(spark, "events")
    sinks.write_events(table(spark, d, "session_events"), f"{path}/ann_events.parquet")
    return readers.read_events(spark, f"{path}/*_events.parquet").select("session_id", "event_id", "order_idx", "timestamp", "event_type", "text", "tool_name", "source")


@register("SELECT span_id, trace_id, name, start_time, llm_token_count_total, input_value FROM spans")
def stored_raw(spark, d):
    """Raw JSON lines, appended in two parts, read back."""
    path = scratch(spark, "raw")
    s = _spans(spark, d)
    sinks.append_raw(s.filter("coalesce(status_code, '') = 'OK'"), path, "one")
    sinks.append_raw(s.filter("coalesce(status_code, '') <> 'OK'"), path, "one")
    return readers.read_span_lines(spark, path).select("span_id", "trace_id", "name", "start_time", "llm_token_count_total", "input_value")


@register("SELECT DISTINCT coalesce(trace_id, '') AS trace_id, span_id FROM spans")
def merged_raw(spark, d):
    """Raw lines with all repetitions, merged to one row a span."""
    path = scratch(spark, "raw-merge")
    sinks.append_raw(_spans(spark, d), f"{path}/raw", "one")
    sinks.merge_raw(spark, f"{path}/raw", f"{path}/merged")
    return spark.read.parquet(f"{path}/merged").select(F.coalesce("trace_id", F.lit("")).alias("trace_id"), "span_id")


_TABLE = "SELECT id, name, CAST(llm_token_count_total AS VARCHAR) AS tokens FROM spans"


@register(_TABLE)
def rows_as_json(spark, d):
    path = scratch(spark, "json")
    sinks.write(_spans(spark, d).select("id", "name", F.col("llm_token_count_total").cast("string").alias("tokens")), "json", path)
    return spark.read.schema("id long, name string, tokens string").json(path)


@register(_TABLE)
def rows_as_csv(spark, d):
    path = scratch(spark, "csv")
    df = _spans(spark, d).select("id", "name", F.col("llm_token_count_total").cast("string").alias("tokens"))
    sinks.write(df, "csv", path)
    return spark.read.schema("id long, name string, tokens string").option("header", "true").csv(path)


@register("SELECT '| ' || id || ' | ' || coalesce(replace(name, '|', '\\|'), '') || ' |' AS line FROM spans")
def rows_as_markdown(spark, d):
    path = scratch(spark, "markdown")
    sinks.write(_spans(spark, d).select("id", "name"), "markdown", path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@register("SELECT type, uuid, message.content AS content, toolUseResult AS result, timestamp, sessionId AS session_id, cwd FROM claude_session_minimal")
def read_transcript_lines(spark, d):
    """Transcript lines as JSON, read back by the transcript reader."""
    path = scratch(spark, "transcripts")
    table(spark, d, "claude_session_minimal").write.option("ignoreNullFields", "true").json(path)
    t = readers.read_transcripts(spark, path)
    return t.select("type", "uuid", F.col("message.content").alias("content"), F.col("toolUseResult").alias("result"), "timestamp", F.col("sessionId").alias("session_id"), "cwd")


@register("SELECT CAST(tool_id AS VARCHAR) AS tool_id, tool_name, family FROM tool_catalog")
def sqlite_rows(spark, d):
    """A small table through a SQLite file and its reader by ranges."""
    readers.register(spark)
    path = scratch(spark, "sqlite").removeprefix("file:") + ".db"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p.getParent())
    rows = [tuple(r) for r in table(spark, d, "tool_catalog").select("tool_id", "tool_name", "family").limit(10_000).collect()]  # a fixed table of 240 rows
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (tool_id INTEGER, tool_name TEXT, family TEXT)")
        c.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    c.close()
    return spark.read.format("tq_sqlite").options(path=path, query="SELECT * FROM t", key="tool_id", partitions="3").load()


@register("SELECT span_id, trace_id, parent_id, name, span_kind, start_time, end_time, status_code, input_value, output_value, llm_model_name, llm_token_count_prompt, llm_token_count_total, 'phoenix' AS backend FROM spans")
def dotted_backend(spark, d):
    """Spans in a backend's dotted columns, normalised."""
    s = _spans(spark, d)
    names = {"span_id": "context.span_id", "trace_id": "context.trace_id", "input_value": "attributes.input.value", "output_value": "attributes.output.value", "llm_model_name": "attributes.llm.model_name", "llm_token_count_prompt": "attributes.llm.token_count.prompt", "llm_token_count_total": "attributes.llm.token_count.total"}
    raw = s.select(*(F.col(c).alias(n) for c, n in names.items()), "parent_id", "name", "span_kind", "start_time", "end_time", "status_code")
    out = readers.normalize_dotted(raw, "phoenix")
    return out.select("span_id", "trace_id", "parent_id", "name", "span_kind", "start_time", "end_time", "status_code", "input_value", "output_value", "llm_model_name", "llm_token_count_prompt", "llm_token_count_total", "backend")


@register("SELECT span_id, input_value, llm_model_name, llm_token_count_total, 'arize' AS backend, epoch_us(start_time) // 1000 AS start_ms FROM spans")
def packed_backend(spark, d):
    """Spans whose attributes are one packed JSON column and whose times are epoch milliseconds, normalised."""
    s = _spans(spark, d)
    packed = F.to_json(F.struct(F.struct(F.col("input_value").alias("value")).alias("input"), F.struct(F.col("llm_model_name").alias("model_name"), F.struct(F.col("llm_token_count_total").alias("total")).alias("token_count")).alias("llm")))
    raw = s.select("span_id", packed.alias("attributes"), F.unix_millis("start_time").cast("string").alias("start_time"))
    out = readers.normalize_dotted(raw, "arize")
    return out.select("span_id", "input_value", "llm_model_name", "llm_token_count_total", "backend", F.unix_millis("start_time").alias("start_ms"))


def _star(spark, d):
    """The backend's tables as they would be for the stored spans: a project for each source and a trace for each (trace, source)."""
    s = _spans(spark, d).filter("trace_id IS NOT NULL AND source IS NOT NULL")
    projects = s.select(F.xxhash64("source").alias("id"), F.col("source").alias("name")).distinct()
    traces = s.select(F.xxhash64("trace_id", "source").alias("id"), "trace_id", F.xxhash64("source").alias("project_rowid")).distinct()
    spans = s.select("id", "span_id", F.xxhash64("trace_id", "source").alias("trace_rowid"), "start_time", "name")
    return s, spans, traces, projects


@register("SELECT id, span_id, trace_id FROM spans WHERE source = 'arize-main' AND trace_id IS NOT NULL AND start_time >= TIMESTAMPTZ '2026-10-05 00:00:00+00' AND start_time < TIMESTAMPTZ '2026-10-12 00:00:00+00'")
def backend_spans(spark, d):
    _, spans, traces, projects = _star(spark, d)
    return readers.backend_spans(spans, traces, projects, "arize-main", start="2026-10-05 00:00:00", end="2026-10-12 00:00:00").select("id", "span_id", "trace_id")


@register("SELECT CAST(id AS VARCHAR) AS annotation_id, span_id, status_code AS label, CAST(llm_token_count_total AS DOUBLE) AS score, name FROM spans WHERE source = 'arize-main' AND trace_id IS NOT NULL AND name = 'litellm_request'")
def backend_annotations(spark, d):
    """Annotations of a project's spans through the backend's four tables, those of one name."""
    s, spans, traces, projects = _star(spark, d)
    notes = s.select("id", F.col("id").alias("span_rowid"), "name", F.struct(F.col("status_code").alias("label"), F.col("llm_token_count_total").cast("double").alias("score"), F.lit(None).cast("string").alias("explanation")).alias("result"))
    out = readers.named_annotations(readers.backend_annotations(notes, spans, traces, projects, "arize-main"), include=["litellm_request"])
    return out.select("annotation_id", "span_id", "label", "score", "name")


@register("SELECT 'events' AS schema, count(*) AS n, count(DISTINCT session_id) AS sessions, count(event_type) AS typed, count(span_kind) AS kinds FROM (SELECT session_id, event_type, NULL AS span_kind FROM session_events) UNION ALL SELECT 'spans', count(*), count(DISTINCT session_id), 0, count(span_kind) FROM spans")
def two_schemas(spark, d):
    u = readers.union_schemas({"spans": _spans(spark, d).select("session_id", "span_kind"), "events": table(spark, d, "session_events").select("session_id", "event_type")})
    return u.groupBy("schema").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"), F.count("event_type").alias("typed"), F.count("span_kind").alias("kinds"))


@register("SELECT id, name FROM spans")
def spans_by_ranges(spark, d):
    """Spans exported by ranges of their id, in a run and one that takes it up again."""
    path = scratch(spark, "ranges")
    s = _spans(spark, d).select("id", "name")
    top = s.agg(F.max("id")).first()[0] or 1
    readers.export_by_ranges(s, path, rows_per_range=max(1, top // 4))
    readers.export_by_ranges(s, path, rows_per_range=max(1, top // 4))
    return spark.read.schema("id long, name string").parquet(path + "/*")


@register("""
    WITH c AS (SELECT session_id, min(name) AS category, max(name) AS label FROM spans WHERE session_id IS NOT NULL GROUP BY 1), u AS (SELECT session_id, arg_max(status_code, id) AS category, arg_max(output_value, id) AS label FROM spans WHERE session_id IS NOT NULL AND status_code IS NOT NULL AND output_value IS NOT NULL GROUP BY 1)
    SELECT session_id, coalesce(substring(u.category, 1, 80), c.category) AS category, coalesce(substring(u.label, 1, 300), c.label) AS label FROM c LEFT JOIN u USING (session_id)
""")
def updated_categories(spark, d):
    s = _spans(spark, d).filter("session_id IS NOT NULL")
    catalog = s.groupBy("session_id").agg(F.min("name").alias("category"), F.max("name").alias("label"))
    new = s.filter("status_code IS NOT NULL AND output_value IS NOT NULL").select("session_id", F.col("status_code").alias("category"), F.col("output_value").alias("label"), F.col("id").alias("at"))
    return sinks.update_categories(catalog, new)


@register(r"""
    SELECT uuid, CASE WHEN regexp_full_match(t, '\d{11,14}') THEN make_timestamptz(CAST(t AS BIGINT) * 1000) WHEN regexp_full_match(t, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*') THEN TRY_CAST(regexp_replace(t, '(Z|[+-]\d{2}:\d{2})$', '') || 'Z' AS TIMESTAMPTZ) END AS ts
    FROM (SELECT uuid, regexp_replace("timestamp", '^\s+|\s+$', '', 'g') AS t FROM claude_session_minimal)
""")
def times_without_zone(spark, d):
    return table(spark, d, "claude_session_minimal").select("uuid", parse_time(F.col("timestamp"), drop_zone=True).alias("ts"))


@register(f"""
    SELECT id, array_to_string(list_transform(regexp_extract_all(raw_attributes, '{T.UUID}'), lambda x: lower(x)), ',') AS uuids, array_to_string(regexp_extract_all(input_value, '\\b([A-Z][A-Z0-9]+-\\d+)\\b', 1), ',') AS tickets,
           CASE lower(regexp_extract(input_value, '\\.(\\w+)\\.?$', 1)) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'jsx' THEN 'javascript' WHEN 'json' THEN 'json' WHEN 'md' THEN 'markdown' WHEN 'sh' THEN 'bash'
               WHEN 'yaml' THEN 'yaml' WHEN 'yml' THEN 'yaml' WHEN 'sql' THEN 'sql' WHEN 'rs' THEN 'rust' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'html' THEN 'html' WHEN 'css' THEN 'css' WHEN 'rb' THEN 'ruby' ELSE 'text' END AS language FROM spans
""")
def names_in_texts(spark, d):
    """UUIDs and tickets of a span, and the language of the file that its input ends with."""
    path = F.regexp_replace("input_value", r"\.$", "")
    return _spans(spark, d).select("id", F.array_join(T.uuids(F.col("raw_attributes")), ",").alias("uuids"), F.array_join(T.tickets(F.col("input_value")), ",").alias("tickets"), T.language_hint(path).alias("language"))


@register(f"WITH i AS (SELECT id, coalesce({S.identity('session')}, trace_id, nullif(regexp_extract(input_value, 'session_([a-zA-Z0-9_-]+)', 1), '')) AS s FROM ({S.META})) SELECT id FROM i WHERE s = (SELECT min(s) FROM i)")
def spans_of_identified_session(spark, d):
    """The spans of the first session by name, whose session is read from their attributes."""
    s = I.with_identities(_spans(spark, d).select("id", "trace_id", "input_value", "raw_attributes"))
    first = s.agg(F.min("found_session").alias("found_session"))
    return s.join(F.broadcast(first), "found_session").select("id")  # one row
