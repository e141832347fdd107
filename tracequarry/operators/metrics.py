"""Aggregates over spans: sessions, tools, failures, files, tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.functions import classify as C
from tracequarry.functions import text as T
from tracequarry.functions.times import duration_ms


def with_category(spans: DataFrame) -> DataFrame:
    return spans.withColumn("_c", C.span_category()).withColumn("category", F.col("_c.category")).withColumn("confidence", F.col("_c.confidence")).drop("_c")


def category_counts(spans: DataFrame) -> DataFrame:
    """(category, spans): all categories, also those without spans."""
    spark = spans.sparkSession
    every = spark.createDataFrame([(c,) for c in C.CATEGORIES], "category string")
    n = with_category(spans).groupBy("category").agg(F.count("*").alias("n"))
    return every.join(n, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("spans"))


def session_metrics(spans: DataFrame) -> DataFrame:
    """One row for each session: turns, tools, failures, calls by model class, tokens, first and last activity over starts and ends."""
    tok = lambda c: F.coalesce(F.sum(c), F.lit(0))
    s = with_category(spans.filter("session_id IS NOT NULL"))
    m = s.groupBy("session_id").agg(
        F.count("*").alias("span_count"),
        F.count_if(C.is_user_turn(F.col("category"), F.col("name"))).alias("turn_count"),
        F.count_if(F.col("category") == "tools").alias("tool_call_count"),
        F.count_if(C.is_failure(F.col("status_code"))).alias("failure_count"),
        F.count_if(F.col("category") == "main").alias("main_model_calls"),
        F.count_if(F.col("category") == "haiku_holdover").alias("haiku_calls"),
        tok("llm_token_count_prompt").alias("prompt_tokens"),
        tok("llm_token_count_completion").alias("completion_tokens"),
        tok("llm_token_count_total").alias("_total"),
        F.least(F.min("start_time"), F.min("end_time")).alias("first_activity"),
        F.greatest(F.max("start_time"), F.max("end_time")).alias("last_activity"),
    )
    total = F.when(F.col("_total") == 0, F.col("prompt_tokens") + F.col("completion_tokens")).otherwise(F.col("_total"))
    seconds = F.coalesce((F.unix_micros("last_activity") - F.unix_micros("first_activity")) / 1e6, F.lit(0.0))
    return m.withColumn("total_tokens", total).withColumn("duration_seconds", seconds).drop("_total")


def all_sessions(metrics: DataFrame) -> DataFrame:
    """One row over session_metrics(): sums and averages; zeros for an empty table."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}")
    mean = lambda c: F.coalesce(F.round(F.avg(c), 2), F.lit(0.0)).alias(f"avg_{c}")
    return metrics.agg(F.count("*").alias("sessions"), *(total(c) for c in ("span_count", "turn_count", "tool_call_count", "failure_count", "total_tokens")), *(mean(c) for c in ("turn_count", "tool_call_count", "total_tokens")))


def session_rows(spans: DataFrame) -> DataFrame:
    """The session row of exports: counts, token sums, distinct models as text in order, whether any status is ERROR."""
    models = F.array_join(F.array_sort(F.collect_set("llm_model_name")), ",")  # as many as there are models
    return spans.filter("session_id IS NOT NULL").groupBy("session_id").agg(
        F.count("*").alias("span_count"), F.min("start_time").alias("first_span_time"), F.max("start_time").alias("last_span_time"),
        F.coalesce(F.sum("llm_token_count_prompt"), F.lit(0)).alias("total_prompt_tokens"), F.coalesce(F.sum("llm_token_count_completion"), F.lit(0)).alias("total_completion_tokens"),
        F.coalesce(F.sum("llm_token_count_total"), F.lit(0)).alias("total_tokens"), models.alias("models_used"), F.coalesce(F.bool_or(F.col("status_code") == "ERROR"), F.lit(False)).alias("has_errors"),
    )


def tool_stats(spans: DataFrame) -> DataFrame:
    """(tool, calls, successes, failures, success_rate, timed_calls, total_ms, avg_ms): tool spans by tool; success is OK, SUCCESS or no status."""
    s = with_category(spans).filter("category = 'tools'")
    ok, ms = C.is_success(F.col("status_code")), duration_ms(F.col("start_time"), F.col("end_time"))
    g = s.groupBy(C.tool_name(F.col("name")).alias("tool")).agg(
        F.count("*").alias("calls"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), F.count(ms).alias("timed_calls"),
        F.round(F.coalesce(F.sum(ms), F.lit(0.0)), 3).alias("total_ms"), F.round(F.avg(ms), 3).alias("avg_ms"),
    )
    return g.withColumn("success_rate", F.round(F.col("successes") / F.col("calls"), 4))


def top_tools(stats: DataFrame, n: int = 10) -> DataFrame:
    return stats.orderBy(F.desc("calls"), "tool").limit(n)


def slowest_tools(stats: DataFrame, n: int = 10) -> DataFrame:
    return stats.filter("avg_ms IS NOT NULL").orderBy(F.desc("avg_ms"), "tool").limit(n)


def before_in_session(spans: DataFrame, around: int, *, chunk: int = 100_000) -> DataFrame:
    """(id, session_id, own facts..., earlier): each span with what the `around` spans before it in its session were, the last one last.

    What a span was is its id, name, category and digests of its texts, so no text is sorted. Sessions are cut by ranges of arrival (id): within (session, range) a window finds the
    spans before; the first `around` of a range also look at the last ones of the ranges before, of which only so many rows meet in a window by session. A session that holds a third of all spans,
    or those without a session, which are one group, are spread over their ranges.
    """
    digest = lambda c: F.when(F.col(c) != "", F.md5(c))
    s = with_category(spans).select("id", F.coalesce("session_id", F.lit("\0")).alias("s"), "name", "category", digest("input_value").alias("text"), digest("raw_attributes").alias("attrs"), C.failure_type(F.col("status_code"), F.col("name"), F.col("status_message") if "status_message" in spans.columns else None).alias("failure"))
    s = s.withColumn("c", F.floor(F.col("id") / F.lit(chunk))).withColumn("me", F.struct("id", "name", "category", "text", "attrs"))
    w = Window.partitionBy("s", "c").orderBy("id")
    s = s.withColumns({"r": F.row_number().over(w), "earlier": F.collect_list("me").over(w.rowsBetween(-around, -1))})
    ends = s.withColumn("from_end", F.row_number().over(Window.partitionBy("s", "c").orderBy(F.desc("id")))).filter(F.col("from_end") <= around)
    ends = ends.groupBy("s", "c").agg(F.array_sort(F.collect_list("me")).alias("tail"))  # at most `around` spans
    # the tails of as many ranges before as can be needed, each of which has at least one span
    over = Window.partitionBy("s").orderBy("c").rowsBetween(-around, -1)
    ends = ends.select("s", "c", F.flatten(F.collect_list("tail").over(over)).alias("tails"))
    first = s.filter(F.col("r") <= around).join(ends, ["s", "c"]).withColumn("earlier", F.concat("tails", "earlier")).drop("tails")
    first = first.withColumn("earlier", F.slice("earlier", F.greatest(F.size("earlier") - around + 1, F.lit(1)), around))
    out = s.filter(F.col("r") > around).unionByName(first)
    return out.select("id", F.when(F.col("s") != "\0", F.col("s")).alias("session_id"), "name", "category", "text", "attrs", "failure", "earlier")


def failures(spans: DataFrame, *, around: int = 3) -> DataFrame:
    """(id, session_id, failure, context): a row for each failure, with the ids of up to `around` spans before it in its session; spans without session are one session.

    A span fails by its status, its name or, where there is one, its status_message; it repeats the span before it, back_to_back, if it has its name and the same text, or its category and the same
    attributes. It may fail and repeat at once.
    """
    s = before_in_session(spans, around).withColumn("last", F.get("earlier", F.size("earlier") - 1))
    same = F.col("last").isNotNull() & F.col("name").eqNullSafe(F.col("last.name"))
    text = F.coalesce(F.col("text") == F.col("last.text"), F.lit(False))
    attrs = F.coalesce((F.col("attrs") == F.col("last.attrs")) & (F.col("category") == F.col("last.category")), F.lit(False))
    kinds = F.array_compact(F.array(F.col("failure"), F.when(same & (text | attrs), F.lit("back_to_back"))))
    return s.select("id", "session_id", F.explode(kinds).alias("failure"), F.array_join(F.transform("earlier", lambda x: x["id"].cast("string")), ",").alias("context"))


def failure_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("failure").agg(F.count("*").alias("n"))


def churn(spans: DataFrame, *, many: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """(by..., file, edits, writes, operations, multi_edit, write_then_edit): work on files; multi_edit from `many` edits on, write_then_edit if an edit directly follows a write of the file."""
    op = C.file_operation(F.col("name"))
    path = T.file_path(F.col("raw_attributes"), F.col("input_value"))
    s = spans.select("id", *by, op.alias("op"), path.alias("file")).filter("op IS NOT NULL AND file IS NOT NULL")
    w = Window.partitionBy(*by, "file").orderBy("id")
    s = s.withColumn("_next", F.lead("op").over(w))
    g = s.groupBy(*by, "file").agg(F.count_if(F.col("op") == "edit").alias("edits"), F.count_if(F.col("op") == "write").alias("writes"), F.count("*").alias("operations"), F.coalesce(F.bool_or((F.col("op") == "write") & (F.col("_next") == "edit")), F.lit(False)).alias("write_then_edit"))
    return g.withColumn("multi_edit", F.col("edits") >= many)


def churn_summary(files: DataFrame) -> DataFrame:
    """One row over churn(): files, edits, writes, and edits a file (0 without files)."""
    g = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("edits"), F.lit(0)).alias("edits"), F.coalesce(F.sum("writes"), F.lit(0)).alias("writes"))
    return g.withColumn("churn_ratio", F.when(F.col("files") > 0, F.round(F.col("edits") / F.col("files"), 4)).otherwise(0.0))


_MESSAGES = "array<map<string,string>>"


def token_breakdown(spans: DataFrame) -> DataFrame:
    """(id, session_id, system, user, model, tool tokens): prompt tokens shared out by the characters of each role in input_messages; what rounding leaves goes to the user."""
    s = with_category(spans)
    prompt, completion = (F.coalesce(F.col(f"llm_token_count_{c}"), F.lit(0)) for c in ("prompt", "completion"))
    msgs = F.from_json("input_messages", _MESSAGES)
    role = lambda m: F.lower(F.coalesce(F.nullif(F.try_element_at(m, F.lit("message.role")), F.lit("")), F.try_element_at(m, F.lit("role")), F.lit("")))
    size = lambda m: F.length(F.coalesce(F.nullif(F.try_element_at(m, F.lit("message.content")), F.lit("")), F.try_element_at(m, F.lit("content")), F.lit("")))
    chars = lambda *roles: F.aggregate(F.coalesce(msgs, F.expr("CAST(array() AS array<map<string,string>>)")), F.lit(0).cast("long"), lambda a, m: a + F.when(role(m).isin(*roles), size(m)).otherwise(0))
    all_chars = F.aggregate(F.coalesce(msgs, F.expr("CAST(array() AS array<map<string,string>>)")), F.lit(0).cast("long"), lambda a, m: a + size(m))
    s = s.withColumns({"_p": prompt, "_o": completion, "_sys": chars("system"), "_tool": chars("tool", "function"), "_all": all_chars, "_n": F.coalesce(F.size(msgs), F.lit(0))})
    llm, hinted = F.col("category").isin("main", "haiku_holdover"), F.lower(F.substring(F.coalesce("input_value", F.lit("")), 1, 500)).contains("system")
    part = lambda c: F.when((F.col("_all") > 0) & (F.col("_p") > 0), F.floor(F.col("_p") * F.col(c) / F.col("_all"))).otherwise(0)
    talks = llm & (F.col("_n") > 0)
    system = F.when(talks, part("_sys")).when(llm & hinted, F.col("_p")).when(F.col("category") == "internal", F.col("_p")).otherwise(0)
    tool = F.when(F.col("category") == "tools", F.col("_p") + F.col("_o")).when(talks, part("_tool")).otherwise(0)
    model = F.when(F.col("category") == "tools", 0).otherwise(F.col("_o"))
    s = s.withColumns({"system_tokens": system.cast("long"), "tool_tokens": tool.cast("long"), "model_tokens": model.cast("long")})
    user = F.when(F.col("category") == "tools", 0).when(F.col("category") == "internal", 0).otherwise(F.col("_p") - F.col("system_tokens") - F.col("tool_tokens"))
    raw = F.when(F.col("llm_token_count_total") > 0, F.col("llm_token_count_total")).otherwise(F.col("_p") + F.col("_o"))
    return s.select("id", "session_id", "category", "system_tokens", user.cast("long").alias("user_tokens"), "model_tokens", "tool_tokens", F.col("_p").alias("raw_input_tokens"), F.col("_o").alias("raw_output_tokens"), raw.alias("raw_total_tokens"))


def session_tokens(breakdown: DataFrame) -> DataFrame:
    """(session_id, tokens of each kind, raw tokens, tool_spans, llm_spans, internal_spans) over token_breakdown()."""
    cols = ("system_tokens", "user_tokens", "model_tokens", "tool_tokens", "raw_input_tokens", "raw_output_tokens", "raw_total_tokens")
    kinds = {"tool_spans": ("tools",), "llm_spans": ("main", "haiku_holdover"), "internal_spans": ("internal",)}
    return breakdown.filter("session_id IS NOT NULL").groupBy("session_id").agg(*(F.sum(c).alias(c) for c in cols), *(F.count_if(F.col("category").isin(*k)).alias(c) for c, k in kinds.items()))


def cost(prompt: Column, completion: Column, per_million_in: float = 3.0, per_million_out: float = 15.0) -> Column:
    return F.round(prompt / 1e6 * per_million_in + completion / 1e6 * per_million_out, 6)


def skills(spans: DataFrame) -> DataFrame:
    """(skill, calls, successes): the calls of the Skill tool by skill; those that name none are left out."""
    inner = F.get_json_object(F.col("raw_attributes"), "$.attributes.input.value")
    name = F.nullif(F.get_json_object(inner, "$.input.skill"), F.lit(""))
    s = spans.filter("name = 'Claude_Code_Tool_Skill'").select(name.alias("skill"), C.is_success(F.col("status_code")).alias("ok")).filter("skill IS NOT NULL")
    return s.groupBy("skill").agg(F.count("*").alias("calls"), F.count_if("ok").alias("successes"))


# What may be suggested, and how pressing it is.
SEVERITY = {"errors": "high", "repeated_operations": "medium", "rate_limits": "high", "edit_churn": "medium", "write_then_edit": "low", "many_tokens": "medium"}


def suggestions(spans: DataFrame, *, many_tokens: int = 100_000) -> DataFrame:
    """(session_id, suggestion, severity, n): rules of thumb over a session's failures, repeats, work on files and tokens; n is what they count."""
    s = spans.filter("session_id IS NOT NULL")
    names = {"error": "errors", "back_to_back": "repeated_operations", "rate_limit": "rate_limits"}
    f = failures(s).filter(F.col("failure").isin(*names)).groupBy("session_id", F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("failure")].alias("suggestion")).agg(F.count("*").alias("n"))
    files = churn(s, by=["session_id"]).groupBy("session_id").agg(F.count_if("multi_edit").alias("edit_churn"), F.count_if("write_then_edit").alias("write_then_edit"))
    c = files.unpivot("session_id", ["edit_churn", "write_then_edit"], "suggestion", "n").filter("n > 0")
    t = session_metrics(s).filter(F.col("total_tokens") > many_tokens).select("session_id", F.lit("many_tokens").alias("suggestion"), F.col("total_tokens").alias("n"))
    severity = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    return f.unionByName(c).unionByName(t).select("session_id", "suggestion", severity[F.col("suggestion")].alias("severity"), "n")
