"""Transcript lines to events, and the pairing of tool calls with their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.functions import text as T
from tracequarry.functions.times import parse_time
from tracequarry.session import written

_BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string>>"


def lines(df: DataFrame) -> DataFrame:
    """(session_id, uuid, type, subtype, ts, text, blocks, cwd, branch, compact): a row for each distinct line, in the order of its time.

    Repeated (sessionId, uuid) count once, at their earliest readable time. Rows with null sessionId are left out; a time that cannot be read is null and sorts last.
    """
    c = F.col("message.content")
    is_array = F.schema_of_variant(F.try_parse_json(c)).startswith("ARRAY")
    d = df.filter("sessionId IS NOT NULL").select(
        F.col("sessionId").alias("session_id"), "uuid", "type", "subtype", parse_time(F.col("timestamp")).alias("ts"), T.content_text(c).alias("text"),
        F.when(is_array, F.from_json(c, _BLOCKS)).alias("blocks"), F.col("cwd"), F.col("gitBranch").alias("branch"), F.col("compactMetadata.trigger").alias("compact"),
    )
    rest = [x for x in d.columns if x not in ("session_id", "uuid", "ts")]
    return d.groupBy("session_id", "uuid").agg(F.min("ts").alias("ts"), F.min(F.struct(*rest)).alias("r")).select("session_id", "uuid", "ts", "r.*")


def _in_time(*more: Column) -> Window:
    return Window.partitionBy("session_id").orderBy(F.col("ts").asc_nulls_last(), *more, "uuid")


def tool_calls(ls: DataFrame) -> DataFrame:
    """(session_id, tool_id, name, input, uuid, ts): every tool call block."""
    b = ls.filter("type = 'assistant'").select("session_id", "uuid", "ts", F.explode("blocks").alias("b")).filter("b.type = 'tool_use'")
    return b.select("session_id", F.col("b.id").alias("tool_id"), F.col("b.name").alias("name"), F.col("b.input").alias("input"), "uuid", "ts")


def tool_results(ls: DataFrame) -> DataFrame:
    """(session_id, tool_id, result, uuid, ts): every tool result block, its blocks' texts joined."""
    b = ls.filter("type = 'user'").select("session_id", "uuid", "ts", F.explode("blocks").alias("b")).filter("b.type = 'tool_result'")
    return b.select("session_id", F.col("b.tool_use_id").alias("tool_id"), T.content_text(F.col("b.content")).alias("result"), "uuid", "ts")


def paired_tools(ls: DataFrame) -> DataFrame:
    """(session_id, tool_id, name, input, call_ts, result_ts, result): each call with the earliest result of its id; a call without one has nulls, results without a call are left out."""
    c = tool_calls(ls).groupBy("session_id", "tool_id").agg(F.min_by(F.struct("name", "input", "ts"), F.struct("ts", "uuid")).alias("c"))
    r = tool_results(ls).groupBy("session_id", "tool_id").agg(F.min_by(F.struct("result", "ts"), F.struct("ts", "uuid")).alias("r"))
    j = c.join(r, ["session_id", "tool_id"], "left")
    return j.select("session_id", "tool_id", F.col("c.name").alias("name"), F.col("c.input").alias("input"), F.col("c.ts").alias("call_ts"), F.col("r.ts").alias("result_ts"), F.col("r.result").alias("result"))


def paired_in_turn(ls: DataFrame) -> DataFrame:
    """(session_id, n, name, result, call_uuid, result_uuid): results without regard to ids, each with the first call before it that has none; calls of Tasks and their results are left out.

    A result that comes while no call is open takes none. So the n-th call is paired with the n-th result that is taken: of results up to some time as many are taken as there are, less the most by
    which they have run ahead of the calls so far, which is a running minimum. Windows see no texts.
    """
    call = ls.filter("type = 'assistant'").select("session_id", "uuid", "ts", F.posexplode("blocks").alias("pos", "b")).filter("b.type = 'tool_use' AND NOT b.name <=> 'Task'")
    task = tool_calls(ls).filter("name = 'Task'").select("session_id", "tool_id")
    res = ls.filter("type = 'user'").select("session_id", "uuid", "ts", F.posexplode("blocks").alias("pos", "b")).filter("b.type = 'tool_result'")
    res = res.withColumn("tool_id", F.col("b.tool_use_id")).join(task, ["session_id", "tool_id"], "left_anti")
    step = call.select("session_id", "uuid", "ts", "pos", F.lit(1).alias("c")).unionByName(res.select("session_id", "uuid", "ts", "pos", F.lit(0).alias("c")))
    so_far = Window.partitionBy("session_id").orderBy(F.col("ts").asc_nulls_last(), "uuid", "pos").rowsBetween(Window.unboundedPreceding, 0)
    step = step.withColumns({"calls": F.sum("c").over(so_far), "results": F.sum(1 - F.col("c")).over(so_far)})
    ahead = F.least(F.min(F.when(F.col("c") == 0, F.col("calls") - F.col("results"))).over(so_far), F.lit(0))
    step = step.withColumn("taken", F.col("results") + F.coalesce(ahead, F.lit(0)))
    step = step.withColumn("before", F.coalesce(F.lag("taken").over(Window.partitionBy("session_id").orderBy(F.col("ts").asc_nulls_last(), "uuid", "pos")), F.lit(0)))
    c = step.filter("c = 1").select("session_id", "uuid", "pos", F.col("calls").alias("n")).join(call, ["session_id", "uuid", "pos"]).select("session_id", "n", F.col("b.name").alias("name"), F.col("uuid").alias("call_uuid"))
    r = step.filter("c = 0 AND taken > before").select("session_id", "uuid", "pos", F.col("taken").alias("n")).join(res, ["session_id", "uuid", "pos"])
    r = r.select("session_id", "n", T.content_text(F.col("b.content")).alias("result"), F.col("uuid").alias("result_uuid"))
    return c.join(r, ["session_id", "n"]).select("session_id", "n", "name", "result", "call_uuid", "result_uuid")


def parallel_calls(ls: DataFrame) -> DataFrame:
    """(session_id, uuid, ts, calls, tools, answered): the messages that make several calls at once, their tools in order and how many of the calls have a result by their id."""
    b = ls.filter("type = 'assistant'").select("session_id", "uuid", "ts", F.filter("blocks", lambda x: x["type"] == "tool_use").alias("b")).filter(F.size("b") > 1)
    done = tool_results(ls).select("session_id", "tool_id").distinct().withColumn("done", F.lit(1))
    one = b.select("session_id", "uuid", F.explode("b.id").alias("tool_id")).join(done, ["session_id", "tool_id"], "left").groupBy("session_id", "uuid").agg(F.count("done").alias("answered"))
    return b.join(one, ["session_id", "uuid"]).select("session_id", "uuid", "ts", F.size("b").alias("calls"), F.array_join("b.name", ",").alias("tools"), "answered")


def events(ls: DataFrame) -> DataFrame:
    """(session_id, event_id, order_idx, ts, event_type, text, tool_name): the events of transcripts, in order.

    user and assistant events have text; a tool event stands at its result and takes its call's name, subagent if it is a Task; a compaction boundary takes the next line's text if that is
    the user's, which then gives no event of its own. Event ids are hashes of session, line and block, so a second run gives the same. Windows see no texts: these are joined afterwards.
    """
    w = _in_time()
    boundary = F.coalesce((F.col("type") == "system") & (F.col("subtype") == "compact_boundary"), F.lit(False))
    n = ls.select("session_id", "uuid", "ts", "type", boundary.alias("b"))
    n = n.withColumns({"next_type": F.lead("type").over(w), "next_uuid": F.lead("uuid").over(w), "eaten": F.coalesce(F.lag("b").over(w) & (F.col("type") == "user"), F.lit(False))})
    place = n.filter(F.col("b") | F.col("type").isin("user", "assistant") & ~F.col("eaten"))
    says = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    none = F.lit(None).cast("string")
    text = ls.select("session_id", "uuid", "text")
    talk = place.filter("NOT b").select("session_id", "uuid", "ts", "type").join(text, ["session_id", "uuid"]).filter(says).select("session_id", "uuid", "ts", F.col("type").alias("event_type"), "text", none.alias("tool_name"), F.lit("").alias("part"))
    told = text.select("session_id", F.col("uuid").alias("next_uuid"), "text")
    compact = place.filter("b").join(told, ["session_id", "next_uuid"], "left").select("session_id", "uuid", "ts", F.lit("compaction").alias("event_type"), F.when(F.col("next_type") == "user", F.col("text")).alias("text"), none.alias("tool_name"), F.lit("").alias("part"))
    calls = tool_calls(ls).groupBy("session_id", "tool_id").agg(F.min("name").alias("name"))
    first = tool_results(ls).groupBy("session_id", "tool_id").agg(F.min_by(F.struct("result", "ts", "uuid"), F.struct("ts", "uuid")).alias("r"))
    tools = first.join(calls, ["session_id", "tool_id"]).select("session_id", F.col("r.uuid").alias("uuid"), F.col("r.ts").alias("ts"), F.when(F.col("name") == "Task", "subagent").otherwise("tool").alias("event_type"), F.col("r.result").alias("text"), F.col("name").alias("tool_name"), F.col("tool_id").alias("part"))
    rank = F.expr("CASE event_type WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 WHEN 'tool' THEN 2 WHEN 'subagent' THEN 3 ELSE 4 END")
    u = written(talk.unionByName(compact).unionByName(tools), "transcript-events")
    order = Window.partitionBy("session_id").orderBy(F.col("ts").asc_nulls_last(), rank, "uuid", "part")
    key = ["session_id", "uuid", "event_type", "part"]
    at = u.select(*key, "ts").withColumn("order_idx", F.row_number().over(order) - 1).drop("ts")
    out = u.alias("u").join(at.alias("a"), [F.col(f"u.{c}").eqNullSafe(F.col(f"a.{c}")) for c in key]).select("u.*", "a.order_idx")
    return out.select("session_id", F.sha2(F.concat_ws("|", "session_id", "uuid", "event_type", "part"), 256).alias("event_id"), "order_idx", "ts", "event_type", "text", "tool_name")


def summary(ls: DataFrame) -> DataFrame:
    """(session_id, lines, user_lines, first_ts, last_ts, cwd, branch, first_prompt, tickets): what a transcript is about."""
    at = F.struct(F.col("ts").isNull(), "ts", "uuid")
    ask = F.when((F.col("type") == "user") & T.is_human_turn(F.col("text")), F.col("text"))
    found = ls.select("session_id", F.explode(T.tickets(F.coalesce("text", F.lit("")))).alias("ticket")).distinct().groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list("ticket")), ",").alias("tickets"))
    facts = ls.groupBy("session_id").agg(
        F.count("*").alias("lines"), F.count_if(F.col("type") == "user").alias("user_lines"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), at)).alias("cwd"), F.min_by("branch", F.when(F.col("branch").isNotNull(), at)).alias("branch"),
        F.min_by(ask, F.when(ask.isNotNull(), at)).alias("first_prompt"),
    )
    return facts.join(found, "session_id", "left").withColumn("tickets", F.coalesce("tickets", F.lit("")))


def top_tools(ls: DataFrame, n: int = 8) -> DataFrame:
    """(session_id, tools): a session's n most used tools with their counts, as text name=count."""
    c = tool_calls(ls).groupBy("session_id", "name").agg(F.count("*").alias("k"))
    w = Window.partitionBy("session_id").orderBy(F.desc("k"), "name")
    top = c.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    parts = F.array_sort(F.collect_list(F.struct("r", F.concat_ws("=", "name", F.col("k").cast("string")).alias("t"))))
    return top.groupBy("session_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), ",").alias("tools"))


def markdown(ev: DataFrame, *, limit: int = 2000) -> DataFrame:
    """(session_id, order_idx, block, full_result): an event as a piece of Markdown; pieces of a session in order make its document.

    Texts of users, assistants and compactions are whole. A tool's result stands in its piece with its first `limit` characters; where that shortens it, full_result has all of it, else null.
    """
    head = F.initcap("event_type")
    tool = F.col("event_type").isin("tool", "subagent")
    title = F.when(F.col("tool_name").isNotNull(), F.concat(F.lit("### "), head, F.lit(": `"), F.col("tool_name"), F.lit("`"))).otherwise(F.concat(F.lit("## "), head))
    whole = T.strip(T.strip_reminders(F.coalesce("text", F.lit(""))))
    body = F.when(tool, T.truncate(whole, limit)).otherwise(whole)
    body = F.when(F.col("tool_name").isNotNull(), F.concat(F.lit("```\n"), body, F.lit("\n```"))).otherwise(body)
    full = F.when(tool & (F.length(whole) > limit), F.col("text"))
    return ev.select("session_id", "order_idx", F.concat(title, F.lit("\n\n"), body, F.lit("\n")).alias("block"), full.alias("full_result"))
