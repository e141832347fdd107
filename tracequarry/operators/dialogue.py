"""Conversations across sessions: chains, turns, events and the messages that requests carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.functions import classify as C
from tracequarry.functions import text as T
from tracequarry.functions.literals import as_json
from tracequarry.operators import hierarchy, links
from tracequarry.session import written

PROMPT = "Claude_Code_Internal_Prompt_"
TASK = "Claude_Code_Tool_Task"
# Beginnings of texts in a user's place that no user wrote.
NOT_SAID = ("<system", "Files modified by", "Explore the ~/", "Search for and read")
SUMMARY = "The conversation is summarized below:"
_BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"


def _is_array(j: Column) -> Column:
    return F.schema_of_variant(F.try_parse_json(j)).startswith("ARRAY")


def blocks(value: Column) -> Column:
    """A message's content as blocks: of a JSON array or Python literal its text, tool_use and tool_result blocks, of other text one text block, of nothing none."""
    plain = F.from_json(F.to_json(F.array(F.struct(F.lit("text").alias("type"), value.alias("text")))), _BLOCKS)
    listed = T.once(as_json(F.when(value.rlike(r"^\s*\["), value)), lambda j: F.filter(F.from_json(F.when(_is_array(j), j), _BLOCKS), lambda b: b["type"].isin("text", "tool_use", "tool_result")))
    return F.coalesce(listed, F.when(value.rlike(r"\S"), plain))


# Chains


def _session_facts(spans: DataFrame) -> DataFrame:
    """(session_id, uuid, user_hash, a, b, n, t, k) of each session; uuid and user_hash from the older identity text of its first span that has one."""
    u, who = F.regexp_extract("raw_attributes", rf"session_({T.UUID})", 1), F.regexp_extract("raw_attributes", r"user_([a-zA-Z0-9]+)_account", 1)
    first = lambda c: F.min_by(c, F.when(c != "", F.col("id")))
    return spans.filter("session_id IS NOT NULL").groupBy("session_id").agg(
        F.nullif(first(u), F.lit("")).alias("uuid"), F.nullif(first(who), F.lit("")).alias("user_hash"), F.min("start_time").alias("a"), F.max("end_time").alias("b"), F.count("*").alias("n"),
        F.coalesce(F.sum("llm_token_count_total"), F.lit(0)).alias("t"), F.count_if(F.coalesce(F.col("input_value").contains(C.COMPACTION_TASK), F.lit(False))).alias("k"),
    )


def chain_members(spans: DataFrame, *, max_gap_s: int = 60) -> DataFrame:
    """(chain_id, claude_session_id, session_index, session_id, linked): the sessions of each chain in order.

    Sessions that name the same conversation are a chain. Of the others those are chained that go on, by the marker of a compacted session, where the one that starts directly before
    them ended at most max_gap_s before; sessions with no such link are in no chain. chain_id is the first session.
    """
    s = _session_facts(spans)
    order = Window.partitionBy("uuid").orderBy(F.col("a").asc_nulls_first(), "session_id")
    named = s.filter("uuid IS NOT NULL").withColumn("i", F.row_number().over(order) - 1)
    heads = named.filter("i = 0").select("uuid", F.col("session_id").alias("chain_id"))
    named = named.join(heads, "uuid").select("chain_id", F.col("uuid").alias("claude_session_id"), F.col("i").alias("session_index"), "session_id", F.lit(False).alias("linked"))
    rest = spans.join(s.filter("uuid IS NULL").select("session_id"), "session_id", "left_semi")
    link = links.continuation_links(rest, max_gap_s=max_gap_s).select("session_id", "previous_id")
    nodes = link.unionByName(link.select(F.col("previous_id").alias("session_id"), F.lit(None).cast("string").alias("previous_id")))
    h = hierarchy.hierarchy(nodes.select(F.lit("sessions").alias("trace_id"), F.col("session_id").alias("span_id"), F.col("previous_id").alias("parent_id")))
    gone_on = h.select(F.col("root_id").alias("chain_id"), F.lit(None).cast("string").alias("claude_session_id"), F.col("depth").alias("session_index"), F.col("span_id").alias("session_id"), (F.col("depth") > 0).alias("linked"))
    return named.unionByName(gone_on)


def chains(spans: DataFrame, *, max_gap_s: int = 60) -> DataFrame:
    """(chain_id, claude_session_id, user_hash, session_ids, sessions, spans, tokens, compactions, start_time, end_time): a row for each chain; compactions are summarising tasks, or links where sessions are linked by time."""
    j = chain_members(spans, max_gap_s=max_gap_s).join(_session_facts(spans), "session_id")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("session_index", "session_id"))), lambda x: x["session_id"]), ",")  # the sessions of one conversation
    return j.groupBy("chain_id").agg(
        F.max("claude_session_id").alias("claude_session_id"), F.min_by("user_hash", F.when(F.col("claude_session_id").isNotNull() & F.col("user_hash").isNotNull(), F.col("session_index"))).alias("user_hash"), ids.alias("session_ids"),
        F.count("*").alias("sessions"), F.sum("n").alias("spans"), F.sum("t").alias("tokens"), F.sum(F.when(F.col("claude_session_id").isNull(), F.col("linked").cast("long")).otherwise(F.col("k"))).alias("compactions"),
        F.min("a").alias("start_time"), F.max("b").alias("end_time"),
    )


def chain_summary(found: DataFrame) -> DataFrame:
    """One row over chains(): their number, sessions, mean and greatest length, compactions; zeros without chains."""
    return found.agg(
        F.count("*").alias("chains"), F.coalesce(F.sum("sessions"), F.lit(0)).alias("sessions"), F.coalesce(F.round(F.avg("sessions"), 2), F.lit(0.0)).alias("avg_length"),
        F.coalesce(F.max("sessions"), F.lit(0)).alias("max_length"), F.coalesce(F.sum("compactions"), F.lit(0)).alias("compactions"),
    )


def longest_first(found: DataFrame, min_sessions: int = 1) -> DataFrame:
    return found.filter(F.col("sessions") >= min_sessions).orderBy(F.desc("sessions"), "chain_id")


# Turns


def turns(spans: DataFrame, members: DataFrame, *, ancillary: bool = False) -> DataFrame:
    """(chain_id, turn_index, session_id, session_index, turn_suffix, id, span_id, parent_id, thread_type, reason, confidence, is_compaction, subagents, tool_use_id, linked_turn_index, model, tokens_prompt, tokens_completion, input, output): a row for each turn of a chain.

    A turn is a prompt span with its answer, the last of its session with this number; numbers order them within a session, others count as 0. Summarising tasks and continuations are
    no turns. A side request's turn is listed only with `ancillary`; it is linked to the last turn up to it that made the tool call whose result it brings. subagents are the Task calls of the answer.
    """
    p = spans.filter(F.col("name").startswith(PROMPT)).join(members.select("chain_id", "session_index", "session_id"), "session_id")
    suffix = F.substring("name", len(PROMPT) + 1, 1000)
    at = F.struct(F.col("start_time").isNotNull(), "start_time", "id")
    p = p.select("chain_id", "session_index", "session_id", "id", suffix.alias("turn_suffix"), at.alias("at"))
    last = p.groupBy("chain_id", "session_index", "session_id", "turn_suffix").agg(F.max_by("id", "at").alias("id"), F.min("at").alias("first_at"))
    t = spans.select("id", "span_id", "parent_id", "name", C.model_text().alias("model"), "llm_token_count_prompt", "llm_token_count_completion", C.input_text().alias("input_value"), C.output_text().alias("output_value"))
    t = last.join(t, "id").filter(~F.col("input_value").contains(C.COMPACTION_CONTINUED) & ~F.col("input_value").contains(C.COMPACTION_TASK))
    t = written(t, "turns")
    t = t.withColumns({"th": C.thread(), "is_compaction": C.compaction(F.col("input_value"), F.col("name")).isNotNull(), "out": blocks(F.col("output_value"))})
    t = t.withColumn("result_of", F.get(F.filter(blocks(F.col("input_value")), lambda b: b["type"] == "tool_result"), F.lit(0))["tool_use_id"])
    if not ancillary:
        t = t.filter(F.col("th.type") != "ancillary")
    t = written(t, "turns")
    number = F.coalesce(F.when(F.col("turn_suffix").rlike(r"^\d+$"), F.col("turn_suffix").try_cast("long")), F.lit(0))
    order = Window.partitionBy("chain_id").orderBy("session_index", number, "first_at")
    place = t.select("id", "chain_id", "session_index", "turn_suffix", "first_at").withColumn("turn_index", F.row_number().over(order) - 1).select("id", "chain_id", "turn_index")
    t = t.join(place, ["id", "chain_id"])
    calls = t.select("chain_id", "turn_index", F.explode("out").alias("b")).filter("b.type = 'tool_use' AND b.id <> ''").select("chain_id", F.col("b.id").alias("result_of"), F.col("turn_index").alias("made_at"))
    asked = t.filter(F.col("th.type") == "ancillary").select("id", "chain_id", "turn_index", "result_of")
    link = asked.join(calls, ["chain_id", "result_of"]).filter("made_at <= turn_index").groupBy("id", "chain_id").agg(F.max("made_at").alias("linked_turn_index"))
    t = t.join(link, ["id", "chain_id"], "left")
    agents = F.transform(F.filter("out", lambda b: (b["type"] == "tool_use") & (b["name"] == "Task")), lambda b: F.concat_ws(":", b["id"], F.coalesce(F.get_json_object(b["input"], "$.subagent_type"), F.lit("unknown"))))
    return t.select(
        "chain_id", "turn_index", "session_id", "session_index", "turn_suffix", "id", "span_id", "parent_id", F.col("th.type").alias("thread_type"), F.col("th.reason").alias("reason"), F.col("th.confidence").alias("confidence"), "is_compaction",
        F.coalesce(F.array_join(agents, ","), F.lit("")).alias("subagents"), F.when(F.col("th.type") == "ancillary", F.col("result_of")).alias("tool_use_id"), "linked_turn_index", "model",
        F.col("llm_token_count_prompt").alias("tokens_prompt"), F.col("llm_token_count_completion").alias("tokens_completion"), F.col("input_value").alias("input"), F.col("output_value").alias("output"),
    )


def turn_metrics(every: DataFrame) -> DataFrame:
    """(chain_id, turns, main_thread_turns, ancillary_turns, subagent_turns, models, prompt_tokens, completion_tokens) over turns(ancillary=True); models as text name=count."""
    kinds = {"main_thread": "main_thread_turns", "ancillary": "ancillary_turns", "sub_agent": "subagent_turns"}
    n = every.groupBy("chain_id").agg(
        F.count("*").alias("turns"), *(F.count_if(F.col("thread_type") == k).alias(v) for k, v in kinds.items()),
        F.coalesce(F.sum("tokens_prompt"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("tokens_completion"), F.lit(0)).alias("completion_tokens"),
    )
    m = every.filter("model <> ''").groupBy("chain_id", "model").agg(F.count("*").alias("k"))
    m = m.groupBy("chain_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("model", "k"))), lambda x: F.concat_ws("=", x["model"], x["k"].cast("string"))), ",").alias("models"))  # as many as there are models
    return n.join(m, "chain_id", "left").withColumn("models", F.coalesce("models", F.lit("")))


# Messages that requests carry


def _items(value: Column) -> Column:
    """A JSON array's items as JSON texts; an array inside a string is read too."""
    return T.once(as_json(value), lambda j: F.from_json(F.when(_is_array(j), j), "array<string>"))


_MESSAGES = "array<struct<role:string,content:string>>"


def messages(field: str) -> Column:
    """The messages (role, content) that a span's attributes hold as llm.<field>, in the dotted or the nested layout; items without a role are left out, content that isn't text stays JSON."""
    raw = T.valid_json(F.col("raw_attributes"))
    return _messages(T.once(raw, lambda r: F.coalesce(F.nullif(F.get_json_object(r, f"$['llm.{field}']"), F.lit("[]")), F.get_json_object(r, f"$.attributes.llm.{field}"))))


def _messages(value: Column) -> Column:
    own = F.transform(_items(value), lambda i: F.coalesce(F.get_json_object(i, "$.message"), i))
    got = F.transform(own, lambda i: F.struct(F.get_json_object(i, "$.role").alias("role"), F.coalesce(F.get_json_object(i, "$.content"), F.lit("")).alias("content")))
    return F.coalesce(F.filter(got, lambda m: m["role"].isNotNull()), F.from_json(F.lit("[]"), _MESSAGES))


def cumulative_messages() -> Column:
    """The whole conversation up to a request, as its attributes hold it under the model key None: JSON or a Python literal."""
    return _messages(F.get_json_object(T.valid_json(F.col("raw_attributes")), "$.attributes.llm.None.messages"))


def tool_spans(spans: DataFrame) -> DataFrame:
    """(id, tool, tool_use_id, input, result, subagent_type, description, prompt, skill): what tool spans say of their call; input and result as in the attributes. A Task span without a call is left out."""
    raw = T.valid_json(F.col("raw_attributes"))
    given = T.valid_json(F.get_json_object(raw, "$.attributes.input.value"))
    call = F.get_json_object(given, "$.type") == "tool_use"
    inner = F.coalesce(F.when(call, F.get_json_object(given, "$.input")).otherwise(given), F.lit("{}"))
    result = F.coalesce(F.get_json_object(raw, "$.attributes.output.value"), F.lit(""))
    said = F.get(F.filter(blocks(result), lambda b: b["type"] == "text"), F.lit(0))["text"]
    task = F.col("name") == TASK
    s = spans.filter(F.col("name").startswith("Claude_Code_Tool_") & raw.isNotNull()).select(
        "id", "session_id", "trace_id", "name", "start_time", F.substring("name", 18, 200).alias("tool"), F.coalesce(F.when(call, F.get_json_object(given, "$.id")), F.lit("")).alias("tool_use_id"), inner.alias("input"),
        F.when(task, F.coalesce(said, F.lit(""))).otherwise(result).alias("result"), F.coalesce(call, F.lit(False)).alias("_call"),
    )
    get = lambda p, other="": F.when(F.col("name") == TASK, F.coalesce(F.get_json_object("input", p), F.lit(other)))
    return s.filter((F.col("name") != TASK) | F.col("_call")).withColumns({
        "subagent_type": get("$.subagent_type", "unknown"), "description": get("$.description"), "prompt": get("$.prompt"), "skill": F.when(F.col("tool") == "Skill", F.get_json_object("input", "$.skill")),
    }).drop("_call")


def last_tool_results(lines: DataFrame) -> DataFrame:
    """(session_id, tool_id, result) of transcript.lines(): the last result of each call that isn't empty, later ones winning."""
    r = lines.filter("type = 'user'").select("session_id", "uuid", "ts", F.explode("blocks").alias("b")).filter("b.type = 'tool_result'")
    r = r.select("session_id", F.col("b.tool_use_id").alias("tool_id"), T.content_text(F.col("b.content")).alias("result"), F.struct(F.col("ts").isNull(), "ts", "uuid").alias("at")).filter("result <> ''")
    return r.groupBy("session_id", "tool_id").agg(F.max_by("result", "at").alias("result"))


# Events of a chain


def message_order(spans: DataFrame, members: DataFrame) -> DataFrame:
    """(chain_id, order_idx, role, text): the messages of each chain in the order in which requests carry them.

    Requests that carry more messages than the last kept one, or fewer than half of it but four, are the conversation's; each message counts where it first comes, known by role and
    beginning. Tool results and what no user wrote are left out.
    """
    r = spans.filter("name = 'raw_gen_ai_request'").join(members.select("chain_id", "session_id"), "session_id").select("chain_id", "id", "start_time", cumulative_messages().alias("m"))
    r = r.filter((F.size("m") >= 2) & (F.get("m", F.lit(0))["role"] == "user"))
    kept = links.growing(r.select("chain_id", F.struct("start_time", "id").alias("at"), F.size("m").alias("n")), key="chain_id", order="at", count="n", floor=4)
    kept = kept.select(F.col("key").alias("chain_id"), F.col("ord.id").alias("id"), F.col("ord").alias("at"))
    m = r.join(kept, ["chain_id", "id"]).select("chain_id", "at", F.posexplode("m").alias("pos", "m")).select("chain_id", "at", "pos", "m.role", blocks(F.col("m.content")).alias("b"))
    text = F.array_join(F.transform("b", lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "tool_result", F.concat(F.lit("[tool_result: "), F.substring(b["content"], 1, 100), F.lit("]")))), " ")
    first = F.get("b", F.lit(0))
    key = F.coalesce(F.when(first["type"] == "text", F.substring(first["text"], 1, 200)).when(first["type"] == "tool_result", F.concat(F.lit("tool_result:"), first["tool_use_id"])), F.lit(""))
    m = m.withColumns({"text": F.coalesce(text, F.lit("")), "key": F.concat_ws(":", "role", key)})
    m = m.groupBy("chain_id", "key").agg(F.min(F.struct("at", "pos")).alias("at"), F.min_by(F.struct("role", "text"), F.struct("at", "pos")).alias("m")).select("chain_id", "at", "m.role", "m.text")
    said = F.when(F.col("role") == "user", T.strip(T.strip_reminders(F.col("text")))).otherwise(F.col("text"))
    m = m.filter(~((F.col("role") == "user") & F.col("text").startswith("[tool_result:"))).withColumn("text", said)
    m = m.filter(F.col("text").rlike(r"\S") & ((F.col("role") != "user") | is_said(F.col("text"), 0)))
    return m.withColumn("order_idx", F.row_number().over(Window.partitionBy("chain_id").orderBy("at")) - 1).select("chain_id", "order_idx", "role", "text")


def is_said(text: Column, least: int = 10) -> Column:
    """Whether a text in a user's place is the user's: longer than `least`, no output of a command, no JSON object, none of the fixed beginnings."""
    command = text.startswith("Command:") & text.contains("\nOutput:")
    return (F.length(text) > least) & ~command & ~(text.startswith("{") & text.endswith("}")) & ~T.starts_with_any(text, NOT_SAID)


def _first_of(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def main_spans(spans: DataFrame, members: DataFrame) -> DataFrame:
    """The spans of chains with their chain_id, of the traces that launch tasks; where a chain has no task all of its spans, and those without a trace."""
    s = spans.join(members.select("chain_id", "session_id"), "session_id")
    task = s.filter((F.col("name") == TASK) & F.col("trace_id").isNotNull()).select("chain_id", "trace_id").distinct()
    some = task.select("chain_id").distinct().withColumn("_some", F.lit(True))
    j = s.join(some, "chain_id", "left").join(task.withColumn("_main", F.lit(True)), ["chain_id", "trace_id"], "left")
    return j.filter("_some IS NULL OR trace_id IS NULL OR _main").drop("_some", "_main")


def chain_events(spans: DataFrame, members: DataFrame) -> DataFrame:
    """(chain_id, event_no, event_type, order_idx, timestamp, text, tool_use_id, tool, input, subagent_type, description, prompt): the events of each chain in order.

    user and assistant events are the texts of prompt spans and their answers, each once by its beginning; tool events and subagents stand at their spans, each call once; a compaction is a
    continuation with a summary. Texts that requests carry have their place there; a call stands half a place behind the answer that made it, else behind the last answer before its time; what has no place stands a tenth behind the last event before its time.
    """
    members = written(members, "chain-members")
    main = main_spans(spans, members)
    said = written(message_order(spans, members), "chain-messages")
    begin = lambda c: F.substring(T.strip(c), 1, 100)
    index = said.groupBy("chain_id", begin(F.col("text")).alias("begin")).agg(F.min("order_idx").alias("order_idx"))
    most = said.groupBy("chain_id").agg((F.max("order_idx") + 2).cast("double").alias("end_idx"))
    t = tool_spans(spans).join(members.select("chain_id", "session_id"), "session_id")
    tasks = _first_of(t.filter(F.col("name") == TASK), ["chain_id", "tool_use_id"], F.col("id"))
    tools = t.filter(F.col("name") != TASK).join(main.select("id", "chain_id"), ["id", "chain_id"], "left_semi")
    tools = _first_of(tools.filter("tool_use_id <> ''"), ["chain_id", "tool_use_id"], F.col("id")).unionByName(tools.filter("tool_use_id = ''"))
    kind = F.when(F.col("name") == TASK, "subagent").otherwise("tool")
    none = F.lit(None).cast("string")
    calls = tasks.unionByName(tools.select(tasks.columns)).select("chain_id", "id", kind.alias("event_type"), F.col("start_time").alias("timestamp"), F.col("result").alias("text"), "tool_use_id", "tool", "input", "subagent_type", "description", "prompt", F.lit(0).alias("pos"))
    p = main.filter(F.col("name").startswith(PROMPT) & F.col("start_time").isNotNull()).select("chain_id", "id", "start_time", F.coalesce("end_time", "start_time").alias("end_at"), C.input_text().alias("given"), C.output_text().alias("answer"))
    p = written(p, "chain-prompts")
    summary = p.filter(F.col("given").contains(C.COMPACTION_CONTINUED) & F.col("given").contains(SUMMARY)).select("chain_id", "id", "start_time", F.substring_index("given", SUMMARY, 1).alias("head"), "given")
    summary = summary.select("chain_id", "id", F.col("start_time").alias("timestamp"), F.expr("substring(given, length(head) + 1)").alias("text"))
    summary = _first_of(summary.withColumn("begin", F.substring("text", 1, 500)), ["chain_id", "begin"], F.col("id"))
    talk = p.filter(~F.col("given").contains(C.COMPACTION_CONTINUED) & ~F.col("given").contains(C.COMPACTION_TASK)).withColumns({"in": blocks(F.col("given")), "out": blocks(F.col("answer"))})
    talk = written(talk.select("chain_id", "id", "start_time", "end_at", "in", "out"), "chain-talk")
    texts = lambda side, at, kind: talk.select("chain_id", "id", F.col(at).alias("timestamp"), F.posexplode(side).alias("pos", "b")).filter("b.type = 'text'").select("chain_id", "id", F.lit(kind).alias("event_type"), "timestamp", T.strip(F.col("b.text")).alias("text"), "pos")
    user = texts("in", "start_time", "user").filter(is_said(F.col("text")))
    answer = texts("out", "end_at", "assistant").filter(F.length("text") >= 5)
    spoken = _first_of(user.unionByName(answer).withColumn("begin", begin(F.col("text"))), ["chain_id", "event_type", "begin"], F.struct("id", "pos")).join(index, ["chain_id", "begin"], "left")
    made = talk.select("chain_id", "id", F.explode("out").alias("b")).filter("b.type = 'tool_use' AND b.id <> ''").select("chain_id", "id", F.col("b.id").alias("tool_use_id"))
    made = made.join(spoken.filter("event_type = 'assistant' AND order_idx IS NOT NULL").groupBy("chain_id", "id").agg(F.max_by("order_idx", "pos").alias("made_idx")), ["chain_id", "id"])
    made = made.groupBy("chain_id", "tool_use_id").agg(F.max_by("made_idx", "id").alias("made_idx"))
    fill = {c: none for c in ("tool_use_id", "tool", "input", "subagent_type", "description", "prompt")}
    a = spoken.drop("begin").withColumns({**fill, "order_idx": F.col("order_idx").cast("double")})
    b = summary.drop("begin").withColumns({**fill, "event_type": F.lit("compaction"), "pos": F.lit(0), "order_idx": F.lit(None).cast("double")})
    c = calls.join(made, ["chain_id", "tool_use_id"], "left").withColumn("order_idx", F.col("made_idx") + F.lit(0.5)).drop("made_idx")
    ev = written(a.unionByName(b).unionByName(c.withColumn("order_idx", F.col("order_idx").cast("double"))), "chain-events")
    by_time = Window.partitionBy("chain_id").orderBy(F.col("timestamp").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    is_call = F.col("event_type").isin("tool", "subagent")
    answered = F.max(F.when(F.col("event_type") == "assistant", F.col("order_idx"))).over(by_time)
    # places are found on narrow rows; the texts are joined to them afterwards
    key = ["chain_id", "event_type", "id", "pos"]
    n = ev.select(*key, "timestamp", "order_idx").withColumn("order_idx", F.when(is_call & F.col("order_idx").isNull(), F.when(F.col("timestamp").isNull(), 0.5).otherwise(F.coalesce(answered, F.lit(0.0)) + 0.5)).otherwise(F.col("order_idx")))
    n = n.join(most, "chain_id", "left").withColumn("end_idx", F.coalesce("end_idx", F.lit(1.0)))
    some = F.count("order_idx").over(Window.partitionBy("chain_id")) > 0
    before = F.coalesce(F.max("order_idx").over(by_time), F.lit(0.0)) + 0.1
    n = n.withColumn("order_idx", F.coalesce("order_idx", F.when(some, F.when(F.col("timestamp").isNull(), F.col("end_idx")).otherwise(before))))
    rank = F.expr("CASE event_type WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 WHEN 'tool' THEN 2 WHEN 'subagent' THEN 3 ELSE 4 END")
    order = Window.partitionBy("chain_id").orderBy(F.coalesce("order_idx", "end_idx"), rank, F.col("timestamp").asc_nulls_first(), "id", "pos")
    n = n.withColumn("event_no", F.row_number().over(order) - 1).select(*key, "event_no", "order_idx")
    return ev.drop("order_idx").join(n, key).select("chain_id", "event_no", "event_type", "order_idx", "timestamp", "text", "tool_use_id", "tool", "input", "subagent_type", "description", "prompt")


def live_events(spans: DataFrame) -> DataFrame:
    """(session_id, event_no, event_type, text, tool, input): the events of live sessions from the messages that their requests carry, in order of time.

    User texts are those that a user seems to have typed; answers are whole; a tool call takes the first result of its id, a result without a call is an event of its own, `tool_result`; a
    continuation is a compaction, each once by its summary. Requests to the small model give only compactions.
    """
    s = spans.filter("session_id IS NOT NULL").select("session_id", F.struct(F.col("start_time").isNotNull(), "start_time", "id").alias("at"), F.lower(C.model_text()).contains("haiku").alias("small"), messages("input_messages").alias("i"), messages("output_messages").alias("o"))
    each = lambda c, side: s.select("session_id", "at", "small", F.lit(side).alias("side"), F.posexplode(c).alias("pos", "m")).select("session_id", "at", "small", "side", "pos", "m.role", "m.content")
    given = each("i", 0).filter("role = 'user'")
    going_on = given.filter(F.col("content").contains(C.COMPACTION_CONTINUED)).select("session_id", "at", "pos", F.coalesce(F.get(F.filter(blocks(F.col("content")), lambda b: (b["type"] == "text") & b["text"].contains(C.COMPACTION_CONTINUED)), F.lit(0))["text"], "content").alias("text"))
    going_on = going_on.groupBy("session_id", "at").agg(F.min_by("text", "pos").alias("text"))
    order = ["at", "side", "pos", "block"]
    compact = going_on.groupBy("session_id", "text").agg(F.min("at").alias("at")).select("session_id", "at", F.lit(-1).alias("side"), F.lit(0).alias("pos"), F.lit(0).alias("block"), F.lit("compaction").alias("event_type"), "text", F.lit(None).cast("string").alias("tool"), F.lit(None).cast("string").alias("input"))
    b = given.filter(~F.col("content").contains(C.COMPACTION_CONTINUED) & ~F.col("content").contains(C.COMPACTION_TASK)).unionByName(each("o", 1)).filter("NOT small")
    b = written(b.select("session_id", "at", "side", "pos", F.posexplode(blocks(F.col("content"))).alias("block", "b")), "live-blocks")
    none = F.lit(None).cast("string")
    user = b.filter((F.col("side") == 0) & (F.col("b.type") == "text") & T.is_live_human_turn(F.col("b.text"))).select("session_id", *order, F.lit("user").alias("event_type"), T.strip(F.col("b.text")).alias("text"), none.alias("tool"), none.alias("input"))
    reply = b.filter((F.col("side") == 1) & (F.col("b.type") == "text") & F.col("b.text").rlike(r"\S")).select("session_id", *order, F.lit("assistant").alias("event_type"), T.strip(F.col("b.text")).alias("text"), none.alias("tool"), none.alias("input"))
    call = b.filter("side = 1 AND b.type = 'tool_use'").select("session_id", *order, F.col("b.id").alias("tid"), F.coalesce("b.name", F.lit("Unknown")).alias("tool"), F.coalesce("b.input", F.lit("{}")).alias("input"))
    got = b.filter("side = 0 AND b.type = 'tool_result'").select("session_id", *order, F.col("b.tool_use_id").alias("tid"), T.content_text(F.col("b.content")).alias("text"), F.coalesce("b.is_error", F.lit(False)).alias("bad"))
    place = F.struct(*order)
    first_call = call.groupBy("session_id", "tid").agg(F.min(place).alias("called"))
    g = got.join(first_call, ["session_id", "tid"], "left").withColumn("after", F.coalesce(F.col("called") < place, F.lit(False)))
    answer = g.filter("after").groupBy("session_id", "tid").agg(F.min_by("text", place).alias("text"), F.min(place).alias("answered"))
    tools = call.join(answer, ["session_id", "tid"], "left").select("session_id", *order, F.lit("tool").alias("event_type"), F.coalesce("text", F.lit("")).alias("text"), "tool", "input")
    alone = g.join(answer.select("session_id", "tid", "answered"), ["session_id", "tid"], "left").filter(~F.col("after") | (place != F.col("answered")))
    alone = alone.select("session_id", *order, F.lit("tool").alias("event_type"), "text", F.when(F.col("bad"), "tool_result (error)").otherwise("tool_result").alias("tool"), F.lit("{}").alias("input"))
    ev = written(compact.unionByName(user).unionByName(reply).unionByName(tools).unionByName(alone), "live-events")
    n = ev.select("session_id", "event_type", *order).withColumn("event_no", F.row_number().over(Window.partitionBy("session_id").orderBy(*order)) - 1)
    return ev.join(n, ["session_id", "event_type", *order]).select("session_id", "event_no", "event_type", "text", "tool", "input")
