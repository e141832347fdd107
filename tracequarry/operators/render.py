"""Conversations as Markdown: pieces in order, and the files beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.functions import text as T

# Characters shown of a tool's result, from how many on it has a file of its own, and what is shown of prompts, answers and inputs.
RESULT_INLINE, RESULT_FILE, PROMPT_SHOWN, ANSWER_SHOWN, INPUT_SHOWN = 500, 2000, 200, 500, 200
_QUESTIONS = "array<struct<header:string,question:string,options:array<struct<label:string,description:string>>>>"


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def tool_input_lines(tool_input: Column, leave_out: str | None = None) -> Column:
    """A tool's input as lines key: value by key, values cut; '' if there is none."""
    pairs = F.array_sort(F.map_entries(F.from_json(T.valid_json(tool_input), "map<string,string>")))
    if leave_out:
        pairs = F.filter(pairs, lambda p: p["key"] != leave_out)
    return F.coalesce(F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit(": "), T.truncate(F.coalesce(p["value"], F.lit("None")), INPUT_SHOWN))), "\n"), F.lit(""))


def _questions(tool_input: Column, result: Column) -> Column:
    """Questions with their options and answers; the answers stand in the result as "question"="answer"."""
    asked = F.from_json(F.get_json_object(T.valid_json(tool_input), "$.questions"), _QUESTIONS)

    def one(q: Column, i: Column) -> Column:
        told = F.concat(F.lit('"'), q["question"], F.lit('"="'))
        after = F.when(result.contains(told), F.substring_index(F.element_at(F.split(result, F.concat(F.lit(r"\Q"), told, F.lit(r"\E"))), 2), '"', 1))
        mark = lambda o: F.when(after.contains(o["label"]), F.lit("→")).otherwise(F.lit("-"))
        shown = lambda o: F.when(F.coalesce(o["description"], F.lit("")) != "", F.concat(F.lit("**"), o["label"], F.lit("**: "), o["description"])).otherwise(o["label"])
        options = F.transform(F.coalesce(q["options"], F.expr("CAST(array() AS array<struct<label:string,description:string>>)")), lambda o: F.concat(F.lit("  "), mark(o), F.lit(" "), shown(o)))
        head = F.concat(F.lit("**"), F.coalesce(q["header"], F.concat(F.lit("Question "), (i + 1).cast("string"))), F.lit("**: "), F.coalesce(q["question"], F.lit("")))
        return F.concat_ws("\n", head, F.array_join(F.when(F.size(options) > 0, options), "\n"), F.when(F.coalesce(after, F.lit("")) != "", F.concat(F.lit("  **Answer**: "), after)), F.lit(""))

    return F.coalesce(F.array_join(F.transform(asked, one), "\n"), F.lit(""))


def tool_section(tool: Column, tool_input: Column, result: Column, file: Column) -> Column:
    """A tool call: its name, input and result; of a long result the beginning, with a link to its file."""
    skill = F.when(tool == "Skill", F.get_json_object(T.valid_json(tool_input), "$.skill"))
    many = F.coalesce(F.size(F.from_json(F.get_json_object(T.valid_json(tool_input), "$.questions"), "array<string>")), F.lit(0))
    asks = tool == "AskUserQuestion"
    head = F.when(skill.isNotNull(), F.concat(F.lit("### Skill: "), skill)).when(asks, F.concat(F.lit("### Tool: AskUserQuestion"), F.when(many > 1, F.concat(F.lit(" ("), many.cast("string"), F.lit(" questions)"))).otherwise(""))).otherwise(F.concat(F.lit("### Tool: "), tool))
    given = F.when(skill.isNotNull(), tool_input_lines(tool_input, "skill")).otherwise(tool_input_lines(tool_input))
    hint = F.when(tool == "Read", T.language_hint(F.coalesce(F.get_json_object(T.valid_json(tool_input), "$.file_path"), F.lit("")))).when(tool == "Bash", "bash").otherwise("text")
    shown = F.concat(F.lit("**Result** ("), F.format_number(F.length(result), 0), F.lit(" chars):\n```"), hint, F.lit("\n"), T.truncate(result, RESULT_INLINE), F.lit("\n```"))
    link = F.when(file.isNotNull(), F.concat(F.lit("\n\n→ Full result: ["), file, F.lit("](./"), file, F.lit(")"))).otherwise("")
    body = F.concat(F.when(given != "", _lines("**Input**:", "```text", given, "```", "", "")).otherwise(""), F.when(result != "", F.concat(shown, link)).otherwise(F.lit("**Result**: (empty)")), F.lit("\n"))
    return _lines(head, "", F.when(asks, _questions(tool_input, result)).otherwise(body), "---", "")


def subagent_section(kind: Column, description: Column, prompt: Column, answer: Column, file: Column) -> Column:
    part = lambda name, text, most: F.when(text != "", F.concat(F.lit(f"**{name}**"), F.when(F.length(text) > most, F.lit(f" (first {most} chars)")).otherwise(""), F.lit(":\n> "), T.truncate(text, most), F.lit("\n")))
    task = F.when(description != "", F.concat(F.lit("**Task**: "), description))
    return F.concat_ws("\n", F.concat(F.lit("### Subagent: "), kind), F.lit(""), task, part("Prompt", prompt, PROMPT_SHOWN), part("Result Summary", answer, ANSWER_SHOWN), F.concat(F.lit("→ Full conversation: ["), file, F.lit(".md](./"), file, F.lit(".md)")), F.lit(""), F.lit("---"), F.lit(""))


def subagent_file(kind: Column, description: Column, prompt: Column, answer: Column, file: Column) -> Column:
    or_ = lambda text, other: F.when(text != "", text).otherwise(F.lit(other))
    return F.concat_ws(
        "\n", F.concat(F.lit("# Subagent: "), kind, F.lit(" ("), file, F.lit(")")), F.lit(""), F.lit("## Task"), F.lit(""), F.when(description != "", F.concat(F.lit("**Description:** "), description, F.lit("\n"))),
        F.lit("**Prompt:**"), F.lit(""), or_(prompt, "(no prompt)"), F.lit(""), F.lit("*[Full conversation not available - linked trace not found]*"), F.lit(""), F.lit("## Response"), F.lit(""), or_(answer, "(no response)"), F.lit(""),
    )


def compaction_section(number: Column, summary: Column) -> Column:
    quoted = F.concat(F.lit("> "), F.regexp_replace(F.replace(summary, F.lit("\\n"), F.lit("\n")), "\n", "\n> "))
    return _lines(F.concat(F.lit("### Compaction #"), number.cast("string")), "", "<!-- BEGIN PIPELINE_SPECIFIC -->", "- **Detected from**: LiteLLM traces (LiteLLM only)", "<!-- END PIPELINE_SPECIFIC -->", "", "> **Context Summary**:", quoted, "", "---", "")


def markdown(events: DataFrame, heads: DataFrame) -> DataFrame:
    """(chain_id, block_no, markdown, file, file_text): the pieces of each chain's document in order, a head first and a foot last, each with the file that belongs to it.

    events as of dialogue.chain_events() or live_events(); heads (chain_id, session_id, start_time, end_time, models, compactions). Texts are whole; of results over
    RESULT_FILE characters the beginning is shown and the file has all, prompts and answers of subagents are whole in theirs. Files are numbered on rows without texts.
    """
    e = events.select("chain_id", "event_no", "event_type", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("tool", F.lit("Unknown")).alias("tool"), F.coalesce("input", F.lit("{}")).alias("input"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("subagent_type", "description", "prompt")))
    kind = F.when(F.col("event_type") == "subagent", F.regexp_replace(F.lower("subagent_type"), "[- ]", "_"))
    big = (F.col("event_type") == "tool") & (F.length("text") > RESULT_FILE)
    n = e.select("chain_id", "event_no", "event_type", kind.alias("kind"), big.alias("big"))
    so_far = lambda *by: Window.partitionBy("chain_id", *by).orderBy("event_no").rowsBetween(Window.unboundedPreceding, 0)
    n = n.withColumns({"result_no": F.count_if("big").over(so_far()), "agent_no": F.count("kind").over(so_far("kind")), "compaction_no": F.count_if(F.col("event_type") == "compaction").over(so_far())})
    name = F.when(F.col("big"), F.concat(F.lit("tool_result_"), F.col("result_no").cast("string"), F.lit(".txt"))).when(F.col("kind").isNotNull(), F.concat(F.lit("subagent_"), "kind", F.lit("_"), F.col("agent_no").cast("string")))
    e = e.join(n.select("chain_id", "event_no", "compaction_no", name.alias("name")), ["chain_id", "event_no"])
    talk = lambda title: _lines(f"### {title}", "", F.col("text"), "", "---", "")
    agent = [F.col(c) for c in ("subagent_type", "description", "prompt", "text", "name")]
    t = F.col("event_type")
    block = (
        F.when(t == "user", talk("User")).when(t == "assistant", talk("Assistant")).when(t == "tool", tool_section(F.col("tool"), F.col("input"), F.col("text"), F.col("name")))
        .when(t == "subagent", subagent_section(*agent)).otherwise(compaction_section(F.col("compaction_no"), F.col("text")))
    )
    file = F.when(t == "subagent", F.concat("name", F.lit(".md"))).otherwise(F.col("name"))
    body = e.select("chain_id", F.col("event_no").alias("block_no"), block.alias("markdown"), file.alias("file"), F.when(t == "subagent", subagent_file(*agent)).when(F.col("name").isNotNull(), F.col("text")).alias("file_text"))
    stamp = lambda c, label: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"- **{label}**: "), F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC (LiteLLM only)")))
    head = F.concat_ws(
        "\n", F.concat(F.lit("# Session: "), F.substring("session_id", 1, 8)), F.lit(""), F.lit("## Metadata"), F.lit(""), F.concat(F.lit("- **Session ID**: `"), "session_id", F.lit("`")), F.lit(""), F.lit("<!-- BEGIN PIPELINE_SPECIFIC -->"),
        stamp("start_time", "Started"), stamp("end_time", "Ended"), F.when(F.col("models") != "", F.concat(F.lit("- **Models**: "), "models", F.lit(" (LiteLLM only)"))),
        F.when(F.col("compactions") > 0, F.concat(F.lit("- **Compactions**: "), F.col("compactions").cast("string"), F.lit(" (LiteLLM only)"))), F.lit("<!-- END PIPELINE_SPECIFIC -->"), F.lit(""), F.lit("---"), F.lit(""), F.lit("## Conversation"), F.lit(""),
    )
    none = F.lit(None).cast("string")
    top = heads.select("chain_id", F.lit(-1).alias("block_no"), head.alias("markdown"), none.alias("file"), none.alias("file_text"))
    kinds = ("user", "assistant", "tool", "subagent", "compaction")
    counts = events.groupBy("chain_id").agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in kinds))
    c = heads.select("chain_id", "session_id").join(counts, "chain_id", "left").fillna(0, list(kinds))
    said = lambda k, what: F.concat(F.col(k).cast("string"), F.lit(f" {what}"))
    stats = F.concat_ws(", ", said("user", "user turns"), said("assistant", "assistant turns"), said("tool", "tool calls"), said("subagent", "subagents"), F.when(F.col("compaction") > 0, said("compaction", "compactions")))
    foot = _lines("---", "", F.concat(F.lit("*Exported from session `"), "session_id", F.lit("`*")), F.concat(F.lit("*"), stats, F.lit("*")), "")
    bottom = c.select("chain_id", F.lit(2_000_000_000).alias("block_no"), foot.alias("markdown"), none.alias("file"), none.alias("file_text"))
    return top.unionByName(body).unionByName(bottom)


def heads_of(chains: DataFrame, spans: DataFrame, members: DataFrame) -> DataFrame:
    """The heads of chains() for markdown()."""
    models = spans.join(members.select("chain_id", "session_id"), "session_id").groupBy("chain_id").agg(F.array_join(F.array_sort(F.collect_set("llm_model_name")), ", ").alias("models"))  # as many as there are models
    return chains.join(models, "chain_id", "left").select("chain_id", F.coalesce("claude_session_id", "chain_id").alias("session_id"), "start_time", "end_time", F.coalesce("models", F.lit("")).alias("models"), "compactions")


def write_documents(blocks: DataFrame, path: str) -> None:
    """A folder chain_id=... for each chain below path/documents, whose text lines are its document, and the files of the pieces below path/files/chain_id=.../file=...; nothing is gathered: pieces are sorted within tasks and written."""
    b = blocks.repartition("chain_id").sortWithinPartitions("chain_id", "block_no")
    b.select("chain_id", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("chain_id").text(f"{path}/documents")
    blocks.filter("file IS NOT NULL").select("chain_id", "file", F.col("file_text").alias("value")).write.mode("overwrite").partitionBy("chain_id", "file").text(f"{path}/files")
