"""Column builders for text. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
TICKET = r"\b([A-Z][A-Z0-9]+-\d+)\b"

# What marks text that the agent or its harness wrote into a user turn.
AGENT_PREFIXES = (
    "perform a web search for the query",
    "describe your most recent action",
    "the user stepped away",
    "the user has been idle",
    "[suggestion mode",
    "the date has changed",
    "caveat: the messages below were generated",
)
MACHINE_MARKERS = ("tool_use_id", "<system-reminder>", "<task-notification>", "<command-name>", "<local-command-stdout>", "[request interrupted by user]")
LIVE_PREFIXES = ("<system", "Files modified by", "Caveat: The messages below", "Base directory for this skill")

# Language names of file endings.
LANGUAGES = {
    "py": "python", "js": "javascript", "ts": "typescript", "tsx": "typescript", "jsx": "javascript", "json": "json", "md": "markdown", "sh": "bash", "bash": "bash", "yaml": "yaml", "yml": "yaml", "html": "html",
    "css": "css", "sql": "sql", "rs": "rust", "go": "go", "java": "java", "rb": "ruby", "php": "php", "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp",
}


def once(c: Column, f) -> Column:
    """f(c) with c computed once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def valid_json(c: Column) -> Column:
    """c where it is JSON, else null: path functions would read what they can of a text that breaks off."""
    return F.when(F.try_parse_json(c).isNotNull(), c)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one space."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """Whether c contains any of the words as they are; false for null."""
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return F.coalesce(out, F.lit(False))


def starts_with_any(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.startswith(w)
    return F.coalesce(out, F.lit(False))


def is_human_turn(c: Column, min_chars: int = 12) -> Column:
    """Text that a person seems to have typed: long enough, without machine markers and agent prefixes."""

    def test(t: Column) -> Column:
        return F.coalesce(F.length(t) >= min_chars, F.lit(False)) & ~contains_any(t, MACHINE_MARKERS) & ~starts_with_any(t, AGENT_PREFIXES)

    return once(F.lower(collapse(c)), test)


def is_live_human_turn(c: Column) -> Column:
    """The laxer rule for live sessions, by length and shape."""
    t = strip(c)
    command = t.startswith("Command:") & t.contains("\nOutput:")
    return F.coalesce((F.length(t) > 10) & ~command & ~(t.startswith("{") & t.endswith("}")), F.lit(False)) & ~starts_with_any(t, LIVE_PREFIXES)


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def safe_name(c: Column) -> Column:
    """Usable as a file name: other characters become '_', 120 at most."""
    return F.substring(F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_"), 1, 120)


def tickets(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TICKET), 1)


def uuids(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(f"({UUID})"), 1), F.lower)


def joined_set(c: Column, sep: str = ",") -> Column:
    """An array as text: its distinct elements in order."""
    return F.array_join(F.array_sort(F.array_distinct(c)), sep)


def token_estimate(c: Column) -> Column:
    """A fourth of the characters."""
    return F.floor(F.coalesce(F.length(c), F.lit(0)) / 4)


def language_hint(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))), F.lit("text"))


# Which field of a tool's input says what it is about, how much of it is shown and from which end.
TARGETS = {"Read": ("file_path", 60, "end"), "Write": ("file_path", 60, "end"), "Edit": ("file_path", 60, "end"), "Bash": ("command", 50, "start")}


def tool_target(name: Column, tool_input: Column) -> Column:
    """What a tool call is about, in a few words, from its name and its input's JSON text; '' if nothing says it."""
    j = valid_json(tool_input)
    get = lambda p: F.coalesce(F.get_json_object(j, f"$.{p}"), F.lit(""))
    out = None
    for tool, (field, most, side) in TARGETS.items():
        v = get(field)
        short = truncate(v, most) if side == "start" else F.when(F.length(v) > most, F.concat(F.lit("..."), F.substring(v, -(most - 3), most - 3))).otherwise(v)
        out = F.when(name == tool, short) if out is None else out.when(name == tool, short)
    place = F.concat(F.lit("`"), get("pattern"), F.lit("` in `"), F.coalesce(F.get_json_object(j, "$.path"), F.lit(".")), F.lit("`"))
    args = get("args")
    skill = F.concat(F.coalesce(F.get_json_object(j, "$.skill"), F.lit("unknown")), F.when(args != "", F.concat(F.lit(" "), truncate(args, 30))).otherwise(""))
    more = F.coalesce(F.size(F.from_json(F.get_json_object(j, "$.questions"), "array<string>")), F.lit(0))
    head, asked = get("questions[0].header"), get("questions[0].question")
    question = F.when(more < 1, "question").otherwise(F.concat(F.when(head != "", head).otherwise(truncate(asked, 40)), F.when(more > 1, F.concat(F.lit(" (+"), (more - 1).cast("string"), F.lit(")"))).otherwise("")))
    first = F.from_json(j, "map<string,string>")
    rest = F.coalesce(truncate(F.element_at(F.array_sort(F.map_entries(first)), 1)["value"], 50), F.lit(""))
    return (
        out.when(name.isin("Grep", "Glob"), place).when(name == "Task", F.concat(get("subagent_type"), F.lit(": "), truncate(get("description"), 30))).when(name == "Skill", skill)
        .when(name == "AskUserQuestion", question).when(F.coalesce(F.size(first), F.lit(0)) > 0, rest).otherwise("")
    )


def file_path(raw: Column, text: Column) -> Column:
    """The file a span is about: file_path of its attributes, else the first absolute path in its text; null if neither."""
    raw = valid_json(raw)
    inner = valid_json(F.get_json_object(raw, "$.attributes.input.value"))
    direct = F.coalesce(F.get_json_object(raw, "$.file_path"), F.get_json_object(raw, "$.attributes.tool.parameters.file_path"), F.get_json_object(inner, "$.input.file_path"))
    return F.coalesce(F.nullif(direct, F.lit("")), F.nullif(F.regexp_extract(text, r"((?:/[\w.-]+)+(?:\.\w+)?)", 1), F.lit("")))


def nonempty(c: Column) -> Column:
    """Not null and not a text that stands for nothing."""
    return F.coalesce(~F.lower(strip(c)).isin("", "none", "nan", "null", "[]", "{}"), F.lit(False))


def strip_reminders(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<system-reminder>.*?</system-reminder>", "")


def content_text(c: Column) -> Column:
    """The text of a message: plain text as it is, of a block array the texts of its text blocks, a line each."""
    blocks = F.from_json(c, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    return F.when(F.schema_of_variant(F.try_parse_json(c)).startswith("ARRAY"), F.array_join(texts, "\n")).otherwise(c)


def message_key(c: Column, n: int = 500) -> Column:
    """Messages with the same beginning are the same message."""
    return F.lower(strip(F.substring(c, 1, n)))


def content_hash(c: Column) -> Column:
    return F.md5(F.lower(strip(c)))
