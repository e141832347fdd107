"""Filtered, pattern and grouped queries over spans; one lazy plan each."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.functions.identity import INVALID_SESSIONS

SEARCH_FIELDS = ("name", "input_value", "output_value", "input_messages", "output_messages", "status_code", "llm_model_name", "raw_attributes")
SKILL_SPAN = "Claude_Code_Tool_Skill"


class PatternError(ValueError):
    """A pattern or field that cannot be searched for."""


def java_pattern(pattern: str, ignore_case: bool = True) -> str:
    """The pattern for the JVM: checked here and not in a task, named groups in Java's spelling."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise PatternError(f"bad pattern {pattern!r}: {e}") from e
    return ("(?i)" if ignore_case else "") + re.sub(r"\(\?P<", "(?<", pattern)


def skill_name(name: Column, raw: Column) -> Column:
    """The skill of a skill span, from the JSON text inside its attributes; null for other spans and unreadable text."""
    inner = F.get_json_object(raw, "$.attributes.input.value")
    return F.when(name == SKILL_SPAN, F.nullif(F.get_json_object(inner, "$.input.skill"), F.lit("")))


def filter_spans(
    spans: DataFrame,
    *,
    session_id: str | None = None,
    start=None,
    end=None,
    status: str | None = None,
    model: str | None = None,
    name: str | None = None,
    skill: str | None = None,
    pattern: str | None = None,
    fields: Sequence[str] = SEARCH_FIELDS,
    ignore_case: bool = True,
) -> DataFrame:
    """Spans that meet all conditions given. Both time bounds are inclusive and leave out spans without start_time; model and name are substrings without regard to case, % and _ taken as they are; status is exact."""
    df = spans
    if session_id is not None:
        df = df.filter(F.col("session_id") == session_id)
    if start is not None:
        df = df.filter(F.col("start_time") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col("start_time") <= F.lit(end).cast("timestamp"))
    if status is not None:
        df = df.filter(F.col("status_code") == status)
    if model is not None:
        df = df.filter(F.lower("llm_model_name").contains(model.lower()))
    if name is not None:
        df = df.filter(F.lower("name").contains(name.lower()))
    if skill is not None:
        df = df.filter(skill_name(F.col("name"), F.col("raw_attributes")) == skill)
    if pattern is not None:
        df = search(df, pattern, fields=fields, ignore_case=ignore_case)
    return df


def search(df: DataFrame, pattern: str, *, fields: Sequence[str] = SEARCH_FIELDS, ignore_case: bool = True) -> DataFrame:
    """Rows in one of whose fields the pattern is found; null fields hold nothing. PatternError for a bad pattern or field."""
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise PatternError(f"no such fields: {missing}")
    rx = java_pattern(pattern, ignore_case)
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.col(f).rlike(rx), F.lit(False))
    return df.filter(hit)


def literal(df: DataFrame, text: str, *, fields: Sequence[str] = ("input_value", "output_value")) -> DataFrame:
    """Rows in one of whose fields the text stands as it is, without regard to case."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.lower(f).contains(text.lower()), F.lit(False))
    return df.filter(hit)


def one_session(spans: DataFrame, session_id: str, *, since=None) -> DataFrame:
    """The spans whose attributes name the session, from `since` on. Ids that stand for none are refused: they would match nearly everything."""
    if session_id is None or session_id.strip().lower() in INVALID_SESSIONS:
        raise ValueError(f"{session_id!r} names no session")
    df = spans.filter(F.col("raw_attributes").contains(session_id))
    return df if since is None else df.filter(F.col("start_time") >= F.lit(since).cast("timestamp"))


_MATCH = "id long, field string, start int, end int, match string, context string"


def matches(df: DataFrame, pattern: str, *, fields: Sequence[str], around: int = 50, ignore_case: bool = True) -> DataFrame:
    """(id, field, start, end, match, context): every match with its place and up to `around` characters on both sides, '...' where they are cut.

    Rows without a match are dropped in the JVM; offsets, which it does not give, are found in Arrow batches of the rest.
    """
    hits = search(df, pattern, fields=fields, ignore_case=ignore_case).select(F.col("id").cast("long").alias("id"), *fields)
    rx = re.compile(pattern, re.I if ignore_case else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            ids = b.column(0).to_pylist()
            for k, f in enumerate(fields):
                for i, text in zip(ids, b.column(k + 1).to_pylist()):
                    for m in rx.finditer(text or ""):
                        a, z = max(0, m.start() - around), min(len(text), m.end() + around)
                        out.append((i, f, m.start(), m.end(), m.group(), ("..." if a else "") + text[a:z] + ("..." if z < len(text) else "")))
            cols = list(zip(*out)) or [()] * 6
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["id", "field", "start", "end", "match", "context"])

    return hits.mapInArrow(run, _MATCH)


def extract(df: DataFrame, pattern: str, *, fields: Sequence[str], group: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """(by..., field, value): every match as text, without its place; stays in the JVM."""
    rx = java_pattern(pattern, ignore_case=False)
    parts = F.array(*(F.struct(F.lit(f).alias("field"), F.regexp_extract_all(F.coalesce(F.col(f), F.lit("")), F.lit(rx), group).alias("v")) for f in fields))
    return df.select(*by, F.explode(parts).alias("p")).select(*by, F.col("p.field").alias("field"), F.explode("p.v").alias("value"))


def sessions(spans: DataFrame) -> DataFrame:
    """(session_id, span_count, start_time, end_time): a row for each session; spans without session_id are left out. Newest first with newest_first()."""
    return spans.filter("session_id IS NOT NULL").groupBy("session_id").agg(F.count("*").alias("span_count"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.coalesce("end_time", "start_time").desc_nulls_last(), "session_id")


def nested_sessions(spans: DataFrame, *, part_spans: int = 10_000) -> DataFrame:
    """(session_id, part, span_count, start_time, end_time, spans): sessions with their spans as an array in time order, the form that JSON sinks write; readers put parts together.

    An array holds part_spans spans at most, so that no session is gathered whole. Places are found on rows without texts. Counts and times are the whole session's.
    """
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("start_time").asc_nulls_first(), "id")) - 1
    n = spans.filter("session_id IS NOT NULL").select("session_id", "start_time", "id").withColumn("part", F.floor(place / F.lit(part_spans)).cast("int")).select("id", "part")
    s = F.struct("start_time", "id", "span_id", "name", "status_code", "input_value", "output_value")
    parts = spans.filter("session_id IS NOT NULL").join(n, "id").groupBy("session_id", "part").agg(F.array_sort(F.collect_list(s)).alias("spans"))
    return parts.join(sessions(spans), "session_id").select("session_id", "part", "span_count", "start_time", "end_time", "spans")


def list_sessions(spans: DataFrame, *, min_spans: int = 1, tools: Sequence[str] = ()) -> DataFrame:
    """Sessions with at least min_spans spans in whose texts every one of tools occurs."""
    text = F.concat_ws(" ", "input_value", "output_value", "name", "raw_attributes")
    flags = [F.bool_or(text.contains(t)).alias(f"_t{i}") for i, t in enumerate(tools)]
    s = spans.filter("session_id IS NOT NULL").groupBy("session_id").agg(F.count("*").alias("span_count"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), *flags)
    for i in range(len(tools)):
        s = s.filter(f"_t{i}")
    return s.filter(F.col("span_count") >= min_spans).select("session_id", "span_count", "start_time", "end_time")
