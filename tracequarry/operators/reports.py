"""Batches for models, coverage, statistics, comparisons of spans and checks of exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.functions import text as T
from tracequarry.functions.times import duration_ms
from tracequarry.operators import links, metrics

# Batches


def span_records(spans: DataFrame, *, attributes: bool = False) -> DataFrame:
    """(id, session_id, record): a span as JSON for a model: what it is, did and cost; missing values are left out."""
    s = metrics.with_category(spans)
    cols = [
        F.col("span_id"), F.col("name"), F.col("category"), F.col("confidence"), F.col("status_code").alias("status"), F.col("llm_model_name").alias("model"), F.col("input_value").alias("input"), F.col("output_value").alias("output"),
        F.col("llm_token_count_prompt").alias("tokens_prompt"), F.col("llm_token_count_completion").alias("tokens_completion"), duration_ms(F.col("start_time"), F.col("end_time")).alias("duration_ms"), F.col("start_time"), F.col("end_time"),
    ]
    return s.select("id", "session_id", F.to_json(F.struct(*cols, *([F.col("raw_attributes")] if attributes else []))).alias("record"))


def span_tokens() -> Column:
    """What a span's record takes of a model's input, about."""
    return T.token_estimate(F.col("input_value")) + T.token_estimate(F.col("output_value")) + 50


def _counts(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """A row for each key with its values' counts as text value=count."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(value, "n"))), lambda x: F.concat_ws("=", x[value], x["n"].cast("string"))), ",").alias(name))  # as many as there are values


def session_batches(spans: DataFrame) -> DataFrame:
    """(session_id, batch_id, span_count, token_estimate, categories, models, has_errors): each session as one batch for a model. The records are those of span_records()."""
    s = metrics.with_category(spans.filter("session_id IS NOT NULL")).select("session_id", "category", F.nullif("llm_model_name", F.lit("")).alias("model"), "status_code", span_tokens().alias("size"))
    g = s.groupBy("session_id").agg(F.count("*").alias("span_count"), F.sum("size").alias("token_estimate"), F.coalesce(F.bool_or(F.col("status_code") == "ERROR"), F.lit(False)).alias("has_errors"))
    key = ["session_id"]
    j = g.join(_counts(s, key, "category", "categories"), key, "left").join(_counts(s, key, "model", "models"), key, "left")
    return j.select("session_id", F.concat(F.lit("session_"), "session_id").alias("batch_id"), "span_count", "token_estimate", F.coalesce("categories", F.lit("")).alias("categories"), F.coalesce("models", F.lit("")).alias("models"), "has_errors")


def session_texts(spans: DataFrame) -> DataFrame:
    """(session_id, text): a session in a few sentences, as it is given to an embedding: size, duration, turns, tools, models, errors and its first five tools."""
    m = metrics.session_metrics(spans)
    tool = F.when(F.col("name").contains("Tool"), F.regexp_replace(F.regexp_replace("name", "Claude_Code_Tool_", ""), "Claude_Code_", ""))
    s = spans.filter("session_id IS NOT NULL")
    own = s.groupBy("session_id").agg(  # as many as there are tools and models
        F.array_join(F.array_sort(F.collect_set(tool)), ", ").alias("tools"), F.array_join(F.array_sort(F.collect_set(F.nullif("llm_model_name", F.lit("")))), ", ").alias("models"), F.count_if(F.col("status_code") == "ERROR").alias("errors")
    )
    first = s.filter("span_kind = 'TOOL'").select("session_id", "id", "name").withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy("id"))).filter("r <= 5")
    first = first.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.coalesce("name", F.lit("unknown")).alias("name")))), lambda x: x["name"]), ", ").alias("ops"))
    j = m.join(own, "session_id").join(first, "session_id", "left")
    or_ = lambda c, other: F.when(F.col(c) != "", F.col(c)).otherwise(F.lit(other))
    parts = [
        F.concat(F.lit("Session with "), F.col("span_count").cast("string"), F.lit(" spans")), F.concat(F.lit("Duration: "), F.format_string("%.1f", F.col("duration_seconds") / 60), F.lit(" minutes")), F.concat(F.lit("Turns: "), F.col("turn_count").cast("string")),
        F.concat(F.lit("Tools used: "), or_("tools", "none")), F.concat(F.lit("Models: "), or_("models", "unknown")), F.concat(F.lit("Errors: "), F.col("errors").cast("string")), F.when(F.col("ops").isNotNull(), F.concat(F.lit("Sample operations: "), "ops")),
    ]
    return j.select("session_id", F.concat_ws(". ", *parts).alias("text"))


# Coverage


def session_chunks(spans: DataFrame) -> DataFrame:
    """(id, chunk) of the sessions: their inputs, outputs and messages of more than 10 characters."""
    msgs = lambda c: F.transform(F.from_json(c, "array<map<string,string>>"), lambda m: F.coalesce(F.nullif(F.try_element_at(m, F.lit("message.content")), F.lit("")), F.try_element_at(m, F.lit("content"))))
    none = F.expr("CAST(array() AS array<string>)")
    every = F.concat(F.array("input_value", "output_value"), F.coalesce(msgs("input_messages"), none), F.coalesce(msgs("output_messages"), none))
    c = spans.filter("session_id IS NOT NULL").select(F.col("session_id").alias("id"), F.explode(every).alias("chunk"))
    return c.filter(F.length(T.strip(F.col("chunk"))) > 10)


def coverage(spans: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """One row: sessions in all, complete, subsets, partial and unique, spans in all and deletable, over links.containment() of session_chunks().

    A session is a subset if it lies whole in another, partial if it does in part, else complete; unique if nothing relates it to another. Sessions with the same chunks
    are subsets of their class's representative. Spans of a subset count once for each session that it lies in.
    """
    n = spans.filter("session_id IS NOT NULL").groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n"))
    chunks = session_chunks(spans)
    pairs = relations if relations is not None else links.containment(chunks)
    texts = n.select("id", F.lit(None).cast("string").alias("text"))
    same = links.containment_classes(texts, chunks).filter("class_id IS NOT NULL AND id <> class_id")
    kin = pairs.select("child", "parent", (F.col("relation") == "complete").alias("whole")).unionByName(same.select(F.col("id").alias("child"), F.col("class_id").alias("parent"), F.lit(True).alias("whole")))
    as_child = kin.groupBy(F.col("child").alias("id")).agg(F.bool_or("whole").alias("whole"), F.count_if("whole").alias("times"))
    as_parent = kin.select(F.col("parent").alias("id")).distinct().withColumn("holds", F.lit(True))
    j = n.join(as_child, "id", "left").join(as_parent, "id", "left")
    sub, part = F.coalesce("whole", F.lit(False)), F.col("whole").isNotNull()
    return j.agg(
        F.count("*").alias("sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("spans"), F.count_if(~part).alias("complete"), F.count_if(sub).alias("subsets"), F.count_if(part & ~sub).alias("partial"),
        F.count_if(~part & F.col("holds").isNull()).alias("unique"), F.coalesce(F.sum(F.when(sub, F.col("n") * F.col("times"))), F.lit(0)).alias("deletable_spans"),
    )


def deletable(spans: DataFrame) -> DataFrame:
    """(session_id, kept_in): sessions that lie whole in another, with the least of those; members of a class lie in its representative."""
    chunks = session_chunks(spans)
    texts = spans.filter("session_id IS NOT NULL").select(F.col("session_id").alias("id"), F.lit(None).cast("string").alias("text")).distinct()
    same = links.containment_classes(texts, chunks).filter("class_id IS NOT NULL AND id <> class_id").select(F.col("id").alias("child"), F.col("class_id").alias("parent"))
    every = links.containment(chunks).filter("relation = 'complete'").select("child", "parent").unionByName(same)
    return every.groupBy(F.col("child").alias("session_id")).agg(F.min("parent").alias("kept_in"))


# Statistics


def top_counts(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    """(statistic, value, n): for each column its most frequent values, as many as asked for, and the number of all rows as statistic 'rows'; ties by value."""
    out = df.agg(F.count("*").alias("n")).select(F.lit("rows").alias("statistic"), F.lit(None).cast("string").alias("value"), "n")
    for c, k in columns.items():
        n = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)
        out = out.unionByName(n.select(F.lit(c).alias("statistic"), "value", "n"))
    return out


def time_range(spans: DataFrame) -> tuple:
    """(first, last) start_time; ValueError if there is none, as of an empty table. Over JDBC both are found by the database."""
    a, b = spans.agg(F.min("start_time"), F.max("start_time")).first()
    if a is None:
        raise ValueError("no spans with a start_time")
    return a, b


def content_checks(spans: DataFrame) -> DataFrame:
    """(check, passed): whether spans hold content and are not just there. A check whose signal does not occur is left out."""
    llm = F.upper(F.coalesce("span_kind", F.lit(""))) == "LLM"
    given = T.nonempty(F.col("input_value")) & ~F.coalesce("input_value", F.lit("")).contains("redacted-by-litellm")
    out = T.nonempty(F.col("output_messages")) | T.nonempty(F.col("output_value"))
    raw = F.coalesce("raw_attributes", F.lit(""))
    cached = raw.rlike(r"cache_(?:read|creation)_input_tokens")
    asks, thinks = raw.rlike(r"""display\\?['"]\s*:\s*\\?['"]summarized"""), raw.rlike(r"""['"]signature\\?['"]\s*:|thinking\\?['"]\s*:\s*\\?['"][^'"\\]""")
    g = spans.agg(
        F.bool_or(llm).alias("llm"), F.bool_or(llm & given).alias("llm_input_content_populated"), F.bool_or(llm & out).alias("llm_output_content_populated"), F.bool_or(llm & (F.coalesce("llm_token_count_prompt", F.lit(0)) > 0)).alias("llm_token_counts_populated"),
        F.bool_or(asks).alias("asks"), F.bool_or(thinks).alias("thinking_content_captured"), F.bool_or(llm & cached).alias("cached"), F.bool_or(llm & raw.rlike(r"cache_read_input_tokens\\?['\"]\s*:\s*[1-9]")).alias("cache_reads_recorded"),
    )
    rows = [("llm", c) for c in ("llm_input_content_populated", "llm_output_content_populated", "llm_token_counts_populated")] + [("asks", "thinking_content_captured"), ("cached", "cache_reads_recorded")]
    each = F.array(*(F.when(F.coalesce(F.col(gate), F.lit(False)), F.struct(F.lit(c).alias("check"), F.coalesce(F.col(c), F.lit(False)).alias("passed"))) for gate, c in rows))
    return g.select(F.explode(F.array_compact(each)).alias("x")).select("x.*")


def thinking_mode() -> Column:
    """Whether a request asks for thinking, by its parameters."""
    p = F.coalesce(F.get_json_object(T.valid_json(F.col("raw_attributes")), "$.attributes.llm.invocation_parameters"), F.lit(""))
    return F.when(p.rlike(r'"thinking":\s*\{"type":\s*"adaptive"'), "adaptive").when(p.rlike(r'"thinking":\s*\{"type":\s*"disabled"'), "disabled").when(p.contains("budget_tokens"), "budget").otherwise("absent")


# Comparisons


def message_changes(spans: DataFrame) -> DataFrame:
    """(session_id, id, previous, current, repeated, new, overlap): how a span's input messages differ from those of the span before it in its session that has some; repeated counts the earlier list's messages that come again, overlap is its percentage of the current list."""
    m = spans.filter("session_id IS NOT NULL").select("session_id", "id", F.from_json("input_messages", "array<string>").alias("m")).filter("m IS NOT NULL")
    hashes = F.transform("m", lambda x: F.md5(x))
    w = Window.partitionBy("session_id").orderBy("id")
    m = m.select("session_id", "id", hashes.alias("m")).withColumn("b", F.lag("m").over(w)).filter("b IS NOT NULL")
    repeated, new = F.size(F.filter("b", lambda x: F.array_contains("m", x))), F.size(F.filter("m", lambda x: ~F.array_contains("b", x)))
    share = F.when(F.size("m") > 0, F.round(100.0 * repeated / F.size("m"), 2)).otherwise(0.0)
    return m.select("session_id", "id", F.size("b").alias("previous"), F.size("m").alias("current"), repeated.alias("repeated"), new.alias("new"), share.alias("overlap"))


def contained_in_last(spans: DataFrame) -> DataFrame:
    """(session_id, id, chunks, contained, share): how many of a span's texts stand in the texts of the last span of its session, in percent; the last span itself is left out, as are spans without text."""
    whole = F.concat_ws("\n", *(F.col(c) for c in ("input_value", "output_value", "input_messages", "output_messages")))
    s = spans.filter("session_id IS NOT NULL")
    last = s.groupBy("session_id").agg(F.max("id").alias("last_id"))
    text = s.withColumnRenamed("id", "last_id").join(last, ["session_id", "last_id"]).select("session_id", whole.alias("later"))
    parts = F.filter(F.transform(F.array("input_value", "output_value"), T.strip), lambda x: x != "")
    c = s.select("session_id", "id", parts.alias("parts")).filter(F.size("parts") > 0).join(last, "session_id").filter("id <> last_id").join(text, "session_id")
    hit = F.size(F.filter("parts", lambda x: F.col("later").contains(x)))
    return c.select("session_id", "id", F.size("parts").alias("chunks"), hit.alias("contained"), F.round(100.0 * hit / F.size("parts"), 2).alias("share"))


# Checks of exports


def export_check(events: DataFrame, blocks: DataFrame, *, beginning: int = 100) -> DataFrame:
    """(chain_id, event_type, expected, found): of the events that a chain's document should have, how many stand in it: by the first `beginning` characters of their text, a call without a text by its tool's name. Case is ignored; each event is looked for in its own piece and its file."""
    want = F.lower(F.substring(T.strip(F.when(F.coalesce("text", F.lit("")) != "", F.col("text")).otherwise(F.coalesce("tool", F.lit("")))), 1, beginning))
    e = events.select("chain_id", "event_no", "event_type", want.alias("want"))
    b = blocks.select("chain_id", F.col("block_no").alias("event_no"), F.lower(F.concat_ws("\n", "markdown", "file_text")).alias("have"))
    j = e.join(b, ["chain_id", "event_no"], "left")
    return j.groupBy("chain_id", "event_type").agg(F.count("*").alias("expected"), F.count_if(F.coalesce(F.col("have").contains(F.col("want")), F.lit(False))).alias("found"))


def first_source(spans: DataFrame) -> DataFrame:
    """(session_id, source, spans): each session in the first source that has it, by name, with its number of spans there."""
    n = spans.filter("session_id IS NOT NULL AND source IS NOT NULL").groupBy("session_id", "source").agg(F.count("*").alias("n"))
    return n.groupBy("session_id").agg(F.min("source").alias("source"), F.min_by("n", "source").alias("spans"))


def page(df: DataFrame, *order: str, limit: int, offset: int = 0) -> DataFrame:
    """Rows offset to offset + limit in the order given; nulls last."""
    return df.orderBy(*(F.col(c).asc_nulls_last() for c in order)).offset(offset).limit(limit)
