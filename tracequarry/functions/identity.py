"""Session, user and account ids from the metadata layouts that exporters use.

A metadata value is a JSON object with keys device_id, account_uuid and session_id, or the older text
user_<hash>_account_<uuid>_session_<id>. A JSON object is read by key only: its key session_id would match the older text's pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.functions.text import valid_json

# Fixed values: (part, JSON keys, pattern of the older text).
PARTS = {
    "user": (("device_id",), r"user_([a-zA-Z0-9]+)_account"),
    "account": (("account_uuid", "account_id"), r"account_([a-f0-9-]{36})"),
    "session": (("session_id",), r"session_([a-zA-Z0-9_-]+)"),
}
# Session ids that stand for none, in lower case.
INVALID_SESSIONS = ("id", "", "none", "null", "unknown")


def is_session(c: Column) -> Column:
    """An id that stands for a session: null and the invalid ones, however they are written, do not."""
    return F.coalesce(~F.lower(F.trim(c)).isin(*INVALID_SESSIONS), F.lit(False))


def metadata_values(raw: Column) -> Column:
    """The identity values in a span's raw attributes, as an array in the order in which they count."""
    nested, dotted, top = F.get_json_object(raw, "$.attributes.metadata"), F.get_json_object(raw, "$['attributes.metadata']"), F.get_json_object(raw, "$.metadata")
    llm = F.map_values(F.from_json(F.get_json_object(raw, "$.attributes.llm"), "map<string,string>"))
    model = F.slice(F.array_compact(F.transform(llm, lambda m: F.get_json_object(m, "$.metadata"))), 1, 1)
    metas = F.array_compact(F.concat(F.array(nested, dotted), F.coalesce(model, F.expr("CAST(array() AS array<string>)")), F.array(top)))
    inner = lambda m: F.array(F.get_json_object(m, "$.user_api_key_end_user_id"), F.get_json_object(m, "$.requester_metadata.user_id"), m)
    return F.array_compact(F.flatten(F.transform(metas, inner)))


def part_of(values: Column, part: str) -> Column:
    """The first of identity values that has the part; null if none has: there is no fallback for users and accounts."""
    keys, pattern = PARTS[part]

    def one(v: Column) -> Column:
        by_key = F.coalesce(*(F.nullif(F.get_json_object(v, f"$.{k}"), F.lit("")) for k in keys))
        is_object = F.ltrim(v).startswith("{") & F.try_parse_json(v).isNotNull()
        return F.when(is_object, by_key).otherwise(F.nullif(F.regexp_extract(v, pattern, 1), F.lit("")))

    return F.try_element_at(F.array_compact(F.transform(values, one)), F.lit(1))


def with_identities(spans: DataFrame) -> DataFrame:
    """spans with found_user, found_account and found_session, read from raw_attributes; a span without a session falls back to its trace, then to its text.

    The steps are projections of their own, so that each text is parsed once.
    """
    s = spans.withColumn("_raw", valid_json(F.col("raw_attributes")))
    s = s.withColumn("_values", metadata_values(F.col("_raw")))
    in_text = F.nullif(F.regexp_extract("input_value", PARTS["session"][1], 1), F.lit(""))
    s = s.withColumns({"found_user": part_of(F.col("_values"), "user"), "found_account": part_of(F.col("_values"), "account"), "found_session": F.coalesce(part_of(F.col("_values"), "session"), F.col("trace_id"), in_text)})
    return s.drop("_raw", "_values")
