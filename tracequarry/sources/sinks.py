"""Sinks: partitioned Parquet with incremental appends, sessions, events, and small results as JSON, CSV or Markdown."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracequarry.functions.times import iso_week
from tracequarry.operators import metrics, query, unify
from tracequarry.session import written
from tracequarry.sources import readers, schemas


# Fixed value: times in text keep their microseconds, which the usual format drops.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _key(df: DataFrame) -> Column:
    """What tells spans apart: trace and span id, of spans without a span id the whole row."""
    row = F.to_json(F.struct(*(c for c in StructType.fromDDL(schemas.SPANS).fieldNames() if c != "source")))
    return F.when(F.col("span_id").isNotNull(), F.sha2(F.concat_ws("|", F.coalesce("trace_id", F.lit("")), "span_id"), 256)).otherwise(F.sha2(row, 256))


def write_spans(spans: DataFrame, root: str, source: str, *, only_new: bool = True) -> int:
    """Appends spans to root/spans/source=/week=; spans that the source already has (by trace_id and span_id; by the whole row without span_id) are left out, of repeated ones the last is written. Gives the number written.

    Only keys are shuffled: rows whose key is not repeated pass where they are.
    """
    spark = spans.sparkSession
    at = f"{root}/spans/source={source}"
    rows = written(readers.align(spans, schemas.SPANS).withColumn("_o", F.monotonically_increasing_id()).withColumn("_k", _key(spans)), "spans")
    many = rows.groupBy("_k").agg(F.max("_o").alias("_last"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    new = rows.join(many, "_k", "left").filter("_last IS NULL OR _o = _last").drop("_last", "_o")
    if only_new and readers.exists(spark, at):
        old = readers.align(spark.read.parquet(at), schemas.SPANS)
        new = new.join(old.select(_key(old).alias("_k")).distinct(), "_k", "left_anti")
    seen = Observation("written")
    out = new.drop("source", "_k").withColumn("week", iso_week(F.col("start_time"))).observe(seen, F.count(F.lit(1)).alias("n"))
    out.write.mode("append").option("compression", "zstd").partitionBy("week").parquet(at)
    return seen.get["n"]


def write_sessions(spans: DataFrame, root: str, source: str) -> None:
    """The session rows of all spans, over again: a session that goes on gets its row anew."""
    metrics.session_rows(spans).withColumn("source", F.lit(source)).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/sessions/source={source}")


def append_sessions(spans: DataFrame, root: str, source: str) -> None:
    """The session rows of those sessions that the source does not have yet."""
    spark, at = spans.sparkSession, f"{root}/sessions/source={source}"
    rows = metrics.session_rows(spans).withColumn("source", F.lit(source))
    if readers.exists(spark, at):
        rows = rows.join(spark.read.parquet(at).select("session_id"), "session_id", "left_anti")
    rows.write.mode("append").option("compression", "zstd").parquet(at)


def write_events(events: DataFrame, path: str) -> dict[str, int]:
    """Events in their fixed schema; an empty table writes the schema. Gives the numbers by event type."""
    readers.align(events, schemas.EVENTS).write.mode("overwrite").option("compression", "zstd").parquet(path)
    n = events.sparkSession.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))
    return {r["event_type"]: r["n"] for r in n.collect()}  # as many as there are event types


def write_nested_sessions(spans: DataFrame, path: str) -> None:
    """JSON lines, a session with its spans each; a very long session has several lines, its parts."""
    query.nested_sessions(spans).write.mode("overwrite").option("timestampFormat", MICROS).json(path)


def update_categories(catalog: DataFrame, updates: DataFrame) -> DataFrame:
    """catalog (session_id, category, label, ...) with the last of updates (session_id, category, label, at) of each session; category is cut at 80 characters and label at 300, sessions without an update keep theirs."""
    last = updates.groupBy("session_id").agg(F.max_by(F.struct("category", "label"), "at").alias("_u"))
    j = catalog.join(last, "session_id", "left")
    new = {c: F.coalesce(F.substring(F.col(f"_u.{c}"), 1, n), F.col(c)) for c, n in (("category", 80), ("label", 300))}
    return j.withColumns(new).select(*catalog.columns)


def merge_raw(spark: SparkSession, files: str, out: str) -> None:
    """The spans of raw JSON-lines files as one Parquet table, of repeated ones the last by file and line."""
    rows = readers.read_span_lines(spark, files).withColumn("_o", F.monotonically_increasing_id()).withColumn("_k", F.lit(None).cast("string"))
    rows = rows.withColumn("_k", _key(rows))
    unify.keep_last(rows, ["_k"], order="_o").drop("_k", "_o").write.mode("overwrite").option("compression", "zstd").parquet(out)


def savings(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows and bytes of text of two frames with the same columns, and the share saved."""
    size = lambda df: sum((F.coalesce(F.sum(F.octet_length(F.col(c).cast("string"))), F.lit(0)) for c in df.columns), F.lit(0))
    one = lambda df, n: df.agg(F.count("*").alias(f"rows_{n}"), size(df).alias(f"bytes_{n}"))
    j = one(before, "before").join(F.broadcast(one(after, "after")))  # one row each
    return j.withColumn("saved", F.when(F.col("bytes_before") > 0, F.round(1 - F.col("bytes_after") / F.col("bytes_before"), 4)).otherwise(0.0))


def append_raw(spans: DataFrame, path: str, backend: str) -> None:
    spans.withColumns({"_backend": F.lit(backend), "_sync_time": F.current_timestamp()}).write.mode("append").option("timestampFormat", MICROS).json(path)


def write(df: DataFrame, form: str, path: str) -> None:
    """All rows to a folder, through Spark: json, csv (nested values as JSON, session_id first, then columns by name) or markdown (a file a task, rows as table lines)."""
    if form == "json":
        df.write.mode("overwrite").option("timestampFormat", MICROS).json(path)
    elif form == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).select(*_columns(df)).write.mode("overwrite").option("header", "true").option("timestampFormat", MICROS).csv(path)
    elif form == "markdown":
        cells = [F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\\\|"), "\n", " ") for c in df.columns]
        df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format {form!r}: one of {', '.join(FORMATS)}")


def _columns(df: DataFrame) -> list[str]:
    return sorted(df.columns, key=lambda c: (c != "session_id", c))


def _rows(df: DataFrame, limit: int | None) -> tuple[Iterator[dict], Callable[[], str]]:
    """The rows one after another, those of one task at a time, and what to say at the end: whether a limit that was asked for cut some off."""
    cut = [False, 0]

    def rows() -> Iterator[dict]:
        for i, r in enumerate((df if limit is None else df.limit(limit + 1)).toLocalIterator()):
            if limit is not None and i >= limit:
                cut[0] = True
                return
            cut[1] += 1
            yield r.asDict(recursive=True)

    return rows(), lambda: f"{cut[1]} rows" + (f", the first {limit}: there are more" if cut[0] else "")


def to_json(df: DataFrame, limit: int | None = None, indent: int | None = 2) -> str:
    """A JSON array of all rows; of `limit` rows if a limit is asked for, the last element then says so if there are more."""
    rows, said = _rows(df, limit)
    out: list = list(rows)
    if "more" in said():
        out.append({"cut": said()})
    return json.dumps(out, indent=indent, default=str, ensure_ascii=False)


def to_csv(df: DataFrame, limit: int | None = None) -> str:
    """Columns in order of name, session_id first; nested values as JSON; nothing for no rows. A limit that cuts is said in a last line that begins with #."""
    rows, said = _rows(df, limit)
    cols = _columns(df)
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    for n, r in enumerate(rows):
        if not n:
            w.writerow(cols)
        w.writerow([json.dumps(r[c], default=str) if isinstance(r[c], (dict, list)) else r[c] for c in cols])
    return out.getvalue() + (f"# {said()}\n" if "more" in said() else "")


def to_markdown(df: DataFrame, limit: int | None = None, width: int = 50) -> str:
    """A table with values cut at width, and a line with their number and whether a limit cut some off."""
    rows, said = _rows(df, limit)

    def cell(v) -> str:
        t = "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
        return t if len(t) <= width else t[: width - 3] + "..."

    lines = ["| " + " | ".join(cell(r[c]) for c in df.columns) + " |" for r in rows]
    if not lines:
        return "No results found."
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *lines, "", said()])


FORMATS = {"json": to_json, "csv": to_csv, "markdown": to_markdown}


def export(df: DataFrame, form: str, limit: int | None = None) -> str:
    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}: one of {', '.join(FORMATS)}")
    return FORMATS[form](df, limit)
