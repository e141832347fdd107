"""Idle-gap sessions, built per time chunk and merged at the chunk borders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def gap_sessions(events: DataFrame, *, key: str, time_us: str, gap_us: int = 30 * 60_000_000, chunk_us: int = 6 * HOUR_US, sums: Sequence[str] = (), numbered: bool = False) -> DataFrame:
    """(key, start_us, end_us, n, sums...[, block]): sessions of each key, split where successive times lie more than gap_us apart; exactly gap_us does not split.

    Every row counts, so repeated rows and ties add to n. Rows with a null key or time are left out; an empty table gives no sessions. sums are columns to add up, nulls being 0; block numbers a key's sessions from 1.
    The rows are cut at multiples of chunk_us: sessions are first built within (key, chunk), so that a key with very many rows is spread
    over its chunks, then only the first and last partial session of each chunk meet in a window by key: two rows a chunk, however many events.
    """
    e = events.select(F.col(key).alias("_k"), F.col(time_us).cast("long").alias("_t"), *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in sums)).filter("_k IS NOT NULL AND _t IS NOT NULL")
    e = e.withColumn("_c", F.floor(F.col("_t") / F.lit(chunk_us)).cast("long"))
    w = Window.partitionBy("_k", "_c").orderBy("_t")
    cut = F.when(F.col("_t") - F.lag("_t").over(w) > gap_us, 1).otherwise(0)
    local = e.withColumn("_new", cut).withColumn("_s", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    added = [F.sum(c).alias(c) for c in sums]
    part = local.groupBy("_k", "_c", "_s").agg(F.min("_t").alias("a"), F.max("_t").alias("b"), F.count("*").alias("n"), *added)
    # only partial sessions that touch a chunk's first or last place can go on beyond it
    whole = Window.partitionBy("_k", "_c")
    part = part.withColumn("_last", F.max("_s").over(whole)).withColumn("_edge", (F.col("_s") == 0) | (F.col("_s") == F.col("_last")))
    inner = part.filter(~F.col("_edge")).select("_k", "a", "b", "n", *sums)
    over = Window.partitionBy("_k").orderBy("a", "b")
    edge = part.filter("_edge").withColumn("_new", F.when(F.col("a") - F.lag("b").over(over) > gap_us, 1).otherwise(0))
    edge = edge.withColumn("_g", F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    merged = edge.groupBy("_k", "_g").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"), *added)
    out = inner.unionByName(merged.drop("_g"))
    if numbered:  # one row a session meets in the window by key
        out = out.withColumn("block", F.row_number().over(Window.partitionBy("_k").orderBy("a")).cast("long"))
    return out.select(F.col("_k").alias(key), F.col("a").alias("start_us"), F.col("b").alias("end_us"), "n", *sums, *(["block"] if numbered else []))


def working_sessions(spans: DataFrame, *, gap_us: int = 30 * 60_000_000, chunk_us: int = 6 * HOUR_US) -> DataFrame:
    """(user_id, start_us, end_us, n_spans): working sessions of each user. A span (trace_id, span_id; nulls equal) counts once, at its first start_time."""
    once = spans.select("user_id", "trace_id", "span_id", F.unix_micros("start_time").alias("t")).filter("user_id IS NOT NULL AND t IS NOT NULL")
    once = once.groupBy("user_id", "trace_id", "span_id").agg(F.min("t").alias("t"))
    return gap_sessions(once, key="user_id", time_us="t", gap_us=gap_us, chunk_us=chunk_us).withColumnRenamed("n", "n_spans")
