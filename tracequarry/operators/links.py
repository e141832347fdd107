"""Order-sensitive links between rows: chains, intervals, subsets, packing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.functions import classify as C
from tracequarry.functions import text as T
from tracequarry.operators.sessions import HOUR_US
from tracequarry.session import written


def continuation_links(spans: DataFrame, *, max_gap_s: int = 60, chunk_s: int = 86_400) -> DataFrame:
    """(session_id, previous_id, gap_s): sessions that go on where the session that starts directly before them ended, at most max_gap_s seconds earlier.

    A global order is needed, but no window over everything: sessions are ordered within chunks of time, and each chunk's first is linked by a window over one row a chunk.
    """
    s = spans.filter("session_id IS NOT NULL AND start_time IS NOT NULL").groupBy("session_id").agg(
        F.min("start_time").alias("a"), F.max(F.coalesce("end_time", "start_time")).alias("b"), F.bool_or(F.coalesce(F.col("input_value").contains(C.COMPACTION_CONTINUED), F.lit(False))).alias("goes_on")
    )
    s = s.withColumn("c", F.floor(F.unix_seconds("a") / F.lit(chunk_s)))
    w = Window.partitionBy("c").orderBy("a", "session_id")
    me = F.struct("a", "session_id", "b")
    s = s.withColumn("prev", F.lag(me).over(w))
    ends = s.groupBy("c").agg(F.max(me).alias("last"))
    over = Window.orderBy("c")  # one row a chunk of time
    ends = ends.select("c", F.lag("last").over(over).alias("before"))
    s = s.join(ends, "c").withColumn("prev", F.coalesce("prev", "before"))
    gap = (F.unix_micros("a") - F.unix_micros("prev.b")) / 1e6
    return s.withColumn("gap_s", gap).filter(F.col("goes_on") & F.col("gap_s").between(0, max_gap_s)).select("session_id", F.col("prev.session_id").alias("previous_id"), "gap_s")


def chain_lengths(chains: DataFrame) -> DataFrame:
    """(bucket, chains) of the number of sessions: 1, 2, 3, 4-5, 6-10, 11+."""
    n = F.col("sessions")
    b = F.when(n <= 3, n.cast("string")).when(n <= 5, "4-5").when(n <= 10, "6-10").otherwise("11+")
    return chains.groupBy(b.alias("bucket")).agg(F.count("*").alias("chains"))


def merge_intervals(df: DataFrame, *, key: str, start: str, end: str, chunk_us: int = 6 * HOUR_US) -> DataFrame:
    """(key, start, end): the union of each key's intervals (timestamps); those that touch are joined, ends before starts and nulls are left out.

    The intervals are cut into time chunks by their starts: within (key, chunk) they are united first, so a key with very many is spread over its chunks; what is left of each
    chunk then meets in a window by key. How far the intervals before a chunk reach is a running maximum over one row a chunk.
    """
    us = lambda c: F.unix_micros(c) if dict(df.dtypes)[c].startswith("timestamp") else F.col(c).cast("long")
    d = df.select(F.col(key).alias("k"), us(start).alias("a"), us(end).alias("b")).filter("a <= b").withColumn("c", F.floor(F.col("a") / F.lit(chunk_us)))

    def united(x: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("a", "b")
        x = x.withColumn("reach", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        x = x.withColumn("g", F.sum(F.when(F.col("reach").isNull() | (F.col("a") > F.col("reach")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return x.groupBy(*by, "g").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("g")

    part = united(d, "k", "c")
    before = Window.partitionBy("k").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    reach = part.groupBy("k", "c").agg(F.max("b").alias("b"), F.min("a").alias("first")).withColumn("come", F.max("b").over(before))
    reach = reach.withColumn("next", F.lead("first").over(Window.partitionBy("k").orderBy("c"))).select(F.col("k").alias("rk"), F.col("c").alias("rc"), "come", "next")
    # only what an earlier chunk reaches, or what reaches the next chunk, can be joined beyond its chunk
    j = part.join(reach, part["k"].eqNullSafe(F.col("rk")) & (F.col("c") == F.col("rc"))).drop("rk", "rc")
    edge = F.coalesce(F.col("a") <= F.col("come"), F.lit(False)) | F.coalesce(F.col("b") >= F.col("next"), F.lit(False))
    out = j.filter(~edge).select("k", "a", "b").unionByName(united(j.filter(edge).select("k", "a", "b"), "k"))
    back = lambda c, name: (F.timestamp_micros(c) if dict(df.dtypes)[name].startswith("timestamp") else F.col(c).cast(dict(df.dtypes)[name])).alias(name)
    return out.select(F.col("k").alias(key), back("a", start), back("b", end))


def interval_gaps(merged: DataFrame, *, key: str, start: str, end: str) -> DataFrame:
    """(key, gap_start, gap_end): what lies between a key's merged intervals."""
    w = Window.partitionBy(key).orderBy(start)
    return merged.withColumn("gap_end", F.lead(start).over(w)).filter("gap_end IS NOT NULL").select(key, F.col(end).alias("gap_start"), "gap_end")


def _chunk_sets(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, h) of the distinct chunks, and (id, n, s): how many an id has and what ids with the same chunks share."""
    h = chunks.filter("chunk IS NOT NULL").select(F.col("id"), F.unhex(T.content_hash(F.col("chunk"))).alias("h")).distinct()
    return h, h.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.xxhash64("h").cast("decimal(38,0)")).alias("s"))


def containment_classes(texts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, class_id, text_id, chunks, relation): each id of texts(id, text) with the representative of its class in containment(chunks).

    text_id is the least id with exactly this text. relation is representative; copy, the text being that of text_id; complete, where the text differs from that of every
    lesser id but the chunks are the representative's. Members of a class with different text_id are complete subsets of each other, both ways. Without chunks there is no class and no relation.
    """
    _, sig = _chunk_sets(chunks)
    rep = sig.groupBy("n", "s").agg(F.min("id").alias("class_id"))
    member = sig.join(rep, ["n", "s"]).select("id", "class_id", "n")
    t = texts.select("id", F.sha2("text", 256).alias("t"))
    first = t.filter("t IS NOT NULL").groupBy("t").agg(F.min("id").alias("text_id"))
    relation = F.when(F.col("id") == F.col("class_id"), "representative").when(F.col("class_id").isNotNull(), F.when(F.col("id") == F.col("text_id"), "complete").otherwise("copy"))
    return t.join(first, "t", "left").join(member, "id", "left").select("id", "class_id", "text_id", F.coalesce("n", F.lit(0)).alias("chunks"), relation.alias("relation"))


def containment(chunks: DataFrame, *, complete: float = 95.0, review: float = 80.0, least: float = 50.0) -> DataFrame:
    """(child, parent, overlap, relation): of chunks(id, chunk) which ids' chunks lie in another's, in percent of the child's distinct chunks.

    Compared are ids that share a chunk, the child having no more chunks than the parent (ties by id); relation is complete, review or keep_both; below `least` nothing is said.
    Ids with the same chunks are one class with its least id as representative, so copies give no pairs among themselves; containment_classes() has the members.
    """
    h, sig = _chunk_sets(chunks)
    rep = sig.groupBy("n", "s").agg(F.min("id").alias("id"))
    r = h.join(rep.select("id", "n"), "id")
    often = r.groupBy("h").agg(F.count("*").alias("often"))
    r = written(r.join(often, "h"), "chunks")
    # of a child's n chunks at least `need` must lie in the parent, so one of its n - need + 1 rarest does: common chunks find no candidates
    need = F.greatest(F.ceil(F.col("n") * least / 100.0), F.lit(1))
    rare = r.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("often", "h"))).filter(F.col("r") <= F.col("n") - need + 1)
    smaller = (F.col("a.n") < F.col("b.n")) | (F.col("a.n") == F.col("b.n")) & (F.col("a.id") < F.col("b.id"))
    near = rare.alias("a").join(r.alias("b"), (F.col("a.h") == F.col("b.h")) & smaller).select(F.col("a.id").alias("child"), F.col("b.id").alias("parent"), F.col("a.n").alias("n")).distinct()
    own = near.join(r.select(F.col("id").alias("child"), "h"), "child")
    pairs = own.join(r.select(F.col("id").alias("parent"), "h"), ["parent", "h"]).groupBy("child", "parent", "n").agg(F.count("*").alias("k"))
    share = F.round(100.0 * F.col("k") / F.col("n"), 2)
    relation = F.when(share >= complete, "complete").when(share >= review, "review").otherwise("keep_both")
    return pairs.withColumn("overlap", share).filter(F.col("overlap") >= least).select("child", "parent", "overlap", relation.alias("relation"))


def _scan(rows: DataFrame, step: Callable[[tuple, int], tuple[tuple, int | None]], start: tuple, name: str) -> DataFrame:
    """rows (key, ord, n) with what `step` makes of them in the order of each key: step(state, n) gives the next state and the value, null values being dropped.

    Rows are sorted within tasks and read in Arrow batches, of which one is in memory at a time: only the state is carried on, however long a key is.
    """
    t = dict(rows.dtypes)

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, first = None, start, True
        for b in got:
            values = []
            for k, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if first or k != key:
                    key, state, first = k, start, False
                state, v = step(state, n)
                values.append(v)
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.int64())], names=["key", "ord", "n", name])
            yield out.filter(out.column(3).is_valid())

    return rows.repartition("key").sortWithinPartitions("key", "ord").mapInArrow(run, f"key {t['key']}, ord {t['ord']}, n long, {name} long")


def batches(rows: DataFrame, *, key: str, order: str, size: str, max_rows: int = 100, max_size: int = 8000) -> DataFrame:
    """(key, ord, size, batch_no): within a key in order, a new batch begins where the next row would pass max_rows or max_size. A reset depends on all rows before it, so a key's rows, which are narrow here, are read in turn."""

    def step(state: tuple, n: int) -> tuple[tuple, int]:
        no, held, total = state
        if held and (held >= max_rows or total + n > max_size):
            no, held, total = no + 1, 0, 0
        return (no, held + 1, total + n), no

    d = rows.select(F.col(key).alias("key"), F.col(order).alias("ord"), F.col(size).cast("long").alias("n"))
    return _scan(d, step, (0, 0, 0), "batch_no").select("key", "ord", F.col("n").alias("size"), F.col("batch_no").cast("int").alias("batch_no"))


def growing(rows: DataFrame, *, key: str, order: str, count: str, floor: int = 4) -> DataFrame:
    """(key, ord, n) of the rows kept by a running maximum with resets: a count is kept if it exceeds the last kept one, or drops below half of it while at least floor. Null counts are left out."""

    def step(state: tuple, n: int) -> tuple[tuple, int | None]:
        ok = n > state[0] or n < state[0] / 2 and n >= floor
        return ((n,), 1) if ok else (state, None)

    d = rows.select(F.col(key).alias("key"), F.col(order).alias("ord"), F.col(count).cast("long").alias("n")).filter("n IS NOT NULL")
    return _scan(d, step, (-1,), "kept").drop("kept")
