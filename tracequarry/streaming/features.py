"""Per-entity feature tables kept up to date by stateful streams.

Two streams follow each other. The state of the first has an entry for each distinct event, so that a redelivery is known as such, and gives out what an event adds: its
first delivery a count, each what its longest duration has grown by. The state of the second has the counters: for each entity and event key the number of events, the latest time
and the total duration, aggregated within each task before they meet, so an entity that holds a third of all events is spread like any other. After each batch
the counters that changed are written as full feature rows. Counters only grow, so the newest row of a key is the greatest: rows of several batches merge by maxima, and are folded
together, and the old ones removed, every FOLD batches.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.session import remove, scratch, stream_path, written

EVENTS = (
    "session_id string, event_id string, parent_event_id string, order_idx int, timestamp timestamp, event_type string, text string, "
    "tool_name string, tool_input string, tool_result string, subagent_type string, project_path string, git_branch string, "
    "raw_message_json string, duration_ms long"
)

# Spellings of the event types, letters only and in lower case.
EVENT_TYPES = {
    "user": "user",
    "human": "user",
    "assistant": "assistant",
    "subagent": "subagent",
    "compaction": "compaction",
    "compactboundary": "compaction",
    "tool": "tool",
    "tooluse": "tool",
}


def event_kind(event_type: Column) -> Column:
    """The event type without regard to case and punctuation; unknown spellings stay as they are in lower case, null becomes 'unknown'."""
    bare = F.regexp_replace(F.lower(event_type), "[^a-z]", "")
    known = F.create_map(*(F.lit(x) for kv in EVENT_TYPES.items() for x in kv))
    return F.coalesce(F.element_at(known, bare), F.nullif(F.trim(F.lower(event_type)), F.lit("")), F.lit("unknown"))


def tool_folded(name: Column) -> Column:
    """A tool name without exporter prefixes, case and punctuation: what all its spellings share. Empty if no tool is named."""
    low = F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))
    bare = F.regexp_replace(low, r"^(claude_code_tool_|tool_)", "")
    bare = F.regexp_replace(bare, r"^mcp[^a-z0-9]+", "")
    return F.regexp_replace(bare, "[^a-z0-9]", "")


def with_event_key(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """events with event_key: the event kind, or for tool events tool:NAME with NAME as in catalog(tool_name), tool:unknown when none is named.

    A name that isn't in the catalog keeps its trimmed spelling. The catalog is a dimension of some hundred rows: it is broadcast only while it has at most 10,000.
    """
    names = catalog.select(tool_folded(F.col("tool_name")).alias("_folded"), F.col("tool_name").alias("_own")).groupBy("_folded").agg(F.min("_own").alias("_own"))
    if catalog.limit(10_001).count() <= 10_000:
        names = F.broadcast(names)
    e = events.withColumn("_folded", F.coalesce(tool_folded(F.col("tool_name")), F.lit(""))).join(names, "_folded", "left")
    tool = F.when(F.col("_folded") == "", "unknown").otherwise(F.coalesce("_own", F.trim("tool_name")))
    kind = event_kind(F.col("event_type"))
    return e.withColumn("event_key", F.when(kind == "tool", F.concat(F.lit("tool:"), tool)).otherwise(kind)).drop("_folded", "_own")


# The state lies on disk, with one bounded cache for all of an executor's partitions.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """The settings for the time in which a query starts, which keeps them; a provider that the session has chosen stays."""
    before = {k: spark.conf.get(k, None) for k in _STATE}
    own = "spark.sql.streaming.stateStore.providerClass"
    if before[own] is not None and not before[own].endswith("HDFSBackedStateStoreProvider"):
        yield
        return
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


FEATURES = "session_id string, event_key string, n_events long, last_us long, duration_ms long"
_DURATIONS = "session_id string, event_key string, event_id string, ms long"
_CHANGES = "session_id string, event_key string, n long, us long, ms long"
#: Versions of a table that are folded into one.
FOLD = 8


def _versions(spark: SparkSession, folder: str) -> tuple[int, list[int]]:
    """(last batch folded into the base, batches after it) of a table of versions; -1 if there is no base."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    done = [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    base = max((int(n[4:]) for n in done if n.startswith("base")), default=-1)
    return base, sorted(int(n[1:]) for n in done if n.startswith("v") and int(n[1:]) > base)


def _merged(spark: SparkSession, folder: str, schema: str, keys: list[str], before: int | None = None) -> DataFrame:
    """The greatest values of each key over a table's versions, those of batches before `before`."""
    base, later = _versions(spark, folder)
    paths = [f"{folder}/base{base}"] * (base >= 0) + [f"{folder}/v{n}" for n in later if before is None or n < before]
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*paths)
    return rows.groupBy(*keys).agg(*(F.max(c).alias(c) for c in rows.columns if c not in keys))


def _fold(spark: SparkSession, folder: str, schema: str, keys: list[str], before: int) -> None:
    """Folds the versions of batches before `before` into a new base, if there are FOLD, and removes them. A base that is there beside its versions, after a failure, changes no maximum."""
    base, later = _versions(spark, folder)
    old = [n for n in later if n < before]
    if len(old) < FOLD:
        return
    _merged(spark, folder, schema, keys, before).write.mode("overwrite").parquet(f"{folder}/base{old[-1]}")
    gone = [f"{folder}/v{n}" for n in old] + [f"{folder}/base{base}"] * (base >= 0)
    for p in gone:
        remove(spark, p)


def _event_stream(events: DataFrame, catalog: DataFrame, folder: str, forget_after: str | None) -> None:
    """The first stream: writes what each batch adds to the counters to folder/changes."""
    keyed = with_event_key(events.filter("session_id IS NOT NULL AND event_id IS NOT NULL"), catalog)
    duration = F.when(F.col("duration_ms") >= 0, F.col("duration_ms"))
    seen = keyed.select("session_id", "event_key", "event_id", "timestamp", F.unix_micros("timestamp").alias("us"), duration.alias("ms"), F.current_timestamp().alias("at"))
    event = ["session_id", "event_key", "event_id"]
    by = [F.col(c) for c in event]
    if forget_after:
        seen = seen.withColumn("timestamp", F.coalesce("timestamp", "at")).withWatermark("timestamp", forget_after)
        by.append(F.window("timestamp", "1 day"))
    state = seen.groupBy(*by).agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max("us").alias("us"), F.max("ms").alias("ms"))

    def changes(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = F.col("first_at") == F.col("last_at")
        batch = written(batch.drop("window"), "changed")
        log = f"{folder}/durations"
        _fold(spark, log, _DURATIONS, event, n)
        past = _merged(spark, log, _DURATIONS, event, n).join(batch.filter(~new).select(*event), event, "left_semi").withColumnRenamed("ms", "before")
        full = batch.join(past, event, "left")
        more = F.coalesce("ms", F.lit(0)) - F.coalesce("before", F.lit(0))
        full.filter(more > 0).select(*event, "ms").write.mode("overwrite").parquet(f"{log}/v{n}")
        delta = full.groupBy("session_id", "event_key").agg(F.count_if(new).alias("n"), F.max("us").alias("us"), F.sum(more).alias("ms"))
        delta.write.mode("overwrite").parquet(f"{folder}/changes/v{n}")

    with _state_on_disk(events.sparkSession):
        q = state.writeStream.outputMode("update").foreachBatch(changes).option("checkpointLocation", f"{folder}/checkpoint-events").trigger(availableNow=True).start()
        q.awaitTermination()
    late = sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])
    if late:
        warnings.warn(f"{late} events were more than {forget_after} late and are not counted; batch_features() counts all", stacklevel=3)


def _counter_stream(spark: SparkSession, folder: str, on_batch: Callable[[DataFrame, int], None] | None) -> None:
    """The second stream: keeps the counters and writes those that changed as full rows to folder/features."""
    rows = spark.readStream.schema(_CHANGES).option("maxFilesPerTrigger", "1000").parquet(f"{folder}/changes/*")
    counters = rows.groupBy("session_id", "event_key").agg(F.sum("n").alias("n_events"), F.max("us").alias("last_us"), F.sum("ms").alias("duration_ms"))

    def upsert(batch: DataFrame, n: int) -> None:
        _fold(batch.sparkSession, f"{folder}/features", FEATURES, ["session_id", "event_key"], n)
        batch.write.mode("overwrite").parquet(f"{folder}/features/v{n}")
        if on_batch:
            on_batch(batch.sparkSession.read.schema(FEATURES).parquet(f"{folder}/features/v{n}"), n)

    with _state_on_disk(spark):
        counters.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", f"{folder}/checkpoint-counters").trigger(availableNow=True).start().awaitTermination()


def feature_stream(events: DataFrame, catalog: DataFrame, *, folder: str, forget_after: str | None = None, on_batch: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs the stream `events` to the end of what is there now; the feature table (session_id, event_key, n_events, last_us, duration_ms) after it.

    folder holds the checkpoints, what each batch added and the feature rows, so a later call goes on where this one ended; a batch that is run again after a failure writes its
    parts anew. on_batch gets the feature rows that a batch changed. Rows with null session_id are left out. n_events counts distinct event_id (rows without
    one are left out), last_us is the latest timestamp (null if there is none), duration_ms the sum over events of the longest duration that isn't negative.

    To tell redeliveries exactly, every event is remembered, on disk. With forget_after, such as '30 days', events are forgotten when the latest timestamps are that far ahead; a
    redelivery has to have its event's day. Later ones are then dropped, with a warning that has their number. batch_features() is the exact way without state.
    """
    spark = events.sparkSession
    _event_stream(events, catalog, folder, forget_after)
    if _versions(spark, f"{folder}/changes")[1]:
        _counter_stream(spark, folder, on_batch)
    return feature_table(spark, folder)


def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    """The feature rows that the streams of a folder have come to."""
    return _merged(spark, f"{folder}/features", FEATURES, ["session_id", "event_key"])


def batch_features(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """The same table of a stored table of events, without streams and state."""
    keyed = with_event_key(events.filter("session_id IS NOT NULL AND event_id IS NOT NULL"), catalog)
    once = keyed.groupBy("session_id", "event_key", "event_id").agg(F.max(F.unix_micros("timestamp")).alias("us"), F.max(F.when(F.col("duration_ms") >= 0, F.col("duration_ms"))).alias("ms"))
    return once.groupBy("session_id", "event_key").agg(F.count("*").alias("n_events"), F.max("us").alias("last_us"), F.coalesce(F.sum("ms"), F.lit(0)).alias("duration_ms"))


def event_features(spark: SparkSession, events_path: str, catalog: DataFrame, *, folder: str | None = None, files_per_batch: int = 64, forget_after: str | None = None) -> DataFrame:
    """The feature table of a folder or file of events, read as a stream in batches of files_per_batch files."""
    folder = folder or scratch(spark, "features")
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", str(files_per_batch)).parquet(stream_path(spark, events_path))
    return feature_stream(events, catalog, folder=folder, forget_after=forget_after)


def wide(features: DataFrame) -> DataFrame:
    """One row per session: counts, last times and durations as maps by event key, and their totals."""
    m = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_key", c)))).alias(c)  # noqa: E731  # at most one entry per event key of the catalog
    return features.groupBy("session_id").agg(m("n_events"), m("last_us"), m("duration_ms"), F.sum("n_events").alias("total_events"), F.max("last_us").alias("session_last_us"))
