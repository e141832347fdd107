"""Streams over span files: deduplication and idle-gap sessions with a policy for late rows."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.sources import schemas


def span_stream(spark: SparkSession, path: str, *, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schemas.SPANS).option("maxFilesPerTrigger", str(files_per_batch)).parquet(path)


def once(spans: DataFrame, *, late: str = "1 day") -> DataFrame:
    """Each (trace_id, span_id) once; a copy is known as such within `late` of the first. Rows without start_time cannot be placed in time and are left out."""
    return spans.filter("start_time IS NOT NULL").withWatermark("start_time", late).dropDuplicatesWithinWatermark(["trace_id", "span_id"])


def session_windows(spans: DataFrame, *, key: str = "user_id", gap: str = "30 minutes") -> DataFrame:
    """(key, start_time, end_time, spans): closed sessions of a stream with a watermark, or all sessions of a table. end_time is the last start, not the window's end."""
    g = spans.filter(F.col(key).isNotNull()).groupBy(F.session_window("start_time", gap).alias("w"), key)
    return g.agg(F.min("start_time").alias("start_time"), F.max("start_time").alias("end_time"), F.count("*").alias("spans")).select(key, "start_time", "end_time", "spans")


def closed_sessions(spark: SparkSession, path: str, out: str, *, late: str = "1 day", gap: str = "30 minutes", files_per_batch: int = 64) -> DataFrame:
    """Runs the stream to the end of what is there; the sessions that were closed by then, from a table that later runs append to.

    For files that arrive about in order of time: rows more than `late` behind those of earlier batches are dropped, with a warning that has their number. stored_sessions() drops none.
    """
    s = session_windows(once(span_stream(spark, path, files_per_batch=files_per_batch), late=late), gap=gap)
    q = s.writeStream.outputMode("append").format("parquet").option("path", f"{out}/sessions").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    dropped = sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])
    if dropped:
        warnings.warn(f"{dropped} rows were more than {late} late and are in no session", stacklevel=2)
    return spark.read.schema("user_id string, start_time timestamp, end_time timestamp, spans long").parquet(f"{out}/sessions")


def stored_sessions(spark: SparkSession, path: str, out: str, *, late: str = "1 day", gap: str = "30 minutes", files_per_batch: int = 64) -> DataFrame:
    """closed_sessions() of a whole stored table, whatever the order of its rows and the number of its files; out is a new folder.

    Each (trace_id, span_id) counts once, at its least start_time and with the user of its earliest copy that has one. The spans are written in slices of start_time,
    one for files_per_batch files of the table, and the stream is run to its end over one slice after another, so that no row comes late.
    """
    spans = spark.read.schema(schemas.SPANS).parquet(path)
    files = max(1, len(spans.inputFiles()))
    user = F.min_by("user_id", F.when(F.col("user_id").isNotNull(), F.struct("start_time", "user_id")))
    rows = spans.filter("start_time IS NOT NULL").groupBy("trace_id", "span_id").agg(user.alias("user_id"), F.min("start_time").alias("start_time"))
    slices = -(-files // files_per_batch)
    us = F.unix_micros("start_time")
    cuts = rows.agg(F.percentile_approx(us, [i / slices for i in range(1, slices)], 10_000)).first()[0] if slices > 1 else []
    below = F.filter(F.array(*map(F.lit, cuts or [])).cast("array<long>"), lambda c: c < us)
    rows.repartitionByRange(files, "start_time").withColumn("slice", F.size(below)).write.partitionBy("slice").parquet(f"{out}/slices")
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(out).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at(f"{out}/in"))
    found = spark.createDataFrame([], "user_id string, start_time timestamp, end_time timestamp, spans long")
    for i in range(slices):
        part = at(f"{out}/slices/slice={i}")
        if not fs.exists(part):
            continue
        for f in fs.listStatus(part):
            fs.rename(f.getPath(), at(f"{out}/in/{i:06d}-{f.getPath().getName()}"))
        found = closed_sessions(spark, f"{out}/in", out, late=late, gap=gap, files_per_batch=2**31 - 1)
    return found
