"""Session, shared folder and small plan helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "tracequarry", cores: str = "*", **conf: str) -> SparkSession:
    """A session for local work; on a cluster the caller's session is used instead."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's spark.checkpoint.dir.

    Only where that is unset and the master is local, as in tests, a temporary folder is made and set. On a cluster a folder of one machine would be lost to the others, so there it must be set.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not given and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="tracequarry-"))
    return given or sc._jsc.sc().getCheckpointDir().get()


_swept: set[str] = set()


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in this application's folder below the shared folder. The application's folder is deleted when the driver ends, or before by sweep()."""
    own = f"{shared_dir(spark).rstrip('/')}/tracequarry-{spark.sparkContext.applicationId}"
    if own not in _swept:
        _swept.add(own)
        at = spark._jvm.org.apache.hadoop.fs.Path(own)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        atexit.register(_delete, fs, at)
    return f"{own}/{what}-{uuid.uuid4().hex}"


def _delete(fs, at) -> None:
    try:
        fs.delete(at, True)
    except Exception:  # the JVM may have ended before
        pass


def sweep(spark: SparkSession) -> None:
    """Deletes all that written() and scratch() have put down for this application. Frames that were made from it cannot be read afterwards."""
    remove(spark, f"{shared_dir(spark).rstrip('/')}/tracequarry-{spark.sparkContext.applicationId}")


def written(df: DataFrame, what: str) -> DataFrame:
    """The frame as a table written to the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_path(spark: SparkSession, path: str) -> str:
    """The path for a file stream, which takes folders and patterns: of a single file, a pattern that matches just this file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return f"{path[:-1]}[{path[-1]}]" if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile() else path
