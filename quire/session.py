"""Session defaults and the places where intermediate tables may live."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quire")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where none is named, a local master gets a folder of its own; on a
    cluster that would be another folder on each machine, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(root)
        return root
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jdir.isEmpty():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    return jdir.get()


_recorded: list[list[str]] = []


@contextmanager
def cleared(spark: SparkSession) -> Iterator[list[str]]:
    """Delete all scratch tables that are made inside the block once it ends, but for those that it takes off the list.

    Operators return frames that still read their scratch tables; whoever has written such a result wraps both in this.
    """
    own: list[str] = []
    _recorded.append(own)
    try:
        yield own
    finally:
        _recorded.pop()
        for path in own:
            discard(spark, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{checkpoint_root(spark)}/quire-{name}-{uuid.uuid4().hex}"
    if _recorded:
        _recorded[-1].append(path)
    return path


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df_or_path: DataFrame | str) -> None:
    """Delete a table written by materialise once nothing reads it any more."""
    paths = [df_or_path] if isinstance(df_or_path, str) else {f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()}
    for path in paths:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any Hadoop file system; none if it is absent."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(jpath)) if fs.exists(jpath) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in one piece to any Hadoop file system, in place of one of that name."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).create(jpath, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand rows to Python in Arrow batches of at most `rows`: texts may be long, and batches live outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))
