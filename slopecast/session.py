"""Session defaults and durable scratch space."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCOPES: list[list[str]] = []


def local_session(app: str = "slopecast", cores: str = "8", memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where nothing is configured (a local test session) is a fresh temporary
    folder made and set as the checkpoint folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _hadoop_path(spark, path, lambda fs, p: fs.deleteOnExit(p))
    for made in _SCOPES:
        made.append(path)
    return path


def _hadoop_path(spark: SparkSession, path: str, use):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return use(p.getFileSystem(spark._jsc.hadoopConfiguration()), p)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system that Spark takes it for."""
    return _hadoop_path(spark, path, lambda fs, p: fs.makeQualified(p).toString())


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch paths that no later plan reads."""
    for path in paths:
        _hadoop_path(spark, path, lambda fs, p: fs.delete(p, True))


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, which survives a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_TABLES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def reused(df: DataFrame, name: str = "reused") -> DataFrame:
    """Write once to the shared folder, read as often as needed.

    For inputs an operator scans several times: the expensive plan above it runs once,
    later scans are column-pruned Parquet with known statistics, and the table outlives
    any executor. It goes when the application ends, or earlier by :func:`release`.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _TABLES[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of ``reused`` tables that no later plan reads."""
    for t in tables:
        if (path := _TABLES.pop(t, None)) is not None:
            discard(t.sparkSession, path)


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """Collects the scratch paths made inside it, for whoever knows when they are no longer read."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.remove(made)
