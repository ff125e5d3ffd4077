"""Intermediate tables on storage that every executor and the driver can reach."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_folders: list[str] = []


def _one_machine(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def warehouse_root(spark: SparkSession) -> str:
    """A folder of the warehouse, whose default is a folder of the driver: on a cluster such a one
    is refused."""
    warehouse = spark._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.sql.warehouse.dir"))
    system = warehouse.getFileSystem(spark._jsc.hadoopConfiguration())
    root = system.makeQualified(warehouse).toString()
    if root.startswith("file:") and not _one_machine(spark):
        raise RuntimeError(
            f"{root} may be a folder of one machine: set spark.checkpoint.dir to shared storage"
        )
    return root.rstrip("/") + "/_runs"


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the checkpoint folder of the context, else the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    return warehouse_root(spark)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through the Hadoop file system that it is on."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is at path, on the Hadoop file system that it names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def _drop_session_folder(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended already
        delete_folder(spark, path)


def run_folder(spark: SparkSession) -> str:
    """Where stage() writes now: the innermost run_scope, else one folder for this session,
    which goes when the Python process ends."""
    if _folders:
        return _folders[-1]
    app = spark.sparkContext.applicationId
    path = f"{shared_root(spark)}/sentrylake-{app}"
    if path not in _sessions:
        _sessions.add(path)
        atexit.register(_drop_session_folder, spark, path)
    return path


_sessions: set[str] = set()


@contextlib.contextmanager
def run_scope(spark: SparkSession) -> Iterator[str]:
    """Tables staged inside live in one folder that is deleted on leaving; whatever is read
    from them has to be written out before."""
    path = f"{shared_root(spark)}/sentrylake-run-{uuid.uuid4().hex}"
    _folders.append(path)
    try:
        yield path
    finally:
        _folders.remove(path)
        delete_folder(spark, path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df once as parquet and read it back, so that later steps neither recompute it
    nor depend on the executors that produced it."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_observed(df: DataFrame, label: str, *measures: Column) -> tuple[DataFrame, dict]:
    """stage(), with aggregates over the rows taken while they are written."""
    seen = Observation()
    return stage(df.observe(seen, *measures), label), seen.get
