"""Tables written once to a shared folder: lineage ends there, and commits are whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and all runs on this machine (tests and other local runs).
LOCAL_FOLDER = "/tmp/checkpoints"
#: Paths that are removed when the block that watches them ends, innermost block last.
WATCHED: list[list[str]] = []


class NoSharedFolder(RuntimeError):
    """A cluster whose session names no folder that driver and executors share."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or the folder that
    was set with setCheckpointDir."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    return folder_for(named, spark.sparkContext.master)


def folder_for(named: str | None, master: str) -> str:
    """The named folder; without one a cluster is refused, as each executor would write to its own disk."""
    if named:
        return named.rstrip("/")
    if master != "local" and not master.startswith("local["):
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that driver and executors share")
    return LOCAL_FOLDER


def write_new(frame: DataFrame, name: str) -> str:
    """Write the frame to a folder of its own; its path."""
    path = f"{shared_folder(frame.sparkSession)}/silverloom/{name}-{uuid.uuid4().hex}"
    if WATCHED:
        WATCHED[-1].append(path)
    frame.write.option("compression", "zstd").parquet(path)
    return path


def settle(frame: DataFrame, name: str) -> DataFrame:
    """Write the frame to the shared folder and read it back."""
    return frame.sparkSession.read.schema(frame.schema).parquet(write_new(frame, name))


def remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Whatever is settled inside is removed at the end: for a job whose results are elsewhere by then.
    Not for calls on a State, whose tables live on."""
    WATCHED.append([])
    try:
        yield
    finally:
        remove(spark, WATCHED.pop())
