"""Lineage cuts: tables written to the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session in one process
    (tests, bench) gets a local one; on a cluster that would lose rows, so it raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "verbaloom-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders written within each open scratch().
_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that materialize() writes inside are deleted at the end, except those of its results given to what this yields."""
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.materialized_at)  # an empty table may have no files to tell
        return df

    _scratch.append([])
    try:
        yield keep
    finally:
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        for root in _scratch.pop():
            if root not in kept:
                path = spark._jvm.org.apache.hadoop.fs.Path(root)
                path.getFileSystem(conf).delete(path, True)
            elif _scratch:
                _scratch[-1].append(root)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends at replicated storage, so
    a lost executor costs a re-read and never a recomputation of the whole chain."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.materialized_at = path
    return out


def folders(df: DataFrame) -> list[str]:
    """Where materialize() wrote what df reads."""
    return sorted({name.rsplit("/", 1)[0] for name in df.inputFiles()})


def _roots(df: DataFrame):
    """(file system, folder) of what df reads."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for root in folders(df):
        path = jvm.org.apache.hadoop.fs.Path(root)
        yield path.getFileSystem(conf), path


def drop_materialized(df: DataFrame) -> None:
    """Delete what materialize() wrote for df (only once no plan needs it any more)."""
    for system, path in _roots(df):
        system.delete(path, True)


def stored_bytes(df: DataFrame) -> int:
    return sum(system.getContentSummary(path).getLength() for system, path in _roots(df))
