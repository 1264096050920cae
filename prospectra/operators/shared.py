"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from .files import Folder


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder given to setCheckpointDir. Where neither is
    set, a session in one process takes a temporary folder; on a cluster a folder of one
    machine would lose tables, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class _Written(threading.local):
    """Folders that operators wrote in this thread, oldest first. A stream's batches run in
    threads of their own and clear their own folders."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_written = _Written()


def fresh_path(spark: SparkSession, what: str) -> str:
    """A fresh folder in the shared one, which clear() removes."""
    _written.paths.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return _written.paths[-1]


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back: it is
    computed once, its lineage is cut and it survives the loss of executors."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """stored(), for a step within an operator."""
    return stored(df, "cut")


def marked() -> int:
    """A point in time for clear()."""
    return len(_written.paths)


def clear(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Remove the folders that operators wrote since marked(), except the last ``but``.
    What was made from them must have been written by then."""
    end = len(_written.paths) - but
    for path in _written.paths[since:end]:
        Folder(spark, path).remove()
    del _written.paths[since:end]


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not installed."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}" if known else root
