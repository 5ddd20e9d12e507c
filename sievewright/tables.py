"""Tables in the folder that a cluster's executors share: intermediate results that outlive lost executors."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []
_paths: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir of the session; in local mode a temporary one of our own
    where that is unset, while a cluster without it raises an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="sievewright-"))
        spark.sparkContext.setCheckpointDir(_own_folder[0])
    return _own_folder[0]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/sievewright/{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as a table in the shared folder and read back: it cuts lineage and outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def fewer(df: DataFrame, share: int = 20) -> DataFrame:
    """df in fewer tasks, for `written`: as many as `share` times fewer than shuffles have partitions, but two a core at least.

    To open and commit a file costs a task more than thousands of narrow rows do, and every reader pays for it again. What
    is left still grows with the shuffles' partitions; nothing is shuffled for it.
    """
    spark = df.sparkSession
    return df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // share))


def forget(*tables: DataFrame) -> None:
    """Delete tables that `written` gave, once everything that was worked out from them has been written itself."""
    for table in tables:
        if table.written_at in _paths:
            _paths.remove(table.written_at)
            drop_path(table.sparkSession, table.written_at)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more: it does so when the driver collects its
    garbage, which a driver with little to do may not for hours."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of the tables that are written in between: whoever asks deletes them, with `drop_path`."""
    before, out = len(_paths), []
    try:
        yield out
    finally:
        out += _paths[before:]
        del _paths[before:]


def clear(spark: SparkSession) -> None:
    """Delete the tables that this process has written, once nothing reads them any more."""
    while _paths:
        drop_path(spark, _paths.pop())


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Delete at the end, also after an error, what tables are written in between: for a result that has been written by then."""
    before = len(_paths)
    try:
        yield
    finally:
        while len(_paths) > before:
            drop_path(spark, _paths.pop())


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
