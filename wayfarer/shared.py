"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders named since each passing() that is open began.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.

    Only where it is unset and the master is local, as in tests, a folder is made up and set.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    sc.setCheckpointDir(f"file:///tmp/checkpoints/wayfarer-{uuid.uuid4().hex}")
    return sc.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """URI of a folder of its own below the shared one; it is not made yet."""
    folder = f"{shared_dir(spark)}/wayfarer/{label}-{uuid.uuid4().hex}"
    for named in _open:
        named.append(folder)
    return folder


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Folders that are named within are deleted at the end: what was made from their tables must be written elsewhere by then."""
    _open.append([])
    try:
        yield
    finally:
        for folder in _open.pop():
            delete(spark, folder)


def clear(spark: SparkSession) -> None:
    """Delete all that this package has written in the shared folder."""
    delete(spark, f"{shared_dir(spark)}/wayfarer")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return the table read back.

    What a lost executor had computed is read again from there instead of being computed again.
    """
    spark = df.sparkSession
    folder = new_folder(spark, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by written(), when nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/wayfarer/" in folder:
            delete(df.sparkSession, folder)
