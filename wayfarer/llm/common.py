"""Pieces that several operators use: files by URI, Arrow batches, figures of groups."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfarer.shared import drop_written, new_folder, shared_dir, written

__all__ = ["CACHES", "arrow_limits", "batches_of", "drop_written", "free_shuffles", "new_folder", "open_store", "release", "rows_per_batch", "shared_dir", "shuffles_end", "to_batch", "trim", "unused", "with_group_figures", "written"]

#: Characters that count as white space in this package's word rules: space and U+0009 to U+000D.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, for executors; a bare path is a local one."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


#: Functions that empty caches of operators; a worker serves one operator after another.
CACHES: list[Callable[[], None]] = []


def release() -> None:
    """Empty operators' caches, and give memory that nothing uses any more back to the system: workers live on after a task."""
    for clear in CACHES:
        clear()
    trim()


def trim() -> None:
    """Give memory that nothing uses any more back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of plans that nothing refers to: it does when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def arrow_limits(spark: SparkSession, rows: int = 2000) -> None:
    """Keep Arrow batches small enough for very long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


@contextlib.contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of fewer rows, for what is executed within."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(kept)) if int(kept) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, kept)


@contextlib.contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that is executed within are deleted when it ends.

    Else they stay until the driver's garbage is collected, and those of the last query longer: Spark's listeners hold its plan until
    there is another.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, kept)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Gather tuples into record batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield to_batch(held, schema)
            held = []
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def unused(name: str, taken: Iterable[str]) -> str:
    """name, with underscores in front until no column is called so; Spark's names don't tell case apart."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name = "_" + name
    return name


def with_group_figures(df: DataFrame, key: str, row: Column, figures: dict[str, tuple[Column, str]], salts: int | None = None) -> DataFrame:
    """Add to every row figures of its group, such as its least id, without gathering the group.

    figures: name -> (value, one of min, max, sum). Rows of a key are dealt over ``salts`` parts by
    a hash of ``row``; each part is aggregated, the parts of a key (one row each, ``salts`` at most)
    are combined in a window, and the figures go back to the rows by (key, part). A key that holds a
    third of all rows thus spreads over as many tasks. Null keys form a group of their own.
    """
    spark = df.sparkSession
    salts = salts or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    agg = {"min": F.min, "max": F.max, "sum": F.sum}
    own_key, own_salt, k, s = (unused(n, [*df.columns, *figures]) for n in ("key", "salt", "their_key", "their_salt"))
    salted = df.withColumn(own_key, F.col(key)).withColumn(own_salt, F.pmod(F.xxhash64(row), F.lit(salts)))
    parts = salted.groupBy(own_key, own_salt).agg(*[agg[how](value).alias(name) for name, (value, how) in figures.items()])
    whole = Window.partitionBy(own_key)
    parts = parts.select(F.col(own_key).alias(k), F.col(own_salt).alias(s), *[agg[how](name).over(whole).alias(name) for name, (_, how) in figures.items()])
    joined = salted.join(parts, salted[own_key].eqNullSafe(parts[k]) & (salted[own_salt] == parts[s]), "left")
    return joined.drop(own_key, own_salt, k, s)
