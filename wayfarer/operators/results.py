"""What walks tell: endpoints, visits, estimates of PageRank and of personalised PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def endpoints(paths: DataFrame, steps: int) -> DataFrame:
    return paths.filter(F.col("step") == steps).select("walk_id", "source", "pos")


def visits(paths: DataFrame) -> DataFrame:
    """vertex, visits: how often walks stood on a vertex, sources counted."""
    return paths.groupBy(F.col("pos").alias("vertex")).agg(F.count("*").alias("visits"))


def pagerank(paths: DataFrame, burn_in: int) -> DataFrame:
    """vertex, hits: visits after the first hops, in proportion to the PageRank with this teleport."""
    return paths.filter(F.col("step") >= burn_in).groupBy(F.col("pos").alias("vertex")).agg(F.count("*").alias("hits"))


def ppr_topk(paths: DataFrame, k: int) -> DataFrame:
    """source, vertex, hits, rank: the k vertices that walks from a source stood on most; of equals the lowest."""
    counted = paths.groupBy("source", F.col("pos").alias("vertex")).agg(F.count("*").alias("hits"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("hits"), "vertex")).cast("long")
    return counted.withColumn("rank", place).filter(F.col("rank") <= k)
