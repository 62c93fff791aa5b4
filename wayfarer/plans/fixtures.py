"""Graphs from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfarer.operators.structure import Graph, graph

#: A total order of a customer's lines; order key and line number alone are not unique.
LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's order lines as edges to parts, weighted by quantity; both ids share one space."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").cast("long").alias("weight"), *LINE_ORDER)


def customer_part(spark: SparkSession, sf_dir: str) -> Graph:
    return graph(customer_part_edges(spark, sf_dir), LINE_ORDER)


def customer_part_priced(spark: SparkSession, sf_dir: str) -> Graph:
    """The same edges with fractions as weights: price in thousands."""
    return graph(customer_part_edges(spark, sf_dir).withColumn("weight", F.col("l_extendedprice") / 1000.0), LINE_ORDER)


def event_transitions(spark: SparkSession, sf_dir: str) -> Graph:
    """Event types, with how often a user's next event is of another type as weight."""
    events = table(spark, sf_dir, "events")
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = events.select(F.col("event_type").alias("a"), after.alias("b")).filter("b is not null").groupBy("a", "b").agg(F.count("*").alias("weight"))
    ids = events.select("event_type").distinct().select("event_type", (F.dense_rank().over(Window.orderBy("event_type")) - 1).cast("long").alias("id"))
    named = pairs.join(ids.withColumnsRenamed({"event_type": "a", "id": "src"}), "a").join(ids.withColumnsRenamed({"event_type": "b", "id": "dst"}), "b")
    return graph(named.select("src", "dst", "weight"), ("dst",))


def customer_supplier(spark: SparkSession, sf_dir: str) -> Graph:
    """Who bought from whom, in both directions, once each; suppliers' ids follow the customers'."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    shift = table(spark, sf_dir, "customer").agg(F.max("c_custkey") + 1).first()[0]
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + shift).alias("dst")).distinct()
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph(both.withColumn("weight", F.lit(1).cast("long")), ("dst",))
