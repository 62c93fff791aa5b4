"""Graphs as Parquet: edges and offsets by block, the blocks, the meta row, and tables for sampling.

Blocks are partition folders, so reading one block prunes to its files. Writing replaces, or refuses to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.operators.blocks import intra_block_ratio, split_blocks, vertex_block
from wayfarer.operators.sampling import alias_table, weight_accumulate
from wayfarer.operators.structure import Graph, csr_offsets

#: Names of the tables in a graph's folder, and the vertex column that tells a row's block.
EDGES, OFFSETS, BLOCKS, META = "edges", "offsets", "blocks", "meta"
RATIO, PREFIX, ALIAS, SCHEMAS = "ratio", "prefix", "alias", "schemas"
TABLES = {EDGES: "src", OFFSETS: "id", RATIO: "id", PREFIX: "src", ALIAS: "src"}


def table_path(folder: str, what: str) -> str:
    return f"{folder.rstrip('/')}/{what}"


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether a graph is stored there: its meta row is written last."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table_path(folder, META))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def delete_graph(spark: SparkSession, folder: str) -> bool:
    """Delete a stored graph with all its tables; False if there was nothing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _save(rows: DataFrame, blocks: DataFrame, folder: str, what: str, order: list[str], max_records: int) -> None:
    # A block has a bounded number of edges, so a task for each is bounded too.
    placed = vertex_block(rows, blocks, TABLES[what]).repartition("blk").sortWithinPartitions(*order)
    placed.write.option("maxRecordsPerFile", max_records).mode("overwrite").partitionBy("blk").parquet(table_path(folder, what))
    # An empty table beside it tells the schema, so that no files have to be opened for it, or be there.
    rows.sparkSession.createDataFrame([], placed.schema).write.mode("overwrite").parquet(table_path(folder, f"{SCHEMAS}/{what}"))


def _load(spark: SparkSession, folder: str, what: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(table_path(folder, f"{SCHEMAS}/{what}")).schema).parquet(table_path(folder, what))


def save_graph(graph: Graph, folder: str, budget: int, max_records: int = 1_744_830_464 // 4, replace: bool = True) -> None:
    """budget: most edges in a block. max_records: rows after which a file is closed and another begun."""
    if not replace and exists(graph.spark, folder):
        raise FileExistsError(folder)
    blocks = split_blocks(graph, budget)
    _save(csr_offsets(graph), blocks, folder, OFFSETS, ["id"], max_records)
    _save(graph.edges, blocks, folder, EDGES, ["src", "pos"], max_records)
    blocks.write.mode("overwrite").parquet(table_path(folder, BLOCKS))
    graph.meta().write.mode("overwrite").parquet(table_path(folder, META))


def save_tables(graph: Graph, folder: str, max_records: int = 1_744_830_464 // 4) -> None:
    """Beside a stored graph: share of edges within the block, prefix sums and alias tables, by block."""
    blocks = load_blocks(graph.spark, folder)
    _save(intra_block_ratio(graph, blocks), blocks, folder, RATIO, ["id"], max_records)
    _save(weight_accumulate(graph), blocks, folder, PREFIX, ["src", "pos"], max_records)
    _save(alias_table(graph), blocks, folder, ALIAS, ["src", "pos"], max_records)


def load_meta(spark: SparkSession, folder: str) -> tuple[int, int]:
    """nvertices, nedges."""
    meta = spark.read.parquet(table_path(folder, META)).first()
    return meta.nvertices, meta.nedges


def load_graph(spark: SparkSession, folder: str) -> Graph:
    edges = _load(spark, folder, EDGES).select("src", "dst", "weight", "pos")
    return Graph(edges, *load_meta(spark, folder))


def load_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(table_path(folder, BLOCKS))


def load_table(spark: SparkSession, folder: str, what: str) -> DataFrame:
    """One of TABLES, of all blocks."""
    return _load(spark, folder, what).drop("blk")


def load_block(spark: SparkSession, folder: str, blk: int, what: str = EDGES) -> DataFrame:
    """Rows of one of TABLES for one block: only its folder is read."""
    return _load(spark, folder, what).filter(F.col("blk") == blk)


def load_range(spark: SparkSession, folder: str, first: int, last: int, what: str = EDGES) -> DataFrame:
    """Rows of one of TABLES for vertices first .. last: the folders of their blocks, and in them the row groups that fit, are read."""
    blocks = load_blocks(spark, folder).filter((F.col("start_vert") <= last) & (F.col("start_vert") + F.col("nverts") > first))
    low, high = blocks.agg(F.min("blk"), F.max("blk")).first()
    vertex = F.col(TABLES[what])
    return _load(spark, folder, what).filter((F.col("blk") >= F.lit(low)) & (F.col("blk") <= F.lit(high)) & (vertex >= first) & (vertex <= last))
